"""parlance: dialogue-corpus analytics as declarative Spark plans."""
