"""The queries of this subpackage; SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_tree, warc
from .context_tree import op4_context_tree
from .fingerprints import op6_fingerprints
from .jaccard_join import op9_jaccard_join
from .mixing import op1_mixing
from .name_join import op12_name_join
from .pieces import op8_sentencepiece
from .suffix_array import op7_suffix_array
from .suffix_tree import op2_suffix_tree
from .toxicity import op3_toxicity
from .tree_search import op11_tree_search
from .vector_forest import op5_vector_forest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_toxicity": op3_toxicity,
    "op4_context_tree": op4_context_tree,
    "op5_vector_forest": op5_vector_forest,
    "op6_fingerprints": op6_fingerprints,
    "op7_suffix_array": op7_suffix_array,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_warc": warc.op10_warc,
    "op11_tree_search": op11_tree_search,
    "op12_name_join": op12_name_join,
    "op13_ball_tree": ball_tree.op13_ball_tree,
}

SQL: dict[str, str] = {"op10_warc": warc.SQL, "op13_ball_tree": ball_tree.SQL}
