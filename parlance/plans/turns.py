"""Queries on dialogue turns."""

from __future__ import annotations

from ..operators.turns import expand_turns
from ..sources.tables import table

QUERIES = {
    "turn_expand_all": lambda spark, d: expand_turns(table(spark, d, "conversations")).selectExpr("conv_id", "turn", "assistant_turn_index", "assistant_turn_count", "to_json(prompt) AS prompt_json", "completion"),
}
SQL = {
    "turn_expand_all": """
        SELECT conv_id, turn, assistant_turn_index, assistant_turn_count, to_json(p)::varchar AS prompt_json, completion FROM (
          SELECT conv_id, turn, role, text AS completion,
                 list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
                 CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS assistant_turn_index,
                 CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS BIGINT) AS assistant_turn_count
          FROM conversations) WHERE role = 'assistant'""",
}
