"""Prefix aggregates: what came before each row of its group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def prefixes(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column], lasts: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """rows with, per name, the sum over the earlier rows of the group (0 for none), or the last value there that is not null.

    A group is cut into ranges of `order`, a whole number that tells its rows apart. Each range is a window of its own and gives
    one row to the offsets, so a group that a third of all rows belongs to is worked on by many tasks. Null keys are a group.
    """
    lasts = lasts or {}
    x = rows.withColumns({f"_v_{n}": c for n, c in (sums | lasts).items()} | {"_block": F.floor(F.col(order) / block)})
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col(order)
    each = x.groupBy(*keys, "_block").agg(
        *[F.sum(f"_v_{n}").alias(n) for n in sums], *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(n) for n in lasts],
    )
    offsets = each.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"),
        *[F.sum(n).over(before).alias(f"_o_{n}") for n in sums], *[F.last(n, ignorenulls=True).over(before).alias(f"_o_{n}") for n in lasts],
    )
    zero = F.lit(0)
    x = x.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in sums} | {f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in lasts})
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    found = {n: F.coalesce(f"_o_{n}", zero) + F.coalesce(f"_i_{n}", zero) for n in sums} | {n: F.coalesce(f"_i_{n}", f"_o_{n}") for n in lasts}
    return x.join(offsets, same).select(*[F.col(c) for c in rows.columns], *[v.alias(n) for n, v in found.items()])
