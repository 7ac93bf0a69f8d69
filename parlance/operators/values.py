"""JSON values as rows: type-strict comparison that names where two values differ.

A value becomes one row for each of its parts: path, type and text. Types are those of the text: 1, 1.0, true and "1" are an integer, a number,
a boolean and a string wherever they stand; integers of any size and the exact value of numbers are kept. Objects and arrays
have rows of their own, so empty ones count. Two values are the same when their rows are the same multiset; the order of keys
is no matter. Texts that are not strict JSON (repeated keys, NaN, anything after the value) are one row of type 'invalid'; a missing text is one of type 'missing'.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = "path string, type string, value string"


class _Bad(ValueError):
    pass


def _object(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Bad("repeated key")
    return out


def _refuse(name: str):
    raise _Bad(name)


def parts(text: str | None) -> list[tuple[str, str, str]]:
    """(path, type, value) of every part of a JSON text."""
    if text is None:
        return [("$", "missing", "")]
    try:
        top = json.loads(text, object_pairs_hook=_object, parse_constant=_refuse, parse_int=lambda s: ("integer", s.removeprefix("-") if s == "-0" else s), parse_float=lambda s: ("number", repr(float(s))))
    except (ValueError, RecursionError):
        return [("$", "invalid", text)]
    out, open_ = [], [("$", top)]
    while open_:
        path, v = open_.pop()
        if isinstance(v, dict):
            out.append((path, "object", ""))
            open_ += [(f"{path}[{json.dumps(k, ensure_ascii=False)}]", x) for k, x in v.items()]
        elif isinstance(v, list):
            out.append((path, "array", ""))
            open_ += [(f"{path}[{i}]", x) for i, x in enumerate(v)]
        elif isinstance(v, tuple):
            out.append((path, *v))
        elif isinstance(v, bool):
            out.append((path, "boolean", str(v).lower()))
        else:
            out.append((path, "null", "") if v is None else (path, "string", v))
    return out


def flattened(df: DataFrame, key: str, document: Column) -> DataFrame:
    """(key, path, type, value): a row for each part of each document."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *p) for i, text in enumerate(batch.column("document").to_pylist()) for p in parts(text)]
            at, *found = zip(*rows, strict=True) if rows else ((), (), (), ())
            keys = batch.column("key").take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, pa.string()) for c in found]], ["key", "path", "type", "value"])

    flat = df.select(F.col(key).alias("key"), document.cast("string").alias("document")).mapInArrow(run, f"key {kind}, {PARTS}")
    return flat.withColumnRenamed("key", key)


def differences(left: DataFrame, right: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, left_type, left_value, right_type, right_value) for each part that one side lacks or has otherwise; keys of one side only
    are named by their missing document. Documents that are the same text are not taken apart. Keys are unique on each side."""
    a, b = left.select(F.col(key).alias("k"), F.col(document).alias("a"), F.lit(True).alias("in_a")), right.select(F.col(key).alias("k2"), F.col(document).alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, F.col("k").eqNullSafe(F.col("k2")), "full_outer")
    both = both.where("in_a IS NULL OR in_b IS NULL OR NOT a <=> b").select(F.when(F.col("in_a"), F.col("k")).otherwise(F.col("k2")).alias(key), "a", "b")
    one = lambda c, side: flattened(both, key, F.col(c)).withColumn("side", F.lit(side))
    rows = one("a", "left").unionByName(one("b", "right"))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
    met = rows.groupBy(key, "path").agg(pick("left", "type"), pick("left", "value"), pick("right", "type"), pick("right", "value"))
    return met.where("NOT (left_type <=> right_type AND left_value <=> right_value)")
