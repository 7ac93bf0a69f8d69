"""Files of records: JSON lines with their numbers, CSV with an exact header, hashes, and strict contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.checks import ContractViolation, report, violations


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType | str) -> DataFrame:
    """JSON lines under an explicit schema: blank lines are skipped, a malformed line ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, file, line, json, sha256) of every line that is not blank; the physical line number counts blank lines.

    A file is read in splits by as many tasks as its size asks for. Lines are numbered within their split, in the order in which the task
    read them, and offset by the counts of the splits before; a split's lines are all that meets in one task. Lines end with LF or CRLF;
    sha256 is of the line without its end. Should files or splits change between the two passes over them, the read fails."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    split = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    own = raw.select(*split, F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row"), "value")
    own = own.withColumn("inside", F.row_number().over(Window.partitionBy("path", "block").orderBy("row")))
    sizes = raw.select(*split).groupBy("path", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("path").alias("s_path"), F.col("block").alias("s_block"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    x = own.join(sizes, (F.col("path") == F.col("s_path")) & (F.col("block") == F.col("s_block")), "left")
    line = F.when(F.col("inside") <= F.col("n"), F.col("before") + F.col("inside")).otherwise(F.raise_error(F.concat(F.lit("splits changed while being read: "), "path")).cast("long"))
    text = F.regexp_replace("value", r"\r$", "")
    return x.select("path", "file", line.cast("long").alias("line"), text.alias("json")).where(F.trim("json") != "").withColumn("sha256", F.sha2("json", 256))


def running_lines(lines: DataFrame) -> DataFrame:
    """lines with `at`: their number counted on over the files in the order of their paths, as if they were one; trailing blank lines of a
    file are not counted."""
    sizes = lines.groupBy("path").agg(F.max("line").alias("n"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    sizes = sizes.select(F.col("path").alias("s_path"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(sizes, F.col("path") == F.col("s_path")).withColumn("at", F.col("before") + F.col("line")).drop("s_path", "before")


def parsed_lines(lines: DataFrame, schema: StructType | str) -> DataFrame:
    """read_lines with a record column; a line that is not strict JSON (duplicate keys, NaN) has a null record."""
    strict = F.try_parse_json("json").isNotNull() & (F.substring(F.ltrim("json"), 1, 1) == "{")
    return lines.withColumn("record", F.when(strict, F.from_json("json", schema)))


def line_violations(lines: DataFrame, schema: StructType | str) -> DataFrame:
    """Lines of read_lines that are no JSON object, as violation rows named file:line."""
    return violations(parsed_lines(lines, schema), "S1", F.concat_ws(":", "file", "line"), F.col("record").isNull(), F.left("json", F.lit(80)))


def with_provenance(df: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows that carry `path`, with the hash of that file as file_sha256; null where none is known."""
    return df.join(hashes.select("path", F.col("sha256").alias("file_sha256")), "path", "left")


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, file, sha256) of every file under a path. A file is one row here; for larger ones see operators/manifest.py."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.sha2("content", 256).alias("sha256"))


def read_split_files(spark: SparkSession, splits: dict[str, str], schema: StructType | str, expected: dict[str, str] | None = None) -> DataFrame:
    """(split, path, line, json, sha256, file_sha256, record): the lines of several splits with where they come from, behind a hash gate.

    expected: SHA-256 of each split's file; a file that is missing or differs ends the read before any line is returned."""
    if unknown := sorted(set(splits) - set(expected if expected is not None else splits)):
        raise ContractViolation(f"no hash is registered for {', '.join(unknown)}")
    parts = []
    for name, path in splits.items():
        hashes = file_hashes(spark, path)
        if expected is not None and [r.sha256 for r in hashes.select("sha256").limit(2).collect()] != [expected[name]]:
            raise ContractViolation(f"{name}: {path} is not the file that is registered")
        lines = with_provenance(parsed_lines(read_lines(spark, path), schema), hashes)
        parts.append(lines.select(F.lit(name).alias("split"), "path", "line", "json", "sha256", "file_sha256", "record"))
    return union_all(parts)


def split_line_violations(lines: DataFrame, record_id: str = "id", split: str = "split") -> DataFrame:
    """read_split_files' rows that are no record, have no id, repeat one, or state another split: named path:line. record_id and split are
    fields of the record (split may be nested, with points)."""
    at = F.concat_ws(":", "path", "line")
    i, stated = F.col(f"record.{record_id}"), F.col(f"record.{split}")
    has = F.col("record").isNotNull()
    first = lines.where(has).groupBy(i.alias("id")).agg(F.count("*").alias("n")).where("n > 1 AND id IS NOT NULL")
    again = lines.join(first, i == F.col("id"), "left_semi")
    return report([
        violations(lines, "S3", at, ~has, F.lit("no JSON object")), violations(lines.where(has), "S3", at, F.coalesce(i.cast("string") == "", F.lit(True)), F.lit("no id")),
        violations(again, "S3", at, F.lit(True), F.concat(F.lit("repeated id "), i.cast("string"))), violations(lines.where(has), "S3", at, ~stated.eqNullSafe(F.col("split")), stated),
    ])


def require_hashes(spark: SparkSession, path: str, expected: dict[str, str]) -> None:
    """The hash gate before a read: every file named must be there with its hash. One row per named file is read."""
    found = {r.file: r.sha256 for r in file_hashes(spark, path).where(F.col("file").isin(*expected)).collect()}
    bad = sorted(f for f, h in expected.items() if found.get(f) != h)
    if bad:
        raise ContractViolation(f"hash differs or file is missing: {', '.join(bad)}")


def read_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """CSV with an exact set of columns, quoted commas and line breaks, and perhaps a byte order mark."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    names = [c.removeprefix("﻿") for c in df.columns]
    if set(names) != set(header) or len(names) != len(header):
        raise ContractViolation(f"columns missing: {sorted(set(header) - set(names))}, unexpected: {sorted(set(names) - set(header))}")
    return df.toDF(*names).select(*header)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def protected_excerpts(df: DataFrame, column: str = "text_excerpt", least: int = 8) -> DataFrame:
    return df.where(F.length(F.trim(F.col(column))) >= least)
