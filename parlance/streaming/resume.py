"""Incremental judging as a stream: each new request once, the call audit before the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.checks import report, require, violations


AUDIT = "request_id string, status string, judgment string, fingerprint string, judgment_sha256 string, batch long, try int"
RESULTS = "request_id string, judgment string, judgment_sha256 string, batch long"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is under a folder of batches; empty where nothing is yet."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def unbacked(results: DataFrame, audit: DataFrame) -> DataFrame:
    """(rule_id, record_id, detail): stored results that no successful call stands behind with this very judgment, or that are there twice."""
    own = results.withColumn("judgment_sha256", F.sha2("judgment", 256))
    calls = audit.where("status = 'ok' AND trim(fingerprint) <> ''").select("request_id", "judgment_sha256")
    again = results.groupBy("request_id").agg(F.count("*").alias("n"))
    return report([
        violations(own.join(calls, ["request_id", "judgment_sha256"], "left_anti"), "D17", F.col("request_id"), F.lit(True), F.lit("no successful call")), violations(again, "D17", F.col("request_id"), F.col("n") > 1, F.lit("repeated result")),
    ])


def run_pending(spark: SparkSession, requests: str, schema: str, results: str, audit: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame], audited: Callable[[int], None] = lambda batch: None) -> StreamingQuery:
    """Judges the requests under a folder that have no result yet, then stops; started again, it goes on from there.

    judge takes requests and gives (request_id, status, judgment, fingerprint). A batch is written as a folder of its number: first the calls, each
    try of the batch in a folder of its own so that no call is ever lost, then the results, read from that try and put in the place of what an
    earlier try left. A batch that died in between is replayed under its number and leaves one result for each request. Before anything
    is judged, all stored results must have their call in the audit. More than one fingerprint stops the run before its results are written.
    audited is called with the batch between the two writes.
    """
    require(unbacked(stored(spark, results, RESULTS), stored(spark, audit, AUDIT)))

    def batch(df: DataFrame, n: int) -> None:
        s = df.sparkSession
        done = stored(s, results, RESULTS).where(F.col("batch") != n).select("request_id")
        tries = stored(s, audit, AUDIT).where(F.col("batch") == n).agg(F.max("try").alias("t")).first().t
        path = f"{audit}/batch={n}/try={0 if tries is None else tries + 1}"
        judged = judge(df.dropDuplicates(["request_id"]).join(done, "request_id", "left_anti"))
        judged.select("request_id", "status", "judgment", "fingerprint", F.sha2("judgment", 256).alias("judgment_sha256")).write.mode("overwrite").parquet(path)
        if stored(s, audit, AUDIT).where("status = 'ok'").select("fingerprint").distinct().limit(2).count() > 1:
            raise RuntimeError("the judge's fingerprint has changed")
        audited(n)
        # from what was written: judged anew, a judge could answer otherwise than its audit says
        called = s.read.schema("request_id string, status string, judgment string, judgment_sha256 string").parquet(path)
        called.where("status = 'ok'").select("request_id", "judgment", "judgment_sha256").write.mode("overwrite").parquet(f"{results}/batch={n}")

    stream = spark.readStream.schema(schema).json(requests)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: counts per event-time window and type, with a watermark; works on streams and tables."""
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
