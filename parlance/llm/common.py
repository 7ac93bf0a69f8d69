"""Shared pieces: written stages, text blocks, word hashes, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than ASCII white space; bytes.split() uses exactly this set.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that go to a Python worker at once; texts are long, and 10,000 of them take too much memory in each worker.
ROWS = 1000
U64 = np.uint64
#: Multipliers of the 64-bit hashes (odd, arbitrary); the inverse undoes BASE modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode where that is unset (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            import atexit
            import shutil
            import tempfile

            _own_dirs[app] = tempfile.mkdtemp(prefix="parlance-")
            atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        shared = f"file://{_own_dirs[app]}"
    return shared.rstrip("/")


class Stage:
    """Writes intermediate tables as Parquet into the shared folder, and removes them when they are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}  # frames are held, so that an id stays theirs
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)

    def write(self, df: DataFrame) -> DataFrame:
        """df, cut from its lineage: survives the loss of any executor."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes written tables that nothing reads any more."""
        jvm = self.spark._jvm
        for frame in frames:
            if held := self.paths.pop(id(frame), None):
                p = jvm.org.apache.hadoop.fs.Path(held[1])
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def free(self) -> None:
        """Shuffle files go once the driver has collected the plans that own them."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()


def blocks(batches: Iterable[pd.DataFrame], column: str, limit: int) -> Iterator[pd.DataFrame]:
    """Runs of rows whose texts hold about limit characters at most; a longer text comes alone."""
    for pdf in batches:
        if not len(pdf):
            continue
        sizes = pdf[column].str.len().fillna(0).to_numpy(np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield pdf.iloc[start:i]
                start, total = i, 0
            total += size
        yield pdf.iloc[start:]


def encoded(texts: Iterable) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the output."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, U64)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have[:n]


class Rolling:
    """Hashes of any run of symbols of one array, by prefix sums of symbol * BASE**-i."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * powers(BASE_INV, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(BASE, len(self.sums))[start] + (end - start).astype(U64))


class Words:
    """The words of several texts at once: hash, start and end byte of each, and each text's range of words."""

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join(texts) + b" "
        x = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        space = (x == 32) | ((x >= 9) & (x <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(x) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = Rolling(_BYTES[x]).of(self.start, self.end) if len(edge) else np.zeros(0, U64)
        self.first = np.searchsorted(self.start, self.begin)
        self.last = np.searchsorted(self.start, self.begin + sizes)
        self.count = self.last - self.first


def byte_symbols(raw: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(raw, np.uint8)]


def revive(kind: type, state: dict):
    """An object of kind from its attributes: broadcasts hold plain values only."""
    out = kind.__new__(kind)
    vars(out).update(state)
    return out


def components(stage: Stage, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for every node that has an edge to another.

    Contraction: each round hooks every node to its smallest neighbour, shortens the hooks, and replaces
    the ends of the edges by their hooks, until no edge joins two different nodes. Links stay distributed.
    """
    edges = stage.write(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        hook = stage.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to")))
        moved = True
        while moved:  # hooks lead to smaller nodes only, so this ends; each turn follows up to eight of them
            far = hook.select("node", "to")
            for step in ("first", "second", "third"):
                up = hook.select(F.col("node").alias("to"), F.col("to").alias(step))
                far = far.join(up, "to", "left").withColumn("to", F.coalesce(step, "to"))
            jumped = stage.write(far.select("node", "to", (F.coalesce("second", "first") > F.col("to")).alias("moved")))
            stage.drop(hook)
            hook = jumped
            moved = not hook.where("moved").isEmpty()
        ends = hook.select("node", "to")
        old = labels
        if labels is None:
            labels = stage.write(ends.toDF("node", "component"))
        else:
            step = ends.toDF("component", "to")
            labels = stage.write(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        ha, hb = ends.toDF("a", "ta"), ends.toDF("b", "tb")
        left = stage.write(edges.join(ha, "a").join(hb, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct())
        stage.drop(edges, hook, *([old] if old is not None else []))
        edges = left
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    stage.drop(edges)
    return labels
