"""The logarithmic family of suffix arrays on shared storage: batches of documents that come in later calls meet what earlier calls have filed.

Each batch gets a sparse suffix array (see repeats): a table in the order of prefix and context, dealt out by ranges of prefixes, with count, smallest
document and one place of every context. It is scanned against itself and every level for prefixes that occur again; what both hold under
those prefixes is compared on the bytes, by sorted order and common prefix lengths, and gives the repeats of a window and more. Then it is filed: levels
of equal rank merge as in a binary counter, so that n batches are in log n levels and an entry is rewritten once per doubling.

A state is a table of its levels and batches under a number of its own, written last; a call that dies before leaves the state before it in force, and what it
wrote is not read by anyone. One writer at a time. Levels and states that were replaced go when `vacuum` is called.

Cases as in suffix_array: null and empty texts have no bytes; rows that repeat, in one batch or in several, are copies. A batch may be empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage
from .repeats import MOST, Spec, anchor_rows, entries, groups, keyed, runs, spans
from .suffix_array import WINDOW

STATE = "kind string, rank int, batches int, path string"
ENTRY = "kh long, ch long, n long, d1 long, rep struct<d: long, rk: long, p: int, lo: int, hi: int>"
DOCS = "d long, rk long, text string"


class SuffixIndex:
    """A family under a folder that all executors share; opened by its path, with the window that it was made with."""

    def __init__(self, spark: SparkSession, path: str, spec: Spec = WINDOW):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        done = self._states()
        self.number = max(done, default=-1)
        rows = spark.read.schema(STATE).parquet(f"{self.path}/state/{self.number}").collect() if done else []  # a row for each level and batch
        self.levels = sorted(((r.rank, r.batches, r.path) for r in rows if r.kind == "level"), reverse=True)
        self.texts = [r.path for r in rows if r.kind == "texts"]

    def _folder(self, name: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _states(self) -> list[int]:
        """Numbers of the states that were written to their end."""
        fs, p = self._folder("state")
        if not fs.exists(p):
            return []
        jvm = self.spark._jvm
        return [int(s.getPath().getName()) for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def _read(self, schema: str, names: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _array(self, found: DataFrame) -> str:
        return self._write(found.repartitionByRange("kh").sortWithinPartitions("kh", "ch"), "levels")

    def add(self, docs: DataFrame, most: int = MOST) -> DataFrame:
        """Files docs (doc_id, text) and gives d, text, spans: the byte ranges of their windows that start elsewhere in them or in anything filed before."""
        stage = Stage(self.spark, "index")
        texts = self._write(keyed(docs), "texts")
        own = self._read(DOCS, [texts])
        a = stage.write(anchor_rows(own, self.spec))
        name = self._array(entries(a))
        array = self._read(ENTRY, [name])
        mine = array.groupBy("kh").agg(F.sum("n").alias("n"))
        met = mine.where("n >= 2").select("kh")
        for _, _, level in self.levels:
            met = met.unionByName(mine.select("kh").join(self._read(ENTRY, [level]).select("kh"), "kh", "left_semi"))
        met = stage.write(met.distinct())
        held = self._read(ENTRY, [name, *[level for *_, level in self.levels]]).join(met, "kh", "left_semi")
        found = stage.write(groups(self._merged(held)))
        repeated = runs(stage, self._read(DOCS, [*self.texts, texts]), found, self.spec, most)
        got = stage.write(spans(a.join(met, "kh", "left_semi"), repeated, self.spec, earlier=False))
        stage.drop(a, met, repeated)
        self._file(name, texts)
        return own.join(got.hint("shuffle_hash"), ["d", "rk"], "left").select("d", "text", "spans")

    @staticmethod
    def _merged(held: DataFrame) -> DataFrame:
        return held.groupBy("kh", "ch").agg(F.sum("n").alias("n"), F.min("d1").alias("d1"), F.min("rep").alias("rep"))

    def _file(self, array: str, texts: str) -> None:
        """The new array as a level of rank 0, merged upwards; then the state that holds it."""
        rank, batches, old = 0, 1, []
        levels = list(self.levels)
        while levels and levels[-1][0] == rank:
            _, more, level = levels.pop()
            old.append(level)
            rank, batches = rank + 1, batches + more
        if old:
            array = self._array(self._merged(self._read(ENTRY, [array, *old])))
        levels.append((rank, batches, array))
        rows = [("level", *level) for level in levels] + [("texts", None, 1, t) for t in [*self.texts, texts]]
        self.spark.createDataFrame(rows, STATE).coalesce(1).write.parquet(f"{self.path}/state/{self.number + 1}")
        self.levels, self.texts, self.number = levels, [*self.texts, texts], self.number + 1

    def vacuum(self) -> int:
        """Deletes levels, texts and states that the state in force doesn't name; how many. Results of earlier calls must have been written by then."""
        keep = {level for *_, level in self.levels} | set(self.texts) | {f"state/{self.number}"}
        gone = 0
        for kind in ("levels", "texts", "state"):
            fs, p = self._folder(kind)
            for s in fs.listStatus(p) if fs.exists(p) else ():
                if f"{kind}/{s.getPath().getName()}" not in keep:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone
