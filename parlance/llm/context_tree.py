"""Language-model scores by context-tree weighting over bytes.

A text is scored as its words, lower-cased (A-Z) and joined by one space, and an end byte. Each byte is eight binary
decisions; each decision, in each context of 0 to 5 bytes before it, has a Krichevsky-Trofimov estimate from the
training texts, and the estimates of all depths are mixed by the weights of the context tree: a node's weight is
half its own evidence against half its children's. A context that training never met leaves the decision to the
next shorter one. The sum of the logarithms is the text's log10 probability, and, over log10(2), its code length.

The score is that of the text so written, not of its own white space.

A task's texts form blocks. A block asks for the 6-byte strings and words in it, with the counts it adds to
training: one row for each part of the keys, sorted and packed, so that a key takes a few bytes. A part has all strings
of the three-byte contexts dealt to it by hash. Its keys are merged over sets of at most 64 blocks, then sets of sets, so a task
holds the different strings of a part and of a set, never all that the corpus asks; the tree from depth 3 down
is built of what is merged, and the blocks of a set are answered together. Parts are 1,024 at most, so rows grow with the corpus. What
grows with a part are its different strings: a three-byte context has at most 2**24 of them whatever the corpus. Only the nodes of
two bytes of context and fewer are broadcast: at most 65,536 * 255 of them, in practice a hundredth of that.

Cases: null texts count as empty: one end token. A null doc_id is a training row. Repeated rows count each time. With
no training row every context is unseen and every decision has probability 1/2. An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Stage, Words, blocks, encoded, mix
from .repeats import LAST

DEPTH = 5
END = np.int64(-1)  # the end token's key
BLOCK = 16_000_000
TOP = 3  # strings that share so many bytes of context are in one part
SLAB = 100_000  # different strings whose decisions are held at once
#: Strings have keys of 48 bits; words have negative ones, so that one column tells both apart.
WORD_BIT = U64(1 << 63)
#: Where a 6-byte string's parts lie in its key: the last context byte first, the byte itself last.
_SHIFTS = [U64(8 * (DEPTH - d)) for d in range(DEPTH)]
EIGHT = U64(8)
PAD = b"\n" * DEPTH


def canonical(texts: list[bytes]) -> list[bytes]:
    return [b" ".join(t.lower().split()) + b"\n" for t in texts]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes of canonical texts in their contexts, and where each text's begin; new lines precede a text."""
    x = np.frombuffer(PAD + PAD.join(texts), np.uint8).astype(U64)
    n = len(x) - DEPTH
    key = x[DEPTH:].copy()
    for d in range(DEPTH):
        key |= x[DEPTH - 1 - d : DEPTH - 1 - d + n] << _SHIFTS[d]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + DEPTH) - size - DEPTH
    keep = np.ones(n, bool)
    gap = (begin[1:, None] - DEPTH + np.arange(DEPTH)).ravel() if len(texts) > 1 else np.zeros(0, np.int64)
    keep[gap] = False
    return key[keep].view(np.int64), np.cumsum(size) - size


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of canonical texts, and the number in each."""
    w = Words(texts)
    return (w.hash | WORD_BIT).view(np.int64), w.count


class _Tally:
    """Keys with counts, merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        at, found = pd.factorize(keys)
        self.parts.append((found, np.bincount(at, times, len(found))))
        if len(self.parts) > 4:
            self.parts = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        at, found = pd.factorize(keys)
        return found, np.bincount(at, times, len(found))


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte in planes: small numbers leave most planes empty."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    x = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(x.T).view("<u8").ravel()


def sorted_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=U64).view(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Strings by the three bytes before the last, parts 0 .. parts - 1; words by their hash, behind those."""
    k = keys.view(U64)
    words = U64(max(1, parts // 8))
    return np.where(keys < 0, U64(parts) + mix(k) % words, mix((k >> _SHIFTS[TOP - 1]) + U64(1)) % U64(parts)).astype(np.int64)


ASKED = "block long, part int, keys binary, times binary, ids binary, held binary, texts binary"


def _ask(parts: int):
    def rows(block: int, tally: _Tally) -> Iterator[pd.DataFrame]:
        if not tally.parts:
            return
        keys, times = tally.merged()
        part = part_of(keys, parts)
        order = np.lexsort((keys.view(U64), part))
        keys, times, part = keys[order], times[order].astype(np.int64), part[order]
        cut = np.flatnonzero(part[1:] != part[:-1]) + 1
        for s in range(0, len(cut) + 1, 256):
            own = [(part[k[0]], packed(np.diff(keys[k].view(U64), prepend=U64(0))), packed(times[k])) for k in np.split(np.arange(len(keys)), cut)[s : s + 256]]
            yield pd.DataFrame(own, columns=["part", "keys", "times"]).assign(block=block, ids=None, held=None, texts=None)[[x.split()[0] for x in ASKED.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        task, number, size = TaskContext.get().partitionId() if TaskContext.get() else 0, 0, 0
        tallies = _Tally(), _Tally()
        for pdf in blocks(batches, "text", 1_500_000):
            texts, held = canonical(encoded(pdf["text"])), pdf["held"].to_numpy(bool)
            keys, begin = grams(texts)
            learn = (~held).astype(float)
            lengths = np.diff(begin, append=len(keys))
            tallies[0].add(keys, np.repeat(learn, lengths))
            words, count = words_of(texts)
            tallies[1].add(np.append(words, np.full(len(texts), END)), np.append(np.repeat(learn, count), learn))
            raw = b"".join(texts)
            ids = np.stack([pdf["d"].to_numpy(np.int64), lengths]).tobytes()
            block = (task << 24) | number
            yield pd.DataFrame({"block": [block], "part": -1, "keys": None, "times": None, "ids": [ids], "held": [held.tobytes()], "texts": [pack.compress(raw)]})
            size += len(raw)
            if size > BLOCK:
                for t in tallies:
                    yield from rows(block, t)
                tallies, number, size = (_Tally(), _Tally()), number + 1, 0
        for t in tallies:
            yield from rows((task << 24) | number, t)

    return run


def _summed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of a part, in order, with their times over all blocks."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, times = (np.concatenate(x) for x in zip(*held, strict=True))
        found, at = np.unique(keys, return_inverse=True)
        return found, np.bincount(at, times, len(found))

    for k, t in zip(pdf["keys"], pdf["times"], strict=True):
        held.append((sorted_keys(k), unpacked(t).astype(float)))
        size += len(held[-1][0])
        if size > 1_000_000 and len(held) > 1:
            held = [merged()]
            size = 0
    return merged()


def _slabs(keys: np.ndarray) -> Iterator[slice]:
    """Runs of whole three-byte contexts of sorted strings."""
    context = keys >> np.int64(_SHIFTS[TOP - 1])
    edge = np.append(np.flatnonzero(context[1:] != context[:-1]) + 1, len(keys))
    start = 0
    while start < len(keys):
        k = int(np.searchsorted(edge, start + SLAB, "right"))
        stop = int(edge[k - 1]) if k and edge[k - 1] > start else int(edge[k])
        yield slice(start, stop)
        start = stop


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    y = x + 8
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _evidence(n: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of n[:, 0] zeros and n[:, 1] ones."""
    return _log_gamma(n[:, 0] + 0.5) + _log_gamma(n[:, 1] + 0.5) - _log_gamma(n.sum(axis=1) + 1) - np.log(np.pi)


def _share(n: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the node's own estimate, logarithm of the weighted probability), from counts and the children's sum."""
    own = _evidence(n)
    both = np.logaddexp(own, below) - np.log(2)
    return np.exp(own - np.log(2) - both), both


def _decisions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions of each byte, 1 .. 255 by the bits before, and what each decided."""
    s, bits = (keys & U64(255)).astype(np.int64)[:, None], np.arange(8)
    return (1 << bits) | (s >> (8 - bits)), (s >> (7 - bits)) & 1


def _up(node: np.ndarray) -> np.ndarray:
    """The parent of a node: the same decision without the context byte farthest back."""
    return (node >> EIGHT >> EIGHT << EIGHT) | (node & U64(255))


class Tree:
    """The nodes of depth `top` and more for some strings: all strings that share the contexts of depth `top`."""

    def __init__(self, keys: np.ndarray, times: np.ndarray, top: int = TOP):
        self.top = top
        keys = keys.view(U64)
        self.path, self.bit = _decisions(keys)
        full = ((keys >> EIGHT << EIGHT)[:, None] | self.path.astype(U64)).ravel()
        weight = np.repeat(times.astype(float), 8)
        self.index, self.n, self.share = {}, {}, {}
        node, at = np.unique(full, return_inverse=True)
        bit = self.bit.ravel()
        n = np.stack([np.bincount(at, weight * (bit == b), len(node)) for b in (0, 1)], axis=1)
        logs = _evidence(n)
        self.index[DEPTH], self.n[DEPTH], self.share[DEPTH] = at.reshape(-1, 8), n, np.ones(len(node))
        for d in range(DEPTH - 1, top - 1, -1):
            up, to = np.unique(_up(node), return_inverse=True)
            n = np.stack([np.bincount(to, n[:, b], len(up)) for b in (0, 1)], axis=1)
            self.index[d], self.n[d] = to[self.index[d + 1]], n
            self.share[d], logs = _share(n, np.bincount(to, logs, len(up)))
            node = up
        self.node, self.logs = node, logs

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """For each string and decision: the probability of its bit by the depths from `top` on, and whether training met the node."""
        mixed, seen = None, None
        for d in range(DEPTH, self.top - 1, -1):
            at = self.index[d]
            n = self.n[d][at]
            total = n.sum(axis=2)
            own = (np.take_along_axis(n, self.bit[:, :, None], 2)[:, :, 0] + 0.5) / (total + 1)
            w = self.share[d][at]
            mixed = own if mixed is None else np.where(seen, w * own + (1 - w) * mixed, own)
            seen = total > 0
        return mixed, seen


def _roots(parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """What the nodes at depth TOP pass up, per node above and decision: counts and evidence. Words: their total and number."""
        keys, times = _summed(pdf)
        if pdf["part"].iloc[0] >= parts:
            return pd.DataFrame({"node": [-1], "n0": [times.sum()], "n1": [float((times > 0).sum())], "logs": [0.0]})
        out = []
        for s in _slabs(keys):
            t = Tree(keys[s], times[s])
            up, to = np.unique(_up(t.node), return_inverse=True)
            n = t.n[t.top]
            out.append(pd.DataFrame({"node": up.view(np.int64), "n0": np.bincount(to, n[:, 0], len(up)), "n1": np.bincount(to, n[:, 1], len(up)), "logs": np.bincount(to, t.logs, len(up))}))
        return pd.concat(out).groupby("node", as_index=False).sum()

    return run


def _crown(rows: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, counts, share) of the depths TOP - 1 to 0, from what the depth below passes up."""
    node, n, logs = rows["node"].to_numpy(np.int64).view(U64), rows[["n0", "n1"]].to_numpy(float), rows["logs"].to_numpy(float)
    out = []
    for _ in range(TOP):
        share, both = _share(n, logs) if len(n) else (np.zeros(0), np.zeros(0))
        out.append((node, n, share))
        up, to = np.unique(_up(node), return_inverse=True)
        n = np.stack([np.bincount(to, n[:, b], len(up)) for b in (0, 1)], axis=1)
        node, logs = up, np.bincount(to, both, len(up))
    return out


def _values(keys: np.ndarray, times: np.ndarray, crown: list) -> np.ndarray:
    """Natural logarithm of each string's last byte in its context."""
    out = np.empty(len(keys))
    for s in _slabs(keys):
        t = Tree(keys[s], times[s])
        mixed, seen = t.predict()
        for d, (node, count, share) in zip(range(TOP - 1, -1, -1), crown, strict=True):
            context = keys[s].view(U64) >> U64(8 * (DEPTH + 1 - d)) if d else np.zeros(len(mixed), U64)
            at = np.searchsorted(node, (context << EIGHT)[:, None] | t.path.astype(U64))
            n = count[at]
            total = n.sum(axis=2)
            own = (np.take_along_axis(n, t.bit[:, :, None], 2)[:, :, 0] + 0.5) / (total + 1)
            mixed = np.where(seen, share[at] * own + (1 - share[at]) * mixed, own)
            seen = total > 0
        out[s] = np.log(mixed).sum(axis=1)
    return out


FIGURES = "block long, part int, keys binary, figures binary"


SUMS = "part int, set long, keys binary, times binary"


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for the different keys of some blocks in a part."""
    keys, times = _summed(pdf)
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "set": [pdf["set"].iloc[0]], "keys": [packed(np.diff(keys.view(U64), prepend=U64(0)))], "times": [packed(times.astype(np.int64))]})


def _figures(parts: int, sent):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A part's keys with their figures: strings' logarithms (32 bits), words' times in training."""
        keys, times = _summed(pdf)
        word = pdf["part"].iloc[0] >= parts
        value = times.astype("<f8") if word else _values(keys, times, sent.value).astype("<f4")
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "keys": [packed(np.diff(keys.view(U64), prepend=U64(0)))], "figures": [value.tobytes()]})

    return run


def _answers(parts: int):
    def run(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """The keys of a set of blocks, each with its own keys' figures."""
        if not len(asked):  # a set in which no block asks this part
            return pd.DataFrame(columns=[x.split()[0] for x in FIGURES.split(", ")])
        keys, value = sorted_keys(known["keys"].iloc[0]), np.frombuffer(known["figures"].iloc[0], "<f8" if known["part"].iloc[0] >= parts else "<f4")
        figures = [value[np.searchsorted(keys, sorted_keys(k))].tobytes() for k in asked["keys"]]
        return pd.DataFrame({"block": asked["block"].to_numpy(), "part": asked["part"].to_numpy(), "keys": asked["keys"].array, "figures": figures})

    return run


def _score(parts: int, sent):
    def run(texts: pd.DataFrame, figures: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        total, different = sent.value
        unpack = zstandard.ZstdDecompressor()
        tables = []
        for word in (False, True):
            own = figures[(figures["part"] >= parts) == word]
            known = np.concatenate([sorted_keys(k) for k in own["keys"]] or [np.zeros(0, np.int64)])
            value = np.concatenate([np.frombuffer(f, "<f8" if word else "<f4") for f in own["figures"]] or [np.zeros(0)])
            order = np.argsort(known, kind="stable")
            tables.append((known[order], value[order]))

        def look(keys: np.ndarray, table) -> np.ndarray:
            at, found = pd.factorize(keys)
            return table[1][np.searchsorted(table[0], found)].astype(float)[at]

        out = []
        for ids, held, raw in zip(texts["ids"], texts["held"], texts["texts"], strict=True):
            d, lengths = np.frombuffer(ids, np.int64).reshape(2, -1)
            raw = unpack.decompress(raw)
            end = np.cumsum(lengths)
            own = [raw[a:b] for a, b in zip(end - lengths, end, strict=True)]
            keys, begin = grams(own)
            score = np.add.reduceat(look(keys, tables[0]), begin) / np.log(10)
            words, count = words_of(own)
            doc = np.append(np.repeat(np.arange(len(d)), count), np.arange(len(d)))
            c = look(np.append(words, np.full(len(d), END)), tables[1])
            base = np.bincount(doc, np.log10((c + 1) / (total + different + 1)), len(d))
            out.append(pd.DataFrame({"d": d, "held_out": np.frombuffer(held, bool), "n_tokens": count + 1, "n_known": np.bincount(doc, c > 0, len(d)).astype(np.int64), "train_tokens": np.int64(total), "base_score": base, "score": score, "n_bytes": lengths}))
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in SCORED.split(", ")])

    return run


SCORED = "d long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


MOST_PARTS = 1024  # so that rows, one for each block and part, grow with the corpus and no faster
TOGETHER = 64  # blocks whose keys one task holds


def score(docs: DataFrame, held_out, stage: Stage, parts: int = 0, together: int = TOGETHER) -> DataFrame:
    """docs (doc_id, text) and a boolean column for rows that are not learned, to SCORED with doc_id for d.

    parts: into how many the strings are dealt; 0: four for each block of the corpus, up to MOST_PARTS.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(docs["doc_id"], F.lit(LAST)).alias("d"), F.coalesce(held_out, F.lit(False)).alias("held"), docs["text"].alias("text"))
    if not parts:
        parts = min(MOST_PARTS, max(64, 4 * -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK)))
    asked = stage.write(own.mapInPandas(_ask(parts), ASKED))
    figures = asked.where("part >= 0")
    sets = max(1, -(-figures.agg(F.count_distinct("block")).first()[0] // together))
    figures = figures.select("block", "part", "keys", "times", F.pmod(F.xxhash64("block"), F.lit(sets)).alias("set"))
    # a part's keys are merged over sets of blocks, then over sets of sets: no task holds the keys of all blocks
    sums, left, old = figures, sets, None
    while True:
        merged = stage.write(sums.groupBy("part", "set").applyInPandas(_merge, SUMS))
        if old is not None:
            stage.drop(old)
        if left == 1:
            break
        left = -(-left // together)
        old, sums = merged, merged.withColumn("set", F.pmod("set", F.lit(left)))
    sums = merged
    roots = sums.groupBy("part").applyInPandas(_roots(parts), "node long, n0 double, n1 double, logs double")
    crown = roots.groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("logs").alias("logs")).orderBy("node").toPandas()
    words = crown[crown["node"] < 0]
    sent = spark.sparkContext.broadcast(_crown(crown[crown["node"] >= 0]))
    stage.free()
    values = stage.write(sums.groupBy("part").applyInPandas(_figures(parts, sent), "part int, keys binary, figures binary"))
    stage.drop(sums)
    known = values.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)).cast("array<long>")))
    answers = stage.write(figures.groupBy("part", "set").cogroup(known.groupBy("part", "set")).applyInPandas(_answers(parts), FIGURES))
    stage.drop(values)
    stage.free()
    texts = asked.where("part < 0").select(F.col("block").alias("own"), "ids", "held", "texts")
    sizes = spark.sparkContext.broadcast((int(words["n0"].sum()), int(words["n1"].sum())))
    out = texts.groupBy("own").cogroup(answers.groupBy("block")).applyInPandas(_score(parts, sizes), SCORED)
    return out.withColumn("d", F.nullif("d", F.lit(LAST))).withColumnRenamed("d", "doc_id")


def op4_context_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(7)) == 2
    return score(docs, held, Stage(spark, "op4"))
