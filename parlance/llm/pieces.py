"""SentencePiece sampling by forward filtering and backward sampling over the piece lattice, and lossless decoding.

The model file gives the pieces; a piece's weight is (1 + rank) ** -alpha, the rank being its negated score (the
public file is a merge model, whose scores are ranks and not probabilities; alpha sharpens or flattens).
A character that no piece spells alone falls back to its UTF-8 bytes, so every text has a segmentation and
decoding gives the text back byte for byte. As in the library, one space is put before the text, and pieces
start words: no piece goes on after a space that follows a letter, so the lattice falls apart at spaces and new
lines, and segments are sampled independently. A segment's lattice is filtered once per task and kept.

Backward sampling runs over all segments of a block at once. Its uniform numbers are hashes of (seed, row key,
segment number, step), so a row is sampled alike in every run, on any machine and in any order.

Cases: a null text counts as empty; an empty text has the pieces of the prefix space alone. A null doc_id is a key
like others. Repeated rows get equal segmentations. An empty table gives no rows; extra columns are ignored.
Long texts without spaces make long lattices, linear in their length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Rolling, blocks, encoded, mix, revive
from .repeats import LAST

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEGMENT = re.compile(" *[^ \n]+| +|\n")


class Pieces:
    """Pieces with weights, their bytes for decoding, and the ids of the 256 byte pieces. Bounded by the model file."""

    def __init__(self, path: str = MODEL, alpha: float = 2.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, tuple[int, float]] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        self.longest = 1
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.bytes.append(text.encode())
                self.ids[text] = (i, -alpha * math.log1p(max(0.0, -sp.get_score(i))))
                self.longest = max(self.longest, len(text))
        if self.ids.get("\n"):
            raise ValueError("the lattice is cut at new lines, but a piece spells one")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)


class Sampler:
    """Filtered lattices of the segments met so far, in growing arrays."""

    def __init__(self, pieces: Pieces, most: int = 3_000_000):
        self.pieces, self.most = pieces, most
        texts = sorted(pieces.ids, key=len)
        points = _points("".join(texts))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(size)
        h = Rolling(mix(points + U64(1))).of(end - size, end)
        order = np.argsort(h)
        self.hash = h[order]
        self.id = np.array([pieces.ids[t][0] for t in texts], np.int64)[order]
        self.weight = np.array([pieces.ids[t][1] for t in texts])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[h >> U64(44)] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.end, self.ptr, self.back, self.piece = [np.zeros(0, np.int64) for _ in range(5)]
        self.cum = np.zeros(0)

    def build(self, segments: list[str]) -> None:
        """Forward filtering of new segments: for each node, the cumulative shares of the edges that end there."""
        points = _points("".join(segments))
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        many, n = len(segments), len(points)
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(many), size)
        place = np.arange(n) - begin[owner]
        left = size[owner] - place
        # nodes are numbered by depth, then segment: those of one depth are filtered together
        depth = np.concatenate((place, size))
        holder = np.concatenate((owner, np.arange(many)))
        order = np.lexsort((holder, depth))
        rank = np.empty(n + many, np.int64)
        rank[order] = np.arange(n + many)
        node = np.empty(n + many, np.int64)  # by begin + segment + place
        node[np.concatenate((np.arange(n) + owner, begin + size + np.arange(many)))] = rank
        flat = np.arange(n) + owner
        roll = Rolling(mix(points + U64(1)))
        at = np.arange(n)
        parts = []
        for length in range(1, self.pieces.longest + 1):
            at = at[left[at] >= length]
            if not len(at):
                break
            h = roll.of(at, at + length)
            hit = np.flatnonzero(self.maybe[h >> U64(44)])
            k = np.minimum(np.searchsorted(self.hash, h[hit]), len(self.hash) - 1)
            ok = self.hash[k] == h[hit]
            i, k = at[hit[ok]], k[ok]
            parts.append((node[flat[i]], node[flat[i] + length], self.id[k], self.weight[k]))
            if length == 1:  # a character without a piece: -1 - its code point stands for its bytes
                none = np.ones(n, bool)
                none[i] = False
                i = np.flatnonzero(none)
                parts.append((node[flat[i]], node[flat[i] + 1], -1 - points[i].astype(np.int64), np.full(len(i), -40.0)))
        source, to, piece, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(to, kind="stable")
        source, to, piece, weight = source[by], to[by], piece[by], weight[by]
        ptr = np.concatenate(([0], np.cumsum(np.bincount(to, minlength=n + many))))
        level = np.searchsorted(depth[order], np.arange(int(size.max()) + 2))
        total, share = np.zeros(n + many), np.empty(len(to))
        for a, b in zip(level[1:-1], level[2:], strict=True):
            e, f = ptr[a], ptr[b]
            value = total[source[e:f]] + weight[e:f]
            starts, counts = ptr[a:b] - e, ptr[a + 1 : b + 1] - ptr[a:b]
            top = np.maximum.reduceat(value, starts)
            total[a:b] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), starts))
            share[e:f] = np.exp(value - np.repeat(total[a:b], counts))
        cum, edges_in = share, np.diff(ptr)
        at = np.flatnonzero(edges_in > 1)
        for k in range(1, int(edges_in.max())):  # each node is summed on its own: the same in every batch
            at = at[edges_in[at] > k]
            cum[ptr[at] + k] += cum[ptr[at] + k - 1]
        base, edges = len(self.ptr), len(self.cum)
        self.first = np.append(self.first, base + node[begin + np.arange(many)])
        self.end = np.append(self.end, base + node[begin + size + np.arange(many)])
        self.ptr = np.append(self.ptr, ptr[:-1] + edges)
        self.cum, self.back, self.piece = np.append(self.cum, cum), np.append(self.back, source + base), np.append(self.piece, piece)

    def sample(self, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
        """Backward sampling: the piece ids of each text."""
        if len(self.cum) > self.most:
            self.clear()
        known, news = self.known, []
        segments: list[int] = []
        counts = []
        for t in texts:
            found = SEGMENT.findall(" " + t)
            counts.append(len(found))
            for x in found:
                at = known.get(x)
                if at is None:
                    at = known[x] = len(known)
                    news.append(x)
                segments.append(at)
        if news:
            self.build(news)
        ptr = np.append(self.ptr, len(self.cum))
        counts = np.array(counts, np.int64)
        seg = np.array(segments, np.int64)
        doc = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
        root = mix(keys[doc] + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)) + mix(number.astype(U64) + U64(1)))
        start, node = self.first[seg], self.end[seg]
        live = np.arange(len(seg))
        taken = []
        step = 0
        while len(live):
            at = node[live]
            e, last = ptr[at], ptr[at + 1] - 1
            many = np.flatnonzero(e < last)
            if len(many):
                u = (mix(root[live[many]] + U64((step + 1) * 0xA0761D6478BD642F % (1 << 64))) >> U64(11)).astype(np.float64) * 2.0**-53
                em, lm = e[many], last[many]
                move = np.flatnonzero((self.cum[em] <= u) & (em < lm))
                while len(move):
                    em[move] += 1
                    move = move[(self.cum[em[move]] <= u[move]) & (em[move] < lm[move])]
                e[many] = em
            taken.append((live, self.piece[e]))
            node[live] = self.back[e]
            live = live[node[live] != start[live]]
            step += 1
        size = np.zeros(len(seg), np.int64)
        for who, _ in taken:
            size[who] += 1
        end = np.cumsum(size)
        ids = np.empty(int(size.sum()), np.int64)
        for k, (who, p) in enumerate(taken):
            ids[end[who] - 1 - k] = p
        total = np.bincount(doc, size, minlength=len(texts)).astype(np.int64)
        return [self._spelled(x) for x in np.split(ids, np.cumsum(total)[:-1])]

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """Byte pieces in place of -1 - code point."""
        at = np.flatnonzero(ids < 0)
        if not len(at):
            return ids.astype(np.int32)
        out, last = [], 0
        for i in at.tolist():
            out.append(ids[last:i])
            out.append(np.array([self.pieces.byte_ids[b] for b in chr(-1 - int(ids[i])).encode("utf-8", "surrogatepass")]))
            last = i + 1
        return np.concatenate([*out, ids[last:]]).astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes: the pieces' bytes without the space put before."""
        spelled = self.pieces.bytes
        return b"".join([spelled[i] for i in ids.tolist()])[1:]


def segment(docs: DataFrame, pieces: Pieces, seed: int = 1, digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_pieces, and either pieces (array of ids) or pieces_sha256 (of the ids as
    little-endian 32-bit numbers); decoded (binary) or decoded_sha256; lossless: whether the text came back. carry:
    string columns of docs to keep."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(pieces))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(revive(Pieces, sent.value))
        for pdf in blocks(batches, "text", 600_000):
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            keys = mix(pdf["d"].to_numpy(np.int64).view(U64) + U64(1))
            ids = sampler.sample(texts, keys, seed)
            back = [sampler.decode(x) for x in ids]
            out = {"d": pdf["d"].to_numpy(), "n_pieces": [len(x) for x in ids], "lossless": [a == b for a, b in zip(back, encoded(texts), strict=True)]}
            if digest:
                out |= {"pieces_sha256": [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]}
            else:
                out |= {"pieces": ids, "decoded": back}
            yield pd.DataFrame(out | {c: pdf[c].array for c in carry})

    own = docs.select(F.coalesce(docs["doc_id"], F.lit(LAST)).alias("d"), docs["text"].alias("text"), *[docs[c].alias(c) for c in carry])
    more = "pieces_sha256 string, decoded_sha256 string" if digest else "pieces array<int>, decoded binary"
    more += "".join(f", {c} string" for c in carry)
    out = own.mapInPandas(run, f"d long, n_pieces long, lossless boolean, {more}")
    return out.withColumn("d", F.nullif("d", F.lit(LAST))).withColumnRenamed("d", "doc_id")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return segment(docs, Pieces(), digest=True)
