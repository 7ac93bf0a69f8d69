"""Digests that add up: of histories, whatever task a message is in, and of tables, whatever order their rows are in.

A part's SHA-256 gives two 60-bit numbers; a digest is the count of its parts and the sums of both. Sums are exact
(decimals), so partial sums of any tasks meet in the same digest, and no list of parts is ever built. A history binds each
part to its position, so its digest tells orders apart; a table does not, so repeated rows count and order is no matter.
Two tables can be made to collide on purpose more easily than two files of one hash: digests find changes, they are no signatures.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part_hash(position: Column, role: Column, content: Column) -> Column:
    """SHA-256 of one message at its place; a message without role or content has a hash of its own."""
    whole = F.concat(position.cast("string"), F.lit("\0"), role, F.lit("\0"), content)
    return F.sha2(F.coalesce(whole, F.concat(position.cast("string"), F.lit("\0"))), 256)


def halves(sha: Column) -> tuple[Column, Column]:
    """Two 60-bit numbers of a SHA-256 in hexadecimal."""
    return tuple(F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16))


def sums(sha: Column) -> tuple[Column, Column]:
    """Aggregates: the sums of both numbers; zero over no rows."""
    return tuple(F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)") for h in halves(sha))


def rendered(n: Column, a: Column, b: Column) -> Column:
    return F.concat_ws(":", n.cast("long"), a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))


def history_digest(messages: Column) -> Column:
    """Digest of an array of messages (role, content), as prefix sums give it for the messages one by one."""
    def step(s: Column, m: Column) -> Column:
        a, b = halves(part_hash(s["n"], m["role"], m["content"]))
        return F.struct((s["n"] + 1).alias("n"), (s["a"] + a).cast("decimal(38,0)").alias("a"), (s["b"] + b).cast("decimal(38,0)").alias("b"))

    none = F.lit(0).cast("decimal(38,0)")
    start = F.struct(F.lit(0).cast("long").alias("n"), none.alias("a"), none.alias("b"))
    return F.aggregate(messages, start, step, lambda s: rendered(s["n"], s["a"], s["b"]))
