"""Additive digests, prefix aggregates in blocks, and what binds comparisons and reviews to frozen turns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import digest as D
from parlance.operators import binding as B
from parlance.operators.prefix import prefixes


def by_hand(messages):
    a = b = 0
    for n, (role, content) in enumerate(messages):
        whole = f"{n}\0{role}\0{content}" if role is not None and content is not None else f"{n}\0"
        h = hashlib.sha256(whole.encode()).hexdigest()
        a, b = a + int(h[:15], 16), b + int(h[15:30], 16)
    return f"{len(messages)}:{a}:{b}"


def test_history_digest(spark):
    rows = [[], [("user", "a")], [("user", "a"), ("assistant", "b")], [("assistant", "b"), ("user", "a")], [("user", None)], [(None, "x")], [("user", "é\0b")] * 40]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, m array<struct<role: string, content: string>>")
    got = {r.i: r.d for r in df.select("i", D.history_digest(F.col("m")).alias("d")).collect()}
    assert got == {i: by_hand(r) for i, r in enumerate(rows)} and len(set(got.values())) == len(rows) - 1  # nulls are one


@pytest.mark.parametrize("block", [4096, 3])
def test_prefixes(spark, block):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), t, rng.choice([None, f"v{t}"]), rng.randrange(9)) for t in rng.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k string, t long, v string, n int").repartition(3)
    got = {(r.k, r.t): (r.total, r.latest) for r in prefixes(df, ["k"], "t", {"total": F.col("n")}, {"latest": F.col("v")}, block=block).collect()}
    for k, t, _, _ in rows:
        earlier = sorted((r for r in rows if r[0] == k and r[1] < t), key=lambda r: r[1])
        assert got[k, t] == (sum(r[3] for r in earlier), next((r[2] for r in reversed(earlier) if r[2] is not None), None))


def turns(spark):
    talk = [("system", "s"), ("user", "u1"), ("assistant", "g1"), ("user", "u2"), ("assistant", "g2"), ("user", "u3"), ("assistant", "g3")]
    rows = [("test", r, n, role, text, policy, "daily", "g", 1, ["x"]) for r, policy in (("A", "all"), ("B", "final_only"), ("C", None)) for n, (role, text) in enumerate(talk)]
    return talk, spark.createDataFrame(rows, "split string, record_id string, turn long, role string, content string, policy string, capability string, scenario_group string, seriousness int, risk_flags array<string>")


def comparisons(spark, talk, mode):
    """What an honest generator records, with whole prompts."""
    out = []
    for record, final in (("A", False), ("B", True), ("C", False)):
        past = {v: [] for v in B.VARIANTS}
        index, latest = 0, None
        for role, text in talk:
            if role != "assistant":
                latest = text if role == "user" else latest
                for v in B.VARIANTS:
                    past[v].append((role, text))
                continue
            index += 1
            said = dict.fromkeys(B.VARIANTS, text)
            if not final or index == 3:
                eval_id = f"test:{record}:{mode}:T{index:02d}"
                seed = int.from_bytes(hashlib.sha256(f"7\0test\0{record}\0{mode}\0{index}".encode()).digest()[:4], "big")
                answers = {v: f"{v} of {eval_id}" for v in B.VARIANTS}
                out.append({"eval_id": eval_id, "record_id": record, "split": "test", "capability": "daily", "scenario_group": "g", "seriousness": 1, "risk_flags": ["x"], "mode": mode, "assistant_turn_index": index, "latest_user_message": latest, "gold_response": text, "seed": seed, "config_sha256": "c", **{f"{v}_messages": list(past[v]) for v in B.VARIANTS}, **{f"{v}_response": answers[v] for v in B.VARIANTS}})
                if mode == B.ROLLOUT:
                    said = answers
            for v in B.VARIANTS:
                past[v].append(("assistant", said[v]))
    return out


def found(spark, t, rows, mode):
    message = "array<struct<role: string, content: string>>"
    schema = "eval_id string, record_id string, split string, capability string, scenario_group string, seriousness int, risk_flags array<string>, mode string, assistant_turn_index long, latest_user_message string, gold_response string, seed long, config_sha256 string, " + ", ".join(f"{v}_messages {message}" for v in B.VARIANTS) + ", " + ", ".join(f"{v}_response string" for v in B.VARIANTS)
    names = [c.split()[0] for c in schema.replace("role: string, content: string", "").split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    df = df.withColumns({f"{v}_prompt": D.history_digest(F.col(f"{v}_messages")) for v in B.VARIANTS})
    return sorted((r.record_id, r.detail) for r in B.turn_violations(t, df, mode, 7, "c").collect())


def test_honest_records_bind_and_tampered_ones_do_not(spark):
    """Two modes, a bridge turn, and histories of a candidate's own answers."""
    talk, t = turns(spark)
    for mode in (B.GOLD, B.ROLLOUT):
        rows = comparisons(spark, talk, mode)
        assert len(rows) == 7 and found(spark, t, rows, mode) == []
    rows = comparisons(spark, talk, B.ROLLOUT)
    at = {r["eval_id"]: r for r in rows}
    second, third, final = "test:A:rollout:T02", "test:A:rollout:T03", "test:B:rollout:T03"
    at[second]["tuned_messages"] = at[second]["base_messages"]  # the other candidate's past
    at[third]["base_messages"] = [*at[third]["base_messages"][:-1], ("user", "u3 ")]
    at[final]["base_messages"] = [m if m[1] != "g1" else ("assistant", "made up") for m in at[final]["base_messages"]]  # a bridge
    at[final]["seed"] += 1
    rows.append(dict(at["test:C:rollout:T01"]))
    rows = [r for r in rows if r["eval_id"] != "test:C:rollout:T03"]
    rows.append({**at[second], "eval_id": "test:A:rollout:T04"})
    want = [(second, "tuned_prompt"), (third, "base_prompt"), (final, "base_prompt"), (final, "seed"), ("test:C:rollout:T01", "repeated"), ("test:C:rollout:T03", "missing"), ("test:A:rollout:T04", "unexpected")]
    assert found(spark, t, rows, B.ROLLOUT) == sorted(want)


def test_a_view_must_bear_its_protocol(spark):
    rows = [("A::A1", "A", 1, "test", [" Safety"], []), ("A::A2", "A", 2, "test", [], []), ("B::A1", "B", 1, "test", None, ["HARM "]), ("C::A1", "C", 1, "test", [], None)]
    schema = "id string, source_record_id string, assistant_turn_index int, split string, labels array<string>, risk_flags array<string>"
    view = spark.createDataFrame(rows, schema)
    got = {r.eval_id: r.critical for r in B.protocol(view, capabilities=("safety",), risks=("harm",)).collect()}
    assert got == {f"test:{r}:{B.GOLD}:T0{n}": c for r, n, c in (("A", 1, True), ("A", 2, True), ("B", 1, True), ("C", 1, False))}
    assert B.view_violations(view, declared=4).isEmpty()
    bad = spark.createDataFrame([*rows, rows[0], ("x", "", 0, "train", [], []), ("D::A2", "D", 1, "test", [], [])], schema)
    assert sorted((r.record_id, r.detail) for r in B.view_violations(bad, declared=4).collect()) == sorted([("A::A1", "repeated"), ("x", "split"), ("x", "source_record_id"), ("x", "assistant_turn_index"), ("x", "id"), ("D::A2", "id"), ("view", "rows 7")])


def test_a_complete_protocol(spark):
    asked = spark.createDataFrame([("test:A:m:T01", "A", True), ("test:B:m:T01", "B", False)], "eval_id string, record_id string, critical boolean")
    reviews = spark.createDataFrame([("test:A:m:T01", "test", "A", "m", 1), ("test:B:m:T01", "test", "B", "m", 1)], "eval_id string, split string, record_id string, mode string, assistant_turn_index int")
    compared = reviews.select("eval_id")
    whole = lambda r: B.completeness(asked, r, B.reconciliation(asked, compared, r), mode="m").first()
    assert whole(reviews).complete and whole(reviews).failures == 0
    few = whole(reviews.where("record_id = 'B'"))
    assert not few.complete and few.failures == 1
    details = B.reconciliation(asked, compared, reviews.where("record_id = 'B'")).collect()
    assert [tuple(r) for r in details] == [("test:A:m:T01", "no review of a critical row")]
