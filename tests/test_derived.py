"""Derived rows, and the contracts of configurations and tokenizers."""

import copy

import pytest
from pyspark.sql import functions as F

from parlance.operators import derive as D
from parlance.operators import evaluation_config as E


def sound():
    """A configuration that keeps its contract."""
    out = {}

    def put(path, value):
        at, *names = out, *path.split(".")
        for n in names[:-1]:
            at = at.setdefault(n, {})
        at[names[-1]] = value

    for path, (low, _, _) in E.NUMBERS.items():
        put(path, max(1, low) if isinstance(low, int) else 1)
    for path, value in E.CONSTANTS.items():
        put(path, value)
    for path in E.WORDS:
        put(path, ["a", "b"])
    for path, lists in E.OBJECTS.items():
        put(path, [{"id": i, **dict.fromkeys(lists, ["x"])} for i in ("one", "two")])
    put("surface_style.register.ideal_average_sentence_chars", [5, 9])
    put("surface_style.register.long_response_chars", 30)
    for places, total in E.SUMS:
        for p in places:
            put(p, total / len(places))
    put("value_worldview.principles", {"care": ["a"], "truth": ["b"]})
    put("value_worldview.principles_by_capability", {"daily": ["care"]})
    put("layers", {n: {"weight": w, "metrics": {"m": {"weight": 0.25}, "n": {"weight": 0.75}}} for n, w in zip(E.LAYERS, (0.3, 0.35, 0.35), strict=True)})
    out["judge"] |= {"default_seed": 1, "max_tokens": 9, "provider": "p", "model": "m", "base_url": "u", "thinking": "no", "seed_scope": "order", "required_fields_per_candidate_layer": ["score", "reason", "evidence"]}
    return out


def test_a_sound_configuration():
    assert list(E.problems(sound())) == [] and list(E.problems([])) == ["$: is no object"]
    assert len(list(E.problems({}))) > 40


@pytest.mark.parametrize(
    ("path", "value", "told"),
    [(p, v, p) for p, (low, high, _) in E.NUMBERS.items() for v in (low - 1, high + 1, True, None, float("nan"))]
    + [(p, 1.5, p) for p, (_, _, whole) in E.NUMBERS.items() if whole]
    + [(p, v, p) for p, c in E.CONSTANTS.items() for v in ("x", c + 1 if isinstance(c, int) else 0)]
    + [(p, v, p) for p in E.WORDS for v in ([], ["a", "a"], ["a", " b"], [1], "a")]
    + [
        ("value_worldview.risk_action_groups.1.id", "one", "value_worldview.risk_action_groups.1.id"), ("value_worldview.risk_action_groups.0.actions", [], "value_worldview.risk_action_groups.0.actions"), ("knowledge_relationship.relationship_constraints.facts", [], "knowledge_relationship.relationship_constraints.facts"),
        ("value_worldview.principles_by_capability.daily", ["care", "none"], "value_worldview.principles_by_capability.daily"), ("value_worldview.principles", {}, "value_worldview.principles"), ("layers.surface_style.weight", 0.4, "layers.surface_style.weight, "), ("layers.surface_style.metrics.m.weight", 0.5, "layers.surface_style.metrics"),
        ("layers.surface_style.metrics.m.weight", -0.25, "layers.surface_style.metrics"), ("surface_style.register.short_response_chars", 31, "surface_style.register.short_response_chars"), ("surface_style.register.ideal_average_sentence_chars", [9, 5], "surface_style.register.ideal_average_sentence_chars.0"),
        ("judge.default_seed", True, "judge.default_seed"), ("judge.max_tokens", 0, "judge.max_tokens"), ("judge.provider", " ", "judge.provider"), ("judge.required_fields_per_candidate_layer", ["score"], "judge.required"),
    ],
)
def test_each_rule_of_a_configuration(path, value, told):
    config = copy.deepcopy(sound())
    at, *names = config, *path.split(".")
    for n in names[:-1]:
        at = at[int(n) if isinstance(at, list) else n]
    at[int(names[-1]) if isinstance(at, list) else names[-1]] = value
    found = list(E.problems(config))
    assert found and all(f.startswith(told) or "must sum to" in f or "is greater" in f for f in found), found


def test_tokenizer_identity():
    good = {"chat_template_sha256": "a", "bos_token_id": None, "eos_token_id": 1, "pad_token_id": 0, "padding_side": "right", "chat_template_kwargs": {}}
    assert list(E.tokenizer_problems(good)) == [] and list(E.tokenizer_problems(good | {"bos_token_id": 3})) == []
    for field, bad in {"chat_template_sha256": "", "bos_token_id": -1, "eos_token_id": None, "pad_token_id": True, "padding_side": "up", "chat_template_kwargs": []}.items():
        assert [p.split(":")[0] for p in E.tokenizer_problems(good | {field: bad})] == [field]
        assert list(E.tokenizer_problems({k: v for k, v in good.items() if k != field})) == [f"{field}: is missing"]


def test_recomputed(spark):
    schema = "k string, m struct<a: int, b: array<string>>, v double"
    stored = spark.createDataFrame([("a", (1, ["x"]), 1.0), ("b", (1, ["x"]), 1.0), ("b", (1, ["y"]), 1.0), ("c", None, None), (None, None, 2.0), ("z", None, None)], schema)
    derived = spark.createDataFrame([("a", (1, ["x"]), 1.0), ("b", (1, ["x"]), 1.0), ("c", (None, None), None), (None, None, 2.0), ("d", None, None)], schema).select("v", "m", "k")
    got = {(r.k, r.detail) for r in D.recomputed(stored, derived, "k").collect()}
    assert got == {("b", "repeated"), ("b", "differs from what is derived"), ("c", "differs from what is derived"), ("d", "missing"), ("z", "does not resolve")}
    assert D.recomputed(stored.limit(0), derived.limit(0), "k").isEmpty()


def test_texts_summaries_and_rates(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "all"), (2, ["a", "b"], "final_only"), (3, [], "all"), (4, None, "all"), (5, ["a"], None)], "i int, said array<string>, policy string")
    assert {r.i: r.t for r in df.select("i", D.supervised_text(F.col("said"), F.col("policy")).alias("t")).collect()} == {1: "a\nb", 2: "b", 3: None, 4: None, 5: "a"}
    records = spark.createDataFrame([("c", 2), ("c", 1), ("d", 3)], "capability string, answers int")
    got = {r.capability: tuple(r)[1:] for r in D.summarized(records, spark.createDataFrame([("c",)] * 4, "capability string")).collect()}
    assert got == {"c": (2, 1, 4), "d": (1, 1, 0), None: (3, 2, 4)}
    examples = spark.createDataFrame([("r", "c"), ("r", "d"), ("s", "c"), ("t", "x"), ("u", None)], "r string, label string")
    assert {(x.record_id, x.detail) for x in D.conflicting(examples, "r", "label", ["c", "d"]).collect()} == {("r", "several labels"), ("t", "unknown label"), ("u", "unknown label")}
    scored = spark.createDataFrame([("a", 5, False), ("a", 3, None), ("a", 5, True), ("a", None, False)], "v string, safety_ethics int, critical boolean")
    assert tuple(D.gate_rates(scored, ["v"]).first()) == ("a", 4, 1, 1, 0.25, 0.25)
    own = D.with_source(spark.createDataFrame([("x", 7, 3)], "id string, n int, line int"), "data", "line", {"n": "number"}).first().source
    assert (own.dataset, own.line, own.id, own.number, len(own.record_sha256)) == ("data", 3, "x", 7, 64)
