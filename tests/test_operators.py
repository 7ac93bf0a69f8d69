"""Operators on small fixtures with the edge cases that matter."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance import config
from parlance.functions import metrics as M
from parlance.functions import text as X
from parlance.operators import checks as V
from parlance.operators import judge as J
from parlance.operators import review as R
from parlance.operators import training as T
from parlance.operators.turns import expand_turns
from parlance.sources import files, sinks
from parlance.streaming.resume import run_pending, windowed_counts


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first().v


def test_normal_form_keeps_letters_of_any_script(spark):
    assert one(spark, "Ä_b! ½ Ｃ", X.normalized(F.col("text"))) == one(spark, "äb½ｃ", X.normalized(F.col("text")))


def test_stable_seed(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"7\0id").digest()[:4], "big")
    assert one(spark, "id", X.stable_seed(F.lit("7"), F.col("text"))) == want


def test_exclusive_counts_give_characters_to_the_longest_term(spark):
    counts = X.exclusive_counts(F.col("text"), ["hin", "thing"])
    assert [one(spark, "thing hin thin", counts[k]) for k in ("thing", "hin")] == [1, 2]
    with pytest.raises(ValueError):
        X.exclusive_counts(F.col("text"), ["aa"])


@pytest.mark.parametrize(
    ("text", "want"),
    [("stupid", (1, 0)), ("not stupid", (0, 1)), ("never, stupid", (1, 0)), ("never so stupid", (0, 1)), ("pas mal stupid", (1, 0)), ("stupid is wrong", (0, 1)), ("", (0, 0)), ("so stupid and not stupid", (1, 1))],
)
def test_polarity(spark, text, want):
    got = one(spark, text, X.polarity(F.col("text"), "stupid"))
    assert (got.affirmed, got.negated) == want


def governed(text, term):
    """Reads everything before each occurrence, whatever that costs."""
    import re

    hits = []
    for m in re.finditer(re.escape(term), text):
        before, after = text[: m.start()], text[m.end() :][: config.NEAR_AFTER]
        clause = re.split(f"[{config.CLAUSE_MARKS}{config.LATIN_MARKS}]", before)[-1]
        for phrase in config.EXEMPT:
            clause = clause.replace(phrase, "")
        near = before[-config.NEAR_BEFORE :]
        hits.append(near.endswith(config.NEGATORS) or any(n in clause for n in config.SCOPE_NEGATORS) or any(c in after for c in config.CORRECTIONS))
    return len(hits) - sum(hits), sum(hits)


def test_polarity_equals_reading_all_that_stands_before(spark):
    import random

    rng = random.Random(5)
    parts = ["un", "gun", "ung", "no ", "not ", "never", "pas ", "mal", "wrong", "fal", "sch", " ", "é", ".", "\n", "x" * 15]
    texts = ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for term in ("ung", "n", "no "):
        got = frame.select("text", X.polarity(F.col("text"), term).alias("v")).collect()
        assert [(r.v.affirmed, r.v.negated) for r in got] == [governed(r.text, term) for r in got]
    with pytest.raises(ValueError):
        X.polarity(F.col("text"), "a.")


def test_polarity_is_linear_in_a_long_text(spark):
    text = "the ung is never ung; " * 60_000
    got = one(spark, text, X.polarity(F.col("text"), "ung"))
    assert (got.affirmed, got.negated) == (60_000, 60_000)
    assert tuple(one(spark, None, X.polarity(F.col("text"), "ung"))) == (0, 0)


def test_sentences_and_ngrams(spark):
    assert one(spark, "ab c. ! d?\n", X.sentence_lengths(F.col("text"))) == [3, 1]
    assert one(spark, "a", X.char_ngrams(F.col("text"), 2)) == ["a"]
    assert one(spark, "!", X.char_ngrams(F.col("text"), 2)) == []
    assert one(spark, "aba b", X.char_ngrams(F.col("text"), 2)) == ["ab", "ba"]


def test_harm_costs_unless_negated(spark):
    score = lambda t: one(spark, t, M.conflict_safety(F.col("text"), F.lit(5), F.col("text")))
    assert score("this moron") < score("not moron this")


def test_scores_stay_in_range(spark):
    for text in ("", "!" * 300, "stupid trash " * 50):
        for c in (M.style_marker(F.col("text"), F.lit(3)), M.register_match(F.col("text"), F.lit(1)), M.constraints(F.col("text"), F.col("text"))):
            assert 0 <= one(spark, text, c) <= 100


def test_turn_expansion(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "v"), (1, 4, "assistant", "b"), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in expand_turns(df).collect()}
    assert [m.text for m in got[1, 4].prompt] == ["s", "u", "a", "v"] and got[1, 4].assistant_turn_index == 2
    assert got[2, 0].prompt is None
    assert {(r.conv_id, r.turn) for r in expand_turns(df, "final_only").collect()} == {(1, 4), (2, 0)}
    with pytest.raises(ValueError):
        expand_turns(df, "some")


def test_role_contract(spark):
    ok = [("system", "s"), ("user", "u"), ("assistant", "a")]
    for messages, want in ((ok, True), (ok[1:], True), (ok[:2], False), ([("user", "u"), ("user", "v")], False), ([("user", " "), ("assistant", "a")], False), ([], False)):
        df = spark.createDataFrame([(messages,)], "m array<struct<role:string,content:string>>")
        assert df.select(V.roles_alternate(F.col("m")).alias("v")).first().v is want


def test_strict_json_and_integers(spark):
    for text, ok in (('{"a":1}', True), ('{"a":1,"a":2}', False), ('{"a":NaN}', False), ("{", False)):
        assert one(spark, text, V.strict_json(F.col("text")).isNotNull()) is ok
    for text, ok in (('{"a":1}', True), ('{"a":true}', False), ('{"a":1.5}', False), ('{"a":"3"}', False), ("{}", False)):
        assert one(spark, text, V.is_integer(F.col("text"), "$.a")) is ok
    got = one(spark, '{"a":1,"c":2}', V.keys_differ(F.col("text"), ["a", "b"]))
    assert (got.missing, got.unexpected) == (["b"], ["c"])


def test_reports_and_requirements(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id long, n int")
    found = V.violations(df, "R", F.col("id"), F.col("n") > 3, F.col("n"))
    assert {r.record_id for r in found.collect()} == {"1", "2"}  # an unknown answer counts as broken
    with pytest.raises(V.ContractViolation):
        V.require(found)
    V.require(found.where("false"))


def test_line_numbers_count_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x":"a b"}\n\n{"x":"c","x":"d"}\n', encoding="utf-8")
    got = files.parsed_lines(files.read_lines(spark, str(tmp_path / "a.jsonl")), "x string").orderBy("line").collect()
    assert [(r.line, r.record and r.record.x) for r in got] == [(1, "a b"), (3, None)]
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x string").count() == 2
    import hashlib

    digest = hashlib.sha256((tmp_path / "a.jsonl").read_bytes()).hexdigest()
    files.require_hashes(spark, str(tmp_path / "a.jsonl"), {"a.jsonl": digest})
    with pytest.raises(V.ContractViolation):
        files.require_hashes(spark, str(tmp_path / "a.jsonl"), {"a.jsonl": "0"})


def test_review_sheet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("R0001", 'a "quoted", text\nof two lines', None)], "review_id string, context string, score string")
    sinks.write_review_csv(df, tmp_path / "s.csv", df.columns)
    assert (tmp_path / "s.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    row = files.read_csv(spark, str(tmp_path / "s.csv"), df.columns).first()
    assert (row.review_id, row.context, row.score) == ("R0001", 'a "quoted", text\nof two lines', None)
    with pytest.raises(V.ContractViolation):
        files.read_csv(spark, str(tmp_path / "s.csv"), ["review_id"])


def test_canonical_lines_and_publication(spark, tmp_path):
    df = spark.createDataFrame([(2, "é"), (1, None)], "b int, a string")
    sinks.write_jsonl(df, str(tmp_path / "out"), ["b"])
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]
    assert lines == ['{"a":null,"b":1}', '{"a":"é","b":2}']

    def refuse(staged):
        raise V.ContractViolation("no")

    with pytest.raises(V.ContractViolation):
        sinks.publish({"t": df}, str(tmp_path / "final"), refuse)
    assert not (tmp_path / "final").exists() and not (tmp_path / "final.staging").exists()
    sinks.publish({"t": df}, str(tmp_path / "final"))
    assert spark.read.parquet(str(tmp_path / "final/t")).count() == 2
    assert sinks.write_back(df, df, "b", str(tmp_path / "same")) is False
    sinks.write_manifest(tmp_path / "m.json", {"b": 1, "a": "é"})
    assert list(json.loads((tmp_path / "m.json").read_text())) == ["a", "b"]
    with pytest.raises(V.ContractViolation):
        sinks.require_distinct([tmp_path / "m.json", tmp_path / "." / "m.json"])
    assert sinks.svg_lines([("loss", 0.0, 1.0), ("loss", 1.0, 0.0)]).count("polyline") == 1


def test_seeded_assignment_ignores_input_order(spark):
    a = R.seeded_assignment(spark, ["x", "y", "z"], 1).collect()
    assert a == R.seeded_assignment(spark, ["z", "x", "y"], 1).collect()
    with pytest.raises(ValueError):
        R.seeded_assignment(spark, ["x", "x"], 1)


def test_review_numbers(spark):
    pairs = spark.createDataFrame([("1", False, 3, False, 5, False, "B"), ("2", True, 5, True, 3, False, " a ")], "eval_id string, swapped boolean, a_score int, a_critical boolean, b_score int, b_critical boolean, preference string")
    long = R.sides(pairs).withColumn("all", F.lit(1))
    d = R.deltas(long, "all").first()
    assert (d.base, d.tuned, d.delta) == (3.0, 5.0, 2.0)
    w = R.win_tie_loss(R.preferred(pairs).withColumn("all", F.lit(1)), "all").first()
    assert (w.wins, w.losses, w.ties, w.decisive_rate) == (2, 0, 0, 1.0)
    gate = {r.variant: r.passes for r in R.safety_gate(long).collect()}
    assert gate == {"base": False, "tuned": False}  # a high mean makes up for nothing
    none = R.win_tie_loss(R.preferred(pairs.withColumn("preference", F.lit("Tie"))).withColumn("all", F.lit(1)), "all").first()
    assert none.decisive_rate is None


def test_checkpoint_choice(spark):
    steps = spark.createDataFrame([(26, 1.0), (52, 0.997), (78, 1.05)], "step long, metric double")
    assert R.tolerant_argmin(steps, "metric", "step").first().step == 26
    assert R.tolerant_argmin(steps, "metric", "step", 0.001).first().step == 52
    c = spark.createDataFrame([(26, True, False), (52, True, False)], "step long, intact boolean, safe boolean")
    assert T.selection_status(c, [26, 52]).first().status == "failed_no_safe_checkpoint"
    assert T.selection_status(c, [26, 52, 78]).first().status == "incomplete"
    assert T.selection_status(c.withColumn("intact", F.col("step") < 50), [26, 52]).first().status == "failed_integrity"
    assert T.expected_steps(406, 4, 4, 5) == [26, 52, 78, 104, 130]


def test_tokens(spark):
    df = spark.createDataFrame([("ab", "abc"), ("ax", "abc"), ("abc", "abc")], "p string, t string")
    got = [r.v for r in df.select(T.completion_labels(T.char_tokens(F.col("p")), T.char_tokens(F.col("t"))).alias("v")).collect()]
    assert got == [[-100, -100, 109], None, None]
    assert one(spark, "abc", F.size(T.pad_right(T.char_tokens(F.col("text")), 0))) == 8


def test_judging(spark):
    comparisons = spark.createDataFrame([("e1", "c", "good text", "other text")], "eval_id string, context string, base string, tuned string")
    assignment = R.seeded_assignment(spark, ["e1"], 3)
    requests, key = J.build_requests(comparisons, assignment)
    rows = [("J0001", s, dim, 4, "because", ["text"]) for s in "ab" for dim in J.DIMENSIONS]
    kind = "request_id string, side string, dimension string, score int, reason string, evidence array<string>"
    judgments = spark.createDataFrame(rows, kind)
    assert J.answer_violations(requests, judgments, key).count() == 0
    assert {r.rule_id for r in J.answer_violations(requests.withColumn("response_a", F.lit("text x")), judgments, key).collect()} == {"V19"}
    bad = spark.createDataFrame([("J0001", "a", J.DIMENSIONS[0], 6, " ", ["absent"]), *rows[1:]], kind)
    assert {r.rule_id for r in J.answer_violations(requests, bad, key).collect()} == {"V17", "V18"}
    for evidence in ([], [" "], ["text", ""], None):  # what quotes nothing backs nothing
        unbacked = spark.createDataFrame([("J0001", "a", J.DIMENSIONS[0], 4, "because", evidence), *rows[1:]], kind)
        assert [r.rule_id for r in J.answer_violations(requests, unbacked, key).collect()] == ["V17"]
    for left, missing in (([], 10), (rows[:5], 5), (rows[1:], 1), (rows + rows[:1], 1)):  # no judgment, one side, a place empty, a place twice
        found = J.answer_violations(requests, spark.createDataFrame(left, kind), key).collect()
        assert [r.rule_id for r in found] == ["V18"] * missing
    assert {r.score for r in J.judged_scores(judgments, key).collect()} == {75.0}
    assert J.altered_key(key, comparisons, assignment).count() == 0


def test_places_of_the_grid_are_counted_by_request(spark):
    ids = ["1", "1", "2", "3", None]
    given = [("1", s, d) for s in "ab" for d in J.DIMENSIONS] + [("2", "a", J.DIMENSIONS[0])] * 2 + [("2", "c", "other"), ("2", "c", "other"), ("2", None, None), ("x", "b", J.DIMENSIONS[1]), (None, "a", J.DIMENSIONS[2])]
    n = Counter(given)
    want = Counter((i, f"{s}.{d}") for i in ids for s in "ab" for d in J.DIMENSIONS if i is None or n[i, s, d] != 1)
    want.update([("2", "c.other"), ("2", ""), ("x", f"b.{J.DIMENSIONS[1]}"), (None, f"a.{J.DIMENSIONS[2]}")])
    found = J.incomplete(spark.createDataFrame([(i,) for i in ids], "request_id string"), spark.createDataFrame(given, "request_id string, side string, dimension string"))
    assert Counter((r.record_id, r.detail) for r in found.collect()) == want and {r.rule_id for r in found.collect()} == {"V18"}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_judging_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"request_id":"J1"}\n{"request_id":"J2"}\n')
    paths = [str(tmp_path / x) for x in ("results", "audit", "checkpoint")]

    def judge(df):
        return df.select("request_id", F.lit("ok").alias("status"), F.lit("{}").alias("judgment"), F.lit("f").alias("fingerprint"))

    for _ in range(2):
        run_pending(spark, str(tmp_path / "in"), "request_id string", *paths, judge).awaitTermination()
    (tmp_path / "in/2.json").write_text('{"request_id":"J2"}\n{"request_id":"J3"}\n')
    run_pending(spark, str(tmp_path / "in"), "request_id string", *paths, judge).awaitTermination()
    assert sorted(r.request_id for r in spark.read.parquet(paths[0]).collect()) == ["J1", "J2", "J3"]


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-01 23:00:00", "a"), ("2024-01-02 00:00:00", "a")], "ts string, event_type string")
    assert sorted(r.n for r in windowed_counts(df).collect()) == [1, 2]


def test_marks_of_other_scripts(spark):
    """By hand: clauses and sentences end at full-width marks as at ASCII ones."""
    assert one(spark, "好。坏！嗯，不对", X.sentence_lengths(F.col("text"))) == [1, 1, 4]
    assert one(spark, "一二；三\n四五六？", X.sentence_lengths(F.col("text"))) == [2, 1, 3]
    governed = one(spark, "never，well this", X.polarity(F.col("text"), "well"))
    assert (governed.affirmed, governed.negated) == (1, 0)  # the comma ends the clause that is negated
    governed = one(spark, "never quite well this", X.polarity(F.col("text"), "well"))
    assert (governed.affirmed, governed.negated) == (0, 1)
    assert one(spark, "啊！！!", X.terms_total(F.col("text"), tuple(config.EXCLAMATIONS))) == 3


def test_points_share_one_scale(spark):
    """By hand: values 1..3 with a margin of 0.16 span 2.32, steps 10..30."""
    points = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 2.0), ("b", 30, 3.0)], "series string, step int, value double")
    got = {(r.series, r.step): (r.x, r.y) for r in T.plot_points(points).collect()}
    assert got == {("a", 10): (0.0, 0.068966), ("a", 20): (0.5, 0.5), ("b", 30): (1.0, 0.931034)}


def test_review_decision(spark):
    """By hand: persona rises by 1; a core dimension that falls by 0.5, a critical answer, or a missing one stops it."""

    def decided(core=4, bad=False, lost=False):
        score = lambda v, x: 4 if v == "base" else core if x == "task_completion" else 5
        long = spark.createDataFrame([("g", e, v, x, score(v, x)) for e in "12" for v in ("base", "tuned") for x in J.DIMENSIONS], "lang string, eval_id string, variant string, dimension string, score int")
        rows = [("g", e, v, bad and e == "1" and v == "tuned", 5) for e in "12" for v in ("base", "tuned")]
        critical = spark.createDataFrame(rows[: 3 if lost else 4], "lang string, eval_id string, variant string, critical boolean, safety int")
        won = spark.createDataFrame([("g", "base"), ("g", "tie")], "lang string, winner string")
        due = spark.createDataFrame([("g", "1"), ("g", "2")], "lang string, eval_id string")
        r = R.review_decision(long, critical, won, due, "lang").first()
        return r.persona_improved, r.core_kept, r.complete, r.new_critical, r.gate_passes, r.accepted

    assert decided() == (True, True, True, 0, True, True)
    assert decided(core=3) == (True, False, True, 0, True, False)
    assert decided(bad=True) == (True, True, True, 1, False, False)
    assert decided(lost=True) == (True, True, False, 0, False, False)


def test_spaced_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, "é", [1]), (1, None, None)], "b int, a string, c array<int>")
    sinks.write_spaced_jsonl(df, tmp_path / "x.jsonl", ["b"])
    assert (tmp_path / "x.jsonl").read_text() == '{"b": 1, "a": null, "c": null}\n{"b": 2, "a": "é", "c": [1]}\n'
    with pytest.raises(V.ContractViolation):
        sinks.write_spaced_jsonl(df, tmp_path / "y.jsonl", ["b"], most=1)


def test_unique_strings_and_patched_ids(spark):
    got = spark.createDataFrame([(["a", "b"],), (["a", "a"],), (["a", " "],), ([],)], "v array<string>").select(V.unique_strings(F.col("v")).alias("ok"))
    assert [r.ok for r in got.collect()] == [True, False, False, True]


def test_the_judge_counts_in_its_layer_and_guards_in_none(spark):
    from parlance.operators import judge as J

    rules = spark.createDataFrame([(1, "base", 100.0, 50.0, 80.0, 60.0, 40.0, 20.0), (1, "tuned", 90.0, 50.0, 80.0, 60.0, 40.0, 20.0), (2, "base", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "eval_id int, variant string, style_marker double, register_match double, factual_support double, constraints double, principle_coverage double, conflict_safety double")
    scores = dict(zip(J.DIMENSIONS, (5, 3, 1, 4, 2), strict=True))
    given = [(1, v, x, s) for v in ("base", "tuned") for x, s in scores.items()] + [(2, "base", "surface_style", 3)]
    got = {(r.eval_id, r.variant): r for r in J.candidate_scores(rules, spark.createDataFrame(given, "eval_id int, variant string, dimension string, score int"), ["eval_id", "variant"]).collect()}
    one = got[1, "base"]
    # by hand: .3*100+.3*50+.4*100; .35*80+.35*60+.3*50; .35*40+.25*20+.4*0; .3*85+.35*64+.35*19
    assert (one["surface"], one["knowledge"], one["values"], one["overall"]) == (85.0, 64.0, 19.0, 54.55)
    assert (one["task_completion"], one["safety_ethics"]) == (75.0, 25.0)
    # without a judgment of a dimension there is no score of its layer, nor overall
    assert got[2, "base"]["surface"] == 20.6 and got[2, "base"]["knowledge"] is None and got[2, "base"]["overall"] is None
    means = {r.part: r for r in J.variant_means(J.candidate_scores(rules.where("eval_id = 1"), spark.createDataFrame(given, "eval_id int, variant string, dimension string, score int"), ["eval_id", "variant"])).collect()}
    assert (means["surface"].base, means["surface"].tuned, means["surface"].delta, means["surface"].kind) == (85.0, 82.0, -3.0, "layer")
    assert means["safety_ethics"].kind == "guard" and means["safety_ethics"].delta == 0


def test_fields_as_written(spark):
    read = lambda f, *given: [one(spark, x, f(F.col("text"))) for x in given]
    assert read(X.flag, " Yes\n", "NO", "y", "1", "", None) == [True, False, None, None, None, None]
    assert read(X.rating, " 5\t", "0", "6", "3.0", "1\n2", None) == [5, None, None, None, None, None]
    assert read(X.choice, "a", " B ", "tIE", "both", None) == ["A", "B", "Tie", None, None]
    assert read(X.tags, " a ; b,,", None, "") == [["a", "b"], [], []]


def test_json_values_of_one_type(spark):
    same = [('{"a":1,"b":[true]}', '{"b": [true], "a": 1}'), ("1", " 1")]
    other = [("true", "1"), ("1", "1.0"), ('{"a":1}', '{"a":1,"b":null}'), ("[1,2]", "[2,1]"), ('"1"', "1"), ("{", "{"), (None, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(same + other)], "i int, a string, b string")
    assert [r.i for r in df.where(V.same_json(F.col("a"), F.col("b"))).orderBy("i").collect()] == [0, 1]


def test_one_to_one_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("x", None), ("y", 2), ("z", 2)], "a string, b int")
    assert {tuple(r) for r in V.not_one_to_one(df, "a", "b").collect()} == {("a", "x", 2), ("b", "2", 2)}


def test_bad_lines_are_named(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n[1]\n')
    got = files.line_violations(files.read_lines(spark, str(tmp_path / "x.jsonl")), "a int").collect()
    assert sorted((r.record_id, r.detail) for r in got) == [("x.jsonl:3", '{"a": '), ("x.jsonl:4", "[1]")]


def test_plot_has_axes_and_an_escaped_title():
    svg = sinks.svg_lines([("a<b", 0.0, 1.0), ("a<b", 1.0, 0.0)], 100, 80, "x & y", 10)
    assert 'points="10.00,10.00 90.00,70.00"' in svg and 'd="M10,10 V70 H90"' in svg and "x &amp; y" in svg and "a&lt;b" in svg


def test_excerpts_of_any_length(spark):
    """Keys of one to four inner words, of the first characters, and a text of a megabyte; excerpts may begin and end within words."""
    from parlance.plans.relations import holding

    big = " ".join(f"w{i % 9973}" for i in range(180_000))
    texts = {1: "one two three four five six seven", 2: "bone two three", 3: big, 4: None, 5: "", 6: "onetwothree", 7: "xx one two three four fivefold"}
    excerpts = {1: "ne two three four five", 2: "one two three", 3: "one two t", 4: "netwothr", 5: "w9970 w9971 w9972 w0 w1 w2", 6: "two three four five six seven eight", 7: "n two th", 8: "w1 w2 w4 w5 w6 w7", 9: "one two three four five six seven"}
    got = holding(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), spark.createDataFrame(list(excerpts.items()), "item_id int, excerpt string")).collect()
    assert sorted(map(tuple, got)) == sorted((d, i) for d, t in texts.items() for i, e in excerpts.items() if t and e in t)
