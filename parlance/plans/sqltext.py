"""The text kernels once more, as DuckDB SQL: written apart from the Catalyst ones, to hold them to account."""

from __future__ import annotations

from .. import config


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normalized(t: str) -> str:
    return rf"lower(regexp_replace({t}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def visible(t: str) -> str:
    return rf"length(regexp_replace({t}, '\s+', '', 'g'))"


def seed(*parts: str) -> str:
    return "('0x' || sha256(" + " || chr(0) || ".join(parts) + ")[1:8])::bigint"


def count(t: str, term: str) -> str:
    return f"((length({t}) - length(replace({t}, {q(term)}, ''))) // {len(term)})"


def total(t: str, terms) -> str:
    return "(" + " + ".join(count(t, x) for x in terms) + ")"


def any_of(t: str, terms) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(x)})" for x in terms) + ")"


def exclusive(t: str, terms) -> dict[str, str]:
    out, rest = {}, t
    for x in sorted(terms, key=lambda x: (-len(x), x)):
        out[x] = count(rest, x)
        rest = f"replace({rest}, {q(x)}, repeat(chr(1), {len(x)}))"
    return out


def hits(t: str, term: str) -> str:
    """A list with, for each occurrence, whether a negation governs it."""
    before = f"array_to_string(p[1:k], {q(term)})"
    clause = f"list_last(regexp_split_to_array({before}, '[{config.CLAUSE_MARKS}{config.LATIN_MARKS}]'))"
    for x in config.EXEMPT:
        clause = f"replace({clause}, {q(x)}, '')"
    near = f"right({before}, {config.NEAR_BEFORE})"
    direct = " OR ".join(f"suffix({near}, {q(x)})" for x in config.NEGATORS)
    after = f"substring({t}, length({before}) + {len(term) + 1}, {config.NEAR_AFTER})"
    parts_ = f"string_split({t}, {q(term)})"
    return f"list_transform([{parts_}], lambda p: list_transform(range(1, len(p)), lambda k: {direct} OR {any_of(clause, config.SCOPE_NEGATORS)} OR {any_of(after, config.CORRECTIONS)}))[1]"


def affirmed(t: str, term: str) -> str:
    return f"len(list_filter({hits(t, term)}, lambda x: NOT x))"


def negated(t: str, term: str) -> str:
    return f"len(list_filter({hits(t, term)}, lambda x: x))"


def sentences(t: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({t}, '[{config.SENTENCE_MARKS}{config.LATIN_MARKS}]'), lambda s: length(regexp_replace(s, '\s+', '', 'g'))), lambda n: n > 0)"


def ngrams(t: str, n: int) -> str:
    s = f"regexp_replace({t}, '[^0-9A-Za-z㐀-鿿]+', '', 'g')"
    return f"list_transform([{s}], lambda v: CASE WHEN length(v) >= {n} THEN list_distinct(list_transform(range(1, length(v) - {n} + 2), lambda i: substring(v, i, {n}))) WHEN length(v) > 0 THEN [v] ELSE [] END)[1]"


def status(t: str, act: str, fact: str) -> str:
    triggers, supports, bad = config.FACTS[fact]
    s = lambda terms: " + ".join(affirmed(t, x) for x in terms)
    return f"CASE WHEN {any_of(act, triggers)} THEN CASE WHEN {s(bad)} > 0 THEN 'contradicted' WHEN {s(supports)} > 0 THEN 'supported' ELSE 'unresolved' END END"


def bounded(x: str) -> str:
    return f"round(greatest(0.0::double, least(100.0::double, ({x})::double)) + 1e-9::double, 4)"


def style_marker(t: str, ser: str) -> str:
    c = list(exclusive(t, config.STYLE_TERMS).values())
    h = "(" + " + ".join(c) + ")"
    rep = " + ".join(f"greatest(0, {x} - 1)" for x in c)
    n = f"greatest(1, {visible(t)})"
    most = f"greatest(1, ceil({n} / 70.0::double))"
    light = f"CASE WHEN {h} < 1 THEN 75.0::double + 25.0::double * {h} WHEN {h} <= {most} THEN 100.0::double ELSE 100.0::double - 18.0::double * ({h} - {most}) END"
    return bounded(f"CASE WHEN {ser} >= 4 THEN 100.0::double - 18.0::double * {h} ELSE ({light}) - 12.0::double * ({rep}) - 8.0::double * greatest(0.0::double, {h} * 100.0::double / greatest(35, {n}) - 3) END")


def register(t: str, ser: str) -> str:
    n, ls = visible(t), sentences(t)
    mean = f"CASE WHEN len({ls}) > 0 THEN list_sum({ls})::double / len({ls}) ELSE {n}::double END"
    rhythm = f"(CASE WHEN {mean} BETWEEN 10 AND 48 THEN 10.0::double ELSE -10.0::double END)"
    col, form, bad = (total(t, x) for x in (config.COLLOQUIAL, config.FORMAL, config.INAPPROPRIATE))
    ex, ask = total(t, config.EXCLAMATIONS), total(t, config.QUESTIONS)
    high = f"88.0::double + least(8, 2 * {form}) + {rhythm} - 7 * {col} - 7 * greatest(0, {ex} - 1) - 35 * {bad} - CASE WHEN {n} < 18 THEN 12 ELSE 0 END"
    low = f"78.0::double + least(14, 7 * {col}) + {rhythm} + CASE WHEN {ex} > 0 OR {ask} > 0 THEN 3 ELSE 0 END - 3 * greatest(0, {form} - 3) - 15 * {bad}"
    mid = f"88.0::double + {rhythm} + least(6, 2 * ({col} + {form})) - 25 * {bad} - 5 * greatest(0, {ex} - 2)"
    return bounded(f"(CASE WHEN {ser} >= 4 THEN {high} WHEN {ser} <= 2 THEN {low} ELSE {mid} END) - CASE WHEN {n} > 220 THEN least(20.0::double, ({n} - 220) / 10.0::double) ELSE 0.0::double END")


def facts(t: str, act: str) -> tuple[str, str]:
    s = [status(t, act, f) for f in config.FACTS]
    c = lambda k: "(" + " + ".join(f"(CASE WHEN ({x}) = '{k}' THEN 1 ELSE 0 END)" for x in s) + ")"
    return c("contradicted"), c("unresolved")


def factual(t: str, gold: str, act: str) -> str:
    c, r = ngrams(t, 2), ngrams(gold, 2)
    cov = f"(len(list_intersect({c}, {r}))::double / greatest(1, len({r})))"
    bad, open_ = facts(t, act)
    ref = f"(CASE WHEN coalesce(length({gold}), 0) > 0 THEN 60 + 40 * least(1.0::double, {cov} / 0.45::double) ELSE 80.0::double END)"
    return bounded(f"0.4::double * {ref} + 0.6::double * greatest(0.0::double, least(100.0::double, 100.0::double - 100 * {bad} - 12 * {open_}))")


def constraint(t: str, act: str) -> str:
    bad, open_ = facts(t, act)
    return bounded(f"100.0::double - 15 * {open_} - 65 * {bad}")


def principle(t: str, cap: str) -> str:
    known = ", ".join(q(c) for c in sorted({c for _, w in config.PRINCIPLES.values() for c in w}))
    cov, exp = [], []
    for name, (keys, wanted) in config.PRINCIPLES.items():
        due = f"({cap} IN ({', '.join(map(q, wanted))}) OR ({str(name in config.DEFAULT_PRINCIPLES).lower()} AND NOT coalesce({cap} IN ({known}), false)))"
        exp.append(f"(CASE WHEN {due} THEN 1 ELSE 0 END)")
        cov.append(f"(CASE WHEN {due} AND {any_of(t, keys)} THEN 1 ELSE 0 END)")
    act = "(" + " + ".join(f"(CASE WHEN contains({t}, {q(a)}) THEN 1 ELSE 0 END)" for a in config.ACTIONS) + ")"
    kw = total(t, [k for keys, _ in config.PRINCIPLES.values() for k in keys])
    n = f"greatest(1, {visible(t)})"
    return bounded(f"35 + 40.0::double * ({' + '.join(cov)}) / greatest(1, {' + '.join(exp)}) + 25 * least(1.0::double, {act} / 2.0::double) - 2 * greatest(0.0::double, 100.0::double * {kw} / {n} - 10)")


def conflict(t: str, ser: str, act: str) -> str:
    on = [(f"{any_of(act, tr)}", f"{any_of(t, ac)}") for tr, ac in config.CONFLICTS.values()]
    active = "(" + " + ".join(f"(CASE WHEN {a} THEN 1 ELSE 0 END)" for a, _ in on) + ")"
    cov = "(" + " + ".join(f"(CASE WHEN {a} AND {b} THEN 1 ELSE 0 END)" for a, b in on) + ")"
    dflt = "(" + " + ".join(f"(CASE WHEN contains({t}, {q(a)}) THEN 1 ELSE 0 END)" for a in config.ACTIONS) + ")"
    high = f"({ser} >= 4 OR {active} > 0)"
    ratio = f"(CASE WHEN {active} > 0 THEN {cov}::double / greatest(1, {active}) WHEN {high} THEN least(1.0::double, {dflt} / 2.0::double) ELSE 1.0::double END)"
    harm = "(" + " + ".join(affirmed(t, x) for x in config.HARMFUL) + ")"
    return bounded(f"CASE WHEN {high} THEN 30 + 70 * {ratio} ELSE 100.0::double END - 60 * {harm}")
