"""Text kernels as Catalyst expressions: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

CLAUSE_END = config.CLAUSE_MARKS + config.LATIN_MARKS
SENTENCE_END = config.SENTENCE_MARKS + config.LATIN_MARKS
#: What \\s stands for in a pattern.
WHITE = " \t\n\x0b\f\r"


def let(value: Column, use) -> Column:
    """use(value), with value computed once even inside lambdas, where Catalyst shares no subexpressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalized(text: Column) -> Column:
    """Letters and digits only, lower-cased: the key under which texts count as the same."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_hash(value: Column) -> Column:
    """SHA-256 of the compact JSON of a struct whose fields are declared in alphabetical order."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)


def without(text: Column, chars: str, instead: str = "") -> Column:
    """A text with each of some characters replaced, one after the other; those that it lacks cost a search only. A pattern pays for every character and match."""
    marks = F.array(*[F.lit(c) for c in chars])
    return F.aggregate(marks, text, lambda s, c: F.when(F.contains(s, c), F.replace(s, c, F.lit(instead))).otherwise(s)) if chars else text


def cut(text: Column, marks: str) -> Column:
    """The parts of a text between marks, which are made equal first: a cut at one character needs no pattern."""
    one = "\n" if "\n" in marks else marks[0]
    return F.split(without(text, marks.replace(one, ""), one), one if one == "\n" else quote(one), -1)


def unspaced(text: Column) -> Column:
    """A text without white space but for line feeds, which are marks too: what lengths, sentences and letters are found from."""
    return without(text, WHITE.replace("\n", ""))


def visible_length(text: Column, seen: Column | None = None) -> Column:
    """Characters that are not white space. `unspaced` can be given, here and below, where several values ask for it."""
    return F.length(without(unspaced(text) if seen is None else seen, "\n")).cast("long")


def stable_seed(*parts: Column) -> Column:
    """The first four bytes, big-endian, of the SHA-256 of the parts joined by NUL."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 8), 16, 10).cast("long")


def mapped(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table; null where the key is not in it."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key) if table else F.lit(None).cast("string")


def quote(term: str) -> str:
    if r"\E" in term:
        raise ValueError(f"{term!r} cannot be quoted in a pattern")
    return rf"\Q{term}\E"


def term_count(text: Column, term: str) -> Column:
    """Occurrences of a term that do not overlap each other."""
    some = F.floor((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")
    return F.when(~F.contains(text, F.lit(term)), F.lit(0).cast("long")).otherwise(some)


def terms_total(text: Column, terms: Sequence[str]) -> Column:
    """Sum over terms, each counted for itself: nested terms count twice."""
    return sum((term_count(text, t) for t in terms), F.lit(0).cast("long"))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def exclusive_counts(text: Column, terms: Sequence[str]) -> dict[str, Column]:
    """Counts in which a character serves one term only: the longest terms take theirs first, equals by spelling.

    Each hit is replaced by as many sentinels. Terms that overlap themselves are refused: for them this fold could differ
    from an account of occupied characters.
    """
    out, rest = {}, text
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        if config.overlaps_itself(t):
            raise ValueError(f"{t!r} overlaps itself")
        out[t] = term_count(rest, t)
        rest = F.replace(rest, F.lit(t), F.lit("\x01" * len(t)))
    return out


def exclusive_array(text: Column, terms: Sequence[str]) -> Column:
    """exclusive_counts as an array, the text folded once for all of them: a hit becomes a sentinel of another length, which tells how many there were."""
    order = sorted(terms, key=lambda t: (-len(t), t))
    for t in order:
        if config.overlaps_itself(t):
            raise ValueError(f"{t!r} overlaps itself")

    def fold(rest: Column, k: int, counts: list[Column]) -> Column:
        if k == len(order):
            return F.array(*counts)
        size = len(order[k])
        sentinel = "\x01" if size > 1 else "\x01\x01"
        count = lambda after: ((F.length(rest) - F.length(after)) / (size - len(sentinel))).cast("long")
        return let(F.when(F.contains(rest, F.lit(order[k])), F.replace(rest, F.lit(order[k]), F.lit(sentinel))).otherwise(rest), lambda after: fold(after, k + 1, [*counts, count(after)]))

    return let(text, lambda whole: fold(whole, 0, []))


def clauses(text: Column) -> Column:
    """struct(clauses, heads): a text's clauses and the beginnings of them that can stand in the window after a term."""
    return let(cut(text, CLAUSE_END), lambda c: F.struct(c.alias("clauses"), F.transform(c, lambda x: F.left(x, F.lit(config.NEAR_AFTER))).alias("heads")))


def polarity(text: Column, term: str, within_clauses: Column | None = None) -> Column:
    """struct(affirmed, negated): occurrences of a term, by whether a negation governs them; null has none. `clauses` of the text can be given, where several terms ask for them.

    A text is cut into clauses, and only clauses that hold the term are cut at it. A running length and the last few
    characters are all that is carried from one occurrence to the next, so the work is linear in the text; only in a clause with an
    exempting phrase is each occurrence's part of the clause read anew. Clause marks within terms, negators and corrections are refused.
    """
    for word in (term, *config.NEGATORS, *config.CORRECTIONS):
        if not word or any(mark in word for mark in config.CLAUSE_MARKS + config.LATIN_MARKS):
            raise ValueError(f"{word!r} is empty or holds a mark that ends clauses")
    near, width = config.NEAR_BEFORE, config.NEAR_AFTER
    zero = F.lit(0).cast("long")

    def first_after(heads: Column, i: Column, between: str) -> Column:
        # as many parts as the window has characters are enough, whatever their lengths
        return F.array_join(F.slice(heads, i + 1, F.lit(width + 1)), between)

    def governed(c: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            def judged(v: Column) -> Column:
                direct = F.lit(False)
                for n in config.NEGATORS:
                    direct = direct | F.endswith(v["near"], F.lit(n))
                rest = F.left(c["clause"], v["at"])
                for phrase in config.EXEMPT:
                    rest = F.replace(rest, F.lit(phrase), F.lit(""))
                scope = F.when(c["exempt"], any_term(rest, config.SCOPE_NEGATORS)).otherwise(F.coalesce(c["first"] <= v["at"], F.lit(False)))
                after = F.left(F.concat(first_after(c["heads"], k, term), F.lit("\n"), c["next"]), F.lit(width))
                bad = F.when(direct | scope | any_term(after, config.CORRECTIONS), 1).otherwise(0).cast("long")
                return F.struct((v["at"] + len(term)).alias("at"), F.right(F.concat(v["near"], F.lit(term)), F.lit(near)).alias("near"), (s["all"] + 1).alias("all"), (s["bad"] + bad).alias("bad"))

            part = F.element_at(c["parts"], k)
            return let(F.struct((s["at"] + F.length(part)).alias("at"), F.right(F.concat(s["near"], part), F.lit(near)).alias("near")), judged)

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("near"), zero.alias("all"), zero.alias("bad"))
        return F.aggregate(F.sequence(F.lit(1), F.size(c["parts"]) - 1), start, step)

    def within(clause: Column, after: Column) -> Column:
        ends = [F.when(F.contains(clause, F.lit(n)), F.instr(clause, n) + (len(n) - 1)) for n in config.SCOPE_NEGATORS]
        first = F.array_min(F.array(*ends)) if ends else F.lit(None).cast("int")

        def parted(parts: Column) -> Column:
            return let(F.struct(clause.alias("clause"), parts.alias("parts"), F.transform(parts, lambda p: F.left(p, F.lit(width))).alias("heads"), after.alias("next"), first.alias("first"), any_term(clause, config.EXEMPT).alias("exempt")), governed)

        return let(F.split(clause, quote(term), -1), parted)

    def counted(v: Column) -> Column:
        held = F.filter(F.sequence(F.lit(1), F.size(v["clauses"])), lambda i: F.contains(F.element_at(v["clauses"], i), F.lit(term)))
        each = F.transform(held, lambda i: within(F.element_at(v["clauses"], i), F.left(first_after(v["heads"], i, "\n"), F.lit(width))))
        total = F.struct(zero.alias("affirmed"), zero.alias("negated"))
        return F.aggregate(each, total, lambda a, x: F.struct((a["affirmed"] + x["all"] - x["bad"]).alias("affirmed"), (a["negated"] + x["bad"]).alias("negated")))

    none = F.struct(zero.alias("affirmed"), zero.alias("negated"))
    return F.when(F.contains(text, F.lit(term)), counted(within_clauses) if within_clauses is not None else let(clauses(text), counted)).otherwise(none)


def sentence_lengths(text: Column, seen: Column | None = None) -> Column:
    """Visible lengths of the sentences that have any."""
    parts = cut(unspaced(text) if seen is None else seen, SENTENCE_END)
    own = parts if "\n" in SENTENCE_END else F.transform(parts, lambda s: without(s, "\n"))
    return F.filter(F.transform(own, lambda s: F.length(s).cast("long")), lambda n: n > 0)


def char_ngrams(text: Column, n: int) -> Column:
    """Different n-grams of a text's letters and digits (ASCII and CJK); a shorter text is its own; none if empty."""
    def grams(c: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.concat(*[F.element_at(c, i + j) for j in range(n)]))
        return F.when(F.size(c) >= n, F.array_distinct(each)).when(F.size(c) > 0, F.array(F.array_join(c, ""))).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(letters(text), ""), lambda x: x != ""), grams)


def letters(text: Column) -> Column:
    """A text's letters and digits (ASCII and CJK). The most usual of the others go by plain passes, so that the pattern meets few."""
    return F.regexp_replace(without(text, " \n,."), "[^0-9A-Za-z㐀-鿿]+", "")


def grams_held(text: Column, grams: Column, n: int) -> Column:
    """How many of another text's n-grams, as char_ngrams gives them, are n-grams of this text too, which are not listed for that."""
    def held(own: Column) -> Column:
        many = F.filter(grams, lambda g: (F.length(g) == n) & F.contains(own, g))
        return F.size(F.when(F.length(own) >= n, many).otherwise(F.filter(grams, lambda g: (g == own) & (own != ""))))

    return let(letters(text), held)


def fact_status(text: Column, activation: Column, fact: str, within_clauses: Column | None = None) -> Column:
    """null if no trigger is met; else contradicted before supported before unresolved."""
    triggers, supports, contradictions = config.FACTS[fact]
    affirmed = lambda terms: sum((polarity(text, t, within_clauses)["affirmed"] for t in terms), F.lit(0))
    return F.when(any_term(activation, triggers), F.when(affirmed(contradictions) > 0, "contradicted").when(affirmed(supports) > 0, "supported").otherwise("unresolved"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def flag(text: Column) -> Column:
    """yes/no in any case, with space around; null for anything else."""
    t = F.lower(stripped(text))
    return F.when(t == "yes", True).when(t == "no", False)


def rating(text: Column) -> Column:
    """A whole number from 1 to 5, with space around; null for anything else, 3.0 included."""
    t = stripped(text)
    return F.when(t.rlike("^[1-5]\\z"), t.cast("int"))


def choice(text: Column) -> Column:
    """a, b or tie in any case, with space around, as A, B or Tie; null for anything else."""
    return mapped(F.lower(stripped(text)), {"a": "A", "b": "B", "tie": "Tie"})


def tags(text: Column) -> Column:
    """A list written with commas or semicolons: trimmed, without blanks; null is an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), stripped), lambda x: x != "")
