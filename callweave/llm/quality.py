"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects texts by counts (``COUNTS``) that it names. On a bounded sample every rule is timed from the raw text,
its counts included, and its rejections are counted; the rules then run in order of rejections per second. The counts of
a rule are computed where it stands in that order, and only for texts that no earlier rule has rejected: a text stops at
the first rule that rejects it, and costly counts never see it. Rules share the counts that they have in common. The
order changes the time and which rule is named, never the verdict.

Seconds are rounded to powers of two, so that noise in the timing rarely changes the order.

Edge cases: a null or empty text has no words, counts of zero, and is rejected by ``few_words``; a very long text is one
row like any other, with arrays of its words; repeated rows are judged one by one; null or equal ids change nothing; an
empty table gives an empty result. The columns of the caller pass through untouched whatever their names: internal
columns take a prefix that none of them has, and the verdict of ``cascade`` the first of ``rejected_by``,
``rejected_by_`` ... that is free.

Repeated three-word windows are found by a 64-bit hash of the three words: two different windows of one text share it
with a probability below 1e-10 for a text of 20,000 words.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are estimated (its expected size), and words that a text needs.
SAMPLE_ROWS, LEAST_WORDS = 2000, 50

Counts = Callable[[str], Column]


def _at(m: Counts) -> Column:
    """Where the windows begin that stand twice or more in the text."""
    same = lambda e, j: F.coalesce(F.get(m("sorted"), j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(m("sorted"), j + 1)["h"] == e["h"], F.lit(False))
    return F.transform(F.filter(m("sorted"), same), lambda e: e["i"])


def _less(m: Counts, signs: str) -> Column:
    return (F.length(m("solid")) - F.length(F.translate(m("solid"), signs, ""))).cast("long")


#: Every count: what it needs, and its Column. Arrays stand on their own: what a lambda reads is computed once.
COUNTS: dict[str, tuple[tuple[str, ...], Callable[[Counts], Column]]] = {
    "words": (("text",), lambda m: F.array_remove(F.split(m("text"), "[ \\t-\\r]+"), "")),
    "n_words": (("words",), lambda m: F.array_size(m("words")).cast("long")),
    "n_distinct": (("words",), lambda m: F.array_size(F.array_distinct(m("words")))),
    "solid": (("text",), lambda m: F.translate(m("text"), SPACE, "")),
    "word_chars": (("solid",), lambda m: F.length(m("solid")).cast("long")),
    "n_symbols": (("solid",), lambda m: _less(m, SYMBOLS)),
    "n_digits": (("solid",), lambda m: _less(m, "0123456789")),
    "lines": (("text",), lambda m: F.when(F.instr(m("text"), "\n") > 0, F.filter(F.split(m("text"), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0))),
    "distinct_lines": (("lines",), lambda m: F.array_distinct(m("lines"))),
    "n_dup_lines": (("lines", "distinct_lines"), lambda m: F.coalesce(F.array_size(m("lines")) - F.array_size(m("distinct_lines")), F.lit(0)).cast("long")),
    "line_chars": (("lines",), lambda m: F.length(F.array_join(m("lines"), ""))),
    "distinct_line_chars": (("distinct_lines",), lambda m: F.length(F.array_join(m("distinct_lines"), ""))),
    "zip": (("words", "n_words"), lambda m: F.slice(F.arrays_zip(m("words").alias("a"), F.slice(m("words"), F.lit(2), m("n_words").cast("int")).alias("b"), F.slice(m("words"), F.lit(3), m("n_words").cast("int")).alias("c")),
                                                    F.lit(1), F.greatest(m("n_words").cast("int") - 2, F.lit(0)))),
    "hashes": (("zip",), lambda m: F.transform(m("zip"), lambda z: F.xxhash64(z["a"], z["b"], z["c"]))),
    "sorted": (("hashes",), lambda m: F.when(F.array_size(F.array_distinct(m("hashes"))) < F.array_size(m("hashes")), F.sort_array(F.transform(m("hashes"), lambda x, i: F.struct(x.alias("h"), i.alias("i")))))),
    "at": (("sorted",), _at),
    "n_repeat_words": (("at",), lambda m: F.coalesce(F.array_size(F.array_union(F.array_union(m("at"), F.transform(m("at"), lambda i: i + 1)), F.transform(m("at"), lambda i: i + 2))), F.lit(0)).cast("long")),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Counts], Column]


def base_rules(least_words: int = LEAST_WORDS) -> list[Rule]:
    return [
        Rule("few_words", ("n_words",), lambda m: m("n_words") < least_words),
        Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda m: m("n_repeat_words") * 100 > m("n_words") * 50),
    ]


def standard_rules() -> list[Rule]:
    """The rules beside the base ones; thresholds are the defaults of this operator."""
    return [
        Rule("symbols", ("n_symbols", "n_words"), lambda m: m("n_symbols") * 10 > m("n_words")),
        Rule("duplicate_lines", ("n_dup_lines", "line_chars", "distinct_line_chars"), lambda m: (m("n_dup_lines") > 0) & ((m("line_chars") - m("distinct_line_chars")) * 10 > m("line_chars") * 3)),
        Rule("word_length", ("word_chars", "n_words"), lambda m: (m("word_chars") < m("n_words") * 2) | (m("word_chars") > m("n_words") * 15)),
        Rule("digits", ("n_digits", "word_chars"), lambda m: m("n_digits") * 5 > m("word_chars")),
        Rule("few_distinct", ("n_distinct", "n_words"), lambda m: m("n_distinct") * 10 < m("n_words")),
    ]


class Work:
    """``docs`` with counts in columns of their own, added as they are called for."""

    def __init__(self, docs: DataFrame, text: str = "text"):
        self.p = "_q_"
        while any(c.lower().startswith(self.p) for c in docs.columns):
            self.p = "_" + self.p
        self.have = {"text"}
        self.df = docs.withColumn(f"{self.p}text", F.coalesce(F.col(text), F.lit("")))

    def __call__(self, name: str) -> Column:
        return F.col(self.p + name)

    def add(self, names: tuple[str, ...] | list[str], where: Column | None = None) -> Work:
        """Computes counts and what they need; null where ``where`` is false."""
        for name in names:
            if name not in self.have:
                needs, build = COUNTS[name]
                self.add(needs, where)
                column = build(self)
                self.df = self.df.withColumn(self.p + name, column if where is None else F.when(where, column))
                self.have.add(name)
        return self

    def judge(self, rules: list[Rule]) -> Work:
        """Adds ``by``, the name of the first of ``rules`` that rejects the text, null if none does."""
        by = self.p + "by"
        if by not in self.df.columns:
            self.df = self.df.withColumn(by, F.lit(None).cast("string"))
        for r in rules:
            self.add(r.needs, F.col(by).isNull())
            self.df = self.df.withColumn(by, F.when(F.col(by).isNull(), F.when(r.rejects(self), r.name)).otherwise(F.col(by)))
        return self

    def held(self, name: str) -> Work:
        """A column behind an expression that the optimizer takes for nondeterministic: filters on it stay above, else
        they are pushed down with all arrays written out, lambdas included, and each element computes its array anew."""
        self.df = self.df.withColumn(self.p + name, F.when(F.monotonically_increasing_id() >= 0, self(name)))
        return self


def estimate(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """[{name, seconds, rejected}] per rule, on a random sample of about ``sample_rows`` rows, whatever the ids are.

    seconds: the better of two runs from the raw texts to the verdict, less the time of a run without a rule, rounded to
    a power of two."""
    total = docs.count()
    if not total:
        return [{"name": r.name, "seconds": 1.0, "rejected": 0} for r in rules]
    # every task filters its share of the table; only the sample itself is dealt anew
    sample = docs.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / total), seed=7).limit(4 * sample_rows).repartition(2).persist()
    try:
        sample.count()

        def timed(r: Rule | None) -> tuple[float, int]:
            best, got = 1e9, 0
            for _ in range(2):
                began = time.perf_counter()
                w = Work(sample).add(r.needs if r else ())
                got = w.df.agg(F.count_if(r.rejects(w) if r else F.length(w("text")) < 0)).first()[0]
                best = min(best, time.perf_counter() - began)
            return best, got

        idle, out = timed(None)[0], []
        for r in rules:
            s, got = timed(r)
            out.append({"name": r.name, "seconds": 2.0 ** round(log2(max(s - idle, 1 / 64))), "rejected": got})
        return out
    finally:
        sample.unpersist()


def ordered(rules: list[Rule], figures: list[dict]) -> list[Rule]:
    """By rejections per second, most first; the name breaks ties."""
    rate = {f["name"]: f["rejected"] / f["seconds"] for f in figures}
    return sorted(rules, key=lambda r: (-rate[r.name], r.name))


def _judged(docs: DataFrame, rules: list[Rule] | None, text: str) -> Work:
    rules = [*base_rules(), *standard_rules()] if rules is None else rules
    return Work(docs, text).judge(ordered(rules, estimate(docs, rules, text))).held("by")


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``rejected_by``, the first rule that rejects the text, null if none does."""
    w, name = _judged(docs, rules, text), "rejected_by"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return w.df.select(*docs.columns, w("by").alias(name))


def keep(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    w = _judged(docs, rules, text)
    return w.df.where(w("by").isNull()).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts of every text, base_failed and kept."""
    rest = standard_rules()
    rest = ordered(rest, estimate(docs, rest))
    asked = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    w = Work(docs.select("doc_id", "text")).add(asked).held("n_repeat_words")
    failed = base_rules()[0].rejects(w) | base_rules()[1].rejects(w)
    w.df = w.df.withColumns({"base_failed": failed, w.p + "by": F.when(failed, "base")})
    w.judge(rest)
    return w.df.select("doc_id", *(w(k).alias(k) for k in asked), "base_failed", w("by").isNull().alias("kept"))
