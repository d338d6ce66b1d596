"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle).

A profile lists the most frequent letter n-grams (n = 1 to 3) of a language in order of frequency. A document's own
most frequent n-grams are compared to it by the out-of-place distance: the sum of the differences in rank, with the
length of the profile for an n-gram that it lacks. The nearest profile names the language.

Letters are lower-cased; a run of anything else is one word boundary, which n-grams may hold at either end. Equal
counts are ordered by code point, equal distances by the language's name, so results don't depend on partitioning.

Profiles are fitted on a bounded sample: about ``SAMPLE_DOCS`` labelled documents of each language, chosen by a hash
of the id. Every document is predicted from its whole text.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing can be learned;
repeated rows are judged one by one; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from callweave.llm.common import crc32_mod, map_arrow, slices, small_batches

UND = "und"
#: Labelled documents of each language in the sample (its expected size), n-grams in a profile, languages at most.
SAMPLE_DOCS, PROFILE, MAX_LANGUAGES = 2000, 400, 1000
BOUNDARY = 1
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point whether it's a letter; made once in a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of a whole text; a code holds up to three code points of 21 bits."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ok = _letter_table()[cp]
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.where(ok, cp, BOUNDARY)
    keep = np.ones(len(cp), bool)
    keep[1:] = ok[1:] | ok[:-1]  # one boundary for a run
    cp = np.concatenate(([BOUNDARY], cp[keep], [BOUNDARY]))
    if cp[1] == BOUNDARY:
        cp = cp[1:]
    if cp[-2] == BOUNDARY:
        cp = cp[:-1]
    two = cp[:-1] << 21 | cp[1:]
    three = two[:-1] << 21 | cp[2:]
    return np.unique(np.concatenate((cp[cp != BOUNDARY], two, three)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The codes of the ``size`` highest counts, in order; smaller codes first where counts are equal."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")][:size]


class Profiles:
    """The ranked n-grams of each language, ready for distances."""

    def __init__(self, by_lang: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(by_lang), size
        self.codes = np.unique(np.concatenate([np.array(v, np.int64) for v in by_lang.values()] or [np.zeros(0, np.int64)]))
        #: rank of each code in each language, ``size`` if absent; the last row is for unknown codes.
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, by_lang[lang]), k] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is 1 less the distance's share of the largest possible one."""
        own = ranked(*ngrams(text), self.size)
        if not len(own) or not self.langs:
            return UND, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), max(0, len(self.codes) - 1))
        ranks = self.ranks[np.where(self.codes[at] == own, at, len(self.codes))]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (len(own) * self.size))


def fit(labelled: DataFrame, id_column: str = "doc_id", sample_docs: int = SAMPLE_DOCS, size: int = PROFILE) -> Profiles:
    """Profiles from (id, text, lang) rows whose lang isn't null, on about ``sample_docs`` rows of each language."""
    named = labelled.where("lang is not null and text is not null")
    counts = named.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Profiles({}, size)
    part: Column | None = None
    for lang, n in counts:
        share = F.lit(min(1 << 20, int(sample_docs / n * (1 << 20)) + 1))
        part = F.when(F.col("lang") == lang, share) if part is None else part.when(F.col("lang") == lang, share)
    sample = named.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 20)) < part).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            parts: dict[str, list] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                parts.setdefault(lang, []).append(ngrams(text))
            for lang, found in parts.items():
                codes, inverse = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([k for _, k in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    grams = map_arrow(sample, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rows = (
        grams.withColumn("r", F.expr("row_number() over (partition by lang order by n desc, code)")).where(F.col("r") <= size)
        .select("lang", "code", "r").collect()
    )
    by_lang: dict[str, list] = {}
    for lang, code, _ in sorted(rows, key=lambda r: (r[0], r[2])):
        by_lang.setdefault(lang, []).append(code)
    return Profiles(by_lang, size)


def identify(docs: DataFrame, profiles: Profiles, id_column: str = "doc_id", text: str = "text", extra: tuple[Column, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, and the ``extra`` columns) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    chosen = docs.select(F.col(id_column), *extra, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for b in slices(batches, "_text"):
            got = [p.predict(t) for t in b.column("_text").to_pylist()]
            names = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_arrow(chosen, run, f"{schema}, lang_pred string, score double")


def keep(docs: DataFrame, profiles: Profiles, min_score: float = 0.0, text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that are ``und`` or score less than ``min_score``; filtered where they
    are read, without a shuffle, and only the text goes to Python."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    small_batches(docs.sparkSession)

    @arrow_udf(T.BooleanType())
    def known(texts: pa.Array) -> pa.Array:
        got = (held.value.predict(t) for t in texts.to_pylist())
        return pa.array([lang != UND and score >= min_score for lang, score in got], pa.bool_())

    return docs.where(known(F.col(text)))


def train_fold(docs: DataFrame) -> DataFrame:
    return docs.where(crc32_mod("doc_id", 4) != 2)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: learned on one fold, predicted on all."""
    held_out = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return identify(docs, fit(train_fold(docs)), extra=(held_out,)).select("doc_id", "held_out", "lang_pred", "score")
