"""Symbol search: an inverted index with positions, substring and edit-distance fallbacks, one re-ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.text import escaped, jaro_winkler, tokens
from callweave.plans.checkpoints import settle

FIELDS, K1, B, MAX_BYTES = ("name", "qualified_name", "signature"), 1.2, 0.75, 500


@dataclass(frozen=True)
class Index:
    """postings (id, field, pos, token) of names, qualified names and signatures; lengths (id, n), n tokens of a symbol;
    totals, one row (mean, docs)."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame


def index_of(symbols: DataFrame, settled: bool = False) -> Index:
    """The inverted index; ``settled`` computes it once for many questions."""
    words = F.array(*(tokens(F.coalesce(f, F.lit(""))) for f in FIELDS))
    rows = symbols.select("id", F.posexplode(words).alias("field", "w")).select("id", "field", F.posexplode("w").alias("pos", "token"))
    lengths = symbols.select("id", F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.size(w)).alias("n")).where("n > 0")
    if settled:
        rows, lengths = settle(rows), settle(lengths)
    totals = lengths.agg(F.avg("n").alias("mean")).crossJoin(symbols.agg(F.count("*").alias("docs")))
    return Index(rows, lengths, settle(totals) if settled else totals)


def query_tokens(query: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", query.lower())


def phrase_hits(index: DataFrame, words: list[str]) -> DataFrame:
    """(id, field, pos): where the words stand in a row, the last as a prefix. Each word joins on id, field and place."""
    out = None
    for k, w in enumerate(words):
        last = k == len(words) - 1
        rows = index.where(F.col("token").startswith(w) if last else F.col("token") == w).select("id", "field", (F.col("pos") - k).alias("pos"))
        out = rows if out is None else out.join(rows, ["id", "field", "pos"], "left_semi")
    return out


def fts_search(symbols: DataFrame, query: str, limit: int = 20, index: Index | None = None) -> DataFrame:
    """(id, score): symbols with the phrase, by bm25 over all three fields as one document; ties by id."""
    words = query_tokens(query)
    if not words or len(query.encode()) > MAX_BYTES:
        return symbols.select("id", F.lit(0.0).alias("score")).where("false")
    index = index or index_of(symbols)
    tf = phrase_hits(index.postings, words).groupBy("id").agg(F.count("*").alias("tf"))
    totals = index.totals.crossJoin(tf.agg(F.count("*").alias("df")))  # one row
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return tf.join(index.lengths, "id").crossJoin(F.broadcast(totals)).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def like_search(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, name, score 1): names that contain the query in any case, by name and id."""
    return symbols.where(F.col("name").ilike(f"%{escaped(query)}%")).select("id", "name", F.lit(1.0).alias("score")).orderBy("name", "id").limit(limit)


def fuzzy_search(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, name, score): by edit distance over the longer byte length, among the first 10 * limit (5000 at most, by id)
    names that share the query's first two characters."""
    start = query[:2]
    pool = symbols.where(F.col("name").ilike(escaped(start) + "%")) if len(start) >= 2 else symbols
    pool = pool.select("id", "name").orderBy("id").limit(min(limit * 10, 5000))
    longest = F.greatest(F.octet_length("name"), F.lit(len(query.encode())))
    score = F.when(longest > 0, 1 - F.levenshtein(F.lit(query), "name") / longest).otherwise(0.0)
    return pool.select("id", "name", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def search(symbols: DataFrame, query: str, limit: int = 50, fuzzy: bool = True, index: Index | None = None) -> DataFrame:
    """(id, name, score): full text, else substrings; filled up by edit distance and ranked by Jaro-Winkler if fuzzy.
    A symbol stands once, where it was found first; equal scores keep the order of finding."""
    named = symbols.select("id", "name")
    fts = fts_search(symbols, query, limit, index).join(named, "id").select("id", "name", "score", F.lit(1).alias("source"))
    like = like_search(symbols, query, limit).select("id", "name", "score", F.lit(2).alias("source"))
    best = fts.union(like)
    first = best.agg(F.coalesce(F.min("source"), F.lit(0)).alias("first"), F.count_if(F.col("source") == 1).alias("n1"), F.count_if(F.col("source") == 2).alias("n2"))  # one row
    kept = best.crossJoin(F.broadcast(first)).where("source = first").select("id", "name", "score", "source")
    if fuzzy:
        found = fuzzy_search(symbols, query, limit).withColumn("source", F.lit(3)).withColumn("place", F.expr("row_number() over (order by score desc, id)"))  # limit rows
        room = F.greatest(F.lit(limit) - F.when(F.col("first") == 1, F.col("n1")).when(F.col("first") == 2, F.col("n2")).otherwise(0), F.lit(0))
        kept = kept.union(found.crossJoin(F.broadcast(first)).where(F.col("place") <= room).select("id", "name", "score", "source"))
    once = kept.groupBy("id", "name").agg(F.min(F.struct("source", (-F.col("score")).alias("s"))).alias("m"))
    score = F.round(jaro_winkler(F.col("name"), F.lit(query)), 6) if fuzzy else -F.col("m.s")
    return once.withColumn("score", score).orderBy(F.desc("score"), "m.source", "m.s", "id").limit(limit).select("id", "name", "score")
