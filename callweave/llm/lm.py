"""Language-model scoring with a gated recurrent network.

1. ``word_counts``: the count of every word of every training document, summed in two steps (a slice of texts, then a
   shuffle by word); a word that a third of all documents hold is one row for each slice before the shuffle.
2. ``Dictionary``: the words from a count on, of which there are ``DICTIONARY`` at most, go to all executors; the most
   frequent ``SHORTLIST`` are symbols of the network, the others fall into bands by frequency.
3. ``encoded``: every whole document is turned into symbols once, two bytes a token, and written to the shared folder.
4. The network (``recurrent.Gru``) is trained by truncated backpropagation on every token of every training document,
   each document in one of ``ROUNDS`` rounds. Copies, one for each ``COPY`` tokens, train in parallel; after each round
   their weights are averaged slice by slice, so that neither a task nor the driver holds many copies.
5. Scoring: each whole document runs through the network, its state carried to the end. Words beyond the dictionary are
   looked up in the counts by a join on the word, which frequent words never enter.

A token's probability is P(class | state) P(token | class, state) for a shortlisted token, else P(band | state) times
its smoothed share of the band, so that probabilities add up to one over the same open vocabulary as the base model.

In training, a document of more than ``SEGMENT`` tokens is learned in segments, each from a zero state, so that one long
text doesn't leave a task with a single lane. In scoring it is one sequence, however long.

Edge cases: a null or empty text is the end token alone; without a training document all counts are zero, the base
model knows the end of a document only by smoothing, and the score equals it; repeated rows are scored one by one and
count as often as they occur; null or equal ids change nothing, as rows have keys of their own; an empty table gives an
empty result; further columns are not read. A very long text is held whole by one task, at about 20 bytes a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import log, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import crc32_mod, map_arrow, one_thread, slices, written
from callweave.llm.recurrent import Gru

SMOOTH, SHORTLIST, DICTIONARY, BAND_TOP = 0.1, 2048, 500_000, 16_000
#: Tokens of a copy of the network, over all rounds.
ROUNDS, COPY = 2, 6_000_000
#: Tokens that a task gathers before it trains on them, and the longest piece of a document that it learns at once.
GATHERED, SEGMENT = 4_000_000, 4096
#: Slices of the weights, each averaged on its own.
SLICES = 64
END = b""


def tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, the number of each token's word, the first token of each text and the end of the last). The tokens
    of a text are its words, A-Z lower-cased, and the end token, which is the empty word."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = parts.flatten().dictionary_encode()
    vocabulary, ids = words.dictionary.cast(pa.binary()).to_pylist(), words.indices.to_numpy(zero_copy_only=False)
    end = pc.index(words.dictionary, "").as_py()
    cuts = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    if end < 0:
        end = len(vocabulary)
        vocabulary.append(END)
    full = ids != end  # white space at either end of a text leaves an empty word
    cuts = np.concatenate(([0], np.cumsum(full)))[cuts]
    ids = np.insert(ids[full], cuts[1:], end)
    return vocabulary, ids, cuts + np.arange(len(cuts))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all ``docs``; the empty word is the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", 16 << 20):
            vocabulary, ids, _ = tokens(b.column("t"))
            n = np.bincount(ids, minlength=len(vocabulary))
            yield pa.RecordBatch.from_arrays([pa.array(vocabulary, pa.binary()), pa.array(n)], ["word", "n"])

    return map_arrow(docs.select(F.col(text).alias("t")), run, "word binary, n long", "16m").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


class Dictionary:
    """The frequent words with what scoring needs of them; broadcast to all executors.

    Symbols: 0 .. shortlist - 1 are words, then the band of the words up to rank ``BAND_TOP``, the band of all others in
    the dictionary, and the tail: all words beyond it and those that occur once, from which the network learns how often
    a new word comes. The end token is always symbol 0."""

    def __init__(self, rows: list[tuple[bytes, int]], total: int, distinct: int, shortlist: int = SHORTLIST):
        rows = sorted(rows, key=lambda r: (r[0] != END, -r[1], r[0]))
        self.total, self.distinct = total, distinct
        self.index = {bytes(w): i for i, (w, _) in enumerate(rows)}
        n = np.array([k for _, k in rows], np.int64)
        self.shortlist = min(shortlist, len(rows))
        top = min(max(BAND_TOP, self.shortlist), len(rows))
        self.symbol = np.minimum(np.arange(len(rows)), self.shortlist).astype(np.int32)
        self.symbol[top:] = self.shortlist + 1
        self.tail = self.shortlist + 2
        self.symbol[(n <= 1) & (np.arange(len(rows)) >= self.shortlist)] = self.tail
        logs = np.log10(n + SMOOTH)
        self.log_count = logs
        mass = np.bincount(self.symbol, n + SMOOTH, self.shortlist + 3).astype(np.float64)
        mass[self.tail] += max(total - n.sum(), 0) + SMOOTH * (distinct - len(rows) + 1)
        self.mass = mass
        #: What a word adds beside the network: its share of its band; nothing if it's shortlisted.
        self.within = np.where(self.symbol < self.shortlist, 0.0, logs - np.log10(np.maximum(mass, 1e-300))[self.symbol])
        self.log_tail, self.log_all = log10(mass[self.tail]), log10(total + SMOOTH * (distinct + 1))

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))

    def symbols(self, places: np.ndarray) -> np.ndarray:
        return np.where(places < 0, self.tail, self.symbol[places]) if len(self.symbol) else np.full(len(places), self.tail, np.int32)

    def network(self, seed: int = 7) -> Gru:
        return Gru(self.mass / self.mass.sum(), self.shortlist, seed=seed)


def dictionary(counts: DataFrame, limit: int = DICTIONARY) -> tuple[Dictionary, int]:
    """The dictionary, and the count from which on words are in it: the least power of two that leaves ``limit`` at most.
    Only words at or above it come to the driver, and the number of powers."""
    rows = counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    total, distinct, held, least = sum(r.n for r in rows), sum(r.words for r in rows), 0, 1 << 62
    for r in sorted(rows, key=lambda r: -r.p):
        if held + r.words > limit:
            break
        held, least = held + r.words, 1 << int(r.p)
    chosen = counts.where((F.col("n") >= least) | (F.octet_length("word") == 0)).collect()
    return Dictionary([(bytes(w), n) for w, n in chosen], total, distinct), least


def encoded(docs: DataFrame, words: Dictionary, train: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, key (unique), train, n_tokens, known (tokens in the dictionary), base and model (what
    the two scores sum up outside the network), symbols (16 bits each), rare (the words beyond the dictionary with their
    number of times)."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, key = held.value, TaskContext.get().partitionId() << 40
        for b in slices(batches, "t"):
            vocabulary, ids, cuts = tokens(b.column("t"))
            starts, n = cuts[:-1], np.diff(cuts)
            if not len(starts):
                continue
            places = words.places(vocabulary)
            inside = places >= 0
            log_count = np.where(inside, words.log_count[places], 0.0) if len(words.log_count) else np.zeros(len(places))
            within = np.where(inside, words.within[places], -words.log_tail) if len(words.within) else np.full(len(places), -words.log_tail)
            symbols = words.symbols(places).astype(np.uint16)[ids]
            beyond = np.flatnonzero(~inside[ids])
            pair, times = np.unique(np.repeat(np.arange(len(n)), n)[beyond] * len(vocabulary) + ids[beyond], return_counts=True)
            rare = pa.StructArray.from_arrays([pa.array(vocabulary, pa.binary()).take(pa.array(pair % len(vocabulary))), pa.array(times.astype(np.int32))], ["word", "n"])
            ends = np.searchsorted(pair, np.arange(len(n) + 1) * len(vocabulary)).astype(np.int32)
            keys = np.arange(key, key + len(n))
            key += len(n)
            raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((cuts * 2).astype(np.int64)), pa.py_buffer(symbols)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("i"), pa.array(keys), b.column("train"), pa.array(n), pa.array(np.add.reduceat(inside[ids].astype(np.int64), starts)),
                 pa.array(np.add.reduceat(log_count[ids], starts) - words.log_all * n), pa.array(np.add.reduceat(within[ids], starts)),
                 raw, pa.ListArray.from_arrays(pa.array(ends), rare)],
                ["doc_id", "key", "train", "n_tokens", "known", "base", "model", "symbols", "rare"],
            )

    rows = docs.select(F.col(id_column).cast("long").alias("i"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("t"))
    schema = "doc_id long, key long, train boolean, n_tokens long, known long, base double, model double, symbols binary, rare array<struct<word: binary, n: int>>"
    return written(map_arrow(rows, run, schema))


def trained(docs: DataFrame, words: Dictionary) -> np.ndarray | None:
    """The averaged weights after ``ROUNDS`` rounds over all training rows of ``encoded`` documents; None without any."""
    if not words.total or not words.shortlist:
        return None
    one_thread(docs.sparkSession)
    sc, copies, weights = docs.sparkSession.sparkContext, max(1, words.total // COPY), None
    held, rows = sc.broadcast(words), docs.where("train").select("key", "symbols")
    for k in range(ROUNDS):
        at = sc.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], at=at) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            net, seen, pieces, size = held.value.network(), 0, [], 0
            if at.value is not None:
                net.load(at.value)
            for b in batches:
                for raw in b.column("symbols").to_pylist():
                    x = np.frombuffer(raw, np.uint16)
                    pieces.extend(x[i : i + SEGMENT] for i in range(0, len(x), SEGMENT))
                    size += len(x)
                    if size >= GATHERED:
                        seen, pieces, size = seen + net.train(pieces), [], 0
            seen += net.train(pieces)
            if seen:
                parts, copy = np.array_split(net.flat(), SLICES), TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(SLICES), pa.int32()), pa.array([copy] * SLICES, pa.int32()), pa.array([seen] * SLICES), pa.array([p.tobytes() for p in parts], pa.binary())], ["s", "copy", "n", "w"]
                )

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = {}, {}
            for b in batches:
                for s, m, w in zip(*(b.column(c).to_pylist() for c in ("s", "n", "w")), strict=True):
                    w = np.frombuffer(w, np.float32).astype(np.float64) * m
                    total[s] = total[s] + w if s in total else w
                    n[s] = n.get(s, 0) + m
            parts = [(total[s] / n[s]).astype(np.float32).tobytes() for s in total]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(parts, pa.binary())], ["s", "w"])

        # the same rounds, copies and order of sums in every run
        dealt = rows.where(F.pmod(F.xxhash64(F.lit("round"), "key"), F.lit(ROUNDS)) == k).repartition(copies, F.xxhash64("key")).sortWithinPartitions("key").select("symbols")
        slices_of = map_arrow(dealt, run, "s int, copy int, n long, w binary").repartition(min(SLICES, copies), "s").sortWithinPartitions("s", "copy")
        got = sorted(slices_of.mapInArrow(mean, "s int, w binary").collect())
        if got:
            weights = np.concatenate([np.frombuffer(g.w, np.float32) for g in got])
    return weights


def scores(docs: DataFrame, train: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of all whole ``docs``, learned from those that
    ``train`` is true for."""
    spark = docs.sparkSession
    counts = written(word_counts(docs.where(train), text))
    words, least = dictionary(counts)
    each = encoded(docs, words, train, id_column, text)
    weights = trained(each, words)
    held = spark.sparkContext.broadcast((words.network() if weights is not None else None, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, weights = held.value
        if net is not None:
            net.load(weights)
        for b in batches:
            of = [np.frombuffer(x, np.uint16) for x in b.column("symbols").to_pylist()]
            net_score = net.score(of) / log(10) if net else np.zeros(len(of))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "doc_id", "n_tokens", "known", "base")), pa.array(b.column("model").to_numpy() + net_score)], ["key", "doc_id", "n_tokens", "known", "base", "model"])

    # larger batches: long documents share their steps with more others
    whole = map_arrow(each.select("key", "doc_id", "n_tokens", "known", "base", "model", "symbols"), run, "key long, doc_id long, n_tokens long, known long, base double, model double", "8m")
    beyond = each.select("key", F.explode("rare").alias("r")).select("key", "r.word", F.col("r.n").alias("times"))
    found = beyond.join(counts.where((F.col("n") < least) & (F.octet_length("word") > 0)), "word", "left")
    sums = found.groupBy("key").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more")
    )
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    base = F.col("base") + logs
    return whole.join(sums, "key", "left").select(
        "doc_id", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), base.alias("base_score"),
        (base if weights is None else F.col("model") + logs).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: learned on one fold, scored on all."""
    held_out = F.coalesce(crc32_mod("doc_id", 10) == 0, F.lit(False))
    s = scores(docs, ~held_out)
    return s.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
