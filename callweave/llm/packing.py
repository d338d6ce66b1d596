"""Packing of token sequences by minimum bin slack.

1. Each document is tokenized once and cut into full windows and a rest. A window that is full needs no company.
2. The lengths of all pieces form a histogram of at most ``capacity`` entries, whatever the size of the corpus.
3. ``plan`` fills windows from the histogram: the longest piece left seeds a window; a subset-sum dynamic program over
   a bitset picks the multiset of remaining lengths that comes closest to what is free, with the counts backtracked;
   the same filling is repeated as long as the counts allow, so that the plan is short too.
4. Pieces of equal length are interchangeable: each gets a rank among its length, in two levels so that no task holds
   all pieces of one length, and takes the slot of that rank.

Edge cases: a null or empty text is the end token alone; repeated rows are packed like any others; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from math import isqrt
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import map_arrow, settle, slices, utf8

CAPACITY, END = 4096, 2
#: Words whose ids a worker remembers: of each of two generations; longer words are never kept.
CACHE_WORDS, CACHE_BYTES = 200_000, 64


#: The printable form of each byte in a byte-level vocabulary.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_FORM = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class WordTokenizer:
    """Ids of whole texts from a tokenizer that never joins characters over ASCII white space and folds case.

    Texts are split at ASCII white space and the ids of words are remembered, A-Z lower-cased. What a tokenizer does to a
    word must not depend on other words, which holds for the "word" vocabulary; tests compare whole encodings. A word of
    lower-case letters goes straight to the tokenizer's model; a comma or full stop after one is a token run of its own."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer

        self.tok, self.young, self.old, self.cache_words = Tokenizer.from_file(path), {}, {}, cache_words
        self.model, self.special = self.tok.model, [t.content.encode().lower() for t in self.tok.get_added_tokens_decoder().values()]

    def _ids(self, w: bytes) -> bytes:
        """The ids of one word that isn't remembered."""
        if w[-1:] in (b",", b".") and w[-2:-1].isalnum():
            return self._get(w[:-1]) + self._get(w[-1:])
        s = w.decode("utf-8", "replace")
        if s.isalpha() and s == s.lower() and (s.isascii() or is_normalized("NFC", s)):
            form = s if s.isascii() else w.decode("latin-1").translate(_BYTE_FORM)
            return array("I", [t.id for t in self.model.tokenize(form)]).tobytes()
        return array("I", self.tok.encode(s, add_special_tokens=False).ids).tobytes()

    def _get(self, w: bytes) -> bytes:
        ids = self.young.get(w)
        if ids is None:
            ids = self.old.get(w)
            if ids is None:
                ids = self._ids(w)
            if len(w) <= CACHE_BYTES:
                self.young[w] = ids
        return ids

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        for text in texts:
            text = text or b""
            low = text.lower()
            # a special token is found in its own case only, so a text that may hold one keeps its case
            words = (text if any(t in low for t in self.special) else low).split()
            found = list(map(self.young.get, words))
            if None in found:
                found = [self._get(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]
            yield b"".join(found)
            if len(self.young) > self.cache_words:
                self.young, self.old = {}, self.young


_workers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the windows of each document, cut at multiples of ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, stop = tokenizer(path), np.array([end], "<u4").tobytes()
        for b in slices(batches, "t", 4 << 20):
            row, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(tok.encode(utf8(b.column("t")))):
                ids += stop
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    row.append(i)
                    start.append(at)
                    length.append(min(capacity, n - at))
                    crc.append(zlib.crc32(ids[at * 4 : (at + capacity) * 4]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("i").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return map_arrow(
        docs.select(F.col(id_column).cast("long").alias("i"), F.col(text).alias("t")), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def fill(counts: dict[int, int], lengths: list[int], free: int) -> dict[int, int]:
    """The multiset of ``lengths`` (descending, with ``counts`` left) whose sum comes closest to ``free`` from below."""
    mask, bits = (1 << (free + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # (bitset before, length, copies)
    for n in lengths:
        if n > free:
            continue
        left, copies = min(counts[n], free // n), 1
        while left:
            take = min(copies, left)
            steps.append((bits, n, take))
            bits |= bits << (n * take) & mask
            left, copies = left - take, copies * 2
        if bits >> free & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for before, n, take in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + take
            at -= n * take
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(repetitions, [(length, copies), ...])]: windows that hold every piece of the histogram exactly once."""
    counts = {n: k for n, k in histogram.items() if k > 0}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        used = fill(counts, lengths, capacity - seed)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        out.append((times, sorted(used.items(), reverse=True)))
        for n, k in used.items():
            counts[n] -= k * times
        if any(not counts[n] for n in used):
            lengths = [n for n in lengths if counts[n]]
    return out


class Slots:
    """The plan as sorted arrays: which window and offset the r-th piece of a length takes."""

    RANKS = 1 << 48

    def __init__(self, windows: list[tuple[int, list[tuple[int, int]]]]):
        taken: dict[int, int] = {}
        rows, base = [], 0
        for times, used in windows:
            offset = 0
            for n, k in used:
                rows.append((n * self.RANKS + taken.get(n, 0), k, base, offset))
                taken[n] = taken.get(n, 0) + times * k
                offset += n * k
            base += times
        rows.sort()
        self.keys, self.copies, self.base, self.offset = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        self.windows = base

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length * self.RANKS + rank
        at = np.searchsorted(self.keys, key, "right") - 1
        j = key - self.keys[at]
        return self.base[at] + j // self.copies[at], self.offset[at] + j % self.copies[at] * length


def ranks(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``rows`` with ``rank``, from 0 among rows of equal ``length``: about the square root of their number stand in
    one bucket, so neither a bucket nor the table of a length's buckets grows with the corpus as a whole."""
    spark = rows.sparkSession
    many = [(n, isqrt(k) + 1) for n, k in histogram.items() if k > 512]  # at most one entry per length
    buckets = F.broadcast(spark.createDataFrame(many or [(-1, 1)], "length long, buckets int"))
    order = "doc_id, start, ids_crc32"
    dealt = rows.join(buckets, "length", "left").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.coalesce("buckets", F.lit(1))))
    dealt = dealt.withColumn("own", F.expr(f"row_number() over (partition by length, bucket order by {order}) - 1"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    first = sizes.withColumn("first", F.expr("sum(n) over (partition by length order by bucket) - n")).select("length", "bucket", "first")
    return dealt.join(first, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("first")).select(*rows.columns, "rank")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece."""
    cut = settle(pieces(docs, path, capacity, end, id_column, text))
    histogram = dict(map(tuple, cut.groupBy("length").count().collect()))  # at most ``capacity`` rows
    held = docs.sparkSession.sparkContext.broadcast(Slots(plan(histogram, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = held.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    return map_arrow(
        ranks(cut, histogram), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns."""
    return pack(docs, path or default_path())
