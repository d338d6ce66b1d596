"""Benchmark decontamination by greedy string tiling.

Texts and test items are lower-cased word sequences. A document and an item that share a seed (``SEED`` words in a row)
are a candidate pair. Its tiles are found by running Karp-Rabin greedy string tiling: windows of unmarked words are
matched by rolling hashes, and the longest marked first, down to the seed length, so that no word lies in two tiles. Tiles may come in any order, which catches reordered passages. The pair is reported if
the tiles cover at least ``threshold`` of the item's words.

Before the tiling, a pair is dropped if all seed windows of the item that occur in the document together cover less
than the threshold: tiles are made of such windows, so nothing is lost.

The items are broadcast in blocks of at most ``BLOCK_BYTES`` of text, and the documents are read once for each block;
no document is shuffled, so a passage that a third of them share costs no more than any other.

Edge cases: a null or empty text matches nothing; an item of fewer than ``SEED`` words matches where it stands whole, one
of fewer than ``SHORTEST`` can't be told from chance and matches nothing; a very long text is held whole by one task, and
its time is in proportion to its length whatever it repeats; repeated rows are judged one by one; with an empty table on either side nothing is reported and
``clean`` keeps all documents; further columns are not read by ``matches`` and pass through ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from callweave.llm.common import map_arrow, slices, small_batches

SEED, THRESHOLD, BLOCK_BYTES = 5, 0.5, 8 << 20
#: An item of fewer words can't be told from chance.
SHORTEST = 3
BASE = np.uint64(0x9E3779B97F4A7C15)
#: A word, or one sign of a script that sets no spaces (Han, kana, Thai, Lao, Khmer, Burmese).
_word = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\W\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")


def words(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of ``size`` ids."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * BASE + (ids[j : j + n] + 1).astype(np.uint64)
    return out


def _hashes(ids: np.ndarray, size: int, scale: int) -> np.ndarray:
    """Hashes of the same windows from prefix sums: the cost doesn't grow with ``size``. Only hashes of one ``scale``,
    which is no smaller than any sequence, can be compared."""
    n = len(ids) - size + 1
    powers = np.ones(scale + 1, np.uint64)
    np.multiply.accumulate(np.full(scale, BASE, np.uint64), out=powers[1:])
    prefix = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate((ids + 1).astype(np.uint64) * powers[: len(ids)])))
    return (prefix[size:] - prefix[:n]) * powers[scale - size - np.arange(n)]


def _windows(free: np.ndarray, size: int) -> np.ndarray:
    """Where ``size`` free places stand in a row."""
    if len(free) < size:
        return np.zeros(0, np.int64)
    taken = np.concatenate(([0], np.cumsum(~free)))
    return np.flatnonzero(taken[size:] == taken[:-size])


def tiles(text: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """[(start in text, start in item, length)]: running Karp-Rabin greedy string tiling, longest matches first, of equal
    ones that which comes first in the item, then in the text.

    The greatest length at which any two free windows have one hash is found by bisection, as a match holds matches of
    every smaller length; all its matches are marked before the search goes on below it. Lengths only fall, and their
    sum is at most the item's length, so the time is in proportion to the text whatever it repeats."""
    free_t, free_i, found = np.ones(len(text), bool), np.ones(len(item), bool), []
    scale = max(len(text), len(item))

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Free windows of the item that free windows of the text share: (starts, first and last place in ``at``, at)."""
        open_t, open_i = _windows(free_t, size), _windows(free_i, size)
        if not len(open_t) or not len(open_i):
            return None
        ht, hi = _hashes(text, size, scale)[open_t], _hashes(item, size, scale)[open_i]
        near = np.isin(ht, hi)
        ht, open_t = ht[near], open_t[near]
        order = np.argsort(ht, kind="stable")
        lo, up = np.searchsorted(ht[order], hi, "left"), np.searchsorted(ht[order], hi, "right")
        hit = up > lo
        return (open_i[hit], lo[hit], up[hit], open_t[order]) if hit.any() else None

    top = min(len(text), len(item))
    while top >= least:
        low, high, got = least, top, common(least)
        if got is None:
            break
        while low < high:
            size = (low + high + 1) // 2
            at = common(size)
            if at is None:
                high = size - 1
            else:
                low, got = size, at
        begun: dict[int, int] = {}  # windows of one hash: how many of the text's are used up
        for b, lo, up in zip(*(x.tolist() for x in got[:3]), strict=True):
            if not free_i[b : b + low].all():
                continue
            k = begun.get(lo, lo)
            while k < up:
                a = int(got[3][k])
                k += 1
                if free_t[a : a + low].all() and (text[a : a + low] == item[b : b + low]).all():
                    free_t[a : a + low] = free_i[b : b + low] = False
                    found.append((a, b, low))
                    break
            begun[lo] = k
        top = low - 1
    return found


class Items:
    """The test items of one block, with the seed windows of all in one sorted table for each length of a seed."""

    def __init__(self, rows: list[tuple[int, str | None]], seed: int = SEED, threshold: float = THRESHOLD):
        self.threshold, self.vocabulary, self.ids, self.items = threshold, {}, [], []
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in rows:
            w = words(text)
            if len(w) < min(SHORTEST, seed):
                continue
            ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64)
            size = min(seed, len(w))  # a shorter item is a seed itself
            by_size.setdefault(size, []).append((_rolled(ids, size), len(self.items)))
            self.ids.append(item_id)
            self.items.append(ids)
        #: (length, sorted hashes, the item and the place of each) of every length of a seed
        self.tables = []
        for size, got in sorted(by_size.items()):
            h = np.concatenate([x for x, _ in got])
            owner, place = np.repeat([k for _, k in got], [len(x) for x, _ in got]), np.concatenate([np.arange(len(x)) for x, _ in got])
            order = np.argsort(h, kind="stable")
            self.tables.append((size, h[order], owner[order], place[order]))

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """[(item_id, coverage, tiles, longest tile)] of the items that the whole text covers."""
        w, get = words(text), self.vocabulary.get
        if not w or not self.items:
            return []
        ids = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
        out = [m for table in self.tables for m in self._matched(ids, *table)]
        return [(self.ids[k], *rest) for k, *rest in sorted(out)]

    def _matched(self, ids: np.ndarray, seed: int, hashes: np.ndarray, owner: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        if len(ids) < seed:
            return
        at = _windows(ids >= 0, seed)
        if not len(at):
            return
        h = _rolled(ids, seed)[at]
        hit = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
        at, h = at[hit], h[hit]
        # each seed once, however often the text repeats it: no more rows than the block has seeds
        once = np.unique(h)
        first = np.searchsorted(hashes, once)
        reps = np.searchsorted(hashes, once, "right") - first
        flat = np.repeat(first - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
        flat = flat[np.argsort(owner[flat], kind="stable")]
        cuts = np.flatnonzero(np.diff(owner[flat])) + 1
        for mine in np.split(flat, cuts) if len(flat) else ():
            k = int(owner[mine[0]])
            item, reach = self.items[k], np.zeros(len(self.items[k]) + 1, np.int64)
            np.add.at(reach, place[mine], 1)
            np.add.at(reach, place[mine] + seed, -1)
            if (np.cumsum(reach[:-1]) > 0).sum() < self.threshold * len(item):
                continue
            held = np.zeros(len(ids) + 1, np.int64)
            where = at[np.isin(h, hashes[mine])]
            held[where] += 1
            held[where + seed] -= 1
            spots = np.flatnonzero(np.cumsum(held[:-1]) > 0)
            cut = np.flatnonzero(np.diff(spots) > 1) + 1
            part = np.insert(ids[spots], cut, -2 - np.arange(len(cut)))  # only what holds seeds; no match crosses a cut
            found = tiles(part, item, seed)
            covered = sum(n for _, _, n in found)
            if covered >= self.threshold * len(item):
                yield k, covered / len(item), len(found), max(n for _, _, n in found)


def blocks(benchmark: DataFrame, seed: int, threshold: float, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of about ``block_bytes`` of text at most, dealt by a hash of the id."""
    rows = benchmark.select("item_id", "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        yield Items(sorted(map(tuple, part), key=lambda r: (r[0] is None, r[0] or 0, r[1])), seed, threshold)


def matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile) of all contaminated documents and their items."""
    out = None
    for items in blocks(benchmark, seed, threshold):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "t", 4 << 20):
                at, rows = [], []
                for i, t in enumerate(b.column("t").to_pylist()):
                    for m in held.value.matches(t):
                        at.append(i)
                        rows.append(m)
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("i").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"],
                )

        got = map_arrow(
            docs.select(F.col(id_column).cast("long").alias("i"), F.col(text).alias("t")), run, "doc_id long, item_id long, coverage double, n_tiles long, longest_tile long"
        )
        out = got if out is None else out.union(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that hold an item; filtered where they are read, without a shuffle, and only the text
    goes to Python."""
    small_batches(docs.sparkSession)
    for items in blocks(benchmark, seed, threshold):
        docs = docs.where(_free_of(docs.sparkSession.sparkContext.broadcast(items))(F.col(text)))
    return docs


def _free_of(held: Broadcast):
    @arrow_udf(T.BooleanType())
    def free(texts: pa.Array) -> pa.Array:
        return pa.array([not held.value.matches(t) for t in texts.to_pylist()], pa.bool_())

    return free
