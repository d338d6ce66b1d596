"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

1. ``fingerprints``: one 64-bit SimHash per whole text, from XXH64 of its three-word shingles.
2. Equal fingerprints fold into one row before anything is compared, so exact copies cost one row.
3. ``links``: two fingerprints within ``distance`` bits agree on at least one choice of ``blocks - distance`` out of
   ``blocks`` bit blocks. For each choice those blocks move to the front, and fingerprints are sorted by the Gray rank
   of the permuted bits: whoever shares the front stands together. Within such a group a hierarchical index is built
   over the Gray order: an upper node holds the bits that all below it share (mask and pattern), a lower node only
   those that its ancestors don't, and a query drops a whole node once the accumulated differences pass ``distance``.
   The number of blocks follows the number of fingerprints, so that groups stay small; every choice is exact.
4. A group of more than ``GROUP`` fingerprints is keyed anew by blocks of its other bits; what stays as large is dealt out
   as pairs of chunks, each compared in a task of its own.
5. Each task joins what it links and emits one edge per fingerprint to the smallest of its part: never all pairs.
6. ``components`` of these edges, then one join back to the documents.

``near_copies`` finds copies of a given Jaccard similarity (0.8 of five-word shingles), which lie up to 20 bits apart,
where shared bit blocks prune nothing. Its groups are therefore those that share a key of minimum hashes. Within them the
same Gray-order index links what lies within ``REACH`` bits; in each cluster of such links the exact similarity of whole
shingle sets decides, which reads each set once, not once a pair. Equal sets fold into one before all this.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other; a text of one or two words is
one shingle; repeated rows give repeated rows; a null id is never the smallest of a component; an empty table gives an empty result; further columns are not read. A text is held whole by
one task, at about 90 bytes a word. Chunks of a group bound a task's memory; the work in a group that no key splits grows
with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import map_arrow, settle, slices, utf8
from callweave.plans.checkpoints import broadcast_if_small
from callweave.plans.graph import connected_components

SEED, BITS, WORDS, DISTANCE = 42, 64, 3, 3
#: Near copies: words of a shingle, least similarity, and the bits in which fingerprints of such a pair differ at most: at
#: 0.8 about 10 of 64, more than REACH with a chance below 1 in 10,000.
COPY_WORDS, SIMILAR, REACH = 5, 0.8, 22
#: Keys of near copies: a pair of similarity 0.8 shares none of BANDS keys of ROWS minimum hashes with a chance of
#: (1 - 0.8^4)^18, below 1 in 10,000; a more similar one more rarely.
BANDS, ROWS = 18, 4
_MIX = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
_MIX[0] |= np.uint64(1)
#: Bytes of shingle sets that a task of the last check holds of one cluster, from each side.
HELD_BYTES = 32 << 20
#: Fingerprints of one group that a task compares at most; larger groups are dealt out in chunks of this size.
GROUP = 4096
#: Runs of up to this many fingerprints are compared directly: the leaves of the index.
LEAF = 16


def shingle_hashes(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of the shingles of one UTF-8 text in their order, A-Z lower-cased; a text of fewer words is one shingle."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, ">u8")
    flat = b" ".join(w)
    if len(w) < words:
        digests = [xxhash.xxh64_digest(flat, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - words + 1].tolist()
        h = xxhash.xxh64_digest
        digests = [h(flat[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), ">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set, as an unsigned integer."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    n, ones = len(bits), np.zeros(BITS, np.int64)
    for at in range(0, n, 255):  # sums of 255 rows fit a byte, which numpy adds fastest
        ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def simhash(text: bytes | None, words: int = WORDS) -> int:
    return fingerprint(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            got = np.array([simhash(t) for t in utf8(b.column("t"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(got)], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_column).alias("i"), F.col(text).alias("t")), run, "doc_id long, fp long")


def _blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` blocks that make up 64 bits."""
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [(BITS - b, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def choices(count: int, distance: int = DISTANCE, group: int = GROUP) -> list[tuple[list[tuple[int, int]], int]]:
    """The permutations of the bits that ``count`` fingerprints call for: (blocks in order, bits of the key).

    More blocks give longer keys and more permutations; the fewest are taken that leave groups of random fingerprints
    well below ``group``."""
    for n in range(distance + 1, distance + 5):
        blocks = _blocks(n)
        chosen = list(combinations(range(n), n - distance))
        width = min(sum(blocks[i][1] for i in c) for c in chosen)
        if count / 2**width <= group / 64:
            break
    out = []
    for c in chosen:
        order = [blocks[i] for i in c] + [blocks[i] for i in range(n) if i not in c]
        out.append((order, sum(blocks[i][1] for i in c)))
    return out


def _permuted(fp: Column, order: list[tuple[int, int]]) -> Column:
    out = None
    for shift, width in order:
        part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        out = part if out is None else F.shiftleft(out, width).bitwiseOR(part)
    return out


def gray_rank(code: Column) -> Column:
    """The place of a 64-bit code in Gray order, as an unsigned number in a long: the XOR of all its right shifts."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code


class GrayIndex:
    """The hierarchical index over the codes of one group, which come in Gray order.

    Level 0 are the codes; a node of level k + 1 spans ``FAN`` nodes of level k. ``mask`` has the bits that all codes
    below share and that no ancestor holds, ``bits`` their pattern."""

    FAN = 8

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        low, high = codes.copy(), codes.copy()  # AND and OR of what is below
        spans = [(low, high)]
        while len(spans[-1][0]) > self.FAN:
            cut = np.arange(0, len(spans[-1][0]), self.FAN)
            spans.append((np.bitwise_and.reduceat(spans[-1][0], cut), np.bitwise_or.reduceat(spans[-1][1], cut)))
        self.levels, above = [], None
        for low, high in reversed(spans):
            shared = ~(low ^ high)
            own = shared if above is None else shared & ~np.repeat(above, self.FAN)[: len(shared)]
            self.levels.append((own, low & own))
            above = shared

    def pairs(self, queries: np.ndarray, distance: int, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query number, code number) of all codes within ``distance``; only codes beyond ``after`` if that is given."""
        n = len(self.levels[0][0])
        q, node = np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
        spent = np.zeros(len(q), np.int64)
        for depth, (mask, bits) in enumerate(self.levels):
            size = self.FAN ** (len(self.levels) - 1 - depth)
            spent = spent + np.bitwise_count((queries[q] & mask[node]) ^ bits[node])
            live = spent <= distance
            if after is not None:
                live &= (node + 1) * size - 1 > after[q]
            q, node, spent = q[live], node[live], spent[live]
            if depth + 1 < len(self.levels):
                below = len(self.levels[depth + 1][0])
                q, spent = np.repeat(q, self.FAN), np.repeat(spent, self.FAN)
                node = (node[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                inside = node < below
                q, node, spent = q[inside], node[inside], spent[inside]
        return q, node


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the parts of a[i] and b[i] in ``labels`` (each the number of a member, roots name themselves)."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def linked(codes: np.ndarray, group: np.ndarray, side: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each code the number of the first member of its part. Rows are sorted by group and then by Gray rank; within
    a group, codes of one side are compared to each other if there's one side only, else codes of side 0 to side 1."""
    n = len(codes)
    labels = np.arange(n)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    small = np.repeat(sizes <= LEAF, sizes)
    for d in range(1, LEAF):  # all leaf groups at once
        if d >= n:
            break
        a = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
        if not len(a):
            break
        ok = np.bitwise_count(codes[a] ^ codes[a + d]) <= distance
        _joined(labels, a[ok], a[ok] + d)
    for at, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
        here, two = np.arange(at, at + size), side[at : at + size]
        crossed = two.any() and not two.all()
        rows = here[two == 1] if crossed else here
        asks = here[two == 0] if crossed else here
        index = GrayIndex(codes[rows])
        for k in range(0, len(asks), 256):
            part = asks[k : k + 256]
            after = None if crossed else np.arange(k, k + len(part))
            q, found = index.pairs(codes[part], distance, after)
            _joined(labels, part[q], rows[found])
    return labels


def blocked(fps: DataFrame, count: int, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(node, t, k, c): every fingerprint ``fps`` (fp) under the keys that it shares with all within ``distance``. What
    shares a key with more than ``group`` others is keyed once more, by blocks of the bits that the key leaves."""
    tables = choices(count, distance, group)
    code = F.array(*(F.struct(F.lit(i).alias("t"), _permuted(F.col("fp"), order).alias("c")) for i, (order, _) in enumerate(tables)))
    front = F.array(*(F.lit(w) for _, w in tables))[F.col("t")] if len({w for _, w in tables}) > 1 else F.lit(tables[0][1])
    rows = fps.select(F.col("fp").alias("node"), F.inline(code)).withColumn("k", F.call_function("shiftrightunsigned", F.col("c"), F.lit(64) - front))
    hot = settle(rows.groupBy("t", "k").count().where(F.col("count") > group).select("t", "k", F.lit(True).alias("hot")))
    if hot.isEmpty():
        return rows
    width = F.ceil((F.lit(64) - front) / (distance + 1)).cast("int")
    block = F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.col("c"), front + F.col("j") * width), F.lit(64) - width)
    return (
        rows.join(broadcast_if_small(hot), ["t", "k"], "left").withColumn("j", F.explode(F.when(F.col("hot"), F.array(*map(F.lit, range(distance + 1)))).otherwise(F.array(F.lit(-1)))))
        .select("node", F.when(F.col("hot"), len(tables) + F.col("t") * (distance + 1) + F.col("j")).otherwise(F.col("t")).alias("t"), F.when(F.col("hot"), F.xxhash64("k", block)).otherwise(F.col("k")).alias("k"), "c")
    )


def _dealt(rows: DataFrame, keys: list[str], member: str, parts: DataFrame | None) -> DataFrame:
    """``rows`` with lo, hi and side: a group that ``parts`` (keys, p) names is dealt out as all pairs of p chunks, each a
    group of its own in which side 0 meets side 1 (one chunk: all meet all)."""
    if parts is None:
        return rows.withColumns({"lo": F.lit(0), "hi": F.lit(0), "side": F.lit(0).cast("tinyint")})
    p, x, y = F.coalesce("p", F.lit(1)), F.col("x"), F.col("y")
    return (
        rows.join(broadcast_if_small(parts), keys, "left").withColumn("x", F.pmod(F.xxhash64(member), p).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), p - 1)))
        .withColumns({"lo": F.least(x, y), "hi": F.greatest(x, y), "side": F.when(x > y, 1).otherwise(0).cast("tinyint")}).drop("x", "y", "p")
    )


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[pa.Table]:
    """The sorted rows in tables of whole groups (rows that are equal in the first ``keys`` columns) of at least ``least``
    rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        differs = np.logical_or.reduce([c != c[-1] for c in cols])
        cut = b.num_rows - int(np.argmax(differs[::-1])) if differs.any() else 0
        if cut and sum(x.num_rows for x in held) >= least:
            yield pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _runs(table: pa.Table, keys: int) -> np.ndarray:
    """The number of each row's group."""
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in (table.column(i).to_numpy() for i in range(keys))])
    return np.concatenate(([0], np.cumsum(new)))


def links(rows: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(src, dst): edges that join exactly those nodes of ``rows`` (node, t, k, c and, if it isn't the node, code) that
    share a key (t, k) and whose codes lie within ``distance`` bits."""
    many = settle(rows.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > group).select("t", "k", F.ceil(F.col("n") / group).cast("int").alias("p")))
    dealt = _dealt(rows, ["t", "k"], "node", None if many.isEmpty() else many)
    sign = F.lit(-(1 << 63)).cast("long")
    ready = (
        dealt.withColumn("g", F.xxhash64("t", "k", "lo", "hi"))
        .repartition("g").sortWithinPartitions("g", "t", "k", "lo", "hi", gray_rank(F.col("c")).bitwiseXOR(sign))
        .select("t", "k", "lo", "hi", "side", "node", *(["code"] if "code" in rows.columns else []))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 4, 65536):
            node, code = table.column("node").to_numpy(), table.column(table.num_columns - 1).to_numpy()
            labels = linked(code.view(np.uint64), _runs(table, 4), table.column("side").to_numpy(), distance)
            at = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[labels[at]])], ["src", "dst"])

    return map_arrow(ready, run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id that links of at most ``distance`` bits reach."""
    each = settle(fingerprints(docs, id_column, text))
    distinct = settle(each.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = settle(links(blocked(distinct.select("fp"), distinct.count(), distance, group), distance, group))
    return each.join(_named(distinct, "fp", edges), "fp").select("doc_id", "fp", "component_id")


def _named(distinct: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """(node, component_id) of ``distinct`` (node, low): the smallest ``low`` of those that ``edges`` connect."""
    comp = settle(connected_components(edges))
    # settled, so that the join below has exchanges of its own on both sides, which a large component can be split in
    named = settle(distinct.select(node, "low").join(comp.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node)))
    low = settle(named.groupBy("component").agg(F.min("low").alias("component_id")))
    return settle(named.join(low, "component").select(node, "component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    n = near_duplicates(docs)
    return n.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def marks(s: np.ndarray) -> np.ndarray:
    """One key for each band of minimum hashes of a set of shingles; none of the empty set."""
    if not len(s):
        return np.zeros(0, np.uint64)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 1024):
        x = s[at : at + 1024, None] * _MIX[0] + _MIX[1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(low, x.min(axis=0), out=low)
    return np.array([xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)], np.uint64)


def alike(sets: list[np.ndarray], codes: np.ndarray, side: np.ndarray, similar: float, reach: int) -> np.ndarray:
    """For each of the sorted ``sets`` the number of the first member of its part: sets are joined if their Jaccard
    similarity is ``similar`` or more and their codes differ in at most ``reach`` bits. What is joined already isn't
    compared again; with two sides, only sets of side 0 are compared to those of side 1."""
    n, size = len(sets), np.array([len(s) for s in sets])
    labels, flat, starts = np.arange(n), np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum(size)))
    crossed = bool(side.any()) and not side.all()
    for i in range(n):
        if crossed and side[i]:
            continue
        near = (labels != labels[i]) & (np.bitwise_count(codes ^ codes[i]) <= reach) & (np.minimum(size, size[i]) >= similar * np.maximum(size, size[i]))
        if crossed:
            near &= side == 1
        else:
            near[: i + 1] = False
        at = np.flatnonzero(near)
        while len(at):
            part, at = at[:256], at[256:]
            cuts = np.concatenate(([0], np.cumsum(size[part])))
            theirs = flat[np.repeat(starts[part] - cuts[:-1], size[part]) + np.arange(cuts[-1])]
            place = np.minimum(np.searchsorted(sets[i], theirs), size[i] - 1)
            both = np.add.reduceat((sets[i][place] == theirs).astype(np.int64), cuts[:-1])
            for j in part[both >= similar * (size[i] + size[part] - both)].tolist():
                x, y = sorted((labels[i], labels[j]))
                if x != y:
                    labels[labels == y] = x
            at = at[labels[at] != labels[i]]
    return labels


def near_copies(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = COPY_WORDS, similar: float = SIMILAR, reach: int = REACH, group: int = GROUP, held_bytes: int = HELD_BYTES
) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest id that links of the given similarity reach."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            rows, keys = [], []
            for t in utf8(b.column("t")):
                h = shingle_hashes(t, words)
                s = np.unique(h).astype(np.uint64)
                rows.append((xxhash.xxh64_intdigest(s.tobytes(), SEED), fingerprint(h), len(s)))
                keys.append(marks(s))
            cols = np.array(rows, np.uint64).reshape(-1, 3).view(np.int64).T
            at = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("h"), *map(pa.array, cols), lists], ["doc_id", "h", "whole", "fp", "n", "marks"])

    source = docs.select(F.col(id_column).cast("long").alias("i"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    each = settle(map_arrow(source, sign, "doc_id long, h long, whole long, fp long, n long, marks array<long>"))
    distinct = settle(each.groupBy("whole", "fp", "n", "marks").agg(F.min("doc_id").alias("low"), F.min("h").alias("h")))
    rows = distinct.select(F.col("whole").alias("node"), F.col("fp").alias("code"), F.lit(0).alias("t"), F.explode("marks").alias("k"), F.col("fp").alias("c"))
    clusters = settle(connected_components(settle(links(rows, reach, group))))
    members = settle(distinct.drop("marks", "fp").join(clusters.withColumnRenamed("node", "whole").withColumnRenamed("component", "cluster"), "whole"))
    many = (
        members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") * 2 / group), F.ceil(F.sum("n") * 8 / held_bytes)).cast("int").alias("p")).where("p > 1")
    )
    many = settle(many)
    # the texts of the members, one row for each: of the smallest id, or by its hash where all copies lack one
    asked = members.select(F.col("low").isNull().alias("none"), F.coalesce("low", "h").alias("of"), "whole", "cluster").distinct()
    found = source.withColumns({"none": F.col("i").isNull(), "of": F.coalesce("i", "h")}).join(broadcast_if_small(asked, 200_000), ["none", "of"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            at, out, codes = [], [], []
            for i, (t, whole) in enumerate(zip(utf8(b.column("t")), b.column("whole").to_numpy().view(np.uint64).tolist(), strict=True)):
                h = shingle_hashes(t, words)
                s = np.unique(h).astype(np.uint64)
                if xxhash.xxh64_intdigest(s.tobytes(), SEED) == whole:  # else another row of a repeated id
                    at.append(i)
                    out.append(s.tobytes())
                    codes.append(fingerprint(h))
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("cluster").take(took), b.column("whole").take(took), pa.array(np.array(codes, np.uint64).view(np.int64)), pa.array(out, pa.binary())], ["cluster", "whole", "code", "s"])

    one = map_arrow(found.select("cluster", "whole", "t"), sets, "cluster long, whole long, code long, s binary").dropDuplicates(["whole"])
    dealt = _dealt(one, ["cluster"], "whole", None if many.isEmpty() else many)
    ready = dealt.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "side", "whole").select("cluster", "lo", "hi", "side", "whole", "code", "s")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 3, 256):
            group_of, whole = _runs(table, 3), table.column("whole").to_numpy()
            code, side, held = table.column("code").to_numpy().view(np.uint64), table.column("side").to_numpy(), table.column("s")
            for rows in np.split(np.arange(len(whole)), np.flatnonzero(np.diff(group_of)) + 1):
                s = [np.frombuffer(x, np.uint64) for x in held.slice(rows[0], len(rows)).to_pylist()]
                labels = alike(s, code[rows], side[rows], similar, reach)
                at = np.flatnonzero(labels != np.arange(len(labels)))
                yield pa.RecordBatch.from_arrays([pa.array(whole[rows[at]]), pa.array(whole[rows[labels[at]]])], ["src", "dst"])

    edges = settle(map_arrow(ready, verify, "src long, dst long"))
    return each.select("doc_id", "whole").join(_named(distinct, "whole", edges), "whole").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = COPY_WORDS, similar: float = SIMILAR) -> DataFrame:
    """The documents with the smallest id of their group of near copies, all rows of it, and those without an id, which
    can't be told apart."""
    of = near_copies(docs, id_column, text, words, similar)
    gone = settle(of.where("doc_id is not null").groupBy(F.col("doc_id").alias("_gone")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first")).where("not first").select("_gone"))
    return docs.join(broadcast_if_small(gone, 500_000), F.col(id_column) == gone["_gone"], "left_anti")
