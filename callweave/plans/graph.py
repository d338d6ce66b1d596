"""Iterative graph kernels over edge tables.

All take and return DataFrames; the driver only sees counts. Every round is cut with a reliable checkpoint, so a lost
executor costs one round at most and plans do not grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.plans.checkpoints import forget, settle


#: Rows of a frontier that are broadcast at most.
FRONTIER = 50_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges``.

    Alternating large-star and small-star rounds: every edge is replaced by one towards the smallest neighbour, so the
    edge table never grows and the number of rounds is logarithmic in the longest path. Nodes that only have an edge
    to themselves form a component of their own; null ends are ignored.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select("u", "v")
    e = settle(
        pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = _print(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, settle(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v")
                           .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        forget(old)
        now = _print(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    named = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.distinct().select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))


def _print(e: DataFrame) -> tuple:
    """Count and two order-free sums of hashes of an edge table: equal for equal tables."""
    h = F.xxhash64("u", "v")
    row = e.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))).first()
    return tuple(row)


def frontier_bfs(
    seeds: DataFrame,
    edges: DataFrame,
    max_depth: int | None = None,
    key: str = "key",
    paths: bool = False,
) -> DataFrame:
    """(key, node, depth, parent): breadth-first search of many sources in one loop.

    seeds: (key, node); edges: (src, dst). The seeds come back at depth 0 with a null parent. ``depth`` is the shortest
    distance within a key, ``parent`` the smallest predecessor at depth - 1. ``max_depth`` is inclusive; None searches
    until nothing is new. ``paths`` adds ``path``, the nodes from the seed to the parent.
    """
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).where("_s <> _d").distinct()
    step = settle(step.repartition("_s"))  # read by every level
    kind = step.schema["_d"].dataType
    seen = settle(
        seeds.select(F.col(key).alias("key"), F.col("node").cast(kind).alias("node")).where("node is not null").distinct()
        .select("key", "node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"), *([F.array().cast(T.ArrayType(kind)).alias("path")] if paths else []))
    )
    best = [F.min("_s").alias("parent"), *([F.min_by(F.concat("path", F.array("_s")), "_s").alias("path")] if paths else [])]
    depth, front, size, pieces = 0, seen, seen.count(), [seen]
    while size and (max_depth is None or depth < max_depth):
        # a frontier that is counted small goes to the edges, which then stay where they are
        near = F.broadcast(front) if size <= FRONTIER else front
        new = (
            near.drop("depth", "parent").join(step, F.col("node") == F.col("_s")).drop("node")
            .groupBy("key", F.col("_d").alias("node"))
            .agg(*best)
            .join(seen.select("key", "node"), ["key", "node"], "left_anti")
            .select("key", "node", F.lit(depth + 1).alias("depth"), "parent", *(["path"] if paths else []))
        )
        front = settle(new)
        size = front.count()
        if not size:
            break
        depth += 1
        seen = seen.union(front)
        pieces.append(front)
        if depth % 10 == 0:
            seen = settle(seen)  # a deep search would else read ever more small pieces
            forget(*pieces[:-1])
            pieces = [front, seen]
    forget(step)
    return seen


def when_any(conditions: list[Column]) -> Column:
    """The OR of ``conditions``; false for none."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out
