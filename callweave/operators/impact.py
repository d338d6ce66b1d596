"""Who depends on whom: traversals, impact, tests, cycles, paths and plans.

Every traversal runs on the one frontier kernel, keyed by its source, so many sources take one loop. Depth is the
shortest distance. Nodes of the call graph are the ends of resolved calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.plans.checkpoints import forget, settle
from callweave.plans.graph import connected_components, frontier_bfs


def call_edges(calls: DataFrame) -> DataFrame:
    """(src, dst): distinct resolved calls."""
    return calls.where("callee_symbol_id is not null").select(F.col("caller_symbol_id").alias("src"), F.col("callee_symbol_id").alias("dst")).distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def graph_nodes(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    e = call_edges(calls)
    ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return symbols.join(ends, "id", "left_semi").join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id").select("id", "name", "qualified_name", "kind", "file_path", "line_start")


def dependents(calls: DataFrame, imports: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id): distinct callers, and the ``<module>`` symbols of files that import the target. targets: (target)."""
    direct = calls.join(targets, F.col("callee_symbol_id") == F.col("target")).select("target", F.col("caller_symbol_id").alias("id"))
    modules = symbols.where("name = '<module>'").select("file_id", "id")
    by_import = imports.join(targets, F.col("resolved_symbol_id") == F.col("target")).join(modules.withColumnRenamed("id", "mid"), "file_id").select("target", F.col("mid").alias("id"))
    return direct.union(by_import).distinct()


def dependencies(calls: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, line): callees, one row for each call."""
    return calls.where("callee_symbol_id is not null").join(sources, F.col("caller_symbol_id") == F.col("source")).select("source", F.col("callee_symbol_id").alias("id"), "line")


def traverse(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, up: bool = False) -> DataFrame:
    """(key, node, depth), the seeds (key, node) left out."""
    return frontier_bfs(seeds, reversed_edges(edges) if up else edges, max_depth).where("depth > 0").select("key", "node", "depth")


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(key, node, depth, direct): all that reach the seed within ``max_depth`` + 1 steps; direct at one step."""
    return traverse(edges, seeds, max_depth + 1, up=True).withColumn("direct", F.col("depth") == 1)


def blast_radius_services(hit: DataFrame, symbols: DataFrame, files: DataFrame, service_edges: DataFrame) -> DataFrame:
    """(key, service_id, rank): the services of affected symbols first (rank 0), then those that call them in turn."""
    own = hit.join(symbols.select(F.col("id").alias("node"), "file_id"), "node").join(files.select(F.col("id").alias("file_id"), "service_id"), "file_id").select("key", F.col("service_id").alias("node")).distinct()
    edges = service_edges.select(F.col("to_service_id").alias("src"), F.col("from_service_id").alias("dst"))
    return frontier_bfs(own, edges).select("key", F.col("node").alias("service_id"), F.col("depth").alias("rank"))


def blast_summary(hit: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(key, affected_files, total, n_direct) of a blast radius: the sorted distinct paths, joined by commas, and counts."""
    path = files.select(F.col("id").alias("file_id"), "path")
    rows = hit.join(symbols.select(F.col("id").alias("node"), "file_id"), "node").join(path, "file_id")
    return rows.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("path")), ",").alias("affected_files"), F.count("*").alias("total"), F.count_if("direct").alias("n_direct"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, step, node): a shortest path for each pair that has one, the smallest predecessor at every step.

    pairs: (src, dst), or (src) for the paths to all that a source reaches. All sources search in one loop, and the
    frontier carries the path of each node."""
    found = frontier_bfs(pairs.select(F.col("src").alias("key"), F.col("src").alias("node")).distinct(), edges, max_depth, paths=True)
    found = found.select(F.col("key").alias("src"), F.col("node").alias("dst"), F.concat("path", F.array("node")).alias("path"))
    if "dst" in pairs.columns:
        found = found.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    return found.select("src", "dst", F.posexplode("path").alias("step", "node"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, cycle): nodes on a cycle of two or more, named by the smallest of theirs.

    Nodes that only lead in or out are trimmed until none is left; then forward labels are coloured and each colour is
    searched backward from its root (Orzan), on what is left, until nothing is."""
    left = settle(edges.where("src <> dst").select("src", "dst").distinct())
    out = None
    while True:
        n = -1
        while n != (n := left.count()) and n:
            old = left
            for _ in range(2):  # two layers a round
                left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            left = settle(left)
            forget(old)
        if not n:
            break
        colour = last = settle(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("c", F.col("node")))
        while True:
            low = left.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            new = settle(colour.join(low, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")))
            forget(last)
            last, colour = new, new.select("node", "c")
            if not new.where("moved").head(1):
                break
        ends = left.join(colour.withColumnsRenamed({"node": "src", "c": "cs"}), "src").join(colour.withColumnsRenamed({"node": "dst", "c": "cd"}), "dst").where("cs = cd")
        roots = colour.where("node = c").select(F.col("c").alias("key"), "node")
        back = frontier_bfs(roots, ends.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        part = settle(back.select("node", F.col("key").alias("cycle")))
        out = part if out is None else out.union(part)
        left = settle(left.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if out is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("cycle")).where("false")
    many = out.groupBy("cycle").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1")
    return out.join(many, "cycle").select("node", F.col("low").alias("cycle"))


def detect_cycles(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(cycle, size, members): members by qualified name and id, joined by commas."""
    named = strongly_connected(edges).join(symbols.select(F.col("id").alias("node"), "qualified_name"), "node")
    return named.groupBy("cycle").agg(F.count("*").alias("size"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("qualified_name", "node"))), lambda x: x["qualified_name"]), ",").alias("members"))


def communities(symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership (id, community_id) and communities (id, name, symbol_count, internal_edges, external_edges, modularity).

    Communities are the components of the undirected call graph, numbered from 1 by their smallest member: no edge
    leaves one, so modularity is 1, or 0 where only self-calls make up a component."""
    comp = settle(connected_components(edges))
    sizes = comp.groupBy("component").agg(F.count("*").alias("symbol_count"))
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    inner = pairs.join(comp, F.col("b") == F.col("node")).groupBy("component").agg(F.count("*").alias("pairs"))
    loops = edges.where("src = dst").join(comp, F.col("src") == F.col("node")).groupBy("component").agg(F.count("*").alias("loops"))
    numbered = sizes.join(inner, "component", "left").join(loops, "component", "left")
    # one row a component; ranks are dealt by ranges of the smallest member
    ranked = dense_ids(numbered, "component")
    internal = (F.coalesce("pairs", F.lit(0)) * 2 + F.coalesce("loops", F.lit(0))).cast("long")
    internal = F.floor(internal / 2)
    info = ranked.select(
        "id", "component", F.concat(F.lit("community_"), F.col("id")).alias("name"), "symbol_count", internal.cast("long").alias("internal_edges"), F.lit(0).cast("long").alias("external_edges"),
        (internal / F.greatest(internal, F.lit(1))).cast("double").alias("modularity"),
    )
    members = comp.join(ranked.select("component", F.col("id").alias("community_id")), "component").select(F.col("node").alias("id"), "community_id")
    return members, info.drop("component")


def dense_ids(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``id`` from 1 in the order of the unique column ``key``, without one task that holds them all:
    ranges are numbered on their own and shifted by the sizes of the ranges before."""
    parts = settle(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    first = parts.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("low"))
    shift = first.withColumn("before", F.expr("sum(n) over (order by _part) - n")).select("_part", "low", "before")  # a row for each partition
    return parts.join(F.broadcast(shift), "_part").withColumn("id", (F.col("_at") - F.col("low") + F.col("before") + 1).cast("long")).drop("_part", "_at", "low", "before")


def reachable(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): the forward closure of entry points, exported symbols, tests and trait implementations."""
    trait = F.exists("decorators", lambda d: d.contains("trait_impl")) if "decorators" in symbols.columns else F.lit(False)
    seeds = symbols.where(F.col("is_entry_point") | F.col("is_exported") | F.col("is_test") | F.coalesce(trait, F.lit(False)))
    return frontier_bfs(seeds.select(F.lit(0).alias("key"), F.col("id").alias("node")), edges).select(F.col("node").alias("id"))


def with_dead(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``symbols`` with is_dead: functions and methods, not tests, that nothing alive reaches."""
    live = settle(reachable(symbols, call_edges(calls))).withColumn("_live", F.lit(True))
    dead = F.col("kind").isin("function", "method") & ~F.col("is_test") & F.col("_live").isNull()
    return symbols.drop("is_dead").join(live, "id", "left").withColumn("is_dead", dead).drop("_live")


def flows(symbols: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(flow_id, symbol_id, step_order, depth): what each entry point reaches, ordered by depth and id from 0."""
    seeds = symbols.where("is_entry_point").select(F.col("id").alias("key"), F.col("id").alias("node"))
    steps = frontier_bfs(seeds, edges, max_depth).select(F.col("key").alias("flow_id"), F.col("node").alias("symbol_id"), "depth")
    return steps.withColumn("step_order", F.expr("cast(row_number() over (partition by flow_id order by depth, symbol_id) - 1 as int)"))


def execution_flows(steps: DataFrame, symbol: int, limit: int = 200) -> DataFrame:
    mine = steps.where(F.col("symbol_id") == symbol).select("flow_id").distinct()
    return steps.join(mine, "flow_id", "left_semi").orderBy("flow_id", "step_order").limit(limit)


def edit_plan(edges: DataFrame, target: int, max_depth: int | None = None) -> DataFrame:
    """(node, depth, has_cycle): the target and all that depend on it, by (depth, id). has_cycle: the edges among them
    can't be ordered (a self-call counts); nodes without predecessors are dropped until only cycles are left."""
    spark = edges.sparkSession
    cone = settle(frontier_bfs(spark.createDataFrame([(0, target)], "key int, node long"), reversed_edges(edges), max_depth).select("node", "depth"))
    left = settle(edges.join(cone.select(F.col("node").alias("src")), "src", "left_semi").join(cone.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    n = -1
    while n != (n := left.count()) and n:
        left = settle(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
    return cone.withColumn("has_cycle", F.lit(n > 0))


def affected_tests(symbols: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int | None = None, by_name: bool = False) -> DataFrame:
    """(id, name): tests that reach a changed symbol, itself included; ``changed``: (id). by_name keeps the smallest id
    of each name and leaves out changed symbols without a call."""
    seeds = changed.select(F.lit(0).alias("key"), F.col("id").alias("node"))
    if by_name:
        seeds = seeds.join(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "node", "left_semi").select("key", "node")
    hit = frontier_bfs(seeds, reversed_edges(edges), max_depth).select(F.col("node").alias("id")).distinct()
    tests = symbols.where("is_test").join(hit, "id", "left_semi").select("id", "name")
    return tests.groupBy("name").agg(F.min("id").alias("id")).select("id", "name") if by_name else tests


def diff_impact(symbols: DataFrame, files: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int = 5, top: int = 20) -> dict[str, DataFrame]:
    """What a change of ``changed`` (id) reaches within ``max_depth`` steps upward, as three tables.

    details (key, id, name, qualified_name, kind, path, depth): symbols other than tests, once for each changed one;
    tests (id, name, qualified_name, path): the smallest id of each name; focus (path, n): the ``top`` files by affected
    symbols, tests included, counted once for each changed one."""
    seeds = changed.select(F.col("id").alias("key"), F.col("id").alias("node"))
    hit = traverse(edges, seeds, max_depth, up=True).withColumnRenamed("node", "id")
    named = symbols.select("id", "name", "qualified_name", "kind", "is_test", "file_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    rows = hit.join(named, "id")
    tests = rows.where("is_test").groupBy("name").agg(F.min(F.struct("id", "qualified_name", "path")).alias("m")).select("m.id", "name", "m.qualified_name", "m.path")
    return {
        "details": rows.where("not is_test").select("key", "id", "name", "qualified_name", "kind", "path", "depth"), "tests": tests,
        "focus": rows.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(top),
    }


def graph_data(symbols: DataFrame, edges: DataFrame, group: Column, max_nodes: int = 5000, max_edges: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, group_code, degree), the first by id, and the first edges (src, dst) that have both ends among
    them; the degree counts these edges. ``group``: the group code as a Column of ``symbols``."""
    top = symbols.orderBy("id").limit(max_nodes).select("id", "name", group.alias("group_code"))
    e = edges.join(top.select(F.col("id").alias("src")), "src", "left_semi").join(top.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    e = settle(e.orderBy("src", "dst").limit(max_edges))
    degree = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return top.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), e


def neighborhood(edges: DataFrame, center: int, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth, degree) around a symbol and the edges among them; the degree counts these edges only."""
    both = edges.union(reversed_edges(edges)).distinct()
    near = settle(frontier_bfs(edges.sparkSession.createDataFrame([(0, center)], "key int, node long"), both, min(depth, 5)).select("node", "depth"))
    inner = edges.join(near.select(F.col("node").alias("src")), "src", "left_semi").join(near.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    degree = inner.select(F.col("src").alias("node")).union(inner.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    return near.join(degree, "node", "left").select("node", "depth", F.coalesce("degree", F.lit(0)).alias("degree")), inner


def mutual_calls(edges: DataFrame, limit: int | None = 10) -> DataFrame:
    """(a, b): pairs a < b that call each other, the first ``limit`` in order; None for all."""
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    found = edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(back, ["a", "b"], "left_semi").distinct()
    return found if limit is None else found.orderBy("a", "b").limit(limit)


def file_links(calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, kind, from_name, to_name): distinct connections between different files."""
    s = symbols.select("id", "name", F.col("file_id").alias("f"))
    c = (
        calls.where("callee_symbol_id is not null").select("caller_symbol_id", "callee_symbol_id").distinct()
        .join(s.select(F.col("id").alias("caller_symbol_id"), F.col("name").alias("from_name"), F.col("f").alias("src")), "caller_symbol_id")
        .join(s.select(F.col("id").alias("callee_symbol_id"), F.col("name").alias("to_name"), F.col("f").alias("dst")), "callee_symbol_id")
        .select("src", "dst", F.lit("call").alias("kind"), "from_name", "to_name")
    )
    i = imports.where("resolved_file_id is not null").select(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst"), F.lit("import").alias("kind"), F.lit("").alias("from_name"), F.col("imported_name").alias("to_name"))
    return c.unionByName(i).where("src <> dst").distinct()


def file_dependencies(links: DataFrame, dependents_of: bool = False) -> DataFrame:
    """(file_id, other, connections): per file and neighbour the connections as kind:from>to, sorted and joined."""
    a, b = ("dst", "src") if dependents_of else ("src", "dst")
    text = F.concat(F.col("kind"), F.lit(":"), F.col("from_name"), F.lit(">"), F.col("to_name"))
    return links.groupBy(F.col(a).alias("file_id"), F.col(b).alias("other")).agg(F.array_join(F.sort_array(F.collect_set(text)), ",").alias("connections"))


def transitive_file_deps(links: DataFrame, file_id: int, max_depth: int = 5) -> DataFrame:
    """(file_id, depth, via): files reached within 1 to 5 steps and the file through which each was found."""
    seeds = links.sparkSession.createDataFrame([(0, file_id)], "key int, node long")
    got = frontier_bfs(seeds, links.select("src", "dst").distinct(), max(1, min(max_depth, 5)))
    return got.where("depth > 0").select(F.col("node").alias("file_id"), "depth", F.col("parent").alias("via"))


def call_chain(edges: DataFrame, start: int, symbols: DataFrame, max_depth: int = 10) -> DataFrame:
    """(line): a Mermaid star from the start to everything it reaches."""
    names = symbols.select(F.col("id").alias("node"), "name")
    near = traverse(edges, edges.sparkSession.createDataFrame([(0, start)], "key int, node long"), max_depth).join(names, "node")
    first = names.where(F.col("node") == start).select(F.col("name").alias("start"))
    return near.crossJoin(F.broadcast(first)).select(F.concat(F.lit(f"    n{start}["), "start", F.lit("] --> n"), F.col("node").cast("string"), F.lit("["), "name", F.lit("]")).alias("line"))
