"""Derived tables: coupling, history, topology, rules, boundaries, entry points, search tables for insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.text import glob_regex
from callweave.plans.graph import when_any

#: Names that are entry points, and name patterns (LIKE, case-insensitive, ``_`` a wildcard).
ENTRY_NAMES = ["main", "Main", "run", "start", "init", "constructor", "<module>"]
ENTRY_PATTERNS = ["%_handler", "handle_%", "%Handler"]
#: Per framework exported names, suffixes of files whose exports are entry points, and name patterns.
FRAMEWORKS = {
    "nextjs": {
        "names": "GET POST PUT DELETE PATCH HEAD OPTIONS generateMetadata generateStaticParams getServerSideProps getStaticProps getStaticPaths middleware".split(),
        "files": """
/page.tsx /page.ts /page.jsx /page.js /layout.tsx /layout.ts /layout.jsx /layout.js /loading.tsx /loading.ts /loading.jsx /loading.js /error.tsx
/error.ts /error.jsx /error.js /not-found.tsx /not-found.ts /not-found.jsx /not-found.js /template.tsx /template.ts /template.jsx /template.js
/default.tsx /default.ts /default.jsx /default.js /route.tsx /route.ts /route.jsx /route.js /global-error.tsx /global-error.ts /global-error.jsx
/global-error.js
""".split(),
        "patterns": [],
    },
    "nuxt": {"names": "defineNuxtConfig defineNuxtPlugin defineNuxtRouteMiddleware defineEventHandler defineNitroPlugin".split(), "files": [], "patterns": []},
    "angular": {"names": [], "files": [], "patterns": ["%Component", "%Module", "%Service", "%Directive", "%Pipe", "%Guard"]},
    "svelte": {"names": "load actions prerender ssr csr".split(), "files": [], "patterns": []},
    "node": {"names": [], "files": [], "patterns": ["%Middleware", "%middleware"]},
}


def with_entry_points(symbols: DataFrame, files: DataFrame, frameworks: list[str] = (), configured: list[str] = ()) -> DataFrame:
    """``symbols`` with is_entry_point: marked before, or by name, pattern, class membership, framework or configuration."""
    name = F.col("name")
    rules: list[Column] = [F.col("is_entry_point"), name.isin(ENTRY_NAMES), *(name.ilike(p) for p in ENTRY_PATTERNS)]
    if configured:
        rules.append(name.isin(list(configured)) | F.col("qualified_name").isin(list(configured)))
    out = symbols
    for f in frameworks:
        spec = FRAMEWORKS.get(f)
        if spec:
            rules.append(F.col("is_exported") & name.isin(spec["names"])) if spec["names"] else None
            rules.extend(name.ilike(p) for p in spec["patterns"])
            if spec["files"]:
                ends = when_any([F.concat(F.lit("/"), F.col("path")).endswith(x) for x in spec["files"]])
                marked = files.where(ends).select(F.col("id").alias("file_id"), F.lit(True).alias(f"_in_{f}"))
                out = out.join(marked, "file_id", "left")
                rules.append(F.col("is_exported") & F.col(f"_in_{f}"))
    # a method whose qualified name starts with a class name and a dot
    classes = symbols.where("kind = 'class'").select(F.lower("name").alias("_class")).distinct()
    owned = symbols.where("kind = 'method'").select("id", F.lower(F.substring_index("qualified_name", ".", 1)).alias("_class")).join(classes, "_class", "left_semi").select("id", F.lit(True).alias("_owned"))
    out = out.join(owned, "id", "left")
    return out.withColumn("is_entry_point", when_any([*rules, F.col("_owned")])).drop("_owned", *(f"_in_{f}" for f in frameworks))


def entry_points(symbols: DataFrame, files: DataFrame, endpoints: DataFrame, category: str | None = None, limit: int = 100) -> DataFrame:
    """(id, name, qualified_name, category): alive handlers (http), marked symbols (framework) and main functions (main),
    each symbol under the first of these."""
    live = symbols.where("not is_dead")
    http = live.join(endpoints.select(F.col("handler_symbol_id").alias("id")), "id", "left_semi").select("id", F.lit(1).alias("p"))
    marked = live.where("is_entry_point").select("id", F.lit(2).alias("p"))
    main = live.where("name = 'main' and kind = 'function'").select("id", F.lit(3).alias("p"))
    every = http.union(marked).union(main)
    names = F.element_at(F.array(F.lit("http"), F.lit("framework"), F.lit("main")), F.col("p"))
    if category is not None:
        every = every.where(names == category)
    best = every.groupBy("id").agg(F.min("p").alias("p"))
    return symbols.join(best, "id").select("id", "name", "qualified_name", names.alias("category")).orderBy("category", "name", "id").limit(limit)


def coupling_source(commit_files: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """Distinct (commit, path) of commits with 2 to 20 files."""
    rows = commit_files.select("commit", "path").distinct()
    kept = rows.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    return rows.join(kept.select("commit"), "commit", "left_semi")


def coupling(commit_files: DataFrame, files: DataFrame, least: int = 2) -> DataFrame:
    """(file_a_id, file_b_id, co_changes, strength): pairs of files changed together; strength is their share of the kept
    commits. A commit has 20 files at most, so its pairs are bounded."""
    kept = coupling_source(commit_files).join(files.select("path", F.col("id").alias("f")), "path").select("commit", "f")
    total = kept.agg(F.greatest(F.count_distinct("commit"), F.lit(1)).alias("total"))  # one row
    sets = kept.groupBy("commit").agg(F.sort_array(F.collect_set("f")).alias("s"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("x"))
    n = pairs.groupBy(F.col("x.a").alias("file_a_id"), F.col("x.b").alias("file_b_id")).agg(F.count("*").alias("co_changes")).where(F.col("co_changes") >= least)
    return n.crossJoin(F.broadcast(total)).select("file_a_id", "file_b_id", "co_changes", (F.col("co_changes") / F.col("total")).alias("strength"))


def top_coupling_pairs(c: DataFrame, files: DataFrame, module: Column, limit: int = 50) -> DataFrame:
    f = files.select("id", "path", module.alias("module"))
    top = c.orderBy(F.desc("strength"), "file_a_id", "file_b_id").limit(limit)
    a, b = f.toDF("file_a_id", "path_a", "module_a"), f.toDF("file_b_id", "path_b", "module_b")
    return top.join(a, "file_a_id").join(b, "file_b_id").select("file_a_id", "file_b_id", "path_a", "path_b", "module_a", "module_b", "co_changes", "strength")


def file_couplings(c: DataFrame, file_id: int) -> DataFrame:
    other = F.when(F.col("file_a_id") == file_id, F.col("file_b_id")).otherwise(F.col("file_a_id"))
    return c.where((F.col("file_a_id") == file_id) | (F.col("file_b_id") == file_id)).select(other.alias("partner"), "co_changes", "strength")


def blame_to_symbols(blame: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, ts, author, commit): blamed lines inside the symbols' spans; the file is the key, the span a filter."""
    f = files.select(F.col("id").alias("file_id"), "path")
    s = symbols.select(F.col("id").alias("symbol_id"), "file_id", "line_start", "line_end").join(f, "file_id")
    return s.join(blame, "path").where("line between line_start and line_end").select("symbol_id", "ts", "author", "commit")


def symbol_history(rows: DataFrame, as_of: Column, days: int = 30, volatile: int = 3) -> DataFrame:
    """(symbol_id, created_at, last_modified_at, modification_count, author_count, is_volatile): volatile with more than
    three commits in the last 30 days before ``as_of`` (epoch seconds)."""
    # commits and authors are each folded to one row before they are counted: no row is repeated for a distinct count
    last = F.max(F.col("ts") >= as_of - days * 86400).cast("int").alias("recent")
    commits = rows.groupBy("symbol_id", "commit").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), last)
    seen = F.col("commit").isNotNull()
    per = commits.groupBy("symbol_id").agg(F.min("a").alias("created_at"), F.max("b").alias("last_modified_at"), F.count("commit").alias("modification_count"), (F.count_if(seen & (F.col("recent") == 1)) > volatile).alias("is_volatile"))
    authors = rows.select("symbol_id", "author").distinct().groupBy("symbol_id").agg(F.count("author").alias("author_count"))
    return per.join(authors, "symbol_id").select("symbol_id", "created_at", "last_modified_at", "modification_count", "author_count", "is_volatile")


def service_topology(api: DataFrame) -> DataFrame:
    """(from_service_id, to_service_id, protocol, call_count, confidence) of resolved calls between services."""
    n = api.where("resolved_service_id is not null and resolved_service_id <> service_id").groupBy(F.col("service_id").alias("from_service_id"), F.col("resolved_service_id").alias("to_service_id"), "protocol").agg(F.count("*").alias("call_count"))
    return n.withColumn("confidence", F.when(F.col("call_count") > 5, 0.9).otherwise(0.6))


def mermaid_topology(edges: DataFrame, services: DataFrame) -> DataFrame:
    a, b = services.select(F.col("id").alias("from_service_id"), F.col("name").alias("a")), services.select(F.col("id").alias("to_service_id"), F.col("name").alias("b"))
    text = F.concat(F.lit("    "), "a", F.lit(" -->|"), "protocol", F.lit(" x"), F.col("call_count").cast("string"), F.lit("| "), "b")
    return edges.join(a, "from_service_id").join(b, "to_service_id").select(text.alias("line"))


def check_rules(imports: DataFrame, files: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_name, from_file_id, to_file_id, line, severity): resolved imports that a rule's globs forbid. The rules are
    literals of the plan; imports are read once for all of them."""
    f = files.select("id", "path")
    i = imports.where("resolved_file_id is not null").select("file_id", "resolved_file_id", "line")
    i = i.join(f.toDF("file_id", "_from"), "file_id").join(f.toDF("resolved_file_id", "_to"), "resolved_file_id")
    hits = F.array_compact(F.array(*(
        F.when(F.col("_from").rlike(glob_regex(r["from"])) & F.col("_to").rlike(glob_regex(r["to"])), F.struct(F.lit(r["name"]).alias("rule_name"), F.lit(r.get("severity", "error")).alias("severity"))) for r in rules
    )))
    return i.select(F.col("file_id").alias("from_file_id"), F.col("resolved_file_id").alias("to_file_id"), "line", F.explode(hits).alias("r")).select("r.rule_name", "from_file_id", "to_file_id", "line", "r.severity")


def rule_summary(violations: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_name, violations, passed)."""
    spark = violations.sparkSession
    names = spark.createDataFrame([(r["name"],) for r in rules], "rule_name string")
    n = violations.groupBy("rule_name").agg(F.count("*").alias("violations"))
    return names.join(n, "rule_name", "left").select("rule_name", F.coalesce("violations", F.lit(0)).alias("violations"), F.col("violations").isNull().alias("passed"))


def boundaries(members: DataFrame, symbols: DataFrame, files: DataFrame, top: int = 5) -> DataFrame:
    """(community_id, path, n, rank): the files with most symbols of each community."""
    s = members.join(symbols.select("id", "file_id"), "id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    n = s.groupBy("community_id", "path").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.expr("row_number() over (partition by community_id order by n desc, path)")).where(F.col("rank") <= top)


def cross_community_calls(members: DataFrame, calls: DataFrame) -> DataFrame:
    """(from_community, to_community, n, callees): calls between communities with their distinct callee names."""
    a, b = members.toDF("caller_symbol_id", "from_community"), members.toDF("callee_symbol_id", "to_community")
    c = calls.join(a, "caller_symbol_id").join(b, "callee_symbol_id").where("from_community <> to_community")
    return c.groupBy("from_community", "to_community").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("callee_name")), ",").alias("callees"))


def boundary_summary(communities: DataFrame) -> DataFrame:
    """One row (total_modules, avg_modularity, boundary_violations): a violation is a community with more edges outward
    than inside; 0 throughout without any."""
    return communities.agg(F.count("*").alias("total_modules"), F.coalesce(F.avg("modularity"), F.lit(0.0)).alias("avg_modularity"), F.count_if(F.col("external_edges") > F.col("internal_edges")).alias("boundary_violations"))


def insights(symbols: DataFrame, files: DataFrame, calls: DataFrame, top: int = 10, god: int = 50, dead: int = 200) -> DataFrame:
    """(list, rank, id, name, n) of three lists: most_connected, the ``top`` symbols by degree; god_files, the files of
    ``god`` symbols and more; dead, the first ``dead`` dead symbols by name."""
    connected = most_connected(symbols, calls, top).select(F.lit("most_connected").alias("list"), "id", "name", F.col("degree").alias("n"))
    large = group_files(files, symbols).where(F.col("n") >= god).select(F.lit("god_files").alias("list"), "id", F.col("path").alias("name"), "n")
    gone = symbols.where("is_dead").orderBy("name", "id").limit(dead).select(F.lit("dead").alias("list"), "id", "name", F.lit(0).cast("long").alias("n"))
    order = F.expr("row_number() over (partition by list order by n desc, name, id)")
    by_degree = F.expr("row_number() over (partition by list order by n desc, id)")
    return connected.withColumn("rank", by_degree).union(large.withColumn("rank", order)).union(gone.withColumn("rank", order)).select("list", "rank", "id", "name", "n")


def most_connected(symbols: DataFrame, calls: DataFrame, limit: int = 10) -> DataFrame:
    """(id, name, degree) by call rows in and out."""
    ends = calls.where("callee_symbol_id is not null").select(F.explode(F.array("caller_symbol_id", "callee_symbol_id")).alias("id"))
    top = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return top.join(symbols.select("id", "name"), "id").select("id", "name", "degree").orderBy(F.desc("degree"), "id").limit(limit)


def scip_occurrences(symbols: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, symbol, role): definitions (1) and call references (0), lines from 0 and never below."""
    f = files.select(F.col("id").alias("file_id"), "path")
    zero = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    defs = symbols.join(f, "file_id").select("path", zero("line_start").alias("line"), F.col("qualified_name").alias("symbol"), F.lit(1).alias("role"))
    target = symbols.select(F.col("id").alias("callee_symbol_id"), "qualified_name")
    refs = calls.join(target, "callee_symbol_id").join(f, "file_id").select("path", zero("line").alias("line"), F.col("qualified_name").alias("symbol"), F.lit(0).alias("role"))
    return defs.union(refs)


def scip_documents(symbols: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each file, ready to be written as JSON: path, occurrences in order, symbols by qualified name."""
    o = scip_occurrences(symbols, calls, files)
    order = F.sort_array(F.collect_list(F.struct("line", "role", "symbol")))
    return o.groupBy("path").agg(order.alias("occurrences"), F.sort_array(F.collect_set(F.when(F.col("role") == 1, F.col("symbol")))).alias("symbols"))


def group_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, path, n): files by number of symbols; insights take those of 50 and more."""
    return files.join(symbols.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n")), "id").select("id", "path", "n")
