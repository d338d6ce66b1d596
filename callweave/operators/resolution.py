"""Name resolution: imports, calls, inheritance and API calls as ranked equi-joins.

Every lookup is first reduced to one best row for each key, so a join can't multiply the calls, however often a name
occurs. Ties go to the smallest id (or path, line, id where said), never to chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.builtins import NAMES, PREFIXES
from callweave.functions.text import like_ci, normalized_path
from callweave.plans.checkpoints import broadcast_if_small, settle

#: What is tried after a module path, in order.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
#: Callback names of pass 9.
LOCAL_NAMES = ["resolve", "reject", "callback", "cb", "done", "next", "handler", "onSuccess", "onError", "onChange", "onClick", "onSubmit", "refetch", "mutate", "revalidate"]


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def expand_alias(module: Column, aliases: list[tuple[str, str]]) -> Column:
    """The expansion of the longest matching alias pattern (one ``*`` at most), root-relative; null if none matches."""
    out = F.lit(None).cast("string")
    for pattern, target in sorted(aliases, key=lambda a: (len(a[0]), a[0])):  # the last wins: longest first in effect
        if "*" in pattern:
            prefix = pattern.split("*")[0]
            rest = F.substring(module, len(prefix) + 1, 1 << 30)
            head, star, tail = target.partition("*")
            grown = F.concat(F.lit(head), rest, F.lit(tail)) if star else F.lit(target)
            hit = module.startswith(prefix)
        else:
            grown, hit = F.lit(target), module == pattern
        out = F.when(hit, F.regexp_replace(grown, "^\\./", "")).otherwise(out)
    return out


def module_candidates(module: Column, importer: Column, aliases: list[tuple[str, str]]) -> Column:
    """The paths to try for a JS or TS import, in order."""
    alias = F.when(~module.startswith("."), expand_alias(module, aliases))
    parent = _parent(importer)
    base = F.coalesce(alias, F.when(module.startswith("."), F.when(parent == "", module).otherwise(F.concat(parent, F.lit("/"), module))).otherwise(module))
    norm = normalized_path(base)
    return F.array(*(F.concat(norm, F.lit(s)) for s in SUFFIXES))


def rust_candidates(module: Column, importer: Column) -> Column:
    """The paths to try for a Rust import: ever fewer segments, each as a file and as a directory, then the start."""
    parts = F.split(module, "::")
    first = parts[0]
    start = F.when(first == "crate", "src").when(first.isin("super", "self"), _parent(importer))
    rest = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: s != "*")
    at = lambda k: F.concat_ws("/", F.when(start == "", None).otherwise(start), F.array_join(F.slice(rest, F.lit(1), k), "/"))
    counts = F.when(F.size(rest) > 0, F.sequence(F.size(rest), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    tries = F.flatten(F.transform(counts, lambda k: F.array(F.concat(at(k), F.lit(".rs")), F.concat(at(k), F.lit("/mod.rs")))))
    last = F.array(F.concat(F.when(start == "", "").otherwise(F.concat(start, F.lit("/"))), F.lit("mod.rs")), F.concat(start, F.lit(".rs")))
    return F.when(start.isNotNull(), F.concat(tries, last)).otherwise(F.array().cast("array<string>"))


def first_existing(requests: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """(id, file_id): the first candidate path of each request that is a file."""
    tried = requests.select("id", F.posexplode(candidates).alias("pos", "path"))
    hit = tried.join(files.select("path", F.col("id").alias("file_id")), "path")
    return hit.groupBy("id").agg(F.min(F.struct("pos", "file_id")).alias("m")).select("id", "m.file_id")


def resolve_imports(imports: DataFrame, files: DataFrame, symbols: DataFrame, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """``imports`` with resolved_file_id, resolved_symbol_id and is_external filled in; external rows are tried only if
    an alias matches. The symbol is the exported one of the original or imported name, else any; smallest id."""
    aliases = list(aliases)
    src = files.select(F.col("id").alias("file_id"), F.col("path").alias("_importer"), F.col("language").alias("_lang"))
    todo = imports.join(src, "file_id").where(~F.col("is_external") | expand_alias(F.col("module_path"), aliases).isNotNull())
    cand = F.when(F.col("_lang") == "rust", rust_candidates(F.col("module_path"), F.col("_importer"))).otherwise(module_candidates(F.col("module_path"), F.col("_importer"), aliases))
    found = first_existing(todo, files, cand).withColumnRenamed("file_id", "_rf")
    best = symbols.groupBy(F.col("file_id").alias("_rf"), F.col("name").alias("_name")).agg(F.min(F.struct(~F.col("is_exported"), "id")).alias("b")).select("_rf", "_name", F.col("b.id").alias("_rs"))
    original = F.coalesce("original_name", "imported_name") if "original_name" in imports.columns else F.col("imported_name")
    out = imports.join(found, "id", "left").withColumn("_name", original).join(best, ["_rf", "_name"], "left")
    return out.withColumns({
        "resolved_file_id": F.coalesce("_rf", "resolved_file_id") if "resolved_file_id" in imports.columns else F.col("_rf"),
        "resolved_symbol_id": F.coalesce("_rs", "resolved_symbol_id") if "resolved_symbol_id" in imports.columns else F.col("_rs"),
        "is_external": F.col("is_external") & F.col("_rf").isNull(),
    }).drop("_rf", "_rs", "_name")


def is_builtin(name: Column) -> Column:
    out = F.regexp_replace(name, "!$", "").isin(NAMES)
    for p in PREFIXES:
        out = out | name.startswith(p)
    return out


def is_local(name: Column) -> Column:
    return name.rlike("^set\\p{Lu}") | name.rlike("^on\\p{Lu}") | name.isin(LOCAL_NAMES)


#: Slices into which the rows of every name are dealt where a name is called from many files.
SLICES = 16
#: Names that occur in more files than this are hot.
HOT = 100_000


def hot_values(rows: DataFrame, column: str, hot: int = HOT) -> DataFrame | None:
    """The values of a column that more than ``hot`` rows have; None if there are none."""
    many = settle(rows.groupBy(column).count().where(F.col("count") > hot).select(column))
    return None if many.isEmpty() else broadcast_if_small(many)


def spread(rows: DataFrame, best: DataFrame, keys: list[str], by: str, many: DataFrame | None) -> DataFrame:
    """``rows`` left-joined with ``best``, which has one row for each of ``keys``. Rows with a value of ``many`` in the last
    key are dealt into ``SLICES`` by a hash of ``by``, and their rows of ``best`` are repeated."""
    if many is None:
        return rows.join(best, keys, "left")
    many = many.withColumn("_hot", F.lit(True))
    dealt = rows.join(many, keys[-1], "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SLICES))).otherwise(0)).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(best.join(many, keys[-1], "left").withColumn("_part", F.explode(parts).cast("long")).drop("_hot"), [*keys, "_part"], "left").drop("_part")


def resolve_calls(calls: DataFrame, symbols: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """``calls`` (id, callee_name, file_id ...) with callee_symbol_id, confidence and resolution.

    Ten passes in order of priority, the first that applies: import_guided, same_file, dotted_same_file,
    dotted_import_guided, dotted_same_service, import_file_affinity, same_service, global, then external, builtin,
    method_call and local, which name no symbol; the rest stays unresolved."""
    s = symbols.select("id", "file_id", "name", "is_exported", "line_start").join(files.select(F.col("id").alias("file_id"), "service_id", "path"), "file_id")
    shown = ~F.col("is_exported")
    best = lambda *key: F.min(F.struct(*key)).alias("b")

    def lookup(rows: DataFrame, keys: dict[str, str], order: tuple, out: str) -> DataFrame:
        return rows.groupBy(*(F.col(k).alias(v) for k, v in keys.items())).agg(best(*order, "id")).select(*keys.values(), F.col("b.id").alias(out))

    in_file = lookup(s, {"file_id": "file_id", "name": "_n"}, (), "_same")
    in_service = lookup(s, {"service_id": "_svc", "name": "_last"}, (), "_dsvc")
    of_service = lookup(s.where("is_exported"), {"service_id": "_svc", "name": "callee_name"}, ("path", "line_start"), "_svcsym")
    anywhere = lookup(s.where("is_exported"), {"name": "callee_name"}, ("path", "line_start"), "_global")
    known = imports.where("resolved_file_id is not null")
    original = F.coalesce("original_name", "imported_name") if "original_name" in imports.columns else F.col("imported_name")
    target = s.select(F.col("file_id").alias("resolved_file_id"), F.col("name").alias("_o"), "is_exported", "line_start", "id")
    guided = lookup(known.select("file_id", "imported_name", "resolved_file_id", original.alias("_o")).join(target, ["resolved_file_id", "_o"]).withColumn("_x", shown), {"file_id": "file_id", "imported_name": "callee_name"}, ("_x", "line_start"), "_guided")
    # a name is resolved once a file, however often it is called there
    c = calls.select("file_id", "callee_name").distinct().join(files.select(F.col("id").alias("file_id"), F.col("service_id").alias("_svc")), "file_id")
    dotted = F.instr("callee_name", ".") > 0
    c = c.withColumns({
        "_last": F.when(dotted, F.nullif(F.substring_index("callee_name", ".", -1), F.lit(""))),
        "_first": F.when(dotted, F.substring_index("callee_name", ".", 1)),
    })
    c = settle(c)
    hot_names, hot_lasts = hot_values(c, "callee_name"), hot_values(c.where("_last is not null"), "_last")
    c = c.join(guided, ["file_id", "callee_name"], "left").join(in_file.withColumnRenamed("_n", "callee_name"), ["file_id", "callee_name"], "left")
    c = c.join(in_file.withColumnsRenamed({"_n": "_last", "_same": "_dfile"}), ["file_id", "_last"], "left")
    # dotted, guided by an import of the first segment: the last segment in its file
    heads = known.select("file_id", F.col("imported_name").alias("_first"), "resolved_file_id").distinct()
    d = c.where("_last is not null").select("callee_name", "file_id", "_first", "_last").join(heads, ["file_id", "_first"])
    d = d.join(in_file.withColumnsRenamed({"file_id": "resolved_file_id", "_n": "_last", "_same": "_s"}), ["resolved_file_id", "_last"]).groupBy("file_id", "callee_name").agg(F.min("_s").alias("_dimp"))
    c = spread(c.join(d, ["file_id", "callee_name"], "left"), in_service, ["_svc", "_last"], "file_id", hot_lasts)
    # the name in any file that the file imports from
    reach = known.select("file_id", "resolved_file_id").distinct()
    in_reach = s.groupBy(F.col("file_id").alias("resolved_file_id"), F.col("name").alias("callee_name")).agg(best(shown, "path", "line_start", "id"))
    a = calls.select("file_id", "callee_name").distinct().join(reach, "file_id").join(in_reach, ["resolved_file_id", "callee_name"]).groupBy("file_id", "callee_name").agg(F.min("b").alias("b")).select("file_id", "callee_name", F.col("b.id").alias("_aff"))
    c = spread(c.join(a, ["file_id", "callee_name"], "left"), of_service, ["_svc", "callee_name"], "file_id", hot_names)
    c = spread(c, anywhere, ["callee_name"], "file_id", hot_names)
    ext = imports.where("is_external").select("file_id", F.col("imported_name").alias("_e")).distinct().withColumn("_hit", F.lit(True))
    c = c.join(ext.withColumnsRenamed({"_e": "callee_name", "_hit": "_ext1"}), ["file_id", "callee_name"], "left").join(ext.withColumnsRenamed({"_e": "_first", "_hit": "_ext2"}), ["file_id", "_first"], "left")
    passes = [("_guided", 0.98, "import_guided"), ("_same", 0.95, "same_file"), ("_dfile", 0.85, "dotted_same_file"), ("_dimp", 0.88, "dotted_import_guided"), ("_dsvc", 0.65, "dotted_same_service"),
              ("_aff", 0.80, "import_file_affinity"), ("_svcsym", 0.75, "same_service"), ("_global", 0.50, "global")]
    label = F.when(F.lit(False), F.struct(F.lit(0.0).alias("c"), F.lit("").alias("r")))
    for column, confidence, name in passes:
        label = label.when(F.col(column).isNotNull(), F.struct(F.lit(confidence).alias("c"), F.lit(name).alias("r")))
    for hit, confidence, name in (
        (F.col("_ext1").isNotNull() | F.col("_ext2").isNotNull(), 0.90, "external"), (is_builtin(F.col("callee_name")), 1.0, "builtin"),
        (F.instr("callee_name", ".") > 0, 0.30, "method_call"), (is_local(F.col("callee_name")), 0.40, "local"),
    ):
        label = label.when(hit, F.struct(F.lit(confidence).alias("c"), F.lit(name).alias("r")))
    label = label.otherwise(F.struct(F.lit(0.5).alias("c"), F.lit("unresolved").alias("r")))
    done = c.select("file_id", "callee_name", F.coalesce(*(F.col(p[0]) for p in passes)).alias("callee_symbol_id"), label.alias("l")).select("file_id", "callee_name", "callee_symbol_id", F.col("l.c").alias("confidence"), F.col("l.r").alias("resolution"))
    return calls.drop("callee_symbol_id", "confidence", "resolution").join(done, ["file_id", "callee_name"])


def resolve_heritage(heritage: DataFrame, symbols: DataFrame) -> DataFrame:
    low = symbols.where(F.col("kind").isin("class", "interface", "trait")).groupBy(F.col("name").alias("parent_name")).agg(F.min("id").alias("parent_symbol_id"))
    return heritage.drop("parent_symbol_id").join(low, "parent_name", "left")


#: Lengths of the beginnings by which texts that contain others are found: equal keys instead of a search of all pairs.
LENGTHS = (16, 8, 4, 2, 1)


def _key(literal: Column) -> Column:
    """The longest beginning of one of ``LENGTHS``; empty for an empty text."""
    out = F.lit("")
    for n in reversed(LENGTHS):
        out = F.when(F.length(literal) >= n, F.substring(literal, 1, n)).otherwise(out)
    return out


def _keys(text: Column) -> Column:
    """All beginnings of the ``LENGTHS``, of which one is the key of whatever ``text`` begins with."""
    return F.array_compact(F.array(*(F.when(F.length(text) >= n, F.substring(text, 1, n)) for n in LENGTHS)))


def _longest(parts: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"], F.lit(""))


def _after_slashes(text: Column) -> Column:
    parts = F.split(text, "/")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def _near_urls(api_calls: DataFrame, endpoints: DataFrame, literal: Column) -> DataFrame:
    """The distinct urls of ``api_calls`` (m, url_pattern, protocol) beside the ``endpoints`` of their m that they may hold:
    ``literal`` is a text that stands behind a slash in every url that an endpoint fits. Endpoints without one are beside
    all urls of their m."""
    e = broadcast_if_small(endpoints.withColumn("_k", _key(literal)))
    urls = api_calls.select("m", "url_pattern", "protocol").distinct()
    keys = F.array_distinct(F.concat(F.flatten(F.transform(_after_slashes(F.lower("url_pattern")), _keys)), F.array(F.lit(""))))
    return urls.withColumn("_k", F.explode(keys)).join(e, ["m", "_k"])


def resolve_api_calls(api_calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(id, endpoint_id, endpoint_service_id): the smallest endpoint of the same method whose path the url contains,
    in the way of LIKE: case-insensitive, with the path's own wildcards."""
    e = endpoints.select(F.col("id").alias("endpoint_id"), F.col("service_id").alias("endpoint_service_id"), F.col("method").alias("m"), "path_pattern")
    calls = api_calls.select("id", F.col("method").alias("m"), "url_pattern", F.lit("").alias("protocol"))
    literal = _longest(F.transform(_after_slashes(F.lower("path_pattern")), lambda x: F.regexp_extract(x, r"^[^%_\\]*", 0)))
    hit = _near_urls(calls, e, literal).where(like_ci(F.col("url_pattern"), F.concat(F.lit("%"), F.col("path_pattern"), F.lit("%"))))
    best = hit.groupBy("m", "url_pattern").agg(F.min(F.struct("endpoint_id", "endpoint_service_id")).alias("b"))
    return calls.join(best.select("m", "url_pattern", "b.*"), ["m", "url_pattern"], "left").select("id", "endpoint_id", "endpoint_service_id")


def boost_schema_matches(api_calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(id, endpoint_id): the first endpoint from a schema whose method (any case), protocol and path fit the url."""
    fixed = F.array_join(F.filter(F.split("path_pattern", "/"), lambda x: ~x.startswith("{")), "/")
    e = endpoints.select(F.col("id").alias("endpoint_id"), F.upper("method").alias("m"), "path_pattern", F.col("protocol").alias("ep"), fixed.alias("fixed"))
    calls = api_calls.select("id", F.upper("method").alias("m"), "url_pattern", "protocol")
    fixed = F.col("fixed")
    hit = _near_urls(calls, e, _longest(_after_slashes(F.lower(fixed)))).where((F.col("protocol") == F.col("ep")) | (F.col("ep") == "http"))
    hit = hit.where(F.col("url_pattern").contains(F.col("path_pattern")) | ((fixed != "") & (fixed != "/") & F.lower("url_pattern").contains(F.lower(fixed))))
    best = hit.groupBy("m", "url_pattern", F.col("protocol").alias("_p")).agg(F.min("endpoint_id").alias("endpoint_id")).withColumnsRenamed({"m": "_m", "url_pattern": "_u"})
    same = (F.col("m") == F.col("_m")) & (F.col("url_pattern") == F.col("_u")) & F.col("protocol").eqNullSafe(F.col("_p"))
    return calls.join(best, same, "left").select("id", "endpoint_id")


def _grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.filter(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))), lambda x: F.length(x) == n)


def find_handlers(endpoints: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, handler_symbol_id) for endpoints (id, method, path_pattern, operation_id): the operation's name, else the
    name made of method and path, else a function whose name has the method and then the last segment. An empty
    operation id counts as none. Ends and insides of names are found by equal keys."""
    s = symbols.select(F.col("id").alias("sid"), F.lower("name").alias("lname"), "name", "qualified_name", "kind")
    e = endpoints.select("id", "method", "path_pattern", "operation_id")
    asked = e.where("operation_id <> ''")
    equal = asked.select("id", F.col("operation_id").alias("name")).join(s, "name").select("id", "sid")
    ends = broadcast_if_small(asked.select("id", F.lower("operation_id").alias("o")).withColumn("_k", _key(F.reverse("o"))))
    tails = s.select("sid", F.lower("qualified_name").alias("q")).withColumn("_k", F.explode(_keys(F.reverse("q"))))
    op = equal.union(tails.join(ends, "_k").where(F.col("q").endswith(F.col("o"))).select("id", "sid")).groupBy("id").agg(F.min("sid").alias("_op"))
    low = s.groupBy("lname").agg(F.min("sid").alias("_by_name"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("path_pattern", "^/+", ""), "/", "_"), "[{}]", "")
    named = e.select("id", F.lower(F.concat_ws("_", "method", clean)).alias("lname")).join(low, "lname").select("id", "_by_name")
    last = F.lower(F.regexp_replace(F.element_at(F.split(F.regexp_replace("path_pattern", "/+$", ""), "/"), -1), "[{}]", ""))
    run = _longest(F.split(last, r"[%_\\]+"))
    part = e.select("id", F.concat(F.lit("%"), F.lower("method"), F.lit("%"), last, F.lit("%")).alias("p"), last.alias("last"), F.when(F.length(run) >= 2, run).otherwise(F.lower("method")).alias("run")).where("last <> ''")
    part = broadcast_if_small(part.withColumn("_k", F.when(F.length("run") >= 4, F.substring("run", 1, 4)).otherwise(F.substring("run", 1, 2))))
    grams = [_grams(F.col("lname"), n) for n in (4, 2)]
    inside = s.where(F.col("kind").isin("function", "method")).select("sid", "lname").withColumn("_k", F.explode(F.array_distinct(F.concat(*grams))))
    part = inside.join(part, "_k").where(F.call_function("like", F.col("lname"), F.col("p"))).groupBy("id").agg(F.min("sid").alias("_part"))
    return endpoints.select("id").join(op, "id", "left").join(named, "id", "left").join(part, "id", "left").select("id", F.coalesce("_op", "_by_name", "_part").alias("handler_symbol_id"))


def resolve_paths(paths: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id): symbols of files that equal or end in one of ``paths`` (path)."""
    parts = F.split("path", "/")  # all tails of a path that begin at a name, so that the join is on equal paths
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    f = files.select(F.col("id").alias("file_id"), F.explode(F.array_union(tails, F.array("path"))).alias("path"))
    f = f.join(paths.select("path").distinct(), "path", "left_semi").select("file_id").distinct()
    return symbols.join(f, "file_id", "left_semi").select("id")


def resolve_service_for_path(paths: DataFrame, services: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(path, service_id): the service that had the path before, else that of the longest prefix, else the smallest."""
    s = services.select(F.col("id").alias("sid"), F.col("repo_path").alias("_start"))
    starts = F.transform(F.sequence(F.lit(0), F.length("path")), lambda k: F.substring("path", F.lit(1), k))
    hit = paths.select("path", F.explode(starts).alias("_start")).distinct().join(s, "_start").groupBy("path").agg(F.max(F.struct(F.length("_start").alias("n"), (-F.col("sid")).alias("k"))).alias("m"))
    first = services.agg(F.min("id").alias("_first"))  # one row
    out = paths.join(hit.select("path", (-F.col("m.k")).alias("_hit")), "path", "left").crossJoin(F.broadcast(first))
    old = F.lit(None).cast("long")
    if previous is not None:
        out, old = out.join(previous.select("path", F.col("service_id").alias("_old")), "path", "left"), F.col("_old")
    return out.select("path", F.coalesce(old, "_hit", "_first").alias("service_id"))


def ingest_calls(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls by caller name (file_id, caller_name, callee_name, line) as calls by caller id: the name or qualified name in
    the same file, the later symbol winning and a qualified name over a plain one; calls of unknown callers are dropped."""
    keys = symbols.select("file_id", "id", "line_start", F.explode(F.array(F.struct(F.col("name").alias("k"), F.lit(0).alias("q")), F.struct(F.col("qualified_name").alias("k"), F.lit(1).alias("q")))).alias("x"))
    best = keys.groupBy("file_id", F.col("x.k").alias("caller_name")).agg(F.max(F.struct("line_start", "id", "x.q")).alias("m")).select("file_id", "caller_name", F.col("m.id").alias("caller_symbol_id"))
    return raw.join(best, ["file_id", "caller_name"])
