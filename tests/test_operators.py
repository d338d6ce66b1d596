import pytest
from pyspark.sql import functions as F

from callweave.functions.text import _jaro_winkler, glob_regex, normalized_path
from callweave.operators import derive, impact, lookups, metrics, resolution, search
from callweave.plans.graph import connected_components, frontier_bfs


def edges(spark, pairs):
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")


def test_components(spark):
    got = {r.node: r.component for r in connected_components(edges(spark, [(1, 2), (2, 3), (7, 8), (9, 9), (30, 20), *((k, k + 1) for k in range(100, 140))])).collect()}
    assert got[3] == 1 and got[8] == 7 and got[9] == 9 and got[30] == 20 and got[140] == 100
    assert connected_components(edges(spark, [(1, 2)]).where("false")).count() == 0


def test_bfs(spark):
    seeds = spark.createDataFrame([(1, 1), (2, 3)], "key long, node long")
    got = {(r.key, r.node): (r.depth, r.parent) for r in frontier_bfs(seeds, edges(spark, [(1, 2), (2, 3), (1, 3), (3, 1), (3, 3)])).collect()}
    assert got == {(1, 1): (0, None), (1, 2): (1, 1), (1, 3): (1, 1), (2, 3): (0, None), (2, 1): (1, 3), (2, 2): (2, 1)}
    assert frontier_bfs(seeds, edges(spark, [(1, 2), (2, 3)]), 1).count() == 3


def test_cycles(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 5), (4, 5), (9, 9), (6, 10)])
    got = {r.node: r.cycle for r in impact.strongly_connected(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    assert impact.strongly_connected(edges(spark, [(1, 2)])).count() == 0


def test_communities(spark):
    e = edges(spark, [(5, 6), (6, 5), (1, 2), (9, 9)])
    info = {r.id: r for r in impact.communities(None, e)[1].collect()}
    assert [(info[k].symbol_count, info[k].internal_edges, info[k].modularity) for k in (1, 2, 3)] == [(2, 1, 1.0), (2, 1, 1.0), (1, 0, 0.0)]


def test_edit_plan(spark):
    plan = impact.edit_plan(edges(spark, [(1, 2), (2, 3), (4, 3), (8, 9)]), 3).collect()
    assert sorted((r.node, r.depth) for r in plan) == [(1, 2), (2, 1), (3, 0), (4, 1)] and not plan[0].has_cycle
    assert impact.edit_plan(edges(spark, [(1, 2), (2, 2)]), 2).first().has_cycle


def symbols(spark, rows):
    return spark.createDataFrame(rows, "id long, file_id long, name string, qualified_name string, kind string, is_exported boolean, line_start int, line_end int, is_test boolean, is_dead boolean, is_entry_point boolean, signature string")


@pytest.fixture(scope="module")
def small(spark):
    s = symbols(spark, [(1, 1, "foo", "foo", "function", True, 1, 9, False, False, False, "def foo"), (2, 1, "bar", "A.bar", "method", False, 10, 12, False, False, False, "def bar"), (3, 2, "foo", "foo", "function", True, 3, 4, False, False, False, "fn foo"),
                        (4, 2, "A", "A", "class", False, 5, 6, False, False, False, "class A"), (5, 3, "Login_handler", "x.Login_handler", "function", False, 1, 2, False, False, False, "z"), (6, 3, "secret", "secret", "function", False, 3, 3, False, False, False, "z")])
    f = spark.createDataFrame([(1, 1, "src/a.ts", "typescript"), (2, 1, "src/lib/b.ts", "typescript"), (3, 2, "src/store/mod.rs", "rust")], "id long, service_id long, path string, language string")
    return s, f


def test_call_passes(spark, small):
    s, f = small
    i = spark.createDataFrame([(1, 3, "h", 2, False, "foo"), (2, 3, "ext", None, True, None)], "id long, file_id long, imported_name string, resolved_file_id long, is_external boolean, original_name string")
    names = ["h", "secret", "x.secret", "h.foo", "foo", "ext.y", "format!", "console.log", "a.b", "setState", "onSave", "cb", "nope", "bar", "x.bar", "a."]
    c = spark.createDataFrame([(k, n, 3) for k, n in enumerate(names)], "id long, callee_name string, file_id long")
    got = {r.callee_name: (r.callee_symbol_id, r.resolution, r.confidence) for r in resolution.resolve_calls(c, s, f, i).collect()}
    assert got["h"] == (3, "import_guided", 0.98) and got["secret"] == (6, "same_file", 0.95) and got["x.secret"] == (6, "dotted_same_file", 0.85) and got["h.foo"] == (3, "dotted_import_guided", 0.88)
    assert got["foo"] == (3, "import_file_affinity", 0.8) and got["ext.y"][1] == "external" and got["format!"][1] == got["console.log"][1] == "builtin" and got["a.b"][1] == got["a."][1] == "method_call"
    assert got["setState"][1] == got["onSave"][1] == got["cb"][1] == "local" and got["nope"] == got["bar"] == (None, "unresolved", 0.5)  # bar isn't exported
    elsewhere = resolution.resolve_calls(c.where("callee_name = 'foo'").withColumn("file_id", F.lit(1).cast("long")), s.where("id <> 1"), f, i.where("false")).first()
    assert (elsewhere.callee_symbol_id, elsewhere.resolution) == (3, "same_service")


def test_hot_names_resolve_the_same(spark, small, monkeypatch):
    s, f = small
    rows = [(k, n, 1 + k % 3) for k, n in enumerate(["foo", "bar", "x.foo", "y.bar", "nothing", "resolve"] * 5)]
    calls = spark.createDataFrame(rows, "id long, callee_name string, file_id long")
    imports = spark.createDataFrame([(1, 1, "foo", 2, False)], "id long, file_id long, imported_name string, resolved_file_id long, is_external boolean")
    plain = sorted(map(str, resolution.resolve_calls(calls, s, f, imports).collect()))
    monkeypatch.setattr(resolution.hot_values, "__defaults__", (1,))
    assert sorted(map(str, resolution.resolve_calls(calls, s, f, imports).collect())) == plain and len(plain) == len(rows)


def test_api_matches_brute_force(spark):
    """Every endpoint against every url, with wildcards, parameters, odd slashes, short and empty parts."""
    import re

    parts = ["users", "us", "u", "{id}", "orders_x", "a%b", "", "resource-with-a-long-name", "Ünï"]
    paths = [None, "", "/", "users", "{id}", "%", *(f"/{a}" for a in parts), *(f"/{a}/{b}" for a in parts for b in parts[:5]), *(f"{a}/{b}" for a in parts[:3] for b in parts[:4])]
    endpoints = [(k, k % 3, "GET" if k % 4 else "POST", p, "http" if k % 5 else "grpc") for k, p in enumerate(paths)]
    urls = [None, "", "/", "https://h/users/7", "/US/{id}", "/users", "xusers", "/orders-x/us", "/acccb/u", "/RESOURCE-with-a-long-name-and-more", "h/ünï/users/orders_x", "/u/us", "{id}", "/{id}/users"]
    calls = [(k, "GET" if k % 3 else "POST", u, "http" if k % 2 else "grpc") for k, u in enumerate(urls * 3)]
    e = spark.createDataFrame(endpoints, "id long, service_id long, method string, path_pattern string, protocol string")
    c = spark.createDataFrame(calls, "id long, method string, url_pattern string, protocol string")

    def like(text, pattern):
        return re.fullmatch("".join(".*" if x == "%" else "." if x == "_" else re.escape(x) for x in pattern.lower()), text.lower(), re.S)

    got = {r.id: r.endpoint_id for r in resolution.resolve_api_calls(c, e).collect()}
    boost = {r.id: r.endpoint_id for r in resolution.boost_schema_matches(c, e).collect()}
    assert len(got) == len(boost) == len(calls)
    for k, m, u, proto in calls:
        assert got[k] == min((i for i, _, em, p, _ in endpoints if u is not None and p is not None and em == m and like(u, f"%{p}%")), default=None), u
        want = []
        for i, _, em, p, ep in endpoints:
            if u is None or p is None or em != m or ep not in (proto, "http"):
                continue
            fixed = "/".join(x for x in p.split("/") if not x.startswith("{"))
            if p in u or fixed not in ("", "/") and fixed.lower() in u.lower():
                want.append(i)
        assert boost[k] == min(want, default=None), u


def test_handlers_brute_force(spark):
    import re

    names = ["getUsers", "get_users", "forgetUsers", "post_orders", "getX", "list", "gEt_a_b", "getOrdersById"]
    symbols = [(k, n, f"Api.{n}", "function" if k % 3 else "class") for k, n in enumerate(names)]
    asks = [(k, m, p, o) for k, (m, p, o) in enumerate([("get", "/users", None), ("get", "/users", "getUsers"), ("get", "/a/b", None), ("post", "/orders/", None), ("get", "/x", "users"), ("get", "/zzz", "GETUSERS"), ("get", "/", None), ("get", "/{id}", None), ("get", "/or_ers", None), ("get", "/u", ""), ("get", "/s", "x")])]
    e = spark.createDataFrame(asks, "id long, method string, path_pattern string, operation_id string")
    got = {r.id: r.handler_symbol_id for r in resolution.find_handlers(e, spark.createDataFrame(symbols, "id long, name string, qualified_name string, kind string")).collect()}
    for k, m, p, o in asks:
        op = [i for i, n, q, _ in symbols if o and (n == o or q.lower().endswith(o.lower()))]
        made = f"{m}_{re.sub('[{}]', '', p.lstrip('/').replace('/', '_'))}".lower()
        last = re.sub("[{}]", "", p.rstrip("/").split("/")[-1]).lower()
        pattern = ".*" + m + ".*" + "".join("." if x == "_" else re.escape(x) for x in last) + ".*"
        inside = [i for i, n, _, kind in symbols if last and kind in ("function", "method") and re.fullmatch(pattern, n.lower())]
        want = min(op, default=None) if op else min((i for i, n, _, _ in symbols if n.lower() == made), default=min(inside, default=None))
        assert got[k] == want, (k, m, p, o)


def test_shortest_paths(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 1)])
    pairs = spark.createDataFrame([(1, 5), (4, 3), (9, 1)], "src long, dst long")
    got = {}
    for r in impact.shortest_paths(e, pairs).orderBy("step").collect():
        got.setdefault((r.src, r.dst), []).append(r.node)
    assert got == {(1, 5): [1, 2, 4, 5], (4, 3): [4, 5, 1, 3]}
    assert impact.shortest_paths(e, pairs.select("src").where("src = 1")).select("dst").distinct().count() == 5


def test_imports(spark, small):
    s, f = small
    rows = [(1, 1, "foo", "./lib/b", False), (2, 1, "foo", "@/lib/b.ts", True), (3, 1, "x", "react", True), (4, 3, "bar", "crate::store::bar", False), (5, 1, "y", "./lib", False)]
    i = spark.createDataFrame(rows, "id long, file_id long, imported_name string, module_path string, is_external boolean")
    files = f.union(spark.createDataFrame([(9, 1, "src/lib/index.js", "javascript")], f.schema))
    got = {r.id: (r.resolved_file_id, r.resolved_symbol_id, r.is_external) for r in resolution.resolve_imports(i, files, s, [("@/*", "./src/*")]).collect()}
    assert got == {1: (2, 3, False), 2: (2, 3, False), 3: (None, None, True), 4: (3, None, False), 5: (9, None, False)}


def test_entry_points(spark, small):
    s, f = small
    assert {r.id for r in derive.with_entry_points(s, f).where("is_entry_point").collect()} == {2, 5}  # a class member, a handler
    assert {r.id for r in derive.with_entry_points(s, f, configured=["secret"]).where("is_entry_point").collect()} == {2, 5, 6}


def test_ambiguity(spark, small):
    s, f = small
    got = lambda *a: sorted(map(tuple, lookups.resolve_symbol_by_name(s, f, *a).collect()))
    assert got("secret") == [(6, "unique")] and got("foo") == [(1, "ambiguous"), (3, "ambiguous")] and got("foo", "a.ts") == [(1, "unique")] and got("A::bar") == [(2, "unique")] and got("zzz") == []


def test_history_and_volatile(spark, small):
    s, f = small
    day = 86400
    lines = spark.createDataFrame([("src/a.ts", k, 100 * day + k * day, f"a{k % 2}", f"c{k}") for k in range(1, 10)] + [("src/a.ts", 99, 1, "z", "z")], "path string, line int, ts long, author string, commit string")
    got = {r.symbol_id: r for r in derive.symbol_history(derive.blame_to_symbols(lines, s, f), F.lit(110 * day)).collect()}
    assert set(got) == {1} and (got[1].modification_count, got[1].author_count, got[1].is_volatile) == (9, 2, True)
    assert not derive.symbol_history(derive.blame_to_symbols(lines, s, f), F.lit(200 * day)).first().is_volatile


def test_coupling(spark, small):
    _, f = small
    c = spark.createDataFrame([(k, 0, p) for k in "xyz" for p in ("src/a.ts", "src/lib/b.ts")] + [("w", 0, "src/a.ts")], "commit string, ts long, path string")
    assert [tuple(r) for r in derive.coupling(c, f).collect()] == [(1, 2, 3, 1.0)]


def test_search(spark, small):
    s, _ = small
    assert {r.id for r in search.fts_search(s, "login hand").collect()} == {5}  # words split at the underscore
    assert [r.id for r in search.like_search(s, "%").collect()] == []
    got = [r.id for r in search.search(s, "fooo").collect()]
    assert got[:2] == [1, 3] and len(got) == len(set(got))
    assert search.fts_search(s, "x" * 600).count() == 0 and lookups.dashboard_search(s, "").count() == 0


def test_file_risk_and_health(spark, small):
    s, f = small
    calls = spark.createDataFrame([(1, 3, 1)], "id long, caller_symbol_id long, callee_symbol_id long")
    h = spark.createDataFrame([(1, 25, 5, True)], "symbol_id long, modification_count long, author_count long, is_volatile boolean")
    cp = spark.createDataFrame([(1, 2, 8, 0.75)], "file_a_id long, file_b_id long, co_changes long, strength double")
    got = {r.id: r for r in metrics.file_risk(metrics.file_risk_data(f, s, calls, h, cp)).collect()}
    assert got[1].confidence == 1.0 and abs(got[1].risk_score - round((25 / 50 + 0.5 * 0.1 + 0.5 * 0.75 + 1 / 50) / 4, 3)) < 1e-9 and got[3].confidence == 0.5
    assert metrics.hotspots(s, calls, h).first().id == 1


def test_text(spark):
    df = spark.createDataFrame([("a/./b/../c//d",), ("../x",), ("",)], "p string")
    assert [r[0] for r in df.select(normalized_path(F.col("p"))).collect()] == ["a/c/d", "x", ""]
    assert abs(_jaro_winkler("MARTHA", "MARHTA") - 0.9611) < 1e-4 and _jaro_winkler("", "") == 1.0 and _jaro_winkler("a", "") == 0.0
    import re

    assert re.match(glob_regex("src/*.rs"), "src/a/b.rs") and not re.match(glob_regex("src/*.rs"), "lib/src/a.rs")


def test_partitioning_changes_nothing(spark, small):
    s, f = small
    i = spark.createDataFrame([], "id long, file_id long, imported_name string, resolved_file_id long, is_external boolean, original_name string")
    c = spark.createDataFrame([(k, "foo", 3) for k in range(20)], "id long, callee_name string, file_id long")
    a = sorted(map(str, resolution.resolve_calls(c, s, f, i).collect()))
    assert a == sorted(map(str, resolution.resolve_calls(c.repartition(7), s.repartition(5), f.repartition(3), i).collect()))
