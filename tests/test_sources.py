import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from callweave.plans import indexing
from callweave.plans.store import Store
from callweave.sources import discover, parsers, schemas
from callweave.streaming import watch

TREE = {
    "package.json": json.dumps({"dependencies": {"next": "1"}, "devDependencies": {"express": "1"}}),
    "requirements.txt": "Flask==2\n",
    "tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"]},}}',
    ".gitignore": "*.gen.js\nout/\n!keep.gen.js\n",
    "src/a.ts": "import { helper as h } from '@/lib/b';\nimport fs from 'fs';\nexport function start() { return h(1) + other(); }\nfunction other() { return 2; }\nfunction lost() { return 3; }\n",
    "src/lib/b.ts": "export function helper(x) { return x; }\nexport const Big = () => helper(2);\n",
    "src/x.gen.js": "function g() {}", "src/keep.gen.js": "function k() {}", "out/z.js": "function z() {}", "node_modules/m.js": "function m() {}",
    "py/main.py": "from .util import work\n\nclass Job:\n    def run(self):\n        return work(self)\n\ndef _hidden():\n    pass\n",
    "py/util.py": "def work(x):\n    return len(x)\n",
    "api/openapi.yaml": "openapi: 3.0.0\npaths:\n  /users/{id}:\n    get:\n      operationId: helper\n    post:\n      summary: x\n",
    "api/svc.proto": "service Greeter {\n  rpc Hello (A) returns (B) {}\n}\nservice Other {\n  rpc Bye(A) returns (B);\n}\n",
    "README.md": "x",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory) -> Path:
    top = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    return top


def test_discovery(spark, root):
    got = {r.path: r.language for r in discover.discover(spark, str(root)).collect()}
    assert got == {"src/a.ts": "typescript", "src/lib/b.ts": "typescript", "src/keep.gen.js": "javascript", "py/main.py": "python", "py/util.py": "python"}
    assert {r.path for r in discover.discover(spark, str(root), ["py", "src/lib/**"]).collect()} == {"src/a.ts", "src/keep.gen.js"}
    tree = discover.read_tree(spark, str(root))
    assert discover.detect_frameworks(tree) == ["express", "flask", "nextjs", "node", "pip", "typescript-project"]


def test_nested_ignore_files():
    rules = discover.ignore_rules("", "*.log\n/build\n") + discover.ignore_rules("a", "!x.log\nsub/\n")
    assert discover.ignored("y.log", rules) and not discover.ignored("a/x.log", rules) and discover.ignored("a/sub/f.py", rules) and discover.ignored("build/f.py", rules) and not discover.ignored("c/build/f.py", rules)


def test_schemas(spark, root):
    got = {(r.method, r.path_pattern, r.protocol, r.operation_id) for r in schemas.schema_endpoints(discover.read_tree(spark, str(root))).collect()}
    assert got == {("GET", "/users/{id}", "http", "helper"), ("POST", "/users/{id}", "http", None), ("POST", "/Greeter/Hello", "grpc", None), ("POST", "/Other/Bye", "grpc", None)}
    assert schemas.openapi_paths('{"paths": {"/a": {"get": {}, "$ref": "x"}, "/b": {"put": {"operationId": "o"}}}}') == [("PUT", "/b", "o")]
    assert schemas.tsconfig_aliases(TREE["tsconfig.json"]) == [("@/*", "src/*")] and schemas.tsconfig_aliases("nonsense") == []


def _names(language, source, path="f"):
    p = parsers.REGISTRY[language](source, path)
    return {(s["kind"], s["qualified_name"], s["is_exported"]) for s in p.symbols}, {(c["caller_name"], c["callee_name"]) for c in p.calls}, p


@pytest.mark.parametrize(
    ("language", "source", "symbol", "call"),
    [
        ("python", "class A:\n  def m(self):\n    return f(1)\n", ("method", "A.m", False), ("A.m", "f")),
        ("javascript", "const go = async (x) => { return run(x); };\nmodule.exports = { go };", ("function", "go", True), ("go", "run")),
        ("typescript", "export interface I { a: string }\nexport class C { m(x: number): void { this.n(); } n() {} }", ("method", "C.n", False), ("C.m", "this.n")),
        ("go", "package p\nfunc (s *Svc) Do(a int) error { return Run(a) }\n", ("method", "Svc.Do", True), ("Svc.Do", "Run")),
        ("java", "public class A { public int f(int x) throws E { return new B(x).g(); } }", ("method", "A.f", True), ("A.f", "B")),
        ("rust", "impl T for S { fn go(&self) { println!(\"x\"); S::make(); } }\npub const N: u8 = 1;", ("constant", "N", True), ("S::go", "make")),
        ("csharp", "namespace X.Y { public class A { private void F() { B.C(); } } }", ("method", "A.F", False), ("A.F", "B.C")),
        ("ruby", "module M\n  class A\n    def f(x)\n      if x\n        g(x)\n      end\n    end\n  end\nend\n", ("method", "M::A#f", True), ("M::A#f", "g")),
        ("php", "<?php\nclass A { public function f() { return $this->g(new B()); } }", ("method", "A\\f", True), ("A\\f", "g")),
    ],
)
def test_parsers(language, source, symbol, call):
    symbols, calls, p = _names(language, source)
    assert symbol in symbols and call in calls and p.errors == 0


@pytest.mark.parametrize("n", [300, 1000, 10_000])
def test_long_chains(n):
    got = parsers.REGISTRY["python"]("def f():\n    return a" + ".b()" * n + "\n", "x.py")
    assert [s["name"] for s in got.symbols] == ["f"]
    assert got.errors == 1 or len(got.calls) == n and {c["caller_name"] for c in got.calls} == {"f"}
    assert n > 300 or not got.errors


def test_parsers_never_raise(spark):
    for language in parsers.REGISTRY:
        for source in ("", "}}}}", "((((", "class", "def", "import", "'unclosed", "fn", "function", "\x00", "export {", "type X", "impl"):
            parsers.REGISTRY[language](source, "f")
    bad = parsers.REGISTRY["python"]("def f(:\n  pass", "f")
    assert bad.errors == 1 and bad.symbols[0]["name"] == "f"
    deep = parsers.REGISTRY["python"]("x = " + "[" * 150 + "]" * 150 + "\ny = " + "-" * 3000 + "1\ndef g(): pass\n", "g.py")
    assert "g" in {s["name"] for s in deep.symbols}
    def plugin(source, path):
        raise KeyError(path)

    broken = parsers.parse_files(spark.createDataFrame([("a.zz", "zz", "x"), ("b.py", "python", "def f(): pass")], "path string, language string, content string"), {**{k: v for k, v in parsers.REGISTRY.items() if k == "python"}, "zz": plugin})
    assert {r.path: (r.syntax_error_count, len(r.symbols)) for r in broken.collect()} == {"a.zz": (1, 0), "b.py": (0, 1)}
    rows = spark.createDataFrame([("a.py", "python", None), ("b.x", "none", "x"), ("tests/test_a.rs", "rust", "fn t() {}")], "path string, language string, content string")
    got = {r.path: r for r in parsers.parse_files(rows).collect()}
    assert got["a.py"].syntax_error_count == got["b.x"].syntax_error_count == 1 and got["tests/test_a.rs"].symbols[0].decorators == ["test"]


@pytest.fixture(scope="module")
def indexed(spark, root):
    return indexing.index(spark, {"svc": str(root)}, history=False)


def test_index(spark, indexed):
    s = {r.id: r for r in indexed["symbols"].collect()}
    calls = {(s[r.caller_symbol_id].name, r.callee_name): (s[r.callee_symbol_id].name if r.callee_symbol_id else None, r.resolution) for r in indexed["calls"].collect()}
    assert calls[("start", "h")] == ("helper", "import_guided") and calls[("start", "other")] == ("other", "same_file") and calls[("Big", "helper")] == ("helper", "same_file")
    assert {r.name for r in s.values() if r.is_dead} == {"lost", "_hidden", "k"}
    i = {r.imported_name: r for r in indexed["imports"].collect()}
    assert s[i["h"].resolved_symbol_id].name == "helper" and i["fs"].is_external
    handlers = {(r.method, r.path_pattern): r.handler_symbol_id for r in indexed["api_endpoints"].collect()}
    assert s[handlers[("GET", "/users/{id}")]].name == "helper"
    for name, df in indexed.items():
        from callweave.schema import schema

        assert df.columns == schema(name).names, name


def test_store_and_watch(spark, indexed, tmp_path, root):
    store = Store(spark, str(tmp_path / "store"))
    assert store.generation() == 0 and store.read("calls").count() == 0
    assert store.write(indexed) == 1
    log = tmp_path / "log"
    log.mkdir()
    changes = [
        {"ts": "2026-01-01T00:00:00Z", "path": "src/lib/b.ts", "op": "upsert", "content": "junk"},
        {"ts": "2026-01-01T00:00:01Z", "path": "src/lib/b.ts", "op": "upsert", "content": "export function helper(x) { return extra(x); }\nfunction extra(x) { return x; }\n"},
        {"ts": "2026-01-01T00:00:02Z", "path": "py/util.py", "op": "delete", "content": None},
        {"ts": "2026-01-01T00:00:02Z", "path": "node_modules/q.js", "op": "upsert", "content": "function q() {}"},
        {"ts": "2026-01-01T00:00:03Z", "path": "src/new.ts", "op": "upsert", "content": "export function fresh() { return 1; }\n"},
    ]
    (log / "1.json").write_text("\n".join(map(json.dumps, changes)))
    config = indexing.Config()  # aliases and frameworks are told from the store
    q = watch.watch(spark, watch.change_log(spark, str(log)), store, str(tmp_path / "cp"), config, {"availableNow": True})
    q.awaitTermination()
    assert store.generation() == 2
    assert watch.process(store, spark.createDataFrame([], "ts timestamp, path string, op string, content string"), 0, config) == 2  # delivered again
    other = tmp_path / "tree"
    for name, text in {**TREE, "src/lib/b.ts": changes[1]["content"], "src/new.ts": changes[4]["content"]}.items():
        if name != "py/util.py":
            (other / name).parent.mkdir(parents=True, exist_ok=True)
            (other / name).write_text(text)
    full = indexing.index(spark, {"svc": str(other)}, history=False)
    assert picture(store.read) == picture(full.__getitem__)


def _files(folder, tree):
    for name, text in tree.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    return str(folder)


def test_watch_keeps_frameworks_and_aliases(spark, tmp_path):
    tree = {
        "package.json": '{"dependencies": {"next": "14"}}', "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"~/*": ["app/*"]}}}',
        "app/page.tsx": 'import { helper } from "~/lib/util";\nexport default function Page() { return helper(); }\nfunction loader() { return 1; }\n',
        "app/lib/util.ts": "export function helper() { return inner(); }\nfunction inner() { return 2; }\n", "app/lib/gone.ts": "export function old() { return 3; }\n",
        "app/use.ts": 'import { old } from "~/lib/gone";\nexport function use() { return old(); }\n',
    }
    store = Store(spark, str(tmp_path / "store"))
    first = indexing.index(spark, {"svc": _files(tmp_path / "a", tree)}, history=False)
    ids = {r.path: r.id for r in first["files"].collect()}
    some = {r.file_id: r.id for r in first["symbols"].collect()}
    first["coupling"] = indexing.shaped(spark.createDataFrame([(1, ids["app/use.ts"], ids["app/lib/gone.ts"], 3, 0.5), (2, ids["app/use.ts"], ids["app/page.tsx"], 3, 0.5)], "id long, file_a_id long, file_b_id long, co_changes int, strength double"), "coupling")
    first["symbol_history"] = indexing.shaped(spark.createDataFrame([(1, some[ids["app/lib/gone.ts"]]), (2, some[ids["app/use.ts"]])], "id long, symbol_id long"), "symbol_history")
    first["api_endpoints"] = indexing.shaped(spark.createDataFrame([(1, 1, some[ids["app/lib/gone.ts"]], "GET", "/x")], "id long, service_id long, handler_symbol_id long, method string, path_pattern string"), "api_endpoints")
    store.write(first)
    batches = [
        [("app/lib/gone.ts", "delete", None), ("app/new.ts", "upsert", 'import { helper } from "~/lib/util";\nexport function fresh() { return helper(); }\n')],
        [("tsconfig.json", "upsert", tree["tsconfig.json"].replace("~/*", "#/*")), ("app/new.ts", "upsert", 'import { helper } from "#/lib/util";\nexport function fresh() { return helper(); }\n')],
        [("package.json", "delete", None)],
    ]
    for n, batch in enumerate(batches):
        rows = [(f"2026-01-01 00:0{n}:00", p, op, c) for p, op, c in batch]
        watch.process(store, spark.createDataFrame(rows, "ts string, path string, op string, content string").withColumn("ts", F.to_timestamp("ts")), n)
        for p, op, c in batch:
            tree.pop(p, None)
            tree |= {p: c} if op == "upsert" else {}
        full = indexing.index(spark, {"svc": _files(tmp_path / f"t{n}", tree)}, history=False)
        assert picture(store.read) == picture(full.__getitem__), n
        external = lambda t: sorted((r.imported_name, r.is_external) for r in t("imports").collect())
        assert external(store.read) == external(full.__getitem__), n
    assert [r.id for r in store.read("coupling").collect()] == [2] and [r.id for r in store.read("symbol_history").collect()] == [2]
    assert store.read("api_endpoints").first().handler_symbol_id is None


def test_debounce_batcher():
    d = watch.DebounceBatcher(0.5)
    d.add("a", "upsert", 0.0, "1")
    d.add("b", "delete", 0.3)
    assert d.take(0.7) == [] and not d.ready(0.7)
    d.add("a", "upsert", 0.75, "2")
    assert d.take(1.25) == [("b", "delete", None), ("a", "upsert", "2")] and d.take(9) == []


def test_git_walk_takes_merged_branches(spark, tmp_path):
    import subprocess

    def git(*a, at=0):
        when = f"{1_700_000_000 + at} +0000"
        env = {"PATH": "/usr/bin:/bin:/usr/local/bin", "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "HOME": str(tmp_path), "GIT_CONFIG_NOSYSTEM": "1"}
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, env=env)

    def commit(at, **texts):
        for name, text in texts.items():
            (tmp_path / f"{name}.py").write_text(text)
        git("add", "-A", at=at)
        git("commit", "-m", "x", at=at)

    git("init", "-b", "main")
    commit(1, a="1", b="1")
    git("checkout", "-b", "side")
    commit(2, a="2", é="2")
    git("checkout", "main")
    commit(3, b="3")
    git("merge", "--no-ff", "-m", "m", "side", at=4)
    git("rm", "b.py", at=5)
    git("commit", "-m", "d", at=5)
    got = {}
    for r in schemas.git_commit_files(spark, str(tmp_path)).collect():
        got.setdefault(r.ts - 1_700_000_000, set()).add(r.path)
    assert got == {2: {"a.py", "é.py"}, 3: {"b.py"}, 4: {"a.py", "é.py"}, 5: {"b.py"}}


def picture(t):
    s = t("symbols").join(t("files").select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("sid"), F.concat("path", F.lit("#"), "qualified_name").alias("q"), "is_dead", "is_entry_point")
    a, b = s.select(F.col("sid").alias("caller_symbol_id"), F.col("q").alias("a")), s.select(F.col("sid").alias("callee_symbol_id"), F.col("q").alias("b"))
    c = t("calls").join(a, "caller_symbol_id").join(b, "callee_symbol_id", "left").select("a", "b", "callee_name", "resolution", "confidence")
    return sorted(map(str, c.collect())), sorted(map(str, s.drop("sid").collect())), t("flow_steps").count()


def test_sessions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("2026-01-01T00:00:00.000Z", "a"), ("2026-01-01T00:00:00.300Z", "b"), ("2026-01-01T00:00:05Z", "a"), ("2026-01-01T00:01:00Z", "z")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"ts": t, "path": p, "op": "upsert"}) for t, p in rows))
    q = watch.sessions(watch.change_log(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("runs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("runs").collect()) == [1, 2]


def test_source_slice(spark):
    df = spark.createDataFrame([("a\nb\nc\nd", 2, 3)], "c string, s int, e int")
    assert df.select(discover.source_slice(F.col("c"), F.col("s"), F.col("e")).alias("x"), discover.source_slice(F.col("c"), F.col("s"), F.col("e"), 5).alias("y")).first() == ("b\nc", "a\nb\nc\nd")
