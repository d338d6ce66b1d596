"""The tool surface: 32 named questions to an indexed workspace, answered as DataFrames or JSON.

``Workspace`` holds the relations of one store generation. ``ask(name, **parameters)`` returns the DataFrame of a tool,
or several by name for a tool whose answer has parts; ``answer`` the same as a JSON text whose rows are bounded by ``limit``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators import derive, impact, lookups, metrics, search
from callweave.plans.checkpoints import settle
from callweave.plans.store import Store
from callweave.schema import TABLES


class Ambiguous(LookupError):
    def __init__(self, wanted: str, candidates: list[int]):
        super().__init__(f"{wanted} is ambiguous")
        self.candidates = candidates


class Workspace:
    def __init__(self, spark: SparkSession, relations: dict[str, DataFrame]):
        self.spark, self.t = spark, relations

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Workspace:
        store = Store(spark, folder)
        now = store.generation()
        return Workspace(spark, {t: store.read(t, now) for t in TABLES if t not in ("commit_files", "blame_lines", "file_changes")})

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["t"][name]
        except KeyError as e:
            raise AttributeError(name) from e

    @cached_property
    def edges(self) -> DataFrame:
        return settle(impact.call_edges(self.calls))

    @cached_property
    def index(self) -> search.Index:
        return search.index_of(self.symbols, settled=True)

    def symbol(self, wanted: str, file: str | None = None) -> int:
        """The id of a symbol by name; LookupError if there is none, Ambiguous if there are several."""
        rows = lookups.resolve_symbol_by_name(self.symbols, self.files, wanted, file).limit(100).collect()
        if not rows:
            raise LookupError(wanted)
        if rows[0].status != "unique":
            raise Ambiguous(wanted, sorted(r.id for r in rows))
        return rows[0].id

    def _one(self, wanted: str, name: str) -> DataFrame:
        return self.spark.createDataFrame([(self.symbol(wanted),)], f"{name} long")

    def _key(self, wanted: str) -> DataFrame:
        k = self.symbol(wanted)
        return self.spark.createDataFrame([(k, k)], "key long, node long")

    def _named(self, df: DataFrame, column: str = "id") -> DataFrame:
        s = self.symbols.select(F.col("id").alias(column), "name", "qualified_name", "kind", "file_id")
        return df.join(s, column).join(self.files.select(F.col("id").alias("file_id"), "path"), "file_id")

    def _changed(self, paths: list[str]) -> DataFrame:
        from callweave.operators.resolution import resolve_paths

        return resolve_paths(self.spark.createDataFrame([(p,) for p in paths], "path string"), self.symbols, self.files)

    def _file(self, path: str) -> int:
        row = lookups.find_file_by_path(self.files, path).first()
        if row is None:
            raise LookupError(path)
        return row.id

    def _around(self, symbol: str) -> dict[str, DataFrame]:
        """The symbol, its callers, callees and coupled files, and what parsing warned of."""
        k = self.symbol(symbol)
        own = self.symbols.where(F.col("id") == k)
        ins = impact.dependents(self.calls, self.imports, self.symbols, self.spark.createDataFrame([(k,)], "target long")).select("id").distinct()
        outs = impact.dependencies(self.calls, self.spark.createDataFrame([(k,)], "source long")).select("id")
        path = self.files.select(F.col("id").alias("partner"), "path")
        return {
            "symbol": own.join(self.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "name", "qualified_name", "kind", "path", "line_start", "line_end", "is_dead", "is_test"),
            "callers": self._named(ins).orderBy("id"), "callees": self._named(outs).orderBy("id"),
            "coupled_files": derive.file_couplings(self.coupling, own.first().file_id).join(path, "partner").orderBy(F.desc("strength"), "path"), "parse_warnings": lookups.parse_error_files(self.files),
        }

    def _file_summary(self, path: str) -> dict[str, DataFrame]:
        k = self._file(path)
        return {
            "file": self.files.where(F.col("id") == k).select("id", "path", "language", "parse_error_count"), "symbols": self.symbols.where(F.col("file_id") == k).orderBy("line_start", "id"),
            "imports": self.imports.where(F.col("file_id") == k).orderBy("line", "id").withColumn("resolved", F.col("resolved_symbol_id").isNotNull()),
        }

    def _boundaries(self) -> dict[str, DataFrame]:
        members = self.symbols.where("community_id is not null").select("id", "community_id")
        return {
            "summary": derive.boundary_summary(self.communities), "modules": self.communities.orderBy(F.desc("symbol_count"), "id"), "top_files": derive.boundaries(members, self.symbols, self.files).orderBy("community_id", "rank"),
            "cross_boundary_calls": derive.cross_community_calls(members, self.calls).orderBy(F.desc("n"), "from_community", "to_community"),
        }

    def _blast(self, symbol: str, max_depth: int = 10) -> dict[str, DataFrame]:
        hit = settle(impact.blast_radius(self.edges, self._key(symbol), max_depth))
        return {"summary": impact.blast_summary(hit, self.symbols, self.files), "affected": self._named(hit, "node").orderBy("depth", "node")}

    def _diff(self, paths: list[str], max_depth: int = 5) -> dict[str, DataFrame]:
        parts = impact.diff_impact(self.symbols, self.files, self.edges, self._changed(paths), max_depth)
        return {"affected_symbol_details": parts["details"].orderBy("key", "depth", "id").limit(50), "affected_tests": parts["tests"].orderBy("name"), "review_focus": parts["focus"]}

    def ask(self, tool: str, **p) -> DataFrame | dict[str, DataFrame]:
        return TOOLS[tool](self, **p)

    def answer(self, tool: str, limit: int = 500, **p) -> str:
        def rows(df: DataFrame) -> list:
            return [json.loads(r) for r in df.limit(limit).select(F.to_json(F.struct("*")).alias("j")).toPandas().j]

        try:
            got = self.ask(tool, **p)
            return json.dumps({"tool": tool} | ({k: rows(v) for k, v in got.items()} if isinstance(got, dict) else {"rows": rows(got)}))
        except Ambiguous as e:
            return json.dumps({"tool": tool, "status": "ambiguous", "candidates": e.candidates})
        except LookupError as e:
            return json.dumps({"tool": tool, "status": "not_found", "wanted": str(e)})


def _dependency_path(w: Workspace, source: str, target: str) -> DataFrame:
    pair = w.spark.createDataFrame([(w.symbol(source), w.symbol(target))], "src long, dst long")
    return w._named(impact.shortest_paths(w.edges, pair), "node").orderBy("step")


def _cycles(w: Workspace) -> DataFrame:
    return impact.detect_cycles(w.edges, w.symbols)


def _file_risk(w: Workspace, path: str) -> DataFrame:
    data = metrics.file_risk_data(w.files, w.symbols, w.calls, w.symbol_history, w.coupling)
    return metrics.file_risk(data).where(lookups.path_matches(F.col("path"), path))


def _health(w: Workspace) -> DataFrame:
    return metrics.codebase_health(w.symbols, _cycles(w).agg(F.count("*").alias("n_cycles")), w.coupling, w.communities)


def _links(w: Workspace) -> DataFrame:
    return impact.file_links(w.calls, w.imports, w.symbols)


#: The tools by name; each takes the workspace and its own parameters.
TOOLS: dict[str, Callable[..., DataFrame]] = {
    "search_symbol": lambda w, query, limit=20, fuzzy=True: search.search(w.symbols, query, limit, fuzzy, w.index),
    "get_context": lambda w, symbol: w._around(symbol),
    "get_imports": lambda w, path: w.imports.where(F.col("file_id") == w._file(path)).orderBy("line", "id"),
    "get_dependents": lambda w, symbol: w._named(impact.dependents(w.calls, w.imports, w.symbols, w._one(symbol, "target"))),
    "get_dependencies": lambda w, symbol: w._named(impact.dependencies(w.calls, w._one(symbol, "source"))),
    "get_call_chain": lambda w, symbol: impact.call_chain(w.edges, w.symbol(symbol), w.symbols),
    "blast_radius": lambda w, symbol, max_depth=10: w._blast(symbol, max_depth),
    "detect_cycles": _cycles,
    "get_dependency_path": _dependency_path,
    "find_dead_code": lambda w: lookups.dead_symbols(w.symbols),
    "get_file_summary": lambda w, path: w._file_summary(path),
    "get_complexity": lambda w: metrics.counts(w.files, w.symbols, w.calls),
    "get_boundaries": lambda w: w._boundaries(),
    "diff_impact": lambda w, paths, max_depth=5: w._diff(paths, max_depth),
    "affected_tests": lambda w, paths: impact.affected_tests(w.symbols, w.edges, w._changed(paths), by_name=True),
    "compute_file_risk": _file_risk,
    "propose_edit_plan": lambda w, symbol: w._named(impact.edit_plan(w.edges, w.symbol(symbol)), "node").orderBy("depth", "node"),
    "why_symbol": lambda w, symbol: w._around(symbol) | w._blast(symbol, 5),
    "get_heritage": lambda w, symbol: lookups.heritage_of(w.heritage, w.symbol(symbol)),
    "get_execution_flows": lambda w, symbol: impact.execution_flows(w.flow_steps, w.symbol(symbol)),
    "get_symbol_history": lambda w, symbol: w.symbol_history.where(F.col("symbol_id") == w.symbol(symbol)),
    "get_coupling": lambda w, limit=50: derive.top_coupling_pairs(w.coupling, w.files, metrics.module_of(F.col("path")), limit),
    "get_communities": lambda w: w.communities.orderBy(F.desc("symbol_count"), "id"),
    "get_api_endpoints": lambda w: w.api_endpoints.orderBy("path_pattern", "method", "id"),
    "get_file_dependencies": lambda w, path: impact.file_dependencies(_links(w)).where(F.col("file_id") == w._file(path)),
    "get_file_dependents": lambda w, path: impact.file_dependencies(_links(w), True).where(F.col("file_id") == w._file(path)),
    "get_symbol_health": lambda w, symbol: metrics.symbol_health(w.symbols, w.calls, w.symbol_history).where(F.col("id") == w.symbol(symbol)),
    "get_complexity_hotspots": lambda w, limit=50: metrics.hotspots(w.symbols, w.calls, w.symbol_history, limit),
    "get_code_smells": lambda w: metrics.code_smells(w.symbols, w.calls, w.symbol_history),
    "get_codebase_health": _health,
    "get_entry_points": lambda w, category=None, limit=100: derive.entry_points(w.symbols, w.files, w.api_endpoints, category, limit),
    "get_god_objects": lambda w, threshold=20, limit=10: metrics.god_objects(w.symbols, w.calls, threshold, limit),
}
