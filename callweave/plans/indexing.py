"""The full index: from a tree of sources to all relations, each phase a function of DataFrames.

Order: structure, parse, imports, calls, inheritance, entry points, dead code, flows, coupling, history, schema
endpoints, API matches, topology, communities. Inheritance and API calls come from the caller. Ids are ranks in a total order (files by service and path, symbols by
file and place), so two runs over the same tree agree.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators import derive, impact, resolution
from callweave.plans.checkpoints import settle
from callweave.schema import schema
from callweave.sources import discover, parsers, schemas


@dataclass
class Config:
    exclude: list[str] = field(default_factory=list)
    entry_points: list[str] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    aliases: list[tuple[str, str]] = field(default_factory=list)

    @staticmethod
    def read(text: str | None) -> Config:
        """From TOML; unknown keys are ignored."""
        import tomllib

        raw = tomllib.loads(text or "")
        return Config(raw.get("exclude", []), raw.get("entry_points", []), raw.get("rules", []))


def shaped(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns and types of a relation; columns that it lacks are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with id from 1 in the total order of ``order`` (range partitions, numbered each on its own)."""
    key = F.struct(*order)
    return impact.dense_ids(df.withColumn("_key", key), "_key").drop("_key")


def base_relations(files: DataFrame, services: DataFrame) -> dict[str, DataFrame]:
    """files (service_id, path, language, content): the relations that parsing gives, before resolution."""
    fs = settle(numbered(files, "service_id", "path"))
    parsed = settle(fs.select("id", "path").join(parsers.parse_files(fs), "path"))
    s = parsed.select(F.col("id").alias("file_id"), F.posexplode("symbols").alias("pos", "s")).select("file_id", "pos", "s.*")
    symbols = settle(numbered(s, "file_id", "pos").drop("pos").withColumns({
        "is_test": F.exists("decorators", lambda d: (d == "test") | d.startswith("test(") | d.startswith("pytest.")), "is_entry_point": F.lit(False), "is_dead": F.lit(False),
    }))
    i = parsed.select(F.col("id").alias("file_id"), F.posexplode("imports").alias("pos", "s")).select("file_id", "pos", "s.*")
    c = parsed.select(F.col("id").alias("file_id"), F.posexplode("calls").alias("pos", "s")).select("file_id", "pos", "s.*")
    calls = numbered(resolution.ingest_calls(c, symbols), "file_id", "pos").drop("pos", "caller_name")
    errors = parsed.select("id", F.col("syntax_error_count").alias("parse_error_count"))
    return {
        "services": shaped(services, "services"), "files": settle(shaped(fs.join(errors, "id"), "files")), "symbols": settle(shaped(symbols, "symbols")),
        "imports": settle(shaped(numbered(i, "file_id", "pos").withColumn("was_external", F.col("is_external")), "imports")), "calls": settle(shaped(calls.withColumn("resolution", F.lit("unresolved")), "calls")),
    }


def resolved(base: dict[str, DataFrame], config: Config, frameworks: list[str] = ()) -> dict[str, DataFrame]:
    """Imports, calls, entry points, dead code and flows from the parsed relations: also what each watch batch reruns."""
    files, symbols = base["files"], base["symbols"]
    imports = settle(resolution.resolve_imports(base["imports"], files, symbols, config.aliases))
    calls = settle(resolution.resolve_calls(base["calls"], symbols, files, imports))
    marked = settle(derive.with_entry_points(symbols, files, [*frameworks, "node"], config.entry_points))
    dead = settle(impact.with_dead(marked, calls))
    steps = impact.flows(dead, impact.call_edges(calls))
    flow = dead.where("is_entry_point").select("id", F.col("id").alias("entry_symbol_id"), F.concat(F.lit("flow:"), "name").alias("name"))
    violations = derive.check_rules(imports, files, config.rules) if config.rules else None
    out = base | {
        "imports": shaped(imports, "imports"), "calls": shaped(calls, "calls"), "symbols": shaped(dead, "symbols"), "flows": shaped(flow, "flows"),
        "flow_steps": shaped(numbered(steps, "flow_id", "step_order"), "flow_steps"),
    }
    if violations is not None:
        out["rule_violations"] = shaped(numbered(violations, "rule_name", "from_file_id", "to_file_id", "line"), "rule_violations")
    return out


def noted(service: int, top: dict[str, str]) -> dict[str, str]:
    """The root files of a service as entries of the metadata relation, from which a watch batch knows them."""
    return {f"root:{service}:{path}": content for path, content in top.items()}


def told(metadata: dict[str, str], config: Config) -> tuple[Config, list[str]]:
    """The configuration with the aliases, and the frameworks, that the root files in ``metadata`` tell."""
    tops: dict[int, dict[str, str]] = {}
    for key, content in metadata.items():
        if key.startswith("root:"):
            _, service, path = key.split(":", 2)
            tops.setdefault(int(service), {})[path] = content
    aliases = [*config.aliases, *schemas.tsconfig_aliases(tops.get(1, {}).get("tsconfig.json"))]
    frameworks = sorted({f for top in tops.values() for f in discover.frameworks_of(top)})
    return Config(config.exclude, config.entry_points, config.rules, aliases), frameworks


def index(spark: SparkSession, roots: dict[str, str], config: Config | None = None, as_of: int | None = None, history: bool = True, given: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All relations of the services in ``roots`` (name to folder); nothing is written.

    as_of: epoch seconds to which volatility refers, now by default. history: whether to ask git. given: heritage
    (child_symbol_id, parent_name, kind) and api_calls, which no parser finds; their targets and the topology follow."""
    config, given, metadata = config or Config(), given or {}, {}
    names = sorted(roots)
    trees = {n: settle(discover.read_tree(spark, roots[n])) for n in names}
    services = spark.createDataFrame([(k, n, "microservice", roots[n]) for k, n in enumerate(names, 1)], "id long, name string, type string, repo_path string")
    parts = None
    for k, n in enumerate(names, 1):
        tree = trees[n]
        mine = tree.where(discover.accepted(F.col("path"), config.exclude, discover.tree_rules(tree)))
        mine = mine.select(F.lit(k).cast("long").alias("service_id"), "path", F.concat(F.lit(roots[n].rstrip("/") + "/"), "path").alias("absolute_path"), parsers.language_of(F.col("path")).alias("language"), "content", F.col("mtime").alias("last_modified"))
        parts = mine if parts is None else parts.union(mine)
        metadata |= noted(k, discover.root_files(tree))
    base = base_relations(parts, services)
    out = resolved(base, *told(metadata, config))
    out["metadata"] = spark.createDataFrame(sorted(metadata.items()), schema("metadata"))
    if "heritage" in given:
        h = resolution.resolve_heritage(given["heritage"], out["symbols"])
        out["heritage"] = shaped(numbered(h, "child_symbol_id", "parent_name"), "heritage")
    edges = settle(impact.call_edges(out["calls"]))
    members, info = impact.communities(out["symbols"], edges)
    out["communities"] = shaped(info, "communities")
    out["symbols"] = shaped(out["symbols"].drop("community_id").join(members, "id", "left"), "symbols")
    if history:
        commits = blame = None
        for k, n in enumerate(names, 1):
            c = schemas.git_commit_files(spark, roots[n])
            b = schemas.git_blame(spark, roots[n], base["files"].where(F.col("service_id") == k))
            commits, blame = (c, b) if commits is None else (commits.union(c), blame.union(b))
        pairs = derive.coupling(commits, base["files"])
        out["coupling"] = shaped(numbered(pairs, "file_a_id", "file_b_id"), "coupling")
        rows = derive.blame_to_symbols(blame, out["symbols"], base["files"])
        done = derive.symbol_history(rows, F.lit(int(time.time()) if as_of is None else as_of))
        out["symbol_history"] = shaped(numbered(done, "symbol_id"), "symbol_history")
    found = None
    for k, n in enumerate(names, 1):
        e = schemas.schema_endpoints(trees[n]).withColumn("service_id", F.lit(k).cast("long"))
        found = e if found is None else found.unionByName(e)
    e = settle(numbered(found, "service_id", "path_pattern", "method", "protocol"))
    e = e.join(resolution.find_handlers(e, out["symbols"]), "id").join(base["files"].select("service_id", "path", F.col("id").alias("file_id")), ["service_id", "path"], "left")
    out["api_endpoints"] = settle(shaped(e, "api_endpoints"))
    if "api_calls" in given:
        api = settle(shaped(given["api_calls"] if "id" in given["api_calls"].columns else numbered(given["api_calls"], "service_id", "url_pattern", "method"), "api_calls"))
        hit = resolution.resolve_api_calls(api, out["api_endpoints"]).select("id", F.col("endpoint_id").alias("resolved_endpoint_id"), F.col("endpoint_service_id").alias("resolved_service_id"))
        schema_hit = resolution.boost_schema_matches(api, out["api_endpoints"].where("schema_source is not null")).select("id", F.col("endpoint_id").alias("_schema"))
        service_of = out["api_endpoints"].select(F.col("id").alias("_schema"), F.col("service_id").alias("_service"))
        api = api.drop("resolved_endpoint_id", "resolved_service_id").join(hit, "id").join(schema_hit, "id").join(service_of, "_schema", "left")
        api = api.withColumns({"resolved_endpoint_id": F.coalesce("resolved_endpoint_id", "_schema"), "resolved_service_id": F.coalesce("resolved_service_id", "_service")})
        out["api_calls"] = settle(shaped(api, "api_calls"))
        out["service_edges"] = shaped(numbered(derive.service_topology(out["api_calls"]), "from_service_id", "to_service_id", "protocol"), "service_edges")
    return out
