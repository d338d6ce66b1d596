"""The incremental mode: micro-batches of file changes over the same phases as the full index.

A batch holds the last change of each path. Deletes go first; an upsert replaces the file with a new id in its old
service. What pointed at symbols that are gone points nowhere again, and imports, calls, inheritance, entry points, dead code
and flows are computed anew from the merged base, as a full index would. Coupling, history, communities, API matches and
topology wait for the next full index; what they held of files and symbols that are gone is dropped. Each batch is
one generation of the store; a batch that is delivered twice is recognised by its number and skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callweave.operators import resolution
from callweave.plans import indexing
from callweave.plans.checkpoints import settle
from callweave.plans.store import Store
from callweave.schema import schema
from callweave.sources import discover, parsers

BASE = ("services", "files", "symbols", "imports", "calls")


def last_changes(changes: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """(path, op, content): the last change of each accepted path."""
    ok = changes.where(discover.accepted(F.col("path"), list(exclude)))
    return ok.groupBy("path").agg(F.max_by(F.struct("op", "content"), F.struct("ts", F.col("op") == "delete")).alias("m")).select("path", "m.*")


def sessions(changes: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The debounced form on event time: one row for each run of changes without a quiet gap, with its paths."""
    every = F.when(F.col("path").isNotNull(), "all").alias("tree")  # session windows need a key beside them
    return changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap), every).agg(F.collect_set("path").alias("paths"), F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "paths", "n")


def apply_batch(base: dict[str, DataFrame], batch: DataFrame, default_service: int = 1) -> dict[str, DataFrame]:
    """The base relations after a batch (path, op, content) of last changes."""
    batch = settle(batch)
    files = base["files"]
    gone = settle(files.join(batch.select("path"), "path", "left_semi").select(F.col("id").alias("file_id"), "path", "service_id"))
    new = batch.where("op = 'upsert'").join(gone.select("path", "service_id"), "path", "left")
    new = new.select(F.coalesce("service_id", F.lit(default_service)).cast("long").alias("service_id"), "path", F.col("path").alias("absolute_path"), parsers.language_of(F.col("path")).alias("language"), "content")
    fresh = indexing.base_relations(new, base["services"])
    kept = {"files": files.join(gone.select(F.col("file_id").alias("id")), "id", "left_anti")}
    for name in ("symbols", "imports", "calls"):
        kept[name] = base[name].join(gone.select("file_id"), "file_id", "left_anti")
    top = {n: kept_max(base[n]) for n in ("files", "symbols", "imports", "calls")}
    move = lambda df, cols: df.withColumns({c: (F.col(c) + top[t]).cast("long") for c, t in cols.items()})
    out = {"services": base["services"]}
    out["files"] = kept["files"].unionByName(move(fresh["files"], {"id": "files"}))
    out["symbols"] = kept["symbols"].unionByName(move(fresh["symbols"], {"id": "symbols", "file_id": "files"}))
    nothing = {"resolved_file_id": F.lit(None).cast("long"), "resolved_symbol_id": F.lit(None).cast("long")}
    raw_imports = kept["imports"].withColumns(nothing | {"is_external": F.coalesce("was_external", "is_external")})
    out["imports"] = raw_imports.unionByName(move(fresh["imports"], {"id": "imports", "file_id": "files"}))
    calls = kept["calls"].withColumns({"callee_symbol_id": F.lit(None).cast("long"), "confidence": F.lit(0.5), "resolution": F.lit("unresolved")})
    out["calls"] = calls.unionByName(move(fresh["calls"], {"id": "calls", "file_id": "files", "caller_symbol_id": "symbols"}))
    out["symbols"] = out["symbols"].withColumns({"is_entry_point": F.lit(False), "is_dead": F.lit(False)})
    return {k: settle(v.select(*(F.col(f.name).cast(f.dataType) for f in schema(k).fields))) for k, v in out.items()}


def kept_max(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def remaining(store: Store, files: DataFrame, symbols: DataFrame) -> dict[str, DataFrame]:
    """The relations that a batch doesn't compute anew, without what pointed at files or symbols that are gone: pairs and
    histories go, an endpoint or API call stays without its handler, caller or file."""
    f, s = files.select(F.col("id").alias("_f")), symbols.select(F.col("id").alias("_s"))

    def without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
        return df.join(ids, df[column] == ids[ids.columns[0]], "left_semi")

    def cleared(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
        return df.join(ids, df[column] == ids[ids.columns[0]], "left").withColumn(column, F.col(ids.columns[0])).drop(ids.columns[0])

    out = {
        "coupling": without(without(store.read("coupling"), "file_a_id", f), "file_b_id", f), "symbol_history": without(store.read("symbol_history"), "symbol_id", s),
        "heritage": cleared(without(store.read("heritage"), "child_symbol_id", s), "parent_symbol_id", s),
        "api_endpoints": cleared(cleared(store.read("api_endpoints"), "handler_symbol_id", s), "file_id", f),
        "api_calls": cleared(cleared(store.read("api_calls"), "caller_symbol_id", s), "file_id", f),
    }
    return {k: settle(indexing.shaped(v, k)) for k, v in out.items()}


def process(store: Store, changes: DataFrame, batch_id: int, config: indexing.Config | None = None) -> int:
    """Applies one batch of changes (ts, path, op, content) to the store; returns its generation. Frameworks and import
    aliases are told anew from the root files that the index noted, as the batch leaves them."""
    config = config or indexing.Config()
    done = {r.key: r.value for r in store.read("metadata").collect()}
    if int(done.get("last_batch", -1)) >= batch_id:
        return store.generation()
    changes = settle(changes)
    latest = F.max_by(F.struct("op", "content"), F.struct("ts", F.col("op") == "delete")).alias("m")
    for r in changes.where(F.col("path").isin(discover.ROOT_FILES)).groupBy("path").agg(latest).select("path", "m.*").collect():  # a handful of names
        done.pop(f"root:1:{r.path}", None)
        done |= indexing.noted(1, {r.path: r.content or ""}) if r.op == "upsert" else {}
    base = apply_batch({n: store.read(n) for n in BASE}, last_changes(changes, config.exclude))
    tables = indexing.resolved(base, *indexing.told(done, config))
    kept = remaining(store, base["files"], base["symbols"])
    kept["heritage"] = indexing.shaped(resolution.resolve_heritage(kept["heritage"], tables["symbols"]), "heritage")
    tables |= {k: kept[k] for k in kept if k in store.tables()}
    done["last_batch"] = str(batch_id)
    tables["metadata"] = store.spark.createDataFrame(sorted(done.items()), "key string, value string")
    return store.write(tables)


class DebounceBatcher:
    """Changes of one file system watcher, gathered until none has come for ``quiet`` seconds: the driver-side form of
    ``sessions`` for a watcher in the same process. The last change of a path stands; times are the caller's."""

    def __init__(self, quiet: float = 0.5):
        self.quiet, self.held, self.last = quiet, {}, None

    def add(self, path: str, op: str, at: float, content: str | None = None) -> None:
        self.held[path] = (op, content)
        self.last = at

    def ready(self, now: float) -> bool:
        return bool(self.held) and now - self.last >= self.quiet

    def take(self, now: float) -> list[tuple[str, str, str | None]]:
        """(path, op, content) of the batch, deletes first, if the tree has been quiet; else nothing."""
        if not self.ready(now):
            return []
        out = sorted(((p, op, c) for p, (op, c) in self.held.items()), key=lambda r: (r[1] != "delete", r[0]))
        self.held, self.last = {}, None
        return out


def watch(spark: SparkSession, changes: DataFrame, store: Store, checkpoint: str, config: indexing.Config | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Runs ``process`` on every micro-batch of the stream ``changes``; the trigger's interval is the debounce."""
    return (
        changes.writeStream.foreachBatch(lambda df, n: process(store, df, n, config)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()
    )


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of file changes from JSON files that land in ``folder``."""
    return spark.readStream.schema(schema("file_changes")).json(folder)
