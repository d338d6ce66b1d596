"""Point lookups, ordered lists and editor queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.text import escaped


def path_matches(path: Column, wanted: str) -> Column:
    """Equal, or ending in ``/`` and the wanted path."""
    return (path == wanted) | path.endswith("/" + wanted)


def symbol_candidates(symbols: DataFrame, files: DataFrame, wanted: str) -> DataFrame:
    """Symbols of this name or qualified name; if there are none, those of the name after the last colon, or whose
    qualified name ends in it after ``.``, ``:`` or ``/``. Ordered by path, line and id."""
    s = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "name", "qualified_name", "kind", "path", "line_start")
    first = s.where((F.col("name") == wanted) | (F.col("qualified_name") == wanted)).withColumn("stage", F.lit(1))
    tail = wanted.rsplit(":", 1)[-1]
    ends = F.lit(False)
    for sep in ".:/":
        ends = ends | F.col("qualified_name").endswith(sep + tail)
    second = s.where((F.col("name") == tail) | ends).withColumn("stage", F.lit(2))
    both = first.union(second)
    best = both.agg(F.min("stage").alias("best"))  # one row
    return both.join(F.broadcast(best), F.col("stage") == F.col("best")).drop("stage", "best").orderBy("path", "line_start", "id")


def resolve_symbol_by_name(symbols: DataFrame, files: DataFrame, wanted: str, file_hint: str | None = None) -> DataFrame:
    """(id, status): the symbol and ``unique``, or its candidates and ``ambiguous``; no row if there is none.

    Steps, the first that leaves exactly one: all candidates; equal qualified names; qualified names equal after
    ``::``, ``:`` and ``/`` turn to dots, or ending so; those in a file that ends in the hint."""
    c = symbol_candidates(symbols, files, wanted)
    dots = lambda x: F.regexp_replace(x, "::|[:/]", ".")
    plain = wanted.replace("::", ".").replace(":", ".").replace("/", ".")
    hint = (F.col("path").endswith(file_hint)) if file_hint else F.lit(False)
    flags = {"_1": F.lit(True), "_2": F.col("qualified_name") == wanted, "_3": (dots(F.col("qualified_name")) == plain) | dots(F.col("qualified_name")).endswith("." + plain), "_4": hint}
    c = c.withColumns(flags)
    n = c.agg(*(F.count_if(k).alias(f"n{k}") for k in flags))  # one row
    c = c.crossJoin(F.broadcast(n))
    chosen = F.when(F.col("n_1") == 1, F.col("_1")).when(F.col("n_2") == 1, F.col("_2")).when(F.col("n_3") == 1, F.col("_3")).when(F.col("n_4") == 1, F.col("_4"))
    left = F.when(F.col("n_4") > 1, F.col("_4")).otherwise(F.lit(True))
    return c.where(F.coalesce(chosen, left)).select("id", F.when(chosen.isNotNull(), "unique").otherwise("ambiguous").alias("status"))


def file_symbols(symbols: DataFrame, files: DataFrame, wanted: str) -> DataFrame:
    f = files.where(path_matches(F.col("path"), wanted)).select(F.col("id").alias("file_id"))
    return symbols.join(f, "file_id", "left_semi").orderBy("line_start", "id")


def find_file_by_path(files: DataFrame, wanted: str) -> DataFrame:
    return files.where(path_matches(F.col("path"), wanted)).orderBy("id").limit(1)


def dead_symbols(symbols: DataFrame, limit: int = 500) -> DataFrame:
    return symbols.where("is_dead").orderBy("file_id", "line_start", "id").limit(limit)


def parse_error_files(files: DataFrame) -> DataFrame:
    return files.where("parse_error_count > 0").select("id", "path", "parse_error_count")


def parse_health(files: DataFrame, worst: int = 10) -> DataFrame:
    """One row: files with errors, errors, and the worst files as path:count joined by commas."""
    bad = parse_error_files(files)
    total = bad.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("parse_error_count"), F.lit(0)).alias("n_errors"))
    top = bad.orderBy(F.desc("parse_error_count"), "path").limit(worst).agg(F.sort_array(F.collect_list(F.struct((-F.col("parse_error_count")).alias("k"), "path", "parse_error_count"))).alias("w"))
    return total.crossJoin(top).select("n_files", "n_errors", F.array_join(F.transform("w", lambda x: F.concat(x["path"], F.lit(":"), x["parse_error_count"])), ",").alias("worst"))


def symbols_at(symbols: DataFrame, files: DataFrame, positions: DataFrame) -> DataFrame:
    """(path, line, id): for each position the symbol with the smallest span around it. positions: (path, line)."""
    f = files.select(F.col("id").alias("file_id"), "path")
    hit = positions.join(f, "path").join(symbols.select("id", "file_id", "line_start", "line_end"), "file_id").where("line between line_start and line_end")
    return hit.groupBy("path", "line").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "id")).alias("m")).select("path", "line", "m.id")


def goto_definition(symbols: DataFrame, files: DataFrame, calls: DataFrame, positions: DataFrame) -> DataFrame:
    """(path, line, id): the target of the first resolved call on the line, else the symbol there."""
    f = files.select(F.col("id").alias("file_id"), "path")
    target = (
        positions.join(f, "path").join(calls.where("callee_symbol_id is not null").select("file_id", "line", F.col("id").alias("cid"), "callee_symbol_id"), ["file_id", "line"])
        .groupBy("path", "line").agg(F.min(F.struct("cid", "callee_symbol_id")).alias("m")).select("path", "line", F.col("m.callee_symbol_id").alias("target"))
    )
    at = symbols_at(symbols, files, positions)
    return at.join(target, ["path", "line"], "full").select("path", "line", F.coalesce("target", "id").alias("id"))


def references(calls: DataFrame) -> DataFrame:
    """(id, caller, line): direct callers of each symbol and the first line of a call."""
    return calls.where("callee_symbol_id is not null").groupBy(F.col("callee_symbol_id").alias("id"), F.col("caller_symbol_id").alias("caller")).agg(F.min("line").alias("line"))


def hover(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, callers, callees, dead): counts of call rows and the verdict."""
    ins = calls.groupBy(F.col("callee_symbol_id").alias("id")).agg(F.count("*").alias("callers"))
    outs = calls.groupBy(F.col("caller_symbol_id").alias("id")).agg(F.count("*").alias("callees"))
    zero = F.lit(0).cast("long")
    return symbols.join(ins, "id", "left").join(outs, "id", "left").select("id", F.coalesce("callers", zero).alias("callers"), F.coalesce("callees", zero).alias("callees"), F.col("is_dead").alias("dead"))


def code_lens(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, title): the number of references, else ``dead`` for what is dead or not exported."""
    ins = calls.where("callee_symbol_id is not null").groupBy(F.col("callee_symbol_id").alias("id")).agg(F.count("*").alias("n"))
    s = symbols.join(ins, "id", "left")
    title = F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" references"))).when(F.col("is_dead") | ~F.col("is_exported"), "dead").otherwise("0 references")
    return s.select("id", title.alias("title"))


def diagnostics(files: DataFrame, symbols: DataFrame, violations: DataFrame) -> DataFrame:
    """(file_id, line, message): dead code, broken rules and parse errors."""
    dead = symbols.where("is_dead").select("file_id", F.col("line_start").alias("line"), F.concat(F.lit("dead code: "), F.col("name")).alias("message"))
    broken = violations.select(F.col("from_file_id").alias("file_id"), "line", F.concat(F.lit("rule: "), F.col("rule_name")).alias("message"))
    errors = files.where("parse_error_count > 0").select(F.col("id").alias("file_id"), F.lit(1).alias("line"), F.concat(F.col("parse_error_count").cast("string"), F.lit(" parse errors")).alias("message"))
    return dead.unionByName(broken).unionByName(errors)


def heritage_of(heritage: DataFrame, symbol: int) -> DataFrame:
    """(relation, id, kind): parents and children of a symbol."""
    up = heritage.where(F.col("child_symbol_id") == symbol).select(F.lit("parent").alias("relation"), F.col("parent_symbol_id").alias("id"), "kind")
    down = heritage.where(F.col("parent_symbol_id") == symbol).select(F.lit("child").alias("relation"), F.col("child_symbol_id").alias("id"), "kind")
    return up.union(down)


def dashboard_search(symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    if not query or len(query) > 500:
        return symbols.where("false").select("id", "name", "qualified_name")
    like = f"%{escaped(query)}%"
    return symbols.where(F.col("name").ilike(like) | F.col("qualified_name").ilike(like)).select("id", "name", "qualified_name").orderBy("id").limit(limit)


def language_rank(files: DataFrame) -> DataFrame:
    """(service_id, language, n, rank): rank 1 is the service's primary language."""
    return files.groupBy("service_id", "language").agg(F.count("*").alias("n")).withColumn("rank", F.expr("row_number() over (partition by service_id order by n desc, language)"))
