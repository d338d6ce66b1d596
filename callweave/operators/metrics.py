"""Fan-in and fan-out, hotspots, smells, risk and health: aggregates first, one join per aggregate, then expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_up(c: Column, digits: int = 3) -> Column:
    """``c`` rounded after scaling, so that halves go up as they do in floating point."""
    scale = float(10**digits)
    return F.round(c * scale) / scale


def fan(calls: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out): distinct callers and distinct resolved callees of each symbol with a call."""
    pairs = calls.where("callee_symbol_id is not null").select("caller_symbol_id", "callee_symbol_id").distinct()
    ins = pairs.groupBy(F.col("callee_symbol_id").alias("id")).agg(F.count("*").alias("fan_in"))
    outs = pairs.groupBy(F.col("caller_symbol_id").alias("id")).agg(F.count("*").alias("fan_out"))
    return ins.join(outs, "id", "full").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def with_fan(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return symbols.join(fan(calls), "id", "left").withColumns({k: F.coalesce(k, zero) for k in ("fan_in", "fan_out")})


def with_history(symbols: DataFrame, history: DataFrame) -> DataFrame:
    h = history.select(F.col("symbol_id").alias("id"), "modification_count", "author_count", "is_volatile")
    return symbols.join(h, "id", "left")


def hotspots(symbols: DataFrame, calls: DataFrame, history: DataFrame, limit: int = 50) -> DataFrame:
    """Neither tests nor dead; score = fan_in + fan_out + modifications / 10 + 10 if volatile."""
    s = with_history(with_fan(symbols.where("not is_test and not is_dead"), calls), history)
    mods = F.coalesce("modification_count", F.lit(0))
    volatile = F.coalesce("is_volatile", F.lit(False))
    score = F.col("fan_in") + F.col("fan_out") + mods * 0.1 + F.when(volatile, 10.0).otherwise(0.0)
    return s.select("id", "qualified_name", "fan_in", "fan_out", mods.cast("long").alias("modifications"), volatile.alias("is_volatile"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def god_objects(symbols: DataFrame, calls: DataFrame, threshold: int = 20, limit: int | None = 10) -> DataFrame:
    s = with_fan(symbols.where("not is_test and not is_dead"), calls).where(F.col("fan_in") >= threshold).select("id", "name", "qualified_name", "kind", "file_id", "fan_in", "fan_out")
    return s if limit is None else s.orderBy(F.desc("fan_in"), "name", "id").limit(limit)


def code_smells(symbols: DataFrame, calls: DataFrame, history: DataFrame) -> DataFrame:
    """One row for each smell of each symbol: (id, smell, severity)."""
    s = with_history(with_fan(symbols, calls), history)
    mods, volatile = F.coalesce("modification_count", F.lit(0)), F.coalesce("is_volatile", F.lit(False))
    found = F.array(
        F.struct((volatile & (mods > 10)).alias("hit"), F.lit("high_volatility").alias("smell"), F.when(mods > 25, "high").otherwise("medium").alias("severity")),
        F.struct((F.col("fan_in") > 5).alias("hit"), F.lit("high_fan_in").alias("smell"), F.when(F.col("fan_in") > 15, "high").otherwise("medium").alias("severity")),
        F.struct((F.col("fan_out") > 8).alias("hit"), F.lit("high_fan_out").alias("smell"), F.when(F.col("fan_out") > 15, "high").otherwise("medium").alias("severity")),
        F.struct(F.col("is_dead").alias("hit"), F.lit("dead_code").alias("smell"), F.lit("medium").alias("severity")),
    )
    return s.select("id", F.explode(F.filter(found, lambda x: x["hit"])).alias("x")).select("id", "x.smell", "x.severity")


def counts(files: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: files, symbols, calls, resolved (anything but unresolved), dead, and the resolution rate."""
    f = files.agg(F.count("*").alias("files"))
    s = symbols.agg(F.count("*").alias("symbols"), F.count_if("is_dead").alias("dead"))
    c = calls.agg(F.count("*").alias("calls"), F.count_if(F.col("resolution") != "unresolved").alias("resolved"))
    rate = F.coalesce(F.try_divide(F.col("resolved").cast("double"), F.col("calls")), F.lit(0.0))
    return f.crossJoin(s).crossJoin(c).withColumn("resolution_rate", F.round(rate, 6))  # three rows of totals


def file_risk_data(files: DataFrame, symbols: DataFrame, calls: DataFrame, history: DataFrame, coupling: DataFrame) -> DataFrame:
    """The signals of all files with a symbol in one pass: four aggregates by file, joined."""
    owner = symbols.select(F.col("id").alias("sid"), F.col("file_id").alias("fid"))
    s = symbols.join(history.select(F.col("symbol_id").alias("id"), "modification_count", "author_count", "is_volatile"), "id", "left").groupBy(F.col("file_id").alias("id")).agg(
        F.count("*").alias("n_symbols"), F.count_if("is_dead").alias("n_dead"), F.coalesce(F.sum("modification_count"), F.lit(0)).cast("long").alias("modifications"),
        F.coalesce(F.max("author_count"), F.lit(0)).cast("long").alias("max_authors"), F.count_if(F.coalesce("is_volatile", F.lit(False))).alias("n_volatile"), F.count("modification_count").alias("n_with_history"),
    )
    ends = coupling.select(F.col("file_a_id").alias("id"), "strength").union(coupling.select("file_b_id", "strength"))
    cp = ends.groupBy("id").agg(F.count("*").alias("n_coupled"), F.max("strength").alias("max_strength"))
    ext = (
        calls.where("callee_symbol_id is not null").select("caller_symbol_id", "callee_symbol_id").distinct()
        .join(owner, F.col("callee_symbol_id") == F.col("sid")).withColumnRenamed("fid", "id").drop("sid")
        .join(owner, F.col("caller_symbol_id") == F.col("sid")).where("fid <> id").groupBy("id").agg(F.count_distinct("caller_symbol_id").alias("external_callers"))
    )
    out = files.select("id", "path").join(s, "id").join(cp, "id", "left").join(ext, "id", "left")
    return out.withColumns({"n_coupled": F.coalesce("n_coupled", F.lit(0)), "max_strength": F.coalesce("max_strength", F.lit(0.0)), "external_callers": F.coalesce("external_callers", F.lit(0))})


def file_risk(data: DataFrame) -> DataFrame:
    """The mean of the signals a file has, its level and the share of signals present."""
    cap = lambda c: F.least(F.lit(1.0), c)
    churn = F.when(F.col("n_with_history") > 0, cap(F.col("modifications") / 50.0))
    coupled = F.when(F.col("n_coupled") > 0, cap(0.5 * cap(F.col("n_coupled") / 10.0) + 0.5 * F.col("max_strength")))
    fan_in, dead = cap(F.col("external_callers") / 50.0), F.col("n_dead") / F.col("n_symbols")
    signals = [churn, coupled, fan_in, dead]
    total, n = sum(F.coalesce(x, F.lit(0.0)) for x in signals), sum(F.when(x.isNotNull(), 1).otherwise(0) for x in signals)
    score = total / n
    level = F.when(score >= 0.75, "critical").when(score >= 0.5, "high").when(score >= 0.25, "medium").otherwise("low")
    return data.select("id", "path", F.round(score, 3).alias("risk_score"), level.alias("risk_level"), F.round(n / 4.0, 2).alias("confidence"))


def health_level(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").when(score >= 0.2, "poor").otherwise("critical")


def symbol_health(symbols: DataFrame, calls: DataFrame, history: DataFrame) -> DataFrame:
    s = with_history(with_fan(symbols, calls), history)
    mods, authors = F.coalesce("modification_count", F.lit(0)), F.coalesce("author_count", F.lit(0))
    one = F.lit(1.0)
    stability = one - F.least(one, 0.5 * mods / 30.0 + 0.3 * authors / 10.0 + F.when(F.coalesce("is_volatile", F.lit(False)), 0.2).otherwise(0.0))
    span = F.col("line_end") - F.col("line_start")
    complexity = F.least(one, 0.7 * (F.col("fan_in") + F.col("fan_out")) / 20.0 + 0.3 * span / 200.0)
    health = F.greatest(F.lit(0.0), F.least(one, 0.5 * stability + 0.3 * (one - complexity) + F.when(F.col("is_dead"), 0.0).otherwise(0.2)))
    signals = F.array_join(F.array_compact(F.array(
        F.when(F.coalesce("is_volatile", F.lit(False)), "high_volatility"), F.when(F.col("fan_in") > 5, "high_fan_in"), F.when(F.col("fan_out") > 8, "high_fan_out"),
        F.when(F.col("is_dead"), "dead_code"), F.when(authors > 5, "many_authors"))), ",")
    confidence = F.when(F.col("modification_count").isNotNull(), 0.8).otherwise(0.3) + F.when(F.col("fan_in") + F.col("fan_out") > 0, 0.2).otherwise(0.0)
    return s.select("id", half_up(stability).alias("stability"), half_up(complexity).alias("complexity"), half_up(health).alias("health"), health_level(health).alias("level"), half_up(confidence).alias("confidence"), signals.alias("signals"))


def module_of(path: Column) -> Column:
    """The first directory after an optional ``src/``; ``root`` for files without one."""
    inner = F.regexp_replace(path, "^src/", "")
    return F.when(F.instr(inner, "/") > 0, F.substring_index(inner, "/", 1)).otherwise("root")


def module_summaries(files: DataFrame, symbols: DataFrame, calls: DataFrame, cycles: DataFrame, threshold: int = 20) -> DataFrame:
    """A row for each module: files with symbols and their sorted paths, symbols, dead ones, risk (share of dead), health,
    god objects, cycles.

    cycles: (cycle, id); a cycle counts once in each module that it touches."""
    mod = files.select(F.col("id").alias("file_id"), "path", module_of(F.col("path")).alias("module"))
    s = symbols.join(mod, "file_id")
    per_file = s.groupBy("module", "file_id", "path").agg(F.count("*").alias("n"), F.count_if("is_dead").alias("d"))
    base = per_file.groupBy("module").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_symbols"), F.sum("d").alias("n_dead"), F.array_join(F.sort_array(F.collect_list("path")), ",").alias("files"))
    gods = god_objects(symbols, calls, threshold, None).join(mod, "file_id").groupBy("module").agg(F.count("*").alias("n_god_objects"))
    touched = s.join(cycles, "id").select("module", "cycle").distinct().groupBy("module").agg(F.count("*").alias("n_cycles"))
    out = base.join(gods, "module", "left").join(touched, "module", "left")
    risk = F.col("n_dead") / F.col("n_symbols")
    return out.select("module", "n_files", "files", "n_symbols", "n_dead", F.round(risk, 6).alias("risk"), F.round(1 - risk, 6).alias("health"), F.coalesce("n_god_objects", F.lit(0)).alias("n_god_objects"), F.coalesce("n_cycles", F.lit(0)).alias("n_cycles"))


def module_risk(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(module, risk): the share of dead symbols."""
    mod = files.select(F.col("id").alias("file_id"), module_of(F.col("path")).alias("module"))
    return symbols.join(mod, "file_id").groupBy("module").agg(F.round(F.count_if("is_dead") / F.count("*"), 6).alias("risk"))


def codebase_health(symbols: DataFrame, n_cycles: DataFrame, coupling: DataFrame, communities: DataFrame) -> DataFrame:
    """Scores of dead code, cycles, coupling and modularity, their mean and its grade. n_cycles: one row (n_cycles)."""
    top = coupling.orderBy(F.desc("strength"), "file_a_id", "file_b_id").limit(50).agg(F.round(F.avg("strength"), 3).alias("coupling"))
    mods = communities.agg(F.avg("modularity").alias("modularity"))
    dead = symbols.agg((F.count_if("is_dead") / F.greatest(F.count("*"), F.lit(1))).alias("dead"))
    row = dead.crossJoin(n_cycles).crossJoin(top).crossJoin(mods)  # four rows of totals
    scores = {
        "dead_score": F.when(F.col("dead") <= 0.05, 100.0).when(F.col("dead") <= 0.15, 70.0).otherwise(30.0),
        "cycle_score": F.when(F.col("n_cycles") == 0, 100.0).when(F.col("n_cycles") <= 2, 70.0).when(F.col("n_cycles") <= 5, 50.0).otherwise(20.0),
        "coupling_score": F.when(F.col("coupling").isNull() | (F.col("coupling") <= 0.3), 100.0).when(F.col("coupling") <= 0.6, 60.0).otherwise(25.0),
        "modularity_score": F.col("modularity") * 100,
    }
    row = row.withColumns(scores)
    n = F.lit(3) + F.when(F.col("modularity_score").isNotNull(), 1).otherwise(0)
    mean = (F.col("dead_score") + F.col("cycle_score") + F.col("coupling_score") + F.coalesce("modularity_score", F.lit(0.0))) / n
    grade = F.when(mean >= 85, "A").when(mean >= 70, "B").when(mean >= 55, "C").when(mean >= 40, "D").otherwise("F")
    return row.select("dead_score", "cycle_score", "coupling_score", F.round("modularity_score", 3).alias("modularity_score"), F.round(mean, 3).alias("score"), grade.alias("grade"))


#: The role of a symbol in a module of this name.
ROLES = {"pipeline": "core_pipeline", "parse": "parser", "db": "data_access", "graph": "graph_analysis", "mcp": "mcp_tool", "analysis": "analysis", "dashboard": "dashboard_api", "search": "search"}


def describe(symbols: DataFrame, files: DataFrame, calls: DataFrame, history: DataFrame, coupling: DataFrame) -> DataFrame:
    """Risk, level, role and narrative of each symbol: what and where it is, up to three callers and callees by name, why
    its risk is high, and the file that changes with its own."""
    both = coupling.select(F.col("file_a_id").alias("file_id"), F.col("file_b_id").alias("other"), "strength").union(coupling.select("file_b_id", "file_a_id", "strength"))
    path = files.select(F.col("id").alias("other"), F.col("path").alias("other_path"))
    ends = both.join(path, "other").groupBy("file_id").agg(F.max("strength").alias("strength"), F.count("*").alias("coupled"), F.min(F.struct(-F.col("strength"), "other_path"))["other_path"].alias("partner"))
    home = files.select(F.col("id").alias("file_id"), "path", module_of(F.col("path")).alias("module"))
    s = with_history(with_fan(symbols, calls), history).join(ends, "file_id", "left").join(home, "file_id")
    known = calls.where("callee_symbol_id is not null").select("caller_symbol_id", "callee_symbol_id").distinct()
    s = s.join(_first_names(known, "callee_symbol_id", "caller_symbol_id", symbols, "callers"), "id", "left").join(_first_names(known, "caller_symbol_id", "callee_symbol_id", symbols, "callees"), "id", "left")
    one = F.lit(1.0)
    mods, volatile = F.coalesce("modification_count", F.lit(0)), F.coalesce("is_volatile", F.lit(False))
    risk = 0.3 * F.least(one, F.col("fan_in") / 20.0) + 0.3 * F.when(volatile, 0.8).otherwise(F.least(one, mods / 30.0)) + 0.2 * F.coalesce("strength", F.lit(0.0)) + 0.2 * F.when(F.col("is_dead"), 0.5).otherwise(0.0)
    level = F.when(risk >= 0.8, "critical").when(risk >= 0.6, "high").when(risk >= 0.4, "medium").otherwise("low")
    role = F.when(F.col("is_dead"), "unreachable").when(F.col("fan_in") == 0, "entry_point")
    for word, name in ROLES.items():
        role = role.when(F.col("module") == word, name)
    kind = F.when(F.col("kind").isin("function", "method", "class", "interface"), F.col("kind")).otherwise("symbol")
    where = F.concat(kind, F.lit(" of module "), "module", F.lit(" in "), "path")
    more = lambda names, n: F.when(F.col(n) > 3, F.concat(names, F.lit(" and "), (F.col(n) - 3).cast("string"), F.lit(" more"))).otherwise(F.col(names))
    reasons = F.array_join(F.array_compact(F.array(
        F.when(F.col("fan_in") > 15, F.concat(F.col("fan_in").cast("string"), F.lit(" callers"))), F.when(volatile | (mods > 20), F.lit("frequent changes")),
        F.when(F.col("coupled") > 0, F.concat(F.col("coupled").cast("string"), F.lit(" coupled files"))))), ", ")
    story = F.array_join(F.array_compact(F.array(
        F.concat("name", F.lit(": "), where, F.lit(".")),
        F.when(F.col("fan_in") > 0, F.concat(F.lit("Called by "), more("callers", "fan_in"), F.lit("."))).otherwise(F.lit("No caller is known.")),
        F.when(F.col("fan_out") > 0, F.concat(F.lit("Calls "), more("callees", "fan_out"), F.lit("."))),
        F.when((risk >= 0.8) & (reasons != ""), F.concat(F.lit("Critical: "), reasons, F.lit("."))).when(risk >= 0.5, F.concat(F.lit("Moderately connected: "), F.col("fan_in").cast("string"), F.lit(" in, "), F.col("fan_out").cast("string"), F.lit(" out."))),
        F.when(F.col("strength") > 0.7, F.concat(F.lit("Changes together with "), "partner", F.lit("."))))), " ")
    dead = F.concat("name", F.lit(": unreachable "), where, F.lit(". Nothing leads to it."))
    return s.select("id", half_up(risk).alias("risk"), level.alias("level"), role.otherwise(F.concat_ws("_", "module", "kind")).alias("role"), F.when(F.col("is_dead"), dead).otherwise(story).alias("narrative"))


def _first_names(pairs: DataFrame, key: str, other: str, symbols: DataFrame, out: str, n: int = 3) -> DataFrame:
    """(id, out): the names of the ``n`` smallest ids beside each key, joined by commas; no more than that is gathered."""
    ranked = pairs.select(F.col(key).alias("id"), F.col(other).alias("o")).withColumn("r", F.expr("row_number() over (partition by id order by o)")).where(F.col("r") <= n)
    named = ranked.join(symbols.select(F.col("id").alias("o"), "name"), "o")
    return named.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias(out))


def group_code(kind: Column) -> Column:
    return F.when(kind == "function", 0).when(kind == "class", 1).when(kind == "method", 2).when(kind == "interface", 3).otherwise(4)
