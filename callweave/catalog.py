"""The registered queries of the code-graph engine over the driver's tables, each beside its DuckDB oracle.

A query applies the engine's operator to the relations of ``plans.projection``; the oracle begins with the same
relations as CTEs and states the operator's result in plain SQL. Thresholds are the operators' parameters, lowered
where the projected graph is sparser than real code.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators import derive, impact, lookups, metrics, resolution, search
from callweave.plans.projection import ctes, relation

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


class Graph:
    """The projected relations of one folder, read as they are needed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        found = relation(self.spark, self.sf_dir, name)
        setattr(self, name, found)
        return found

    @cached_property
    def edges(self) -> DataFrame:
        return impact.call_edges(self.calls)

    @cached_property
    def history(self) -> DataFrame:
        rows = self.blame_rows
        return derive.symbol_history(rows, F.lit(rows.agg(F.max("ts")).first()[0]))

    @cached_property
    def coupling(self) -> DataFrame:
        return derive.coupling(self.commit_files, self.files)

    @cached_property
    def seeds(self) -> DataFrame:
        """(key, node): the sources of searches, every symbol whose id is divisible by 20."""
        return self.symbols.where("id % 20 = 0").select(F.col("id").alias("key"), F.col("id").alias("node"))


def query(oracle: str | None) -> Callable:
    """Registers a function of a Graph under its name, with the body of its oracle (what follows the shared CTEs)."""

    def add(f: Callable[[Graph], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    base = f"WITH RECURSIVE {ctes()}, {_SHARED}"
    return {k: f"{base}{v}" if v.startswith(",") else f"{base} {v}" for k, v in _ORACLES.items()}


#: Relations that several oracles share, over the projection.
_SHARED = """
edges AS (SELECT DISTINCT caller_symbol_id AS src, callee_symbol_id AS dst FROM calls),
fin AS (SELECT callee_symbol_id AS id, count(DISTINCT caller_symbol_id) AS fan_in FROM calls GROUP BY 1),
fout AS (SELECT caller_symbol_id AS id, count(DISTINCT callee_symbol_id) AS fan_out FROM calls GROUP BY 1),
hist AS (SELECT symbol_id, min(ts) AS created_at, max(ts) AS last_modified_at, count(DISTINCT commit) AS modification_count, count(DISTINCT author) AS author_count,
         count(DISTINCT CASE WHEN ts >= (SELECT max(ts) FROM blame_rows) - 30 * 86400 THEN commit END) > 3 AS is_volatile FROM blame_rows GROUP BY 1),
sx AS (SELECT s.*, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(modification_count, 0) AS mods, coalesce(author_count, 0) AS authors,
       coalesce(is_volatile, false) AS volatile, modification_count IS NOT NULL AS has_history
       FROM symbols s LEFT JOIN fin ON fin.id = s.id LEFT JOIN fout ON fout.id = s.id LEFT JOIN hist h ON h.symbol_id = s.id),
kept AS (SELECT commit FROM commit_files GROUP BY 1 HAVING count(DISTINCT path) BETWEEN 2 AND 20),
cf AS (SELECT DISTINCT commit, f.id AS f FROM commit_files c JOIN kept USING (commit) JOIN files f ON f.path = c.path),
coup AS (SELECT a.f AS file_a_id, b.f AS file_b_id, count(*) AS co_changes, count(*) / (SELECT greatest(count(*), 1)::DOUBLE FROM kept) AS strength
         FROM cf a JOIN cf b ON a.commit = b.commit AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 2),
links AS (SELECT DISTINCT * FROM (
            SELECT a.file_id AS src, b.file_id AS dst, 'call' AS kind, a.name AS from_name, b.name AS to_name FROM edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst
            UNION ALL SELECT file_id, resolved_file_id, 'import', '', imported_name FROM imports WHERE resolved_file_id IS NOT NULL) WHERE src <> dst),
modf AS (SELECT id AS file_id, split_part(regexp_replace(path, '^src/', ''), '/', 1) AS module FROM files)"""

#: Cycles (node, cycle), and communities (id, community_id) with their internal edges.
REACH = ", rc AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT a, dst FROM rc JOIN edges ON src = b), scc AS (SELECT x.a AS node, least(x.a, min(x.b)) AS cycle FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1) "
CC = """, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), cc AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT node, b FROM cc JOIN both_ways ON a = seen),
comp AS (SELECT node, min(seen) AS root FROM cc GROUP BY 1), num AS (SELECT root, row_number() OVER (ORDER BY root) AS cid FROM (SELECT DISTINCT root FROM comp)), mem AS (SELECT node AS id, cid AS community_id FROM comp JOIN num USING (root)) """
INTERNAL = CC + """, pr AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst), lp AS (SELECT src FROM edges WHERE src = dst),
i AS (SELECT community_id, count(*) AS symbol_count, (2 * (SELECT count(*) FROM pr JOIN mem n ON n.id = pr.a WHERE n.community_id = m.community_id) + (SELECT count(*) FROM lp JOIN mem n ON n.id = lp.src WHERE n.community_id = m.community_id)) // 2 AS internal FROM mem m GROUP BY 1) """

LEVELS = "CASE WHEN health >= 0.8 THEN 'excellent' WHEN health >= 0.6 THEN 'good' WHEN health >= 0.4 THEN 'fair' WHEN health >= 0.2 THEN 'poor' ELSE 'critical' END"


# --- aggregates and scores -------------------------------------------------------------------------------------------


@query("""SELECT id, qualified_name, fan_in, fan_out, mods AS modifications, volatile AS is_volatile, round(fan_in + fan_out + mods * 0.1 + CASE WHEN volatile THEN 10.0 ELSE 0.0 END, 6)::DOUBLE AS score
FROM sx WHERE NOT is_test AND NOT is_dead ORDER BY score DESC, id LIMIT 50""")
def hotspots(g: Graph) -> DataFrame:
    return metrics.hotspots(g.symbols, g.calls, g.history)


@query("SELECT id, fan_in, fan_out FROM sx")
def fan_in_fan_out(g: Graph) -> DataFrame:
    return metrics.with_fan(g.symbols, g.calls).select("id", "fan_in", "fan_out")


@query("SELECT id, name, qualified_name, kind, file_id, fan_in, fan_out FROM sx WHERE NOT is_test AND NOT is_dead AND fan_in >= 4 ORDER BY fan_in DESC, name, id LIMIT 10")
def god_objects(g: Graph) -> DataFrame:
    return metrics.god_objects(g.symbols, g.calls, threshold=4)


@query("""SELECT id, 'high_volatility' AS smell, CASE WHEN mods > 25 THEN 'high' ELSE 'medium' END AS severity FROM sx WHERE volatile AND mods > 10
UNION ALL SELECT id, 'high_fan_in', CASE WHEN fan_in > 15 THEN 'high' ELSE 'medium' END FROM sx WHERE fan_in > 5
UNION ALL SELECT id, 'high_fan_out', CASE WHEN fan_out > 15 THEN 'high' ELSE 'medium' END FROM sx WHERE fan_out > 8
UNION ALL SELECT id, 'dead_code', 'medium' FROM sx WHERE is_dead""")
def code_smells(g: Graph) -> DataFrame:
    return metrics.code_smells(g.symbols, g.calls, g.history)


RAW = ", r AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'unresolved' ELSE resolution END AS r2 FROM calls) "
@query(RAW + """SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM symbols WHERE is_dead) AS dead, count(*) AS calls,
count(*) FILTER (r2 <> 'unresolved') AS resolved, round(count(*) FILTER (r2 <> 'unresolved')::DOUBLE / count(*), 6) AS resolution_rate FROM r""")
def counts(g: Graph) -> DataFrame:
    calls = g.calls.withColumn("resolution", F.when(F.col("id") % 3 == 0, "unresolved").otherwise(F.col("resolution")))
    return metrics.counts(g.files, g.symbols, calls)


@query("SELECT DISTINCT language FROM files")
def languages(g: Graph) -> DataFrame:
    return g.files.select("language").distinct()


@query("SELECT service_id, language, count(*) AS n, row_number() OVER (PARTITION BY service_id ORDER BY count(*) DESC, language)::INTEGER AS rank FROM files GROUP BY 1, 2")
def language_rank(g: Graph) -> DataFrame:
    return lookups.language_rank(g.files)


RISK_DATA = """, own AS (SELECT file_id AS id, count(*) AS n_symbols, count(*) FILTER (is_dead) AS n_dead, sum(mods)::BIGINT AS modifications, max(authors) AS max_authors,
  count(*) FILTER (volatile) AS n_volatile, count(*) FILTER (has_history) AS n_with_history FROM sx GROUP BY 1),
cp AS (SELECT id, count(*) AS n_coupled, max(strength) AS max_strength FROM (SELECT file_a_id AS id, strength FROM coup UNION ALL SELECT file_b_id, strength FROM coup) GROUP BY 1),
ext AS (SELECT b.file_id AS id, count(DISTINCT src) AS external_callers FROM edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE a.file_id <> b.file_id GROUP BY 1),
fr AS (SELECT f.id, f.path, n_symbols, n_dead, modifications, max_authors, n_volatile, n_with_history, coalesce(n_coupled, 0) AS n_coupled, coalesce(max_strength, 0) AS max_strength, coalesce(external_callers, 0) AS external_callers
  FROM files f JOIN own USING (id) LEFT JOIN cp USING (id) LEFT JOIN ext USING (id)) """


@query(RISK_DATA + "SELECT * REPLACE (round(max_strength, 9) AS max_strength) FROM fr")
def file_risk_data(g: Graph) -> DataFrame:
    return metrics.file_risk_data(g.files, g.symbols, g.calls, g.history, g.coupling).withColumn("max_strength", F.round("max_strength", 9))


@query(RISK_DATA + """, sig AS (SELECT id, path, CASE WHEN n_with_history > 0 THEN least(1.0, modifications / 50.0) END AS a, CASE WHEN n_coupled > 0 THEN least(1.0, 0.5 * least(1.0, n_coupled / 10.0) + 0.5 * max_strength) END AS b,
  least(1.0, external_callers / 50.0) AS c, n_dead / n_symbols AS d FROM fr),
sc AS (SELECT id, path, 2 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS n, (coalesce(a, 0) + coalesce(b, 0) + c + d)::DOUBLE / (2 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT) AS s FROM sig)
SELECT id, path, round(s, 3) AS risk_score, CASE WHEN s >= 0.75 THEN 'critical' WHEN s >= 0.5 THEN 'high' WHEN s >= 0.25 THEN 'medium' ELSE 'low' END AS risk_level, round(n / 4.0::DOUBLE, 2) AS confidence FROM sc""")
def file_risk(g: Graph) -> DataFrame:
    return metrics.file_risk(metrics.file_risk_data(g.files, g.symbols, g.calls, g.history, g.coupling))


@query(f""", h AS (SELECT *, 1 - least(1.0, 0.5 * mods::DOUBLE / 30 + 0.3 * authors::DOUBLE / 10 + CASE WHEN volatile THEN 0.2 ELSE 0 END) AS st, least(1.0, 0.7 * (fan_in + fan_out)::DOUBLE / 20 + 0.3 * (line_end - line_start)::DOUBLE / 200) AS cx FROM sx),
k AS (SELECT *, greatest(0.0, least(1.0, 0.5 * st + 0.3 * (1 - cx) + CASE WHEN is_dead THEN 0 ELSE 0.2 END)) AS health FROM h)
SELECT id, round(st, 3)::DOUBLE AS stability, round(cx, 3)::DOUBLE AS complexity, round(health, 3)::DOUBLE AS health, {LEVELS} AS level, (CASE WHEN has_history THEN 0.8 ELSE 0.3 END + CASE WHEN fan_in + fan_out > 0 THEN 0.2 ELSE 0 END)::DOUBLE AS confidence,
concat_ws(',', CASE WHEN volatile THEN 'high_volatility' END, CASE WHEN fan_in > 5 THEN 'high_fan_in' END, CASE WHEN fan_out > 8 THEN 'high_fan_out' END, CASE WHEN is_dead THEN 'dead_code' END, CASE WHEN authors > 5 THEN 'many_authors' END) AS signals FROM k""")
def symbol_health(g: Graph) -> DataFrame:
    return metrics.symbol_health(g.symbols, g.calls, g.history)


@query(REACH + """SELECT module, count(DISTINCT file_id) AS n_files, (SELECT string_agg(path, ',' ORDER BY path) FROM files f WHERE f.id IN (SELECT file_id FROM symbols) AND f.id IN (SELECT file_id FROM modf m2 WHERE m2.module = modf.module)) AS files, count(*) AS n_symbols, count(*) FILTER (is_dead) AS n_dead,
round(count(*) FILTER (is_dead)::DOUBLE / count(*), 6) AS risk, round(1 - count(*) FILTER (is_dead)::DOUBLE / count(*), 6) AS health, count(*) FILTER (fan_in >= 4 AND NOT is_test AND NOT is_dead) AS n_god_objects, count(DISTINCT cycle) AS n_cycles
FROM sx JOIN modf USING (file_id) LEFT JOIN scc ON scc.node = sx.id GROUP BY 1""")
def module_summaries(g: Graph) -> DataFrame:
    return metrics.module_summaries(g.files, g.symbols, g.calls, impact.strongly_connected(g.edges).select("cycle", F.col("node").alias("id")), threshold=4)


@query("SELECT module, round(count(*) FILTER (is_dead)::DOUBLE / count(*), 6) AS risk FROM sx JOIN modf USING (file_id) GROUP BY 1")
def module_risk(g: Graph) -> DataFrame:
    return metrics.module_risk(g.files, g.symbols)


@query(""", es AS (SELECT x.file_id, max(strength) AS strength, count(*) AS coupled, arg_min(o.path, (-strength, o.path)) AS partner FROM (SELECT file_a_id AS file_id, file_b_id AS other, strength FROM coup UNION ALL SELECT file_b_id, file_a_id, strength FROM coup) x JOIN files o ON o.id = other GROUP BY 1),
ci AS (SELECT id, string_agg(name, ', ' ORDER BY r) AS callers FROM (SELECT dst AS id, name, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM edges JOIN symbols s ON s.id = src) WHERE r <= 3 GROUP BY 1),
co AS (SELECT id, string_agg(name, ', ' ORDER BY r) AS callees FROM (SELECT src AS id, name, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM edges JOIN symbols s ON s.id = dst) WHERE r <= 3 GROUP BY 1),
d AS (SELECT s.*, module, path, strength, coupled, partner, callers, callees, 0.3 * least(1.0, fan_in::DOUBLE / 20) + 0.3 * CASE WHEN volatile THEN 0.8 ELSE least(1.0, mods::DOUBLE / 30) END + 0.2 * coalesce(strength, 0) + 0.2 * CASE WHEN is_dead THEN 0.5 ELSE 0 END AS r,
 CASE WHEN kind IN ('function', 'method', 'class', 'interface') THEN kind ELSE 'symbol' END || ' of module ' || module || ' in ' || path AS loc
FROM sx s JOIN modf USING (file_id) JOIN files f ON f.id = s.file_id LEFT JOIN es USING (file_id) LEFT JOIN ci ON ci.id = s.id LEFT JOIN co ON co.id = s.id)
SELECT id, round(r, 3)::DOUBLE AS risk, CASE WHEN r >= 0.8 THEN 'critical' WHEN r >= 0.6 THEN 'high' WHEN r >= 0.4 THEN 'medium' ELSE 'low' END AS level,
CASE WHEN is_dead THEN 'unreachable' WHEN fan_in = 0 THEN 'entry_point' ELSE module || '_' || kind END AS role,
CASE WHEN is_dead THEN name || ': unreachable ' || loc || '. Nothing leads to it.' ELSE concat_ws(' ', name || ': ' || loc || '.',
 CASE WHEN fan_in > 0 THEN 'Called by ' || callers || CASE WHEN fan_in > 3 THEN ' and ' || (fan_in - 3) || ' more' ELSE '' END || '.' ELSE 'No caller is known.' END,
 CASE WHEN fan_out > 0 THEN 'Calls ' || callees || CASE WHEN fan_out > 3 THEN ' and ' || (fan_out - 3) || ' more' ELSE '' END || '.' END,
 CASE WHEN r >= 0.8 AND concat_ws(', ', CASE WHEN fan_in > 15 THEN 'x' END, CASE WHEN volatile OR mods > 20 THEN 'x' END, CASE WHEN coupled > 0 THEN 'x' END) <> '' THEN 'Critical: ' || concat_ws(', ', CASE WHEN fan_in > 15 THEN fan_in || ' callers' END, CASE WHEN volatile OR mods > 20 THEN 'frequent changes' END, CASE WHEN coupled > 0 THEN coupled || ' coupled files' END) || '.'
  WHEN r >= 0.5 THEN 'Moderately connected: ' || fan_in || ' in, ' || fan_out || ' out.' END,
 CASE WHEN strength > 0.7 THEN 'Changes together with ' || partner || '.' END) END AS narrative FROM d""")
def describe(g: Graph) -> DataFrame:
    return metrics.describe(g.symbols, g.files, g.calls, g.history, g.coupling)


@query("SELECT id, CASE kind WHEN 'function' THEN 0 WHEN 'class' THEN 1 WHEN 'method' THEN 2 WHEN 'interface' THEN 3 ELSE 4 END AS group_code FROM symbols")
def group_code(g: Graph) -> DataFrame:
    return g.symbols.select("id", metrics.group_code(F.col("kind")).alias("group_code"))


@query(REACH + INTERNAL + """, t AS (SELECT strength FROM coup ORDER BY strength DESC, file_a_id, file_b_id LIMIT 50),
v AS (SELECT count(*) FILTER (is_dead) / count(*) AS dead, (SELECT round(avg(strength), 3) FROM t) AS c, (SELECT count(DISTINCT cycle) FROM scc) AS n, (SELECT avg(internal / greatest(internal, 1)) FROM i) AS md FROM symbols),
k AS (SELECT CASE WHEN dead <= 0.05 THEN 100.0 WHEN dead <= 0.15 THEN 70.0 ELSE 30.0 END::DOUBLE AS dead_score, CASE WHEN n = 0 THEN 100.0 WHEN n <= 2 THEN 70.0 WHEN n <= 5 THEN 50.0 ELSE 20.0 END::DOUBLE AS cycle_score, CASE WHEN c IS NULL OR c <= 0.3 THEN 100.0 WHEN c <= 0.6 THEN 60.0 ELSE 25.0 END::DOUBLE AS coupling_score, (md * 100)::DOUBLE AS modularity_score FROM v),
m AS (SELECT *, (dead_score + cycle_score + coupling_score + modularity_score) / 4 AS mean FROM k)
SELECT dead_score, cycle_score, coupling_score, round(modularity_score, 3) AS modularity_score, round(mean, 3) AS score, CASE WHEN mean >= 85 THEN 'A' WHEN mean >= 70 THEN 'B' WHEN mean >= 55 THEN 'C' WHEN mean >= 40 THEN 'D' ELSE 'F' END AS grade FROM m""")
def codebase_health(g: Graph) -> DataFrame:
    cycles = impact.strongly_connected(g.edges).select("cycle").distinct().agg(F.count("*").alias("n_cycles"))
    return metrics.codebase_health(g.symbols, cycles, g.coupling, impact.communities(g.symbols, g.edges)[1])


# --- history, coupling, topology, rules ------------------------------------------------------------------------------


@query("SELECT symbol_id, created_at, last_modified_at, modification_count, author_count, is_volatile FROM hist")
def symbol_history(g: Graph) -> DataFrame:
    return g.history


BLAME = ", bl AS (SELECT f.path, b.symbol_id % 900 AS line, b.ts, b.author, b.commit FROM blame_rows b JOIN files f ON f.id = b.symbol_id % (SELECT ns FROM ns)) "
@query(BLAME + """SELECT s.id AS symbol_id, count(*) AS n, min(bl.ts) AS first_ts, max(bl.ts) AS last_ts FROM bl JOIN files f ON f.path = bl.path JOIN symbols s ON s.file_id = f.id AND bl.line BETWEEN s.line_start AND s.line_end GROUP BY 1""")
def blame_source(g: Graph) -> DataFrame:
    b = g.blame_rows.crossJoin(F.broadcast(g.ns)).select((F.col("symbol_id") % F.col("ns")).alias("f"), (F.col("symbol_id") % 900).alias("line"), "ts", "author", "commit")
    lines = b.join(g.files.select(F.col("id").alias("f"), "path"), "f").drop("f")
    return derive.blame_to_symbols(lines, g.symbols, g.files).groupBy("symbol_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT DISTINCT commit, path FROM commit_files JOIN kept USING (commit)")
def coupling_source(g: Graph) -> DataFrame:
    return derive.coupling_source(g.commit_files)


@query("SELECT file_a_id, file_b_id, co_changes, round(strength, 9) AS strength FROM coup")
def coupling(g: Graph) -> DataFrame:
    return g.coupling.withColumn("strength", F.round("strength", 9))


@query("""SELECT file_a_id, file_b_id, a.path AS path_a, b.path AS path_b, ma.module AS module_a, mb.module AS module_b, co_changes, round(strength, 9) AS strength
FROM (SELECT * FROM coup ORDER BY strength DESC, file_a_id, file_b_id LIMIT 50) c JOIN files a ON a.id = file_a_id JOIN files b ON b.id = file_b_id JOIN modf ma ON ma.file_id = file_a_id JOIN modf mb ON mb.file_id = file_b_id""")
def top_coupling_pairs(g: Graph) -> DataFrame:
    return derive.top_coupling_pairs(g.coupling, g.files, metrics.module_of(F.col("path"))).withColumn("strength", F.round("strength", 9))


@query("SELECT CASE WHEN file_a_id = 5 THEN file_b_id ELSE file_a_id END AS partner, co_changes, round(strength, 9) AS strength FROM coup WHERE 5 IN (file_a_id, file_b_id)")
def file_couplings(g: Graph) -> DataFrame:
    return derive.file_couplings(g.coupling, 5).withColumn("strength", F.round("strength", 9))


API = """, api AS (SELECT c.id, c.service_id, c.protocol, (SELECT min(e.id) FROM endpoints e WHERE e.method = c.method AND lower(c.url_pattern) LIKE lower('%' || e.path_pattern || '%')) AS endpoint_id FROM api_calls c),
apir AS (SELECT api.*, e.service_id AS endpoint_service_id FROM api LEFT JOIN endpoints e ON e.id = endpoint_id) """


@query(API + "SELECT id, endpoint_id, endpoint_service_id FROM apir")
def resolve_api_calls(g: Graph) -> DataFrame:
    return resolution.resolve_api_calls(g.api_calls, g.endpoints)


@query("SELECT c.id, (SELECT min(e.id) FROM endpoints e WHERE upper(e.method) = upper(c.method) AND (c.protocol = e.protocol OR e.protocol = 'http') AND (contains(c.url_pattern, e.path_pattern) OR contains(lower(c.url_pattern), lower(e.path_pattern)))) AS endpoint_id FROM api_calls c")
def boost_schema_matches(g: Graph) -> DataFrame:
    return resolution.boost_schema_matches(g.api_calls, g.endpoints)


TOPO = API + ", topo AS (SELECT service_id AS from_service_id, endpoint_service_id AS to_service_id, protocol, count(*) AS call_count FROM apir WHERE endpoint_service_id <> service_id GROUP BY 1, 2, 3) "


def _topology(g: Graph) -> DataFrame:
    done = resolution.resolve_api_calls(g.api_calls, g.endpoints).select("id", F.col("endpoint_service_id").alias("resolved_service_id"))
    return derive.service_topology(g.api_calls.join(done, "id"))


@query(TOPO + "SELECT *, CASE WHEN call_count > 5 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM topo")
def service_topology(g: Graph) -> DataFrame:
    return _topology(g)


@query(TOPO + "SELECT '    ' || a.name || ' -->|' || protocol || ' x' || call_count || '| ' || b.name AS line FROM topo JOIN services a ON a.id = from_service_id JOIN services b ON b.id = to_service_id")
def mermaid_topology(g: Graph) -> DataFrame:
    return derive.mermaid_topology(_topology(g), g.services)


@query(""", ep AS (SELECT id, 'get' AS method, path_pattern, CASE WHEN id % 2 = 0 THEN (SELECT name FROM symbols s WHERE s.id = e.id) END AS operation_id FROM endpoints e)
SELECT id, coalesce((SELECT min(s.id) FROM symbols s WHERE s.name = operation_id OR ends_with(lower(s.qualified_name), lower(operation_id))), (SELECT min(s.id) FROM symbols s WHERE lower(s.name) = lower(method || '_' || replace(substr(path_pattern, 2), '/', '_'))),
  (SELECT min(s.id) FROM symbols s WHERE kind IN ('function', 'method') AND lower(s.name) LIKE '%' || method || '%' || lower(substr(path_pattern, 2)) || '%')) AS handler_symbol_id FROM ep""")
def find_handler(g: Graph) -> DataFrame:
    names = g.symbols.select("id", F.col("name").alias("operation_id")).where("id % 2 = 0")
    return resolution.find_handlers(g.endpoints.select("id", F.lit("get").alias("method"), "path_pattern").join(names, "id", "left"), g.symbols)


RULES = [{"name": "no-even", "from": "src/*[02468]/*", "to": "src/*/*1", "severity": "error"}, {"name": "teens", "from": "src/*", "to": "src/*_1?/*", "severity": "warning"}, {"name": "never", "from": "lib/*", "to": "*"}]
VIOLATIONS = """, pr AS (SELECT i.*, a.path AS fp, b.path AS tp FROM imports i JOIN files a ON a.id = i.file_id JOIN files b ON b.id = i.resolved_file_id),
vi AS (SELECT 'no-even' AS rule_name, file_id AS from_file_id, resolved_file_id AS to_file_id, line, 'error' AS severity FROM pr WHERE fp GLOB 'src/*[02468]/*' AND tp GLOB 'src/*/*1'
UNION ALL SELECT 'teens', file_id, resolved_file_id, line, 'warning' FROM pr WHERE fp GLOB 'src/*' AND tp GLOB 'src/*_1?/*') """


@query(VIOLATIONS + "SELECT * FROM vi")
def check_rules(g: Graph) -> DataFrame:
    return derive.check_rules(g.imports, g.files, RULES)


@query(VIOLATIONS + ", r AS (SELECT unnest(['no-even', 'teens', 'never']) AS rule_name) SELECT rule_name, count(vi.line) AS violations, count(vi.line) = 0 AS passed FROM r LEFT JOIN vi USING (rule_name) GROUP BY 1")
def rule_summary(g: Graph) -> DataFrame:
    return derive.rule_summary(derive.check_rules(g.imports, g.files, RULES), RULES)


@query("SELECT id, name, count(*) AS degree FROM (SELECT caller_symbol_id AS id FROM calls UNION ALL SELECT callee_symbol_id FROM calls) JOIN symbols USING (id) GROUP BY 1, 2 ORDER BY degree DESC, id LIMIT 10")
def most_connected(g: Graph) -> DataFrame:
    return derive.most_connected(g.symbols, g.calls)


@query(""", mc AS (SELECT id, name, count(*) AS n FROM (SELECT caller_symbol_id AS id FROM calls UNION ALL SELECT callee_symbol_id FROM calls) JOIN symbols USING (id) GROUP BY 1, 2 ORDER BY n DESC, id LIMIT 10),
gf AS (SELECT f.id, path AS name, count(*) AS n FROM files f JOIN symbols s ON s.file_id = f.id GROUP BY 1, 2 HAVING count(*) >= 15), dd AS (SELECT id, name, 0 AS n FROM symbols WHERE is_dead ORDER BY name, id LIMIT 200)
SELECT 'most_connected' AS list, row_number() OVER (ORDER BY n DESC, id)::INTEGER AS rank, id, name, n FROM mc UNION ALL SELECT 'god_files', row_number() OVER (ORDER BY n DESC, name, id)::INTEGER, id, name, n FROM gf UNION ALL SELECT 'dead', row_number() OVER (ORDER BY name, id)::INTEGER, id, name, n FROM dd""")
def insights(g: Graph) -> DataFrame:
    return derive.insights(g.symbols, g.files, g.calls, god=15)


@query("SELECT f.id, path, count(*) AS n FROM files f JOIN symbols s ON s.file_id = f.id GROUP BY 1, 2 HAVING count(*) >= 15")
def god_files(g: Graph) -> DataFrame:
    return derive.group_files(g.files, g.symbols).where("n >= 15")


@query("SELECT path, line, symbol, role FROM (SELECT path, greatest(line_start - 1, 0) AS line, qualified_name AS symbol, 1 AS role FROM symbols s JOIN files f ON f.id = s.file_id UNION ALL SELECT path, greatest(line - 1, 0), qualified_name, 0 FROM calls c JOIN symbols s ON s.id = c.callee_symbol_id JOIN files f ON f.id = c.file_id)")
def scip_export(g: Graph) -> DataFrame:
    return derive.scip_occurrences(g.symbols, g.calls, g.files)


@query("""SELECT f.path, (SELECT string_agg(line || ':' || role || ':' || symbol, ',' ORDER BY line, role, symbol) FROM (SELECT greatest(line_start - 1, 0) AS line, 1 AS role, qualified_name AS symbol FROM symbols s WHERE s.file_id = f.id UNION ALL SELECT greatest(c.line - 1, 0), 0, qualified_name FROM calls c JOIN symbols s ON s.id = c.callee_symbol_id WHERE c.file_id = f.id)) AS occurrences,
(SELECT string_agg(DISTINCT qualified_name, ',' ORDER BY qualified_name) FROM symbols s WHERE s.file_id = f.id) AS symbols FROM files f WHERE f.id IN (SELECT file_id FROM symbols UNION SELECT file_id FROM calls)""")
def scip_documents(g: Graph) -> DataFrame:
    d = derive.scip_documents(g.symbols, g.calls, g.files)
    flat = F.transform("occurrences", lambda x: F.concat_ws(":", x["line"].cast("string"), x["role"].cast("string"), x["symbol"]))
    return d.select("path", F.array_join(flat, ",").alias("occurrences"), F.nullif(F.array_join("symbols", ","), F.lit("")).alias("symbols"))


# --- lookups ---------------------------------------------------------------------------------------------------------


def _some_name(g: Graph) -> str:
    return g.symbols.where("id = 7").first().name


@query("SELECT s.id, s.name, s.qualified_name, s.kind, f.path, s.line_start FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name = (SELECT name FROM symbols WHERE id = 7) OR s.qualified_name = (SELECT name FROM symbols WHERE id = 7)")
def symbol_candidates(g: Graph) -> DataFrame:
    return lookups.symbol_candidates(g.symbols, g.files, _some_name(g))


@query("SELECT id, CASE WHEN (SELECT count(*) FROM symbols WHERE qualified_name = q) = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM symbols, (SELECT qualified_name AS q FROM symbols WHERE id = 7) WHERE qualified_name = q")
def resolve_symbol_by_name(g: Graph) -> DataFrame:
    return lookups.resolve_symbol_by_name(g.symbols, g.files, g.symbols.where("id = 7").first().qualified_name)


@query("SELECT s.id FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name = (SELECT name FROM symbols WHERE id = 7) ORDER BY path, line_start, s.id LIMIT 1")
def find_symbol_by_name(g: Graph) -> DataFrame:
    return lookups.symbol_candidates(g.symbols, g.files, _some_name(g)).select("id").limit(1)


@query("SELECT id, name, qualified_name, kind, line_start, line_end FROM symbols WHERE id = 42")
def symbol_by_id(g: Graph) -> DataFrame:
    return g.symbols.where("id = 42").select("id", "name", "qualified_name", "kind", "line_start", "line_end")


@query("SELECT id, path FROM files WHERE id = 4")
def file_path_by_id(g: Graph) -> DataFrame:
    return g.files.where("id = 4").select("id", "path")


@query("SELECT id, path FROM files WHERE ends_with(path, '/' || (SELECT split_part(path, '/', 3) FROM files WHERE id = 3)) ORDER BY id LIMIT 1")
def find_file_by_path(g: Graph) -> DataFrame:
    return lookups.find_file_by_path(g.files, g.files.where("id = 3").first().path.split("/")[2]).select("id", "path")


@query("SELECT id, name, line_start FROM symbols WHERE file_id = 3")
def file_symbols(g: Graph) -> DataFrame:
    return lookups.file_symbols(g.symbols, g.files, g.files.where("id = 3").first().path).select("id", "name", "line_start")


@query("SELECT id, path, language FROM files WHERE service_id = 1")
def service_files(g: Graph) -> DataFrame:
    return g.files.where("service_id = 1").select("id", "path", "language")


@query("SELECT id, service_id, path, language FROM files")
def all_files(g: Graph) -> DataFrame:
    return g.files.select("id", "service_id", "path", "language")


@query("SELECT id, imported_name, module_path, resolved_file_id, line, is_external FROM imports WHERE file_id = 3")
def file_imports(g: Graph) -> DataFrame:
    return g.imports.where("file_id = 3").select("id", "imported_name", "module_path", "resolved_file_id", "line", "is_external")


@query("SELECT id, name, file_id, line_start FROM symbols WHERE is_dead ORDER BY file_id, line_start, id LIMIT 500")
def dead_symbols(g: Graph) -> DataFrame:
    return lookups.dead_symbols(g.symbols).select("id", "name", "file_id", "line_start")


@query("SELECT id, path, parse_error_count FROM files WHERE parse_error_count > 0")
def parse_error_files(g: Graph) -> DataFrame:
    return lookups.parse_error_files(g.files)


@query("SELECT count(*) AS n_files, coalesce(sum(parse_error_count), 0)::BIGINT AS n_errors, (SELECT string_agg(path || ':' || parse_error_count, ',' ORDER BY parse_error_count DESC, path) FROM (SELECT * FROM files WHERE parse_error_count > 0 ORDER BY parse_error_count DESC, path LIMIT 10)) AS worst FROM files WHERE parse_error_count > 0")
def parse_health(g: Graph) -> DataFrame:
    return lookups.parse_health(g.files)


POS = ", pos AS (SELECT f.path, c.line, min(c.id) AS cid FROM calls c JOIN files f ON f.id = c.file_id GROUP BY 1, 2), spot AS (SELECT pos.path, pos.line, arg_min(s.id, (s.line_end - s.line_start)::BIGINT * 100000000 + s.id) AS id FROM pos JOIN files f USING (path) JOIN symbols s ON s.file_id = f.id AND pos.line BETWEEN s.line_start AND s.line_end GROUP BY 1, 2) "


def _positions(g: Graph) -> DataFrame:
    return g.calls.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "line").distinct()


@query(POS + "SELECT * FROM spot")
def symbol_at_position(g: Graph) -> DataFrame:
    return lookups.symbols_at(g.symbols, g.files, _positions(g))


@query(POS + "SELECT pos.path, pos.line, c.callee_symbol_id AS id FROM pos JOIN calls c ON c.id = pos.cid")
def goto_definition(g: Graph) -> DataFrame:
    return lookups.goto_definition(g.symbols, g.files, g.calls, _positions(g))


@query("SELECT callee_symbol_id AS id, caller_symbol_id AS caller, min(line) AS line FROM calls GROUP BY 1, 2")
def references(g: Graph) -> DataFrame:
    return lookups.references(g.calls)


@query("SELECT s.id, (SELECT count(*) FROM calls c WHERE c.callee_symbol_id = s.id) AS callers, (SELECT count(*) FROM calls c WHERE c.caller_symbol_id = s.id) AS callees, is_dead AS dead FROM symbols s")
def hover(g: Graph) -> DataFrame:
    return lookups.hover(g.symbols, g.calls)


@query(", n AS (SELECT callee_symbol_id AS id, count(*) AS n FROM calls GROUP BY 1) SELECT s.id, CASE WHEN n > 0 THEN n || ' references' WHEN is_dead OR NOT is_exported THEN 'dead' ELSE '0 references' END AS title FROM symbols s LEFT JOIN n ON n.id = s.id")
def code_lens(g: Graph) -> DataFrame:
    return lookups.code_lens(g.symbols, g.calls)


@query("SELECT id, name, kind, line_start, line_end FROM symbols WHERE file_id = 6")
def document_symbols(g: Graph) -> DataFrame:
    return g.symbols.where("file_id = 6").select("id", "name", "kind", "line_start", "line_end")


@query(VIOLATIONS + "SELECT file_id, line_start AS line, 'dead code: ' || name AS message FROM symbols WHERE is_dead UNION ALL SELECT from_file_id, line, 'rule: ' || rule_name FROM vi UNION ALL SELECT id, 1, parse_error_count || ' parse errors' FROM files WHERE parse_error_count > 0")
def diagnostics(g: Graph) -> DataFrame:
    return lookups.diagnostics(g.files, g.symbols, derive.check_rules(g.imports, g.files, RULES))


@query("SELECT e.id, e.method, e.path_pattern, s.name AS handler, f.path FROM endpoints e LEFT JOIN symbols s ON s.id = e.handler_symbol_id LEFT JOIN files f ON f.id = e.file_id")
def api_endpoints(g: Graph) -> DataFrame:
    s, f = g.symbols.select(F.col("id").alias("handler_symbol_id"), F.col("name").alias("handler")), g.files.select(F.col("id").alias("file_id"), "path")
    return g.endpoints.join(s, "handler_symbol_id", "left").join(f, "file_id", "left").select("id", "method", "path_pattern", "handler", "path")


HER = ", her AS (SELECT h.*, (SELECT min(s.id) FROM symbols s WHERE s.name = h.parent_name AND s.kind IN ('class', 'interface', 'trait')) AS parent_symbol_id FROM heritage_in h) "


@query(HER + "SELECT id, child_symbol_id, parent_name, parent_symbol_id, kind FROM her")
def resolve_heritage(g: Graph) -> DataFrame:
    return resolution.resolve_heritage(g.heritage_in, g.symbols).select("id", "child_symbol_id", "parent_name", "parent_symbol_id", "kind")


@query(HER + ", m AS (SELECT min(parent_symbol_id) AS x FROM her) SELECT 'parent' AS relation, parent_symbol_id AS id, kind FROM her, m WHERE child_symbol_id = x UNION ALL SELECT 'child', child_symbol_id, kind FROM her, m WHERE parent_symbol_id = x")
def heritage(g: Graph) -> DataFrame:
    h = resolution.resolve_heritage(g.heritage_in, g.symbols)
    return lookups.heritage_of(h, h.agg(F.min("parent_symbol_id")).first()[0])


@query("SELECT id, name, qualified_name FROM symbols WHERE name ILIKE '%ea%' OR qualified_name ILIKE '%ea%' ORDER BY id LIMIT 50")
def dashboard_search(g: Graph) -> DataFrame:
    return lookups.dashboard_search(g.symbols, "EA")


@query("SELECT s.id FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.path = 'src/france' OR f.id IN (1, 2) OR ends_with(f.path, '/' || (SELECT split_part(path, '/', 3) FROM files WHERE id = 4))")
def resolve_paths_to_symbol_ids(g: Graph) -> DataFrame:
    f = {r.id: r.path for r in g.files.where("id in (1, 2, 4)").collect()}
    wanted = g.spark.createDataFrame([(f[1],), (f[2],), (f[4].split("/")[2],), ("src/france",)], "path string")
    return resolution.resolve_paths(wanted, g.symbols, g.files)


@query("SELECT '/srv/' || lower(n_name) || '/x.py' AS path, (SELECT coalesce((SELECT arg_max(id, length(repo_path) * 1000 - id) FROM services WHERE starts_with('/srv/' || lower(n_name) || '/x.py', repo_path)), (SELECT min(id) FROM services))) AS service_id FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)")
def resolve_service_for_path(g: Graph) -> DataFrame:
    names = [r[0] for t, c in (("nation", "n_name"), ("region", "r_name")) for r in g.spark.read.parquet(f"{g.sf_dir}/{t}.parquet").select(c).collect()]
    return resolution.resolve_service_for_path(g.spark.createDataFrame([(f"/srv/{n.lower()}/x.py",) for n in names], "path string"), g.services)


# --- resolution ------------------------------------------------------------------------------------------------------

CALLS_ORACLE = """, c AS (SELECT r.*, f.service_id AS svc, CASE WHEN contains(callee_name, '.') THEN nullif(split_part(callee_name, '.', -1), '') END AS last, CASE WHEN contains(callee_name, '.') THEN split_part(callee_name, '.', 1) END AS first FROM raw_calls r JOIN files f ON f.id = r.file_id),
s AS (SELECT y.*, f.service_id, f.path FROM symbols y JOIN files f ON f.id = y.file_id),
a AS (SELECT c.id,
 (SELECT arg_min(s.id, (CASE WHEN s.is_exported THEN 0 ELSE 1 END * 10000000 + s.line_start)::HUGEINT * 100000000 + s.id) FROM imports i JOIN s ON s.file_id = i.resolved_file_id AND s.name = i.imported_name WHERE i.file_id = c.file_id AND i.imported_name = c.callee_name) AS p0,
 (SELECT min(s.id) FROM s WHERE s.file_id = c.file_id AND s.name = c.callee_name) AS p1,
 (SELECT min(s.id) FROM s WHERE s.file_id = c.file_id AND s.name = c.last) AS p2a,
 (SELECT min(s.id) FROM imports i JOIN s ON s.file_id = i.resolved_file_id WHERE i.file_id = c.file_id AND i.imported_name = c.first AND s.name = c.last) AS p2b,
 (SELECT min(s.id) FROM s WHERE s.service_id = c.svc AND s.name = c.last) AS p2c,
 (SELECT first(s.id ORDER BY s.is_exported DESC, s.path, s.line_start, s.id) FROM imports i JOIN s ON s.file_id = i.resolved_file_id WHERE i.file_id = c.file_id AND s.name = c.callee_name) AS p3,
 (SELECT first(s.id ORDER BY s.path, s.line_start, s.id) FROM s WHERE s.is_exported AND s.service_id = c.svc AND s.name = c.callee_name) AS p4,
 (SELECT first(s.id ORDER BY s.path, s.line_start, s.id) FROM s WHERE s.is_exported AND s.name = c.callee_name) AS p5,
 EXISTS (SELECT 1 FROM imports i WHERE i.is_external AND i.file_id = c.file_id AND i.imported_name IN (c.callee_name, c.first)) AS p6, callee_name AS n FROM c)
SELECT id, coalesce(p0, p1, p2a, p2b, p2c, p3, p4, p5) AS callee_symbol_id,
 CASE WHEN p0 IS NOT NULL THEN 0.98 WHEN p1 IS NOT NULL THEN 0.95 WHEN p2a IS NOT NULL THEN 0.85 WHEN p2b IS NOT NULL THEN 0.88 WHEN p2c IS NOT NULL THEN 0.65 WHEN p3 IS NOT NULL THEN 0.8 WHEN p4 IS NOT NULL THEN 0.75 WHEN p5 IS NOT NULL THEN 0.5
  WHEN p6 THEN 0.9 WHEN n = 'println!' OR starts_with(n, 'console.') THEN 1.0 WHEN contains(n, '.') THEN 0.3 WHEN n = 'resolve' OR regexp_matches(n, '^set[A-Z]') THEN 0.4 ELSE 0.5 END::DOUBLE AS confidence,
 CASE WHEN p0 IS NOT NULL THEN 'import_guided' WHEN p1 IS NOT NULL THEN 'same_file' WHEN p2a IS NOT NULL THEN 'dotted_same_file' WHEN p2b IS NOT NULL THEN 'dotted_import_guided' WHEN p2c IS NOT NULL THEN 'dotted_same_service' WHEN p3 IS NOT NULL THEN 'import_file_affinity'
  WHEN p4 IS NOT NULL THEN 'same_service' WHEN p5 IS NOT NULL THEN 'global' WHEN p6 THEN 'external' WHEN n = 'println!' OR starts_with(n, 'console.') THEN 'builtin' WHEN contains(n, '.') THEN 'method_call' WHEN n = 'resolve' OR regexp_matches(n, '^set[A-Z]') THEN 'local' ELSE 'unresolved' END AS resolution FROM a"""


@query(CALLS_ORACLE)
def resolve_calls(g: Graph) -> DataFrame:
    return resolution.resolve_calls(g.raw_calls, g.symbols, g.files, g.imports).select("id", "callee_symbol_id", "confidence", "resolution")


@query(""", q AS (SELECT i.id, i.imported_name, i.is_external, f.language AS lang, t.id AS target, t.language AS tlang, i.id % 2 = 0 AS aliased FROM imports i JOIN files f ON f.id = i.file_id JOIN files t ON t.path = i.module_path),
t AS (SELECT *, CASE WHEN is_external THEN CASE WHEN aliased AND lang <> 'rust' AND tlang <> 'rust' THEN target END WHEN lang = 'rust' THEN CASE WHEN tlang = 'rust' THEN target END WHEN tlang <> 'rust' THEN target END AS rf FROM q)
SELECT id, rf AS resolved_file_id, (SELECT first(s.id ORDER BY s.is_exported DESC, s.id) FROM symbols s WHERE s.file_id = rf AND s.name = t.imported_name) AS resolved_symbol_id, is_external AND rf IS NULL AS is_external FROM t""")
def resolve_imports(g: Graph) -> DataFrame:
    """All imports: relative ones, those of Rust files through the crate, and external ones, half of them behind an alias.
    Rust files have their suffix, the others are found as they are."""
    files = g.files.withColumn("path", F.when(F.col("language") == "rust", F.concat("path", F.lit(".rs"))).otherwise(F.col("path")))
    lang = g.files.select(F.col("id").alias("file_id"), F.col("language").alias("_l"))
    tail = F.substring_index("module_path", "/", -2)
    module = (
        F.when(F.col("is_external"), F.concat(F.when(F.col("id") % 2 == 0, "@app/").otherwise("other/"), tail))
        .when(F.col("_l") == "rust", F.concat(F.lit("crate::"), F.regexp_replace(tail, "/", "::"))).otherwise(F.concat(F.lit("../"), tail))
    )
    i = g.imports.join(lang, "file_id").withColumn("module_path", module).drop("resolved_file_id", "resolved_symbol_id", "_l")
    return resolution.resolve_imports(i, files, g.symbols, [("@app/*", "./src/*")]).select("id", "resolved_file_id", "resolved_symbol_id", "is_external")


@query("SELECT id, 'src/' || split_part(path, '/', 2) || '/x' AS path FROM files")
def normalize_path(g: Graph) -> DataFrame:
    from callweave.functions.text import normalized_path

    raw = F.concat(F.lit("./"), F.substring_index("path", "/", 2), F.lit("/./y/../z/w/../../x"))
    return g.files.select("id", normalized_path(raw).alias("path"))


@query("SELECT id, CASE WHEN starts_with(path, 'src/a') THEN 'lib/' || substr(path, 6) || '.gen' WHEN starts_with(path, 'src/') THEN 'app/' || substr(path, 5) END AS expanded FROM files")
def expand_alias(g: Graph) -> DataFrame:
    return g.files.select("id", resolution.expand_alias(F.col("path"), [("src/*", "./app/*"), ("src/a*", "lib/*.gen")]).alias("expanded"))


@query("SELECT c.id, (SELECT arg_max(s.id, s.line_start::HUGEINT * 100000000 + s.id) FROM symbols s WHERE s.file_id = c.file_id AND s.name = y.name) AS caller_symbol_id FROM calls c JOIN symbols y ON y.id = c.caller_symbol_id")
def ingest_parse_result(g: Graph) -> DataFrame:
    names = g.symbols.select(F.col("id").alias("caller_symbol_id"), F.col("name").alias("caller_name"))
    raw = g.calls.join(names, "caller_symbol_id").select("id", "file_id", "caller_name", "callee_name", "line")
    return resolution.ingest_calls(raw, g.symbols).select("id", "caller_symbol_id")


# --- entry points ----------------------------------------------------------------------------------------------------


@query("""SELECT id, is_entry_point OR name IN ('main', 'Main', 'run', 'start', 'init', 'constructor', '<module>', (SELECT name FROM symbols WHERE id = 7)) OR name ILIKE '%_handler' OR name ILIKE 'handle_%' OR name ILIKE '%Handler'
OR name ILIKE '%Component' OR name ILIKE '%Module' OR name ILIKE '%Service' OR name ILIKE '%Directive' OR name ILIKE '%Pipe' OR name ILIKE '%Guard'
OR (kind = 'method' AND lower(split_part(qualified_name, '.', 1)) IN (SELECT lower(name) FROM symbols WHERE kind = 'class')) AS is_entry_point FROM symbols""")
def entry_marking(g: Graph) -> DataFrame:
    return derive.with_entry_points(g.symbols, g.files, ["angular", "nextjs"], [_some_name(g)]).select("id", "is_entry_point")


@query(""", e AS (SELECT s.id, s.name, s.qualified_name, min(p) AS p FROM symbols s JOIN (SELECT handler_symbol_id AS id, 1 AS p FROM endpoints UNION ALL SELECT id, 2 FROM symbols WHERE is_entry_point UNION ALL SELECT id, 3 FROM symbols WHERE name = 'main' AND kind = 'function') x USING (id) WHERE NOT is_dead GROUP BY 1, 2, 3)
SELECT id, name, qualified_name, CASE p WHEN 1 THEN 'http' WHEN 2 THEN 'framework' ELSE 'main' END AS category FROM e ORDER BY category, name, id LIMIT 100""")
def entry_points(g: Graph) -> DataFrame:
    return derive.entry_points(g.symbols, g.files, g.endpoints)


# --- graph -----------------------------------------------------------------------------------------------------------

#: Searches start from every symbol whose id is divisible by 20. The oracles' recursions need a bound to end on cycles;
#: where the operator has none, theirs (DEEP) lies beyond every distance of the test tables. A deeper graph has more rows
#: in the query than in the oracle: those at depths beyond the bound.
DEEP = 64
UP = ", up AS (SELECT id AS key, id AS node, 0 AS depth FROM symbols WHERE id % 20 = 0 UNION SELECT key, src, depth + 1 FROM up JOIN edges ON dst = node WHERE src <> dst AND depth < {0}), upd AS (SELECT key, node, min(depth) AS depth FROM up GROUP BY 1, 2) "
DOWN = ", dn AS (SELECT id AS key, id AS node, 0 AS depth FROM symbols WHERE id % 20 = 0 UNION SELECT key, dst, depth + 1 FROM dn JOIN edges ON src = node WHERE src <> dst AND depth < {0}), dnd AS (SELECT key, node, min(depth) AS depth FROM dn GROUP BY 1, 2) "
CLOSURE = ", live AS (SELECT id FROM symbols WHERE is_entry_point OR is_exported OR is_test UNION SELECT dst FROM live JOIN edges ON src = live.id) "


@query("SELECT s.id, s.name, qualified_name, kind, path AS file_path, line_start FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.id IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def build_call_graph(g: Graph) -> DataFrame:
    return impact.graph_nodes(g.calls, g.symbols, g.files)


@query("SELECT DISTINCT callee_symbol_id AS target, caller_symbol_id AS id FROM calls")
def dependents(g: Graph) -> DataFrame:
    return impact.dependents(g.calls, g.imports, g.symbols, g.symbols.select(F.col("id").alias("target")))


@query("SELECT caller_symbol_id AS source, callee_symbol_id AS id, line FROM calls")
def dependencies(g: Graph) -> DataFrame:
    return impact.dependencies(g.calls, g.symbols.select(F.col("id").alias("source")))


@query(UP.format(4) + "SELECT key, node, depth FROM upd WHERE depth > 0")
def traverse_up(g: Graph) -> DataFrame:
    return impact.traverse(g.edges, g.seeds, 4, up=True)


@query(DOWN.format(4) + "SELECT key, node, depth FROM dnd WHERE depth > 0")
def traverse_down(g: Graph) -> DataFrame:
    return impact.traverse(g.edges, g.seeds, 4)


@query(UP.format(11) + "SELECT key, node, depth, depth = 1 AS direct FROM upd WHERE depth > 0")
def blast_radius(g: Graph) -> DataFrame:
    return impact.blast_radius(g.edges, g.seeds)


@query(UP.format(11) + "SELECT key, string_agg(DISTINCT path, ',' ORDER BY path) AS affected_files, count(*) AS total, count(*) FILTER (depth = 1) AS n_direct FROM upd JOIN symbols s ON s.id = node JOIN files f ON f.id = s.file_id WHERE depth > 0 GROUP BY 1")
def blast_radius_files(g: Graph) -> DataFrame:
    return impact.blast_summary(impact.blast_radius(g.edges, g.seeds), g.symbols, g.files)


@query(UP.format(11) + TOPO + """, own AS (SELECT DISTINCT key, service_id FROM upd JOIN symbols s ON s.id = node JOIN files f ON f.id = s.file_id WHERE depth > 0),
sv AS (SELECT key, service_id, 0 AS rank FROM own UNION SELECT key, from_service_id, rank + 1 FROM sv JOIN topo ON to_service_id = service_id WHERE rank < 6) SELECT key, service_id, min(rank) AS rank FROM sv GROUP BY 1, 2""")
def blast_radius_cross_service(g: Graph) -> DataFrame:
    return impact.blast_radius_services(impact.blast_radius(g.edges, g.seeds), g.symbols, g.files, _topology(g))


@query(DOWN.format(DEEP) + """, pt AS (SELECT d.key, d.node, d.depth, (SELECT min(src) FROM edges JOIN dnd p ON p.key = d.key AND p.node = src AND p.depth = d.depth - 1 WHERE dst = d.node) AS parent FROM dnd d),
wk AS (SELECT key AS src, node AS dst, depth AS step, node, parent FROM pt UNION ALL SELECT w.src, w.dst, w.step - 1, p.node, p.parent FROM wk w JOIN pt p ON p.key = w.src AND p.node = w.parent) SELECT src, dst, step, node FROM wk""")
def shortest_path(g: Graph) -> DataFrame:
    """The paths themselves, from every source to all that it reaches."""
    return impact.shortest_paths(g.edges, g.seeds.select(F.col("key").alias("src")))


@query(REACH + "SELECT cycle, count(*) AS size, string_agg(qualified_name, ',' ORDER BY qualified_name, node) AS members FROM scc JOIN symbols s ON s.id = node GROUP BY 1")
def detect_cycles(g: Graph) -> DataFrame:
    return impact.detect_cycles(g.edges, g.symbols)


@query(DOWN.format(10).replace("id % 20 = 0", "id = 3") + "SELECT '    n3[' || (SELECT name FROM symbols WHERE id = 3) || '] --> n' || node || '[' || name || ']' AS line FROM dnd JOIN symbols s ON s.id = node WHERE depth > 0")
def call_chain(g: Graph) -> DataFrame:
    return impact.call_chain(g.edges, 3, g.symbols)


@query(INTERNAL + "SELECT community_id AS id, 'community_' || community_id AS name, symbol_count, internal AS internal_edges, 0::BIGINT AS external_edges, (internal / greatest(internal, 1))::DOUBLE AS modularity FROM i")
def communities(g: Graph) -> DataFrame:
    return impact.communities(g.symbols, g.edges)[1]


@query(CC + "SELECT community_id, count(*) AS n, string_agg(name, ',' ORDER BY name, s.id) AS members FROM mem JOIN symbols s ON s.id = mem.id GROUP BY 1")
def community_list(g: Graph) -> DataFrame:
    members = impact.communities(g.symbols, g.edges)[0].join(g.symbols.select("id", "name"), "id")
    return members.groupBy("community_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "id"))), lambda x: x["name"]), ",").alias("members"))


@query(CC + ", n AS (SELECT community_id, path, count(*) AS n FROM mem JOIN symbols s ON s.id = mem.id JOIN files f ON f.id = s.file_id GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY n DESC, path)::INTEGER AS rank FROM n) WHERE rank <= 5")
def boundaries(g: Graph) -> DataFrame:
    return derive.boundaries(impact.communities(g.symbols, g.edges)[0], g.symbols, g.files)


@query(INTERNAL + "SELECT count(*) AS total_modules, coalesce(avg((internal / greatest(internal, 1))::DOUBLE), 0) AS avg_modularity, 0::BIGINT AS boundary_violations FROM i")
def boundary_summary(g: Graph) -> DataFrame:
    """No edge leaves a component, so none has more edges outward than inside."""
    return derive.boundary_summary(impact.communities(g.symbols, g.edges)[1])


MODM = ", mm AS (SELECT s.id, module AS community_id FROM symbols s JOIN modf USING (file_id)) "


@query(MODM + "SELECT a.community_id AS from_community, b.community_id AS to_community, count(*) AS n, string_agg(DISTINCT callee_name, ',' ORDER BY callee_name) AS callees FROM calls c JOIN mm a ON a.id = caller_symbol_id JOIN mm b ON b.id = callee_symbol_id WHERE a.community_id <> b.community_id GROUP BY 1, 2")
def cross_community_calls(g: Graph) -> DataFrame:
    mod = g.files.select(F.col("id").alias("file_id"), metrics.module_of(F.col("path")).alias("m"))
    return derive.cross_community_calls(g.symbols.join(mod, "file_id").select("id", "m"), g.calls)


@query(CLOSURE + "SELECT id FROM live")
def reachability(g: Graph) -> DataFrame:
    return impact.reachable(g.symbols, g.edges)


@query(CLOSURE + "SELECT id, kind IN ('function', 'method') AND NOT is_test AND id NOT IN (SELECT id FROM live) AS is_dead FROM symbols")
def dead_code(g: Graph) -> DataFrame:
    return impact.with_dead(g.symbols, g.calls).select("id", "is_dead")


FLOWS = ", fl AS (SELECT id AS flow_id, id AS symbol_id, 0 AS depth FROM symbols WHERE is_entry_point UNION SELECT flow_id, dst, depth + 1 FROM fl JOIN edges ON src = symbol_id WHERE depth < 64), fs AS (SELECT flow_id, symbol_id, min(depth) AS depth FROM fl GROUP BY 1, 2), fo AS (SELECT *, (row_number() OVER (PARTITION BY flow_id ORDER BY depth, symbol_id) - 1)::INTEGER AS step_order FROM fs) "


@query(FLOWS + "SELECT flow_id, symbol_id, step_order, depth FROM fo")
def flows(g: Graph) -> DataFrame:
    return impact.flows(g.symbols, g.edges).select("flow_id", "symbol_id", "step_order", "depth")


@query(FLOWS + ", m AS (SELECT min(symbol_id) AS x FROM fo WHERE depth > 1) SELECT flow_id, symbol_id, step_order, depth FROM fo WHERE flow_id IN (SELECT flow_id FROM fo, m WHERE symbol_id = x) ORDER BY flow_id, step_order LIMIT 200")
def execution_flows(g: Graph) -> DataFrame:
    steps = impact.flows(g.symbols, g.edges)
    return impact.execution_flows(steps, steps.where("depth > 1").agg(F.min("symbol_id")).first()[0]).select("flow_id", "symbol_id", "step_order", "depth")


@query(UP.format(DEEP).replace("id % 20 = 0", "id = 40") + REACH + "SELECT node, depth, EXISTS (SELECT 1 FROM scc JOIN upd USING (node)) OR EXISTS (SELECT 1 FROM edges JOIN upd ON node = src WHERE src = dst) AS has_cycle FROM upd")
def edit_plan(g: Graph) -> DataFrame:
    return impact.edit_plan(g.edges, 40)


CHANGED = ", ch AS (SELECT id AS node FROM symbols WHERE file_id % 20 = 0 UNION SELECT src FROM ch JOIN edges ON dst = node) "


@query(CHANGED + "SELECT id, name FROM symbols WHERE is_test AND id IN (SELECT node FROM ch)")
def affected_tests(g: Graph) -> DataFrame:
    return impact.affected_tests(g.symbols, g.edges, g.symbols.where("file_id % 20 = 0").select("id"))


@query(CHANGED.replace("WHERE file_id % 20 = 0", "WHERE file_id % 20 = 0 AND id IN (SELECT src FROM edges UNION SELECT dst FROM edges)") + "SELECT min(id) AS id, name FROM symbols WHERE is_test AND id IN (SELECT node FROM ch) GROUP BY name")
def affected_tests_by_name(g: Graph) -> DataFrame:
    return impact.affected_tests(g.symbols, g.edges, g.symbols.where("file_id % 20 = 0").select("id"), by_name=True)


DIFF = UP.format(5).replace("id % 20 = 0", "file_id % 20 = 0") + ", df AS (SELECT key, s.id, name, qualified_name, kind, path, depth, is_test FROM upd JOIN symbols s ON s.id = node JOIN files f ON f.id = s.file_id WHERE depth > 0) "


def _diff(g: Graph) -> dict[str, DataFrame]:
    return impact.diff_impact(g.symbols, g.files, g.edges, g.symbols.where("file_id % 20 = 0").select("id"))


@query(DIFF + "SELECT path, count(*) AS n FROM df GROUP BY 1 ORDER BY n DESC, path LIMIT 20")
def diff_impact(g: Graph) -> DataFrame:
    return _diff(g)["focus"]


@query(DIFF + "SELECT key, id, name, qualified_name, kind, path, depth FROM df WHERE NOT is_test")
def diff_impact_details(g: Graph) -> DataFrame:
    return _diff(g)["details"]


@query(DIFF + "SELECT min(id) AS id, name, arg_min(qualified_name, id) AS qualified_name, arg_min(path, id) AS path FROM df WHERE is_test GROUP BY name")
def diff_impact_tests(g: Graph) -> DataFrame:
    return _diff(g)["tests"]


@query(""", bw AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), nb AS (SELECT 3::BIGINT AS node, 0 AS depth UNION SELECT b, depth + 1 FROM nb JOIN bw ON a = node WHERE depth < 3), nd AS (SELECT node, min(depth) AS depth FROM nb GROUP BY 1),
ie AS (SELECT src, dst FROM edges WHERE src IN (SELECT node FROM nd) AND dst IN (SELECT node FROM nd)) SELECT node, depth, (SELECT count(*) FROM (SELECT src AS x FROM ie UNION ALL SELECT dst FROM ie) WHERE x = node) AS degree FROM nd""")
def neighborhood(g: Graph) -> DataFrame:
    return impact.neighborhood(g.edges, 3, 3)[0]


DATA = ", top AS (SELECT id, name, kind FROM symbols ORDER BY id LIMIT 5000), ge AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top) ORDER BY src, dst LIMIT 10000) "


@query(DATA + "SELECT src, dst FROM ge")
def graph_data(g: Graph) -> DataFrame:
    return impact.graph_data(g.symbols, g.edges, metrics.group_code(F.col("kind")))[1]


@query(DATA + "SELECT id, name, CASE kind WHEN 'function' THEN 0 WHEN 'class' THEN 1 WHEN 'method' THEN 2 WHEN 'interface' THEN 3 ELSE 4 END AS group_code, (SELECT count(*) FROM (SELECT src AS x FROM ge UNION ALL SELECT dst FROM ge) WHERE x = id) AS degree FROM top")
def graph_data_nodes(g: Graph) -> DataFrame:
    return impact.graph_data(g.symbols, g.edges, metrics.group_code(F.col("kind")))[0]


@query(", ev AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges WHERE (src + dst) % 3 = 0) SELECT DISTINCT x.src AS a, x.dst AS b FROM ev x JOIN ev y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst ORDER BY a, b LIMIT 10")
def mutual_calls(g: Graph) -> DataFrame:
    """This graph has none, so a third of the edges are called back."""
    back = g.edges.where("(src + dst) % 3 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return impact.mutual_calls(g.edges.union(back))


@query("SELECT DISTINCT x.src AS a, x.dst AS b FROM links x JOIN links y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def mutual_files(g: Graph) -> DataFrame:
    return impact.mutual_calls(impact.file_links(g.calls, g.imports, g.symbols).select("src", "dst").distinct(), limit=None)


@query("SELECT src AS file_id, dst AS other, string_agg(DISTINCT kind || ':' || from_name || '>' || to_name, ',' ORDER BY kind || ':' || from_name || '>' || to_name) AS connections FROM links GROUP BY 1, 2")
def file_dependencies(g: Graph) -> DataFrame:
    return impact.file_dependencies(impact.file_links(g.calls, g.imports, g.symbols))


@query("SELECT dst AS file_id, src AS other, string_agg(DISTINCT kind || ':' || from_name || '>' || to_name, ',' ORDER BY kind || ':' || from_name || '>' || to_name) AS connections FROM links GROUP BY 1, 2")
def file_dependents(g: Graph) -> DataFrame:
    return impact.file_dependencies(impact.file_links(g.calls, g.imports, g.symbols), dependents_of=True)


@query(", tf AS (SELECT 3::BIGINT AS file_id, 0 AS depth UNION SELECT dst, depth + 1 FROM tf JOIN links ON src = file_id WHERE depth < 3), td AS (SELECT file_id, min(depth) AS depth FROM tf GROUP BY 1) SELECT t.file_id, t.depth, (SELECT min(src) FROM links JOIN td p ON p.file_id = src WHERE dst = t.file_id AND p.depth = t.depth - 1) AS via FROM td t WHERE depth > 0")
def transitive_file_deps(g: Graph) -> DataFrame:
    return impact.transitive_file_deps(impact.file_links(g.calls, g.imports, g.symbols), 3, 3)


# --- incremental -----------------------------------------------------------------------------------------------------

CHANGES = ", ch AS (SELECT f.path, e.ts, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events e JOIN files f ON f.id = e.event_id % (SELECT ns FROM ns)) "


def _changes(g: Graph) -> DataFrame:
    e = g.spark.read.parquet(f"{g.sf_dir}/events.parquet").crossJoin(F.broadcast(g.ns))
    e = e.select((F.col("event_id") % F.col("ns")).alias("f"), "ts", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    return e.join(g.files.select(F.col("id").alias("f"), "path"), "f").select("path", "ts", "op")


@query(CHANGES + "SELECT path, arg_max(op, (epoch_us(ts) * 2 + (op = 'delete')::BIGINT)) AS op FROM ch GROUP BY 1")
def watch_last_changes(g: Graph) -> DataFrame:
    return _changes(g).groupBy("path").agg(F.max_by("op", F.struct("ts", F.col("op") == "delete")).alias("op"))


@query(CHANGES + """, s AS (SELECT ts, CASE WHEN ts <= lag(ts) OVER (ORDER BY ts) + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM (SELECT ts FROM ch)), k AS (SELECT ts, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT epoch_us(min(ts))::BIGINT AS start_us, epoch_us(max(ts))::BIGINT AS last_us, count(*) AS n FROM k GROUP BY k""")
def debounce(g: Graph) -> DataFrame:
    """Runs of changes without a quiet gap: the batches that the watcher would take."""
    runs = _changes(g).groupBy(F.session_window("ts", "5 minutes"), F.when(F.col("path").isNotNull(), "all").alias("tree")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return runs.select(*(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})").alias(n) for c, n in (("a", "start_us"), ("b", "last_us"))), "n")


# --- search ----------------------------------------------------------------------------------------------------------


@query("SELECT id, name, 1.0::DOUBLE AS score FROM symbols WHERE name ILIKE '%an%' ORDER BY name, id LIMIT 20")
def like_search(g: Graph) -> DataFrame:
    return search.like_search(g.symbols, "AN")


@query(", p AS (SELECT id, name FROM symbols WHERE name ILIKE (SELECT substr(name, 1, 2) FROM symbols WHERE id = 7) || '%' ORDER BY id LIMIT 200) SELECT id, name, round(1 - levenshtein(name, q) / greatest(strlen(name), strlen(q)), 6)::DOUBLE AS score FROM p, (SELECT name AS q FROM symbols WHERE id = 7) ORDER BY score DESC, id LIMIT 20")
def fuzzy_search(g: Graph) -> DataFrame:
    return search.fuzzy_search(g.symbols, _some_name(g))


TOK = """, tk AS (SELECT id, 0 AS field, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT id, regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+') AS w FROM symbols)
UNION ALL SELECT id, 1, unnest(w), generate_subscripts(w, 1) - 1 FROM (SELECT id, regexp_extract_all(lower(qualified_name), '[\\p{L}\\p{N}]+') AS w FROM symbols)
UNION ALL SELECT id, 2, unnest(w), generate_subscripts(w, 1) - 1 FROM (SELECT id, regexp_extract_all(lower(signature), '[\\p{L}\\p{N}]+') AS w FROM symbols)),
tf AS (SELECT a.id, count(*) AS tf FROM tk a JOIN tk b ON a.id = b.id AND a.field = b.field AND b.pos = a.pos + 1, (SELECT regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+') AS q FROM symbols WHERE id = 7) WHERE a.token = q[1] AND starts_with(b.token, substr(q[2], 1, 3)) GROUP BY 1),
ln AS (SELECT id, count(*) AS n FROM tk GROUP BY 1), tot AS (SELECT (SELECT avg(n) FROM ln) AS mean, (SELECT count(*) FROM symbols) AS docs, (SELECT count(*) FROM tf) AS df)
"""


@query(TOK + "SELECT id, round(greatest(ln((docs - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean)), 6)::DOUBLE AS score FROM tf JOIN ln USING (id), tot ORDER BY score DESC, id LIMIT 20")
def fts_search(g: Graph) -> DataFrame:
    a, b = search.query_tokens(_some_name(g))[:2]
    return search.fts_search(g.symbols, f"{a} {b[:3]}")


PHRASE = TOK.replace("q[2], 1, 3", "q[2], 1, 1000").replace("AND starts_with(b.token", "AND b.id = a.id AND starts_with(b.token")


SEARCH = PHRASE + """, q AS (SELECT name AS q FROM symbols WHERE id = 7),
ft AS (SELECT id, round(greatest(ln((docs - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean)), 6)::DOUBLE AS score FROM tf JOIN ln USING (id), tot ORDER BY score DESC, id LIMIT 50),
fz AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place, score FROM (SELECT id, round(1 - levenshtein(name, q) / greatest(strlen(name), strlen(q)), 6) AS score FROM (SELECT * FROM symbols, q WHERE name ILIKE substr(q, 1, 2) || '%' ORDER BY id LIMIT 500) ORDER BY score DESC, id LIMIT 50)),
al AS (SELECT id, 1 AS source, -score AS s FROM ft UNION ALL SELECT id, 3, -score FROM fz WHERE place <= 50 - (SELECT count(*) FROM ft)),
on_ AS (SELECT id, min(source) AS source, arg_min(s, source) AS s FROM al GROUP BY 1)
SELECT s.id, s.name, round(jaro_winkler_similarity(s.name, q), 6)::DOUBLE AS score FROM on_ JOIN symbols s USING (id), q ORDER BY score DESC, source, on_.s, s.id LIMIT 50"""


@query(SEARCH)
def search_symbols(g: Graph) -> DataFrame:
    return search.search(g.symbols, _some_name(g))


@query(TOK.replace("AND starts_with(b.token, substr(q[2], 1, 3))", "AND starts_with(b.token, q[2])") + "SELECT id, round(greatest(ln((docs - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean)), 6)::DOUBLE AS score FROM tf JOIN ln USING (id), tot ORDER BY score DESC, id LIMIT 100")
def raw_search(g: Graph) -> DataFrame:
    """The match expression as it is given, up to 100 rows."""
    return search.fts_search(g.symbols, " ".join(search.query_tokens(_some_name(g))[:2]), 100)


@query(SEARCH)
def workspace_symbols(g: Graph) -> DataFrame:
    """Search with the fuzzy part, up to 50 rows."""
    return search.search(g.symbols, _some_name(g), 50, True)


# --- sources ---------------------------------------------------------------------------------------------------------


@query("SELECT s.name AS service, s.repo_path || '/' || f.path AS absolute_path, f.path, f.language, first_value(language) OVER (PARTITION BY service_id ORDER BY n DESC, language) AS primary_language FROM files f JOIN services s ON s.id = f.service_id JOIN (SELECT service_id, language, count(*) AS n FROM files GROUP BY 1, 2) USING (service_id, language)")
def create_structure(g: Graph) -> DataFrame:
    first = lookups.language_rank(g.files).where("rank = 1").select("service_id", F.col("language").alias("primary_language"))
    s = g.services.select(F.col("id").alias("service_id"), F.col("name").alias("service"), "repo_path")
    f = g.files.join(s, "service_id").join(first, "service_id")
    return f.select("service", F.concat_ws("/", "repo_path", "path").alias("absolute_path"), "path", "language", "primary_language")


@query(", d AS (SELECT s.id, s.file_id, row_number() OVER (PARTITION BY s.file_id ORDER BY s.id) AS k, (SELECT min(dst) FROM edges WHERE src = s.id) AS callee FROM symbols s) SELECT f.path, 's' || d.id AS name, (2 * k - 1)::INTEGER AS line_start, (2 * k)::INTEGER AS line_end, CASE WHEN callee IS NOT NULL THEN 's' || callee END AS callee FROM d JOIN files f ON f.id = d.file_id")
def parse_files(g: Graph) -> DataFrame:
    """Sources written from the graph, one function of two lines for each symbol, parsed again."""
    from callweave.sources.parsers import parse_files as parse

    low = g.edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("callee"))
    body = F.concat(F.lit("def s"), F.col("id").cast("string"), F.lit("():\n    "), F.coalesce(F.concat(F.lit("return s"), F.col("callee").cast("string"), F.lit("()")), F.lit("pass")), F.lit("\n"))
    code = g.symbols.join(low, "id", "left").groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", body.alias("b")))), lambda x: x["b"]), "").alias("content"))
    parsed = parse(g.files.select(F.col("id").alias("file_id"), "path").join(code, "file_id").select("path", F.lit("python").alias("language"), "content"))
    calls = parsed.select("path", F.inline("calls")).select("path", F.col("caller_name").alias("name"), F.col("callee_name").alias("callee"))
    return parsed.select("path", F.inline("symbols")).select("path", "name", "line_start", "line_end").join(calls, ["path", "name"], "left")


@query("SELECT '/' || replace(r_name, ' ', '_') || '/' || n_name AS path_pattern, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey)::INTEGER + 1 AS line FROM nation JOIN region ON r_regionkey = n_regionkey")
def proto_source(g: Graph) -> DataFrame:
    from callweave.sources.schemas import schema_endpoints

    n, r = (g.spark.read.parquet(f"{g.sf_dir}/{t}.parquet") for t in ("nation", "region"))
    rpcs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("  rpc "), x["n_name"], F.lit(" (A) returns (B);"))), "\n").alias("b"))
    tree = rpcs.select(F.concat("r_name", F.lit(".proto")).alias("path"), F.concat(F.lit("service "), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit(" {\n"), "b", F.lit("\n}\n")).alias("content"))
    return schema_endpoints(tree).select("path_pattern", "line")


@query("SELECT method, path_pattern, 'op' || id AS operation_id FROM endpoints")
def openapi_source(g: Graph) -> DataFrame:
    from callweave.sources.schemas import schema_endpoints

    item = F.map_from_arrays(F.array(F.lower("method")), F.array(F.struct(F.concat(F.lit("op"), "id").alias("operationId"))))
    tree = g.endpoints.groupBy("service_id").agg(F.map_from_entries(F.collect_list(F.struct("path_pattern", item.alias("i")))).alias("paths"))
    return schema_endpoints(tree.select(F.concat(F.lit("s"), "service_id", F.lit("/openapi.json")).alias("path"), F.to_json(F.struct("paths")).alias("content"))).select("method", "path_pattern", "operation_id")


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS slice FROM documents")
def source_slice(g: Graph) -> DataFrame:
    from callweave.sources.discover import source_slice as cut

    return g.spark.read.parquet(f"{g.sf_dir}/documents.parquet").select("doc_id", cut(F.col("text"), F.lit(2), F.lit(3)).alias("slice"))


@query("SELECT id, NOT (regexp_matches(path, '^src/[^/]*3/') OR (regexp_matches(path, '7$') AND NOT regexp_matches(path, '17$')) OR (regexp_matches(path, '7/') AND NOT regexp_matches(path, '17/'))) AS kept FROM files")
def ignore_files(g: Graph) -> DataFrame:
    from callweave.sources.discover import ignore_rules, ignored_column

    rules = ignore_rules("", "*7\n!*17\n") + ignore_rules("src", "/*3/\n")
    return g.files.select("id", (~ignored_column(F.col("path"), rules)).alias("kept"))


@query("SELECT id, path || CASE id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' ELSE '.txt' END AS path, CASE id % 3 WHEN 0 THEN 'python' ELSE 'rust' END AS language FROM files WHERE id % 3 <> 2 AND NOT path GLOB 'src/*_1?/*' AND NOT contains(path, '/nation_5/')")
def discover_files(g: Graph) -> DataFrame:
    from callweave.sources.discover import accepted
    from callweave.sources.parsers import language_of

    f = g.files.select("id", F.concat("path", F.element_at(F.array(F.lit(".py"), F.lit(".rs"), F.lit(".txt")), (F.col("id") % 3 + 1).cast("int"))).alias("path"))
    return f.where(accepted(F.col("path"), ["src/*_1?/*", "nation_5"])).withColumn("language", language_of(F.col("path")))


@query("SELECT id, id AS file_id FROM files")
def resolve_module_path(g: Graph) -> DataFrame:
    """Every file found again from a neighbour by a relative import, as an index file, with an extension or as it is."""
    kinds = F.array(F.lit(""), F.lit(".tsx"), F.lit("/index.js"))
    files = g.files.select("id", F.concat("path", F.element_at(kinds, (F.col("id") % 3 + 1).cast("int"))).alias("path"))
    asks = g.files.select("id", F.concat(F.lit("./../x/../"), F.substring_index("path", "/", -2)).alias("module"), F.lit("src/here/a.ts").alias("importer"))
    return resolution.first_existing(asks, files, resolution.module_candidates(F.col("module"), F.col("importer"), []))


@query("SELECT id, id AS file_id FROM files")
def resolve_rust_module(g: Graph) -> DataFrame:
    """Every file found again from a path through the crate that goes on to a symbol."""
    kinds = F.array(F.lit(".rs"), F.lit("/mod.rs"))
    files = g.files.select("id", F.concat("path", F.element_at(kinds, (F.col("id") % 2 + 1).cast("int"))).alias("path"))
    asks = g.files.select("id", F.concat(F.lit("crate::"), F.regexp_replace(F.substring_index("path", "/", -2), "/", "::"), F.lit("::Thing::*")).alias("module"), F.lit("src/x/y.rs").alias("importer"))
    return resolution.first_existing(asks, files, resolution.rust_candidates(F.col("module"), F.col("importer")))


@query("SELECT s.id, is_entry_point OR name IN ('main', 'Main', 'run', 'start', 'init', 'constructor', '<module>') OR name ILIKE '%_handler' OR name ILIKE 'handle_%' OR name ILIKE '%Handler' OR (is_exported AND f.id % 4 = 1) OR (kind = 'method' AND lower(split_part(qualified_name, '.', 1)) IN (SELECT lower(name) FROM symbols WHERE kind = 'class')) AS is_entry_point FROM symbols s JOIN files f ON f.id = s.file_id")
def framework_entry_points(g: Graph) -> DataFrame:
    f = g.files.withColumn("path", F.when(F.col("id") % 4 == 1, F.concat(F.substring_index("path", "/", 2), F.lit("/page.tsx"))).otherwise(F.col("path")))
    return derive.with_entry_points(g.symbols, f, ["nextjs"]).select("id", "is_entry_point")


#: How a function of two lines is written in each language that one lexical reader serves: head of a file, function, call, tail.
WRITTEN = {
    "javascript": ("", "function {} (a) {{\n", "  {}(a); }}\n", ""), "typescript": ("", "export function {}(a: number) {{\n", "  {}(a); }}\n", ""), "go": ("package p\n", "func {}(a int) {{\n", "  {}(a) }}\n", ""),
    "java": ("class C {\n", "public void {}(int a) {{\n", "  {}(a); }}\n", "}\n"), "csharp": ("class C {\n", "public void {}(int a) {{\n", "  {}(a); }}\n", "}\n"), "rust": ("", "pub fn {}(a: u8) {{\n", "  {}(a); }}\n", ""),
    "php": ("<?php\n", "function {}($a) {{\n", "  {}($a); }}\n", ""), "ruby": ("", "def {}(a)\n", "  {}(a) ; end\n", ""),
}


def _parser_query(language: str) -> None:
    head, define, call, tail = WRITTEN[language]
    first = head.count("\n")
    oracle = f""", d AS (SELECT s.id, s.file_id, row_number() OVER (PARTITION BY s.file_id ORDER BY s.id) AS k, (SELECT min(dst) FROM edges WHERE src = s.id) AS callee FROM symbols s)
SELECT f.path, 's' || d.id AS name, ({first} + 2 * k - 1)::INTEGER AS line_start, ({first} + 2 * k)::INTEGER AS line_end, CASE WHEN callee IS NOT NULL THEN 's' || callee END AS callee, CASE WHEN callee IS NOT NULL THEN ({first} + 2 * k)::INTEGER END AS line FROM d JOIN files f ON f.id = d.file_id"""

    def run(g: Graph) -> DataFrame:
        from callweave.sources.parsers import parse_files as parse

        low = g.edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("callee"))
        name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
        fill = lambda text, c: F.concat(F.lit(text.split("{}")[0]), name(c), F.lit(text.split("{}")[1].replace("{{", "{").replace("}}", "}")))
        empty = F.lit("  ; end\n" if language == "ruby" else "  }\n")
        body = F.concat(fill(define, "id"), F.when(F.col("callee").isNotNull(), fill(call, "callee")).otherwise(empty))
        code = g.symbols.join(low, "id", "left").groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", body.alias("b")))), lambda x: x["b"]), "").alias("c"))
        tree = g.files.select(F.col("id").alias("file_id"), "path").join(code, "file_id").select("path", F.lit(language).alias("language"), F.concat(F.lit(head), "c", F.lit(tail)).alias("content"))
        parsed = parse(tree)
        calls = parsed.select("path", F.inline("calls")).select("path", F.regexp_extract("caller_name", r"(s\d+)$", 1).alias("name"), F.col("callee_name").alias("callee"), "line")
        return parsed.select("path", F.inline("symbols")).where("kind in ('function', 'method')").select("path", "name", "line_start", "line_end").join(calls, ["path", "name"], "left")

    run.__name__ = f"parse_{language}"
    run.__doc__ = f"{language} sources written from the graph, one function of two lines for each symbol, parsed again."
    query(oracle)(run)


for _language in WRITTEN:
    _parser_query(_language)


@query("SELECT '@' || lower(replace(r_name, ' ', '-')) || '/*' AS pattern, 'src/' || lower(replace(r_name, ' ', '-')) || '/*' AS target, (row_number() OVER (ORDER BY length(r_name) DESC, '@' || lower(replace(r_name, ' ', '-')) || '/*'))::INTEGER AS place FROM region")
def tsconfig_source(g: Graph) -> DataFrame:
    """Aliases of a configuration written from the regions, with comments and trailing commas."""
    from callweave.sources.schemas import tsconfig_aliases

    names = [r.r_name.lower().replace(" ", "-") for r in g.spark.read.parquet(f"{g.sf_dir}/region.parquet").collect()]
    paths = "".join(f'"@{n}/*": ["./{n}/*", "x"], // {n}\n' for n in names)
    got = tsconfig_aliases('{"compilerOptions": {/* here */ "baseUrl": "./src", "paths": {' + paths + "},},}")
    return g.spark.createDataFrame([(p, t, k) for k, (p, t) in enumerate(got, 1)], "pattern string, target string, place int")


@query("SELECT framework FROM (VALUES ('node'), ('nextjs'), ('vue'), ('pip'), ('django'), ('docker')) AS t(framework)")
def detect_frameworks(g: Graph) -> DataFrame:
    """What marker files, a manifest and requirements tell; the projected files tell nothing."""
    from callweave.sources.discover import detect_frameworks as told

    rows = [("package.json", '{"dependencies": {"next": "1"}, "devDependencies": {"vue": "3", "left-pad": "1"}}'), ("requirements.txt", "# x\nDjango==4\nnumpy\n"), ("Dockerfile", ""), ("deep/angular.json", "{}")]
    tree = g.files.select("path", F.lit("").alias("content")).union(g.spark.createDataFrame(rows, "path string, content string"))
    return g.spark.createDataFrame([(f,) for f in told(tree)], "framework string")


@query("""SELECT 'symbol' AS kind, path, name, line_start AS line FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.id % 5 > 1 UNION ALL SELECT 'call', path, callee_name, line FROM calls c JOIN files f ON f.id = c.file_id WHERE f.id % 5 > 1
UNION ALL SELECT 'symbol', path, unnest(['first', 'second']), unnest([1, 3]) FROM files WHERE id % 5 = 1 UNION ALL SELECT 'call', path, 'second', 2 FROM files WHERE id % 5 = 1""")
def watch_apply_batch(g: Graph) -> DataFrame:
    """Symbols and calls after a batch that deletes a fifth of the files and rewrites another."""
    from callweave.plans.indexing import shaped
    from callweave.streaming.watch import BASE, apply_batch

    base = {n: shaped(getattr(g, n).withColumn("path", F.concat("path", F.lit(".py"))) if n == "files" else getattr(g, n), n) for n in BASE}
    text = F.when(F.col("id") % 5 == 1, "def first():\n    second()\ndef second():\n    pass\n")
    batch = base["files"].where("id % 5 < 2").select("path", F.when(F.col("id") % 5 == 0, "delete").otherwise("upsert").alias("op"), text.alias("content"))
    out = apply_batch(base, batch)
    f = out["files"].select(F.col("id").alias("file_id"), F.regexp_replace("path", "[.]py$", "").alias("path"))
    return out["symbols"].join(f, "file_id").select(F.lit("symbol").alias("kind"), "path", "name", F.col("line_start").alias("line")).union(out["calls"].join(f, "file_id").select(F.lit("call"), "path", "callee_name", "line"))


@query("SELECT 1::BIGINT AS generation, 'files' AS relation, count(*) AS n, sum(id)::BIGINT AS ids FROM files UNION ALL SELECT 1, 'symbols', count(*), sum(id)::BIGINT FROM symbols UNION ALL SELECT 2, 'files', count(*), sum(id)::BIGINT FROM files WHERE id % 2 = 0 UNION ALL SELECT 2, 'symbols', count(*), sum(id)::BIGINT FROM symbols UNION ALL SELECT 2, 'flows', 0, NULL")
def store_generations(g: Graph) -> DataFrame:
    """Two generations of a store: the second replaces one relation and takes over the other."""
    import uuid

    from callweave.plans.checkpoints import shared_dir
    from callweave.plans.indexing import shaped
    from callweave.plans.store import Store

    store = Store(g.spark, f"{shared_dir(g.spark)}/store-{uuid.uuid4().hex}")
    store.write({"files": shaped(g.files, "files"), "symbols": shaped(g.symbols, "symbols")})
    store.write({"files": shaped(g.files.where("id % 2 = 0"), "files")})
    out = None
    for n, t in ((1, "files"), (1, "symbols"), (2, "files"), (2, "symbols"), (2, "flows")):
        row = store.read(t, n).agg(F.lit(n).cast("long").alias("generation"), F.lit(t).alias("relation"), F.count("*").alias("n"), F.sum("id").alias("ids"))
        out = row if out is None else out.union(row)
    return out
