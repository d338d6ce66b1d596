"""A deterministic code graph over the driver's tables.

One SQL text per relation, which Spark and DuckDB both run (``{div}`` is integer division): the registered queries are
the engine's operators on these relations, and their oracles start from the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {
    "ns": "SELECT count(*) AS ns FROM supplier",
    "services": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, concat('/srv/', lower(r_name)) AS repo_path FROM region",
    "files": """SELECT s_suppkey AS id, CAST(n_regionkey AS BIGINT) AS service_id, concat('src/', lower(n_name), '/', s_name) AS path,
        CASE s_suppkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' ELSE 'go' END AS language,
        CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey % 4 AS INT) ELSE 0 END AS parse_error_count
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "symbols": """SELECT p_partkey AS id, p_partkey % ns AS file_id, p_name AS name, concat(p_brand, '.', p_name) AS qualified_name,
        CASE p_size % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 4 THEN 'constant' ELSE 'function' END AS kind,
        CAST((p_partkey {div} ns) * 60 + 1 AS INT) AS line_start, CAST((p_partkey {div} ns) * 60 + p_size AS INT) AS line_end,
        p_partkey % 4 = 0 AS is_exported, p_size = 50 AS is_test, p_size <= 2 AS is_entry_point, p_type AS signature,
        p_size % 5 IN (1, 2, 3) AND p_size <> 50 AND p_partkey % 9 = 4 AS is_dead
        FROM part CROSS JOIN ns""",
    "steps": """SELECT l_orderkey, l_linenumber, l_partkey AS a, l_quantity,
        lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS b,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem""",
    "calls": """SELECT l_orderkey * 100 + k AS id, a AS caller_symbol_id, b AS callee_symbol_id, name AS callee_name, a % ns AS file_id,
        CAST(l_linenumber AS INT) AS line, CAST(0.95 AS DOUBLE) AS confidence, 'same_file' AS resolution
        FROM steps CROSS JOIN ns JOIN symbols ON symbols.id = b WHERE l_quantity >= 49 AND b IS NOT NULL""",
    "raw_calls": """SELECT id, caller_symbol_id, CASE id % 11 WHEN 0 THEN concat('alias.', callee_name) WHEN 1 THEN concat('console.', callee_name) WHEN 2 THEN 'println!'
        WHEN 3 THEN concat(callee_name, '.', callee_name) WHEN 4 THEN concat('set', upper(callee_name)) WHEN 5 THEN concat('missing_', callee_name) WHEN 6 THEN 'resolve'
        ELSE callee_name END AS callee_name, file_id, line FROM calls""",
    "imports": """SELECT c.id AS id, c.file_id AS file_id, c.callee_name AS imported_name, t.path AS module_path, CASE WHEN c.id % 7 = 0 THEN NULL ELSE s.file_id END AS resolved_file_id,
        CASE WHEN c.id % 7 = 0 THEN NULL ELSE s.id END AS resolved_symbol_id, c.line AS line, c.id % 7 = 0 AS is_external
        FROM calls c JOIN symbols s ON s.id = c.callee_symbol_id JOIN files t ON t.id = s.file_id WHERE c.file_id <> s.file_id AND c.line % 2 = 1""",
    "heritage_in": """SELECT s.id AS id, s.id AS child_symbol_id, p.name AS parent_name, 'extends' AS kind
        FROM symbols s JOIN symbols p ON p.id = s.id + 1 WHERE s.kind = 'class'""",
    "endpoints": """SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS service_id, CASE n_nationkey % 3 WHEN 0 THEN 'POST' ELSE 'GET' END AS method,
        concat('/', lower(n_name)) AS path_pattern, CAST(n_nationkey AS BIGINT) AS handler_symbol_id, 'http' AS protocol, CAST(n_nationkey % 5 AS BIGINT) AS file_id FROM nation""",
    "api_calls": """SELECT c_custkey AS id, CAST(n_regionkey AS BIGINT) AS service_id, c_custkey % 100 AS caller_symbol_id, CASE c_custkey % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'get' ELSE 'GET' END AS method,
        concat('https://api.example.com/', CASE WHEN c_custkey % 5 = 0 THEN upper(n_name) ELSE lower(n_name) END, '/', c_mktsegment) AS url_pattern, 'http' AS protocol
        FROM customer JOIN nation ON n_nationkey = (c_nationkey + c_custkey) % 25""",
    "commit_files": "SELECT DISTINCT CAST(l_orderkey AS STRING) AS commit, CAST(0 AS BIGINT) AS ts, path FROM lineitem JOIN files ON files.id = l_suppkey",
    "blame_rows": """SELECT event_id % np AS symbol_id, {epoch} AS ts, CAST(user_id AS STRING) AS author, CAST(CAST(ts AS DATE) AS STRING) AS commit
        FROM events CROSS JOIN (SELECT count(*) AS np FROM part) p""",
}
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation as a DataFrame; its sources are read with only the columns it needs."""
    sql = _with(name, div="div", epoch="timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in NAMES if f" {t}" in sql}
    for t in args:
        sql = _table(sql, t, "{" + t + "}")
    return spark.sql(sql, **args)


def _table(sql: str, name: str, to: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {to}", sql)


def _needs(name: str) -> list[str]:
    import re

    out: list[str] = []
    for other in re.findall(r"\b(?:FROM|JOIN) (\w+)", SQL[name]):
        if other in SQL:
            for x in [*_needs(other), other]:
                if x not in out:
                    out.append(x)
    return out


def _with(name: str, **names: str) -> str:
    parts = [f"{n} AS ({SQL[n].format(**names)})" for n in _needs(name)]
    return (f"WITH {', '.join(parts)} " if parts else "") + SQL[name].format(**names)


def ctes() -> str:
    """All relations as DuckDB CTEs, to begin an oracle with."""
    done: list[str] = []
    for n in SQL:
        done += [x for x in [*_needs(n), n] if x not in done]
    return ",\n".join(f"{n} AS ({SQL[n].format(div='//', epoch='CAST(floor(epoch(ts)) AS BIGINT)')})" for n in done)
