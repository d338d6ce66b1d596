"""Registered queries against their DuckDB oracles: a few by default, all of them with CALLWEAVE_FULL=1."""

import math
import os

import duckdb
import pytest

from callweave import catalog
from callweave.plans.projection import NAMES

SF = "/root/testdata/sf0.001"
SOME = ["hotspots", "god_objects", "file_risk", "symbol_health", "resolve_calls", "resolve_imports", "dead_code", "blast_radius", "detect_cycles", "communities", "coupling", "file_dependencies", "search_symbols", "check_rules", "parse_files"]


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in (*NAMES, "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_all_have_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) and len(catalog.queries()) >= 100


@pytest.mark.parametrize("name", sorted(catalog.queries()) if os.environ.get("CALLWEAVE_FULL") else SOME)
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert mine == sorted(tuple(norm(r[i]) for i in order) for r in found.fetchall())


@pytest.fixture(scope="module")
def chain(tmp_path_factory):
    """A folder whose code graph is one chain of calls 0 -> 1 -> ... -> 66 with an entry point at 0, and DuckDB over it."""
    folder, con = tmp_path_factory.mktemp("chain"), duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    rows = {
        "part": "SELECT * REPLACE (i AS p_partkey, CASE i WHEN 0 THEN 1 ELSE 7 END::INTEGER AS p_size) FROM one, range(67) r(i)",
        "supplier": "SELECT * REPLACE (0::BIGINT AS s_suppkey) FROM one",
        "lineitem": "SELECT * REPLACE (0::BIGINT AS l_orderkey, i AS l_partkey, 0::BIGINT AS l_suppkey, i::INTEGER AS l_linenumber, 50::DOUBLE AS l_quantity) FROM one, range(67) r(i)",
    }
    for t in NAMES:
        body = rows.get(t, "FROM one")
        con.execute(f"COPY (WITH one AS (FROM '{SF}/{t}.parquet' LIMIT 1) {body}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


def test_flows_go_deeper_than_their_oracle(spark, chain):
    """The recursion of the oracle stops at 64 calls; the query has no such bound."""
    folder, con = chain
    got = sorted(map(tuple, catalog.queries()["flows"](spark, folder).collect()))
    assert got == [(0, k, k, k) for k in range(67)]  # flow_id, symbol_id, step_order, depth
    assert sorted(con.execute(catalog.oracle_sql()["flows"]).fetchall()) == [r for r in got if r[3] <= catalog.DEEP]


def test_shortest_paths_go_deeper_than_their_oracle(spark, chain):
    """As above, for whole paths: the sources are the ids divisible by 20."""
    folder, con = chain
    got = sorted(map(tuple, catalog.queries()["shortest_path"](spark, folder).collect()))
    assert got == [(s, d, k, s + k) for s in range(0, 67, 20) for d in range(s, 67) for k in range(d - s + 1)]  # src, dst, step, node
    assert sorted(con.execute(catalog.oracle_sql()["shortest_path"]).fetchall()) == [r for r in got if r[1] - r[0] <= catalog.DEEP]
