"""Spark queries against their DuckDB oracles on the smallest tables."""

import decimal

import duckdb
import pytest

from lintel.plans.catalog import QUERIES
from lintel.plans.oracle import SQL
from lintel.sources.corpus import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["file_metrics", "halstead_code", "mi_bands", "project_health", "folder_rollup", "rank_issues",
        "severity_counts", "parse_bug_scan", "parse_diagnosis", "fix_outcomes", "attempt_fold", "describe",
        "path_nodes", "path_edges", "common_prefix", "common_dir", "loc", "scan_prune", "diff_lines",
        "node_depth_markup", "nesting_cost_markup", "debt_trend", "upsert_latest", "calibration", "patch_overlay",
        "markup_nodes", "markup_stats", "node_metrics_markup", "node_metrics_code", "report", "requests", "export_patched",
        "sibling_order", "stream_upsert", "stream_debt_window"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(rows):
    def v(x):
        if isinstance(x, (float, decimal.Decimal)):
            return round(float(x), 6)
        return x
    return sorted(tuple("" if x is None else str(v(x)) for x in r) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    cols = sorted(sdf.columns)
    got = norm([tuple(r[c] for c in cols) for r in sdf.collect()])
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = norm([tuple(r[i] for i in idx) for r in res.fetchall()])
    assert got == want
