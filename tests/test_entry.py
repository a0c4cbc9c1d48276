"""Registered queries against their SQL twins, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from credsieve.plans.catalog import QUERIES
from credsieve.plans.oracle import ORACLE_SQL

SF = Path("/root/testdata/sf0.001")
TABLES = "orders events documents pages conversations labels".split()
# One of each kind; the check at the larger scale runs all of them.
SOME = [
    "lines_documents", "lines_pages", "mask_secret", "redact_line", "regex_matches", "tokens", "entropy_scores",
    "findings_custom", "summary_with_baseline", "sarif_results", "tree_scan", "user_rules_word_boundary", "diff_added_lines", "stream_scan",
]

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, str(SF))
    twin = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(twin.columns)
    mine = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    order = [twin.columns.index(c) for c in columns]
    theirs = sorted(str(tuple(r[i] for i in order)) for r in twin.fetchall())
    assert mine == theirs


def test_plans_keep_python_out(spark):
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan and "CartesianProduct" not in plan
