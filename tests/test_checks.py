"""Registered queries against their DuckDB reference.

By default a sample of all areas runs at the smallest scale; ALL_CHECKS=1 runs every one.
"""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from surveyloom.checks import catalog

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = (
    "src_1_csv_scan", "fn_7_proper_case", "fn_27_job_card", "w_1_newest_per_key", "w_6_vote_shares", "inf_3_category", "inf_9_majority_vote_data",
    "set_2_all_issues", "flow_11_export", "flow_2_table_run", "agg_18_conflicts",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("key", sorted(catalog.QUERIES) if os.environ.get("ALL_CHECKS") else SAMPLE)
def test_query_equals_reference(spark, duck, key):
    df = driver.queries()[key](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(([normal(r[c]) for c in columns] for r in df.collect()), key=repr)
    result = duck.execute(driver.oracle_sql()[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(([normal(r[i]) for i in order] for r in result.fetchall()), key=repr) == rows


def test_every_query_has_a_reference():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).columns[0] == "row_id"
