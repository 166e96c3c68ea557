"""The entry module: queries and SQL have the same columns and rows on a small table; llm may be absent."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from vellumite.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, list):
        return tuple(map(plain, value))
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the standard tables")
@pytest.mark.parametrize("name", ["page_report", "list_markers", "weighted_median_size", "merge_intervals", "containment_anti_join", "repeated_boilerplate", "choose_format"])
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    df = QUERIES[name](spark, SF)
    want = db.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_all_names():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
