"""Rows that an order leaves equal: queries keep the one that their SQL keeps."""

import duckdb
import pytest

from vellumite.catalog import ORACLES, QUERIES

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"


@pytest.mark.parametrize("name", ["table_grid", "table_text"])
def test_grids_keep_the_first_of_equal_line_numbers(spark, tmp_path, name):
    """Spark reads larger files first, SQL the first by name: here that is neither the first nor the last that Spark reads."""
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    many = [(k % 50, 3 * k + k % 2, 2 * k, 1 + k % 7, 2.0 * (k % 9), "N") for k in range(2000)]
    some, few = [(*r[:5], "S") for r in many[:350]], [(*r[:5], "F") for r in many[:40]]
    for at, rows in enumerate((some, many, few)):
        spark.createDataFrame(rows, LINE).coalesce(1).toPandas().to_parquet(folder / f"part-{at}.parquet", index=False)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    made = QUERIES[name](spark, str(tmp_path))
    want = db.execute(ORACLES[name]).fetchall()
    columns = [d[0] for d in db.description]
    assert sorted(map(repr, map(tuple, made.select(*columns).collect()))) == sorted(map(repr, want))
