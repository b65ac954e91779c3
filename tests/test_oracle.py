"""Every query with SQL against DuckDB, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else format(float(v), ".9g")
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    order = [relation.columns.index(c) for c in sorted(df.columns)]
    ours = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert ours == sorted(str([plain(r[k]) for k in order]) for r in relation.fetchall())


#: Rows of the queries without SQL on the smallest tables (10 planes of 10 by 10 pixels); their values are tested beside their operators.
ROWS = {"sampled_percentiles": 1, "gaussian_plane": 1000, "nlm_plane": 1000, "decompose_flats": 1000, "flow_warp": 900, "separated_warp": 900, "transport_gain": 900, "flat_report": 9, "residual_report": 8}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_others_give_finite_rows(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    assert len(rows) == ROWS.get(name, len(rows)) > 0
    assert all(v == v and abs(v) != float("inf") for r in rows for v in r if isinstance(v, float))


def test_entry(spark):
    assert entry.entry(spark).columns == ["z", "y", "x", "v"] and entry.entry(spark).count() == 112


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append([sorted(map(str, entry.queries()[q](spark, SF).collect())) for q in ("pipeline_fused", "p1_found", "p2_found", "p3_found", "p5_found")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
