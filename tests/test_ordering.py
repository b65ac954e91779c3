import random

from pyspark.sql import functions as F

from volspark.operators.ordering import running_total, with_positions


def rows_of(n=500):
    random.seed(7)
    return [(random.choice(["hot"] * 4 + ["b", None]), k, random.choice([1, 5, 9]), "x") for k in random.sample(range(-n, n), n)]


def test_positions(spark):
    rows = rows_of()
    got = with_positions(spark.createDataFrame(rows, "g string, k int, v int, _gid string"), ["g", "k"]).collect()
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r._pos)] == [r[:3] for r in expected]
    assert sorted(r._pos for r in got) == list(range(len(rows)))
    assert with_positions(spark.createDataFrame([], "k int"), ["k"]).count() == 0


def test_running_totals(spark):
    rows = [r for r in rows_of() if r[0]]
    df = spark.createDataFrame(rows, "g string, k int, v int, x string")
    got = running_total(df, ["g"], "k", F.floor(F.col("k") / 16), {"before": F.col("v"), "n": F.lit(1)}).collect()
    for r in got:
        earlier = [q[2] for q in rows if q[0] == r.g and q[1] < r.k]
        assert (r.before, r.n) == (sum(earlier), len(earlier))
    assert len(got) == len(rows)
