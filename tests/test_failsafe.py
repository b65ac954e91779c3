"""What must raise, end or survive."""

import importlib
import math
import sys

import numpy as np
import pytest

import __spark_entry__ as entry
from volspark import session
from volspark.functions import numeric as N


@pytest.mark.parametrize("keep", [5, 100_000])
def test_percentiles_end_on_infinite_values(spark, keep):
    values = [math.inf, -math.inf, -math.inf, None, math.nan, 1e308, -1e308, 5e-324, 0.0, *[float(i % 7) for i in range(41)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    there = sorted(v for v in values if v is not None and v == v)
    got = N.exact_percentiles(df, "v", [0, 2, 5, 37.5, 50, 100], keep)
    n = len(there) - 1
    for p, x in zip([0, 2, 5, 37.5, 50, 100], got):
        lo, hi = there[math.floor(p / 100 * n)], there[math.ceil(p / 100 * n)]
        assert x == lo == hi or np.isclose(x, lo + (hi - lo) * (p / 100 * n % 1), atol=0) or (math.isinf(lo) and (x == lo or x != x)), (p, x, lo, hi)
    assert N.exact_percentiles(spark.createDataFrame([(math.inf,)], "v double"), "v", [50]) == [math.inf]


class Cluster:
    class conf:
        get = staticmethod(lambda *_: None)

    class sparkContext:
        master, applicationId = "spark://host:7077", "x"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)


def test_queries_without_the_text_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "volspark.llm", None)
    try:
        assert "p1_found" in importlib.reload(entry).queries() and "p6_ids" not in entry.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_one_publication_of_a_file(spark, tmp_path):
    files = session.Files(spark, str(tmp_path))
    path = f"{tmp_path}/state/v=1"
    assert files.publish(path, "first é") and not files.publish(path, "second")
    assert files.read_text(path) == "first é" and files.names(f"{tmp_path}/state") == ["v=1"]
