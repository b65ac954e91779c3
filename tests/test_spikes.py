import random
from datetime import datetime

from volspark.operators import spikes

SCHEMA = "row_id bigint, source_file string, type string, index int, mean double, min bigint, max bigint, extracted_at timestamp, _pos string"


def series(n, level, scatter, seed, drift=0.0):
    r = random.Random(seed)
    return [[level + drift * i + r.gauss(0, scatter), int(level * 0.6 + drift * i + r.gauss(0, 3 * scatter)), int(level * 1.5 + drift * i + r.gauss(0, 5 * scatter))] for i in range(n)]


def run(spark, sources):
    rows, k = [], 0
    for (name, kind), frames in sources.items():
        for i, f in frames:
            rows.append((k, name, kind, i, *f, datetime(2020, 1, 1), "x"))
            k += 1
    random.Random(9).shuffle(rows)
    out = spikes.implausible(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r.source_file, r.type, r["index"]): set(r.why) for r in out}


def test_planted_cases_and_nothing_else(spark):
    a = series(3000, 20000, 4, 1, drift=0.5)
    expected = {}
    for i, n in ((1, 1), (500, 1), (1022, 3), (1500, 2), (2999, 1)):
        for k in range(n):
            a[i + k][0] += 900
            expected[("a", "white", i + k)] = {"spike"}
    for i in range(1700, 1800):  # a change of level that lasts
        a[i] = [x + 300 for x in a[i]]
    for i in range(2000, 2004):  # too long for a spike, too short for a level
        a[i][0] += 900
    for i in range(2044, 2050):
        a[i] = list(a[2044])
        expected[("a", "white", i)] = {"stuck"}
    for i in range(2200, 2204):
        a[i] = list(a[2200])
    for i, f in ((10, [float("nan"), 1, 2]), (11, [float("inf"), 1, 2]), (12, [500.0, -1, 900]), (13, [60000.0, 1, 70000]), (14, [5.0, 9, 8]), (15, [1e6, 9, 800])):
        a[i] = f
        expected[("a", "white", i)] = {"bounds"}
    b = [[100.0, 90, 110] for _ in range(3)] + [[100.0 + i % 3, 90 + i % 2, 110 + i % 2] for i in range(30)]
    frames = list(enumerate(a))
    sources = {("a", "white"): frames + frames[40:44], ("b", "dark"): [(i * 2, f) for i, f in enumerate(b)]}
    assert run(spark, sources) == expected


def test_odd_rows(spark):
    rows = [(1, None, "w", 1, 5.0, 1, 9, None, "x"), (2, "s", None, 1, 5.0, 1, 9, None, "x"), (3, "s", "w", None, 5.0, 1, 9, None, "x"), (4, "s", "w", 1, None, 1, 9, None, "x"), (5, "s", "w", 2, 50.0, 1, 9, None, "x")]
    got = spikes.implausible(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["index"], r.why) for r in got] == [(2, ["bounds"])]
    assert spikes.implausible(spark.createDataFrame([], SCHEMA)).count() == 0
