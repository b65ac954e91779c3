import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from volspark.operators import incremental as inc

T0 = datetime(2020, 1, 1)
OBJECTS = "row_id bigint, tree string, key string, size bigint, mtime_ns bigint, listed_at timestamp, seen_at timestamp, state string, part int"
RUNS = "run_id bigint, tree string, started_at timestamp, status string, logged_at timestamp"


def at(m):
    return T0 + timedelta(minutes=m)


def brute(objects, runs):
    last = {}
    for r in sorted(runs, key=lambda r: (r[4], r[3])):
        if r[0] is not None:
            last[r[0]] = r
    good = sorted((r for r in last.values() if r[3] == "succeeded" and r[1] and r[2]), key=lambda r: (r[1], r[2], r[0]))
    found, before = set(), {}
    for run, tree, start, *_ in good:
        now = {}
        for row, t, key, size, mtime, listed, seen, *_ in objects:
            if None in (t, key, size, mtime, seen) or t != tree or seen > start:
                continue
            rank = (listed is not None, listed or T0, row)
            if key not in now or now[key][0] < rank:
                now[key] = (rank, size, mtime)
        old = before.get(tree, {})
        found |= {(run, k) for k, v in now.items() if k not in old or old[k][1:] != v[1:]}
        before[tree] = now
    return found


def case(n=600, seed=3):
    random.seed(seed)
    trees = ["a"] * 6 + ["b", "c", None]
    objects = []
    for i in range(n):
        seen = random.randrange(300)
        listed = None if random.random() < 0.03 else at(seen - random.randrange(20))
        objects.append((i, random.choice(trees), random.choice([f"k{j}" for j in range(12)] + [None]), random.choice([1, 2, None]), random.choice([5, 6]), listed, at(seen), "x", 7))
    objects += objects[:5]
    runs = []
    for r in range(40):
        start = random.randrange(300)
        tree = random.choice(["a", "b", "d"])
        runs.append((r, tree, at(start), "running", at(start)))
        if random.random() < 0.8:
            runs += [(r, tree, at(start), random.choice(["succeeded", "succeeded", "failed", "aborted"]), at(start + 5))] * 2
    runs.append((100, "a", at(100), "succeeded", at(101)))
    runs.append((101, "a", at(100), "succeeded", at(101)))
    return objects, runs


@pytest.mark.parametrize("group_rows", [50_000, 40])
def test_deltas_equal_a_replay_of_all_runs(spark, group_rows):
    objects, runs = case()
    rows = inc.sync_deltas(spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(runs, RUNS), group_rows).select("run_id", "key").collect()
    assert {tuple(r) for r in rows} == brute(objects, runs) and len(rows) == len(set(rows)) > 30


def test_refresh_recomputes_only_what_changed_and_survives_a_failure(spark, tmp_path):
    objects, runs = case(200)
    root = str(tmp_path / "t")
    as_df = lambda o, r: (spark.createDataFrame(o, OBJECTS), spark.createDataFrame(r, RUNS))
    table, first = inc.refresh_sync(spark, root, *as_df(objects, runs))
    got = lambda: sorted((tuple(r) for r in table.read().collect()), key=str)
    assert got() == sorted(brute(objects, runs), key=str) and first.changed
    _, again = inc.refresh_sync(spark, root, *as_df(objects, runs))
    assert not again.changed and again.version == first.version
    more = objects + [(999, "b", "new", 3, 3, at(1), at(1), "x", 7)]
    _, third = inc.refresh_sync(spark, root, *as_df(more, runs))
    assert len(third.changed) == 1 and third.version == first.version + 1
    assert got() == sorted(brute(more, runs), key=str)
    fewer = [o for o in more if o[1] != "b"]
    _, fourth = inc.refresh_sync(spark, root, *as_df(fewer, runs))
    assert fourth.removed and got() == sorted(brute(fewer, runs), key=str)


def test_generic_refresh(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("n", T.LongType())])
    part = F.pmod(F.hash("g"), F.lit(5)).cast("int")
    table = inc.IncrementalRefresh(spark, str(tmp_path), schema, lease=0)
    seen = []

    def count(cut):
        seen.append(cut[0].count())
        return cut[0].groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("part", part)

    rows = [("a", 1), ("a", None), (None, 1), ("b", 2)]
    make = lambda rs: [inc.Source(spark.createDataFrame(rs, "g string, v int"), part)]
    table.run(make(rows), count)
    expect = lambda rs: {g: sum(1 for r in rs if r[0] == g) for g in {r[0] for r in rs}}
    state = lambda: {r.g: r.n for r in table.read().collect()}
    assert state() == expect(rows)
    changed = rows + [("a", 5), ("c", 1)]
    with pytest.raises(RuntimeError):
        table.run(make(changed), count, fail_after_write=True)
    done = table.run(make(changed), count)
    assert done.changed and state() == expect(changed) and table.read().count() == len(expect(changed))
    assert not table.run(make(changed), count).changed
    # null and value swapped between columns change the fingerprint, as does a repeated row
    assert table.run(make(changed + [("b", 2)]), count).changed
    assert table.run(make([]), count).removed and table.read().count() == 0
    assert inc.IncrementalRefresh(spark, str(tmp_path / "none"), schema).read().count() == 0


def test_of_two_runs_at_once_one_commits_and_nothing_stale_stays(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("n", T.LongType())])
    part = F.pmod(F.hash("g"), F.lit(5)).cast("int")
    count = lambda cut: cut[0].groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("part", part)
    make = lambda rs: [inc.Source(spark.createDataFrame(rs, "g string, v int"), part)]
    table, other = (inc.IncrementalRefresh(spark, str(tmp_path), schema) for _ in range(2))
    table.run(make([("a", 1)]), count)
    old, new = [("a", 1), ("a", 2)], [("a", 1), ("a", 2), ("a", 3)]

    def meanwhile(cut):
        other.run(make(new), count)
        return count(cut)

    with pytest.raises(RuntimeError, match="another run"):
        table.run(make(old), meanwhile)
    assert [r.n for r in table.read().collect()] == [2]  # the late writer has left its rows
    assert table.run(make(new), count).changed and [r.n for r in table.read().collect()] == [3]
    assert table.run(make(new), count).changed  # until the lease of the run that failed has ended
    table.lease = 0
    assert table.run(make(new), count).changed and not table.run(make(new), count).changed


def test_partitions_follow_the_size(spark, tmp_path):
    assert (inc.side_for(0), inc.side_for(64_000_000), inc.side_for(10**9), inc.side_for(10**13)) == (8, 8, 32, 256)
    objects, runs = case(200)
    as_df = lambda: (spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(runs, RUNS))
    table, _ = inc.refresh_sync(spark, str(tmp_path), *as_df())
    before, inc.PART_ROWS = inc.PART_ROWS, 0.1
    try:
        table, again = inc.refresh_sync(spark, str(tmp_path), *as_df())
    finally:
        inc.PART_ROWS = before
    assert table.layout() == 64 and again.changed
    assert sorted((tuple(r) for r in table.read().collect()), key=str) == sorted(brute(objects, runs), key=str)
    assert not inc.refresh_sync(spark, str(tmp_path), *as_df())[1].changed
