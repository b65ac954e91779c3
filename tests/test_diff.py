import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from volspark.operators import diff

SCHEMA = "k string, a bigint, b string, _side int, extra string"


def brute(left, right):
    out = set()
    for k in {*left, *right} - {None}:
        if k not in right:
            out.add((k, "missing_right"))
        elif k not in left:
            out.add((k, "missing_left"))
        else:
            out |= {(k, f) for f, x, y in zip("ab", left[k], right[k]) if x != y}
    return out


def frame(spark, side):
    return spark.createDataFrame([(k, *v, 1, "x") for k, v in side.items()], SCHEMA)


def test_all_differences_of_long_tables(spark):
    random.seed(1)
    left = {f"{random.choice('xyz')}/{i:05d}": (random.choice([1, 2, None]), random.choice(["p", "", None])) for i in range(3000)}
    right = dict(left)
    for k in random.sample(sorted(left), 60):
        right.pop(k)
    for k in random.sample(sorted(right), 60):
        right[k] = (9, "q")
    for i in range(40):
        right[f"y/{random.randrange(9**6)}n"] = (1, "p")
    left[None] = (1, "z")
    got = diff.diff_tables(frame(spark, left), frame(spark, right), "k", ["a", "b"]).collect()
    assert {tuple(r) for r in got} == brute(left, right) and len(got) == len(set(got))


def test_chunks_stay_where_rows_are_missing(spark):
    left = {f"k{i:05d}": (1, "p") for i in range(4000)}
    right = {k: v for k, v in left.items() if k not in ("k00100", "k02000")}
    sides = [frame(spark, s).select("k", "a", "b").selectExpr("*", f"{n} as _side") for n, s in enumerate((left, right))]
    rows = diff.chunked(sides[0].unionByName(sides[1]), "k", ["a", "b"])
    bad = rows.join(diff.unmatched(rows, "k"), ["_range", "_side", "_chunk"], "left_semi").count()
    assert 0 < bad < 600


def test_empty_sides(spark):
    left = {"a": (1, None), "b": (None, "")}
    assert diff.diff_tables(frame(spark, left), frame(spark, {}), "k", ["a", "b"]).count() == 2
    assert diff.diff_tables(frame(spark, {}), frame(spark, {}), "k", ["a", "b"]).count() == 0
    assert diff.diff_tables(frame(spark, left), frame(spark, left), "k", ["a", "b"]).count() == 0


VALUES = st.dictionaries(st.text("ab/é", max_size=4), st.tuples(st.sampled_from([None, 0, 1]), st.sampled_from([None, "", "x"])), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(VALUES, VALUES)
def test_any_two_tables(spark, left, right):
    got = diff.diff_tables(frame(spark, left), frame(spark, right), "k", ["a", "b"]).collect()
    assert {tuple(r) for r in got} == brute(left, right)


def test_untidy_remote_numbers(spark):
    remote = spark.createDataFrame(
        [("/a", 1, 5, " 005 ", "7", False), ("a", 2, 6, "6.0", "x", False), ("//b", 1, 1, None, None, False), ("c", 1, 1, "1", "1", False), ("c", 2, None, None, None, True), (None, 1, 1, "1", "1", False)],
        "key string, version_no int, content_length bigint, meta_size string, meta_mtime_ns string, is_delete_marker boolean",
    )
    rows = {r.key: (r["size"], r.meta_size, r.mtime_ns) for r in diff.remote_states(remote).collect()}
    assert rows == {"a": (6, 6, None), "/b": (1, None, None)}
