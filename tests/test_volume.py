"""Inline cases with known results, NumPy cross-checks, and the fused chain against its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark.functions import numeric as N
from volspark.operators import volume as V
from volspark.plans import spec as P


def table(spark, a, kind="double"):
    a = np.asarray(a)
    while a.ndim < 3:
        a = a[None]
    conv = int if kind != "double" else float
    return spark.createDataFrame([(*map(int, k), conv(a[k])) for k in np.ndindex(a.shape)], f"z int, y int, x int, v {kind}")


def array(df):
    rows = df.select("z", "y", "x", "v").collect()
    out = np.full([max(r[k] for r in rows) + 1 for k in range(3)], np.nan)
    for r in rows:
        out[r.z, r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("values, expected", [([[-1, 0, 1]], [[0, 127, 255]]), ([[0, 0.5], [1, 2]], [[0, 63], [127, 255]]), ([[0, 10], [20, 30]], [[0, 85], [170, 255]]), ([[7, 7]], [[0, 0]])])
def test_stretch(spark, values, expected):
    assert array(V.stretch(table(spark, values), "uint8"))[0].tolist() == expected


def test_stretch_wraps_and_signs(spark):
    assert array(V.stretch(table(spark, [[0, 300, 65535]]), "uint8"))[0].tolist() == [[0, 44, 255]]
    assert array(V.stretch(table(spark, [[0, 128, 255]]), "int8"))[0].tolist() == [[0, -128, -1]]
    assert array(V.stretch(table(spark, [[0, 5, 10]]), "float64"))[0].tolist() == [[0, 0.5, 1]]


def test_saturating_and_unit_casts(spark):
    one = lambda vs, e: [r[0] for r in spark.createDataFrame([(float(v),) for v in vs], "v double").select(e(F.col("v"))).collect()]
    assert one([-2, 1.9, 255.9, 300], lambda v: N.saturating_cast(v, "uint8")) == [0, 1, 255, 255]
    assert one([-1, 1e30], lambda v: N.saturating_cast(v, "uint64")) == [0, 2**64 - 1]
    assert one([-1.9, -200], lambda v: N.saturating_cast(v, "int8")) == [-1, -128]
    with pytest.raises(Exception):
        one([float("nan")], lambda v: N.saturating_cast(v, "uint8"))
    assert one([0, 10, 5, -3], lambda v: N.unit_scale_cast(v, F.lit(0.0), F.lit(10.0), "uint16")) == [0, 65535, 32768, 0]
    assert one([3], lambda v: N.unit_scale_cast(v, F.lit(3.0), F.lit(3.0), "uint8")) == [0]


def test_crops():
    assert N.crop_bounds((0.25, 0.5), 8) == (2, 4) and N.crop_bounds((1, 2), 8) == (1, 6) and N.crop_bounds((0.0, 0.25), 6) == (0, 4)
    with pytest.raises(ValueError):
        N.crop_bounds((4, 4), 8)


def test_trim(spark):
    a = np.stack([np.arange(16).reshape(4, 4) + 20 * k for k in range(3)])
    assert array(V.trim(table(spark, a), (3, 4, 4), z=(1, 0), y=(1, 1), x=(1, 1))).tolist() == [[[25, 26], [29, 30]], [[45, 46], [49, 50]]]


@pytest.mark.parametrize("axis", "zyx")
def test_sliding_max(spark, axis):
    a = np.arange(24.0).reshape(2, 3, 4)
    k = "zyx".index(axis)
    expected = np.maximum(np.take(a, range(a.shape[k] - 1), k), np.take(a, range(1, a.shape[k]), k))
    assert (array(V.sliding_max(table(spark, a), axis, 2)) == expected).all()


def test_mask_bin_flip_transpose_reslice(spark):
    masked = array(V.circular_mask(table(spark, np.ones((2, 5, 5))), 0.8, 5, 5, -1.0))
    assert masked[0, 2, 2] == 1 and masked[1, 0, 0] == -1
    assert array(V.spatial_bin(table(spark, np.arange(16).reshape(1, 4, 4)), 2, 4, 4, whole=True)).tolist() == [[[3, 5], [11, 13]]]
    a = np.arange(1, 9).reshape(2, 2, 2)
    assert (array(V.flip(table(spark, a), "z", 2)) == a[::-1]).all() and (array(V.flip(table(spark, a), "x", 2)) == a[:, :, ::-1]).all()
    b = np.arange(24).reshape(2, 3, 4)
    assert (array(V.transpose(table(spark, b))) == b.transpose(2, 1, 0)).all()
    c = np.arange(24).reshape(3, 2, 4)
    rows = V.reslice(table(spark, c), (2, 1, 1), (3, 2, 4)).collect()
    got = {(r.plane, r.row, r.col): r.v for r in rows}
    for name, plane in (("xy", c[1]), ("xz", c[:, 1, :]), ("yz", c[:, :, 2])):
        assert all(got[(name, *k)] == plane[k] for k in np.ndindex(plane.shape))
    with pytest.raises(ValueError):
        V.reslice(table(spark, c), (4, 0, 0), (3, 2, 4))


@pytest.mark.parametrize("boundary, expected", [("preserve", [10, 10, 100, 10, 10]), ("drop", [10, 100, 10])])
def test_denoise_threshold(spark, boundary, expected):
    df = table(spark, np.array([10, 100, 10, 100, 10]).reshape(5, 1, 1), "int")
    assert array(V.denoise_threshold(df, 0.5, boundary, whole=True)).ravel().tolist() == expected


def test_denoise_flat(spark):
    assert array(V.denoise_flat(table(spark, np.array([5, 99, 5]).reshape(3, 1, 1)), 10)).ravel().tolist() == [5, 0, 5]


def test_majority_ties(spark):
    assert array(V.downsample(table(spark, [[[3, 2], [2, 3]]], "int"), labels=True)).ravel().tolist() == [2]


def test_exact_percentiles(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, 4000), np.full(3000, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    for keep in (100_000, 50):
        got = N.exact_percentiles(df, "v", [0, 5, 33.3, 50, 95, 100], keep)
        assert np.allclose(got, np.percentile(v, [0, 5, 33.3, 50, 95, 100]), rtol=1e-12)
    with pytest.raises(ValueError):
        N.exact_percentiles(df.limit(0), "v", [50])


def numpy_chain(a, s):
    lo, hi = np.percentile(a, s.normalize)
    a = (np.clip(a, lo, hi) - lo) / (hi - lo)
    for k, c in enumerate((s.trim_z, s.trim_y, s.trim_x)):
        b, e = N.crop_bounds(c, a.shape[k])
        a = np.take(a, range(b, e), k)
    a = np.stack([a[k : k + s.mip].max(0) for k in range(len(a) - s.mip + 1)])
    y, x = np.indices(a.shape[1:])
    h, w = a.shape[1:]
    a = np.where((y - (h - 1) / 2) ** 2 + (x - (w - 1) / 2) ** 2 <= (s.mask * min(h, w) / 2) ** 2, a, 0)
    if s.flip:
        a = np.flip(a, "zyx".index(s.flip))
    out = []
    for p in a:
        p = np.floor((p - p.min()) * max(255 / ((p.max() - p.min()) or 1), 1)) % 256
        out.append(np.floor(p.reshape(h // 2, 2, w // 2, 2).mean((1, 3)) + 0.5))
    return np.stack(out)


@pytest.mark.parametrize("flip", [None, "z", "y"])
def test_chain_equals_numpy(spark, flip):
    a = np.random.default_rng(2).integers(0, 1000, (6, 8, 8)).astype(float)
    s = P.PipelineSpec(normalize=(5, 95), trim_z=(1, 0), trim_y=(1, 1), trim_x=(1, 1), mip=2, mask=1.0, flip=flip, dtype="uint8", bin_power=1)
    assert (array(P.run(table(spark, a), s, a.shape)) == numpy_chain(a, s)).all()


def steps_in_numpy(a, s):
    """The chain without normalization, one step after another on the whole array."""
    k = "zyx".index(s.mip_axis)
    a = np.lib.stride_tricks.sliding_window_view(a, s.mip, k).max(-1) if s.mip > 1 else a
    if s.mask is not None:
        y, x = np.indices(a.shape[1:])
        h, w = a.shape[1:]
        a = np.where((y - (h - 1) / 2) ** 2 + (x - (w - 1) / 2) ** 2 <= (s.mask * min(h, w) / 2) ** 2, a, a.min())
    new = a.copy()
    for z in range(1, len(a) - 1):
        if s.denoise == "threshold":
            gap = s.threshold * (a[z - 1 : z + 2].max() - a[z - 1 : z + 2].min())
            off = (abs(a[z] - a[z - 1]) > gap) & (abs(a[z] - a[z + 1]) > gap)
            new[z] = np.where(off, (a[z - 1] + a[z + 1]) / 2, a[z])
        elif s.denoise == "flat":
            new[z] = np.where((a[z - 1] < s.threshold) & (a[z + 1] < s.threshold), 0, a[z])
    a = np.flip(new, "zyx".index(s.flip)) if s.flip else new
    if s.dtype == "uint16":
        a = np.stack([np.floor((p - p.min()) * max(65535 / ((p.max() - p.min()) or 1), 1)) % 65536 for p in a])
    return a


@pytest.mark.parametrize("block", [(2, 2, 4), (3, 8, 3)])
def test_blocks_make_up_the_whole(spark, block):
    a = np.random.default_rng(6).integers(0, 999, (7, 9, 8)).astype(float)
    for s in (
        P.PipelineSpec(mip=4, mask=0.9, denoise="threshold", threshold=0.3, flip="z", dtype="uint16"),
        P.PipelineSpec(mip=3, mip_axis="y", denoise="flat", threshold=700, flip="y", dtype=None),
        P.PipelineSpec(mip=2, mip_axis="x", mask=0.7, flip="z", dtype=None),
    ):
        assert np.array_equal(array(P.run(table(spark, a), s, a.shape, block=block)), steps_in_numpy(a, s))
    s = P.PipelineSpec(normalize=(5, 95), trim_y=(1, 0), mip=2, mask=1.0, flip="x", dtype="uint8", bin_power=1)
    assert (array(P.run(table(spark, a), s, a.shape, block=block)) == numpy_chain(a, s)).all()
    assert P.run(table(spark, a), P.PipelineSpec(mip=9), a.shape).count() == 0


def test_missing_voxels_are_left_out_with_what_needs_them(spark):
    a = np.random.default_rng(7).random((5, 3, 3))
    df = table(spark, a).where("not (z = 2 and y = 1 and x = 1)")
    got = {(r.z, r.y, r.x): r.v for r in P.run(df, P.PipelineSpec(mip=2, dtype=None), a.shape, block=(2, 2, 2)).collect()}
    best = np.maximum(a[1:], a[:-1])
    assert got == {k: best[k] for k in np.ndindex(best.shape) if k not in ((1, 1, 1), (2, 1, 1))}


def test_one_shuffle_of_voxels(spark):
    """Blocks once cut are never shuffled again: behind the cut come joins with one row for each row of blocks."""
    a = np.zeros((3, 4, 4))
    plan = P.run(table(spark, a), P.PipelineSpec(mip=2, mask=1.0, dtype=None, bin_power=1), a.shape, fill=0.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_input_range_is_all_that_is_needed(spark):
    a = np.random.default_rng(3).integers(0, 99, (12, 4, 4)).astype(float)
    for s in (P.PipelineSpec(trim_z=(2, 1), mip=3, dtype=None), P.PipelineSpec(trim_z=(1, 0), mip=2, flip="z", denoise="flat", threshold=50, dtype=None)):
        whole = array(P.run(table(spark, a), s, a.shape))
        lo, hi = s.input_range(3, 5, 12)
        assert hi - lo < 12
        cut = a.copy()
        cut[:lo], cut[hi:] = -1e9, -1e9
        assert (array(P.run(table(spark, cut), s, a.shape))[3:5] == whole[3:5]).all()


def test_ranges_equal_the_whole(spark):
    a = np.random.default_rng(4).integers(0, 999, (11, 6, 6)).astype(float)
    df = table(spark, a)
    for s in (
        P.PipelineSpec(normalize=(5, 95), trim_z=(1, 2), mip=3, mask=1.0, bin_power=1),
        P.PipelineSpec(trim_z=(2, 0), mip=2, mask=0.8, denoise="threshold", threshold=0.3, flip="z", dtype=None),
        P.PipelineSpec(denoise="flat", threshold=300, flip="y", dtype="uint16"),
    ):
        whole = P.run(df, s, a.shape)
        depth = s.output_depth(11)
        for first, last in ((0, 2), (2, 5), (depth - 1, depth)):
            expected = sorted(map(tuple, whole.where((F.col("z") >= first) & (F.col("z") < last)).collect()))
            assert sorted(map(tuple, P.run_range(df, s, a.shape, first, last).collect())) == expected


def test_coordinates_reach_the_scan(spark):
    import os

    from volspark import views

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    plan = views.voxels(spark, "/root/testdata/sf0.001", planes=(3, 8))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,300)" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_impossible_specs():
    for bad in ({"normalize": (9, 5)}, {"denoise": "x"}, {"flip": "q"}, {"mip": -1}):
        with pytest.raises(ValueError):
            P.PipelineSpec(**bad).validate()
    assert P.output_names(list("abcdef"), P.PipelineSpec(trim_z=(1, 1), mip=2)) == ["c", "d", "e"]
