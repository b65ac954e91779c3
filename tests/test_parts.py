"""Names, literals, layers, nodes, metadata, kernels, stages and streams."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark.functions import stencils as S
from volspark.functions import text as X
from volspark.operators import admin as A
from volspark.operators import flats as L
from volspark.operators import layers as Y
from volspark.operators import mesh, metadata
from volspark.plans import stages
from volspark.streaming import usage


def each(spark, texts, e):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").sort("i").select(e(F.col("s"))).collect()]


def test_names(spark):
    assert sorted(["b10", "b2", "B1"], key=dict(zip(["b10", "b2", "B1"], each(spark, ["b10", "b2", "B1"], X.natural_key))).get) == ["B1", "b2", "b10"]
    assert each(spark, ["/a/b c/", "", "//", None], X.safe_name) == ["a__b_c", "root", "root", "root"]
    assert each(spark, ["a_7.tif", "a_1234567.tif", "a_b_7.tif", "a.tif"], X.padded_name) == ["a_00007.tif", "a_1234567.tif", None, None]
    assert each(spark, ["flat_pre_001", "x"], X.flat_key) == ["flat_pre", "x"]


def test_addresses(spark):
    assert each(spark, ["bucket|bar", "bucket", None], X.layer_address) == ["precomputed://bucket", "bucket", None]
    assert each(spark, ["precomputed://file:///a%20b", "/x/y", "s3://b/k"], X.local_path) == ["/a b", "/x/y", None]
    assert each(spark, ["/x/vol/"], X.queue_root) == ["/x/.vol.queue"]
    assert each(spark, ["precomputed://s3://b/k/l", "s3://b", "gs://b"], X.bucket_and_key) == [("b", "k/l"), ("b", ""), None]
    assert each(spark, ["http://0.0.0.0:80/x", "http://[::1]:80/x"], lambda s: X.advertised(s, "fe80::1")) == ["http://[fe80::1]:80/x"] * 2
    assert each(spark, ["#fff", "ffff", "12345", "GGG"], X.is_color) == [True, True, False, False]
    assert each(spark, ["a_seg", "My_Labels", "scan"], X.layer_kind) == ["segmentation", "segmentation", "image"]


def test_literals(spark):
    assert each(spark, ["axon", "axon:9:"], lambda s: X.record(s, [("n", "string", ""), ("i", "int", -1), ("r", "int", -1)])) == [("axon", -1, -1), ("axon", 9, -1)]
    assert each(spark, ["0.25", "5,2", "1"], X.crop_pair) == [(0.25, 0.25, False), (5, 2, True), (1, 1, True)]
    assert each(spark, ["1,2,3", "4x5x6", "1,2"], X.triple) == [[1, 2, 3], [4, 5, 6], None]
    assert each(spark, ["3.5 GiB", "10", "2 kib", "x GiB", "1 PB"], X.byte_size) == [3758096384, 10, 2048, None, None]
    assert each(spark, ["3,1,1", "a", "-1"], X.mip_list) == [[1, 3], None, None]
    assert each(spark, ["5", "2,5", "2,9,3"], X.number_range) == [(0, 5, 1), (2, 5, 1), (2, 9, 3)]
    assert each(spark, ["[1:5:2,:7]"], X.slices) == [[(1, 5, 2), (None, 7, None)]]
    assert each(spark, ["a=1,b=2=3,a=4"], X.option_map) == [{"a": "4", "b": "2=3"}]
    assert each(spark, ["MemTotal: 12 kB\nx y\nfree 3"], X.key_values) == [{"MemTotal": 12, "free": 3}]
    assert each(spark, ["uint8,int16,uint8", "uint9"], lambda s: X.type_list(s, ["uint8", "int16"])) == [["uint8", "int16"], None]
    assert each(spark, ["FLATS_GENERATED_UC"], X.status_text) == ["Flats Generated Uc"]
    assert each(spark, ["1536", "10", str(3 << 30)], lambda s: X.human_bytes(s.cast("bigint"))) == ["1.50 KiB", "10 B", "3.00 GiB"]
    assert each(spark, ["#!/bin/sh\nbase=/d\nrun --in=$base/x --n=3 --n=4"], metadata.script_options) == [{"in": "/d/x", "n": "4"}]


def test_layers(spark):
    assert Y.tag_plan(["existing", "fresh"], [5, -1], [-1, -1]) == [("existing", 5, 30), ("fresh", 65535 // 4, 30)]
    docs = spark.createDataFrame([("d", '{"layers":[{"name":"a","type":"image","odd":[1,{"k":null}]},{"name":"b"}],"position":[1,2]}')], "doc string, body string")
    rows = Y.layers_of(docs)
    assert [(r.ord, r.name, r.type) for r in rows.sort("ord").collect()] == [(0, "a", "image"), (1, "b", None)]
    assert Y.documents_of(rows).first().body == '{"layers":[{"name":"a","odd":[1,{"k":null}],"type":"image"},{"name":"b"}]}'
    src = spark.createDataFrame([("a",), ("b",)], "name string")
    with pytest.raises(ValueError):
        Y.copy_layers(src, src, ["a", "zz"])
    assert Y.copy_layers(src, src.where("name = 'b'"), ["a"]).count() == 2


def test_nodes(spark):
    lines = spark.createDataFrame([("NAME COUNT PARTITION STATUS",), ("n1 1 main* idle",), ("n2 1 main mix",), ("n3 1 sas idle",), ("n4 1 main idle*",), ("short",)], "value string")
    nodes = A.node_lines(lines).withColumn("ord", F.monotonically_increasing_id())
    assert {r.name for r in A.eligible_nodes(nodes).collect()} == {"n1", "n4"} and {r.name for r in A.eligible_nodes(nodes, mixed=True).collect()} == {"n1", "n2", "n4"}
    merged = A.merged_nodes(spark.createDataFrame([(1, 0, "a"), (0, 5, "a"), (1, 1, "b")], "priority int, ord int, name string"))
    assert {tuple(r) for r in merged.collect()} == {("a", 0, 5), ("b", 1, 1)}
    assert A.stage_range() == A.STAGES and A.stage_range("upload") == ["upload"] and A.stage_range("shard", "mesh", upload=False) == ["shard", "mesh"]
    diff = A.field_differences(spark.createDataFrame([("a", 1), ("b", 2)], "field string, value int"), spark.createDataFrame([("a", 1), ("c", 3)], "field string, value int"))
    assert {r.field for r in diff.collect()} == {"b", "c"}
    shown = A.tally(spark.createDataFrame([(0, 2), (1, 1), (2, 9)], "ord int, done int"), 5)
    assert [r.shown for r in shown.sort("ord").collect()] == [2, 2, 5]


@pytest.mark.parametrize("ceiling, down, shard", [(2, 32, 23), (4, 23, 11), (8, 11, 5)])
def test_workers(spark, ceiling, down, shard):
    memory = F.lit(126_000_000_000).cast("bigint")
    got = spark.range(1).select(*[A.workers(memory, F.lit(ceiling << 30), F.lit(32), F.lit(64), k) for k in (1, 2)]).first()
    reserve = min(24 << 30, 126_000_000_000 // 4)
    assert tuple(got) == tuple(max(1, min(32, 64, (126_000_000_000 - reserve) // (k * (ceiling << 30)))) for k in (1, 2))


def test_metadata(spark):
    kinds = "file string, path string, parent string, kind string, shape array<bigint>, dtype string, value string, visit bigint"
    nodes = spark.createDataFrame(
        [("f", "m/i/actual_pixel_size", "m/i", "dataset", [], "float32", "1", 0), ("f", "m/i/setup/x", "m/i/setup", "dataset", [2], "float32", "1 2", 1), ("f", "exchange/data", "exchange", "dataset", [4, 3, 2], "uint16", None, 2), ("g", "a/data", "a", "dataset", [4, 3, 2], "uint16", None, 1), ("g", "b/data", "b", "dataset", [4, 3, 2], "uint16", None, 0), ("g", "q", "", "dataset", [2, 3, 4, 5], "float64", None, 3)]
        + [("h", f"c/{k}", "c", "dataset", [1], "uint8", "0", k) for k in range(9)],
        kinds,
    )
    assert {tuple(r) for r in metadata.projection_dataset(nodes).collect()} == {("f", "exchange/data"), ("g", "b/data")}
    assert {r.path for r in metadata.select_path(nodes, "/m/i/").collect()} == {"m/i/actual_pixel_size", "m/i/setup/x"}
    assert [r.value for r in metadata.select_path(nodes, "m/i", 1).sort("visit").collect()] == ["1", None]
    assert metadata.collapsed(nodes).where("file = 'h'").count() == 2 and metadata.collapsed(nodes).where("file = 'g'").count() == 3
    assert metadata.image_datasets(nodes).where("path = 'q'").count() == 2
    frames = spark.createDataFrame([("f", 1, 0), ("f", 1, 1), ("f", 2, 0)], "file string, label int, index int")
    stamps = spark.createDataFrame([("f", 1, 10, "t0"), ("f", 1, 11, "t1"), ("f", 2, 12, "t2"), ("f", 2, 13, "t3")], "file string, label int, ord int, stamp string")
    assert {(r.label, r["index"]): r.stamp for r in metadata.timed_frames(frames, stamps).collect()} == {(1, 0): "t0", (1, 1): "t1", (2, 0): None}
    maps = spark.createDataFrame([(0, {"a": "1", "b": "1"}), (1, {"a": "2"})], "ord int, settings map<string,string>")
    assert {tuple(r) for r in metadata.merged_settings(maps).collect()} == {("a", "2"), ("b", "1")}


def test_flats(spark):
    df = spark.createDataFrame([(0, 0, 0, 4.0), (0, 0, 1, -1.0), (0, 0, 2, float("nan")), (0, 0, 3, 8.0), (1, 0, 0, -2.0)], "z int, y int, x int, v double")
    assert sorted(r.v for r in L.cleaned(df.where("z = 0"), "z").collect()) == [4, 6, 6, 8]
    assert L.centroids(df.where("z = 1"), "z").first().centroid_row is None
    assert L.sample_centres(1000, 7) == [int((i + 0.5) * 1000 / 7) for i in range(7)]
    with pytest.raises(ValueError):
        L.bracket(spark.createDataFrame([(1.0,)], "t double"), [1, 1])
    one = spark.createDataFrame([(0, y, x, float(1 + y * 2 + x)) for y in range(2) for x in range(2)], "theta int, y int, x int, v double")
    flat = one.select("y", "x", F.lit(1.0).alias("pre_gain"), F.lit(1.0).alias("post_gain"), F.lit(0.0).alias("pre_dark"), F.lit(0.0).alias("post_dark"))
    assert {(r.y, r.x): r.v for r in L.sinograms(one, flat, 1, 1).collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}


def test_kernels(spark):
    a = np.random.default_rng(5).random((30, 40)) + 1
    assert np.allclose(S.gaussian(np.full((9, 9), 3.0), 2), 3) and abs(S.gaussian(a, 2).mean() - a.mean()) < 0.02
    w = np.exp(-0.5 * (np.arange(-4, 5) / 1.0) ** 2)
    point = np.zeros((21, 21))
    point[10, 10] = 1
    assert np.allclose(S.gaussian(point, 1.0)[6:15, 6:15], np.outer(w, w) / w.sum() ** 2)
    brute = np.array([[np.median(np.pad(a[y], 2, mode="symmetric")[x : x + 5]) for x in range(40)] for y in range(30)])
    assert np.allclose(S.directional_median(a, 5, 1), brute)
    rng = np.random.default_rng(6)
    assert abs(S.noise_floor(1000 + rng.normal(0, 5, (300, 300))) - 5) < 0.3
    noisy = np.repeat([[0.0, 100.0]], 20, 1).reshape(1, -1).repeat(20, 0) + rng.normal(0, 5, (20, 40))
    assert np.std(S.non_local_means(noisy, 3, 4, 15.0)[:, :18]) < 0.7 * np.std(noisy[:, :18])
    y, x = np.indices((64, 64))
    blob = lambda c: 1000 + 400 * np.exp(-((y - c) ** 2 + (x - 32) ** 2) / 60)
    v, u = S.flow(blob(30), blob(31), fine=1.0, coarse=30, stiffness=0.02, rounds=200, shrink=1)
    inside = (abs(y - 30) < 7) & (abs(x - 32) < 7)
    assert 0.5 < v[inside].mean() < 1.6 and abs(u[inside].mean()) < 0.2
    assert np.allclose(S.transported(a, a, 0.3), a) and np.allclose(S.flow_warped(a, a, 0.3, rounds=3), a)
    assert np.allclose(S.sample(a, np.array([1.5]), np.array([2.0])), (a[1, 2] + a[2, 2]) / 2)


def test_reports(spark):
    rng = np.random.default_rng(9)
    y, x = np.indices((160, 160))
    pre = 5000 + 1500 * np.sin(y / 40) + rng.normal(0, 4, y.shape)
    post = 1.1 * (5000 + 1500 * np.sin((y - 12) / 40)) + rng.normal(0, 4, y.shape)
    row = lambda z, *planes: (z, 160, 160, *[p.ravel().tolist() for p in planes])
    pairs = spark.createDataFrame([row(0, pre, post), row(1, pre, pre + rng.normal(0, 4, y.shape))], "z int, height int, width int, pre array<double>, post array<double>")
    r, same = L.flat_report(pairs).sort("z").collect()
    assert 5 < r.drift_percent < 15 and abs(r.noise - 4) < 1 and r.motion_to_noise > 3 and r.method == "flow" and same.method == "transport"
    # against the definitions, with another smoothing
    ratio = np.log(post / pre)
    w = np.exp(-0.5 * (np.arange(-32, 33) / 8) ** 2)
    along = lambda a: np.array([np.convolve(np.pad(r, 32, mode="symmetric"), w / w.sum(), "valid") for r in a])
    smooth = along(along(ratio).T).T
    h = (ratio - smooth) - (ratio - smooth).mean()
    assert np.allclose([r.smooth_motion, r.fine, r.lag1, r.drift_percent], [smooth.std(), h.std(), (h[:, 1:] * h[:, :-1]).mean() / (h * h).mean(), 100 * (np.exp(np.median(ratio)) - 1)], rtol=1e-3)


def test_residuals_of_gain_models(spark):
    rng = np.random.default_rng(9)
    y, x = np.indices((60, 60))
    pre = 5000 + 1500 * np.sin(y / 15) + rng.normal(0, 4, y.shape)
    post = 1.1 * (5000 + 1500 * np.sin((y - 5) / 15)) + rng.normal(0, 4, y.shape)
    mid = np.exp((np.log(pre) + np.log(post)) / 2)
    one = spark.createDataFrame([(0, 60, 60, *[p.ravel().tolist() for p in (pre, post, mid)])], "z int, height int, width int, pre array<double>, post array<double>, projection array<double>")
    left = L.residual_report(one, 0.5, F.col("x") > 3).first()
    assert left.best in ("crossfade", "transport") and left.share > 0.9 and left.worthwhile
    smoothed = lambda a: S.gaussian(np.log(a), 8)[:, 4:]
    assert np.isclose(left.pre, (smoothed(mid) - smoothed(pre)).std())
    transport = S.gaussian(np.log(S.transported(pre, post, 0.5, 12)), 8)[:, 4:]
    assert np.isclose(left.transport, (smoothed(mid) - transport).std(), atol=1e-9)


def test_warped_gains_are_the_models(spark):
    """Against a plain evaluation, pixel by pixel, with the flow given."""
    rng = np.random.default_rng(2)
    pre, post = (1000 + 300 * rng.random((14, 12)) for _ in range(2))
    how = {"coarse": 6.0, "rounds": 10, "shrink": 1, "stiffness": 0.1, "most": 2.0}
    v, u = S.flow(pre, post, fine=1.5, **how)
    assert np.percentile(np.hypot(v, u), 99) <= 2 + 1e-9 and np.abs(v).max() > 0.01
    lp, lq, s = np.log(pre), np.log(post), 0.3
    beam = S.gaussian(lp, 1.5)

    def at(a, i, j):
        i, j = min(max(i, 0), a.shape[0] - 1), min(max(j, 0), a.shape[1] - 1)
        i0, j0 = min(int(i), a.shape[0] - 2), min(int(j), a.shape[1] - 2)
        p, q = i - i0, j - j0
        return (1 - p) * ((1 - q) * a[i0, j0] + q * a[i0, j0 + 1]) + p * ((1 - q) * a[i0 + 1, j0] + q * a[i0 + 1, j0 + 1])

    warp = lambda k: np.array([[at(beam, i + k * v[i, j], j + k * u[i, j]) for j in range(12)] for i in range(14)])
    drift = S.gaussian(lq - warp(1) - (lp - beam), 2.0)
    assert np.allclose(S.flow_warped(pre, post, s, sigma=1.5, spread=2.0, **how), np.exp(lp - beam + warp(s) + s * drift))
    change = S.gaussian(lq - lp, 2.0)
    assert np.allclose(S.separated_warped(pre, post, s, 1.5, 2.0, **how), np.exp(lp - beam + warp(s) + s * (change - (warp(s) - beam))))
    assert np.allclose(S.separated_warped(pre, post, s, 1.5, 2.0, use_flow=False), np.exp(lp + s * change))


def test_info_documents(spark):
    good = '{"type": "image", "data_type": "uint8", "num_channels": 1, "scales": [{"key": "k", "encoding": "raw", "resolution": [1, 1.5, 1], "voxel_offset": [0, -1, 0], "size": [1, 2, 3], "chunk_sizes": [[1, 1, 1], [2, 2, 2]]}]}'
    texts = [good, "{", "[1]", None, "{}", '{"type": 3, "data_type": null, "num_channels": true, "scales": [{"key": 1, "resolution": [1, "2", 3], "size": [1, 0, 2], "chunk_sizes": [[1, 1]]}, [1]]}', good.replace("raw", "png"), good.replace("[2, 2, 2]", "[4, 4, 4]")]
    found = each(spark, texts, A.info_errors)
    assert found[0] == [] and found[1] == found[2] == found[3] == ["info must be a JSON object"]
    assert found[4] == [*[f"missing info field: {f}" for f in A.INFO_FIELDS], "unsupported layer type: None", "invalid num_channels: None", "scales must be a non-empty list"]
    assert found[5] == [
        "unsupported layer type: 3", "invalid num_channels: true", "mip 0: missing encoding", "mip 0: missing voxel_offset", "mip 0: key must be a non-empty string", "mip 0: resolution entries must be numeric",
        "mip 0: voxel_offset must contain three values", "mip 0: size entries must be positive", "mip 0: invalid chunk_sizes", "mip 1: scale must be an object",
    ]
    prints = each(spark, texts, A.info_fingerprint)
    assert prints[0] == prints[7] != prints[6] and prints[1] is prints[3] is prints[4] is None


def test_fingerprint_sees_a_rewritten_file(spark):
    files = lambda t: spark.createDataFrame([("p", 'a"b', 1, 5), ("p", "c", 2, t)], "parent string, name string, size bigint, mtime_ns bigint")
    one, two = (A.file_fingerprints(files(t)).first().fingerprint for t in (6, 7))
    assert one == hashlib.sha256(json.dumps([['a"b', 1, 5], ["c", 2, 6]], separators=(",", ":")).encode()).hexdigest() != two


def test_forward_view_and_points(spark, tmp_path):
    state = spark.createDataFrame([({"layout": '"4panel"', "x": "1"},), ({"layout": '{"type":"xy","orthographicProjection":false}', "projectionOrientation": "[1]"},), ({"x": "2"},)], "s map<string,string>")
    plain, ortho = (state.select(Y.shift_angle(F.col("s"), o)).collect() for o in (False, True))
    assert plain[0][0] == {"layout": '"4panel"', "x": "1", "projectionOrientation": Y.FORWARD} and plain[1][0]["projectionOrientation"] == Y.FORWARD
    assert json.loads(ortho[0][0]["layout"]) == {"type": "4panel", "orthographicProjection": True} and json.loads(ortho[1][0]["layout"]) == {"type": "xy", "orthographicProjection": True}
    a = np.arange(12, dtype=np.int16).reshape(4, 3)
    np.save(tmp_path / "p.npy", a)
    assert [tuple(r)[2:] for r in Y.read_points(spark, str(tmp_path / "p.npy")).sort("ord").collect()] == [tuple(map(float, r)) for r in a]
    np.save(tmp_path / "q.npy", a.T)
    with pytest.raises(Exception, match="three columns"):
        Y.read_points(spark, str(tmp_path / "q.npy")).collect()


def test_natural_order_of_long_numbers(spark):
    names = ["a1", "a01b", "a" + "9" * 30, "a1" + "0" * 30, "a1" + "0" * 29 + "1", "a2b", "B"]
    keys = dict(zip(names, each(spark, names, X.natural_key)))
    assert sorted(names, key=keys.get) == ["a1", "a01b", "a2b", "a" + "9" * 30, "a1" + "0" * 30, "a1" + "0" * 29 + "1", "B"]


def test_rename_plans(spark):
    files = spark.createDataFrame([("d/a/x.tif.gz",), ("d/a/y_7.tif",), ("e/a/x.tif.br",)], "path string")
    plan = {r.path: (r.new, r.collides) for r in A.rename_plan(files, X.unzipped_name(F.col("path"))).collect()}
    assert plan == {"d/a/x.tif.gz": ("a/x.tif", True), "e/a/x.tif.br": ("a/x.tif", True), "d/a/y_7.tif": ("a/y_7", False)}
    assert A.rename_plan(files, X.padded_name(F.substring_index("path", "/", -1))).collect() == [("d/a/y_7.tif", "y_00007.tif", False)]


def test_decomposition_reconstructs(spark):
    from volspark.operators.volume import planes

    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(z, y, x, float(rng.random() + 1)) for z in range(3) for y in range(8) for x in range(9)], "z int, y int, x int, v double")
    static, beams = S.decompose(planes(df), 1.0, 3)
    back = beams.join(static, ["y", "x"]).join(df.withColumnRenamed("v", "w"), ["z", "y", "x"])
    assert back.count() == 216 and back.where(F.abs(F.col("v") * F.col("d") - F.col("w")) > 1e-9).count() == 0


def test_surfaces(spark):
    cube = spark.createDataFrame([(z, y, x, 1 if z < 2 and y < 2 and x < 2 else 0) for z in range(4) for y in range(4) for x in range(4)], "z int, y int, x int, v int")
    assert mesh.faces(cube).count() == 24 and mesh.faces(cube, dust=9).count() == 0
    assert mesh.levels_of_detail(cube, 2).where("lod = 1").count() == 6


def test_stages(spark, tmp_path):
    ran = []

    def make(name, n):
        def build(s, tables):
            ran.append(name)
            return s.range(n) if not tables else list(tables.values())[-1].union(s.range(n))

        return stages.Stage(name, {"n": n}, build)

    run = stages.Stages(spark, str(tmp_path))
    assert run.run([make("a", 3), make("b", 2)]) == {"a": "done", "b": "done"}
    assert run.run([make("a", 3), make("b", 2)]) == {"a": "kept", "b": "kept"} and ran == ["a", "b"]
    with pytest.raises(ValueError):
        run.run([make("a", 4)])
    assert run.run([make("a", 4), make("b", 2)], replace=True) == {"a": "done", "b": "done"}
    assert spark.read.parquet(f"{tmp_path}/b.parquet").count() == 6


def test_usage_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    rows = [("s", t + timedelta(minutes=m), m, 1) for m in (0, 1, 2, 30, 31)] + [("s", t + timedelta(hours=9), 0, 1)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "stage string, ts timestamp, used int, processes int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = usage.sessions(spark.readStream.schema(schema).parquet(src))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.began, r.peak, r.samples) for r in spark.read.parquet(out).collect()}
    assert got == {(t, 2, 3), (t + timedelta(minutes=30), 31, 2)}
    assert usage.sessions(spark.createDataFrame(rows, schema)).count() == 3


def test_selections(spark, tmp_path):
    names = spark.createDataFrame([("ab1",), ("b2",), (".h",), ("c_mesh",)], "name string")
    got = lambda df: sorted(r[0] for r in df.collect())
    assert got(A.with_prefixes(names, "name", ["ab", "b", "ab"])) == ["ab1", "b2"] and got(A.with_prefixes(names, "name", [])) == []
    assert got(A.datasets(names, ("_mesh",))) == ["ab1", "b2"] and got(A.remaining(names, names.where("name = 'b2'"), "name")) == [".h", "ab1", "c_mesh"]
    assert got(A.idle_nodes(spark.createDataFrame([("n1 x idle",), ("n2 x down",), ("n3 mix",)], "value string"))) == ["n1", "n3"]
    assert got(A.node_range("n", 8, 10, spark)) == ["n10", "n8", "n9"]
    assert {tuple(r) for r in A.present_scales(spark.createDataFrame([("a",), ("b",)], "scale string"), spark.createDataFrame([("b",), ("c",)], "parent string")).collect()} == {("a", True, False), ("b", True, True), ("c", False, True)}
    assert {tuple(r) for r in A.successes(spark.createDataFrame([(200,), (404,), (None,)], "status int")).collect()} == {(True, 1), (False, 2)}
    (tmp_path / "p.csv").write_text("1,2,3\n4, 5,6.5\n")
    assert [(r.ord, r.px, r.pz) for r in Y.read_points(spark, str(tmp_path / "p.csv")).sort("ord").collect()] == [(0, 1, 3), (1, 4, 6.5)]
    (tmp_path / "q.csv").write_text("1,2\n")
    with pytest.raises(Exception):
        Y.read_points(spark, str(tmp_path / "q.csv")).collect()


def test_documents(spark):
    docs = spark.createDataFrame([("a", '{"type":"image","data_type":"uint8","num_channels":1,"scales":[{"key":"k","size":[1,2,3]},{"key":"l"}]}'), ("b", "{"), ("c", "{}")], "doc string, body string")
    rows = {(r.doc, r.mip): (r.key, r["size"], r.broken) for r in metadata.scales_of(docs).collect()}
    assert rows == {("a", 0): ("k", [1, 2, 3], False), ("a", 1): ("l", None, False), ("b", None): (None, None, True), ("c", None): (None, None, True)}
    yaml = spark.createDataFrame([("f", "a:\n  b: 1\n  c: [x]\n"), ("g", "a: [")], "path string, value string")
    assert {tuple(r) for r in metadata.yaml_settings(yaml).collect()} == {("f", "a.b", "1"), ("f", "a.c", '["x"]'), ("g", None, None)}
    assert str(each(spark, ["scan done 2024-01-02 03:04:05.000006"], X.log_time)[0]) == "2024-01-02 03:04:05.000006" and each(spark, ["x"], X.log_time) == [None]
    assert [r[0] for r in spark.createDataFrame([([1],), ([1, 2],), ([1] * 70,)], "v array<int>").select(X.value_text(F.col("v"))).collect()] == ["1", "[1, 2]", "<70 values>"]


def test_volume_extras(spark):
    from volspark.functions import numeric as N
    from volspark.operators import volume as V

    df = spark.createDataFrame([(z, y, x, float(z * 12 + y * 4 + x)) for z in range(2) for y in range(3) for x in range(4)], "z int, y int, x int, v double")
    got = {(r.z, r.y, r.x): r.v for r in V.fetch(df, [0, 1, 1], [2, 3, 4], "float32", True).collect()}
    a = np.arange(24.0).reshape(2, 3, 4)[0:2, 1:3, 1:4].transpose(2, 0, 1)
    assert got == {k: a[k] for k in np.ndindex(a.shape)}
    types = V.as_types(df.where("v <= 10"), ["uint16", "float32", "uint16"], "manual", 0, 10)
    assert list(types) == ["uint16", "float32"] and types["uint16"].agg({"v": "max"}).first()[0] == 65535 and types["float32"].agg({"v": "max"}).first()[0] == 1
    assert V.as_types(df, ["uint8"], "percentile", 0, 100)["uint8"].agg({"v": "max"}).first()[0] == 255
    assert N.even_steps(0, 1, 0.25) == [0, 0.25, 0.5, 0.75, 1] and N.even_steps(2, 0, 1) == [2, 1, 0]
    planes = V.planes(df).withColumn("dtype", F.lit("uint8"))
    assert V.check_layout(planes) == (3, 4, "uint8")
    with pytest.raises(ValueError):
        V.check_layout(planes.unionByName(planes.withColumn("height", F.lit(9))))
    rng = np.random.default_rng(1).random((16, 16)) + 1
    assert np.allclose(S.separated_warped(rng, rng, 0.4, rounds=2), rng)
