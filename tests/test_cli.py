import os

import numpy as np
import pytest

from volspark import cli, registry
from volspark.sources import optional, tiff


def stack(path, a):
    os.makedirs(path, exist_ok=True)
    for k, p in enumerate(a):
        tiff.write(f"{path}/in_{k:03d}.tif", [p])
    return str(path)


def read(path):
    out = []
    for n in sorted(os.listdir(path)):
        with open(f"{path}/{n}", "rb") as f:
            out.append(tiff.read_page(f, next(tiff.pages(f))))
    return np.stack(out)


@pytest.fixture()
def data(tmp_path):
    a = np.random.default_rng(1).integers(0, 60000, (5, 6, 8)).astype("uint16")
    return a, stack(tmp_path / "in", a), str(tmp_path / "out")


def test_flip_trim_transpose_stitch(spark, data):
    a, src, out = data
    cli.main(["transform", "flip", src, out, "--flip-axis", "z"], spark)
    assert not os.path.exists(out)  # only shown
    cli.main(["transform", "flip", src, out, "--flip-axis", "z", "--execute"], spark)
    assert (read(out) == a[::-1]).all() and read(out).dtype == a.dtype
    cli.main(["transform", "trim", "--data-dir", src, "--output-dir", out, "--vertical-trim", "1,2", "--z-trim", "1,0", "--execute"], spark)
    assert (read(out) == a[1:, 1:4]).all()
    cli.main(["transform", "transpose", src, out, "--execute"], spark)
    assert (read(out) == a.transpose(2, 1, 0)).all()
    cli.main(["transform", "stitch-reconstructions", src, src, out, "--a-stop", "2", "--b-start", "4", "--execute"], spark)
    assert (read(out) == np.concatenate([a[:2], a[4:]])).all()


def test_pipeline(spark, data):
    a, src, out = data
    cli.main(["transform", "pipeline", "--data-dir", src, "--output-dir", out, "--mips", "2", "--bin-power", "1", "--execute"], spark)
    m = np.maximum(a[:-1], a[1:]).astype(float)
    low, high = m.min((1, 2), keepdims=True), m.max((1, 2), keepdims=True)
    s = np.floor((m - low) * np.maximum(255 / (high - low), 1)).astype(int) % 256
    assert (read(out) == np.floor(s.reshape(4, 3, 2, 4, 2).mean((2, 4)) + 0.5)).all()


def test_precompute_and_validate(spark, data, capsys):
    a, src, out = data
    cli.main(["ng", "precompute", src, out, "--chunk-size", "4,4,2", "--execute"], spark)
    cli.main(["ng", "validate", out], spark)
    assert str(a.size) in capsys.readouterr().out
    back = spark.read.format("chunkedvolume").load(out)
    assert back.count() == a.size and back.agg({"v": "sum"}).first()[0] == a.sum()


def test_registry(spark):
    assert "volume.sliding_max" in registry.OPERATORS and "diff.diff_tables" in registry.OPERATORS
    registry.register_plane_op("double", lambda a: a * 2)
    planes = spark.createDataFrame([(0, 1, 2, [1.0, 2.0])], "z int, height int, width int, pixels array<double>")
    assert registry.apply("double", planes).first().pixels == [2, 4]
    with pytest.raises(ValueError):
        registry.register_plane_op("double", lambda a: a)


def test_absent_libraries_are_named():
    with pytest.raises(ImportError, match="no_such_thing"):
        optional.need("no_such_thing", "reading")
