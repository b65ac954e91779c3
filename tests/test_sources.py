import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from volspark.operators import volume as V
from volspark.sources import formats, sharded, tiff


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    formats.register(spark)


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "float32", "float64", "uint32"])
@pytest.mark.parametrize("compression", ["none", "zlib"])
@pytest.mark.parametrize("big", [False, True])
def test_codec(tmp_path, dtype, compression, big):
    pages = [(np.arange(35).reshape(5, 7) * (k + 1)).astype(dtype) for k in range(3)]
    path = str(tmp_path / "a.tif")
    tiff.write(path, pages, compression, big)
    with open(path, "rb") as f:
        found = list(tiff.pages(f))
        assert len(found) == 3 and all((tiff.read_page(f, p) == q).all() for p, q in zip(found, pages))
        assert (tiff.read_rows(f, found[1], 2, 4) == pages[1][2:4]).all()


def pack_lzw(data):
    out, table, width, held, bits, w = bytearray(), {bytes([k]): k for k in range(256)}, 9, 0, 0, b""

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    n = 258
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        put(table[w])
        table[w + bytes([b])] = n
        n += 1
        width = max(9, n.bit_length())
        w = bytes([b])
        if n == 4094:
            put(table[w])
            put(256)
            table, n, width, w = {bytes([k]): k for k in range(256)}, 258, 9, b""
    if w:
        put(table[w])
        n += 1
        width = min(12, max(9, n.bit_length()))
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def test_lzw():
    for data in (b"abababababab" * 40, bytes(range(256)) * 3, b"x", os.urandom(9000)):
        assert tiff._unpack_lzw(pack_lzw(data)) == data


def test_stack_round_trip_and_pruning(spark, tmp_path):
    for k in range(12):
        tiff.write(str(tmp_path / f"s_{k}.tif"), [np.full((2, 3), k, "uint16") + np.arange(6).reshape(2, 3).astype("uint16")])
    df = spark.read.format("tiffstack").option("planesPerTask", "2").load(str(tmp_path))
    rows = {r.z: (r.name, r.pixels) for r in df.collect()}
    assert [rows[z][0] for z in range(12)] == [f"s_{k}.tif" for k in range(12)] and rows[3][1] == [3, 4, 5, 6, 7, 8]
    os.remove(tmp_path / "s_11.tif")
    (tmp_path / "s_11.tif").write_bytes(b"broken")
    assert df.where((F.col("z") >= 3) & (F.col("z") < 6)).count() == 3  # the broken file isn't opened
    out = str(tmp_path / "out")
    voxels = V.flip(V.voxels(df.where("z < 4")), "z", 4)
    planes = V.planes(voxels).select("z", F.lit(None).cast("string").alias("name"), "height", "width", F.lit("uint16").alias("dtype"), "pixels")
    planes.write.format("tiffstack").mode("append").option("path", out).save()
    again = spark.read.format("tiffstack").load(out)
    assert {r.z: r.pixels[0] for r in again.collect()} == {0: 3, 1: 2, 2: 1, 3: 0}
    with pytest.raises(Exception):
        planes.write.format("tiffstack").mode("append").option("path", out).save()
    planes.where("z < 1").write.format("tiffstack").mode("overwrite").option("path", out).save()
    assert sorted(os.listdir(out)) == ["slice_00000.tif"]


def test_multipage_file_and_orders(spark, tmp_path):
    tiff.write(str(tmp_path / "m.tif"), [np.full((2, 2), k, "float32") for k in range(5)])
    df = spark.read.format("tiffstack").load(str(tmp_path / "m.tif"))
    assert [r.pixels[0] for r in df.where("z >= 2").sort("z").collect()] == [2, 3, 4]
    for n in ("b2.tif", "b10.tif", "B1.tiff"):
        (tmp_path / n).touch()
    base = lambda o: [os.path.basename(p) for p in formats.listing(str(tmp_path), o)]
    assert base("name") == ["B1.tiff", "b10.tif", "b2.tif", "m.tif"] and base("natural") == ["B1.tiff", "b2.tif", "b10.tif", "m.tif"]
    (tmp_path / "b02.tif").touch()
    with pytest.raises(ValueError):
        base("stem")


def test_raw_volume(spark, tmp_path):
    v = np.arange(24, dtype=">i2").reshape(4, 3, 2)
    path = str(tmp_path / "v.raw")
    open(path, "wb").write(b"head" + v.tobytes())
    o = {"width": "2", "height": "3", "depth": "4", "dtype": "int16", "byteOrder": "big", "headerBytes": "4", "planesPerTask": "1"}
    df = spark.read.format("rawvolume").options(**o).load(path)
    assert [r.pixels for r in df.sort("z").collect()] == v.reshape(4, 6).tolist()
    assert df.where("z = 2").count() == 1
    with pytest.raises(Exception):
        spark.read.format("rawvolume").options(**o | {"depth": "5"}).load(path).count()


def test_row_windows_and_byte_spans(spark, tmp_path):
    for k in range(3):
        tiff.write(str(tmp_path / f"p{k}.tif"), [np.arange(12, dtype="uint16").reshape(3, 4) + 100 * k], "none" if k else "zlib")
    rows = spark.read.format("tiffstack").option("rows", "1:3").load(str(tmp_path)).sort("z").collect()
    assert [r.pixels for r in rows] == [(np.arange(4, 12) + 100 * k).tolist() for k in range(3)] and rows[0].height == 2
    (tmp_path / "raw").write_bytes(b"__abc--DEF++")
    spans = spark.read.format("bytespans").options(offset="2", stride="5", size="3", count="2")
    assert [bytes(r.data) for r in spans.load(str(tmp_path / "raw")).sort("k").collect()] == [b"abc", b"DEF"]
    with pytest.raises(Exception):
        spans.option("count", "3").load(str(tmp_path / "raw")).collect()


def test_file_tree(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for n, size in (("top", 3), ("a/_hidden", 0), ("a/b/.dot", 5)):
        (tmp_path / n).write_bytes(b"x" * size)
    rows = spark.read.format("filetree").option("prefix", "/p/").load(str(tmp_path)).collect()
    assert {(r.key, r["size"]) for r in rows} == {("p/top", 3), ("p/a/_hidden", 0), ("p/a/b/.dot", 5)} and all(r.mtime_ns > 0 for r in rows)


def test_chunked_volume(spark, tmp_path):
    v = np.arange(5 * 4 * 3).reshape(3, 4, 5)
    df = spark.createDataFrame([(z, y, x, float(v[z, y, x])) for z, y, x in np.ndindex(v.shape)], "z int, y int, x int, v double")
    info = formats.info_document("image", "uint16", [5, 4, 3], [2, 3, 2], [700, 700, 700], [10, 20, 30])
    formats.write_chunked(df, str(tmp_path / "vol"), info)
    names = os.listdir(tmp_path / "vol/700_700_700")
    assert len(names) == 12 and "10-12_20-23_30-32" in names
    first = np.frombuffer((tmp_path / "vol/700_700_700/10-12_20-23_30-32").read_bytes(), "<u2").reshape((2, 3, 2), order="F")
    assert (first == v.transpose(2, 1, 0)[:2, :3, :2]).all()
    back = spark.read.format("chunkedvolume").load(str(tmp_path / "vol")).collect()
    assert {(r.z - 30, r.y - 20, r.x - 10): r.v for r in back} == {k: float(v[k]) for k in np.ndindex(v.shape)}


@pytest.mark.parametrize("shards", [False, True])
@pytest.mark.parametrize("labels", [False, True])
def test_all_scales_written_and_regions_read(spark, tmp_path, shards, labels):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 4 if labels else 999, (5, 9, 7))
    df = spark.createDataFrame([(z, y, x, float(v[z, y, x])) for z, y, x in np.ndindex(v.shape)], "z int, y int, x int, v double")
    info = formats.with_scales(formats.info_document("segmentation" if labels else "image", "uint16", [7, 9, 5], [2, 3, 2], [4, 4, 4], [10, 20, 30]), 2)
    info = formats.with_shards(info, 4, 2) if shards else info
    path = str(tmp_path / "vol")
    os.makedirs(path)
    formats.write_pyramid(df, path, info, labels)
    assert json.load(open(f"{path}/info")) == info and [s["size"] for s in info["scales"]] == [[7, 9, 5], [4, 5, 3], [2, 3, 2]]
    level = v
    for mip, s in enumerate(info["scales"]):
        o = s["voxel_offset"]
        back = spark.read.format("chunkedvolume").option("mip", mip).load(path)
        got = {(r.z - o[2], r.y - o[1], r.x - o[0]): r.v for r in back.collect()}
        assert got == {k: float(level[k]) for k in np.ndindex(level.shape)}
        region = back.where(f"z >= {o[2] + 1} and x < {o[0] + 2} and y = {o[1] + 1}")
        assert {(r.z - o[2], r.x - o[0]): r.v for r in region.collect()} == {(z, x): float(level[z, 1, x]) for z in range(1, level.shape[0]) for x in range(min(2, level.shape[2]))}
        parts = np.empty([-(-n // 2) for n in level.shape])
        for k in np.ndindex(parts.shape):
            block = level[tuple(slice(2 * i, 2 * i + 2) for i in k)].ravel()
            parts[k] = np.bincount(block.astype(int)).argmax() if labels else np.rint(block.mean())
        level = parts


def test_a_region_opens_its_chunks_alone(tmp_path):
    info = formats.info_document("image", "uint8", [8, 8, 8], [2, 2, 2], [1, 1, 1])
    (tmp_path / "info").write_text(json.dumps(info))
    reader = formats.ChunkedReader({"path": str(tmp_path), "chunkspertask": "3"})
    assert sum(p.count for p in reader.partitions()) == 64
    assert list(reader.pushFilters([GreaterThanOrEqual(("z",), 3), LessThan(("z",), 5), EqualTo(("x",), 7), EqualTo(("v",), 1.0)])) == [EqualTo(("v",), 1.0)]
    assert [(p.first, p.count) for p in reader.partitions()] == [(0, 3), (3, 3), (6, 2)]


def test_shards(spark, tmp_path):
    grid = (5, 3, 2)
    bits = sharded.shard_bits(grid, 8, 2)
    chunks = [(x, y, z, bytes([x, y, z]) * 9) for x in range(5) for y in range(3) for z in range(2)]
    df = spark.createDataFrame(chunks, "bx int, by int, bz int, data binary")
    ids = {(r.bx, r.by, r.bz): r.id for r in df.withColumn("id", sharded.chunk_id(grid, F.col("bx"), F.col("by"), F.col("bz"))).collect()}
    assert len(set(ids.values())) == 30 and ids[(1, 0, 0)] == 1 and ids[(0, 1, 0)] == 2 and ids[(0, 0, 1)] == 4 and ids[(2, 0, 0)] == 8
    data = [(ids[c[:3]], c[3]) for c in chunks]
    for zipped in (True, False):
        assert sharded.unpack(sharded.pack(data, bits, zipped), bits, zipped) == dict(data)
    sharded.write_shards(df, str(tmp_path / "s"), grid, 8)
    bits = sharded.shard_bits(grid, 8)
    found = {}
    for n in os.listdir(tmp_path / "s"):
        found |= sharded.unpack((tmp_path / "s" / n).read_bytes(), bits)
    assert found == dict(data)
