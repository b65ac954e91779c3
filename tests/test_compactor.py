import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volspark.streaming import compactor as c

ROW = T.StructType().add("id", T.LongType()).add("v", T.StringType()).add("batch", T.IntegerType())


def tiny_files(spark, path, first, n):
    for i in range(first, first + n):
        spark.createDataFrame([(i * 10 + k, None if k == 3 else f"v{i}", 1) for k in range(5)], ROW).coalesce(1).write.mode("append").parquet(path)


def test_records_survive_failures_and_late_files(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    tiny_files(spark, src, 0, 9)
    with pytest.raises(Exception):
        c.compact_files(spark, src, out, cp, ROW, files_per_batch=3, fail_at=1)
    done = c.compact_files(spark, src, out, cp, ROW, files_per_batch=3)
    key = lambda rows: sorted(map(str, rows))
    assert key(done.read(ROW).collect()) == key(spark.read.parquet(src).collect())
    tiny_files(spark, src, 9, 2)
    done = c.compact_files(spark, src, out, cp, ROW, files_per_batch=3)
    assert key(done.read(ROW).collect()) == key(spark.read.parquet(src).collect())
    files = [f for _, _, fs in os.walk(out) for f in fs if f.endswith(".parquet")]
    assert len(files) <= 5


INVENTORY = "file_id bigint, stack_id string, output_name string, digits int, size bigint, written_at timestamp, slice_no string"


def test_plan(spark, tmp_path):
    random.seed(2)
    t0 = datetime(2020, 1, 1)
    rows = []
    for i in range(3000):
        stack = random.choice(["hot"] * 5 + ["b", "c", None])
        name = random.choice([f"scan8_{random.randrange(900):04d}.tif", f"s.{random.randrange(900)}.TIFF", f"x{random.randrange(900)}.tif.part", "note.txt", "z.tif", None, "1" * 25 + ".tif", "a5.tif\n"])
        rows.append((i, stack, name, None, random.choice([None, 0, 10, 900_000, 1 << 20, 1 << 22]), random.choice([None, t0 + timedelta(seconds=random.randrange(50))]), "x"))
    src = str(tmp_path / "inv")
    df = spark.createDataFrame(rows, INVENTORY)
    for k in range(3):
        df.where(F.pmod("file_id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(src)
    import re

    best = {}
    for i, stack, name, _, size, at, _ in rows:
        m = re.search(r"([0-9]+)\.tiff?\Z", name or "", re.I)
        if not m or not stack or not size or int(m[1]) >= 1 << 63:
            continue
        rank = (at is not None, at or t0, i)
        if (k := (stack, int(m[1]))) not in best or best[k][0] < rank:
            best[k] = (rank, i, size)
    expected = {(s, n, v[1]) for (s, n), v in best.items() if v[2] < c.TINY}
    compactor = c.SliceCompactor(spark, str(tmp_path / "root"), files_per_batch=1)
    with pytest.raises(Exception):
        compactor.discover(src, df.schema, fail_at=1)
    compactor.discover(src, df.schema)
    plan = compactor.plan(largest=8 << 20).collect()
    assert {(r.stack_id, r.slice_no, r.file_id) for r in plan} == expected and len(plan) == len(expected) > 150
    by = {}
    for r in sorted(plan, key=lambda r: (r.stack_id, r.slice_no)):
        by.setdefault(r.container_name, []).append(r)
    assert all(sum(r["size"] for r in rs) <= 8 << 20 for rs in by.values())
    order = [r.container for r in sorted(plan, key=lambda r: (r.stack_id, r.slice_no)) if r.stack_id == "hot"]
    assert order == sorted(order) and len(set(order)) > 3
    contents = spark.createDataFrame([(i, bytes([i % 251])) for i in range(3000)], "file_id bigint, content binary")
    packs = c.Containers(spark, str(tmp_path / "packs"))
    first = packs.write(compactor.plan(largest=8 << 20), contents)
    assert first == len(by) and packs.write(compactor.plan(largest=8 << 20), contents) == 0
    packed = packs.read()
    assert packed.count() == len(expected)
    assert packed.where(F.col("content") != F.unhex(F.lpad(F.hex(F.pmod("file_id", F.lit(251))), 2, "0"))).count() == 0


def test_a_changed_plan_leaves_each_slice_in_one_container(spark, tmp_path):
    plan_of = lambda rows: spark.createDataFrame([(*r, f"{r[0]}_{r[5]}") for r in rows], "stack_id string, slice_no bigint, file_id bigint, output_name string, size bigint, container bigint, container_name string")
    contents = spark.createDataFrame([(i, bytes([i])) for i in range(20)], "file_id bigint, content binary")
    old = [("a/b=1", i, i, f"s{i}", 1, i // 4) for i in range(12)] + [("", i, 12 + i, f"s{i}", 1, 0) for i in range(3)]
    packs = c.Containers(spark, str(tmp_path / "packs"))
    held = lambda: sorted((r.stack_id, r.slice_no, r.container) for r in packs.read().collect())
    assert held() == [] and packs.write(plan_of(old), contents) == 4
    assert held() == sorted((r[0], r[1], r[5]) for r in old)
    new = [(*r[:5], r[5] if r[0] == "" else r[1] // 6) for r in old if r[1] != 11]  # other cuts, one container less, a slice less
    with pytest.raises(RuntimeError):
        packs.write(plan_of(new), contents, fail_before_commit=True)
    assert held() == sorted((r[0], r[1], r[5]) for r in old)
    assert packs.write(plan_of(new), contents) == 2  # that of the other stack stands
    assert held() == sorted((r[0], r[1], r[5]) for r in new)
    assert packs.vacuum() == 0 and packs.write(plan_of(new), contents) == 0 and packs.vacuum() == 3
    assert held() == sorted((r[0], r[1], r[5]) for r in new)
    with pytest.raises(RuntimeError, match="missing"):
        packs.write(plan_of([*new, ("", 9, 99, "s", 1, 0)]), contents)
    racing = c.Containers(spark, str(tmp_path / "packs"))
    stale = racing._versions()
    assert packs.write(plan_of(old), contents) == 3  # all but that of the other stack, which stands
    racing._versions = lambda: stale
    with pytest.raises(RuntimeError, match="another"):
        racing.write(plan_of(new), contents)
    assert held() == sorted((r[0], r[1], r[5]) for r in old)


def test_old_files_that_arrive_late_are_read(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    tiny_files(spark, src, 0, 2)
    c.compact_files(spark, src, out, cp, ROW)
    tiny_files(spark, str(tmp_path / "more"), 2, 1)
    for f in os.listdir(tmp_path / "more"):
        if f.endswith(".parquet"):
            os.rename(tmp_path / "more" / f, tmp_path / "in" / ("late +%2 é" + f))
            os.utime(tmp_path / "in" / ("late +%2 é" + f), (1e9, 1e9))
    done = c.StreamingCompactor(spark, out, cp)
    assert done.unread(src).count() > 0
    done = c.compact_files(spark, src, out, cp, ROW)
    assert done.read(ROW).count() == 15 and done.unread(src).count() == 0


def test_files_are_packed_by_bytes(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    tiny_files(spark, src, 0, 12)
    size = max(os.path.getsize(os.path.join(src, f)) for f in os.listdir(src) if f.endswith(".parquet"))
    c.compact_files(spark, src, out, cp, ROW, bytes_per_file=6 * size)
    files = [f for _, _, fs in os.walk(out) for f in fs if f.endswith(".parquet")]
    assert 2 <= len(files) <= 3


def test_empty_inventory(spark, tmp_path):
    src = str(tmp_path / "inv")
    spark.createDataFrame([], INVENTORY).write.parquet(src)
    assert c.compact_inventory(spark, src, str(tmp_path / "root")).count() == 0
