"""Results that once left out a part of their input."""

import json
import os
import random
import sys
import types

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from volspark import cli
from volspark.operators import admin, metadata
from volspark.operators import schema_drift as sd
from volspark.sources import optional

SF = "/root/testdata/sf0.001"
LONGER = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_one_table_loses_no_leaf(spark):
    bodies = [
        {"storage": {"inner": "a", "inner_comment": "b", "hasScan": "no"}, "scan": {"tilt": {"deg": 1.5}, "stage_note": "s", "energy": "30kV"}},
        {"sample": {"HAS_SCAN": True, "comment-inner": "c"}, "scan": {"with_scan": False, "tilt": {"deg": 12345678901234567890}, "Stage-Note": 4, "rest": None}},
        {"storage": {"remarks": ["r"]}, "conf_id": 7, "x": {"y": {"note": "deep"}}, "energy": {}},
    ]
    maps = sd.drift_tables(spark.createDataFrame([(i, "s", None, json.dumps(b)) for i, b in enumerate(bodies)], "conf_id bigint, sample_id string, written_at timestamp, body string"))
    columns = sd.resolved_columns(maps)
    rows = {r.conf_id: r.asDict() for r in sd.project_fields(maps, columns).collect()}
    assert (rows[0]["storage_inner"], rows[0]["storage_inner_comment"], rows[0]["scan_tilt_deg"]) == ("a", "b", 1.5)
    spelled = next(ps for _, _, ps in columns if "storage.hasScan" in ps)
    assert "sample.HAS_SCAN" in spelled and "scan.stage_note" in next(ps for _, _, ps in columns if "scan.Stage-Note" in ps)
    assert (rows[2]["storage_remarks"], rows[2]["conf_id_2"], rows[2]["x_y_note"]) == ('["r"]', 7, "deep")
    assert ("scan.tilt.deg", "number", "12345678901234567890") in {tuple(x) for x in rows[1]["rest"]}
    named = {n: ps for n, _, ps in columns}
    for i, b in enumerate(bodies):
        left = {x.path: (x.type, x.value) for x in rows[i]["rest"]}
        assert left.items() <= sd.leaves(json.dumps(b)).items()
        for path, (_, value) in sd.leaves(json.dumps(b)).items():
            carried = [n for n, ps in named.items() if path in ps and rows[i][n] is not None]
            assert path in left or (carried and value is not None), (i, path)
    few = sd.project_fields(maps, sd.resolved_columns(maps, 0)).collect()
    assert "x.y.note" in {x.path for r in few for x in r["rest"]} and "x_y_note" not in few[0]


@needs_data
def test_table_of_p5_has_every_leaf(spark):
    maps = sd.drift_tables(spark.read.parquet(f"{SF}/conf_files.parquet"))
    columns = {n: ps for n, _, ps in sd.resolved_columns(maps, apart=tuple(f"storage.{n}" for n in ("comment", "inner_comment", "outer_comment", "has_scan")))}
    fields = {r.conf_id: r.fields for r in maps.where("fields is not null").collect()}
    rows = entry.queries()["p5_table"](spark, SF).collect()
    assert sum(r.readable for r in rows) == len(fields) < len(rows) == maps.count()
    for r in [r for r in rows if r.readable]:
        left = {x.path for x in r["rest"]}
        for path, leaf in fields[r.conf_id].items():
            assert path in left or (leaf.value is not None and any(path in ps and r[n] is not None for n, ps in columns.items())), (r.conf_id, path)


def test_tally_runs_in_blocks(spark):
    random.seed(3)
    rows = [(i * 3 - 20, random.choice([None, *range(i // 4 + 1)])) for i in range(120)]
    shown, most = {}, None
    for o, d in rows:
        most = d if most is None else most if d is None else max(most, d)
        shown[o] = 25 if most is None else min(most, 25)
    events = spark.createDataFrame(rows, "ord bigint, done int")
    for block in (7, 4096):
        assert {r.ord: r.shown for r in admin.tally(events, 25, block).collect()} == shown
    plan = admin.tally(events, 25)._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(_block" in plan and "windowspecdefinition(ord" not in plan


@needs_data
def test_tally_of_every_part(spark):
    assert entry.queries()["progress_tally"](spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()


@needs_data
@pytest.mark.skipif(not os.path.isdir(LONGER), reason="no test data")
def test_every_plane_is_corrected(spark):
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{LONGER}/events.parquet'")
    want = {tuple(r[:3]): r[3] for r in duck.sql(entry.oracle_sql()["flatfield_correct"]).fetchall()}
    got = {tuple(r[:3]): r[3] for r in entry.queries()["flatfield_correct"](spark, LONGER).select("z", "y", "x", "v").collect()}
    assert got == pytest.approx(want, abs=2e-6) and len({z for z, _, _ in got}) == 100


class FakeDataset:
    """As much of an HDF5 dataset as the source asks for."""

    attrs: dict = {}

    def __init__(self, n):
        self.a = np.arange(n)
        self.size, self.shape, self.dtype = self.a.size, self.a.shape, self.a.dtype

    def __getitem__(self, _):
        return self.a


class FakeFile:
    def __init__(self, path):
        pass

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def visititems(self, visit):
        visit("g", types.SimpleNamespace(attrs={}))
        for k in range(9):
            visit(f"g/d{k}", FakeDataset(100))
        visit("h", FakeDataset(100))


def test_values_and_nodes_of_an_asked_path_are_whole(spark, monkeypatch, capsys):
    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(Dataset=FakeDataset, File=FakeFile))
    read = lambda **o: {r[1]: r for r in optional.H5Reader({"path": "f.h5", **o}).read(optional.OneFile("f.h5"))}
    rows = read(select="/g/", maxvalues="0")
    assert rows["g/d8"][6] == str(list(range(100))) and rows["h"][6] is None
    assert read(select="/", maxvalues="0")["h"][6] and not read(select="g", maxvalues="99")["g/d0"][6] and not read()["g/d0"][6]
    nodes = spark.createDataFrame(list(rows.values()), optional.H5Nodes({}).schema())
    assert cli.tree_rows(nodes, "/g/", 0).count() == 10 and cli.tree_rows(nodes, "/g/", 0).where("value is not null").count() == 9
    assert cli.tree_rows(nodes, "", 16).count() == 4
    cli.print_rows(nodes.crossJoin(spark.range(120)).select("path"))
    assert len(capsys.readouterr().out.splitlines()) == 11 * 120 + 1


def test_every_directory_is_judged(spark, tmp_path, capsys):
    for k in range(105):
        (tmp_path / f"job{k:03d}").mkdir()
        (tmp_path / f"job{k:03d}" / "err-1").write_text("bad" if k == 104 else "")
    cli.main(["parse", "find-errs", str(tmp_path)], spark)
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "parent\terrored" and len(lines) == 106 and lines == [lines[0], *sorted(lines[1:])]
    assert [x for x in lines if x.endswith("\tTrue")] == [lines[-1]] and "job104" in lines[-1]


def test_frames_without_a_usable_mean_count(spark):
    nan, rows = float("nan"), []
    rows += [("a", "white", 10.0, 0.0, 0.0), ("a", "white", 12.0, 0.0, None), ("a", "white", nan, 0.0, 0.0), ("a", "white", -1e301, None, 3.0), ("a", "dark", None, 0.0, 0.0)]
    rows += [("b", "white", float("inf"), 0.0, 0.0), ("b", "dark", nan, 0.0, 0.0)]
    stats = spark.createDataFrame(rows, "source_file string, type string, mean double, i0_move_x double, i0_move_y double")
    got = {tuple(r) for r in metadata.file_report(stats).collect()}
    assert got == {("a", 4, 1, 2 / 11, False), ("b", 1, 1, None, True)}


@needs_data
def test_report_counts_every_frame(spark):
    for name, frames in (("white", "whites"), ("dark", "darks")):
        want = spark.read.parquet(f"{SF}/frame_manifest.parquet").where(f"type = '{name}'").count()
        assert entry.queries()["reference_report"](spark, SF).agg({frames: "sum"}).first()[0] == want


@needs_data
@pytest.mark.skipif(not os.path.isdir(LONGER), reason="no test data")
def test_every_block_has_an_id_of_its_own(spark):
    def code(at, grid):
        out = k = 0
        for bit in range(max(grid).bit_length()):
            for a, n in zip(at, grid):
                if n - 1 >> bit:
                    out |= (a >> bit & 1) << k
                    k += 1
        return out

    got = {(r.bx, r.by, r.bz): (r.id, r.shard) for r in entry.queries()["shard_ids"](spark, LONGER).collect()}
    want = {at: code(at, (3, 3, 25)) for at in np.ndindex(3, 3, 25)}
    assert got == {at: (i, i >> 4) for at, i in want.items()} and len({i for i, _ in got.values()}) == 225


@needs_data
@pytest.mark.skipif(not os.path.isdir(LONGER), reason="no test data")
def test_ranges_of_planes_make_up_the_whole(spark):
    got, want = (sorted(map(tuple, entry.queries()[q](spark, LONGER).select("z", "y", "x", "v").collect())) for q in ("mip_z_ranges", "mip_z"))
    assert got == want and len(got) == 9800
