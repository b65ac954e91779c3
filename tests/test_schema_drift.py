import json
import random
from datetime import datetime, timedelta

from volspark.operators import schema_drift as sd

SCHEMA = "conf_id bigint, sample_id string, project string, written_at timestamp, body string, _pos int, fields string"


def flat(x, prefix=""):
    out = {}
    for k, v in x.items():
        p = f"{prefix}.{k}" if prefix else k
        if isinstance(v, dict) and v:
            out |= flat(v, p)
        else:
            out[p] = v
    return out


def kind(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def brute(rows):
    by = {}
    for cid, sample, _, at, body, *_ in rows:
        try:
            x = json.loads(body)
        except (TypeError, ValueError):
            continue
        if isinstance(x, dict) and sample is not None:
            by.setdefault(sample, []).append((at, cid, flat(x)))
    out = set()
    for files in by.values():
        files.sort(key=lambda f: (f[0], f[1]))
        for (_, _, a), (_, cid, b) in zip(files, files[1:]):
            same = lambda x, y: kind(x) == kind(y) and x == y and x is not None and x != ""
            gone, come = a.keys() - b.keys(), b.keys() - a.keys()
            out |= {(cid, p, "renamed" if any(same(a[p], b[q]) for q in come) else "removed") for p in gone}
            out |= {(cid, q, "added") for q in come if not any(same(a[p], b[q]) for p in gone)}
            out |= {(cid, p, "type_changed") for p in a.keys() & b.keys() if kind(a[p]) != kind(b[p]) and None not in (a[p], b[p])}
    return out


def rows_of(n=250):
    random.seed(4)
    values = [None, "", "x", "y", True, False, 1, 1.0, 2.5, [], [1], ["", {}], {}, "1", 10**25, "é\n"]
    out = []
    for i in range(n):
        body = {s: {random.choice("abcdef"): random.choice(values) for _ in range(3)} for s in ("storage", "scan")} | {random.choice("pq"): random.choice(values)}
        text = random.choice([json.dumps(body)] * 8 + [None, "", "[1]", "{", "3", '{"a": NaN'])
        out.append((i, random.choice(["hot"] * 6 + ["s", "t", None]), "p", datetime(2020, 1, 1) + timedelta(hours=random.randrange(40)), text, 1, "x"))
    return out


def test_every_change(spark):
    rows = rows_of()
    maps = sd.drift_tables(spark.createDataFrame(rows, SCHEMA))
    got = sd.changes(maps).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(set(got)) > 300


def test_leaves_of_odd_bodies():
    assert sd.leaves('{"a": {"b": {}}, "c": [1, {"d": 2.0}], "e": 1e400, "a": {"x": null}}') == {"a.x": ("null", None), "c": ("array", '[1,{"d":2}]'), "e": ("number", "1E+400")}
    assert sd.leaves("{}") == {} and sd.leaves('{"a": NaN}') is None and sd.leaves("[" * 100_000) is None and sd.leaves(None) is None
    assert sd.leaves('{"a": 1.0, "b": 1, "c": "1"}') == {"a": ("number", "1"), "b": ("number", "1"), "c": ("string", "1")}
    assert sd.leaves('{"a": "\\ud800"}') == {"a": ("string", "?")}


def test_one_table_and_failed_casts(spark):
    at = datetime(2020, 1, 1)
    # storage.inner became storage.inner_comment in three samples; scan.a and scan.b exchange a value once only; x and y stand together
    rows = []
    for k in range(3):
        rows += [
            (10 * k, f"s{k}", "p", at, json.dumps({"storage": {"inner": f"t{k}", "has_scan": True, "a": 7 + k}, "scan": {"energy": 30 + k, "x": f"u{k}", "y": f"v{k}"}}), 1, "x"),
            (10 * k + 1, f"s{k}", "p", at + timedelta(1), json.dumps({"storage": {"inner_comment": f"t{k}", "has_scan": False, "a": 1}, "scan": {"energy": 30.5, "x": "q", "y": f"u{k}"}}), 1, "x"),
            (10 * k + 2, f"s{k}", "p", at + timedelta(2), json.dumps({"storage": {"inner_comment": f"w{k}", "has_scan": "maybe" if k == 0 else True}, "scan": {"energy": "30kV" if k == 1 else 2}}), 1, "x"),
        ]
    rows += [(40, "t", "p", at, "broken", 1, "x"), (41, "t", "p", at, None, 1, "x")]
    maps = sd.drift_tables(spark.createDataFrame(rows, SCHEMA))
    columns = sd.resolved_columns(maps)
    assert {n: (k, ps) for n, k, ps in columns} == {
        "storage_inner_comment": ("string", ["storage.inner_comment", "storage.inner"]), "storage_has_scan": ("boolean", ["storage.has_scan"]), "storage_a": ("double", ["storage.a"]),
        "scan_energy": ("double", ["scan.energy"]), "scan_x": ("string", ["scan.x"]), "scan_y": ("string", ["scan.y"]),
    }
    out = {r.conf_id: r for r in sd.project_fields(maps, columns).collect()}
    assert out[0].storage_inner_comment == "t0" and out[1].storage_inner_comment == "t0" and out[2].failed_casts == ["storage_has_scan"] and out[12].failed_casts == ["scan_energy"]
    assert out[12].scan_energy is None and [tuple(x) for x in out[12]["rest"]] == [("scan.energy", "string", "30kV")] and out[0].readable
    assert not out[40].readable and not out[41].readable and out[40].scan_energy is None and len(out) == len(rows)
    stats = {(r.path, r.type): r.files for r in sd.path_statistics(maps, []).collect()}
    assert stats[("scan.energy", "string")] == 1 and stats[("scan.energy", "number")] == 8


def test_values_that_many_fields_share_link_none(spark):
    at = datetime(2020, 1, 1)
    rows = [(i, "s", "p", at + timedelta(i), json.dumps({"a": True, "b": True} if i % 2 else {"c": True, "d": 5}), 1, "x") for i in range(8)]
    maps = sd.drift_tables(spark.createDataFrame(rows, SCHEMA))
    assert sd.rename_links(maps).count() == 0 and [ps for _, _, ps in sd.resolved_columns(maps)] == [["a"], ["b"], ["c"], ["d"]]


def test_empty(spark):
    maps = sd.drift_tables(spark.createDataFrame([], SCHEMA))
    assert sd.resolved_columns(maps) == [] and sd.changes(maps).count() == sd.project_fields(maps, []).count() == 0
