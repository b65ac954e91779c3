"""Files whose fields come, go and change type, read into one table, with a report of every change.

Bodies become maps from path to (type, JSON text): enumerating the leaves of an object of unknown depth is the one step that
built-in functions lack, so it runs in Python over Arrow batches. Everything else is declared on those maps.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .ordering import with_positions

LEAF = T.MapType(T.StringType(), T.StructType().add("type", T.StringType()).add("value", T.StringType()))
_ARROW = pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())]))


def _reject(word: str) -> None:
    raise ValueError(word)


def _canonical(x: object) -> str:
    """JSON with sorted keys and numbers in one form, so that equal values have equal texts and 1 is not "1"."""
    if isinstance(x, Decimal):
        return _leaf(x)[1] or ""
    if isinstance(x, list):
        return "[" + ",".join(map(_canonical, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_canonical(v)}" for k, v in sorted(x.items())) + "}"
    return json.dumps(x, ensure_ascii=False)


def _leaf(x: object) -> tuple[str, str | None]:
    """Type and value of a leaf; numbers that are equal have the same text."""
    if x is None:
        return "null", None
    if isinstance(x, bool):
        return "boolean", "true" if x else "false"
    if isinstance(x, Decimal):
        plain = x.normalize()
        return "number", format(plain, "f") if -30 < plain.adjusted() < 40 else str(plain)
    if isinstance(x, str):
        return "string", x
    return ("array" if isinstance(x, list) else "object"), _canonical(x)


def leaves(body: str | None) -> dict[str, tuple[str, str | None]] | None:
    """Leaves of a JSON object by path; None if the text is none. Arrays and empty objects are leaves. A key that occurs
    twice has its last value. Numbers keep all their digits."""
    if body is None:
        return None
    try:
        top = json.loads(body, parse_float=Decimal, parse_int=Decimal, parse_constant=_reject)
    except (ValueError, RecursionError, ArithmeticError):
        return None
    if not isinstance(top, dict):
        return None
    try:
        return _walk(top)
    except RecursionError:
        return None


def _walk(top: dict) -> dict[str, tuple[str, str | None]]:
    found: dict[str, tuple[str, str | None]] = {}
    todo = [("", top)]
    while todo:
        prefix, node = todo.pop()
        for k, v in node.items():
            path = f"{prefix}.{k}" if prefix else k
            if isinstance(v, dict) and v:
                todo.append((path, v))
            else:
                found[path] = _leaf(v)
    return {k.encode("utf-8", "replace").decode(): (t, v if v is None else v.encode("utf-8", "replace").decode()) for k, (t, v) in found.items()}


def path_maps(files: DataFrame, body: str = "body") -> DataFrame:
    """All columns but the body, and `fields`: the map of its leaves, null for a body that is null or no JSON object."""
    keep = [f for f in files.schema if f.name not in (body, "fields")]
    out = T.StructType([*keep, T.StructField("fields", LEAF)])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [None if (m := leaves(t)) is None else [(k, {"type": x[0], "value": x[1]}) for k, x in m.items()] for t in b.column(body).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(maps, _ARROW)], names=[*names, "fields"])

    return files.select(*names, body).mapInArrow(run, out)


def path_statistics(maps: DataFrame, by: list[str]) -> DataFrame:
    """(by..., path, type, files, first_file, last_file): how often each path has each type."""
    leaf = maps.where("fields is not null").select(*by, "conf_id", F.explode("fields").alias("path", "leaf"))
    return leaf.groupBy(*by, "path", F.col("leaf.type").alias("type")).agg(F.count(F.lit(1)).alias("files"), F.min("conf_id").alias("first_file"), F.max("conf_id").alias("last_file"))


def _pairs(maps: DataFrame, group: str, order: tuple[str, ...]) -> DataFrame:
    """(conf_id, _old, _new): the fields of each readable file and of the one before it in its group.

    Files of a group are neighbours in one sorted order of all files, and meet their neighbour by an equi-join on their positions, so a group
    may be as large as it will.
    """
    rows = with_positions(maps.where(f"fields is not null and {group} is not null").select(group, *order, "fields"), [group, *order])
    before = rows.select((F.col("_pos") + 1).alias("_pos"), F.col(group).alias("_g"), F.col("fields").alias("_old"))
    return rows.join(before, "_pos").where(F.col("_g") == F.col(group)).select("conf_id", "_old", F.col("fields").alias("_new"))


def _only(here: str, there: str) -> Column:
    return F.filter(F.map_entries(here), lambda e: ~F.array_contains(F.map_keys(there), e["key"]))


def _telling(e: Column) -> Column:
    """Whether a value says that two fields are one: neither null nor empty."""
    return e["value"]["value"].isNotNull() & (e["value"]["value"] != "") & (e["value"]["type"] != "null")


def rename_links(maps: DataFrame, group: str = "sample_id", order: tuple[str, ...] = ("written_at", "conf_id")) -> DataFrame:
    """(old, new, files): how often one path took over the value of another from a file to the next, where both were the only ones with that value."""
    entry = lambda side: F.explode(F.transform(F.filter(_only(*side), _telling), lambda e: F.struct(e["key"].alias("path"), e["value"]["type"].alias("t"), e["value"]["value"].alias("v"))))
    pairs = _pairs(maps, group, order)
    sides = [pairs.select("conf_id", entry(side).alias("e"), F.lit(k).alias("side")) for k, side in enumerate((("_old", "_new"), ("_new", "_old")))]
    met = sides[0].unionByName(sides[1]).groupBy("conf_id", "e.t", "e.v").agg(*[x for k in (0, 1) for x in (F.count(F.when(F.col("side") == k, 1)).alias(f"n{k}"), F.max(F.when(F.col("side") == k, F.col("e.path"))).alias(f"p{k}"))])
    return met.where("n0 = 1 and n1 = 1").groupBy(F.col("p0").alias("old"), F.col("p1").alias("new")).agg(F.count(F.lit(1)).alias("files"))


def _together(maps: DataFrame, paths: list[str]) -> DataFrame:
    """(a, b, files): paths of the list, a before b, that stand in one file."""
    there = F.array_sort(F.filter(F.map_keys("fields"), lambda k: k.isin(*paths)))
    found = maps.where("fields is not null").select(F.posexplode(there).alias("i", "a"), there.alias("k")).select("a", F.explode(F.slice("k", F.col("i") + 2, F.size("k"))).alias("b"))
    return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("files"))


KEYS = ("conf_id", "sample_id", "written_at")
#: Paths and links between them of which the driver decides, the most frequent first; what is beyond stays in `rest`.
MOST_PATHS, MOST_LINKS = 10_000, 2_000


def resolved_columns(maps: DataFrame, most: int = 200, least_links: int = 2, apart: tuple[str, ...] = ()) -> list[tuple[str, str, list[str]]]:
    """(name, type, paths): the columns of the one table, decided by the statistics of all files.

    Paths are one field if one took over the other's value from a file to the next at least `least_links` times, the most frequent links first, or if their last
    names are the same but for case and signs; but only if such a field's paths stand in one file in less than a hundredth of the files of the rarer one,
    and if it has no two of the paths `apart`, which the caller knows to be different fields. A field is called after its most frequent path, and has
    the type of most of its values; others are failed casts. Statistics come to the driver for the MOST_PATHS most frequent pairs of path and type;
    the `most` most frequent fields get columns.
    """
    stats = path_statistics(maps, []).select("path", "type", "files").orderBy(F.desc("files"), "path", "type").limit(MOST_PATHS).collect()
    kinds: dict[str, dict[str, int]] = {}
    for path, kind, files in stats:
        kinds.setdefault(path, {})[kind] = files
    count = {p: sum(k.values()) for p, k in kinds.items()}
    links: dict[tuple[str, str], int] = {}
    for old, new, files in rename_links(maps).orderBy(F.desc("files"), "old", "new").limit(MOST_LINKS).collect():
        if old in count and new in count:
            links[tuple(sorted((old, new)))] = links.get(tuple(sorted((old, new))), 0) + files
    links = {k: n for k, n in links.items() if n >= least_links}
    alike: dict[str, str] = {}
    for p in sorted(count, key=lambda p: (-count[p], p)):  # each spelling is linked to the most frequent one
        first = alike.setdefault(re.sub(r"[\W_]", "", p.rpartition(".")[2]).lower(), p)
        if first != p:
            links.setdefault(tuple(sorted((first, p))), 0)
    linked = sorted({p for pair in links for p in pair})
    both = {(a, b): n for a, b, n in _together(maps, linked).collect()} if linked else {}
    field = {p: [p] for p in count}  # path to the paths of its field
    for (a, b), _ in sorted(links.items(), key=lambda x: (-x[1], x[0])):
        one, other = field[a], field[b]
        free = len(set(one + other) & set(apart)) < 2 and all(100 * both.get(tuple(sorted((p, q))), 0) < min(count[p], count[q]) for p in one for q in other)
        if one is not other and free:
            for p in other:
                field[p] = one
            one += other
    fields = {id(ps): sorted(ps, key=lambda p: (-count[p], p)) for ps in field.values()}.values()
    chosen = sorted(fields, key=lambda ps: (-sum(count[p] for p in ps), ps[0]))[:most]
    columns, taken = [], {*KEYS, "fields", "failed_casts", "rest", "readable"}
    for paths in sorted(chosen):
        name = base = re.sub(r"\W", "_", paths[0]).lower() or "_"
        k = 1
        while name in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name)
        total: dict[str, int] = {}
        for p in paths:
            for kind, n in kinds[p].items():
                total[kind] = total.get(kind, 0) + n
        total.pop("null", None)
        kind = max(total, key=lambda k: (total[k], k)) if total else "string"
        columns.append((name, {"number": "double", "boolean": "boolean"}.get(kind, "string"), paths))
    return columns


def project_fields(maps: DataFrame, columns: list[tuple[str, str, list[str]]]) -> DataFrame:
    """One row for each file with fixed typed columns, `readable`, `failed_casts`: the columns whose text didn't become the type, and `rest`:
    (path, type, value) of every leaf that no column carries, by path. A file that is no JSON object has nulls and is not readable.

    A column takes the first of its paths that is there and not null. The others of its paths, texts that didn't become the type, numbers of
    more digits than a double keeps, nulls and paths of no column are in `rest`, so no leaf is lost.
    """
    rows = maps.withColumn("readable", F.col("fields").isNotNull())
    there = lambda p: F.try_element_at("fields", p)["value"].isNotNull()
    rows = rows.withColumns({f"_p_{n}": F.get(F.filter(F.array(*[F.lit(p) for p in paths]), there), 0) for n, _, paths in columns})
    rows = rows.withColumns({f"_t_{n}": F.try_element_at("fields", F.col(f"_p_{n}"))["value"] for n, _, _ in columns})
    rows = rows.withColumns({f"_c_{n}": F.col(f"_t_{n}").try_cast(kind) for n, kind, _ in columns})
    failed = F.array_compact(F.array(*[F.when(F.col(f"_t_{n}").isNotNull() & F.col(f"_c_{n}").isNull(), F.lit(n)) for n, _, _ in columns]))
    whole = lambda n, kind: F.col(f"_c_{n}").isNotNull() & ((F.length(f"_t_{n}") <= 15) if kind == "double" else F.lit(True))
    rows = rows.withColumn("_carried", F.array_compact(F.array(*[F.when(whole(n, kind), F.col(f"_p_{n}")) for n, kind, _ in columns])))
    left = F.filter(F.map_entries("fields"), lambda e: ~F.array_contains("_carried", e["key"]))
    rest = F.array_sort(F.transform(left, lambda e: F.struct(e["key"].alias("path"), e["value"]["type"].alias("type"), e["value"]["value"].alias("value"))))
    return rows.select(*KEYS, "readable", *[F.col(f"_c_{n}").alias(n) for n, _, _ in columns], failed.alias("failed_casts"), rest.alias("rest"))


def changes(maps: DataFrame, group: str = "sample_id", order: tuple[str, ...] = ("written_at", "conf_id")) -> DataFrame:
    """(conf_id, field, change): every difference between a readable file and the one before it in its group.

    `renamed` pairs a field that vanished with one that appeared with the same type and value, neither null nor empty; `removed`, `added`
    and `type_changed` are the others. Rows with a null group form none; a null time is the earliest.
    """
    pairs = _pairs(maps, group, order)
    as_text = lambda e: F.struct(e["value"]["type"].alias("t"), e["value"]["value"].alias("v"))
    texts = lambda es: F.transform(F.filter(es, _telling), as_text)
    rows = pairs.withColumns({"_gone": _only("_old", "_new"), "_come": _only("_new", "_old")})
    rows = rows.withColumns({"_gv": texts(F.col("_gone")), "_cv": texts(F.col("_come"))})
    moved = lambda e, others: _telling(e) & F.array_contains(F.col(others), as_text(e))
    found = lambda es, change: F.transform(es, lambda e: F.struct(e["key"].alias("field"), F.lit(change).alias("change")))
    kept = F.filter(
        F.transform(F.map_entries("_new"), lambda e: F.struct(e["key"].alias("key"), e["value"]["type"].alias("now"), F.try_element_at("_old", e["key"])["type"].alias("was"))),
        lambda e: e["was"].isNotNull() & (e["was"] != e["now"]) & (e["was"] != "null") & (e["now"] != "null"),
    )
    all_ = F.concat(
        found(F.filter("_gone", lambda e: moved(e, "_cv")), "renamed"),
        found(F.filter("_gone", lambda e: ~moved(e, "_cv")), "removed"),
        found(F.filter("_come", lambda e: ~moved(e, "_gv")), "added"),
        F.transform(kept, lambda e: F.struct(e["key"].alias("field"), F.lit("type_changed").alias("change"))),
    )
    return rows.select("conf_id", F.explode(all_).alias("x")).select("conf_id", "x.field", "x.change")


def drift_tables(files: DataFrame) -> DataFrame:
    """The maps as a table in the shared folder, for several reports of one reading."""
    return written(path_maps(files.select("conf_id", "sample_id", "written_at", "body")), "maps")
