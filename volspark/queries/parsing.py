"""Queries of literals, addresses, file metadata, nodes, validation and small numeric steps, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import views
from ..functions import text as X
from ..operators import admin as A
from ..operators import flats, metadata
from ..operators import layers as Y
from ..operators import volume as V
from ..session import load
from ..sources import sharded
from .volume import _V, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part")


def _text(*parts: str) -> Column:
    return F.concat(*[F.lit(p) if not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts])


# literals ----------------------------------------------------------------------------------------------------------
@query("select p_partkey, p_name as name, case when p_size % 2 = 0 then p_size else -1 end as intensity, -1 as radius from part")
def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("p_size") % 2 == 0, _text("$p_name", ":", "$p_size", ":")).otherwise(F.col("p_name"))
    return _part(spark, sf_dir).select("p_partkey", X.record(t, [("name", "string", ""), ("intensity", "int", -1), ("radius", "int", -1)]).alias("r")).select("p_partkey", "r.*")


@query("select p_partkey, case when p_size % 2 = 0 then 0 else p_size end as start, case when p_size % 2 = 0 then p_size else p_size + 9 end as stop, case when p_size % 2 = 0 then 1 else 3 end as step from part")
def parse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir).withColumn("e", F.col("p_size") + 9)
    t = F.when(F.col("p_size") % 2 == 0, _text("$p_size")).otherwise(_text("$p_size", ",", "$e", ",3"))
    return p.select("p_partkey", X.number_range(t).alias("r")).select("p_partkey", "r.*")


@query("select p_partkey, case when p_size % 2 = 0 then p_size else 0.25 end as first, case when p_size % 2 = 0 then 2.0 else 0.25 end as last, p_size % 2 = 0 as voxels from part")
def parse_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("p_size") % 2 == 0, _text("$p_size", ",2")).otherwise(F.lit("0.25"))
    return _part(spark, sf_dir).select("p_partkey", X.crop_pair(t).alias("r")).select("p_partkey", "r.*")


@query("select p_partkey, case when p_size % 3 <> 2 then [p_size, 2, 3] end as triple, list_sort(list_distinct([p_size % 4, 2, 1, 2])) as mips, case when p_size % 2 = 0 then ['uint8', 'int16'] end as types from part")
def parse_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir).withColumn("m", F.col("p_size") % 4)
    triple = F.when(F.col("p_size") % 3 == 0, _text("$p_size", "x2x3")).when(F.col("p_size") % 3 == 1, _text("$p_size", ",2,3")).otherwise(_text("$p_size", ",2"))
    types = F.when(F.col("p_size") % 2 == 0, F.lit("uint8, int16,uint8")).otherwise(F.lit("uint8,word"))
    return p.select("p_partkey", X.triple(triple).alias("triple"), X.mip_list(_text("$m", ",2,1, 2")).alias("mips"), X.type_list(types, ["uint8", "int16", "uint16"]).alias("types"))


@query("select p_partkey, p_size as start, p_size + 5 as stop, cast(null as int) as step, p_brand as brand, 'b=c' as other from part")
def parse_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir).withColumn("e", F.col("p_size") + 5)
    rows = p.select("p_partkey", X.slices(_text("[", "$p_size", ":", "$e", "]"))[0].alias("s"), X.option_map(_text("brand=old,x=b=c,brand=", "$p_brand")).alias("m"))
    return rows.select("p_partkey", "s.*", F.col("m")["brand"].alias("brand"), F.col("m")["x"].alias("other"))


@query("select p_partkey, '#' || lpad(cast(p_partkey % 1000 as varchar), 3, '0') as color, true as good, false as bad, 'Flats ' || upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) as status from part")
def names_and_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir).withColumn("c", F.concat(F.lit("#"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")))
    word = F.upper(F.substring_index("p_name", " ", 1))
    return p.select("p_partkey", F.col("c").alias("color"), X.is_color(F.col("c")).alias("good"), X.is_color(F.concat("c", F.lit("0x"))).alias("bad"), X.status_text(F.concat(F.lit("FLATS_"), word)).alias("status"))


@query("select p_partkey, 'scan_' || case when length(p_partkey::varchar) >= 3 then p_partkey::varchar else lpad(p_partkey::varchar, 3, '0') end || '.tif' as padded, 'scan_' || p_size as grp from part")
def padded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", X.padded_name(_text("scan_", "$p_partkey", ".tif"), 3).alias("padded"), X.flat_key(_text("scan_", "$p_size", "_", "$p_partkey")).alias("grp"))


@query(
    "select p_partkey, 'b' || p_size as bucket, 'k/' || p_partkey as key, 'http://h:80/' || p_partkey || '/info' as endpoint, 'http://[::1]:80/' || p_partkey as shown, '/d/' || p_partkey as path, '/d/.' || p_partkey || '.queue' as queue, "
    "'a/' || p_size || '/z' as joined from part"
)
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s3 = X.bucket_and_key(_text("precomputed://s3://b", "$p_size", "/k/", "$p_partkey"))
    local = _text("precomputed://file:///d/", "$p_partkey")
    return _part(spark, sf_dir).select(
        "p_partkey", s3["bucket"].alias("bucket"), s3["key"].alias("key"), X.endpoint(_text("http://h:80/", "$p_partkey", "//"), F.lit("/info")).alias("endpoint"), X.advertised(_text("http://0.0.0.0:80/", "$p_partkey"), "::1").alias("shown"),
        X.local_path(local).alias("path"), X.queue_root(local).alias("queue"), X.join_key(F.lit("/a/"), F.lit(""), _text("$p_size"), F.lit("z")).alias("joined"),
    )


@query("select p_partkey, case when b >= 1048576 then format('{:.2f} MiB', b / 1048576.0) when b >= 1024 then format('{:.2f} KiB', b / 1024.0) else b || ' B' end as shown from (select p_partkey, p_partkey * p_size * 64 as b from part)")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", X.human_bytes(F.col("p_partkey") * F.col("p_size") * 64).alias("shown"))


@query("select p_partkey, p_size::varchar as n, '/base/' || p_brand as input from part")
def script_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = F.concat(F.lit("#!/bin/sh\nroot=/base\nrun --n=1 --in=$root/"), F.col("p_brand"), F.lit(" --n="), F.col("p_size").cast("string"))
    m = metadata.script_options(script)
    return _part(spark, sf_dir).select("p_partkey", m["n"].alias("n"), m["in"].alias("input"))


# metadata ----------------------------------------------------------------------------------------------------------
_N = (
    "n as (select 'f' || (p_partkey % 40) as file, case when p_partkey % 7 = 0 then 'exchange/data' else 'g' || (p_partkey % 5) || '/' || p_partkey || '/data' end as path, "
    "case when p_partkey % 7 = 0 then 'exchange' else 'g' || (p_partkey % 5) end as parent, case when p_size % 4 = 1 then [p_size] when p_size % 4 = 2 then [p_size, 2] when p_size % 4 = 3 then [p_size, 2, 3] else [2, p_size, 3, 4] end as shape, p_partkey as visit from part)"
)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    main = k % 7 == 0
    group = F.concat(F.lit("g"), (k % 5).cast("string"))
    shape = F.when(s % 4 == 1, F.array(s)).when(s % 4 == 2, F.array(s, F.lit(2))).when(s % 4 == 3, F.array(s, F.lit(2), F.lit(3))).otherwise(F.array(F.lit(2), s, F.lit(3), F.lit(4)))
    return _part(spark, sf_dir).select(
        F.concat(F.lit("f"), (k % 40).cast("string")).alias("file"), F.when(main, "exchange/data").otherwise(F.concat(group, F.lit("/"), k.cast("string"), F.lit("/data"))).alias("path"), F.when(main, "exchange").otherwise(group).alias("parent"),
        F.lit("dataset").alias("kind"), shape.cast("array<bigint>").alias("shape"), F.lit("uint16").alias("dtype"), F.lit("v").alias("value"), k.alias("visit"),
    )


@query(f"with {_N} select file, arg_min(path, (case when path = 'exchange/data' then 0 else 1 end, visit)) as path from n where len(shape) = 3 group by file")
def projection_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.projection_dataset(_nodes(spark, sf_dir))


@query(f"with {_N} select file, path, case when list_product(shape) <= 60 then 'v' end as value from n where path = 'g3' or starts_with(path, 'g3/')")
def h5_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.select_path(_nodes(spark, sf_dir), "/g3/", 60).select("file", "path", "value")


@query(f"with {_N}, k as (select *, count(*) over (partition by file, parent) as c, row_number() over (partition by file, parent order by visit) as r from n) select file, path, visit, case when c > 8 then c - 2 else 0 end as left_out from k where c <= 8 or r <= 2")
def h5_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.collapsed(_nodes(spark, sf_dir)).select("file", "path", "visit", "left_out")


@query(f"with {_N} select file, path, unnest(case when len(shape) = 4 then range(shape[1]) else [0] end) as lead from n where len(shape) >= 2")
def image_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.image_datasets(_nodes(spark, sf_dir))


@query(
    "with f as (select user_id as file, event_type as label, event_id as index, row_number() over (partition by user_id, event_type order by event_id) as k, count(*) over (partition by user_id, event_type) as c from events), "
    "s as (select user_id as file, event_type as label, ts as stamp, row_number() over (partition by user_id, event_type order by ts, event_id) as k, count(*) over (partition by user_id, event_type) as c from events where event_id % 50 <> 0) "
    "select f.file, f.label, f.index, case when f.c = s.c then s.stamp end as stamp from f left join s using (file, label, k)"
)
def timed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("label"), F.col("event_id").alias("index"), "ts")
    stamps = e.where("index % 50 <> 0").select("file", "label", F.struct("ts", "index").alias("ord"), F.col("ts").alias("stamp"))
    return metadata.timed_frames(e.drop("ts"), stamps)


@query("select 'k' || (o_orderkey % 40) as key, arg_max('v' || o_custkey, o_orderkey) as value from orders group by 1")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumn("m", F.col("o_orderkey") % 40)
    return metadata.merged_settings(o.select(F.col("o_orderkey").alias("ord"), F.create_map(_text("k", "$m"), _text("v", "$o_custkey")).alias("settings")))


# nodes and validation ----------------------------------------------------------------------------------------------
@query(
    "with n as (select 'n' || (o_orderkey % 900) as name, o_orderkey as ord, case o_orderstatus when 'O' then 'idle*' when 'F' then 'mix' else 'down' end as status, case when o_orderkey % 9 = 0 then 'sas' else 'main*' end as part from orders) "
    "select name, replace(status, '*', '') as status from n where status <> 'down' and part <> 'sas' qualify row_number() over (partition by name order by ord) = 1"
)
def eligible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumn("m", F.col("o_orderkey") % 900)
    status = F.when(F.col("o_orderstatus") == "O", "idle*").when(F.col("o_orderstatus") == "F", "mix").otherwise("down")
    nodes = o.select(_text("n", "$m").alias("name"), F.col("o_orderkey").alias("ord"), status.alias("status"), F.when(F.col("o_orderkey") % 9 == 0, "sas").otherwise("main*").alias("partition"))
    return A.eligible_nodes(nodes, mixed=True).withColumn("status", F.regexp_replace("status", r"\*$", ""))


@query("select 'n' || (o_orderkey % 900) as name, min(o_custkey % 3) as priority, arg_min(o_orderkey, o_custkey % 3 * 100000000 + o_orderkey) as ord from orders group by 1")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumn("m", F.col("o_orderkey") % 900)
    return A.merged_nodes(o.select((F.col("o_custkey") % 3).alias("priority"), F.col("o_orderkey").alias("ord"), _text("n", "$m").alias("name")))


#: Documents with faults that follow from a part's size; the same text in both dialects.
_DOC = (
    "'{' || case when p_size % 11 = 0 then '' else '\"num_channels\": ' || (p_size % 3) || ', ' end || '\"type\": \"' || case when p_size % 3 = 0 then 'mesh' else 'image' end || '\", \"data_type\": \"' || case when p_size % 4 = 0 then 'word' else 'uint8' end"
    " || '\", \"scales\": [{\"key\": \"' || case when p_size % 5 = 0 then '' else 'k' end || '\", \"encoding\": \"raw\", \"resolution\": [7, 7.5, 7], \"voxel_offset\": [0, 0' || case when p_size % 7 = 0 then '.5' else '' end || ', -1], \"size\": [' || (p_size % 6)"
    " || ', 1, 1], \"chunk_sizes\": [[1, 1, ' || (p_size % 2) || ']]}' || case when p_size % 8 = 0 then ', 3' else '' end || ']}'"
)


@query(
    "select p_partkey, list_filter([case when p_size % 11 = 0 then 'missing info field: num_channels' end, case when p_size % 3 = 0 then 'unsupported layer type: ''mesh''' end, case when p_size % 4 = 0 then 'invalid data_type: ''word''' end, "
    "case when p_size % 11 = 0 then 'invalid num_channels: None' when p_size % 3 = 0 then 'invalid num_channels: 0' end, case when p_size % 5 = 0 then 'mip 0: key must be a non-empty string' end, "
    "case when p_size % 7 = 0 then 'mip 0: voxel_offset entries must be integer' end, case when p_size % 6 = 0 then 'mip 0: size entries must be positive' end, case when p_size % 2 = 0 then 'mip 0: invalid chunk_sizes' end, "
    "case when p_size % 8 = 0 then 'mip 1: scale must be an object' end], lambda m: m is not null) as errors from part"
)
def info_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", A.info_errors(F.expr(_DOC)).alias("errors"))


@query(
    "select p_partkey, case when p_size % 4 = 0 then 'jpeg' when kind = 'image' then 'raw' when kind = 'segmentation' and source = 'raw' then 'compressed_segmentation' else source end as encoding from "
    "(select *, ['image', 'segmentation', 'other'][p_size % 3 + 1] as kind, ['raw', 'png'][p_partkey % 2 + 1] as source from part)"
)
def layer_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("image", "segmentation", "other"))), F.col("p_size") % 3)
    source = F.get(F.array(F.lit("raw"), F.lit("png")), (F.col("p_partkey") % 2).cast("int"))
    return _part(spark, sf_dir).select("p_partkey", X.layer_encoding(F.when(F.col("p_size") % 4 == 0, "jpeg").otherwise("auto"), kind, source).alias("encoding"))


@query(
    "with e as (select p_partkey as field, p_size as expected from part where p_partkey % 3 <> 0), a as (select p_partkey as field, case when p_partkey % 10 = 1 then null else p_size end as actual from part where p_partkey % 5 <> 0) "
    "select coalesce(e.field, a.field) as field, expected, actual from e full join a on e.field = a.field where expected is distinct from actual"
)
def field_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    expected = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("field"), F.col("p_size").alias("value"))
    actual = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("field"), F.when(F.col("p_partkey") % 10 != 1, F.col("p_size")).alias("value"))
    return A.field_differences(expected, actual)


@query("select p_partkey as ord, p_size as done, least(max(p_size) over (order by p_partkey), 45) as shown from part")
def progress_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tally(_part(spark, sf_dir).select(F.col("p_partkey").alias("ord"), F.col("p_size").alias("done")), 45)


@query(
    f"with {_V}, b as (select distinct x // 4 as i, y // 4 as j, z // 4 as k from v), "
    "c as (select *, cast((i & 1) + (j & 1) * 2 + (k & 1) * 4 + (i >> 1) * 8 + (j >> 1) * 16 + ((k >> 1) & 1) * 32 + (k >> 2) * 64 as bigint) as id from b) select i as bx, j as by, k as bz, id, id // 16 as shard from c"
)
def shard_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of the volume, 16 chunks a shard and 4 a minishard."""
    v = views.voxels(spark, sf_dir)
    grid = tuple(-(-n // 4) for n in reversed(V.shape(v)))
    at = lambda c: F.floor(F.col(c) / 4).cast("int")
    b = v.select(at("x").alias("bx"), at("y").alias("by"), at("z").alias("bz")).distinct()
    rows = b.withColumn("id", sharded.chunk_id(grid, F.col("bx"), F.col("by"), F.col("bz")))
    return rows.withColumn("shard", sharded.shard_of(F.col("id"), sharded.shard_bits(grid, 16, 4)))


# numbers -----------------------------------------------------------------------------------------------------------
@query("with e as (select vec_id // 20 as z, vec_id % 20 as y, p - 1 as x, cast(embedding[p] as double) as v from (select *, unnest(generate_series(1, len(embedding))) as p from embeddings)), m as (select z, median(v) as m from e where v > 0 group by z) select cast(z as int) as z, cast(y as int) as y, cast(x as int) as x, round(case when v > 0 then v else m end, 6) as v from e join m using (z)")
def clean_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flats.cleaned(views.signed_voxels(spark, sf_dir), "z").select("z", "y", "x", "v"))


@query(f"with {_V} select z, y, x, round(case when x = 0 then lead(v) over w - v when x = 9 then v - lag(v) over w else (lead(v) over w - lag(v) over w) / 2 end, 6) as g from v window w as (partition by z, y order by x)")
def row_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("z", "y").orderBy("x")
    v, a, b = F.col("v"), F.lag("v").over(w), F.lead("v").over(w)
    g = F.when(a.isNull(), b - v).when(b.isNull(), v - a).otherwise((b - a) / 2)
    return rounded(views.voxels(spark, sf_dir).select("z", "y", "x", g.alias("g")), "g")


@query("select c_custkey, '[' || c_nationkey || ']' as position, '\"n\"' as name, '\"4panel\"' as layout from customer")
def position_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    target = F.create_map(F.lit("name"), F.lit('"n"'), F.lit("position"), F.lit("[0]"), F.lit("layout"), F.lit('"4panel"'))
    source = F.create_map(F.lit("name"), F.lit('"other"'), F.lit("position"), F.concat(F.lit("["), F.col("c_nationkey").cast("string"), F.lit("]")))
    m = Y.copy_position(target, source)
    return c.select("c_custkey", m["position"].alias("position"), m["name"].alias("name"), m["layout"].alias("layout"))


@query("select p_partkey, p_partkey // 8 as start, p_size // 8 as stop from part")
def mip_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", F.shiftright("p_partkey", 3).alias("start"), F.shiftright("p_size", 3).alias("stop"))
