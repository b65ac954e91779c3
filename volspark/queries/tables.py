"""Queries of layer, point, file, name and planning operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import text as X
from ..operators import admin as A
from ..operators import layers as Y
from ..session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}

_L = (
    "l as (select r_name as doc, n_name as name, cast(n_nationkey as bigint) as ord, ['image', 'segmentation', 'annotation'][n_nationkey % 3 + 1] as type, "
    "case when n_nationkey % 2 = 0 then 'bucket/' || n_name || '|' || r_name else 'precomputed://' || n_name end as source from nation join region on n_regionkey = r_regionkey)"
)
_P = "p as (select cast(c_nationkey as bigint) as layer, c_custkey as ord, cast(c_custkey % 97 as double) as px, cast(c_nationkey as double) as py, c_acctbal as pz from customer)"
_F = "f as (select 'job' || o_custkey as parent, 'err-' || o_orderkey as name, case when o_orderpriority like '1%' and o_orderstatus = 'P' then cast(floor(o_totalprice) as bigint) else 0 end as size, o_orderkey as file_id from orders)"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# layers ------------------------------------------------------------------------------------------------------------
@query(
    f"with {_L} select *, 0 as part from l where doc = 'ASIA' union all select *, 1 from l where doc <> 'ASIA' and type = 'image' and name not in (select name from l where doc = 'ASIA')"
)
def layer_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = views.layers(spark, sf_dir)
    source = layers.where("doc <> 'ASIA' and type = 'image'")
    return Y.copy_layers(source, layers.where("doc = 'ASIA'"), [f"NATION_{k}" for k in range(25)], strict=False)


_ASK = ["NATION_7", "NATION_3", "NOWHERE", "NATION_11"]


@query(f"with {_L} select cast(a.pos as int) as pos, a.name, l.source from (select unnest(range(4)) as pos, unnest({_ASK}) as name) a left join l using (name)")
def layer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.extract_layers(views.layers(spark, sf_dir), _ASK)


@query(
    f"with {_L} select doc, ord, type, source, case name when 'NATION_1' then 'NATION_1 ID13107r30' when 'NATION_2' then 'NATION_2 ID26214r9' when 'NATION_4' then 'NATION_4 ID39321r30' else name end as name from l"
)
def layer_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Y.tag_plan(["NATION_1", "NATION_2", "NATION_4"], [-1, 26214, -1], [-1, 9, -1])
    return Y.tag_layers(views.layers(spark, sf_dir), plan)


@query("select cast(c_custkey as bigint) as id, case when c_custkey % 5 = 0 then '#' || lpad(cast(c_custkey % 1000 as varchar), 6, '0') else 'ffffff' end as color from customer")
def layer_recolor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    new = c.where("id % 5 = 0").withColumn("color", F.concat(F.lit("#"), F.lpad((F.col("id") % 1000).cast("string"), 6, "0")))
    bad = c.where("id % 5 = 1").withColumn("color", F.lit("nocolour"))
    return Y.recolor(c.withColumn("color", F.lit("ffffff")), new.unionByName(bad))


@query(f"with {_L} select doc, name, ord, type, case when type in ('image', 'segmentation') and contains(source, '|') then 'precomputed://' || split_part(source, '|', 1) else source end as source from l")
def layer_urlshift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.url_shift(views.layers(spark, sf_dir))


@query(
    f"with {_P} select 0 as pos, row_number() over (order by ord) as ord, px, py, pz from p where layer = 3 union all select 1, row_number() over (order by ord desc), px, py, pz from p where layer = 5"
)
def point_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.merge_points(views.points(spark, sf_dir), [(3, False), (5, True)])


@query(f"with {_P} select layer, row_number() over (partition by layer order by px, ord) - 1 as ord, px, py, pz from p")
def point_sort_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.sort_points(views.points(spark, sf_dir), "px")


@query(f"with {_P} select layer, row_number() over (partition by layer order by px desc, ord desc) - 1 as ord, px, py, pz from p")
def point_sort_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.sort_points(views.points(spark, sf_dir), "px", backward=True)


@query(f"with {_P} select layer, ord, px + 1.5 as px, py - 2 as py, pz + 0.25 as pz from p")
def point_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.shift_points(views.points(spark, sf_dir), (1.5, -2.0, 0.25))


# files -------------------------------------------------------------------------------------------------------------
@query(f"with {_F} select parent, bool_or(size > 0) as errored from f where name like 'err%' group by parent")
def find_errs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.classify_errors(views.files(spark, sf_dir))


@query(f"with {_F} select parent, name, size from f where size > 93 and not regexp_matches(name, '77|13|99')")
def scanlog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scan_logs(views.files(spark, sf_dir), ["77", "13", "99"]).select("parent", "name", "size")


@query("select 'job' || c_custkey || '/history' as path from customer where c_custkey not in (select o_custkey from orders where o_orderpriority like '1%' and o_orderstatus = 'P' and o_totalprice >= 1)")
def prune_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = load(spark, sf_dir, "customer").select(F.concat(F.lit("job"), F.col("c_custkey").cast("string"), F.lit("/history")).alias("path"))
    return A.empty_directories(dirs, views.files(spark, sf_dir).where("size > 0").withColumn("parent", F.concat("parent", F.lit("/history"))))


_SYNC = (
    f"with {_F}, s as (select name as key, size, case when file_id % 3 <> 0 and file_id % 5 <> 0 and file_id % 7 <> 0 then 'skipped' else 'planned' end as status from f) "
)


def _sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir)
    local = f.select(F.col("name").alias("key"), "size", (F.col("file_id") * 10).alias("mtime_ns"), "file_id")
    changed = F.when(F.col("file_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size"))
    lost = F.when(F.col("file_id") % 7 != 0, F.col("mtime_ns").cast("string"))
    remote = local.where("file_id % 3 <> 0").select("key", changed.alias("size"), F.col("size").cast("string").alias("meta_size"), lost.alias("meta_mtime_ns"))
    return A.sync_plan(local, remote)


@query(_SYNC + "select * from s")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync(spark, sf_dir)


@query(_SYNC + ", k as (select unnest(['planned', 'skipped', 'uploaded']) as status) select k.status, count(s.key) as object_count, cast(coalesce(sum(s.size), 0) as bigint) as byte_count from k left join s using (status) group by 1")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sync_summary(_sync(spark, sf_dir))


@query(
    "with p as (select 's' || o_custkey as sample, o_orderkey as step, 'old/' || (o_orderkey % 50) as old, 'new/' || (o_orderkey % 70) as new from orders), e as (select 'old/' || i as path from range(0, 50, 2) t(i) union all select 'new/' || i from range(0, 70, 3) t(i)), "
    "a as (select *, case when old not in (select path from e) then 'keep' when new in (select path from e) then 'blocked' else 'move' end as action from p) "
    "select sample, step, old, new, action, bool_and(action <> 'blocked') over (partition by sample) as movable from a"
)
def path_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k = F.col("o_orderkey")
    paths = o.select(name("s", F.col("o_custkey")).alias("sample"), k.alias("step"), name("old/", k % 50).alias("old"), name("new/", k % 70).alias("new"))
    existing = spark.range(0, 50, 2).select(name("old/", F.col("id")).alias("path")).unionByName(spark.range(0, 70, 3).select(name("new/", F.col("id")).alias("path")))
    return A.path_moves(paths, existing)


@query(f"with {_F} select parent, sha256('[' || string_agg('[\"' || name || '\",' || size || ',' || file_id * 1000003 || ']', ',' order by name) || ']') as fingerprint from f group by parent")
def tree_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.file_fingerprints(views.files(spark, sf_dir).withColumn("mtime_ns", F.col("file_id") * 1000003))


@query(f"with {_F} select parent, min(file_id) as first, max(file_id) as last, max(file_id) - min(file_id) as span from f group by parent")
def time_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scan_times(views.files(spark, sf_dir))


@query(f"with {_F} select parent from f where name like 'err%' group by parent having not bool_or(size > 0)")
def clean_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir)
    bad = A.classify_errors(f).where("errored").select("parent")
    return f.where("name like 'err%'").select("parent").distinct().join(bad, "parent", "left_anti")


# names -------------------------------------------------------------------------------------------------------------
@query(
    f"with {_F} select parent, name, row_number() over (order by k) as place from (select parent, name, list_transform(regexp_extract_all(lower(parent || '/' || name), '[0-9]+|[^0-9]+'), "
    "lambda p: case when regexp_matches(p, '^[0-9]') then {'n': 0, 'v': cast(p as hugeint), 't': ''} else {'n': 1, 'v': 0::hugeint, 't': p} end) as k from f)"
)
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordering import with_positions

    f = views.files(spark, sf_dir).select("parent", "name", X.natural_key(F.concat_ws("/", "parent", "name")).alias("_key"))
    return with_positions(f, ["_key"]).select("parent", "name", (F.col("_pos") + 1).alias("place"))


@query("select p_partkey, regexp_replace(replace(trim('/' || p_name || '/' || p_type || ' (' || p_brand || ')/', '/'), '/', '__'), '[^A-Za-z0-9_.-]+', '_', 'g') as safe from part")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", X.safe_name(F.concat(F.lit("/"), "p_name", F.lit("/"), "p_type", F.lit(" ("), "p_brand", F.lit(")/"))).alias("safe"))


@query(f"with {_L} select name, case when contains(source, '|') then 'precomputed://' || split_part(source, '|', 1) else source end as address, regexp_replace(source, '^precomputed://', '') as path from l")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.layers(spark, sf_dir).select("name", X.layer_address(F.col("source")).alias("address"), X.cloud_path(F.col("source")).alias("path"))


@query("select p_partkey, substr(sha256('{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\"}'), 1, 16) as fingerprint from part")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", X.fingerprint(F.col("p_partkey"), F.col("p_name")).alias("fingerprint"))


@query("select event_id, strftime(make_timestamp((1700000000 + event_id) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(cast(event_id % 1000 as varchar), 9, '0') || 'Z' as iso from events")
def timestamp_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", X.iso_nanos(F.col("event_id") + 1700000000, F.col("event_id") % 1000).alias("iso"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("select p_partkey, 'recon_z' || case when length(p_partkey::varchar) >= 4 then p_partkey::varchar else lpad(p_partkey::varchar, 4, '0') end || '.tif' as name from part")
def slice_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", X.slice_name(F.lit("recon"), F.col("p_partkey"), 4).alias("name"))


@query("select p_partkey, cast(floor(cast(p_size || '.5' as decimal(20,6)) * 1048576) as bigint) as bytes from part")
def parse_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", X.byte_size(F.concat(F.col("p_size").cast("string"), F.lit(".5 MiB"))).alias("bytes"))


@query("select p_partkey, case when contains(p_name, 'red') then 'segmentation' else 'image' end as kind from part")
def layer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", X.layer_kind(F.replace("p_name", F.lit("red"), F.lit("Labels"))).alias("kind"))


# planning ----------------------------------------------------------------------------------------------------------
_PLAN = (
    "with b as (select p_partkey, p_size as edge, 2 as itemsize, cast(p_partkey % 1000 + 1 as bigint) * p_size * 50 * 2 as volume_bytes, cast(p_size as bigint) * p_size * p_size * 2 as chunk_bytes from part), "
    "c as (select *, case when volume_bytes <= 549755813888 then 2147483648 when volume_bytes <= 1099511627776 then 4294967296 else 8589934592 end as ceiling from b), "
    "d as (select *, cast(power(2, floor(log2(ceiling // chunk_bytes))) as bigint) as per_shard from c) "
)


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_size").alias("edge"), F.lit(2).alias("itemsize"), (F.col("p_partkey") % 1000 + 1).alias("sx"), F.col("p_size").alias("sy"), F.lit(50).alias("sz"))


@query(_PLAN + "select p_partkey, volume_bytes, chunk_bytes, ceiling, per_shard, per_shard * chunk_bytes as capacity from d")
def resource_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.plan_shards(_volumes(spark, sf_dir)).select("p_partkey", "volume_bytes", "chunk_bytes", "ceiling", "per_shard", "capacity")


@query(_PLAN + "select p_partkey, cast(greatest(1, least(32, 64, greatest(1, (135291469824 - 25769803776) // (per_shard * chunk_bytes * 2)))) as bigint) as shard_workers from d")
def worker_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.plan_shards(_volumes(spark, sf_dir))
    return rows.select("p_partkey", A.workers(F.lit(126 << 30), F.col("capacity"), F.lit(32), F.lit(64), 2).cast("bigint").alias("shard_workers"))


@query(
    "with s as (select p_partkey as scale, cast(ceil((p_partkey % 1000 + 1) / 7.0) * ceil(p_size / 5.0) * 10 as bigint) as expected from part), o as (select l_partkey as scale, count(*) as n from lineitem group by 1) "
    "select scale, expected, coalesce(n, 0) as found, expected = coalesce(n, 0) as complete from s left join o using (scale)"
)
def completeness_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    chunks = A.chunk_count([F.col("p_partkey") % 1000 + 1, F.col("p_size"), F.lit(50)], [F.lit(7), F.lit(5), F.lit(5)])
    scales = p.select(F.col("p_partkey").alias("scale"), F.lit(False).alias("raw"), F.lit(0).cast("bigint").alias("expected_bytes"), chunks.alias("expected_chunks"))
    return A.completeness(scales, load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("scale"), F.lit(1).alias("size")))


@query(
    "with r as (select user_id as dataset, event_type as stage, arg_max(case when value > 100 then 'complete' else 'failed' end, ts) as status, arg_max(event_id % 2, ts) as configuration from events group by all) "
    "select user_id as dataset, stage, case when stage = 'error' then 'omitted' when status = 'complete' and configuration = user_id % 2 then 'complete' else 'pending' end as decision "
    "from (select distinct user_id from events) u cross join (select distinct event_type as stage from events) t left join r on r.dataset = u.user_id and r.stage = t.stage".replace("t left join r on r.dataset = u.user_id and r.stage = t.stage", "t left join (select dataset, stage as rs, status, configuration from r) r on r.dataset = u.user_id and rs = t.stage")
)
def stage_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    records = e.select(F.col("user_id").alias("dataset"), F.col("event_type").alias("stage"), F.when(F.col("value") > 100, "complete").otherwise("failed").alias("status"), (F.col("event_id") % 2).alias("configuration"), "ts")
    stages = e.agg(F.collect_set("event_type").alias("stages"))  # one row
    wanted = e.select(F.col("user_id").alias("dataset")).distinct().crossJoin(F.broadcast(stages)).select("dataset", F.explode("stages").alias("stage"))
    wanted = wanted.withColumns({"selected": F.col("stage") != "error", "configuration": F.col("dataset") % 2, "artifact_ok": F.lit(True)})
    return A.stage_decisions(wanted, records)


@query(
    "select user_id as dataset, event_type as stage, max(value) as peak, arg_max(ts, (value, ts)) as peak_at, arg_max(event_id % 64, (value, ts)) as processes_at_peak, max(event_id % 64) as most_processes, round(min(500 - value), 4) as least_available, count(*) as samples from events group by all"
)
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("dataset"), F.col("event_type").alias("stage"), "ts", F.col("value").alias("used"), (F.col("event_id") % 64).alias("processes"), (500 - F.col("value")).alias("available"))
    return A.usage_summary(rows, ["dataset", "stage"]).withColumn("least_available", F.round("least_available", 4))
