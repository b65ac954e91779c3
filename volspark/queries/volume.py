"""Queries of volume operators over the driver tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import numeric as N
from ..operators import volume as V
from ..plans import spec
from ..session import scratch
from ..sources import formats

QUERIES: dict = {}
SQL: dict[str, str] = {}

_V = "v as (select cast(event_id // 100 as int) as z, cast((event_id % 100) // 10 as int) as y, cast(event_id % 10 as int) as x, value as v from events)"
_E = "e as (select cast(vec_id // 20 as int) as z, cast(vec_id % 20 as int) as y, cast(p - 1 as int) as x, cast(embedding[p] as double) as v from (select *, unnest(generate_series(1, len(embedding))) as p from embeddings))"
#: Half away or to even matters in no place: values are rounded only to compare sums of another order.
_R = 6


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), _R) for n in names or ("v",)})


@query(f"with {_V} select min(v) as v_min, max(v) as v_max from v")
def find_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bounds(views.voxels(spark, sf_dir))


@query(f"with {_V} select z, min(v) as v_min, max(v) as v_max from v group by z")
def plane_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bounds(views.voxels(spark, sf_dir), ["z"])


@query(f"with {_V}, p as (select quantile_cont(v, 0.05) as a, quantile_cont(v, 0.95) as b from v) select z, y, x, round((least(greatest(v, a), b) - a) / (b - a), 6) as v from v, p")
def normalize_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.normalize(views.voxels(spark, sf_dir), 5, 95))


@query(
    f"with {_V}, p as (select z // 4 as b, quantile_cont(v, 0.1) as lo, quantile_cont(v, 0.9) as hi from v group by 1) "
    "select z, y, x, round((least(greatest(v, lo), hi) - lo) / (hi - lo), 6) as v from v join p on v.z // 4 = p.b"
)
def normalize_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.normalize_batches(views.voxels(spark, sf_dir), 10, 90, 4))


_STRETCH = "cast(cast(floor((v - mn) * greatest(255.0 / (case when mx = mn then 1.0 else mx - mn end), 1.0)) as bigint) % 256 as int)"


@query(f"with {_V}, b as (select z, min(v) as mn, max(v) as mx from v group by z) select z, y, x, {_STRETCH} as v from v join b using (z)")
def stretch_cast_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stretch(views.voxels(spark, sf_dir), "uint8").select("z", "y", "x", F.col("v").cast("int").alias("v"))


@query(
    f"with {_V}, s as (select z, y, x // 3 as section, x % 3 as x, v from v where x < 9), b as (select z, section, min(v) as mn, max(v) as mx from s group by all) "
    f"select z, y, cast(x as int) as x, cast(section as int) as section, {_STRETCH} as v from s join b using (z, section)"
)
def stretch_cast_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stretch_sections(views.voxels(spark, sf_dir), "uint8", 3, 10).select("z", "y", F.col("x").cast("int").alias("x"), "section", F.col("v").cast("int").alias("v"))


@query(f"with {_V} select z, y, x, cast(((cast(floor(v * 3) as bigint) - 700) % 256 + 256) % 256 as int) as v from v")
def wrap_cast_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.voxels(spark, sf_dir).select("z", "y", "x", N.wrap(F.floor(F.col("v") * 3) - 700, "uint8").cast("int").alias("v"))


@query(f"with {_V} select z, y, x, cast(case when v - 100 <= 0 then 0 when v - 100 >= 255 then 255 else trunc(v - 100) end as int) as v from v")
def saturating_cast_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.voxels(spark, sf_dir).select("z", "y", "x", N.saturating_cast(F.col("v") - 100, "uint8").cast("int").alias("v"))


@query(f"with {_V} select z, y, x, cast(round_even((greatest(least(v, 400.0), 100.0) - 100.0) / 300.0 * 65535.0, 0) as int) as v from v")
def unit_scale_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.voxels(spark, sf_dir).select("z", "y", "x", N.unit_scale_cast(F.col("v"), F.lit(100.0), F.lit(400.0), "uint16").alias("v"))


@query(f"with {_V} select cast(z - 2 as int) as z, cast(y - 1 as int) as y, cast(x - 3 as int) as x, v from v where z >= 2 and z < (select max(z) from v) and y >= 1 and y < 8 and x >= 3 and x < 10")
def trim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    return V.trim(v, V.shape(v), z=(2, 1), y=(1, 2), x=(3, 0))


@query(f"with {_V} select z, cast(y - 2 as int) as y, x, v from v where y >= 2 and y < 7 and x < 5")
def trim_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    return V.trim(v, V.shape(v), y=(0.25, 0.25), x=(0.0, 0.5))


def _mip_sql(axis: str, width: int) -> str:
    rest = ", ".join(a for a in "zyx" if a != axis)
    w = f"(partition by {rest} order by {axis} rows between current row and {width - 1} following)"
    return f"with {_V} select z, y, x, m as v from (select z, y, x, max(v) over {w} as m, count(*) over {w} as n from v) where n = {width}"


@query(_mip_sql("z", 3))
def mip_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sliding_max(views.voxels(spark, sf_dir), "z", 3)


@query(_mip_sql("y", 4))
def mip_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sliding_max(views.voxels(spark, sf_dir), "y", 4)


@query(_mip_sql("x", 2))
def mip_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sliding_max(views.voxels(spark, sf_dir), "x", 2)


@query(f"with {_V} select z, y, x, case when power(y - 4.5, 2) + power(x - 4.5, 2) <= 16.0 then v else -1.0 end as v from v")
def circular_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.circular_mask(views.voxels(spark, sf_dir), 0.8, 10, 10, -1.0)


_DENOISE = (
    f"with {_V}, p as (select z, 0.2 * (max(max(v)) over (order by z rows between 1 preceding and 1 following) - min(min(v)) over (order by z rows between 1 preceding and 1 following)) as gap from v group by z), "
    "n as (select *, lag(v) over w as p, lead(v) over w as n from v window w as (partition by y, x order by z)) "
)


@query(_DENOISE + "select z, y, x, case when abs(v - p) > gap and abs(v - n) > gap then (p + n) / 2 else v end as v from n join p using (z)")
def denoise_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.denoise_threshold(views.voxels(spark, sf_dir), 0.2).select("z", "y", "x", "v")


@query(_DENOISE + "select cast(z - 1 as int) as z, y, x, case when abs(v - p) > gap and abs(v - n) > gap then (p + n) / 2 else v end as v from n join p using (z) where p is not null and n is not null")
def denoise_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.denoise_threshold(views.voxels(spark, sf_dir), 0.2, "drop").select("z", "y", "x", "v")


@query(f"with {_V} select z, y, x, case when lag(v) over w < 60 and lead(v) over w < 60 then 0.0 else v end as v from v window w as (partition by y, x order by z)")
def denoise_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.denoise_flat(views.voxels(spark, sf_dir), 60.0)


@query(f"with {_V} select cast((select max(z) from v) - z as int) as z, y, x, v from v")
def flip_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    return V.flip(v, "z", V.shape(v)[0])


@query(f"with {_V} select z, cast(9 - y as int) as y, x, v from v")
def flip_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.flip(views.voxels(spark, sf_dir), "y", 10)


@query(f"with {_V} select z, y, cast(9 - x as int) as x, v from v")
def flip_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.flip(views.voxels(spark, sf_dir), "x", 10)


@query(f"with {_V} select x as z, y, z as x, v from v")
def transpose_zx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transpose(views.voxels(spark, sf_dir))


@query(f"with {_V}, s as (select *, cast(y - (1 + floor(z * 0.05)) as int) as r from v) select r as z, x as y, z as x, v from s where r >= 0 and r < 4")
def transpose_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transpose_shift(views.voxels(spark, sf_dir), 1, 4, 0.05)


@query(f"with {_V} select z, cast(y // 3 as int) as y, cast(x // 3 as int) as x, round(avg(v), 6) as v from v where y < 9 and x < 9 group by all")
def spatial_bin_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.spatial_bin(views.voxels(spark, sf_dir), 3, 10, 10))


@query(f"with {_V} select z, cast(y // 2 as int) as y, cast(x // 2 as int) as x, cast(floor(avg(floor(v)) + 0.5) as bigint) as v from v group by all")
def spatial_bin_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir).withColumn("v", F.floor("v"))
    return V.spatial_bin(v, 2, 10, 10, whole=True)


@query(
    f"with {_V}, a as (select z // 2 as z, y // 2 as y, x // 2 as x, avg(v) as v from v group by all), b as (select z // 2 as z, y // 2 as y, x // 2 as x, avg(v) as v from a group by all), "
    "c as (select 1 as mip, * from a union all select 2, * from b) select mip, cast(z as int) as z, cast(y as int) as y, cast(x as int) as x, round(v, 8) as v from c"
)
def pyramid_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pyramid(views.voxels(spark, sf_dir), 2).withColumn("v", F.round("v", 8))


@query(
    "with v as (select cast(event_id // 100 as int) as z, cast((event_id % 100) // 10 as int) as y, cast(event_id % 10 as int) as x, user_id as v from events), "
    "n as (select cast(z // 2 as int) as z, cast(y // 2 as int) as y, cast(x // 2 as int) as x, v, count(*) as n from v group by all) "
    "select 1 as mip, z, y, x, v from n qualify row_number() over (partition by z, y, x order by n desc, v) = 1"
)
def pyramid_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pyramid(views.voxels(spark, sf_dir, "user_id"), 1, labels=True)


@query(
    "with v as (select cast(event_id // 100 as int) as z, cast((event_id % 100) // 10 as int) as y, cast(event_id % 10 as int) as x, user_id as v from events), "
    "n as (select cast(z // 2 as int) as z, cast(y // 2 as int) as y, cast(x // 2 as int) as x, v, count(*) as n from v group by all), a as (select z, y, x, v from n qualify row_number() over (partition by z, y, x order by n desc, v) = 1), "
    "m as (select cast(z // 2 as int) as z, cast(y // 2 as int) as y, cast(x // 2 as int) as x, v, count(*) as n from a group by all), b as (select z, y, x, v from m qualify row_number() over (partition by z, y, x order by n desc, v) = 1) "
    "select 0 as mip, z, y, x, v from v union all select 1, z, y, x, v from a union all select 2, z, y, x, v from b"
)
def volume_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label volume written as three scales in shard files and read back."""
    formats.register(spark)
    v = views.voxels(spark, sf_dir, "user_id")
    info = formats.info_document("segmentation", "uint32", list(reversed(V.shape(v))), [8, 8, 8], [1, 1, 1])
    path = scratch(spark, "volume").removeprefix("file:")
    formats.write_pyramid(v, path, formats.with_shards(formats.with_scales(info, 2), 16, 4), labels=True)
    read = lambda k: spark.read.format("chunkedvolume").option("mip", k).load(path).select(F.lit(k).alias("mip"), "z", "y", "x", F.col("v").cast("bigint").alias("v"))
    return reduce(DataFrame.unionByName, [read(k) for k in range(3)])


@query(
    f"with {_V} select 'xy' as plane, y as row, x as col, v from v where z = 4 union all select 'xz', z, x, v from v where y = 3 union all select 'yz', z, y, v from v where x = 2"
)
def reslice_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    return V.reslice(v, (2, 3, 4), V.shape(v))


def _stats_sql(box: str) -> str:
    return f"with {_V} select count(v) as voxels, min(v) as v_min, max(v) as v_max, round(avg(v), 6) as v_mean, count(*) filter (where v <> 0) as nonzero from v where {box}"


@query(_stats_sql("z < 4 and y < 4 and x < 4"))
def block_stats_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    a, b = V.clamp_block([-1, 0, 0], [5, 4, 4], [0, 0, 0], list(V.shape(v)))
    return rounded(V.block_stats(v, a, b), "v_mean")


@query(_stats_sql("z >= (select (max(z) + 1) // 2 - 2 from v) and z < (select (max(z) + 1) // 2 + 2 from v) and y >= 3 and y < 7 and x >= 3 and x < 7"))
def block_stats_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    size = V.shape(v)
    a, b = V.clamp_block([n // 2 - 2 for n in size], [4, 4, 4], [0, 0, 0], list(size))
    return rounded(V.block_stats(v, a, b), "v_mean")


@query("select distinct user_id as label from events where event_id // 100 < 3 and (event_id % 100) // 10 < 5 and event_id % 10 < 5")
def segmentation_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.labels_in(views.voxels(spark, sf_dir, "user_id"), [0, 0, 0], [3, 5, 5])


@query(f"with {_V} select z, y, x, cast(c as int) as c, v * [0.5, 0.25, 0.25][c + 1] as v from v, (select unnest([0, 1, 2]) as c)")
def channelize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.channelize(views.voxels(spark, sf_dir), [0.5, 0.25, 0.25])


@query(f"with {_V} select x // 4 as bx, y // 4 as by, z as bz, count(*) as n, round(sum(v), 6) as total from v group by all")
def chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.chunk_of(views.voxels(spark, sf_dir), (4, 4, 1)).groupBy("bx", "by", "bz").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), "total")


@query(f"with {_E} select z, min(v) as v_min, max(v) as v_max, round(avg(v), 6) as v_mean from e group by z")
def signed_plane_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.signed_voxels(spark, sf_dir).groupBy("z").agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean")), "v_mean")


@query(f"with {_V} select z, y, x, v from v")
def planes_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.voxels(V.planes(views.voxels(spark, sf_dir)))


_PIPE = (
    f"with {_V}, p as (select quantile_cont(v, 0.05) as a, quantile_cont(v, 0.95) as b from v), n as (select z, y, x, (least(greatest(v, a), b) - a) / (b - a) as v from v, p), "
    "t as (select z - 1 as z, y - 1 as y, x - 1 as x, v from n where z >= 1 and y between 1 and 8 and x between 1 and 8), "
    "m as (select z, y, x, v from (select z, y, x, max(v) over w as v, count(*) over w as n from t window w as (partition by y, x order by z rows between current row and 2 following)) where n = 3), "
    "c as (select z, y, x, case when power(y - 3.5, 2) + power(x - 3.5, 2) <= 16 then v else 0.0 end as v from m), "
)
_TAIL = (
    f"b as (select z, min(v) as mn, max(v) as mx from {{0}} group by z), s as (select z, y, x, {_STRETCH} as v from {{0}} join b using (z)) "
    "select cast(z as int) as z, cast(y // 2 as int) as y, cast(x // 2 as int) as x, cast(floor(avg(v) + 0.5) as bigint) as v from s group by all"
)
FLAGSHIP = spec.PipelineSpec(normalize=(5, 95), trim_z=(1, 0), trim_y=(1, 1), trim_x=(1, 1), mip=3, mask=1.0, dtype="uint8", bin_power=1)


@query(_PIPE + _TAIL.format("c"))
def pipeline_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    return spec.run(v, FLAGSHIP, V.shape(v))


@query(f"with w as ({_PIPE + _TAIL.format('c')}) select * from w where z >= 2 and z < 5")
def pipeline_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    return spec.run_range(v, FLAGSHIP, V.shape(v), 2, 5)


@query(_mip_sql("z", 3))
def mip_z_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `mip_z`, in up to eight consecutive ranges of output planes, each from the input planes it needs."""
    depth = V.shape(views.voxels(spark, sf_dir))[0]
    s = spec.PipelineSpec(mip=3)
    out = max(0, s.output_depth(depth))
    step = max(1, -(-out // 8))
    ranges = [s.input_range(a, min(a + step, out), depth) for a in range(0, out, step)] or [(0, depth)]
    return reduce(DataFrame.unionByName, [V.sliding_max(views.voxels(spark, sf_dir, planes=r), "z", 3) for r in ranges])


@query(
    _PIPE
    + "g as (select z, 0.4 * (max(max(v)) over w - min(min(v)) over w) as gap from c group by z window w as (order by z rows between 1 preceding and 1 following)), "
    "l as (select *, lag(v) over w as p, lead(v) over w as n from c window w as (partition by y, x order by z)), "
    "d as (select (select max(z) from c) - z as z, y, x, case when abs(v - p) > gap and abs(v - n) > gap then (p + n) / 2 else v end as v from l join g using (z)), " + _TAIL.format("d")
)
def pipeline_fused_flip_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    v = views.voxels(spark, sf_dir)
    return spec.run(v, replace(FLAGSHIP, denoise="threshold", threshold=0.4, flip="z"), V.shape(v))


@query()
def sampled_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    low, high = V.sampled_percentiles(v, 1, 99, V.shape(v)[0], planes_=8, pixels=50)
    return spark.createDataFrame([(low, high)], "low double, high double")
