"""Queries of flat-field, gain and sinogram operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..operators import flats as L
from ..operators import volume as V
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


def _plane(v: DataFrame, z: int, name: str) -> DataFrame:
    return v.where(F.col("z") == z).select("y", "x", F.col("v").alias(name))


@query(f"with {_V} select z // 5 as grp, y, x, median(v) as v from v group by all")
def median_flats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.medianize(views.voxels(spark, sf_dir).withColumn("grp", F.floor(F.col("z") / 5)), ["grp"])


@query("with f as (select event_id // 100 as z, event_type as type, value as v from events) select cast(z as int) as z, type, round(avg(v), 4) as mean, min(v) as min, max(v) as max, count(*) as n from f group by all")
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir).withColumnRenamed("event_type", "type")
    return L.frame_stats(f, ["z", "type"], 4).join(f.groupBy("z", "type").agg(F.count(F.lit(1)).alias("n")), ["z", "type"])


@query(
    "with f as (select cast(event_id // 100 as int) as z, avg(value) as mean from events where event_type = 'signup' group by 1), m as (select median(mean) as m from f) "
    "select z, round(mean, 6) as mean, round(m, 6) as median_mean from f, m where abs(mean - m) > 0.15 * m"
)
def white_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    whites = views.frames(spark, sf_dir).where("event_type = 'signup'")
    return rounded(L.white_outliers(whites.groupBy("z").agg(F.avg("v").alias("mean"))), "mean", "median_mean")


_KEEP, _WIN = 5, 5
_DIGEST = (
    f"with {_V}, n as (select max(z) + 1 as n from v), c as (select cast(floor((i + 0.5) * n / {_KEEP}) as int) as centre from n, (select unnest(range({_KEEP})) as i)), "
    "s as (select centre, y, x, median(v) as v from c join v on v.z between centre - 2 and centre + 2 group by all), "
    "t as (select centre, sum(v) as total, sum(v * y) / sum(v) as r, sum(v * x) / sum(v) as c from s group by centre), "
    "d as (select centre, total / max(total) over () as i, r, c, r - first_value(r) over (order by centre) as dr, c - first_value(c) over (order by centre) as dc from t) "
)


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    return L.drift(L.centroids(L.digest(v, V.shape(v)[0], _KEEP, _WIN), "centre"), "centre")


@query(_DIGEST + "select centre as frame_index, round(i, 6) as intensity_norm, round(r, 6) as centroid_row, round(c, 6) as centroid_col, round(dr, 6) as drift_row, round(dc, 6) as drift_col from d")
def digest_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_drift(spark, sf_dir), "intensity_norm", "centroid_row", "centroid_col", "drift_row", "drift_col")


@query(
    _DIGEST + ", f as (select regr_slope(dr, centre) as s, regr_intercept(dr, centre) as k from d) "
    "select round(arg_max(dr, centre), 6) as total_row, round(arg_max(dc, centre), 6) as total_col, round(arg_max(i, centre) - arg_min(i, centre), 6) as intensity_change, "
    "round(stddev_pop(dr - k - s * centre), 6) as residual, stddev_pop(dr - k - s * centre) > 0.5 as nonlinear from d, f"
)
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.drift_summary(_drift(spark, sf_dir)), "total_row", "total_col", "intensity_change", "residual")


@query("select cast(floor((2 * i + 1) * (select max(event_id) // 100 + 1 from events) / 14.0) as int) as centre from (select unnest(range(7)) as i)")
def sample_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.shape(views.voxels(spark, sf_dir))[0]
    return spark.createDataFrame([(c,) for c in L.sample_centres(n, 7)], "centre int")


_PAIR = f"with {_V}, g as (select a.y, a.x, a.v as pre, b.v as post from v a join v b using (y, x) where a.z = 0 and b.z = 9) "


def _pair(v: DataFrame) -> DataFrame:
    return _plane(v, 0, "pre").join(_plane(v, 9, "post"), ["y", "x"])


@query(f"with {_V}, g as (select a.z, a.y, a.x, a.v as pre, b.v as post from v a join v b on b.z = a.z + 1 and b.y = a.y and b.x = a.x) select z, i, y, x, round(exp((1 - i / 4.0) * ln(pre) + i / 4.0 * ln(post)), 6) as g from g, (select cast(unnest(range(5)) as int) as i)")
def crossfade_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gains between each plane and the next."""
    v = views.voxels(spark, sf_dir)
    later = v.select((F.col("z") - 1).alias("z"), "y", "x", F.col("v").alias("post"))
    return rounded(L.gain_stack(v.withColumnRenamed("v", "pre").join(later, ["z", "y", "x"]), 5, ("z",)), "g")


@query(_PAIR + ", n as (select max(z) + 1 as n from v) select z, y, x, round((v - 0.1) / greatest(exp((1 - z / n) * ln(pre) + z / n * ln(post)) - 0.1, 1e-6), 6) as v from v join g using (y, x), n")
def flatfield_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    rows = v.join(_pair(v), ["y", "x"])
    share = F.col("z") / max(1, V.shape(v)[0])
    return rounded(rows.select("z", "y", "x", L.flatfield(F.col("v"), L.crossfade(F.col("pre"), F.col("post"), share), F.lit(0.1)).alias("v")))


@query(
    "with t as (select distinct event_id // 100 + 0.25 as t from events), k as (select i, i * 2.5 as b from (select cast(unnest(range(4)) as int) as i)), "
    "x as (select t, least(greatest((select count(*) from k where b < t) - 1, 0), 2) as k from t) select cast(t as double) as t, cast(k as int) as k, round((t - k * 2.5) / 2.5, 6) as w from x"
)
def keyframe_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.voxels(spark, sf_dir).select((F.col("z") + 0.25).cast("double").alias("t")).distinct()
    return rounded(L.bracket(t, [0, 2.5, 5, 7.5]), "w")


@query(_PAIR + "select z, round(sum((ln(v) - ln(pre)) * (ln(post) - ln(pre))) / sum(power(ln(post) - ln(pre), 2)), 6) as beam_time from v join g using (y, x) group by z")
def beam_time_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    rows = v.join(_pair(v), ["y", "x"]).select("z", (F.ln("v") - F.ln("pre")).alias("a"), (F.ln("post") - F.ln("pre")).alias("s"))
    return rounded(L.beam_time(rows, "z"), "beam_time")


@query(
    f"with {_V}, m as (select z, sum(v) as m from v group by z), d as (select z, m, m - first_value(m) over (order by z) as d from m), s as (select z, m, max(d) over (order by z) as s from d) "
    "select z, round(m, 4) as m, round(s / (select nullif(max(s), 0) from s), 6) as s from s"
)
def running_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = views.voxels(spark, sf_dir).groupBy("z").agg(F.sum("v").alias("m"))
    return L.running_schedule(track, "z", "m").withColumns({"m": F.round("m", 4), "s": F.round("s", 6)})


@query(
    f"with {_V}, f as (select z / 100.0 as f, avg(v) as b from v group by z) select round(regr_intercept(b, f), 5) as alpha, round(regr_slope(b, f), 5) as beta, "
    "round(sqrt(regr_syy(b, f) / count(*) * (1 - regr_r2(b, f))), 5) as residual from f"
)
def schedule_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.voxels(spark, sf_dir).groupBy("z").agg(F.avg("v").alias("beam_time")).withColumn("fraction", F.col("z") / 100.0)
    return L.schedule_line(points).select(*[F.round(c, 5).alias(c) for c in ("alpha", "beta", "residual")])


@query(f"with {_V}, g as (select a.y, a.x, a.v as pre, b.v as p from v a join v b using (y, x) where a.z = 0 and b.z = 5) select y, x from g where p / pre > 0.95 and pre > (select quantile_cont(pre, 0.5) from g)")
def air_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    return L.air_mask(_plane(v, 0, "pre").join(_plane(v, 5, "p"), ["y", "x"])).select("y", "x")


@query(
    "with l as (select distinct floor(value) as v from events) select count(*) as levels, true as whole, max(v) as v_max, count(*) <= 256 and max(v) <= 255 as eight_bit, "
    "(select min(d) from (select v - lag(v) over (order by v) as d from l)) as step from l"
)
def bit_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bit_depth(views.voxels(spark, sf_dir).withColumn("v", F.floor("v").cast("double")))


@query(
    f"with {_V}, h as (select z, y, x, v - avg(v) over (partition by z) as h from v), n as (select *, lead(h) over (partition by z, y order by x) as n from h) "
    "select z, round(avg(h * n) / avg(h * h), 6) as lag1 from n group by z"
)
def lag1_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.lag1_autocorrelation(views.voxels(spark, sf_dir), "z"), "lag1")


_FLATS = (
    f"with {_V}, f as (select y, x, max(case when z = 0 then v end) as pg, max(case when z = 1 then v end) as qg, max(case when z = 2 then v end) / 10 as pd, max(case when z = 3 then v end) / 10 as qd from v where z < 4 group by all), "
    "p as (select z - 4 as theta, y, x, v from v where z >= 4), c as (select max(theta) + 1 as n from p), "
    "j as (select theta, y, x, v, (pd * (n - theta) + qd * theta) / n as dark, case when y = 0 and x = 0 then 0 else (pg * (n - theta) + qg * theta) / n - (pd * (n - theta) + qd * theta) / n end as gain from p join f using (y, x), c) "
)


def _sinograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    at = lambda k: F.max(F.when(F.col("z") == k, F.col("v")))
    four = v.where("z < 4").groupBy("y", "x").agg(at(0).alias("pre_gain"), at(1).alias("post_gain"), (at(2) / 10).alias("pre_dark"), (at(3) / 10).alias("post_dark"))
    same = (F.col("y") == 0) & (F.col("x") == 0)  # a pixel without gain
    four = four.withColumns({"pre_gain": F.when(same, F.col("pre_dark")).otherwise(F.col("pre_gain")), "post_gain": F.when(same, F.col("post_dark")).otherwise(F.col("post_gain"))})
    return L.sinograms(v.where("z >= 4").select((F.col("z") - 4).alias("theta"), "y", "x", "v"), four, V.shape(v)[0] - 4, 3)


@query(
    _FLATS + ", l as (select theta, y // 3 as w, min(gain) as least from j where gain <> 0 group by all) "
    "select y, cast(j.theta as int) as theta, x, round((v - dark) / (case when gain = 0 then least else gain end), 5) as v from j join l on j.theta = l.theta and j.y // 3 = l.w"
)
def sino_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sinograms(spark, sf_dir).withColumns({"v": F.round("v", 5), "theta": F.col("theta").cast("int")})


@query(
    f"with {_V}, b as (select min(v) as a, max(v) as b from v) select y, z as theta, x, round((v - a) / (b - a), 6) as v from v, b"
)
def sino_preproc_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    low, high = V.bounds(v).first()
    return rounded(v.select("y", F.col("z").alias("theta"), "x", ((F.col("v") - low) / (high - low)).alias("v")))


def _halves(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every even plane and the one behind it, as pairs to stitch."""
    pair = F.floor(F.col("z") / 2).cast("int").alias("pair")
    return tuple(v.where(F.col("z") % 2 == k).select(pair, "y", "x", "v") for k in (0, 1))


@query(
    f"with {_V} select cast(a.z // 2 as int) as pair, cast(o as int) as o, round(stddev_pop(a.v / b.v), 5) as std from (select unnest(range(2, 8)) as o) join v a on a.z % 2 = 0 and a.y >= 10 - o join v b on b.z = a.z + 1 and b.y = a.y - (10 - o) and b.x = a.x group by a.z // 2, o"
)
def stitch_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.overlap_search(*_halves(views.voxels(spark, sf_dir)), 10, 2, 8, ("pair",)).select("pair", "o", F.round("std", 5).alias("std"))


@query(f"with {_V} select cast(z // 2 as int) as pair, y, x, round(avg(v), 6) as v from (select z, y, x, v from v where z % 2 = 0 union all select z, cast(y + 7 as int), x, v from v where z % 2 = 1) group by all")
def stitch_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.blend(*_halves(views.voxels(spark, sf_dir)), 10, 3, ("pair",)))


@query(f"with {_V} select z, y, x, v, 'a' as source from v where z < 3 union all select cast(z - 2 as int), y, x, -v, 'b' from v where z >= 5")
def stack_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.voxels(spark, sf_dir)
    return L.concat_stacks(v, v.withColumn("v", -F.col("v")), 3, 5)
