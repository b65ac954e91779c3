"""Queries of dense kernels, surfaces and file metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import stencils as S
from ..operators import flats, mesh, metadata
from ..operators import volume as V
from ..session import load
from ..streaming import usage

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.planes(views.voxels(spark, sf_dir))


@query()
def gaussian_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.voxels(S.apply_planes(_planes(spark, sf_dir), lambda a: S.gaussian(a, 1.5)))


@query()
def nlm_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.voxels(S.apply_planes(_planes(spark, sf_dir), lambda a: S.non_local_means(a, 3, 2, 50.0)))


@query()
def decompose_flats(spark: SparkSession, sf_dir: str) -> DataFrame:
    static, beams = S.decompose(_planes(spark, sf_dir), 1.5, 5)
    return beams.join(static, ["y", "x"])


@query()
def flow_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.voxels(S.apply_pairs(S.pairs_of(_planes(spark, sf_dir)), lambda a, b: S.flow_warped(a, b, 0.5, sigma=1.5, spread=2.0, fine=1.0, coarse=4.0, rounds=20, shrink=1, most=3.0)))


@query()
def separated_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.voxels(S.apply_pairs(S.pairs_of(_planes(spark, sf_dir)), lambda a, b: S.separated_warped(a, b, 0.5, sigma=1.5, spread=2.0, coarse=4.0, rounds=20, shrink=1, most=3.0)))


@query()
def residual_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plane with the ones before and behind it as flats."""
    pairs = S.pairs_of(_planes(spark, sf_dir), 2)
    middle = _planes(spark, sf_dir).select((F.col("z") - 1).alias("z"), F.col("pixels").alias("projection"))
    return flats.residual_report(pairs.join(middle, "z"), 0.5, F.col("x") > 0, 1.5, 2.0)


@query()
def transport_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.voxels(S.apply_pairs(S.pairs_of(_planes(spark, sf_dir)), lambda a, b: S.transported(a, b, 0.25, 2.0)))


@query()
def flat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flats.flat_report(S.pairs_of(_planes(spark, sf_dir)), 1.5)


_SURFACE = (
    "with v as (select cast(event_id // 100 as int) as z, cast((event_id % 100) // 10 as int) as y, cast(event_id % 10 as int) as x, user_id % 3 as v from events), k as (select * from v where v <> 0), "
    "n as (select k.v, a.axis, a.side, k.z, k.y, k.x, o.v as w from k cross join (values ('z', 0, -1, 0, 0), ('z', 1, 1, 0, 0), ('y', 0, 0, -1, 0), ('y', 1, 0, 1, 0), ('x', 0, 0, 0, -1), ('x', 1, 0, 0, 1)) a(axis, side, dz, dy, dx) "
    "left join v o on o.z = k.z + dz and o.y = k.y + dy and o.x = k.x + dx) select v as label, axis, side, z, y, x from n where w is distinct from v"
)


@query(_SURFACE)
def surface_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.faces(views.voxels(spark, sf_dir, "user_id").withColumn("v", F.col("v") % 3))


@query("select cast(event_id // 100 as int) as z, cast((event_id % 100) // 10 as int) as y, cast(event_id % 10 as int) as x, value as v from events where event_id // 100 between 3 and 39 and (event_id // 100 - 3) % 4 = 0")
def every_fourth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.every(views.voxels(spark, sf_dir), 3, 40, 4)


@query(
    "with m as (select source_file, type, case when not isnan(mean) and abs(mean) < 1e300 then mean end as mean, i0_move_x, i0_move_y from frame_manifest) select source_file, count(*) filter (where type = 'white') as whites, count(*) filter (where type = 'dark') as darks, "
    "round((max(mean) filter (where type = 'white') - min(mean) filter (where type = 'white')) / avg(mean) filter (where type = 'white'), 6) as spread, max(coalesce(abs(i0_move_x), 0) + coalesce(abs(i0_move_y), 0)) = 0 as zero_move from m group by source_file"
)
def reference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.file_report(load(spark, sf_dir, "frame_manifest")).withColumn("spread", F.round("spread", 6))


@query(
    "with s as (select event_type as stage, ts, value, event_id % 64 as p, case when ts - lag(ts) over w >= interval 20 minutes then 1 else 0 end as cut from events window w as (partition by event_type order by ts)), "
    "g as (select *, sum(cut) over (partition by stage order by ts rows unbounded preceding) as g from s) select stage, min(ts) as began, max(ts) + interval 20 minutes as ended, max(value) as peak, max(p) as most_processes, count(*) as samples from g group by stage, g"
)
def usage_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), "ts", F.col("value").alias("used"), (F.col("event_id") % 64).alias("processes"))
    return usage.sessions(e, "20 minutes")
