"""Driver tables as volumes, frames, viewer layers, points and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import load


def voxels(spark: SparkSession, sf_dir: str, value: str = "value", planes: tuple[int, int] | None = None) -> DataFrame:
    """Planes of 10 x 10 voxels. `planes`: only those from the first to before the last, stated as a range of ids, which reaches the scan as
    a range of computed coordinates would not."""
    e = load(spark, sf_dir, "events")
    if planes:
        e = e.where((F.col("event_id") >= 100 * planes[0]) & (F.col("event_id") < 100 * planes[1]))
    i = F.col("event_id")
    return e.select(F.floor(i / 100).cast("int").alias("z"), F.floor(F.pmod(i, F.lit(100)) / 10).cast("int").alias("y"), F.pmod(i, F.lit(10)).cast("int").alias("x"), F.col(value).alias("v"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(F.floor(i / 100).cast("int").alias("z"), F.floor(F.pmod(i, F.lit(100)) / 10).cast("int").alias("y"), F.pmod(i, F.lit(10)).cast("int").alias("x"), F.col("value").alias("v"), "ts", "event_type", "props", "user_id")


def signed_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of 20 x 64 values below and above 0."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return e.select(F.floor(F.col("vec_id") / 20).cast("int").alias("z"), F.pmod("vec_id", F.lit(20)).cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("e").cast("double").alias("v"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    kind = F.element_at(F.array(F.lit("image"), F.lit("segmentation"), F.lit("annotation")), (F.pmod("n_nationkey", F.lit(3)) + 1).cast("int"))
    source = F.when(F.col("n_nationkey") % 2 == 0, F.concat_ws("|", F.concat(F.lit("bucket/"), "n_name"), "r_name")).otherwise(F.concat(F.lit("precomputed://"), "n_name"))
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("doc"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("ord"), kind.alias("type"), source.alias("source"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").cast("bigint").alias("layer"), F.col("c_custkey").cast("bigint").alias("ord"), F.pmod("c_custkey", F.lit(97)).cast("double").alias("px"), F.col("c_nationkey").cast("double").alias("py"), F.col("c_acctbal").cast("double").alias("pz"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    size = F.when(F.col("o_orderpriority").like("1%") & (F.col("o_orderstatus") == "P"), F.floor("o_totalprice")).otherwise(0).cast("bigint")
    return o.select(F.concat(F.lit("job"), F.col("o_custkey").cast("string")).alias("parent"), F.concat(F.lit("err-"), F.col("o_orderkey").cast("string")).alias("name"), size.alias("size"), F.col("o_orderkey").cast("bigint").alias("file_id"))
