"""Positions in a sorted table without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import written

_LOCAL = (1 << 33) - 1


def with_positions(df: DataFrame, order: list[str | Column], name: str = "_pos") -> DataFrame:
    """The rows with their 0-based place in the order of the whole table, as a table in the shared folder.

    Range partitions are sorted each for itself; the place is the place in the partition plus the sizes of those before,
    which are one row for each partition. Rows that are equal in `order` stand in any order; columns that are called `_gid`, `_part` or
    `_before` are dropped.
    """
    sorted_ = df.drop("_gid", "_part", "_before").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(sorted_.withColumn("_gid", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_gid", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_part", part).join(before, "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_gid").bitwiseAND(_LOCAL)).drop("_gid", "_part", "_before")


def running_total(df: DataFrame, group: list[str], order: str, block: Column, values: dict[str, Column]) -> DataFrame:
    """The sums of `values`, by their new names, over the rows of a group before each row.

    `block` must not fall along `order`; a window covers one block of a group, and the blocks' sums, one row each, give what lies before.
    """
    rows = df.withColumn("_block", block).withColumns({f"_v_{n}": c for n, c in values.items()})
    sums = rows.groupBy(*group, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*group, "_block", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = W.partitionBy(*group, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values})
    joined = placed.join(sums, [*group, "_block"]).withColumns({n: F.col(f"_b_{n}") + F.col(f"_i_{n}") for n in values})
    return joined.drop("_block", *[f"_{x}_{n}" for n in values for x in "vbi"])


def running_max(df: DataFrame, order: str, block: Column, value: str, name: str) -> DataFrame:
    """The largest `value` of the rows up to and including each row, null before the first that isn't null.

    As in `running_total`, `block` must not fall along `order`: a window covers one block, and one row for each block gives what lies before.
    """
    rows = df.withColumn("_block", block)
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    most = rows.groupBy("_block").agg(F.max(value).alias("_m")).select(F.col("_block").alias("_at"), F.max("_m").over(before).alias("_b"))
    inside = W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("_i", F.max(value).over(inside))
    return placed.join(most, F.col("_block").eqNullSafe(F.col("_at"))).withColumn(name, F.greatest("_b", "_i")).drop("_block", "_at", "_b", "_i")
