"""Surfaces of labelled volumes as the faces between voxels of different labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .volume import AXES, downsample, others


def faces(labels: DataFrame, dust: int = 0) -> DataFrame:
    """(label, axis, side, z, y, x): each face of a voxel (z, y, x, v) towards another label, 0 or the volume's end.

    Label 0 is background; labels of fewer than `dust` voxels have no faces. One window along each axis, over lines of voxels.
    """
    rows = labels.where("v <> 0")
    if dust:
        kept = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= dust)
        rows = rows.join(kept.select("v"), "v", "left_semi")
    sides = []
    for axis in AXES:
        line = W.partitionBy(*others(axis)).orderBy(axis)
        for side, step in ((0, 1), (1, -1)):
            near = (F.lag if step == 1 else F.lead)(F.struct(axis, "v")).over(line)
            touching = (near[axis] == F.col(axis) - step) & (near["v"] == F.col("v"))
            sides.append(F.when(~F.coalesce(touching, F.lit(False)), F.struct(F.lit(axis).alias("axis"), F.lit(side).alias("side"))))
    named = rows.withColumns({f"_f{k}": c for k, c in enumerate(sides)})
    found = F.array_compact(F.array(*[F.col(f"_f{k}") for k in range(len(sides))]))
    return named.select(F.col("v").alias("label"), F.explode(found).alias("f"), *AXES).select("label", "f.axis", "f.side", *AXES)


def levels_of_detail(labels: DataFrame, levels: int, dust: int = 0) -> DataFrame:
    """Faces of the volume and of its majority pyramid: (lod, label, axis, side, z, y, x)."""
    out, level = faces(labels, dust).withColumn("lod", F.lit(0)), labels
    for k in range(1, levels):
        level = downsample(level, labels=True)
        out = out.unionByName(faces(level).withColumn("lod", F.lit(k)))
    return out
