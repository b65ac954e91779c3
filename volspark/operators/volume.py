"""Operators on volumes as tables of voxels (z, y, x, v).

Statistics of planes or volumes are aggregates that are joined back, not windows over planes, since a plane may hold any number of
voxels; windows run along one axis of one line of voxels only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import numeric as N
from ..session import written

AXES = ("z", "y", "x")


def others(axis: str) -> list[str]:
    return [a for a in AXES if a != axis]


def shape(df: DataFrame) -> tuple[int, int, int]:
    """Depth, height and width of a volume whose coordinates start at 0."""
    return tuple(int(n or 0) for n in df.agg(*[F.max(a) + 1 for a in AXES]).first())


def bounds(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Least and most value, of groups if `by` names any."""
    return df.groupBy(*(by or [])).agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"))


def with_bounds(df: DataFrame, by: list[str]) -> DataFrame:
    return df.join(bounds(df, by), by)


def normalize(df: DataFrame, low: float, high: float) -> DataFrame:
    """Scale the values between two percentiles of the whole volume to 0..1."""
    a, b = N.exact_percentiles(df, "v", [low, high])
    return df.withColumn("v", N.normalized(F.col("v"), F.lit(a), F.lit(b)))


def normalize_batches(df: DataFrame, low: float, high: float, batch: int) -> DataFrame:
    """The same for each batch of consecutive planes, whose size is the caller's to bound."""
    numbered = df.withColumn("batch", F.floor(F.col("z") / batch))
    cut = numbered.groupBy("batch").agg(F.percentile("v", F.array(F.lit(low / 100), F.lit(high / 100))).alias("p"))
    joined = numbered.join(cut, "batch")
    return joined.withColumn("v", N.normalized(F.col("v"), F.col("p")[0], F.col("p")[1])).drop("p", "batch")


def stretch(df: DataFrame, dtype: str, by: list[str] = ["z"]) -> DataFrame:  # noqa: B006
    """Stretch each plane (or other group) to an integer type."""
    return with_bounds(df, by).withColumn("v", N.stretch_cast(F.col("v"), F.col("v_min"), F.col("v_max"), dtype)).drop("v_min", "v_max")


def stretch_sections(df: DataFrame, dtype: str, sections: int, width: int) -> DataFrame:
    """Cut planes into equal sections of their width, leaving out the rest, and stretch each for itself."""
    each = width // sections
    cut = df.withColumn("section", F.floor(F.col("x") / each).cast("int")).where(F.col("section") < sections).withColumn("x", F.col("x") - F.col("section") * each)
    return stretch(cut, dtype, ["z", "section"])


def trim(df: DataFrame, size: tuple[int, int, int], **crops: tuple[float | int, float | int]) -> DataFrame:
    """Cut off both ends of axes, in voxels or fractions, and count from 0 again. The ranges reach the scan as filters."""
    cut = {a: N.crop_bounds(crops[a], n) for a, n in zip(AXES, size) if a in crops}
    for a, (lo, hi) in cut.items():
        df = df.where((F.col(a) >= lo) & (F.col(a) < hi))
    return df.withColumns({a: (F.col(a) - lo).cast("int") for a, (lo, _) in cut.items()})


def sliding_max(df: DataFrame, axis: str, width: int) -> DataFrame:
    """Maximum over exactly `width` voxels along an axis, at the place of the first."""
    if width <= 1:
        return df
    ahead = W.partitionBy(*others(axis)).orderBy(axis).rowsBetween(0, width - 1)
    return df.withColumns({"v": F.max("v").over(ahead), "_n": F.count("v").over(ahead)}).where(F.col("_n") == width).drop("_n")


def circular_mask(df: DataFrame, ratio: float, height: int, width: int, fill: float | Column) -> DataFrame:
    """Give `fill` to voxels outside the circle about the planes' centre."""
    radius = ratio * min(height, width) / 2
    away = F.pow(F.col("y") - (height - 1) / 2, 2) + F.pow(F.col("x") - (width - 1) / 2, 2)
    return df.withColumn("v", F.when(away <= radius * radius, F.col("v")).otherwise(fill if isinstance(fill, Column) else F.lit(fill)))


def _neighbours(df: DataFrame) -> DataFrame:
    line = W.partitionBy("y", "x").orderBy("z")
    return df.withColumns({"_p": F.lag("v").over(line), "_n": F.lead("v").over(line)})


def denoise_threshold(df: DataFrame, threshold: float, boundary: str = "preserve", whole: bool = False) -> DataFrame:
    """Replace a voxel that differs from both neighbours along z by more than the threshold's part of the three planes' range by their
    mean (truncated for whole numbers). Planes without two neighbours are kept or dropped."""
    order = W.orderBy("z").rowsBetween(-1, 1)  # one row for each plane
    planes = bounds(df, ["z"]).select("z", ((F.max("v_max").over(order) - F.min("v_min").over(order)) * threshold).alias("_gap"))
    rows = _neighbours(df).join(planes, "z")
    mean = (F.col("_p") + F.col("_n")) / 2
    mean = F.when(mean < 0, F.ceil(mean)).otherwise(F.floor(mean)).cast(df.schema["v"].dataType) if whole else mean
    off = (F.abs(F.col("v") - F.col("_p")) > F.col("_gap")) & (F.abs(F.col("v") - F.col("_n")) > F.col("_gap"))
    return _bounded(rows.withColumn("_new", F.when(off, mean).otherwise(F.col("v"))), boundary).drop("_gap")


def denoise_flat(df: DataFrame, threshold: float, boundary: str = "preserve") -> DataFrame:
    """0 where both neighbours along z are below the threshold."""
    rows = _neighbours(df)
    return _bounded(rows.withColumn("_new", F.when((F.col("_p") < threshold) & (F.col("_n") < threshold), F.lit(0).cast(df.schema["v"].dataType)).otherwise(F.col("v"))), boundary)


def _bounded(rows: DataFrame, boundary: str) -> DataFrame:
    inner = F.col("_p").isNotNull() & F.col("_n").isNotNull()
    rows = rows.where(inner).withColumn("z", F.col("z") - 1) if boundary == "drop" else rows
    return rows.withColumn("v", F.when(inner, F.col("_new")).otherwise(F.col("v")) if boundary != "drop" else F.col("_new")).drop("_p", "_n", "_new")


def flip(df: DataFrame, axis: str, size: int) -> DataFrame:
    return df.withColumn(axis, (size - 1 - F.col(axis)).cast("int"))


def transpose(df: DataFrame, order: str = "xyz") -> DataFrame:
    """Axes in another order: the new z is the axis named first."""
    return df.select(*[F.col(old).alias(new) for new, old in zip(AXES, order)], *[c for c in df.columns if c not in AXES])


def transpose_shift(df: DataFrame, start: int, levels: int, shift: float) -> DataFrame:
    """Rows of each plane from start + int(z * shift) on become planes: (row, x, old z)."""
    first = F.lit(start) + F.floor(F.col("z") * shift)
    new = (F.col("y") - first).cast("int")
    return df.where((new >= 0) & (new < levels)).select(new.alias("z"), F.col("x").alias("y"), F.col("z").alias("x"), "v")


def spatial_bin(df: DataFrame, factor: int, height: int, width: int, whole: bool = False) -> DataFrame:
    """Means of square blocks of planes, without edges that fill no block; whole numbers round half up."""
    if factor <= 1:
        return df
    kept = df.where((F.col("y") < height // factor * factor) & (F.col("x") < width // factor * factor))
    mean = F.avg("v")
    return kept.groupBy("z", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg((F.floor(mean + 0.5) if whole else mean).alias("v"))


def downsample(df: DataFrame, labels: bool = False) -> DataFrame:
    """One level of a pyramid: blocks of 2 x 2 x 2 by mean, or by the commonest label and of equally common ones the smallest."""
    keys = [F.floor(F.col(a) / 2).cast("int").alias(a) for a in AXES]
    if not labels:
        return df.groupBy(*keys).agg(F.avg("v").alias("v"))
    counts = df.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*AXES).agg(F.min(F.struct(-F.col("n"), "v"))["v"].alias("v"))


def pyramid(df: DataFrame, levels: int, labels: bool = False) -> DataFrame:
    """(mip, z, y, x, v) of levels 1 to `levels`, each from the one before."""
    parts, level = [], df
    for k in range(1, levels + 1):
        level = written(downsample(level, labels), f"level{k}")  # else each level would compute all below it again
        parts.append(level.select(F.lit(k).alias("mip"), *AXES, "v"))
    return reduce(DataFrame.unionByName, parts)


def reslice(df: DataFrame, at: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """(plane, row, col, v): the planes through a point along each axis; one scan."""
    for name, n, k in zip("xyz", at, reversed(size)):
        if not 0 <= n < k:
            raise ValueError(f"{name} = {n} lies outside 0..{k - 1}")
    x, y, z = at
    cut = lambda name, here, row, col: F.when(here, F.struct(F.lit(name).alias("plane"), F.col(row).alias("row"), F.col(col).alias("col")))
    planes = F.array_compact(F.array(cut("xy", F.col("z") == z, "y", "x"), cut("xz", F.col("y") == y, "z", "x"), cut("yz", F.col("x") == x, "z", "y")))
    return df.where((F.col("z") == z) | (F.col("y") == y) | (F.col("x") == x)).select(F.explode(planes).alias("p"), "v").select("p.*", "v")


def clamp_block(start: list[int], size: list[int], least: list[int], most: list[int]) -> tuple[list[int], list[int]]:
    """A box cut to bounds: its first and its last corner, the latter excluded."""
    a = [min(max(s, lo), hi) for s, lo, hi in zip(start, least, most)]
    b = [min(max(s + n, lo), hi) for s, n, lo, hi in zip(start, size, least, most)]
    if any(p >= q for p, q in zip(a, b)):
        raise ValueError("the block lies outside the volume")
    return a, b


def block_stats(df: DataFrame, first: list[int], last: list[int]) -> DataFrame:
    """Statistics of the box from `first` to before `last`, both (z, y, x)."""
    for a, lo, hi in zip(AXES, first, last):
        df = df.where((F.col(a) >= lo) & (F.col(a) < hi))
    return df.agg(F.count("v").alias("voxels"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"), F.count_if(F.col("v") != 0).alias("nonzero"))


def labels_in(df: DataFrame, first: list[int], last: list[int]) -> DataFrame:
    for a, lo, hi in zip(AXES, first, last):
        df = df.where((F.col(a) >= lo) & (F.col(a) < hi))
    return df.select(F.col("v").alias("label")).distinct()


def channelize(df: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """Three channels: the value in each, or weighted."""
    w = F.array(*[F.lit(x) for x in (weights or [1.0, 1.0, 1.0])])
    return df.select(*AXES, F.posexplode(w).alias("c", "w"), "v").select(*AXES, "c", (F.col("v") * F.col("w")).alias("v"))


def chunk_of(df: DataFrame, chunk: tuple[int, int, int]) -> DataFrame:
    """Chunk coordinates (bx, by, bz) of each voxel for a chunk size in x, y, z."""
    return df.withColumns({f"b{a}": F.floor(F.col(a) / n).cast("int") for a, n in zip("xyz", chunk)})


def planes(df: DataFrame) -> DataFrame:
    """(z, height, width, pixels): one row for each plane, pixels in row order. Planes must fit a task, as image files do."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v"))))
    rows = df.groupBy("z").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), cells.alias("c"))
    return rows.select("z", "height", "width", F.transform("c", lambda c: c["v"]).alias("pixels"))


def voxels(df: DataFrame) -> DataFrame:
    """Planes as voxels again."""
    rows = df.select("z", "width", F.posexplode("pixels").alias("i", "v"))
    return rows.select("z", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), F.pmod("i", "width").cast("int").alias("x"), "v")


def sampled_percentiles(df: DataFrame, low: float, high: float, depth: int, planes_: int = 32, pixels: int = 200_000, seed: int = 0) -> tuple[float, float]:
    """Percentiles over evenly spaced planes and a fixed number of pixels of each, chosen by a seeded hash: a sampling operator."""
    count = min(planes_, depth)
    zs = sorted({int(i * (depth - 1) / max(1, count - 1)) for i in range(count)})
    pick = W.partitionBy("z").orderBy(F.xxhash64(F.lit(seed), "z", "y", "x"), "y", "x")
    rows = df.where(F.col("z").isin(zs)).withColumn("_k", F.row_number().over(pick)).where(F.col("_k") <= pixels)
    return tuple(N.exact_percentiles(rows, "v", [low, high]))


def check_layout(planes_: DataFrame) -> tuple[int, int, str]:
    """Height, width and type that all planes share; raises if they differ or there are none."""
    found = [tuple(r) for r in planes_.select("height", "width", "dtype").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError("the planes differ in size or type" if found else "there are no planes")
    return found[0]


def fetch(df: DataFrame, first: list[int], last: list[int], dtype: str | None = None, transposed: bool = False) -> DataFrame:
    """A region (z, y, x) counted from its corner, cast without a stretch, its axes moved so that the last comes first if asked."""
    for a, lo, hi in zip(AXES, first, last):
        df = df.where((F.col(a) >= lo) & (F.col(a) < hi)).withColumn(a, (F.col(a) - lo).cast("int"))
    if dtype:
        df = df.withColumn("v", F.col("v").cast(N.FLOATS[dtype]) if dtype in N.FLOATS else N.wrap(F.when(F.col("v") < 0, F.ceil("v")).otherwise(F.floor("v")), dtype))
    return transpose(df, "xzy") if transposed else df


def as_types(df: DataFrame, dtypes: list[str], mode: str = "none", low: float | None = None, high: float | None = None) -> dict[str, DataFrame]:
    """One volume in several types: as it is, or scaled between bounds found over the whole volume (`minmax`, `percentile`) or given (`manual`)."""
    if mode == "minmax":
        low, high = bounds(df).first()
    elif mode == "percentile":
        low, high = N.exact_percentiles(df, "v", [low if low is not None else 0.1, high if high is not None else 99.9])
    elif mode not in ("none", "manual"):
        raise ValueError("mode is none, minmax, percentile or manual")
    out = {}
    for d in dict.fromkeys(dtypes):
        v = F.col("v").cast("double")
        out[d] = df.withColumn("v", (v.cast(N.FLOATS[d]) if d in N.FLOATS else N.saturating_cast(v, d)) if mode == "none" else N.unit_scale_cast(v, F.lit(float(low)), F.lit(float(high)), d))
    return out
