"""Flat-field series, gain models and sinograms as tables of (frame, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stencils
from ..functions.numeric import exact_percentiles
from ..session import written


def medianize(df: DataFrame, group: list[str]) -> DataFrame:
    """The median frame of each group: a median of as many values as the group has frames, for each pixel."""
    return df.groupBy(*group, "y", "x").agg(F.median("v").alias("v"))


def frame_stats(df: DataFrame, by: list[str], digits: int = 2) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.avg("v"), digits).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))


def white_outliers(stats: DataFrame, limit: float = 0.15) -> DataFrame:
    """Frames whose mean is off the median of all means by more than a part of it; `stats` has one row for each frame."""
    middle = exact_percentiles(stats, "mean", [50])[0]
    return stats.withColumn("median_mean", F.lit(middle)).where(F.abs(F.col("mean") - middle) > limit * middle)


def sample_centres(frames: int, keep: int) -> list[int]:
    """Midpoints of `keep` equal intervals of a series."""
    return [int((2 * i + 1) * frames / (2 * keep)) for i in range(keep)]


def digest(df: DataFrame, frames: int, keep: int, window: int) -> DataFrame:
    """(centre, y, x, v): the median of the frames about each centre. A frame is given to the few centres it lies near."""
    half = max(1, window) // 2
    centres = sample_centres(frames, keep)
    near: dict[int, list[int]] = {}
    for c in dict.fromkeys(centres):
        for z in range(max(0, c - half), min(frames, c + half + 1)):
            near.setdefault(z, []).append(c)
    table = df.sparkSession.createDataFrame([(z, c) for z, cs in near.items() for c in cs], "z int, centre int")
    return df.join(F.broadcast(table), "z").groupBy("centre", "y", "x").agg(F.median("v").alias("v"))


def centroids(df: DataFrame, by: str) -> DataFrame:
    """Intensity-weighted centre of each frame, negative values counting as 0; null where there is no intensity."""
    v = F.greatest(F.col("v"), F.lit(0.0))
    sums = df.groupBy(by).agg(F.sum(v).alias("total"), F.sum(v * F.col("y")).alias("_r"), F.sum(v * F.col("x")).alias("_c"))
    return sums.select(by, F.try_divide("_r", "total").alias("centroid_row"), F.try_divide("_c", "total").alias("centroid_col"), "total")


def drift(track: DataFrame, by: str) -> DataFrame:
    """Drift table of a track of centroids: intensity as part of the largest, drift from the first. One row for each snapshot."""
    order = W.orderBy(by)
    row, col = F.first("centroid_row").over(order), F.first("centroid_col").over(order)
    return track.select(
        F.col(by).alias("frame_index"), (F.col("total") / F.max("total").over(W.partitionBy())).alias("intensity_norm"), "centroid_row", "centroid_col",
        (F.col("centroid_row") - row).alias("drift_row"), (F.col("centroid_col") - col).alias("drift_col"),
    )


def drift_summary(table: DataFrame, limit: float = 0.5) -> DataFrame:
    """Last drift, change of intensity and the deviation of the drift from a straight line."""
    fit = table.agg(
        F.max_by("drift_row", "frame_index").alias("total_row"), F.max_by("drift_col", "frame_index").alias("total_col"),
        (F.max_by("intensity_norm", "frame_index") - F.min_by("intensity_norm", "frame_index")).alias("intensity_change"),
        F.regr_slope("drift_row", "frame_index").alias("slope"), F.regr_intercept("drift_row", "frame_index").alias("intercept"),
    )
    off = table.crossJoin(F.broadcast(fit)).withColumn("_d", F.col("drift_row") - F.col("intercept") - F.col("slope") * F.col("frame_index"))  # fit is one row
    return off.agg(F.first("total_row").alias("total_row"), F.first("total_col").alias("total_col"), F.first("intensity_change").alias("intensity_change"), F.stddev_pop("_d").alias("residual")).withColumn("nonlinear", F.col("residual") > limit)


def cleaned(df: DataFrame, frame: str, floor: float = 0.0) -> DataFrame:
    """Values that aren't finite or not above `floor` become the median of the frame's others."""
    good = F.when(~F.isnan("v") & (F.abs("v") < float("inf")) & (F.col("v") > floor), F.col("v"))
    medians = df.groupBy(frame).agg(F.median(good).alias("_m"))
    return df.join(medians, frame).withColumn("v", F.coalesce(good, "_m")).drop("_m")


def crossfade(pre: Column, post: Column, s: Column) -> Column:
    """Geometric mixture of two gains."""
    return F.exp((1 - s) * F.ln(pre) + s * F.ln(post))


def gain_stack(pair: DataFrame, count: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., i, y, x, g): the mixture at `count` even steps from pre to post."""
    steps = pair.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return steps.select(*by, "i", "y", "x", crossfade(F.col("pre"), F.col("post"), F.col("i") / max(1, count - 1)).alias("g"))


def flatfield(projection: Column, gain: Column, dark: Column) -> Column:
    return (projection - dark) / F.greatest(gain - dark, F.lit(1e-6))


def bracket(times: DataFrame, keys: list[float]) -> DataFrame:
    """The keyframe before each time (the first and last pairs reach beyond their ends) and the weight of the next; `keys` rise."""
    if len(keys) < 2 or any(a >= b for a, b in zip(keys, keys[1:])):
        raise ValueError("keyframes need at least two rising times")
    ks = F.array(*[F.lit(float(k)) for k in keys])
    below = F.size(F.filter(ks, lambda k: k < F.col("t"))) - 1
    k = F.least(F.greatest(below, F.lit(0)), F.lit(len(keys) - 2))
    return times.withColumn("k", k).withColumn("w", (F.col("t") - F.get(ks, F.col("k"))) / (F.get(ks, F.col("k") + 1) - F.get(ks, F.col("k"))))


def beam_time(df: DataFrame, by: str) -> DataFrame:
    """Least-squares place of each projection between two states, from columns a (projection) and s (change); null if nothing changes."""
    return df.groupBy(by).agg(F.try_divide(F.sum(F.col("a") * F.col("s")), F.nullif(F.sum(F.col("s") * F.col("s")), F.lit(0.0))).alias("beam_time"))


def running_schedule(track: DataFrame, order: str, motion: str) -> DataFrame:
    """Cumulative share of a motion that may not go back."""
    first = F.first(motion).over(W.orderBy(order))
    so_far = F.max(F.col("_m")).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = track.withColumn("_m", F.col(motion) - first).withColumn("_s", so_far)
    return rows.withColumn("s", F.try_divide("_s", F.max("_s").over(W.partitionBy()))).drop("_m", "_s")


def schedule_line(points: DataFrame) -> DataFrame:
    """Straight line of beam time over scan fraction and the deviation from it."""
    return points.agg(
        F.regr_intercept("beam_time", "fraction").alias("alpha"), F.regr_slope("beam_time", "fraction").alias("beta"),
        F.sqrt(F.regr_syy("beam_time", "fraction") / F.count("beam_time") * (1 - F.regr_r2("beam_time", "fraction"))).alias("residual"),
    )


def air_mask(df: DataFrame, ratio: float = 0.95, quantile: float = 0.5) -> DataFrame:
    """Pixels with columns p (projection) and pre that show no sample."""
    return df.where((F.col("p") / F.col("pre") > ratio) & (F.col("pre") > exact_percentiles(df, "pre", [100 * quantile])[0]))


def bit_depth(df: DataFrame) -> DataFrame:
    """Levels of the values, their smallest step, whether all are whole and whether they fit 8 bits."""
    levels = df.select("v").distinct()
    # the neighbour of a level: levels are few where a detector's depth is in question, else ranges keep the window's groups small
    ranged = levels.withColumn("_b", F.floor(F.col("v") / 64))
    inner = ranged.withColumn("_d", F.col("v") - F.lag("v").over(W.partitionBy("_b").orderBy("v")))
    edges = ranged.groupBy("_b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    gaps = edges.select((F.col("lo") - F.lag("hi").over(W.orderBy("_b"))).alias("_d"))
    step = inner.select("_d").unionByName(gaps).agg(F.min("_d").alias("step"))
    facts = levels.agg(F.count("v").alias("levels"), F.bool_and(F.col("v") == F.floor("v")).alias("whole"), F.max("v").alias("v_max"))
    return facts.crossJoin(F.broadcast(step)).withColumn("eight_bit", (F.col("levels") <= 256) & (F.col("v_max") <= 255))  # one row each


def lag1_autocorrelation(df: DataFrame, by: str) -> DataFrame:
    """Correlation of neighbours along rows, about the frame's mean."""
    mean = df.groupBy(by).agg(F.avg("v").alias("_m"))
    rows = df.join(mean, by).withColumn("h", F.col("v") - F.col("_m"))
    rows = rows.withColumn("_n", F.lead("h").over(W.partitionBy(by, "y").orderBy("x")))
    return rows.groupBy(by).agg((F.avg(F.col("h") * F.col("_n")) / F.nullif(F.avg(F.col("h") * F.col("h")), F.lit(0.0))).alias("lag1"))


# reports on a pair of flats ----------------------------------------------------------------------------------------
#: Motion of less than 3 noises, 8-bit data and dark pixels in steps of over a hundredth call for the transport model.
MOTION, DARK_STEP, DARK, BRIGHT = 3.0, 0.01, 0.15, 0.6


def flat_report(pairs: DataFrame, sigma: float = 8) -> DataFrame:
    """One row for each pair of planes (z, height, width, pre, post): how the beam changed, in measured noise and motion, and the gain model that suits it.

    All figures are aggregates over the pixels' log ratio, its smooth part and the rest.
    """
    rows = written(stencils.with_smooth(pairs, {"_a": ("pre", sigma), "_b": ("post", sigma)}), "pair")
    ratio = F.ln("post") - F.ln("pre")
    rows = rows.withColumn("smooth", F.col("_b") - F.col("_a")).withColumn("v", ratio - F.col("smooth"))
    facts = rows.groupBy("z").agg(
        F.first("noise").alias("noise"),
        (F.expm1(F.median(ratio)) * 100).alias("drift_percent"),
        F.stddev_pop("smooth").alias("smooth_motion"),
        F.stddev_pop("v").alias("fine"),
        F.percentile("pre", F.lit(BRIGHT)).alias("_bright"),
        F.percentile("pre", F.lit(DARK)).alias("_dark"),
        F.avg("pre").alias("_mean"),
        F.max("pre").alias("_top"),
        F.bool_and(F.col("pre") == F.floor("pre")).alias("_whole"),
    )
    bright = rows.join(facts.select("z", "_bright"), "z").where("pre > _bright").groupBy("z").agg(F.avg("pre").alias("_light"))
    levels = rows.select("z", "pre").distinct()
    gap = F.col("pre") - F.lag("pre").over(W.partitionBy("z").orderBy("pre"))
    steps = levels.withColumn("_gap", gap).groupBy("z").agg(F.count("pre").alias("_levels"), F.min("_gap").alias("_step"))
    all_ = facts.join(bright, "z", "left").join(steps, "z").join(lag1_autocorrelation(rows, "z"), "z")
    in_ratio = F.sqrt(F.lit(2.0)) * F.col("noise") / F.coalesce("_light", "_mean")
    eight = (F.col("_levels") <= 256) & (F.col("_top") <= 255)
    coarse = F.col("_whole") & (F.coalesce("_step", F.lit(0.0)) / F.greatest("_dark", F.lit(1e-6)) > DARK_STEP)
    motion = F.col("smooth_motion") / F.greatest(in_ratio, F.lit(1e-9))
    return all_.select(
        "z", "drift_percent", "noise", "smooth_motion", "fine", F.coalesce("lag1", F.lit(0.0)).alias("lag1"),
        F.sqrt(F.greatest(F.pow("fine", 2) - F.pow(in_ratio, 2), F.lit(0.0))).alias("fine_motion"), motion.alias("motion_to_noise"), eight.alias("eight_bit"),
        F.when((motion <= MOTION) | eight | coarse, "transport").otherwise("flow").alias("method"),
    )


def residual_report(triples: DataFrame, s: float, mask: Column, sigma: float = 8, spread: float = 12) -> DataFrame:
    """One row for each (z, height, width, pre, post, projection): the deviation that each gain model leaves of the projection where `mask` holds (no sample),
    `share`, the squared correlation of what `post` leaves with the drift, the best model, and whether tracking the drift is worthwhile.

    Smoothing is linear, so the residual of a model is the same mixture of smoothed logarithms as the model is of logarithms.
    """
    smooth = {"_a": ("pre", sigma), "_b": ("post", sigma), "_p": ("projection", sigma), "_sa": ("pre", spread), "_sb": ("post", spread), "_ta": ("_sa", sigma), "_tb": ("_sb", sigma)}
    rows = stencils.with_smooth(triples, smooth).where(mask)
    a, b, p = (F.col(c) for c in ("_a", "_b", "_p"))
    models = {"pre": a, "post": b, "crossfade": a + s * (b - a), "transport": (a + b) / 2 + (s - 0.5) * (F.col("_tb") - F.col("_ta"))}
    left = rows.groupBy("z").agg(*[F.stddev_pop(p - m).alias(k) for k, m in models.items()], F.coalesce(F.pow(F.corr(p - b, b - a), 2), F.lit(0.0)).alias("share"))
    best = F.array_min(F.array(*[F.struct(F.col(k).alias("v"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(models)]))["k"]
    worth = (F.col("share") > 0.3) & (F.col("crossfade") < 0.9 * F.least("pre", "post"))
    return left.withColumn("best", best).withColumn("worthwhile", worth)


# sinograms ---------------------------------------------------------------------------------------------------------
def sinograms(projections: DataFrame, flats: DataFrame, count: int, window: int) -> DataFrame:
    """(y, theta, x, v): projections (theta, y, x, v) corrected by flats (y, x, pre_gain, post_gain, pre_dark, post_dark) whose weights
    move from pre to post as theta moves to `count`. A gain of 0 becomes the smallest other gain of its projection's row window.
    """
    p, n = F.col("theta"), F.lit(float(count))
    mix = lambda a, b: (F.col(a) * (n - p) + F.col(b) * p) / n
    rows = projections.join(flats, ["y", "x"]).withColumn("_dark", mix("pre_dark", "post_dark"))
    rows = rows.withColumn("_gain", mix("pre_gain", "post_gain") - F.col("_dark")).withColumn("_w", F.floor(F.col("y") / window))
    least = rows.where("_gain <> 0").groupBy("theta", "_w").agg(F.min("_gain").alias("_least"))
    rows = rows.join(least, ["theta", "_w"], "left").withColumn("_gain", F.when(F.col("_gain") == 0, F.col("_least")).otherwise(F.col("_gain")))
    return rows.select("y", "theta", "x", ((F.col("v") - F.col("_dark")) / F.col("_gain")).alias("v"))


def overlap_search(lower: DataFrame, upper: DataFrame, height: int, least: int, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., o, std): how unevenly the last o rows of one image divide by the first o rows of the next, for each o in least..most-1; `by` names columns of both that tell pairs apart."""
    asked = lower.withColumn("o", F.explode(F.sequence(F.lit(least), F.lit(most - 1)))).where(F.col("y") >= height - F.col("o"))
    met = asked.withColumn("_y", (F.col("y") - (height - F.col("o"))).cast("int")).join(upper.select(*by, F.col("y").alias("_y"), "x", F.col("v").alias("_u")), [*by, "_y", "x"])
    return met.groupBy(*by, "o").agg(F.stddev_pop(F.try_divide("v", "_u")).alias("std"))


def best_overlap(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(F.min_by("o", F.struct("std", "o")).alias("overlap"))


def blend(lower: DataFrame, upper: DataFrame, height: int, overlap: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Two images one below the other, the mean where they overlap; `by` names columns of both that tell pairs apart."""
    shifted = upper.withColumn("y", (F.col("y") + height - overlap).cast("int"))
    return lower.unionByName(shifted).groupBy(*by, "y", "x").agg(F.avg("v").alias("v"))


def concat_stacks(a: DataFrame, b: DataFrame, a_stop: int, b_start: int) -> DataFrame:
    """The planes of a before `a_stop` and those of b from `b_start`, counted from 0."""
    kept = a.where(F.col("z") < a_stop).withColumn("source", F.lit("a"))
    return kept.unionByName(b.where(F.col("z") >= b_start).withColumn("z", (F.col("z") - b_start + a_stop).cast("int")).withColumn("source", F.lit("b")))
