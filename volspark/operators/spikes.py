"""Implausible readings in series of frame statistics.

Each series is taken apart by undecimated wavelets: Haar details x[i] - x[i + s] and second-order details x[i] - (x[i-s] + x[i+s]) / 2, which no
slow drift enters, at the dilations s = 1, 2 and 3. The median absolute second-order detail gives a source's scatter (of a source of many chunks, the
median of the chunks' medians, each counted once for every 64 of its frames). A frame is a spike where
Haar details to both sides exceed `times` that scatter with one sign, over dilations that leave at most `longest` frames between them; so neither a step
of level nor a longer run is one. Beside a spike the details point both ways (the ordinary frame between two spikes stands off both), so the
frame must also stand off most of those around it, by half of that. Runs of zero detail find a stuck detector, bounds find impossible readings.

How far the details of a frame reach doesn't depend on the scatter: one pass gives what each frame's details exceed and each chunk's median detail,
the scatter is an aggregate of those, and thresholds are set on the join of both. That pass runs in NumPy over Arrow batches of sorted partitions, as windows of
so many shifted columns make methods that the JVM doesn't compile. Series are cut into chunks of frames that overlap by HALO, so a source may hold any share
of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.batches import starts, whole_groups
from ..session import written
from .ordering import running_total

FIELDS = ["mean", "min", "max"]
SOURCE = ["source_file", "type"]
CHUNK, HALO, SIDE = 1024, 32, 9
TIMES, LONGEST, STUCK = 10.0, 3, 5
#: A median absolute deviation times this is a normal distribution's standard deviation.
MAD = 1.4826


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def frames_of(manifest: DataFrame, with_: list[str] | None = None) -> DataFrame:
    """One row for each frame: null statistics are none, repeated extractions count once (the last by `extracted_at`, `row_id`)."""
    rows = manifest.where(" and ".join(f"`{c}` is not null" for c in [*SOURCE, "index", *FIELDS]))
    keys = [*SOURCE, *(with_ or []), "index"]
    # a window, as the places that follow need the same order, and an aggregate of structs would sort too
    last = W.partitionBy(*keys).orderBy(F.desc_nulls_last("extracted_at"), F.desc_nulls_last("row_id"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*keys, *FIELDS)


def impossible(lowest: float = 0, highest: float = 65535) -> Column:
    mean, least, most = (F.col(c) for c in FIELDS)
    finite = ~F.isnan(mean) & (F.abs(mean) < float("inf"))
    return ~finite | (least < lowest) | (most > highest) | (least > most) | (mean < least) | (mean > most)


def _around(x: np.ndarray, group: np.ndarray, reach: int) -> np.ndarray:
    """The values up to `reach` places before and after each, NaN beyond the ends of its group; the own value is in the middle."""
    n, shifts = len(x), np.arange(-reach, reach + 1)
    at = np.arange(n)[:, None] + shifts
    safe = np.clip(at, 0, n - 1)
    return np.where((at == safe) & (group[safe] == group[:, None]), x[safe], np.nan)


def second_order(around: np.ndarray, s: int) -> np.ndarray:
    """Undecimated second-order detail at dilation s, of the deviation of its input; NaN where a side is missing."""
    c = around.shape[1] // 2
    return np.abs(around[:, c] - (around[:, c - s] + around[:, c + s]) / 2) / np.sqrt(1.5)


def reach_of_details(around: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(how far, sign): what the Haar details to both sides exceed with one sign, at best over dilations a and b with a + b <= longest + 1.

    Beyond an end of the series there is no detail, and the other side decides; 0 where no two details have one sign.
    """
    c = around.shape[1] // 2
    details = around[:, [c]] - around
    best, sign = np.zeros(len(around)), np.zeros(len(around))
    for s in (1.0, -1.0):
        d = np.where(np.isnan(details), np.inf, s * details)
        before, after = (np.maximum.accumulate(d[:, k], axis=1) for k in (range(c - 1, c - longest - 1, -1), range(c + 1, c + longest + 1)))
        far = np.max([np.minimum(before[:, a], after[:, longest - 1 - a]) for a in range(longest)], axis=0)
        better = np.isfinite(far) & (far > best)
        best, sign = np.where(better, far, best), np.where(better, s, sign)
    return best, sign


def off_most(around: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """How far, in the direction of `sign`, a value stands off more than half of those around it."""
    c = around.shape[1] // 2
    others = np.delete(around, c, axis=1)
    d = np.sort(np.where(np.isnan(others), np.inf, -sign[:, None] * (around[:, [c]] - others)), axis=1)
    half = (~np.isnan(others)).sum(axis=1) // 2
    return -d[np.arange(len(d)), np.minimum(half, d.shape[1] - 1)]


def _median(details: np.ndarray) -> float:
    """Of the details of all dilations (columns); where most are 0, as in a series that repeats itself, of the dilation with the largest median."""
    there = details[~np.isnan(details)]
    if not len(there):
        return float("nan")
    half = float(np.median(there))
    return half or max(float(np.median(d)) for c in details.T if len(d := c[~np.isnan(c)]))


def _decomposed(placed: DataFrame, longest: int, stuck: int) -> DataFrame:
    """Each frame with `_reach_{f}` of its Haar details and `_off_{f}` from most frames around, and on one frame of each chunk the
    median second-order detail `_half_{f}` of the chunk's ordinary frames and their number `_frames`."""
    numbers = [f"_{k}_{f}" for f in FIELDS for k in ("reach", "off", "half")] + ["_frames"]
    keep = [*SOURCE, "index"]
    out = T.StructType([*[placed.schema[c] for c in [*keep, "_bad"]], T.StructField("_stuck", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in numbers]])
    group = [*SOURCE, "_chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, group):
            first = starts(t, group)
            groups = np.cumsum(first)
            values = {f: t.column(f).to_numpy().astype(float) for f in FIELDS}
            with np.errstate(invalid="ignore"):
                zero = ~first
                for x in values.values():
                    zero[1:] &= np.diff(x) == 0
            run_of = np.cumsum(~zero)
            is_stuck = np.bincount(run_of)[run_of] >= stuck
            good = np.flatnonzero(~t.column("_bad").to_numpy())
            columns = {c: np.full(t.num_rows, np.nan) for c in numbers}
            own = t.column("_own").to_numpy() == t.column("_chunk").to_numpy()
            mine = own[good]
            # where each chunk's own ordinary frames begin in `good[mine]`, and on which frame its figures stand
            _, begin = np.unique(groups[good][mine], return_index=True)
            stand = good[mine][begin]
            columns["_frames"][stand] = np.diff([*begin, mine.sum()])
            for f in FIELDS:
                around = _around(values[f][good], groups[good], SIDE)
                details = np.stack([second_order(around[mine], s) for s in range(1, longest + 1)], axis=1)
                columns[f"_half_{f}"][stand] = [_median(d) for d in np.split(details, begin[1:])] if len(begin) else []
                far, sign = reach_of_details(around, longest)
                there = np.flatnonzero(far > 0)
                columns[f"_reach_{f}"][good] = far
                columns[f"_off_{f}"][good[there]] = off_most(around[there], sign[there])
            arrays = [t.column("_bad"), pa.array(is_stuck), *[pa.array(columns[c], from_pandas=True) for c in numbers]]
            yield from pa.table([*[t.column(c) for c in keep], *arrays], names=[*keep, "_bad", "_stuck", *numbers]).filter(pa.array(own)).to_batches()

    rows = placed.repartition(*group).sortWithinPartitions(*group, "_pos")
    return rows.select(*keep, *FIELDS, "_bad", "_own", "_chunk").mapInArrow(run, out)


def implausible(manifest: DataFrame, times: float = TIMES, longest: int = LONGEST, stuck: int = STUCK) -> DataFrame:
    """(source_file, type, index, why): frames whose statistics cannot be right; `why` holds `bounds`, `stuck`, `spike`.

    Defined results: rows with a null statistic, source, type or index are no frames; repeated rows count once; a field
    whose ordinary scatter is 0 is off where it differs from its neighbours at all; other columns are left out.
    """
    # one shuffle by source and block serves the repeated rows, the places and the blocks' sums
    block = F.floor(F.col("index") / CHUNK)
    rows = manifest.select("row_id", *SOURCE, "index", *FIELDS, "extracted_at").withColumn("_block", block).repartition(*SOURCE, "_block")
    frames = frames_of(rows, ["_block"]).withColumn("_bad", impossible())
    placed = running_total(frames, SOURCE, "index", F.col("_block"), {"_pos": F.lit(1)})
    near = F.array_distinct(F.array(*[F.floor((F.col("_pos") + d) / CHUNK) for d in (0, -HALO, HALO)]))
    spread = placed.withColumn("_own", F.floor(F.col("_pos") / CHUNK)).withColumn("_chunk", F.explode(near)).where("_chunk >= 0")
    rows = written(_decomposed(spread, longest, stuck), "frames")
    # a chunk's median counts once for every 64 of its frames
    halves = rows.where("_frames is not null").select(*SOURCE, F.explode(F.array_repeat(F.struct(*[f"_half_{f}" for f in FIELDS]), F.ceil(F.col("_frames") / 64).cast("int"))).alias("d"))
    scales = halves.groupBy(*SOURCE).agg(*[(MAD * F.percentile_approx(f"d._half_{f}", 0.5, 10_000)).alias(f"_scatter_{f}") for f in FIELDS])
    far = lambda f: times * F.coalesce(f"_scatter_{f}", F.lit(0.0))
    spike = any_of([F.coalesce((F.col(f"_reach_{f}") > far(f)) & (F.col(f"_off_{f}") > far(f) / 2), F.lit(False)) for f in FIELDS])
    why = F.array_compact(F.array(F.when(F.col("_bad"), "bounds"), F.when(F.col("_stuck"), "stuck"), F.when(spike, "spike")))
    return rows.join(scales, SOURCE, "left").withColumn("why", why).where("size(why) > 0").select(*SOURCE, "index", "why")
