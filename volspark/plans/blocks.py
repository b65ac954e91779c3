"""The fused chain on blocks of voxels: one binary row for each block, NumPy kernels in Arrow batches.

A volume is shuffled once, into blocks that overlap by what the steps along an axis need. What a step needs of a whole plane (its least and most value) is an
aggregate of the blocks' own figures, one row for each plane; the lineage is cut before it is joined back, so nothing is computed twice.
A voxel that is missing or NaN is left out, as is every result that would need it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import numeric as N
from ..functions.batches import starts, whole_groups
from ..session import written

AXES = ("z", "y", "x")
#: Voxels of a block along each axis; with eight bytes a voxel a block has 4 MB.
BLOCK = (32, 128, 128)
KEYS = ["bz", "by", "bx"]
#: A block: its number, the place of its first voxel, its extent with the overlap, its values, and of its own planes the least and most value.
SCHEMA = "bz int, by int, bx int, z int, y int, x int, depth int, height int, width int, data binary, lows array<double>, highs array<double>"
Kernel = Callable[[np.ndarray, dict], np.ndarray]


def _array(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], "<f8").reshape(row["depth"], row["height"], row["width"])


class Grid:
    """Blocks of a volume of `size`, in multiples of `factor` along y and x; `halo`: how far blocks reach before and behind along each axis."""

    def __init__(self, size: tuple[int, int, int], halo: list[tuple[int, int]], factor: int = 1, block: tuple[int, int, int] = BLOCK):
        self.size, self.halo = size, halo
        self.block = (block[0], *[max(factor, b // factor * factor) for b in block[1:]])
        self.count = [-(-n // b) for n, b in zip(size, self.block)]

    def cut(self, voxels: DataFrame, input_size: tuple[int, int, int]) -> DataFrame:
        """The blocks, with the overlap, of an input that may reach further than `size` at the end of an axis."""
        there = []
        for a, b, n, (before, behind) in zip(AXES, self.block, self.count, self.halo):
            first, last = F.greatest(F.floor((F.col(a) - behind) / b), F.lit(0)), F.least(F.floor((F.col(a) + before) / b), F.lit(n - 1))
            there.append(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>")))
        rows = voxels.select(*[F.col(a).cast("int").alias(a) for a in AXES], F.col("v").cast("double").alias("v"))
        for k, ids in zip(KEYS, there):
            rows = rows.withColumn(k, F.explode(ids))
        block, halo = self.block, self.halo

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in whole_groups(batches, KEYS):
                edges = [*np.flatnonzero(starts(t, KEYS)), t.num_rows]
                at = {c: t.column(c).to_numpy() for c in (*KEYS, *AXES, "v")}
                for lo, hi in zip(edges, edges[1:]):
                    number = [int(at[k][lo]) for k in KEYS]
                    origin = [max(0, i * b - h[0]) for i, b, h in zip(number, block, halo)]
                    end = [min(n, (i + 1) * b + h[1]) for i, b, h, n in zip(number, block, halo, input_size)]
                    a = np.full([e - o for o, e in zip(origin, end)], np.nan)
                    a[tuple(at[c][lo:hi] - o for c, o in zip(AXES, origin))] = at["v"][lo:hi]
                    yield _batch([_row(number, origin, a, None)])

        return rows.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(build, SCHEMA)

    def own(self, row: dict) -> slice:
        """The block's own planes within its extent."""
        first = row["bz"] * self.block[0]
        return slice(first - row["z"], min(self.size[0], first + self.block[0]) - row["z"])


def _row(number: list[int], origin: list[int], a: np.ndarray, own: slice | None) -> dict:
    planes = a[own].reshape(len(a[own]), -1) if own is not None else np.empty((0, 1))
    lows, highs = np.fmin.reduce(planes, axis=1, initial=np.nan), np.fmax.reduce(planes, axis=1, initial=np.nan)
    return dict(zip([*KEYS, *AXES, "depth", "height", "width"], [*number, *origin, *a.shape])) | {"data": np.ascontiguousarray(a, "<f8").tobytes(), "lows": lows.tolist(), "highs": highs.tolist()}


_ARROW = pa.schema([*[(c, pa.int32()) for c in (*KEYS, *AXES, "depth", "height", "width")], ("data", pa.binary()), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64()))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ARROW)


def apply(blocks: DataFrame, grid: Grid, kernel: Kernel) -> DataFrame:
    """A kernel on each block; it may cut the overlap off behind an axis, and before it if it moves the origin in its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                a = kernel(_array(row), row)
                yield _batch([_row([row[k] for k in KEYS], [row[c] for c in AXES], a, grid.own(row))])

    return blocks.mapInArrow(run, SCHEMA)


def plane_bounds(blocks: DataFrame, grid: Grid) -> DataFrame:
    """(z, low, high): one row for each plane, from the blocks' figures."""
    own = blocks.select((F.col("bz") * grid.block[0]).alias("first"), F.posexplode(F.arrays_zip("lows", "highs")).alias("i", "b"))
    seen = lambda c: F.when(~F.isnan(c), F.col(c))
    return own.groupBy((F.col("first") + F.col("i")).cast("int").alias("z")).agg(F.min(seen("b.lows")).alias("low"), F.max(seen("b.highs")).alias("high"))


def with_planes(blocks: DataFrame, grid: Grid, planes: DataFrame, columns: list[str]) -> DataFrame:
    """Blocks with the columns of their own planes, each an array in order of z; null values come as NaN."""
    values = F.array_sort(F.collect_list(F.struct("z", *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns])))
    by_block = planes.groupBy(F.floor(F.col("z") / grid.block[0]).cast("int").alias("bz")).agg(values.alias("_p"))
    return blocks.join(by_block, "bz").select(*blocks.columns, *[F.col(f"_p.{c}").alias(c) for c in columns])


def sliding_max(a: np.ndarray, width: int, axis: int) -> np.ndarray:
    """NaN where any of the values is."""
    return np.lib.stride_tricks.sliding_window_view(a, width, axis).max(axis=-1)


def masked(a: np.ndarray, row: dict, ratio: float, height: int, width: int, fill: float) -> np.ndarray:
    y, x = row["y"] + np.arange(a.shape[1])[:, None], row["x"] + np.arange(a.shape[2])
    away = (y - (height - 1) / 2) ** 2 + (x - (width - 1) / 2) ** 2
    return np.where((away <= (ratio * min(height, width) / 2) ** 2) | np.isnan(a), a, fill)


def denoised(a: np.ndarray, row: dict, own: slice, depth: int, gap: np.ndarray | None, threshold: float) -> np.ndarray:
    """The own planes, in which a voxel unlike both neighbours along z becomes their mean, or, without gaps, 0 where both are below the threshold."""
    z = np.arange(own.start, own.stop)
    inner = (row["z"] + z > 0) & (row["z"] + z < depth - 1)
    before, after, v = a[np.maximum(z - 1, 0)], a[np.minimum(z + 1, len(a) - 1)], a[own]
    if gap is None:
        new = np.where((before < threshold) & (after < threshold), 0.0, v)
    else:
        off = (np.abs(v - before) > gap[:, None, None]) & (np.abs(v - after) > gap[:, None, None])
        new = np.where(off, (before + after) / 2, v)
    return np.where(inner[:, None, None] & ~np.isnan(before) & ~np.isnan(after), new, v)


def stretched(a: np.ndarray, low: np.ndarray, high: np.ndarray, dtype: str) -> np.ndarray:
    """Each plane stretched to the type, as `numeric.stretch_cast`."""
    low, high = low[:, None, None], high[:, None, None]
    span = np.where(high == low, 1.0, high - low)
    if dtype in N.FLOATS:
        return ((a - low) / span).astype(dtype).astype(float)
    least, most = N.limits(dtype)
    whole = np.floor((a - low) * np.maximum((most - least) / span, 1.0))
    return np.where(np.isnan(whole), np.nan, np.mod(whole - least, most - least + 1) + least)


def binned(a: np.ndarray, factor: int, whole: bool) -> np.ndarray:
    d, h, w = a.shape[0], a.shape[1] // factor, a.shape[2] // factor
    mean = a[:, : h * factor, : w * factor].reshape(d, h, factor, w, factor)
    with np.errstate(invalid="ignore"):
        n = (~np.isnan(mean)).sum(axis=(2, 4))
        mean = np.where(n > 0, np.nansum(mean, axis=(2, 4)) / np.maximum(n, 1), np.nan)
    return np.floor(mean + 0.5) if whole else mean


def voxels_of(blocks: DataFrame, kernel: Kernel, factor: int, kind: str) -> DataFrame:
    """(z, y, x, v) of the blocks after a last kernel, which gives own planes in steps of `factor` along y and x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                a = kernel(_array(row), row)
                for k, plane in enumerate(a):
                    y, x = np.nonzero(~np.isnan(plane))
                    columns = [np.full(len(y), row["z"] + k), row["y"] // factor + y, row["x"] // factor + x]
                    yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in columns], pa.array(plane[y, x])], names=[*AXES, "v"])

    out = blocks.mapInArrow(run, "z int, y int, x int, v double")
    return out if kind == "double" else out.withColumn("v", F.col("v").cast(kind))


def run_blocks(voxels: DataFrame, spec, size: tuple[int, int, int], fill: float | None = None, block: tuple[int, int, int] = BLOCK) -> DataFrame:  # noqa: ANN001
    """The steps of a `PipelineSpec` behind the trim, over voxels (z, y, x, v) that count from 0 in a volume of `size`; `spec.bounds` stands for percentiles."""
    axis, reach, factor = AXES.index(spec.mip_axis), spec.mip - 1, 1 << spec.bin_power
    out = tuple(n - (reach if k == axis else 0) for k, n in enumerate(size))
    if min(out) <= 0:
        return voxels.sparkSession.createDataFrame([], "z int, y int, x int, v double")
    near = 1 if spec.denoise else 0
    halo = [(near if k == 0 else 0, (reach if k == axis else 0) + (near if k == 0 else 0)) for k in range(3)]
    grid = Grid(out, halo, factor, block)
    if spec.flip:  # turning the input gives the same as turning the result
        voxels = voxels.withColumn(spec.flip, (size[AXES.index(spec.flip)] - 1 - F.col(spec.flip)).cast("int"))
    bounds, ratio, mip = spec.bounds, spec.mask, spec.mip
    known = fill if fill is not None else 0.0 if bounds else None

    def first(a: np.ndarray, row: dict) -> np.ndarray:
        if bounds:
            a = (np.minimum(np.maximum(a, bounds[0]), bounds[1]) - bounds[0]) / (bounds[1] - bounds[0])
        a = sliding_max(a, mip, axis) if mip > 1 else a
        return masked(a, row, ratio, *out[1:], known) if ratio is not None and known is not None else a

    blocks = apply(grid.cut(voxels, size), grid, first)
    if ratio is not None and known is None:
        blocks = written(blocks, "blocks")
        least = plane_bounds(blocks, grid).agg(F.min("low")).first()[0]
        blocks = apply(blocks, grid, lambda a, row: masked(a, row, ratio, *out[1:], least if least is not None else 0.0))
    if spec.denoise == "threshold":
        blocks = written(blocks, "blocks")
        order = W.orderBy("z").rowsBetween(-1, 1)  # one row for each plane
        gaps = plane_bounds(blocks, grid).withColumn("gap", (F.max("high").over(order) - F.min("low").over(order)) * spec.threshold)
        blocks = _denoise(with_planes(blocks, grid, gaps, ["gap"]), grid, out[0], spec.threshold)
    elif spec.denoise == "flat":
        blocks = _denoise(blocks, grid, out[0], spec.threshold)
    dtype, whole = spec.dtype, spec.dtype in N.INTEGERS
    kind = "double" if not dtype else N.FLOATS.get(dtype) or N.INTEGERS[dtype][2]
    if factor > 1:
        kind = "bigint" if whole else "double"
    if dtype:
        blocks = written(blocks, "blocks")
        blocks = with_planes(blocks, grid, plane_bounds(blocks, grid), ["low", "high"])

    def last(a: np.ndarray, row: dict) -> np.ndarray:
        if dtype:
            a = stretched(a, np.array(row["low"], float), np.array(row["high"], float), dtype)
        return binned(a, factor, whole) if factor > 1 else a

    return voxels_of(blocks, last, factor, kind)


def _denoise(blocks: DataFrame, grid: Grid, depth: int, threshold: float) -> DataFrame:
    def kernel(a: np.ndarray, row: dict) -> np.ndarray:
        own = grid.own(row)
        new = denoised(a, row, own, depth, np.array(row["gap"], float) if "gap" in row else None, threshold)
        row["z"] += own.start
        return new

    return apply(blocks, grid, kernel)
