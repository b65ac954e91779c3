"""The fused chain of volume operators, with the rewrites that the optimizer can't find.

Order: normalize, trim, sliding maximum, mask, denoise, flip, convert, bin. Steps that change nothing are left out. A range of output
planes is turned into the range of input planes it needs (`input_range`) before any voxel is read, as no filter is pushed through the windows along z.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import volume as V
from . import blocks

@dataclass(frozen=True)
class PipelineSpec:
    normalize: tuple[float, float] | None = None
    bounds: tuple[float, float] | None = None  # given instead of percentiles
    trim_z: tuple[float | int, float | int] = (0, 0)
    trim_y: tuple[float | int, float | int] = (0, 0)
    trim_x: tuple[float | int, float | int] = (0, 0)
    mip: int = 1
    mip_axis: str = "z"
    mask: float | None = None
    denoise: str | None = None  # threshold or flat
    threshold: float = 0.5
    flip: str | None = None
    dtype: str | None = "uint8"
    bin_power: int = 0

    def validate(self) -> PipelineSpec:
        if self.normalize and not 0 <= self.normalize[0] < self.normalize[1] <= 100:
            raise ValueError("percentiles must rise within 0..100")
        if self.denoise not in (None, "threshold", "flat"):
            raise ValueError("denoise is threshold or flat")
        if self.mip < 0 or self.bin_power < 0 or self.mip_axis not in V.AXES or self.flip not in (None, *V.AXES):
            raise ValueError("impossible width, power or axis")
        return self

    def simplified(self) -> PipelineSpec:
        """Without steps that change nothing."""
        return replace(self, mip=max(1, self.mip), mask=None if self.mask is None else self.mask)

    def input_range(self, first: int, last: int, depth: int) -> tuple[int, int]:
        """The planes of the input that output planes first..last-1 are made of."""
        lo, hi = N.crop_bounds(self.trim_z, depth)
        out = hi - lo - (self.mip - 1 if self.mip_axis == "z" else 0)
        if self.flip == "z":
            first, last = out - last, out - first
        if self.denoise:
            first, last = max(0, first - 1), min(out, last + 1)
        if self.mip_axis == "z":
            last += self.mip - 1
        return lo + first, lo + last

    def output_depth(self, depth: int) -> int:
        lo, hi = N.crop_bounds(self.trim_z, depth)
        return hi - lo - (self.mip - 1 if self.mip_axis == "z" else 0)


def output_names(names: list[str], spec: PipelineSpec) -> list[str]:
    """Names of the output planes without reading any: of the trailing input of each maximum, reversed values in ascending names for a flip."""
    lo, hi = N.crop_bounds(spec.trim_z, len(names))
    kept = names[lo:hi]
    return kept[spec.mip - 1 :] if spec.mip_axis == "z" else kept


def run(df: DataFrame, spec: PipelineSpec, size: tuple[int, int, int], fill: float | None = None, block: tuple[int, int, int] = blocks.BLOCK) -> DataFrame:
    """The chain over a volume of the given size, on blocks; (z, y, x, v). `fill`: for masked voxels, where it isn't to be found."""
    spec = spec.validate().simplified()
    rows = df.select("z", "y", "x", F.col("v").cast("double").alias("v"))
    if spec.normalize and not spec.bounds:
        spec = replace(spec, bounds=tuple(N.exact_percentiles(rows, "v", list(spec.normalize))))
    crops = dict(zip(V.AXES, (spec.trim_z, spec.trim_y, spec.trim_x)))
    rows = V.trim(rows, size, **crops)
    kept = tuple((lambda c: c[1] - c[0])(N.crop_bounds(crops[a], n)) for a, n in zip(V.AXES, size))
    return blocks.run_blocks(rows, spec, kept, fill, block)


def run_range(df: DataFrame, spec: PipelineSpec, size: tuple[int, int, int], first: int, last: int) -> DataFrame:
    """Output planes first..last-1 of the chain, from no more input planes than they need.

    What depends on the whole volume (percentiles, the fill of masked voxels) is found first, over all of it.
    """
    spec = spec.validate().simplified()
    bounds = spec.bounds or (tuple(N.exact_percentiles(df, "v", list(spec.normalize))) if spec.normalize else None)
    fill = 0.0
    if spec.mask is not None and bounds is None:
        fill = run(df, replace(spec, mask=None, denoise=None, flip=None, dtype=None, bin_power=0), size).agg(F.min("v")).first()[0]
    lo, hi = spec.input_range(first, last, size[0])
    part = replace(spec, normalize=None, bounds=bounds, trim_z=(0, 0))
    cut = df.where((F.col("z") >= lo) & (F.col("z") < hi)).withColumn("z", (F.col("z") - lo).cast("int"))
    rows = run(cut, part, (hi - lo, *size[1:]), fill)
    begin = lo - N.crop_bounds(spec.trim_z, size[0])[0]
    if spec.flip == "z":
        begin = spec.output_depth(size[0]) - begin - part.output_depth(hi - lo)
    return rows.withColumn("z", (F.col("z") + begin).cast("int")).where((F.col("z") >= first) & (F.col("z") < last))
