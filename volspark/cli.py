"""Commands: `python -m volspark.cli CATEGORY TASK ...`. Without --execute a command that writes shows its plan only."""

from __future__ import annotations

import argparse
import csv
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric as N
from .functions import stencils as S
from .operators import admin, flats, metadata, mesh
from .operators import volume as V
from .plans import spec as P
from .session import local_session
from .sources import formats, optional

TASKS: dict[tuple[str, str], tuple[Callable, Callable]] = {}


def task(category: str, name: str, *options: tuple):  # noqa: ANN201
    def add(f: Callable) -> Callable:
        def build(p: argparse.ArgumentParser) -> None:
            for flags, how in options:
                p.add_argument(*([flags] if isinstance(flags, str) else flags), **how)

        TASKS[(category, name)] = (build, f)
        return f

    return add


def crop(text: str) -> tuple[float | int, float | int]:
    parts = [int(t) if t.strip().isdigit() else float(t) for t in text.split(",")]
    return parts[0], parts[-1]


def pair(text: str) -> tuple[float, float]:
    a, b = map(float, text.split(","))
    return a, b


IN, OUT, RUN = ("source", {}), ("target", {}), ("--execute", {"action": "store_true"})
NEEDS = {"required": True}


def planes(spark: SparkSession, path: str, order: str = "natural") -> DataFrame:
    return spark.read.format("tiffstack").option("order", order).load(path)


def save(df: DataFrame, target: str, dtype: str, execute: bool, compression: str = "none") -> None:
    """Voxels as an image stack."""
    rows = V.planes(df).select("z", F.lit(None).cast("string").alias("name"), "height", "width", F.lit(dtype).alias("dtype"), "pixels")
    if not execute:
        rows.explain("formatted")
        print(f"would write {target}")
        return
    rows.write.format("tiffstack").mode("overwrite").option("path", target).option("compression", compression).save()


def print_rows(rows: DataFrame) -> None:
    """Every row, separated by tabs below the names of the columns."""
    out = csv.writer(sys.stdout, delimiter="\t", lineterminator="\n")
    out.writerow(rows.columns)
    out.writerows(rows.toLocalIterator())


def dtype_of(p: DataFrame) -> str:
    kinds = [r[0] for r in p.select("dtype").distinct().limit(2).collect()]
    if len(kinds) != 1:
        raise SystemExit("the planes differ in type")
    return kinds[0]


def size_of(p: DataFrame) -> tuple[int, int, int]:
    depth, h0, h1, w0, w1 = p.agg(F.count(F.lit(1)), F.min("height"), F.max("height"), F.min("width"), F.max("width")).first()
    if (h0, w0) != (h1, w1):
        raise SystemExit("the planes differ in size")
    return depth, h0, w0


@task(
    "transform", "pipeline", ("--data-dir", NEEDS), ("--output-dir", NEEDS), ("--normalize-over", {"type": pair}), ("--vertical-trim", {"type": crop, "default": (0, 0)}), ("--horizontal-trim", {"type": crop, "default": (0, 0)}),
    ("--z-trim", {"type": crop, "default": (0, 0)}), ("--mips", {"type": int, "default": 0}), ("--mips-axis", {"default": "z"}), ("--circ-mask-ratio", {"type": float}), ("--denoise-mode", {}), ("--denoise-threshold", {"type": float, "default": 0.5}),
    ("--flip-axis", {}), ("--out-dtype", {"default": "uint8"}), ("--bin-power", {"type": int, "default": 0}), ("--compressed", {"action": "store_true"}), RUN,
)
def pipeline(spark: SparkSession, a: argparse.Namespace) -> None:
    p = planes(spark, a.data_dir)
    s = P.PipelineSpec(a.normalize_over, None, a.z_trim, a.vertical_trim, a.horizontal_trim, max(1, a.mips), a.mips_axis, a.circ_mask_ratio, a.denoise_mode, a.denoise_threshold, a.flip_axis, a.out_dtype, a.bin_power)
    save(P.run(V.voxels(p), s, size_of(p)), a.output_dir, a.out_dtype, a.execute, "zlib" if a.compressed else "none")


@task("transform", "normalize", ("--data-dir", NEEDS), ("--output-dir", NEEDS), ("--normalize-over", {"type": pair, "default": (5.0, 95.0)}), ("--batch", {"type": int, "default": 16}), RUN)
def normalize(spark: SparkSession, a: argparse.Namespace) -> None:
    p = planes(spark, a.data_dir)
    dtype = dtype_of(p)
    save(V.stretch(V.normalize_batches(V.voxels(p), *a.normalize_over, a.batch), dtype), a.output_dir, dtype, a.execute)


@task("transform", "trim", ("--data-dir", NEEDS), ("--output-dir", NEEDS), ("--vertical-trim", {"type": crop, "default": (0, 0)}), ("--horizontal-trim", {"type": crop, "default": (0, 0)}), ("--z-trim", {"type": crop, "default": (0, 0)}), RUN)
def trim(spark: SparkSession, a: argparse.Namespace) -> None:
    p = planes(spark, a.data_dir)
    save(V.trim(V.voxels(p), size_of(p), z=a.z_trim, y=a.vertical_trim, x=a.horizontal_trim), a.output_dir, dtype_of(p), a.execute)


@task("transform", "convert", IN, OUT, ("--output-type", NEEDS), ("--uncompressed", {"action": "store_true"}), RUN)
def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    save(V.stretch(V.voxels(planes(spark, a.source)), a.output_type), a.target, a.output_type, a.execute, "none" if a.uncompressed else "zlib")


@task("transform", "flip", IN, OUT, ("--flip-axis", NEEDS), RUN)
def flip(spark: SparkSession, a: argparse.Namespace) -> None:
    p = planes(spark, a.source)
    save(V.flip(V.voxels(p), a.flip_axis, dict(zip("zyx", size_of(p)))[a.flip_axis]), a.target, dtype_of(p), a.execute)


@task("transform", "transpose", IN, OUT, ("--stack-start", {"type": int, "default": 0}), ("--stack-levels", {"type": int}), ("--pixel-shift", {"type": float, "default": 0.0}), RUN)
def transpose(spark: SparkSession, a: argparse.Namespace) -> None:
    p = planes(spark, a.source)
    v = V.voxels(p)
    save(V.transpose(v) if a.stack_levels is None else V.transpose_shift(v, a.stack_start, a.stack_levels, a.pixel_shift), a.target, dtype_of(p), a.execute)


@task("transform", "denoise", IN, OUT, ("--threshold", {"type": float, "default": 0.5}), ("--flat-denoise", {"action": "store_true"}), RUN)
def denoise(spark: SparkSession, a: argparse.Namespace) -> None:
    p = planes(spark, a.source)
    dtype = dtype_of(p)
    v = V.voxels(p)
    save(V.denoise_flat(v, a.threshold, "drop") if a.flat_denoise else V.denoise_threshold(v, a.threshold, "drop", dtype not in N.FLOATS), a.target, dtype, a.execute)


@task("transform", "find-bounds", IN)
def find_bounds(spark: SparkSession, a: argparse.Namespace) -> None:
    V.bounds(V.voxels(planes(spark, a.source))).show()


@task("transform", "reslice", IN, OUT, ("--reslice", {"required": True, "help": "x,y,z"}), RUN)
def reslice(spark: SparkSession, a: argparse.Namespace) -> None:
    p = planes(spark, a.source)
    rows = V.reslice(V.voxels(p), tuple(map(int, a.reslice.split(","))), size_of(p))
    for name in ("xy", "xz", "yz"):
        save(rows.where(F.col("plane") == name).select(F.lit(0).alias("z"), F.col("row").alias("y"), F.col("col").alias("x"), "v"), f"{a.target}/{name}", dtype_of(p), a.execute)


@task("transform", "stitch-reconstructions", ("stack_a", {}), ("stack_b", {}), OUT, ("--a-stop", {"type": int, "required": True}), ("--b-start", {"type": int, "required": True}), ("--dtype", {}), RUN)
def stitch_reconstructions(spark: SparkSession, a: argparse.Namespace) -> None:
    p, q = (planes(spark, s, "stem") for s in (a.stack_a, a.stack_b))
    rows = flats.concat_stacks(V.voxels(p), V.voxels(q), a.a_stop, a.b_start).drop("source")
    save(rows.withColumn("v", N.saturating_cast(F.col("v"), a.dtype)) if a.dtype else rows, a.target, a.dtype or dtype_of(p.unionByName(q)), a.execute)


@task("transform", "stack-split", IN, OUT, RUN)
def stack_split(spark: SparkSession, a: argparse.Namespace) -> None:
    p = planes(spark, a.source)
    save(V.voxels(p), a.target, dtype_of(p), a.execute)


@task("transform", "raw-convert", IN, OUT, ("--width", NEEDS), ("--height", NEEDS), ("--depth", NEEDS), ("--dtype", NEEDS), ("--byte-order", {"default": "native"}), ("--header-bytes", {"default": "0"}), RUN)
def raw_convert(spark: SparkSession, a: argparse.Namespace) -> None:
    p = spark.read.format("rawvolume").options(width=a.width, height=a.height, depth=a.depth, dtype=a.dtype, byteOrder=a.byte_order, headerBytes=a.header_bytes).load(a.source)
    save(V.voxels(p), a.target, a.dtype, a.execute)


@task("transform", "channelize", IN, OUT, ("--weights", {"type": lambda t: [float(x) for x in t.split(",")]}), RUN)
def channelize(spark: SparkSession, a: argparse.Namespace) -> None:
    p = planes(spark, a.source)
    rows = V.channelize(V.voxels(p), a.weights)
    for c in range(3):
        save(rows.where(F.col("c") == c).drop("c"), f"{a.target}/{c}", dtype_of(p), a.execute)


@task("transform", "remove-noise", IN, OUT, ("--patch", {"type": int, "default": 9}), ("--distance", {"type": int, "default": 5}), RUN)
def remove_noise(spark: SparkSession, a: argparse.Namespace) -> None:
    p = planes(spark, a.source)
    save(V.voxels(S.apply_planes(p, lambda i: S.non_local_means(i, a.patch, a.distance))), a.target, dtype_of(p), a.execute)


@task("flats", "medianize", IN, OUT, RUN)
def medianize(spark: SparkSession, a: argparse.Namespace) -> None:
    p = planes(spark, a.source)
    group = F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), "_[^_]*$", "")
    rows = flats.medianize(V.voxels(p).join(p.select("z", group.alias("g")), "z"), ["g"])
    for g in [r[0] for r in p.select(group).distinct().collect()]:
        save(rows.where(F.col("g") == g).select(F.lit(0).alias("z"), "y", "x", "v"), f"{a.target}/{g}", dtype_of(p), a.execute)


@task("flats", "series-digest", IN, ("--keep", {"type": int, "default": 120}), ("--median-window", {"type": int, "default": 5}), ("--out", {"default": "."}), RUN)
def series_digest(spark: SparkSession, a: argparse.Namespace) -> None:
    p = planes(spark, a.source)
    track = flats.centroids(flats.digest(V.voxels(p), size_of(p)[0], a.keep, a.median_window), "centre")
    table = flats.drift(track, "centre")
    if a.execute:
        table.coalesce(1).sort("frame_index").write.mode("overwrite").csv(f"{a.out}/drift_trajectory", header=True)
    flats.drift_summary(table).show()


@task("ng", "precompute", IN, OUT, ("--chunk-size", {"default": "512,512,1"}), ("--voxel-resolution", {"default": "700,700,700"}), ("--voxel-offset", {"default": "0,0,0"}), ("--layer-type", {"default": "image"}),
      ("--levels", {"type": int, "default": 0, "help": "further scales, each of half the extent"}), ("--chunks-per-shard", {"type": int, "default": 0, "help": "0: one file for each chunk"}), RUN)
def precompute(spark: SparkSession, a: argparse.Namespace) -> None:
    p = planes(spark, a.source)
    ints = lambda t: [int(x) for x in t.split(",")]
    size = list(reversed(size_of(p)))
    info = formats.info_document(a.layer_type, dtype_of(p), size, [min(c, n) for c, n in zip(ints(a.chunk_size), size)], ints(a.voxel_resolution), ints(a.voxel_offset))
    info = formats.with_scales(info, a.levels)
    info = formats.with_shards(info, a.chunks_per_shard) if a.chunks_per_shard else info
    print(info)
    if a.execute:
        formats.write_pyramid(V.voxels(p), a.target, info, a.layer_type == "segmentation")


@task("transform", "memmap-prep", IN, OUT, ("--out-dtypes", {"default": "uint8"}), ("--normalize", {"default": "none"}), ("--low", {"type": float}), ("--high", {"type": float}), RUN)
def memmap_prep(spark: SparkSession, a: argparse.Namespace) -> None:
    v = V.voxels(planes(spark, a.source))
    if a.execute:
        v = v.persist()  # one reading for several outputs
    for dtype, rows in V.as_types(v, a.out_dtypes.split(","), a.normalize, a.low, a.high).items():
        save(rows, f"{a.target}/{dtype}", dtype, a.execute)
    v.unpersist()


@task("ng", "fetch", IN, OUT, ("--region", {"required": True, "help": "z0:z1,y0:y1,x0:x1"}), ("--out-dtype", {}), ("--transpose-axes", {"action": "store_true"}), RUN)
def fetch(spark: SparkSession, a: argparse.Namespace) -> None:
    first, last = zip(*[map(int, t.split(":")) for t in a.region.split(",")])
    save(V.fetch(spark.read.format("chunkedvolume").load(a.source), list(first), list(last), a.out_dtype, a.transpose_axes), a.target, a.out_dtype or "float64", a.execute)


@task("ng", "validate", IN, ("--mip", {"type": int, "default": 0}))
def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    v = spark.read.format("chunkedvolume").option("mip", a.mip).load(a.source)
    v.agg(F.count("v"), F.min("v"), F.max("v"), F.avg("v"), F.count_if(F.col("v") != 0)).show()


@task("mesh", "build", IN, OUT, ("--dust-threshold", {"type": int, "default": 0}), ("--num-lod", {"type": int, "default": 1}), RUN)
def build_mesh(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = mesh.levels_of_detail(spark.read.format("chunkedvolume").load(a.source).withColumn("v", F.col("v").cast("bigint")), a.num_lod, a.dust_threshold)
    rows.write.mode("overwrite").partitionBy("lod").parquet(a.target) if a.execute else rows.explain("formatted")


@task("parse", "find-errs", IN, ("--pattern", {"default": "err%"}))
def find_errs(spark: SparkSession, a: argparse.Namespace) -> None:
    print_rows(admin.classify_errors(spark.read.format("filetree").load(a.source), a.pattern).sort("parent"))


@task("transport", "sync-plan", IN, ("remote", {"help": "table of key, size, meta_size, meta_mtime_ns"}), ("--prefix", {"default": ""}))
def sync_plan(spark: SparkSession, a: argparse.Namespace) -> None:
    local = spark.read.format("filetree").option("prefix", a.prefix).load(a.source)
    admin.sync_summary(admin.sync_plan(local, spark.read.parquet(a.remote))).show()


def tree_rows(nodes: DataFrame, path: str, max_values: int) -> DataFrame:
    """The nodes in order, crowded groups collapsed; of an asked path all that lies below."""
    rows = metadata.select_path(nodes, path, max_values)
    return (rows if path else metadata.collapsed(rows)).sort("file", "visit")


@task("als832", "h5-tree", IN, ("--path", {"default": ""}), ("--max-values", {"type": int, "default": 16}))
def h5_tree(spark: SparkSession, a: argparse.Namespace) -> None:
    optional.register(spark)
    nodes = spark.read.format("h5nodes").options(select=a.path, maxValues=a.max_values).load(a.source)
    print_rows(tree_rows(nodes, a.path, a.max_values))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="volspark")
    categories = top.add_subparsers(dest="category", required=True)
    made: dict[str, argparse._SubParsersAction] = {}
    for (category, name), (build, _) in TASKS.items():
        if category not in made:
            made[category] = categories.add_parser(category).add_subparsers(dest="task", required=True)
        build(made[category].add_parser(name))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or local_session()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    formats.register(spark)
    TASKS[(a.category, a.task)][1](spark, a)


if __name__ == "__main__":
    main(sys.argv[1:])
