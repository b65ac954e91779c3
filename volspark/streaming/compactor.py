"""Turning far too many small files into few well-sized ones.

`StreamingCompactor` is a checkpointed file stream: the checkpoint records each input file once, a run processes what is there
and ends, and every micro-batch overwrites a directory named after its number, so a batch that is tried again after a failure
replaces its first attempt. `compact_files` uses it for tables; `SliceCompactor` plans the consolidation
of image stacks and `Containers` carries it out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import additive, additive_names
from ..operators.ordering import running_total
from ..session import Files, scratch, written

TINY, LARGEST = 1 << 20, 128 << 20


class StreamingCompactor:
    """Reads each file of `source` once and writes each batch's rows below `out/batch=N`.

    A file is known by its path, whatever its age; one that is written anew at the same path isn't read again. The names that were read stay in
    the checkpoint's log and in the driver, as with every file stream: some hundred bytes a file.
    """

    #: A file stream passes over files older than this before the newest; copied files may have any time.
    ANY_AGE = "365000d"

    def __init__(self, spark: SparkSession, out: str, checkpoint: str, files_per_batch: int = 10_000, source_format: str = "parquet", options: dict[str, str] | None = None):
        self.spark, self.out, self.checkpoint = spark, out.rstrip("/"), checkpoint
        self.files_per_batch, self.source_format, self.options = files_per_batch, source_format, options or {}

    def run(self, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], fail_at: int | None = None) -> None:
        """Process all files that are there. `fail_at` breaks off after that batch was written and before it was recorded."""

        def write(batch: DataFrame, number: int) -> None:
            transform(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.out}/batch={number}")
            if number == fail_at:
                raise RuntimeError("failed before the batch was recorded, as asked")

        reader = self.spark.readStream.format(self.source_format).schema(schema).option("maxFilesPerTrigger", self.files_per_batch)
        reader = reader.option("maxFileAge", self.ANY_AGE).options(**self.options)
        if Files(self.spark, source).is_file(source):  # a stream watches directories: that of the file, for its name
            above, _, name = source.rpartition("/")
            stream = reader.option("pathGlobFilter", name).load(above)
        else:
            stream = reader.load(source)
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    def recorded(self) -> DataFrame:
        """(path): the files that the checkpoint has recorded as read."""
        log = f"{self.checkpoint}/sources/0"
        if not Files(self.spark, log).exists(log):
            return self.spark.createDataFrame([], "path string")
        entries = self.spark.read.text(log).select(F.get_json_object("value", "$.path").alias("path"))
        return entries.where("path is not null").distinct()

    def unread(self, source: str) -> DataFrame:
        """(path): the files below `source` that no run has read; the listing is spread over the executors where it is long."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path")
        form = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        # the log has addresses, the listing plain paths; a plus stands for itself
        known = self.recorded().select(form(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("_p"))
        return listed.join(known, form(F.col("path")) == F.col("_p"), "left_anti")

    def read(self, schema: T.StructType) -> DataFrame:
        if not Files(self.spark, self.out).exists(self.out):
            return self.spark.createDataFrame([], schema)
        # the batches' directories are no column, whatever columns the rows have
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.out)


#: How a scan packs files into tasks: by their bytes alone, up to the size that is asked for.
_PACKING = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}


def compact_files(
    spark: SparkSession, source: str, out: str, checkpoint: str, schema: T.StructType, bytes_per_file: int = LARGEST, files_per_batch: int = 10_000, source_format: str = "parquet", fail_at: int | None = None
) -> StreamingCompactor:
    """Copy the rows of many small files into files made of about `bytes_per_file` bytes of input each; nothing is lost or doubled, even if a run fails.

    The scan packs files into tasks by their size, and each task writes one file: each input is read once, nothing is shuffled or counted.
    An empty source gives an empty table; all columns, null values and repeated rows are kept as they are; a file counts however old it is.
    """
    compactor = StreamingCompactor(spark, out, checkpoint, files_per_batch, source_format)
    wanted = _PACKING | {"spark.sql.files.maxPartitionBytes": str(bytes_per_file)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        compactor.run(source, schema, lambda batch: batch, fail_at)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return compactor


SLICE = (
    T.StructType()
    .add("stack_id", T.StringType())
    .add("slice_no", T.LongType())
    .add("file_id", T.LongType())
    .add("output_name", T.StringType())
    .add("size", T.LongType())
    .add("written_at", T.TimestampType())
)
#: The number that stands directly before the ending.
SLICE_NAME = r"([0-9]+)\.[tT][iI][fF][fF]?\z"


def finished(files: DataFrame) -> DataFrame:
    """The finished slice files: a size above 0 and a name that ends in a number before `.tif` or `.tiff`.

    Rows with a null stack, name or size are none, nor is a number beyond 64 bits.
    """
    digits = F.regexp_extract("output_name", SLICE_NAME, 1)
    return (
        files.where("stack_id is not null and output_name is not null and size > 0")
        .withColumn("slice_no", digits.try_cast("bigint"))
        .where("slice_no is not null")
        .select(*SLICE.names)
    )


def standing(files: DataFrame) -> DataFrame:
    """Of several files of a slice the one with the latest `written_at` (null the earliest), then the largest `file_id`."""
    best = F.max(F.struct("written_at", "file_id", "output_name", "size")).alias("s")
    return files.groupBy("stack_id", "slice_no").agg(best).select("stack_id", "slice_no", "s.file_id", "s.output_name", "s.size", "s.written_at")


class SliceCompactor:
    """Consolidates the tiny slice files of stacks, of which `inventory` lists every file in one or many files.

    Each batch is reduced to the standing file of each slice it lists; the batches together give the standing files, so a
    late line replaces an earlier file without reading the inventory again.
    """

    def __init__(self, spark: SparkSession, root: str, files_per_batch: int = 10_000):
        root = root.rstrip("/")
        self.spark, self.compactor = spark, StreamingCompactor(spark, f"{root}/slices", f"{root}/checkpoint", files_per_batch)

    def discover(self, inventory: str, schema: T.StructType, fail_at: int | None = None) -> None:
        self.compactor.run(inventory, schema, lambda batch: standing(finished(batch)), fail_at)

    def plan(self, tiny: int = TINY, largest: int = LARGEST) -> DataFrame:
        """(stack_id, slice_no, file_id, output_name, size, container, container_name): each tiny slice in exactly one container.

        A container takes the slices of a stack that begin in the same `largest - tiny` bytes of their concatenation in slice order; as a slice is
        smaller than `tiny`, none outgrows `largest`. The concatenation's offsets come from blocks of slices, whatever the size of a stack.
        """
        tiny_ones = standing(self.compactor.read(SLICE)).where(F.col("size") < tiny)
        # floor of the quotient, also below 0: a block must rise with the slice number
        placed = running_total(tiny_ones, ["stack_id"], "slice_no", F.floor(F.col("slice_no") / 4096), {"_start": F.col("size")})
        number = F.floor(F.col("_start") / (largest - tiny))
        return placed.select(
            "stack_id", "slice_no", "file_id", "output_name", "size", number.alias("container"), F.concat("stack_id", F.lit("_"), F.lpad(number.cast("string"), F.greatest(F.lit(6), F.length(number.cast("string"))), F.lit("0")), F.lit(".pack")).alias("container_name")
        )


class Containers:
    """The files of a plan below `root`: `data/` holds each container under the fingerprint of its slices, and the newest `manifest` says which stand.

    A container whose slices are those of the version before is not written again. A new version shows by one exclusive file, after all it
    names was written: readers have the old containers or the new ones, each slice in exactly one, also if a run dies in between.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def _versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self.files.names(f"{self.root}/versions") if n.startswith("v="))

    def _manifest(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.root}/manifests/{self.files.read_text(f'{self.root}/versions/v={versions[-1]}')}") if versions else None

    def write(self, plan: DataFrame, contents: DataFrame, fail_before_commit: bool = False) -> int:
        """Carry out a plan: `contents` (file_id, content binary) are joined to their slices, each container is one file of rows in slice order.

        Gives the number of containers written. A slice whose content is missing raises before the commit. Raises too if another call has committed meanwhile.
        """
        version = (self._versions() or [0])[-1] + 1
        plan = written(plan.drop("print"), "plan")
        line = F.xxhash64("slice_no", "file_id", "size")
        prints = plan.groupBy("stack_id", "container").agg(F.count(F.lit(1)).alias("slices"), *additive(line, "h"))
        named = prints.select("stack_id", "container", "slices", F.sha2(F.to_json(F.struct("stack_id", "container", "slices", *additive_names("h"))), 224).alias("print"))
        named = written(named, "containers")
        old = self._manifest()
        new = named if old is None else named.join(old, "print", "left_anti")
        token = uuid.uuid4().hex
        rows = plan.join(new.select("stack_id", "container", "print"), ["stack_id", "container"]).join(contents.select("file_id", "content"), "file_id")
        (
            rows.repartition("print")
            .sortWithinPartitions("print", "slice_no")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("print")
            .parquet(f"{self.root}/data")
        )
        count = new.count()
        if count:
            held = self._data(new).groupBy("print").agg(F.count(F.lit(1)).alias("held"))
            if new.join(held, "print", "left").where("held is distinct from slices").limit(1).count():
                raise RuntimeError("contents of some slices are missing or doubled")
        named.write.parquet(f"{self.root}/manifests/{token}")
        if fail_before_commit:
            raise RuntimeError("failed before the commit, as asked")
        if not self.files.publish(f"{self.root}/versions/v={version}", token):
            raise RuntimeError(f"another call has committed version {version}")
        return count

    def _data(self, manifest: DataFrame) -> DataFrame:
        columns = "container bigint, container_name string, content binary, print string"
        schema = T.StructType([*[f for f in SLICE.fields if f.name != "written_at"], *T.StructType.fromDDL(columns).fields])
        if not self.files.exists(f"{self.root}/data"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/data").join(manifest.select("print"), "print", "left_semi")

    def read(self) -> DataFrame:
        """The rows of the standing containers; partitions of others aren't opened."""
        manifest = self._manifest()
        if manifest is None:
            manifest = self.spark.createDataFrame([], "print string")
        return self._data(manifest)

    def vacuum(self) -> int:
        """Delete containers that neither of the last two versions names; gives their number. Not while another call writes."""
        kept = [self.spark.read.parquet(f"{self.root}/manifests/{self.files.read_text(f'{self.root}/versions/v={v}')}").select("print") for v in self._versions()[-2:]]
        if not kept:
            return 0
        there = self.spark.createDataFrame([(n[6:],) for n in self.files.names(f"{self.root}/data") if n.startswith("print=")], "print string")
        n = 0
        for r in there.join(reduce(DataFrame.unionByName, kept), "print", "left_anti").toLocalIterator():
            self.files.delete(f"{self.root}/data/print={r[0]}")
            n += 1
        return n


def compact_inventory(spark: SparkSession, inventory: str, root: str | None = None) -> DataFrame:
    """The plan for the inventory at a path, by a compactor in the shared folder if no root is given."""
    compactor = SliceCompactor(spark, root or scratch(spark, "compactor"))
    compactor.discover(inventory, spark.read.parquet(inventory).schema)
    return compactor.plan()
