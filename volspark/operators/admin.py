"""File trees, sync plans, nodes, shard plans, validation and stages as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ordering import running_max

GIB = 1 << 30


# files -------------------------------------------------------------------------------------------------------------
def classify_errors(files: DataFrame, pattern: str = "err%") -> DataFrame:
    """(parent, errored): a directory is errored if any matching file isn't empty."""
    return files.where(F.col("name").like(pattern)).groupBy("parent").agg(F.bool_or(F.col("size") > 0).alias("errored"))


def scan_logs(files: DataFrame, without: list[str], larger_than: int = 93) -> DataFrame:
    """Files above a size whose name holds none of some words."""
    return files.where((F.col("size") > larger_than) & ~F.col("name").rlike("|".join(without)))


def empty_directories(directories: DataFrame, children: DataFrame, pattern: str = "%history") -> DataFrame:
    return directories.where(F.col("path").like(pattern)).join(children.select(F.col("parent").alias("path")), "path", "left_anti")


def sync_plan(local: DataFrame, remote: DataFrame, execute: bool = False) -> DataFrame:
    """(key, size, status): skipped where the remote size and both fingerprints agree, else planned or uploaded."""
    r = remote.select("key", F.col("size").alias("_s"), F.col("meta_size").alias("_ms"), F.col("meta_mtime_ns").alias("_mt"), F.lit(True).alias("_there"))
    same = F.col("_there") & (F.col("_s") == F.col("size")) & (F.col("_ms") == F.col("size").cast("string")) & (F.col("_mt") == F.col("mtime_ns").cast("string"))
    status = F.when(F.coalesce(same, F.lit(False)), "skipped").otherwise("uploaded" if execute else "planned")
    return local.join(r, "key", "left").select("key", "size", status.alias("status"))


def sync_summary(plan: DataFrame) -> DataFrame:
    """Count and bytes of each of the three statuses, 0 where there is none."""
    all_ = plan.sparkSession.createDataFrame([("planned",), ("skipped",), ("uploaded",)], "status string")
    sums = plan.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    return F.broadcast(all_).join(sums, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("object_count"), F.coalesce("b", F.lit(0)).alias("byte_count"))


def path_moves(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """(sample, step, action): old and new paths against those that exist: move, keep or blocked; and whether a sample may move at all."""
    e = existing.select("path").distinct()
    rows = paths.join(e.select(F.col("path").alias("old"), F.lit(True).alias("_o")), "old", "left").join(e.select(F.col("path").alias("new"), F.lit(True).alias("_n")), "new", "left")
    action = F.when(F.col("old") == F.col("new"), "keep").when(F.col("_o").isNull(), "keep").when(F.col("_n").isNotNull(), "blocked").otherwise("move")
    rows = rows.withColumn("action", action)
    verdict = rows.groupBy("sample").agg(F.bool_and(F.col("action") != "blocked").alias("movable"))
    return rows.join(verdict, "sample").select("sample", "step", "old", "new", "action", "movable")


def rename_plan(files: DataFrame, new: Column) -> DataFrame:
    """(path, new, collides): new names of files, null ones left out; two files of one new name collide."""
    rows = files.select("path", new.alias("new")).where("new is not null")
    twice = rows.groupBy("new").agg((F.count(F.lit(1)) > 1).alias("collides"))
    return rows.join(twice, "new").select("path", "new", "collides")


def file_fingerprints(files: DataFrame) -> DataFrame:
    """SHA-256 of the JSON list of each parent's files as (name, size, mtime_ns), by name. Directories are listings of one node, small by nature."""
    entry = lambda x: F.concat(F.lit("["), F.regexp_extract(F.to_json(F.array(x["name"])), r"(?s)^\[(.*)\]$", 1), F.lit(","), x["size"].cast("string"), F.lit(","), x["mtime_ns"].cast("string"), F.lit("]"))
    listing = F.transform(F.array_sort(F.collect_list(F.struct("name", "size", "mtime_ns"))), entry)
    return files.groupBy("parent").agg(F.sha2(F.concat(F.lit("["), F.array_join(listing, ","), F.lit("]")), 256).alias("fingerprint"))


def info_fingerprint(text: Column) -> Column:
    """SHA-256 of what makes a volume's identity in its info document: type, data type, channels, and key, resolution, offset, size and encoding of its first scale.

    Null for a text that is no JSON or has no first scale; keys that are absent count as null.
    """
    doc = F.try_parse_json(text)
    at = lambda path: F.coalesce(F.to_json(F.try_variant_get(doc, path, "variant")), F.lit("null"))
    pair = lambda name, path: F.concat(F.lit(f'"{name}":'), at(path))
    scale = [pair(k, f"$.scales[0].{k}") for k in ("encoding", "key", "resolution", "size", "voxel_offset")]
    identity = F.concat(
        F.lit("{"), F.concat_ws(",", pair("data_type", "$.data_type"), pair("num_channels", "$.num_channels"), F.concat(F.lit('"scale0":{'), F.concat_ws(",", *scale), F.lit("}")), pair("type", "$.type")), F.lit("}")
    )
    return F.when(F.try_variant_get(doc, "$.scales[0]", "variant").isNotNull(), F.sha2(identity, 256))


def scan_times(files: DataFrame) -> DataFrame:
    """First and last number of each directory's files and the difference."""
    number = F.regexp_extract("name", "([0-9]+)[^0-9]*$", 1).try_cast("bigint")
    return files.withColumn("_n", number).where("_n is not null").groupBy("parent").agg(F.min("_n").alias("first"), F.max("_n").alias("last")).withColumn("span", F.col("last") - F.col("first"))


# nodes -------------------------------------------------------------------------------------------------------------
def node_lines(lines: DataFrame) -> DataFrame:
    """(name, count, partition, status) of whitespace-separated lines; a heading and short lines are left out."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.select(p.alias("p")).where("size(p) >= 4 and p[0] <> 'NAME'")
    return rows.select(F.col("p")[0].alias("name"), F.col("p")[1].try_cast("int").alias("count"), F.col("p")[2].alias("partition"), F.col("p")[3].alias("status"))


def eligible_nodes(nodes: DataFrame, mixed: bool = False, barred: str = "sas") -> DataFrame:
    """Idle (and, if asked, mixed) nodes outside a partition, once each: the first line by `ord` counts."""
    status = F.regexp_replace("status", r"\*$", "")
    ok = (status.startswith("idle") | (F.lit(mixed) & status.startswith("mix"))) & (F.regexp_replace("partition", r"\*$", "") != barred)
    first = F.row_number().over(W.partitionBy("name").orderBy("ord"))
    return nodes.where(ok).withColumn("_k", first).where("_k = 1").select("name", "status")


def merged_nodes(sources: DataFrame) -> DataFrame:
    """Of (priority, ord, name) each name once, in its first place."""
    return sources.groupBy("name").agg(F.min(F.struct("priority", "ord")).alias("k")).select("name", "k.priority", "k.ord")


# shards and completeness -------------------------------------------------------------------------------------------
def shard_ceiling(volume_bytes: Column) -> Column:
    """2, 4 or 8 GiB for volumes up to 512 GiB, up to 1 TiB and beyond."""
    return F.when(volume_bytes <= 512 * GIB, 2 * GIB).when(volume_bytes <= 1024 * GIB, 4 * GIB).otherwise(8 * GIB)


def chunks_per_shard(ceiling: Column, chunk_bytes: Column) -> Column:
    """The largest power of two of chunks within the ceiling; null if not even one fits."""
    fits = F.floor(ceiling / chunk_bytes)
    return F.when(fits >= 1, F.pow(F.lit(2), F.floor(F.log2(fits))).cast("bigint"))


def plan_shards(volumes: DataFrame) -> DataFrame:
    """Of columns edge, itemsize, sx, sy, sz: bytes, ceiling, chunks for each shard and a shard's capacity."""
    b = F.col("sx").cast("bigint") * F.col("sy") * F.col("sz") * F.col("itemsize")
    chunk = F.pow(F.col("edge"), F.lit(3)).cast("bigint") * F.col("itemsize")
    rows = volumes.withColumns({"volume_bytes": b, "chunk_bytes": chunk}).withColumn("ceiling", shard_ceiling(F.col("volume_bytes")))
    rows = rows.withColumn("per_shard", chunks_per_shard(F.col("ceiling"), F.col("chunk_bytes")))
    return rows.withColumn("capacity", F.col("per_shard") * F.col("chunk_bytes"))


def memory_reserve(memory: Column) -> Column:
    return F.least(F.lit(24 * GIB), F.floor(memory / 4))


def workers(memory: Column, capacity: Column, asked: Column, cpus: Column, copies: int) -> Column:
    """Workers that hold `copies` shards in memory each: at least one, at most as many as asked for and CPUs."""
    room = F.greatest(F.lit(1), F.floor((memory - memory_reserve(memory)) / (capacity * copies)))
    return F.greatest(F.lit(1), F.least(asked, cpus, room))


def chunk_count(size: list[Column], chunk: list[Column]) -> Column:
    out = F.lit(1).cast("bigint")
    for n, c in zip(size, chunk):
        out = out * F.ceil(n / c)
    return out


def completeness(scales: DataFrame, objects: DataFrame) -> DataFrame:
    """(scale, expected, found, complete): raw scales must have all bytes, others all chunks. scales: scale, raw, expected_bytes, expected_chunks."""
    have = objects.groupBy("scale").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_b"))
    expected = F.when(F.col("raw"), F.col("expected_bytes")).otherwise(F.col("expected_chunks"))
    found = F.coalesce(F.when(F.col("raw"), F.col("_b")).otherwise(F.col("_n")), F.lit(0))
    return scales.join(have, "scale", "left").select("scale", expected.alias("expected"), found.alias("found"), (expected == found).alias("complete"))


#: The fields of an info document and of its scales, and the names of number types.
INFO_FIELDS = ["type", "data_type", "num_channels", "scales"]
SCALE_FIELDS = ["key", "encoding", "resolution", "voxel_offset", "size", "chunk_sizes"]
DATA_TYPES = ["uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64", "float32", "float64"]


def info_errors(text: Column, data_types: list[str] = DATA_TYPES) -> Column:
    """Messages about an info document (JSON text), in the order of its fields and then of its scales; none if it is sound."""
    doc = F.try_parse_json(text)
    get = lambda v, path: F.try_variant_get(v, f"$.{path}", "variant")
    kind = lambda v: F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("VOID"))
    whole, number = (lambda k: k == "BIGINT"), (lambda k: k.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"))
    # a field that is there and null is there: the keys tell
    keys = lambda v: F.coalesce(F.map_keys(F.from_json(F.to_json(v), "map<string,string>")), F.array().cast("array<string>"))
    shown = lambda v: F.when(kind(v) == "STRING", F.concat(F.lit("'"), v.cast("string"), F.lit("'"))).otherwise(F.coalesce(F.nullif(F.to_json(v), F.lit("null")), F.lit("None")))
    items = lambda v: F.when(kind(v) == "ARRAY", v.cast("array<variant>"))

    def scale(s: Column, mip: Column) -> Column:
        at = F.concat(F.lit("mip "), mip.cast("string"), F.lit(": "))
        say = lambda bad, what: F.when(F.coalesce(bad, F.lit(True)), F.concat(at, F.lit(what)))
        there = lambda f: F.array_contains(keys(s), f)

        def triple(f: str, positive: bool, of, word: str) -> Column:  # noqa: ANN001
            xs = items(get(s, f))
            return (
                F.when(F.coalesce(F.size(xs) != 3, F.lit(True)), F.concat(at, F.lit(f"{f} must contain three values")))
                .when(F.exists(xs, lambda x: ~of(kind(x))), F.concat(at, F.lit(f"{f} entries must be {word}")))
                .when(F.exists(xs, lambda x: x.try_cast("double") <= 0) if positive else F.lit(False), F.concat(at, F.lit(f"{f} entries must be positive")))
            )

        chunks = items(get(s, "chunk_sizes"))
        bad_chunk = lambda c: F.coalesce((F.size(items(c)) != 3) | F.exists(items(c), lambda x: ~(whole(kind(x)) & (x.try_cast("double") > 0))), F.lit(True))
        found = [
            *[say(~there(f), f"missing {f}") for f in SCALE_FIELDS],
            *[F.when(there(f), say((kind(get(s, f)) != "STRING") | (get(s, f).cast("string") == ""), f"{f} must be a non-empty string")) for f in ("key", "encoding")],
            triple("resolution", True, number, "numeric"),
            triple("voxel_offset", False, whole, "integer"),
            triple("size", True, whole, "integer"),
            say((F.size(chunks) < 1) | F.exists(chunks, bad_chunk), "invalid chunk_sizes"),
        ]
        return F.when(kind(s) != "OBJECT", F.array(F.concat(at, F.lit("scale must be an object")))).otherwise(F.array_compact(F.array(*found)))

    layer, data, channels, scales = (get(doc, f) for f in INFO_FIELDS)
    top = [
        *[F.when(~F.array_contains(keys(doc), f), F.lit(f"missing info field: {f}")) for f in INFO_FIELDS],
        F.when(F.coalesce((kind(layer) != "STRING") | ~layer.cast("string").isin("image", "segmentation"), F.lit(True)), F.concat(F.lit("unsupported layer type: "), shown(layer))),
        F.when(F.coalesce((kind(data) != "VOID") & ((kind(data) != "STRING") | ~data.cast("string").isin(*data_types)), F.lit(True)), F.concat(F.lit("invalid data_type: "), shown(data))),
        F.when(F.coalesce(~whole(kind(channels)) | (channels.try_cast("double") < 1), F.lit(True)), F.concat(F.lit("invalid num_channels: "), shown(channels))),
        F.when(F.coalesce(F.size(items(scales)) < 1, F.lit(True)), F.lit("scales must be a non-empty list")),
    ]
    each = F.coalesce(F.flatten(F.transform(items(scales), scale)), F.array().cast("array<string>"))
    return F.when(kind(doc) != "OBJECT", F.array(F.lit("info must be a JSON object"))).otherwise(F.concat(F.array_compact(F.array(*top)), each))


def field_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(field, expected, actual) where two tables of (field, value) disagree, null being a value."""
    return expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), "field", "full").where(~F.col("expected").eqNullSafe(F.col("actual")))


# stages ------------------------------------------------------------------------------------------------------------
#: The stages in their order.
STAGES = ["prep", "precompute", "downsample", "shard", "upload", "mesh"]


def stage_range(start: str = "prep", stop: str | None = None, upload: bool = True) -> list[str]:
    """A contiguous range of stages; one that begins with the upload ends there unless told otherwise."""
    last = stop or ("upload" if start == "upload" else STAGES[-1])
    a, b = STAGES.index(start), STAGES.index(last)
    if b < a:
        raise ValueError("the last stage comes before the first")
    return [s for s in STAGES[a : b + 1] if upload or s != "upload"]


def stage_decisions(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """(dataset, stage, decision): complete if the newest record is so for the same configuration and the result is there, else pending; omitted if
    not selected. wanted: dataset, stage, selected, configuration, artifact_ok; records: dataset, stage, status, configuration, ts."""
    newest = records.groupBy("dataset", "stage").agg(F.max_by(F.struct("status", "configuration"), "ts").alias("r"))
    done = (F.col("r.status") == "complete") & (F.col("r.configuration") == F.col("configuration")) & F.col("artifact_ok")
    return wanted.join(newest, ["dataset", "stage"], "left").select("dataset", "stage", F.when(~F.col("selected"), "omitted").when(F.coalesce(done, F.lit(False)), "complete").otherwise("pending").alias("decision"))


def usage_summary(samples: DataFrame, by: list[str]) -> DataFrame:
    """Peak memory and what the sample at the peak said, most processes, least memory left. samples: ts, used, processes, available."""
    peak = F.max_by(F.struct("ts", "processes"), F.struct("used", F.col("ts")))
    return samples.groupBy(*by).agg(F.max("used").alias("peak"), peak.alias("_p"), F.max("processes").alias("most_processes"), F.min("available").alias("least_available"), F.count(F.lit(1)).alias("samples")).select(
        *by, "peak", F.col("_p.ts").alias("peak_at"), F.col("_p.processes").alias("processes_at_peak"), "most_processes", "least_available", "samples"
    )


def tally(events: DataFrame, total: int, block: int = 4096) -> DataFrame:
    """Completions so far, never falling and never above the total. events: ord (a whole number), done. A window covers `block` numbers of ord."""
    return running_max(events, "ord", F.floor(F.col("ord") / block), "done", "shown").withColumn("shown", F.least("shown", F.lit(total)))


# selections --------------------------------------------------------------------------------------------------------
def with_prefixes(rows: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose name begins with any of some distinct prefixes; none for an empty list."""
    hit = F.lit(False)
    for p in dict.fromkeys(prefixes):
        hit = hit | F.col(column).startswith(p)
    return rows.where(hit)


def idle_nodes(lines: DataFrame, states: tuple[str, ...] = ("idle", "mix")) -> DataFrame:
    """First words of lines whose last word is one of some states."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.where(F.element_at(p, -1).isin(*states)).select(p[0].alias("name"))


def node_range(prefix: str, start: int, stop: int, spark) -> DataFrame:  # noqa: ANN001
    """Names of numbered nodes, the last included."""
    return spark.range(start, stop + 1).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("name"))


def datasets(directories: DataFrame, derived: tuple[str, ...]) -> DataFrame:
    """Directories that aren't hidden and whose name has no ending of derived data."""
    rows = directories.where(~F.col("name").startswith("."))
    for ending in derived:
        rows = rows.where(~F.col("name").endswith(ending))
    return rows


def present_scales(scales: DataFrame, files: DataFrame) -> DataFrame:
    """(scale, expected, there): expected scales and those found as directories of files, all of either side."""
    a = scales.select("scale", F.lit(True).alias("expected")).distinct()
    b = files.select(F.col("parent").alias("scale"), F.lit(True).alias("there")).distinct()
    return a.join(b, "scale", "full").select("scale", F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("there", F.lit(False)).alias("there"))


def remaining(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to be done."""
    return expected.join(done.select(key), key, "left_anti")


def successes(responses: DataFrame) -> DataFrame:
    """(ok, n): responses by whether their status is 200 to 299."""
    return responses.groupBy(F.coalesce((F.col("status") >= 200) & (F.col("status") < 300), F.lit(False)).alias("ok")).agg(F.count(F.lit(1)).alias("n"))
