"""Data sources and sinks: image stacks, raw volumes, file trees and chunked volumes.

Each is a Python data source: its plan lists files or byte ranges on the driver, its tasks read no more than their own. Register them with `register`.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.batches import starts, whole_groups
from ..functions.numeric import ITEM_BYTES
from . import sharded, tiff

PLANE = "z int, name string, height int, width int, dtype string, pixels array<double>"


def natural(name: str) -> list:
    return [(0, int(t), "") if t.isdigit() else (1, 0, t.lower()) for t in re.findall(r"\d+|\D+", name)]


def listing(path: str, order: str) -> list[str]:
    """Image files of a directory: by name, or naturally by name or stem (two files of one stem raise)."""
    if os.path.isfile(path):
        return [path]
    names = [n for n in os.listdir(path) if n.lower().endswith((".tif", ".tiff"))]
    if not names:
        raise ValueError(f"no image files in {path}")
    if order == "name":
        names.sort()
    else:
        key = (lambda n: natural(os.path.splitext(n)[0])) if order == "stem" else natural
        names.sort(key=key)
        if order == "stem" and any(key(a) == key(b) for a, b in zip(names, names[1:])):
            raise ValueError("the order of the files is ambiguous")
    return [os.path.join(path, n) for n in names]


@dataclass
class Range:
    """Bounds that filters put on an integer column."""

    low: int = 0
    high: int = 1 << 62

    def take(self, f: Filter, column: str) -> bool:
        if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or tuple(f.attribute) != (column,) or f.value is None:
            return False
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, int(f.value) + isinstance(f, GreaterThan))
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self.high = min(self.high, int(f.value) + (not isinstance(f, LessThan)))
        return True


@dataclass
class Planes(InputPartition):
    first: int
    items: list[tuple[str, int]]


class TiffStackReader(DataSourceReader):
    """Planes of a stack; filters on z choose the files, so that others aren't opened."""

    def __init__(self, options: dict[str, str]):
        self.path, self.order = options["path"], options.get("order", "natural")
        self.per_task, self.range = int(options.get("planespertask", 16)), Range()
        self.rows = tuple(map(int, options["rows"].split(":"))) if "rows" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self.range.take(f, "z"):
                yield f

    def partitions(self) -> list[InputPartition]:
        files = listing(self.path, self.order)
        items = [(p, 0) for p in files]
        if len(files) == 1:
            with open(files[0], "rb") as f:
                items = [(files[0], k) for k, _ in enumerate(tiff.pages(f))]
        low, high = self.range.low, min(self.range.high, len(items))
        return [Planes(a, items[a : min(a + self.per_task, high)]) for a in range(low, high, self.per_task)]

    def read(self, partition: Planes) -> Iterator[tuple]:
        for k, (path, page) in enumerate(partition.items):
            with open(path, "rb") as f:
                found = list(tiff.pages(f))
                if page == 0 and len(found) != 1 and len(partition.items) > 1 and partition.items[0][0] != partition.items[-1][0]:
                    raise ValueError(f"{path} has {len(found)} pages")
                image = tiff.read_rows(f, found[page], *self.rows) if self.rows else tiff.read_page(f, found[page])
            if image.ndim != 2:
                raise ValueError(f"{path} is no grey image")
            yield partition.first + k, os.path.basename(path), *image.shape, image.dtype.name, image.astype(float).ravel().tolist()


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]


class TiffStackWriter(DataSourceWriter):
    """One file for each plane. Tasks write into a hidden directory; the commit moves it into place as a whole, an abort removes it."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.prefix, self.digits, self.compression = options.get("prefix", "slice"), int(options.get("digits", 5)), options.get("compression", "none")
        self.sep = options.get("sep", "_")
        self.stage = f"{os.path.dirname(self.path)}/.{os.path.basename(self.path)}.{uuid.uuid4().hex}"
        if os.path.exists(self.path) and os.listdir(self.path) and not overwrite:
            raise ValueError(f"{self.path} is not empty")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.stage, exist_ok=True)
        names = []
        for r in rows:
            dtype = r["dtype"] or "float64"
            image = np.array(r["pixels"], float).reshape(r["height"], r["width"])
            name = r["name"] or f"{self.prefix}{self.sep}{r['z']:0{self.digits}d}.tif"
            part = f"{self.stage}/.{name}.{uuid.uuid4().hex}"
            tiff.write(part, [image.astype(dtype)], self.compression)
            os.replace(part, f"{self.stage}/{name}")  # a task that runs twice replaces its file
            names.append(name)
        return Staged(names)

    def commit(self, messages: list[Staged | None]) -> None:
        names = [n for m in messages if m for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("two planes have one name")
        os.makedirs(self.stage, exist_ok=True)
        old = f"{self.stage}.old"
        if os.path.exists(self.path):
            os.rename(self.path, old)
        try:
            os.rename(self.stage, self.path)
        except OSError:
            if os.path.exists(old):
                os.rename(old, self.path)
            raise
        shutil.rmtree(old, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class TiffStack(DataSource):
    """`path`: a directory of single-page files or one file of many pages; `order`: name, natural or stem;
    `rows`: first:last, a window of rows, of which uncompressed files give no other bytes."""

    @classmethod
    def name(cls) -> str:
        return "tiffstack"

    def schema(self) -> str:
        return PLANE

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return TiffStackReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return TiffStackWriter(dict(self.options), overwrite)


@dataclass
class RawSpan(InputPartition):
    first: int
    count: int


class RawVolumeReader(DataSourceReader):
    """Planes of a raw volume (z, y, x) behind a header; tasks read byte ranges, filters on z and y shorten them."""

    def __init__(self, o: dict[str, str]):
        self.path, self.header = o["path"], int(o.get("headerbytes", 0))
        self.width, self.height, self.depth = (int(o[k]) for k in ("width", "height", "depth"))
        mark = {"big": ">", "little": "<"}.get(o.get("byteorder", "native"), "=")
        self.dtype, self.per_task, self.range = np.dtype(mark + np.dtype(o["dtype"]).str[1:]), int(o.get("planespertask", 16)), Range()
        expected = self.header + self.width * self.height * self.depth * self.dtype.itemsize
        if os.path.getsize(self.path) != expected:
            raise ValueError(f"{self.path} has {os.path.getsize(self.path)} bytes; {expected} are expected")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self.range.take(f, "z"):
                yield f

    def partitions(self) -> list[InputPartition]:
        low, high = self.range.low, min(self.range.high, self.depth)
        return [RawSpan(a, min(self.per_task, high - a)) for a in range(low, high, self.per_task)]

    def read(self, p: RawSpan) -> Iterator[tuple]:
        plane = self.width * self.height
        with open(self.path, "rb") as f:
            f.seek(self.header + p.first * plane * self.dtype.itemsize)
            for k in range(p.count):
                v = np.frombuffer(f.read(plane * self.dtype.itemsize), self.dtype)
                yield p.first + k, os.path.basename(self.path), self.height, self.width, self.dtype.newbyteorder("=").name, v.astype(float).tolist()


class RawVolume(DataSource):
    """Options: path, width, height, depth, dtype, byteOrder (native, big, little), headerBytes."""

    @classmethod
    def name(cls) -> str:
        return "rawvolume"

    def schema(self) -> str:
        return PLANE

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return RawVolumeReader({k.lower(): v for k, v in self.options.items()})


@dataclass
class Spans(InputPartition):
    path: str


class ByteSpansReader(DataSourceReader):
    """Spans of bytes at even distances of each file; a span that the file cuts short is an error."""

    def __init__(self, o: dict[str, str]):
        self.paths = o["path"].split(",")
        self.offset, self.stride, self.size, self.count = (int(o[k]) for k in ("offset", "stride", "size", "count"))

    def partitions(self) -> list[InputPartition]:
        return [Spans(p) for p in self.paths]

    def read(self, p: Spans) -> Iterator[tuple]:
        with open(p.path, "rb") as f:
            for k in range(self.count):
                f.seek(self.offset + k * self.stride)
                data = f.read(self.size)
                if len(data) != self.size:
                    raise ValueError(f"{p.path} ends within span {k}")
                yield p.path, k, data


class ByteSpans(DataSource):
    """Options: path (several by commas), offset, stride, size, count."""

    @classmethod
    def name(cls) -> str:
        return "bytespans"

    def schema(self) -> str:
        return "file string, k int, data binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ByteSpansReader({k.lower(): v for k, v in self.options.items()})


@dataclass
class Tree(InputPartition):
    path: str
    deep: bool


class FileTreeReader(DataSourceReader):
    """One task for each directory below the root; names that other listings hide, and empty files, are there."""

    def __init__(self, options: dict[str, str]):
        self.root, self.prefix = options["path"].rstrip("/"), options.get("prefix", "").strip("/")

    def partitions(self) -> list[InputPartition]:
        inner = [e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)]
        return [Tree(self.root, False), *(Tree(p, True) for p in sorted(inner))]

    def read(self, p: Tree) -> Iterator[pa.RecordBatch]:
        rows = []
        for top, _, names in os.walk(p.path):
            for n in sorted(names):
                path = os.path.join(top, n)
                s = os.stat(path)
                key = "/".join(x for x in (self.prefix, os.path.relpath(path, self.root)) if x)
                rows.append((path, top, n, key, s.st_size, s.st_mtime_ns))
            if not p.deep:
                break
            if len(rows) >= 10_000:
                yield self._batch(rows)
                rows = []
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("path", pa.string()), ("parent", pa.string()), ("name", pa.string()), ("key", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


class FileTree(DataSource):
    """`path`: the root; `prefix`: put before keys."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, parent string, name string, key string, size bigint, mtime_ns bigint"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FileTreeReader(dict(self.options))


# chunked volumes ---------------------------------------------------------------------------------------------------
def info_document(kind: str, dtype: str, size: list[int], chunk: list[int], resolution: list[float], offset: list[int] | None = None, encoding: str = "raw") -> dict:
    """The description of a chunked volume of one scale; sizes in x, y, z."""
    key = "_".join(f"{r:g}" for r in resolution)
    scale = {"key": key, "encoding": encoding, "resolution": resolution, "voxel_offset": offset or [0, 0, 0], "size": size, "chunk_sizes": [chunk]}
    return {"type": kind, "data_type": dtype, "num_channels": 1, "scales": [scale]}


def with_scales(info: dict, levels: int) -> dict:
    """The description with further scales, each of half the extent (rounded up) and twice the resolution of the one before; their offsets are halved."""
    scales = [info["scales"][0]]
    for _ in range(levels):
        last = scales[-1]
        resolution = [2 * r for r in last["resolution"]]
        scales.append(last | {"key": "_".join(f"{r:g}" for r in resolution), "resolution": resolution, "size": [-(-n // 2) for n in last["size"]], "voxel_offset": [o // 2 for o in last["voxel_offset"]]})
    return info | {"scales": scales}


def with_shards(info: dict, chunks_per_shard: int, minishard_chunks: int = 64) -> dict:
    """The description with every scale in shard files of about so many chunks."""
    scales = []
    for s in info["scales"]:
        pre, mini, shard = sharded.shard_bits(grid_of(s), chunks_per_shard, minishard_chunks)
        spec = {"@type": "neuroglancer_uint64_sharded_v1", "hash": "identity", "preshift_bits": pre, "minishard_bits": mini, "shard_bits": shard, "minishard_index_encoding": "gzip", "data_encoding": "gzip"}
        scales.append(s | {"sharding": spec})
    return info | {"scales": scales}


def grid_of(scale: dict) -> tuple[int, int, int]:
    """How many chunks along x, y and z."""
    return tuple(-(-n // c) for n, c in zip(scale["size"], scale["chunk_sizes"][0]))


def bits_of(scale: dict) -> tuple[int, int, int]:
    return tuple(scale["sharding"][f"{k}_bits"] for k in ("preshift", "minishard", "shard"))


def shard_name(number: int, bits: tuple[int, int, int]) -> str:
    return f"{number:0{max(1, -(-bits[2] // 4))}x}.shard"


def chunk_name(low: list[int], high: list[int]) -> str:
    return "_".join(f"{a}-{b}" for a, b in zip(low, high))


@dataclass
class Chunks(InputPartition):
    """Chunks first..first+count-1 of the box of chunks that is asked for, in x, y, z order."""

    first: int
    count: int


class ChunkedReader(DataSourceReader):
    """Filters on z, y and x choose the chunks, so that others aren't opened; the driver lists ranges of chunks, not chunks."""

    def __init__(self, options: dict[str, str]):
        self.path, self.per_task = options["path"].rstrip("/"), int(options.get("chunkspertask", 64))
        with open(f"{self.path}/info") as f:
            self.info = json.load(f)
        self.scale = self.info["scales"][int(options.get("mip", 0))]
        self.ranges = {a: Range(-(1 << 62)) for a in "xyz"}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not any([r.take(f, a) for a, r in self.ranges.items()]):
                yield f

    def _box(self) -> tuple[list[int], list[int]]:
        """The first chunk of the box along x, y and z, and how many."""
        s = self.scale
        low = [max(0, (max(r.low, o) - o) // c) for r, o, c in zip(self.ranges.values(), s["voxel_offset"], s["chunk_sizes"][0])]
        high = [-(-max(0, min(r.high, o + n) - o) // c) for r, o, n, c in zip(self.ranges.values(), s["voxel_offset"], s["size"], s["chunk_sizes"][0])]
        return low, [max(0, b - a) for a, b in zip(low, high)]

    def partitions(self) -> list[InputPartition]:
        n = int(np.prod(self._box()[1]))
        return [Chunks(k, min(self.per_task, n - k)) for k in range(0, n, self.per_task)]

    def read(self, p: Chunks) -> Iterator[pa.RecordBatch]:
        s, dtype = self.scale, np.dtype(self.info["data_type"]).newbyteorder("<")
        first, count = self._box()
        shards: dict[int, dict[int, bytes]] = {}
        for k in range(p.first, p.first + p.count):
            at = [f + int(i) for f, i in zip(first, np.unravel_index(k, count, order="F"))]
            low = [i * c for i, c in zip(at, s["chunk_sizes"][0])]
            high = [min(a + c, n) for a, c, n in zip(low, s["chunk_sizes"][0], s["size"])]
            low, high = ([a + o for a, o in zip(x, s["voxel_offset"])] for x in (low, high))
            body = self._sharded(at, shards) if "sharding" in s else self._file(f"{self.path}/{s['key']}/{chunk_name(low, high)}")
            if body is None:
                continue
            v = np.frombuffer(body, dtype).reshape([b - a for a, b in zip(low, high)], order="F")
            keep = tuple(slice(max(r.low, a) - a, max(0, min(r.high, b) - a)) for r, a, b in zip(self.ranges.values(), low, high))
            x, y, z = np.meshgrid(*[np.arange(a, b, dtype=np.int32)[cut] for a, b, cut in zip(low, high, keep)], indexing="ij")
            yield pa.RecordBatch.from_arrays([pa.array(z.ravel()), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(v[keep].astype(float).ravel())], names=["z", "y", "x", "v"])

    @staticmethod
    def _file(path: str) -> bytes | None:
        if not os.path.exists(path):
            return None
        with open(path, "rb") as f:
            return f.read()

    def _sharded(self, at: list[int], shards: dict[int, dict[int, bytes]]) -> bytes | None:
        """A chunk's bytes; the last shard that was opened is kept."""
        bits = bits_of(self.scale)
        number = sharded.chunk_number(grid_of(self.scale), at)
        shard = number >> bits[0] + bits[1]
        if shard not in shards:
            shards.clear()
            body = self._file(f"{self.path}/{self.scale['key']}/{shard_name(shard, bits)}")
            shards[shard] = sharded.unpack(body, bits) if body is not None else {}
        return shards[shard].get(number)


class ChunkedWriter(DataSourceWriter):
    """Rows (bx, by, bz, data) as raw chunk files; a chunk that is written twice replaces itself. The commit writes the description."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.info = json.loads(options["info"])
        self.scale = self.info["scales"][int(options.get("mip", 0))]
        folder = f"{self.path}/{self.scale['key']}"
        if os.path.exists(folder) and os.listdir(folder) and not overwrite:
            raise ValueError(f"{folder} is not empty")
        os.makedirs(folder, exist_ok=True)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        s = self.scale
        names = []
        for r in rows:
            low = [r[f"b{a}"] * c for a, c in zip("xyz", s["chunk_sizes"][0])]
            high = [min(a + c, n) for a, c, n in zip(low, s["chunk_sizes"][0], s["size"])]
            name = chunk_name(*[[a + o for a, o in zip(c, s["voxel_offset"])] for c in (low, high)])
            folder = f"{self.path}/{s['key']}"
            with open(part := f"{folder}/.{name}.{uuid.uuid4().hex}", "wb") as f:
                f.write(r["data"])
            os.replace(part, f"{folder}/{name}")
            names.append(name)
        return Staged(names)

    def commit(self, messages: list) -> None:
        write_info(self.path, self.info)

    def abort(self, messages: list) -> None:
        """Chunks are replaced by the next run; without `info` the volume isn't there."""


def write_info(path: str, info: dict) -> None:
    os.makedirs(path, exist_ok=True)
    with open(part := f"{path}/.info.{uuid.uuid4().hex}", "w") as f:
        json.dump(info, f)
    os.replace(part, f"{path}/info")


class Chunked(DataSource):
    """A chunked volume, in chunk or shard files: `path`, `mip`; `chunksPerTask` to read; `info` (JSON) to write."""

    @classmethod
    def name(cls) -> str:
        return "chunkedvolume"

    def schema(self) -> str:
        return "z int, y int, x int, v double"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ChunkedReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return ChunkedWriter(dict(self.options), overwrite)


def chunks_of(voxels: DataFrame, info: dict, mip: int = 0) -> DataFrame:
    """(bx, by, bz, data): voxels (z, y, x, v), counted from 0, as the bytes of chunks in x, y, z order; one shuffle by chunk. Voxels that are missing are 0."""
    from ..operators.volume import chunk_of

    s, dtype = info["scales"][mip], np.dtype(info["data_type"]).newbyteorder("<")
    chunk, size, keys = s["chunk_sizes"][0], s["size"], ["bx", "by", "bz"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            at = {c: t.column(c).to_numpy() for c in (*keys, "x", "y", "z", "v")}
            edges = [*np.flatnonzero(starts(t, keys)), t.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                number = [int(at[k][lo]) for k in keys]
                low = [i * c for i, c in zip(number, chunk)]
                block = np.zeros([min(c, n - a) for a, c, n in zip(low, chunk, size)], dtype)
                block[tuple(at[c][lo:hi] - a for c, a in zip("xyz", low))] = at["v"][lo:hi].astype(dtype)
                yield pa.RecordBatch.from_arrays([*[pa.array([i], pa.int32()) for i in number], pa.array([block.tobytes(order="F")], pa.binary())], names=[*keys, "data"])

    rows = chunk_of(voxels.select("z", "y", "x", F.col("v").cast("double").alias("v")), tuple(chunk))
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(build, "bx int, by int, bz int, data binary")


def write_chunked(voxels: DataFrame, path: str, info: dict, mip: int = 0) -> None:
    """Voxels (z, y, x, v), counted from 0, as one scale of a chunked volume, in chunk files or, where the description says so, in shards."""
    chunks, s = chunks_of(voxels, info, mip), info["scales"][mip]
    if "sharding" in s:
        sharded.write_shards(chunks, f"{path.rstrip('/')}/{s['key']}", grid_of(s), bits=bits_of(s))
        write_info(path.rstrip("/"), info)
    else:
        chunks.write.format("chunkedvolume").mode("overwrite").option("path", path).option("info", json.dumps(info)).option("mip", mip).save()


def write_pyramid(voxels: DataFrame, path: str, info: dict, labels: bool = False) -> None:
    """All scales of a chunked volume: the first from voxels, each other from the one before as it was written, so no level is computed twice.

    Blocks of 2 x 2 x 2 become their mean, rounded half to even for whole types, or the commonest label.
    """
    from ..operators.volume import downsample

    spark = voxels.sparkSession
    write_chunked(voxels, path, info)
    for mip in range(1, len(info["scales"])):
        offset = dict(zip("xyz", info["scales"][mip - 1]["voxel_offset"]))
        above = spark.read.format("chunkedvolume").option("mip", mip - 1).load(path)
        level = downsample(above.select(*[(F.col(a) - offset[a]).cast("int").alias(a) for a in "zyx"], "v"), labels)
        whole = np.dtype(info["data_type"]).kind in "iu"
        write_chunked(level.withColumn("v", F.rint("v") if whole else F.col("v")), path, info, mip)


def bytes_of_scale(size: list[int], dtype: str, channels: int = 1) -> int:
    return int(np.prod(size)) * ITEM_BYTES[dtype] * channels


def register(spark: SparkSession) -> None:
    """Make the formats known, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TiffStack, RawVolume, ByteSpans, FileTree, Chunked):
        spark.dataSource.register(source)
