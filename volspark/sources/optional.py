"""Sources whose libraries may be absent: HDF5 trees and datasets, DICOM slices. Each says so when it is used, not when it is imported."""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .formats import PLANE, natural


def need(module: str, what: str):  # noqa: ANN201
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise ImportError(f"{what} needs the package {module}") from e


def inputs(paths: list[str], endings: tuple[str, ...]) -> list[str]:
    """Files below the paths, each once, in natural order."""
    found = set()
    for p in paths:
        if os.path.isdir(p):
            found |= {os.path.realpath(os.path.join(t, n)) for t, _, ns in os.walk(p) for n in ns if n.lower().endswith(endings)}
        else:
            found.add(os.path.realpath(p))
    return sorted(found, key=natural)


@dataclass
class OneFile(InputPartition):
    path: str


class H5Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options["path"].split(",")
        self.select, self.most = options.get("select", ""), int(options.get("maxvalues", 0))

    def partitions(self) -> list[InputPartition]:
        return [OneFile(p) for p in inputs(self.paths, (".h5", ".hdf5", ".he5"))]

    def read(self, p: OneFile) -> Iterator[tuple]:
        h5py = need("h5py", "reading HDF5 files")
        rows = []
        asked, below = bool(self.select), self.select.strip("/")

        def visit(path: str, node) -> None:  # noqa: ANN001
            data = isinstance(node, h5py.Dataset)
            most = self.most if asked and (not below or path == below or path.startswith(below + "/")) else 64
            small = data and node.size is not None and (most == 0 or node.size <= most)
            value = str(np.asarray(node[()]).tolist()) if small else None
            attrs = {k: str(v) for k, v in node.attrs.items()}
            rows.append((p.path, path, path.rpartition("/")[0], "dataset" if data else "group", list(map(int, node.shape)) if data else None, str(node.dtype) if data else None, value, len(rows), attrs))

        with h5py.File(p.path) as f:
            f.visititems(visit)
        yield from rows


class H5Nodes(DataSource):
    """`path`: files or directories, separated by commas. The rows are those that `operators.metadata` works on.

    Values of datasets of at most 64 elements are read; of those at or below `select`, a path in the files, up to `maxValues` elements (0: all).
    """

    @classmethod
    def name(cls) -> str:
        return "h5nodes"

    def schema(self) -> str:
        return "file string, path string, parent string, kind string, shape array<bigint>, dtype string, value string, visit bigint, attrs map<string,string>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return H5Reader(dict(self.options))


@dataclass
class H5Span(InputPartition):
    path: str
    dataset: str
    first: int
    last: int


class H5StackReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.dataset, self.per_task = options["path"], options["dataset"], int(options.get("planespertask", 16))

    def partitions(self) -> list[InputPartition]:
        with need("h5py", "reading HDF5 files").File(self.path) as f:
            n = f[self.dataset].shape[0]
        return [H5Span(self.path, self.dataset, a, min(a + self.per_task, n)) for a in range(0, n, self.per_task)]

    def read(self, p: H5Span) -> Iterator[tuple]:
        with need("h5py", "reading HDF5 files").File(p.path) as f:
            for z in range(p.first, p.last):
                a = f[p.dataset][z]
                yield z, f"{p.dataset}[{z}]", *a.shape, a.dtype.name, a.astype(float).ravel().tolist()


class H5Stack(DataSource):
    """`path` and `dataset`: a dataset of three dimensions as planes."""

    @classmethod
    def name(cls) -> str:
        return "h5stack"

    def schema(self) -> str:
        return PLANE

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return H5StackReader(dict(self.options))


class DicomReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = inputs([options["path"]], (".dcm", ".ima"))

    def partitions(self) -> list[InputPartition]:
        return [OneFile(p) for p in self.files]

    def read(self, p: OneFile) -> Iterator[tuple]:
        a = need("pydicom", "reading DICOM files").dcmread(p.path).pixel_array
        yield self.files.index(p.path), os.path.basename(p.path), *a.shape, a.dtype.name, a.astype(float).ravel().tolist()


class DicomStack(DataSource):
    """`path`: a directory of slices."""

    @classmethod
    def name(cls) -> str:
        return "dicomstack"

    def schema(self) -> str:
        return PLANE

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return DicomReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (H5Nodes, H5Stack, DicomStack):
        spark.dataSource.register(source)
