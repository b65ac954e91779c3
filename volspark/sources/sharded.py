"""Shard files of chunked volumes, by the public format `neuroglancer_uint64_sharded_v1`.

A shard begins with an index of its minishards (start and end, 64 bits each); a minishard's index has three rows: chunk ids and offsets, each as
differences from the one before, and sizes. Ids are compressed Morton codes; the hash is the identity.
"""

from __future__ import annotations

import gzip

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def morton_bits(grid: tuple[int, int, int]) -> list[tuple[int, int]]:
    """(axis, bit) from the lowest to the highest bit of a compressed Morton code."""
    need = [max(0, (n - 1).bit_length()) for n in grid]
    return [(axis, bit) for bit in range(max(need, default=0)) for axis in range(3) if bit < need[axis]]


def chunk_id(grid: tuple[int, int, int], bx: Column, by: Column, bz: Column) -> Column:
    """A chunk's id from its place in the grid."""
    out = F.lit(0).cast("bigint")
    for k, (axis, bit) in enumerate(morton_bits(grid)):
        out = out.bitwiseOR(F.shiftleft(F.shiftright((bx, by, bz)[axis].cast("bigint"), bit).bitwiseAND(1), k))
    return out


def chunk_number(grid: tuple[int, int, int], at: list[int]) -> int:
    """The same of one place."""
    return sum((at[axis] >> bit & 1) << k for k, (axis, bit) in enumerate(morton_bits(grid)))


def shard_bits(grid: tuple[int, int, int], chunks_per_shard: int, minishard_chunks: int = 64) -> tuple[int, int, int]:
    """(preshift, minishard, shard) bits: neighbours share a minishard, a shard holds about so many chunks."""
    all_bits = len(morton_bits(grid))
    inner = min(all_bits, max(0, chunks_per_shard.bit_length() - 1))
    pre = min(inner, max(0, minishard_chunks.bit_length() - 1))
    return pre, inner - pre, all_bits - inner


def shard_of(id_: Column, bits: tuple[int, int, int]) -> Column:
    return F.shiftright(id_, bits[0] + bits[1]).bitwiseAND((1 << bits[2]) - 1)


def pack(chunks: list[tuple[int, bytes]], bits: tuple[int, int, int], zipped: bool = True) -> bytes:
    """A shard of chunks (id, bytes)."""
    squeeze = (lambda b: gzip.compress(b, mtime=0)) if zipped else (lambda b: b)
    pre, mini, _ = bits
    groups: dict[int, list[tuple[int, bytes]]] = {}
    for i, data in sorted(chunks):
        groups.setdefault((i >> pre) & ((1 << mini) - 1), []).append((i, squeeze(data)))
    body, index = bytearray(), np.zeros((1 << mini, 2), "<u8")
    for m, items in sorted(groups.items()):
        ids, sizes = np.array([i for i, _ in items], "<u8"), np.array([len(d) for _, d in items], "<u8")
        table = np.zeros((3, len(items)), "<u8")
        table[0] = np.diff(ids, prepend=np.uint64(0))
        table[1, 0], table[2] = len(body), sizes  # chunks lie side by side: later offsets differ by 0
        for _, d in items:
            body += d
        raw = squeeze(table.tobytes())
        index[m] = len(body), len(body) + len(raw)
        body += raw
    return index.tobytes() + bytes(body)


def unpack(shard: bytes, bits: tuple[int, int, int], zipped: bool = True) -> dict[int, bytes]:
    """The chunks of a shard by id."""
    open_ = gzip.decompress if zipped else bytes
    head = 16 << bits[1]
    out: dict[int, bytes] = {}
    for a, b in np.frombuffer(shard[:head], "<u8").reshape(-1, 2).astype(int):
        if a == b:
            continue
        table = np.frombuffer(open_(shard[head + a : head + b]), "<u8").reshape(3, -1)
        ids, at = np.cumsum(table[0]), head
        for i, gap, size in zip(ids, table[1], table[2]):
            at += int(gap)
            out[int(i)] = open_(shard[at : at + int(size)])
            at += int(size)
    return out


def write_shards(chunks, folder: str, grid: tuple[int, int, int], chunks_per_shard: int = 512, bits: tuple[int, int, int] | None = None) -> None:  # noqa: ANN001
    """Chunks (bx, by, bz, data binary) as shard files: one shuffle by shard, each shard built by one task within its capacity."""
    import os
    import uuid

    import pandas as pd

    bits = bits or shard_bits(grid, chunks_per_shard)
    digits = max(1, -(-bits[2] // 4))
    rows = chunks.withColumn("id", chunk_id(grid, F.col("bx"), F.col("by"), F.col("bz"))).withColumn("shard", shard_of(F.col("id"), bits))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        name = f"{int(pdf['shard'].iloc[0]):0{digits}x}.shard"
        with open(part := f"{folder}/.{name}.{uuid.uuid4().hex}", "wb") as f:
            f.write(pack(list(zip(pdf["id"].astype(int), pdf["data"])), bits))
        os.replace(part, f"{folder}/{name}")
        return pd.DataFrame({"name": [name], "chunks": [len(pdf)]})

    done = rows.select("shard", "id", "data").groupBy("shard").applyInPandas(build, "name string, chunks bigint")
    done.write.format("noop").mode("overwrite").save()
