"""Reading and writing baseline TIFF: strips without compression, with zlib or LZW, classic and BigTIFF, either byte order, many pages."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: bytes and struct code of each field type.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: Tags.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 339
#: Compressions.
NONE, LZW, ZLIB, OLD_ZLIB = 1, 5, 8, 32946
BIG_FROM = 4 << 30


@dataclass(frozen=True)
class Page:
    height: int
    width: int
    samples: int
    dtype: np.dtype
    compression: int
    predictor: int
    rows: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]

    @property
    def contiguous(self) -> bool:
        """Whether the pixels lie in the file as one block, so that rows can be read by their offsets."""
        return self.compression == NONE and all(a + n == b for a, n, b in zip(self.offsets, self.counts, self.offsets[1:]))


def pages(f) -> Iterator[Page]:  # noqa: ANN001
    """Descriptions of a file's pages, without reading a pixel."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("this is no TIFF file")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    count_size, count_code, entry, slot, code = (8, "Q", 20, 8, "Q") if big else (2, "H", 12, 4, "I")
    seen = set()
    while at:
        if at in seen:
            raise ValueError("the pages of the file go in a circle")
        seen.add(at)
        f.seek(at)
        n = struct.unpack(order + count_code, f.read(count_size))[0]
        block = f.read(n * entry + slot)
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, many = struct.unpack(order + ("HHQ" if big else "HHI"), block[k * entry : k * entry + (12 if big else 8)])
            size, letter = TYPES.get(kind, (1, "B"))
            raw = block[k * entry + (12 if big else 8) : (k + 1) * entry]
            if many * size > slot:
                f.seek(struct.unpack(order + code, raw)[0])
                raw = f.read(many * size)
            if kind not in (2, 5):
                tags[tag] = struct.unpack(f"{order}{many}{letter}", raw[: many * size])
        at = struct.unpack(order + code, block[n * entry :])[0]
        bits, samples = tags.get(BITS, (1,))[0], tags.get(SAMPLES, (1,))[0]
        kind = {1: "u", 2: "i", 3: "f"}.get(tags.get(FORMAT, (1,))[0])
        if kind is None or bits not in (8, 16, 32, 64) or OFFSETS not in tags:
            raise ValueError("only strips of whole 8 to 64 bit numbers are read")
        height = tags[HEIGHT][0]
        yield Page(height, tags[WIDTH][0], samples, np.dtype(f"{order}{kind}{bits // 8}"), tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], min(tags.get(ROWS, (height,))[0], height), tags[OFFSETS], tags[COUNTS])


def _unpack_lzw(data: bytes) -> bytes:
    """Variable codes from 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    out, table, width, last = bytearray(), [], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        now = table[code] if code < len(table) else last + last[:1]
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def read_page(f, page: Page) -> np.ndarray:  # noqa: ANN001
    """The pixels of a page in native byte order: (height, width) or (height, width, samples)."""
    parts = []
    for k, (at, n) in enumerate(zip(page.offsets, page.counts)):
        f.seek(at)
        raw = f.read(n)
        if page.compression in (ZLIB, OLD_ZLIB):
            raw = zlib.decompress(raw)
        elif page.compression == LZW:
            raw = _unpack_lzw(raw)
        elif page.compression != NONE:
            raise ValueError(f"compression {page.compression} isn't read")
        rows = min(page.rows, page.height - k * page.rows)
        strip = np.frombuffer(raw, page.dtype, rows * page.width * page.samples).reshape(rows, page.width, page.samples)
        if page.predictor == 2:
            strip = np.cumsum(strip, axis=1, dtype=page.dtype)
        parts.append(strip)
    image = np.concatenate(parts).astype(page.dtype.newbyteorder("="))
    return image[:, :, 0] if page.samples == 1 else image


def read_rows(f, page: Page, first: int, last: int) -> np.ndarray:  # noqa: ANN001
    """Rows first..last-1 of a page; of a contiguous one only their bytes are read."""
    if not page.contiguous:
        return read_page(f, page)[first:last]
    row = page.width * page.samples * page.dtype.itemsize
    f.seek(page.offsets[0] + first * row)
    image = np.frombuffer(f.read((last - first) * row), page.dtype).reshape(last - first, page.width, page.samples).astype(page.dtype.newbyteorder("="))
    return image[:, :, 0] if page.samples == 1 else image


def write(path: str, images: Iterator[np.ndarray] | list[np.ndarray], compression: str = "none", big: bool | None = None) -> None:
    """Write pages, each as one strip. `big` left open: BigTIFF where the pixels may pass 4 GiB."""
    images = list(images) if big is None else images
    if big is None:
        big = sum(i.nbytes for i in images) >= BIG_FROM - (1 << 20)
    code, slot, entry = ("Q", 8, 20) if big else ("I", 4, 12)
    with open(path, "wb") as f:
        f.write(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 16) if big else struct.pack("<HI", 42, 8)))
        link = 8 if big else 4
        for image in images:
            image = np.ascontiguousarray(image)
            height, width, samples = (*image.shape, 1)[:3]
            kind = {"u": 1, "b": 1, "i": 2, "f": 3}[image.dtype.kind]
            raw = image.astype(image.dtype.newbyteorder("<")).tobytes()
            raw = zlib.compress(raw, 6) if compression == "zlib" else raw
            at = f.tell()
            f.write(raw + b"\0" * (len(raw) & 1))
            bits = 8 * image.dtype.itemsize
            fields = [(WIDTH, 4, width), (HEIGHT, 4, height), (BITS, 3, bits), (COMPRESSION, 3, ZLIB if compression == "zlib" else NONE), (PHOTOMETRIC, 3, 2 if samples == 3 else 1), (OFFSETS, 16 if big else 4, at), (SAMPLES, 3, samples), (ROWS, 4, height), (COUNTS, 16 if big else 4, len(raw)), (FORMAT, 3, kind)]
            place = f.tell()
            f.seek(link)
            f.write(struct.pack("<" + code, place))
            f.seek(place)
            f.write(struct.pack("<Q" if big else "<H", len(fields)))
            for tag, type_, value in fields:
                values = [value] * samples if tag == BITS and samples * 2 <= slot else [value]
                f.write(struct.pack("<HH" + code, tag, type_, len(values)) + struct.pack(f"<{len(values)}{TYPES[type_][1]}", *values).ljust(slot, b"\0"))
            link = f.tell()
            f.write(struct.pack("<" + code, 0))
