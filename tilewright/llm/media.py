"""Operator 8, media columns: texts as 8-bit greyscale PNG images in binary columns.

A payload is cut into rows of a fixed width, each row is filtered with the PNG "sub" filter, the
rows are compressed with zlib and framed as PNG chunks with their checksums.  Reading parses the
chunks, tests every CRC, inflates, undoes the filters with numpy and checks the size.  The feature
is a perceptual hash: the signs of the low-frequency cosine-transform terms of the image's mean
over a 32 x 32 grid, against their median.

All of it is one pass over the rows without a shuffle.  Defined cases: a null text is an empty
payload (one padded unit), equal texts give equal bytes, ids may be null or repeated, further
columns of the input are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import steps

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 192
GRID, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG whose rows are ``payload``; its length must be a multiple of ``width``."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    rows = np.empty((len(pixels), width + 1), np.uint8)
    rows[:, 0] = 1
    rows[:, 1] = pixels[:, 0]
    np.subtract(pixels[:, 1:], pixels[:, :-1], out=rows[:, 2:])
    header = struct.pack(">IIBBBBB", width, len(pixels), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> np.ndarray:
    """The pixels of an 8-bit greyscale PNG without interlace; raises ValueError on any damage."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, packed, ended = 8, None, [], False
    while at < len(image):
        if at + 12 > len(image):
            raise ValueError("cut chunk")
        (length,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + length]
        if at + 12 + length > len(image):
            raise ValueError("cut chunk")
        if struct.unpack_from(">I", image, at + 8 + length)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"bad checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale without interlace")
            size = height, width
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + length
    if size is None or not ended:
        raise ValueError("no header or no end")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if raw.size != size[0] * (size[1] + 1):
        raise ValueError("wrong number of bytes")
    rows = raw.reshape(size[0], size[1] + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the PNG filters none, sub, up, average and Paeth of one-byte pixels."""
    if (kinds == 1).all():
        return np.cumsum(rows, axis=1, dtype=np.uint8)
    if (kinds == 0).all():
        return rows.copy()
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        if kind == 0:
            out[y] = rows[y]
        elif kind == 1:
            out[y] = np.cumsum(rows[y], dtype=np.uint8)
        elif kind == 2:
            out[y] = rows[y] + above
        elif kind in (3, 4):
            left = corner = 0
            for x in range(rows.shape[1]):
                up = int(above[x])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    near = (abs(p - left), abs(p - up), abs(p - corner))
                    guess = left if near[0] <= near[1] and near[0] <= near[2] else up if near[1] <= near[2] else corner
                corner, left = up, (int(rows[y, x]) + guess) & 255
                out[y, x] = left
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[y]
    return out


_K = np.arange(GRID)
_DCT = np.cos(np.pi * (2 * _K[None, :] + 1) * np.arange(LOW)[:, None] / (2 * GRID))


def _shrink(n: int) -> np.ndarray:
    """Edges of GRID nearly equal parts of n pixels; parts may repeat pixels when n < GRID."""
    return (np.arange(GRID + 1) * n) // GRID


def perceptual_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hexadecimal digits from the low frequencies of a 32 x 32 mean image."""
    y, x = _shrink(pixels.shape[0]), _shrink(pixels.shape[1])
    height, width = np.maximum(y[1:] - y[:-1], 1), np.maximum(x[1:] - x[:-1], 1)
    # sums of parts of rows, then of columns: only GRID rows are held as integers
    block = np.add.reduceat(np.add.reduceat(pixels, y[:-1], axis=0, dtype=np.int64), x[:-1], axis=1)
    mean = block / (height[:, None] * width[None, :])
    low = np.round(_DCT @ mean @ _DCT.T, 3).ravel()
    bits = low > np.median(low[1:])
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def payload_of(text: bytes, unit: int = WIDTH) -> bytes:
    """The text followed by spaces up to a positive multiple of ``unit``."""
    return text + b" " * (max(1, -(-len(text) // unit)) * unit - len(text))


SCHEMA = "id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media binary"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """One row per document: its PNG (``media``), digests of what reads back from it, and its hash."""
    schema = SCHEMA if keep_media else SCHEMA.rpartition(",")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches):
            columns: list[list] = [[] for _ in range(8)]
            raw = data.tobytes()
            for i in range(len(part)):
                text = raw[offsets[i] : offsets[i + 1]]
                image = encode_png(payload_of(text))
                pixels = decode_png(image)
                back = pixels.tobytes()
                row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(image), hashlib.sha256(image).hexdigest(), perceptual_hash(pixels), image)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            arrays = [part.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            arrays, names = (arrays, names) if keep_media else (arrays[:-1], names[:-1])
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as id", f"cast(`{text_col}` as string) as text").mapInArrow(run, schema)
