"""PNG rasters: 8-bit grey, RGB and their alpha forms, decoded and encoded with zlib and NumPy."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(raw: bytes) -> np.ndarray:
    """(height, width, channels), not interlaced, eight bits a channel."""
    if raw[:8] != MAGIC:
        raise ValueError("not a PNG file")
    at, data, head = 8, [], b""
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        if kind == b"IHDR":
            head = raw[at + 8 : at + 8 + size]
        elif kind == b"IDAT":
            data.append(raw[at + 8 : at + 8 + size])
        at += size + 12
    w, h, bits, color, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if bits != 8 or color not in CHANNELS or interlace:
        raise ValueError(f"PNG of {bits} bits, colour type {color}, interlace {interlace} isn't supported")
    n = CHANNELS[color]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w * n), np.uint8)
    for y, line in enumerate(lines):
        kind, row, up = line[0], line[1:].copy(), out[y]
        if kind == 1:
            row = np.cumsum(row.reshape(w, n), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            row += up
        elif kind in (3, 4):
            for i in range(w * n):
                a, b, c = (int(row[i - n]), int(up[i]), int(up[i - n])) if i >= n else (0, int(up[i]), 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[i] = (int(row[i]) + guess) & 255
        out[y + 1] = row
    return out[1:].reshape(h, w, n)


def encode(pixels: np.ndarray) -> bytes:
    h, w, n = pixels.shape
    color = {v: k for k, v in CHANNELS.items()}[n]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * n)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def read_png(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(path, band, y, x, v) of each file: the first three channels, or one in place of all three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                px = decode(raw)
                y, x = (i.ravel().astype(np.int32) for i in np.mgrid[: px.shape[0], : px.shape[1]])
                for k in range(3):
                    v = px[:, :, k if px.shape[2] >= 3 else 0].ravel().astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(v)), pa.array(np.full(len(v), k, np.int32)), pa.array(y), pa.array(x), pa.array(v)], ["path", "band", "y", "x", "v"])

    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return f.mapInArrow(run, "path string, band int, y int, x int, v int")


def tiles_as_png(tiles: DataFrame, side: int) -> DataFrame:
    """(ty, tx, png) of tiles (ty, tx, values): grey images of side x side, one row a tile; a mosaic is its tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            png = [encode(np.array(v, np.uint8).reshape(side, side, 1)) for v in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(png, pa.binary())], ["ty", "tx", "png"])

    return tiles.select("ty", "tx", "values").mapInArrow(run, "ty int, tx int, png binary")
