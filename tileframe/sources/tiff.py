"""GeoTIFF rasters: tiled and striped, 8 and 16 bits or float, plain, Deflate or LZW, with their place on the map."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The format's numbers of tags, of field types with their sizes, and of what is used here.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
PROJECTED, GEOGRAPHIC = 3072, 2048
SIDE = 256


def unlzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, the first bit of a byte first; 256 clears the table, 257 ends."""
    table: list[bytes] = []
    out, bits, held, size, before = [], 0, 0, 9, b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < size:
            continue
        bits -= size
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, size, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        got = table[code] if code < len(table) else before + before[:1]
        out.append(got)
        if before:
            table.append(before + got[:1])
        before = got
        size = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def tags_of(raw: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        letter, size = TYPES.get(kind, ("B", 1))
        place = at + 10 + 12 * k
        if n * size > 4:
            place = struct.unpack(order + "I", raw[place : place + 4])[0]
        part = raw[place : place + n * size]
        tags[tag] = (part.rstrip(b"\0").decode("utf-8", "replace"),) if kind == 2 else struct.unpack(order + letter * n, part)
    return order, tags


def decode(raw: bytes) -> tuple[np.ndarray, dict[str, float | int | None]]:
    """(height, width, bands) and where it lies: xmin, ymax, px_w, px_h and epsg, None where the file doesn't say."""
    order, tags = tags_of(raw)
    one = lambda t, default=None: tags.get(t, (default,))[0]
    w, h, n = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    kind = np.dtype(f"{order}{'f' if one(SAMPLE_FORMAT, 1) == 3 else 'i' if one(SAMPLE_FORMAT, 1) == 2 else 'u'}{one(BITS, 8) // 8}")
    if one(PLANAR, 1) != 1 or len(set(tags.get(BITS, (8,)))) > 1:
        raise ValueError("bands in separate planes or of several sizes aren't supported")
    tw, th, starts, sizes = (one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILES], tags[TILE_BYTES]) if TILES in tags else (w, min(one(ROWS, h), h), tags[STRIPS], tags[STRIP_BYTES])
    unpack = {PLAIN: bytes, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}.get(one(COMPRESSION, 1))
    if unpack is None:
        raise ValueError(f"compression {one(COMPRESSION)} isn't supported")
    across = -(-w // tw)
    out = np.zeros((-(-h // th) * th, across * tw, n), kind)
    for k, (at, size) in enumerate(zip(starts, sizes, strict=True)):
        y, x = k // across * th, k % across * tw
        data = unpack(raw[at : at + size])
        rows = len(data) // (tw * n * kind.itemsize)
        part = np.frombuffer(data, kind, rows * tw * n).reshape(rows, tw, n)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, 1, dtype=kind)
        out[y : y + rows, x : x + tw] = part
    scale, tie = tags.get(PIXEL_SCALE), tags.get(TIE_POINT)
    where = {"xmin": None, "ymax": None, "px_w": None, "px_h": None, "epsg": None}
    if scale and tie:
        where |= {"px_w": scale[0], "px_h": scale[1], "xmin": tie[3] - tie[0] * scale[0], "ymax": tie[4] + tie[1] * scale[1]}
    keys = tags.get(GEO_KEYS, ())
    for i in range(4, len(keys) - 3, 4):
        if keys[i] in (PROJECTED, GEOGRAPHIC) and not keys[i + 1]:
            where["epsg"] = keys[i + 3]
    return out[:h, :w].astype(kind.newbyteorder("=")), where


def encode(pixels: np.ndarray, xmin: float | None = None, ymax: float | None = None, px_w: float = 1.0, px_h: float = 1.0, epsg: int | None = None, nodata: int | None = None, metadata: dict | None = None) -> bytes:
    """(height, width, bands) of unsigned bytes as tiles of 256 x 256, differences by row, Deflate."""
    h, w, n = pixels.shape
    down, across = -(-h // SIDE), -(-w // SIDE)
    full = np.zeros((down * SIDE, across * SIDE, n), np.uint8)
    full[:h, :w] = pixels
    tiles = []
    for y in range(0, down * SIDE, SIDE):
        for x in range(0, across * SIDE, SIDE):
            t = full[y : y + SIDE, x : x + SIDE]
            tiles.append(zlib.compress(np.concatenate([t[:, :1], t[:, 1:] - t[:, :-1]], 1).tobytes()))
    starts = (np.cumsum([8, *map(len, tiles)])[:-1]).tolist()
    fields: list[tuple[int, int, list | bytes]] = [
        (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * n), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [2 if n == 3 else 1]), (SAMPLES, 3, [n]), (PLANAR, 3, [1]), (PREDICTOR, 3, [2]),
        (TILE_WIDTH, 3, [SIDE]), (TILE_HEIGHT, 3, [SIDE]), (TILES, 4, starts), (TILE_BYTES, 4, [len(t) for t in tiles]), (SAMPLE_FORMAT, 3, [1] * n),
    ]
    if xmin is not None and ymax is not None:
        fields += [(PIXEL_SCALE, 12, [px_w, px_h, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, xmin, ymax, 0.0])]
    if epsg:
        plane = epsg != 4326
        fields.append((GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 1 if plane else 2, 1025, 0, 1, 1, PROJECTED if plane else GEOGRAPHIC, 0, 1, epsg]))
    if metadata:
        items = "".join(f'<Item name="{k}">{json.dumps(v)}</Item>' for k, v in metadata.items())
        fields.append((METADATA, 2, f"<GDALMetadata>{items}</GDALMetadata>\0".encode()))
    if nodata is not None:
        fields.append((NODATA, 2, f"{nodata}\0".encode()))
    at = 8 + sum(map(len, tiles))
    at += at % 2
    after, entries = at + 2 + 12 * len(fields) + 4, []
    extra = b""
    for tag, kind, values in sorted(fields, key=lambda f: f[0]):
        body = values if isinstance(values, bytes) else struct.pack("<" + TYPES[kind][0] * len(values), *values)
        if len(body) > 4:
            entries.append(struct.pack("<HHII", tag, kind, len(values), after + len(extra)))
            extra += body + b"\0" * (len(body) % 2)
        else:
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
    head = struct.pack("<2sHI", b"II", 42, at)
    body = head + b"".join(tiles)
    return body.ljust(at, b"\0") + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0" + extra


def read_tiff(spark: SparkSession, folder: str, pattern: str = "*.tif*") -> DataFrame:
    """(path, band, y, x, v) of each file: the first three bands, or one in place of all three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                px, _ = decode(raw)
                y, x = (i.ravel().astype(np.int32) for i in np.mgrid[: px.shape[0], : px.shape[1]])
                for k in range(3):
                    v = px[:, :, k if px.shape[2] >= 3 else 0].ravel().astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(v)), pa.array(np.full(len(v), k, np.int32)), pa.array(y), pa.array(x), pa.array(v)], ["path", "band", "y", "x", "v"])

    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return f.mapInArrow(run, "path string, band int, y int, x int, v double")


def scenes_of(spark: SparkSession, folder: str, pattern: str = "*.tif*") -> DataFrame:
    """(scene: path, h, w, xmin, ymax, px_w, px_h, epsg) of each file; a file without a place has pixels of one unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                px, at = decode(raw)
                plain = at["px_w"] is None
                rows.append((path, px.shape[0], px.shape[1], *((0.0, float(px.shape[0]), 1.0, 1.0) if plain else (at["xmin"], at["ymax"], at["px_w"], at["px_h"])), at["epsg"]))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["scene", "h", "w", "xmin", "ymax", "px_w", "px_h", "epsg"])

    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return f.mapInArrow(run, "scene string, h int, w int, xmin double, ymax double, px_w double, px_h double, epsg int")


def masks_as_tiff(painted: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene, tiff) of damage masks (scene, y, x, damage_class): one band, 0 as no data, the classes' names as metadata. scenes:
    (scene, h, w, xmin, ymax, px_w, px_h, epsg). A file is made in one task, which holds one scene's mask."""
    from ..model import CLASS_NAMES

    kind = dict(scenes.dtypes)["scene"]
    sized = scenes.join(painted.where("damage_class > 0").select("scene", "y", "x", "damage_class"), "scene", "left")

    def run(p):  # noqa: ANN001, ANN202
        import pandas as pd

        first = p.iloc[0]
        mask = np.zeros((int(first["h"]), int(first["w"]), 1), np.uint8)
        own = p.dropna(subset=["y"])
        mask[own["y"].astype(int), own["x"].astype(int), 0] = own["damage_class"].astype(int)
        epsg = None if pd.isna(first["epsg"]) else int(first["epsg"])
        raw = encode(mask, float(first["xmin"]), float(first["ymax"]), float(first["px_w"]), float(first["px_h"]), epsg, 0, {f"CLASS_{k}": v for k, v in CLASS_NAMES.items()})
        return pd.DataFrame([[first["scene"], raw]], columns=["scene", "tiff"])

    return sized.groupBy("scene").applyInPandas(run, f"scene {kind}, tiff binary")
