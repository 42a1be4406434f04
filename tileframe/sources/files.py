"""Files: listings, image triplets, model members, calibration documents, rasters."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRE, POST, TARGET = "_pre_disaster.png", "_post_disaster.png", "_post_disaster_target.png"


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modified, length) of the files in a folder; contents aren't read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return f.select("path", F.col("modificationTime").alias("modified"), "length")


def ended(path: Column, suffix: str) -> Column:
    """The file's name without the suffix; null if it has another."""
    name = F.regexp_replace(path, r"^.*/", "")
    return F.when(F.endswith(name, F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix)))


def find_pairs(paths: DataFrame) -> DataFrame:
    """(stem, pre, post, target) for each stem that has all three, by name."""
    of = lambda suffix, n: paths.select(ended(F.col("path"), suffix).alias("stem"), F.col("path").alias(n)).where("stem is not null")
    return of(PRE, "pre").join(of(POST, "post"), "stem").join(of(TARGET, "target"), "stem").orderBy("stem")


def missing(required: DataFrame, present: DataFrame, on: str = "name") -> DataFrame:
    return required.join(present, on, "left_anti")


def members(candidates: DataFrame) -> DataFrame:
    """The first existing file of each stem (half precision counts as the same), in the order of rank."""
    c = candidates.withColumn("stem", F.replace(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_fp16"), F.lit("")))
    w = Window.partitionBy("stem").orderBy("rank", "name")
    return c.where("present").withColumn("r", F.row_number().over(w)).where("r = 1").select("stem", "name", "rank")


def read_temperature(spark: SparkSession, path: str, default: float = 1.0) -> float:
    """cls_temperature of a calibration document, if it is between 0.1 and 10."""
    row = spark.read.option("multiLine", True).json(path)
    if "cls_temperature" not in row.columns:
        return default
    got = row.select(F.col("cls_temperature").try_cast("double").alias("t")).where("t between 0.1 and 10").first()
    return got[0] if got else default


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """(area, crs, ring) of the polygons in GeoJSON files, outer rings only; other geometries don't count. Each file is one
    document, as areas are drawn by hand."""
    point = T.ArrayType(T.DoubleType())
    geometry = T.StructType().add("type", "string").add("coordinates", T.ArrayType(T.ArrayType(point)))
    schema = T.StructType().add("crs", T.StructType().add("properties", T.StructType().add("name", "string"))).add("features", T.ArrayType(T.StructType().add("geometry", geometry)))
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    name = F.coalesce(F.concat(F.lit("EPSG:"), F.nullif(F.regexp_extract("crs.properties.name", r"(\d+)$", 1), F.lit(""))), F.lit("EPSG:4326"))
    each = rows.select(name.alias("crs"), F.posexplode("features").alias("area", "f")).where("f.geometry.type = 'Polygon'")
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    open_ = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    return each.select("area", "crs", open_.alias("ring"))


def checked(files: DataFrame, digests: DataFrame) -> DataFrame:
    """(name, ok): whether each file's content (name, content) has the SHA-256 it should."""
    return files.select("name", F.sha2("content", 256).alias("got")).join(digests, "name").select("name", (F.col("got") == F.lower("sha256")).alias("ok"))


def read_pgm(spark: SparkSession, folder: str) -> DataFrame:
    """(path, band, y, x, v): pixels of binary PGM and PPM rasters, up to three bands; one band counts as all three."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head, at = [], 0
                while len(head) < 4:
                    end = at
                    while raw[end : end + 1] not in (b" ", b"\n", b"\t", b"\r"):
                        end += 1
                    if raw[at : at + 1] == b"#":
                        end = raw.index(b"\n", at)
                    elif end > at:
                        head.append(raw[at:end])
                    at = end + 1
                bands = 3 if head[0] == b"P6" else 1
                w, h, top = int(head[1]), int(head[2]), int(head[3])
                px = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, w * h * bands, at).reshape(h, w, bands).astype(np.int32)
                y, x = np.divmod(np.arange(w * h, dtype=np.int32), w)
                for k in range(3):
                    v = px[:, :, k if bands == 3 else 0].ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(v)), pa.array(np.full(len(v), k, np.int32)), pa.array(y), pa.array(x), pa.array(v)], ["path", "band", "y", "x", "v"])

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.p[gp]m").load(folder).select("path", "content")
    return f.mapInArrow(run, "path string, band int, y int, x int, v int")


def download(source: BinaryIO, path: str, sha256: str, length: int | None = None, report: Callable[[int], None] | None = None, piece: int = 1 << 20) -> None:
    """Copies a stream to a file in pieces with a running SHA-256; report is told each tenth of the length that is there. The
    file takes its name only when all of it is there and right, so what has the name is whole; else ValueError."""
    part, digest, done, told = f"{path}.part", hashlib.sha256(), 0, 0
    try:
        with open(part, "wb") as f:
            while data := source.read(piece):
                f.write(data)
                digest.update(data)
                done += len(data)
                while report and length and told < 10 * done // length:
                    told += 1
                    report(told * 10)
        if digest.hexdigest() != sha256.lower():
            raise ValueError(f"{path}: the digest is {digest.hexdigest()}, not {sha256}")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
