"""Sinks: layers, masks, documents, reports."""

from __future__ import annotations

import json
import logging
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import CLASS_NAMES, class_name

log = logging.getLogger("tileframe")
BLOCK = 256


def layer_rows(features: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows of an output layer: ids from 1 within a group, names, rounded area and confidence."""
    w = Window.partitionBy(*group).orderBy(*order)
    return features.select(*group, F.row_number().over(w).alias("id"), "damage_class", class_name(F.col("damage_class")).alias("damage_name"), F.round("area", 2).alias("area_m2"), F.round("confidence", 4).alias("confidence"))


def write_layer(rows: DataFrame, path: str, view: str | None = None) -> None:
    rows.write.mode("overwrite").parquet(path)
    if view:
        rows.sparkSession.read.parquet(path).createOrReplaceTempView(view)


def read_layer(spark: SparkSession, name: str) -> DataFrame:
    """A layer by the exact name that it was written under; the fields that assessments read must be there."""
    layer = spark.table(f"`{name}`")
    if missing := {"damage_class", "area_m2"} - set(layer.columns):
        raise ValueError(f"{name} is no damage layer: it has no {', '.join(sorted(missing))}")
    return layer


def write_csv(rows: DataFrame, path: str, header: list[str]) -> None:
    """Parts of CSV, each below the same comment lines: a text sink, as the CSV writer knows no preamble."""
    columns = rows.columns
    quoted = [F.when(F.col(c).cast("string").rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    body = rows.select(F.lit(1).alias("o"), F.concat_ws(",", *quoted).alias("value"))
    top = rows.sparkSession.createDataFrame([(0, "\n".join([*(f"# {h}" for h in header), "", ",".join(columns)]))], "o int, value string")
    top.union(body).select("value").write.mode("overwrite").text(path)


def mask_blocks(pixels: DataFrame) -> DataFrame:
    """(block_y, block_x, classes): a mask's blocks of 256 x 256 as arrays, 0 where there is no class. A block's pixels are
    gathered with their places and put there by NumPy."""
    at = ((F.col("y") % BLOCK) * BLOCK + F.col("x") % BLOCK).cast("int")
    block = [F.expr(f"{c} div {BLOCK}").cast("int").alias(f"block_{c}") for c in ("y", "x")]
    got = pixels.where("damage_class > 0").groupBy(*block).agg(F.collect_list(F.struct(at.alias("at"), F.col("damage_class").cast("tinyint").alias("c"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes = np.zeros((b.num_rows, BLOCK * BLOCK), np.int8)
            for k in range(b.num_rows):
                cells = b.column(2)[k].values
                classes[k, cells.field("at").to_numpy()] = cells.field("c").to_numpy()
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * BLOCK * BLOCK, pa.int32()), pa.array(classes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], ["block_y", "block_x", "classes"])

    return got.mapInArrow(run, "block_y int, block_x int, classes array<tinyint>")


def mask_metadata() -> str:
    return json.dumps({"nodata": 0, "block": BLOCK, "classes": {str(k): v for k, v in CLASS_NAMES.items()}})


def provenance(stats: DataFrame, run: dict[str, str]) -> DataFrame:
    """One JSON document: when, with which options, what came out."""
    made = F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_utc"), *(F.lit(v).alias(k) for k, v in run.items()))
    classes = F.create_map(*(F.lit(x) for kv in CLASS_NAMES.items() for x in (str(kv[0]), kv[1])))
    return stats.select(F.to_json(F.struct(made.alias("run"), classes.alias("classes"), F.struct(*stats.columns).alias("result"))).alias("document"))


def performance(profile: DataFrame) -> DataFrame:
    """One JSON document of a stage profile; a run's stages are few."""
    row = F.struct(*(c for c in profile.columns if c != "stage"))
    whole = profile.agg(F.sort_array(F.collect_list(F.struct("stage", row.alias("s")))).alias("l"))
    return whole.select(F.to_json(F.struct(F.map_from_entries("l").alias("stages"))).alias("document"))


def calibration_document(spark: SparkSession, temperature: float, metrics: dict[str, float], n: int) -> DataFrame:
    doc = spark.createDataFrame([(round(temperature, 4), "temperature scaling", n, {k: round(v, 5) for k, v in metrics.items()})], "cls_temperature double, method string, n_pixels long, metrics map<string,double>")
    return doc.select("cls_temperature", "n_pixels", F.to_json(F.struct("*")).alias("document"))


def wkb_polygon(ring: list[tuple[float, float]]) -> bytes:
    """A closed polygon of one ring as little-endian WKB."""
    points = [*ring, ring[0]] if ring and ring[0] != ring[-1] else ring
    return struct.pack("<BIII", 1, 3, 1, len(points)) + b"".join(struct.pack("<dd", *p) for p in points)


def write_gpkg(rows: DataFrame, path: str, srs: int = 0, most_rows: int = 1_000_000) -> None:
    """A GeoPackage with the feature table damage_buildings, made anew: the columns of rows, and their `ring` as geometry geom
    in the reference system of that EPSG number (0: undefined). A file on the driver: rows are streamed to it
    one partition at a time, and a table beyond most_rows is refused, as one file can't hold it well."""
    import os
    import sqlite3

    if rows.count() > most_rows:
        raise ValueError(f"over {most_rows} rows: write Parquet instead")
    for tail in ("", "-shm", "-wal", "-journal"):
        if os.path.exists(path + tail):
            os.remove(path + tail)
    plain = [c for c in rows.columns if c != "ring"]
    kinds = {"int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "double": "REAL", "float": "REAL"}
    types = dict(rows.dtypes)
    box = [float("inf"), float("inf"), float("-inf"), float("-inf")]

    def values() -> Iterator[tuple]:
        for r in rows.toLocalIterator():
            geom = None
            if "ring" in types and r["ring"]:
                ring = [(p["x"], p["y"]) for p in r["ring"]]
                xs, ys = zip(*ring, strict=True)
                box[:] = [min(box[0], *xs), min(box[1], *ys), max(box[2], *xs), max(box[3], *ys)]
                geom = b"GP\0\x03" + struct.pack("<idddd", srs, min(xs), max(xs), min(ys), max(ys)) + wkb_polygon(ring)
            yield (geom, *(r[c] for c in plain))

    with sqlite3.connect(path) as db:
        db.execute("PRAGMA application_id = 0x47504B47")
        db.execute("PRAGMA user_version = 10300")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        systems = [("Undefined Cartesian SRS", -1, "NONE", -1, "undefined"), ("Undefined geographic SRS", 0, "NONE", 0, "undefined"), ("WGS 84 geodetic", 4326, "EPSG", 4326, "EPSG:4326")]
        if srs not in (-1, 0, 4326):
            systems.append((f"EPSG:{srs}", srs, "EPSG", srs, f"EPSG:{srs}"))
        db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, NULL)", systems)
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id))")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL)")
        columns = ", ".join(f'"{c}" {kinds.get(types[c], "TEXT")}' for c in plain)
        db.execute(f"CREATE TABLE damage_buildings (fid INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, geom POLYGON{', ' if columns else ''}{columns})")
        names = ", ".join(["geom", *(f'"{c}"' for c in plain)])
        db.executemany(f"INSERT INTO damage_buildings ({names}) VALUES ({', '.join('?' * (len(plain) + 1))})", values())
        bounds = box if box[0] <= box[2] else [None] * 4
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES ('damage_buildings', 'features', 'damage_buildings', ?, ?, ?, ?, ?)", (*bounds, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('damage_buildings', 'geom', 'POLYGON', ?, 0, 0)", (srs,))


def write_report(reports: DataFrame, column: str, path: str) -> None:
    reports.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_pdf(text: str, path: str, lines: int = 54, width: int = 92) -> None:
    """A plain PDF of a text: Helvetica, `lines` lines a page, long lines folded at blanks."""
    import textwrap

    folded = [part for line in text.split("\n") for part in (textwrap.wrap(line, width) or [""])]
    pages = [folded[i : i + lines] for i in range(0, len(folded), lines)] or [[]]
    escape = lambda s: s.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)").encode("cp1252", "replace")
    bodies = [b"BT /F1 10 Tf 50 790 Td 14 TL\n" + b"".join(b"(" + escape(line) + b") Tj T*\n" for line in page) + b"ET" for page in pages]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages))) + b"] /Count %d >>" % len(pages), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for k, body in enumerate(bodies):
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * k))
        objects.append(b"<< /Length %d >>\nstream\n%b\nendstream" % (len(body), body))
    out, at = b"%PDF-1.4\n", []
    for k, obj in enumerate(objects):
        at.append(len(out))
        out += b"%d 0 obj\n%b\nendobj\n" % (k + 1, obj)
    table = b"".join(b"%010d 00000 n \n" % n for n in at)
    out += b"xref\n0 %d\n0000000000 65535 f \n%btrailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
    with open(path, "wb") as f:
        f.write(out)


def output_paths(folder: str, stem: str, endings: dict[str, str], fallback: str | None = None) -> dict[str, str]:
    """Where each sink writes: <folder>/<stem><ending>; in the fallback folder (the home folder, if not given) where the first
    can't be made or written to."""
    import os
    import re

    from ..functions.text import UNSAFE

    safe = re.sub(f"[{re.escape(UNSAFE)}]", "_", stem).strip(" ") or "damage_assessment"
    home = fallback or os.path.expanduser("~")
    try:
        os.makedirs(folder, exist_ok=True)
        usable = os.access(folder, os.W_OK)
    except OSError as e:
        log.warning("%s: %s", folder, e)
        usable = False
    return {name: os.path.join(folder if usable else home, safe + ending) for name, ending in endings.items()}


def export_all(sinks: dict[str, Callable[[], None]]) -> dict[str, str]:
    """Runs each sink on its own: one that fails is logged and named with its error, the others go on."""
    out = {}
    for name, write in sinks.items():
        try:
            write()
            out[name] = "ok"
        except Exception as e:
            log.warning("%s failed: %s", name, e)
            out[name] = str(e)[:120]
    return out
