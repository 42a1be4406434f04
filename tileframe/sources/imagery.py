"""Map imagery as a grid of tile requests, with the fetch injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


#: Fixed value: Web Mercator as a .prj file states it.
MERCATOR_PRJ = (
    'PROJCS["WGS 84 / Pseudo-Mercator",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],'
    'PROJECTION["Mercator_1SP"],PARAMETER["central_meridian",0],PARAMETER["scale_factor",1],PARAMETER["false_easting",0],PARAMETER["false_northing",0],UNIT["metre",1],AUTHORITY["EPSG","3857"]]'
)


def with_start(requests: DataFrame) -> DataFrame:
    """Adds the grid of each request (zoom, lat, lon, width, height): nx, ny tiles from x0, y0. The centre is on a tile's edge."""
    r = requests.withColumns({"cx": geo.tile_x(F.col("lon"), F.col("zoom")), "cy": geo.tile_y(F.col("lat"), F.col("zoom")), "nx": geo.tiles_across(F.col("width")), "ny": geo.tiles_across(F.col("height")), "n": geo.tiles_at(F.col("zoom")).cast("long")})
    return r.withColumns({"x0": F.expr("cx - nx div 2"), "y0": F.expr("cy - ny div 2")})


def tile_url(provider: str, zoom: Column, x: Column, y: Column) -> Column:
    order = (zoom, y, x) if provider == "imagery" else (zoom, x, y)
    tail = ".png" if provider == "streets" else ""
    return F.concat(F.lit("https://tiles.invalid/"), F.concat_ws("/", *(c.cast("string") for c in order)), F.lit(tail))


def request_grid(requests: DataFrame, provider: str) -> DataFrame:
    """One row a tile: columns wrap around the world, rows beyond it are left out."""
    g = with_start(requests).withColumn("dx", F.explode(F.expr("sequence(0, nx - 1)"))).withColumn("dy", F.explode(F.expr("sequence(0, ny - 1)")))
    g = g.withColumns({"tx": F.pmod(F.col("x0") + F.col("dx"), F.col("n")).cast("int"), "ty": (F.col("y0") + F.col("dy")).cast("int")})
    return g.where((F.col("ty") >= 0) & (F.col("ty") < F.col("n"))).withColumn("url", tile_url(provider, F.col("zoom"), F.col("tx"), F.col("ty")))


def with_world_file(requests: DataFrame) -> DataFrame:
    """pixel_width, pixel_height, x and y of the centre of the first pixel, and the six lines of a world file."""
    r = with_start(requests)
    side = F.lit(geo.CIRCUMFERENCE) / geo.tiles_at(F.col("zoom"))
    r = r.withColumns({"pixel_width": side / geo.SIDE, "pixel_height": -(side / geo.SIDE), "left": F.col("x0") * side - geo.CIRCUMFERENCE / 2, "top": F.lit(geo.CIRCUMFERENCE / 2) - F.col("y0") * side})
    cut = lambda n, size: F.expr(f"({n} * {geo.SIDE} - {size}) div 2")
    r = r.withColumns({"x": F.col("left") + cut("nx", "width") * F.col("pixel_width") + F.col("pixel_width") / 2, "y": F.col("top") + cut("ny", "height") * F.col("pixel_height") + F.col("pixel_height") / 2})
    lines = [F.format_string("%.10f", "pixel_width"), F.lit("0.0"), F.lit("0.0"), F.format_string("%.10f", "pixel_height"), F.format_string("%.6f", "x"), F.format_string("%.6f", "y")]
    return r.withColumns({"world_file": F.concat_ws("\n", *lines), "prj": F.lit(MERCATOR_PRJ)})


def centre_crop(mosaic: DataFrame, size: DataFrame) -> DataFrame:
    """Pixels (y, x, ...) of a mosaic cropped about its centre; size is one row (width, height, asked_w, asked_h)."""
    c = mosaic.crossJoin(F.broadcast(size)).withColumns({"left": F.expr("(width - asked_w) div 2"), "top": F.expr("(height - asked_h) div 2")})
    inside = (F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + F.col("asked_w")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + F.col("asked_h"))
    others = [n for n in mosaic.columns if n not in ("y", "x")]
    return c.where(inside).select((F.col("y") - F.col("top")).cast("int").alias("y"), (F.col("x") - F.col("left")).cast("int").alias("x"), *others)


def usable(content_type: Column, body: Column) -> Column:
    """An image by its type, or long enough to be one."""
    return F.contains(content_type, F.lit("image")) | (F.length(body) > 1000)


def allowed_scheme(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).isin("http", "https"), F.lit(False))


def fetch(grid: DataFrame, get: Callable[[str], tuple[str, bytes]]) -> DataFrame:
    """grid with content_type, body and failed. get runs on executors; an error counts as a failed tile."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = []
            for u in f["url"]:
                try:
                    got.append((*get(u), False))
                except Exception:
                    got.append(("", b"", True))
            yield f.assign(content_type=[g[0] for g in got], body=[g[1] for g in got], failed=[g[2] for g in got])

    return grid.where(allowed_scheme(F.col("url"))).mapInPandas(run, grid.schema.simpleString()[7:-1].replace(":", " ") + ", content_type string, body binary, failed boolean")


def request_outcome(fetched: DataFrame) -> DataFrame:
    bad = F.col("failed") | ~usable(F.col("content_type"), F.col("body"))
    return fetched.groupBy("request_id").agg(F.count("*").alias("tiles"), F.count_if(bad).alias("failed"), (F.count_if(bad) == F.count("*")).alias("all_failed"))
