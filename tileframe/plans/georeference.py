"""Queries on grids, maps, imagery requests and areas of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalar import clamp
from ..operators import registration, vectors
from ..sources import fixtures as fx
from ..sources.imagery import request_grid, with_world_file
from .registry import query

SCENES = """scenes AS (SELECT n_nationkey AS scene_id, CASE WHEN n_nationkey % 7 = 6 THEN 'EPSG:3857' ELSE 'EPSG:32610' END AS crs,
 1000.0::DOUBLE + CASE n_nationkey % 3 WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 0 END AS xmin, 2000.0::DOUBLE AS ymin,
 1200.0::DOUBLE + CASE n_nationkey % 3 WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 0 END AS xmax, 2160.0::DOUBLE AS ymax,
 CASE WHEN n_nationkey % 5 = 4 THEN 100 ELSE 200 END AS width, 160 AS height FROM nation)"""


@query(f"""WITH {SCENES} SELECT b.scene_id, a.width = b.width AND a.height = b.height AND a.crs = b.crs AND abs(a.xmin - b.xmin) <= (a.xmax - a.xmin) / a.width / 2 AND abs(a.xmax - b.xmax) <= (a.xmax - a.xmin) / a.width / 2
 AND abs(a.ymin - b.ymin) <= (a.ymax - a.ymin) / a.height / 2 AND abs(a.ymax - b.ymax) <= (a.ymax - a.ymin) / a.height / 2 AS alike FROM scenes a, scenes b WHERE a.scene_id = 0""")
def grid_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scene's grid against the reference scene's; the reference is one row."""
    s = fx.scenes(spark, sf_dir)
    ref = s.where("scene_id = 0").select(F.struct("*").alias("a"))
    return s.select(F.struct("*").alias("b")).crossJoin(F.broadcast(ref)).select("b.scene_id", registration.grids_alike("a", "b").alias("alike"))


@query(f"WITH {SCENES}, r AS (SELECT scene_id, (xmax - xmin) / width * (0.1::DOUBLE + scene_id * 0.25::DOUBLE) AS ratio FROM scenes) SELECT scene_id, round(ratio, 6) AS ratio, round(CASE WHEN ratio BETWEEN 1 / 1.25::DOUBLE AND 1.25 THEN 1.0::DOUBLE ELSE least(greatest(ratio, 0.25), 4.0) END, 6) AS scale FROM r")
def gsd_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.scenes(spark, sf_dir)
    r = s.select("scene_id", ((F.col("xmax") - F.col("xmin")) / F.col("width") * (F.lit(0.1) + F.col("scene_id") * 0.25)).alias("ratio"))
    return r.select("scene_id", F.round("ratio", 6).alias("ratio"), F.round(registration.rescale(F.col("ratio")), 6).alias("scale"))


@query("""WITH a AS (SELECT n_nationkey AS k, (n_nationkey * 14 - 170)::DOUBLE AS lon, (n_nationkey * 6 - 72)::DOUBLE AS lat, CASE WHEN n_nationkey % 5 = 4 THEN 'EPSG:32610' ELSE 'EPSG:4326' END AS crs FROM nation)
SELECT k AS aoi_id, crs = 'EPSG:4326' AS usable, CASE WHEN crs = 'EPSG:4326' THEN round(lon / 180 * 20037508.343, 3) END AS x, CASE WHEN crs = 'EPSG:4326' THEN round(asinh(tan(radians(lat))) / pi() * 20037508.343, 3) END AS y FROM a""")
def aoi_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First corners of areas of interest on the raster's map; an area whose system has no way there doesn't count."""
    k = F.col("n_nationkey")
    lon, lat = (k * 14 - 170).cast("double"), (k * 6 - 72).cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(lon, lat), corner(lon + 1, lat), corner(lon + 1, lat + 1))
    a = fx.table(spark, sf_dir, "nation").select(k.alias("aoi_id"), ring.alias("ring"), F.when(k % 5 == 4, "EPSG:32610").otherwise("EPSG:4326").alias("crs"))
    a = a.withColumn("ring", geo.reprojected(F.col("ring"), F.col("crs"), F.lit("EPSG:3857")))
    return a.select("aoi_id", F.col("ring").isNotNull().alias("usable"), F.round(F.col("ring")[0]["x"], 3).alias("x"), F.round(F.col("ring")[0]["y"], 3).alias("y"))


@query("""WITH u AS (SELECT n_nationkey AS scene_id, CASE n_nationkey % 4 WHEN 0 THEN 'metre' WHEN 1 THEN 'degree' WHEN 2 THEN 'foot' ELSE 'us-foot' END AS unit, (n_nationkey * 3 - 30)::DOUBLE AS lat FROM nation)
SELECT scene_id, unit, round(CASE unit WHEN 'degree' THEN pi() / 180 * 6378137.0 * cos(radians(lat)) / sqrt(1 - 0.00669437999014 * pow(sin(radians(lat)), 2)) WHEN 'foot' THEN 0.3048 WHEN 'us-foot' THEN 1200.0::DOUBLE / 3937 ELSE 1.0 END, 6) AS metres FROM u""")
def gsd_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    unit = F.when(k % 4 == 0, "metre").when(k % 4 == 1, "degree").when(k % 4 == 2, "foot").otherwise("us-foot")
    u = fx.table(spark, sf_dir, "nation").select(k.alias("scene_id"), unit.alias("unit"), (k * 3 - 30).cast("double").alias("lat"))
    return u.select("scene_id", "unit", F.round(geo.metres_per_unit(F.col("unit"), F.col("lat")), 6).alias("metres"))


@query("""SELECT l_partkey, l_suppkey, round(sum(1000.0::DOUBLE + (l_partkey % 200) * 0.5), 4) AS x, round(sum(2160.0::DOUBLE - (l_suppkey % 160) * 0.5), 4) AS y, round(sum(l_quantity * 0.25), 4) AS area, max(l_linenumber % 4 + 1)::DOUBLE / 4 AS intensity
FROM lineitem GROUP BY l_partkey, l_suppkey""")
def pixel_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = fx.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    x, y = geo.pixel_to_map(F.col("l_partkey") % 200, F.col("l_suppkey") % 160, F.lit(1000.0), F.lit(2160.0), F.lit(0.5), F.lit(0.5))
    return li.groupBy("l_partkey", "l_suppkey").agg(
        F.round(F.sum(x), 4).alias("x"), F.round(F.sum(y), 4).alias("y"), F.round(F.sum(F.col("l_quantity") * 0.5 * 0.5), 4).alias("area"), (F.max(F.col("l_linenumber") % 4 + 1).cast("double") / 4.0).alias("intensity")
    )


@query("""WITH r AS (SELECT p_partkey, (p_size % 7 + 2)::DOUBLE AS a, (p_size % 5 + 1)::DOUBLE AS b FROM part)
SELECT p_partkey, round(a * b + a * b / 2, 6) AS area, round((a * b * a / 2 + a * b / 2 * (a * 4 / 3)) / (a * b * 1.5), 6) AS cx, round((a * b * b / 2 + a * b / 2 * (b / 3)) / (a * b * 1.5), 6) AS cy FROM r""")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and centroid of a rectangle with a triangle at its right side; the SQL adds up the two parts."""
    r = fx.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 7 + 2).cast("double").alias("a"), (F.col("p_size") % 5 + 1).cast("double").alias("b"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    ring = F.array(point(zero, zero), point(F.col("a") * 2, zero), point(F.col("a"), F.col("b")), point(zero, F.col("b")))
    r = r.withColumn("ring", ring)
    cx, cy = geo.centroid(F.col("ring"))
    return r.select("p_partkey", F.round(geo.shoelace(F.col("ring")), 6).alias("area"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


@query("SELECT p_partkey, 'POLYGON ((0 0, ' || p_size || ' 0, ' || p_size || ' ' || (p_size + 1) || ', 0 0))' AS wkt FROM part")
def wkt_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    zero = F.lit(0)
    return fx.table(spark, sf_dir, "part").select("p_partkey", geo.wkt(F.array(point(zero, zero), point(s, zero), point(s, s + 1), point(zero, zero))).alias("wkt"))


AOI = """pts AS (SELECT l_orderkey, (l_partkey % 200)::DOUBLE AS x, (l_suppkey % 80)::DOUBLE AS y, l_extendedprice AS area FROM lineitem),
 aoi AS (SELECT r_regionkey * 40.0 AS x0, r_regionkey * 15.0 AS y0, r_regionkey * 40.0 + 25 AS x1, r_regionkey * 15.0 + 20 AS y1 FROM region{0})"""


@query(f"WITH {AOI.format('')} SELECT l_orderkey, count(*) AS buildings, round(sum(area), 2) AS area FROM pts p WHERE EXISTS (SELECT 1 FROM aoi WHERE x <= x1 AND x + 2 >= x0 AND y <= y1 AND y + 2 >= y0) GROUP BY l_orderkey")
def aoi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clipped(spark, sf_dir, fx.aoi_rects(spark, sf_dir))


@query("SELECT l_orderkey, count(*) AS buildings, round(sum(l_extendedprice), 2) AS area FROM lineitem GROUP BY l_orderkey")
def aoi_filter_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an area every building stays."""
    return clipped(spark, sf_dir, fx.aoi_rects(spark, sf_dir).where("aoi_id < 0"))


def clipped(spark: SparkSession, sf_dir: str, aoi: DataFrame) -> DataFrame:
    li = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 200).cast("double").alias("xmin"), (F.col("l_suppkey") % 80).cast("double").alias("ymin"), F.col("l_extendedprice").alias("area"))
    boxes = li.withColumns({"xmax": F.col("xmin") + 2, "ymax": F.col("ymin") + 2})
    return vectors.aoi_filter(boxes, aoi).groupBy("l_orderkey").agg(F.count("*").alias("buildings"), F.round(F.sum("area"), 2).alias("area"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE (l_partkey % 100) >= 10 AND (l_suppkey % 60) >= 5 AND (l_partkey % 100) + 2 * (l_suppkey % 60) <= 100 GROUP BY ALL")
def aoi_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings of no extent against a triangle: bounding boxes first, then the polygons themselves."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    li = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    x, y = F.col("l_partkey") % 100, F.col("l_suppkey") % 60
    boxes = li.select("*", x.cast("double").alias("xmin"), y.cast("double").alias("ymin"), x.cast("double").alias("xmax"), y.cast("double").alias("ymax"), F.array(point(x, y)).alias("ring"))
    corner = lambda a, b: point(F.lit(a), F.lit(b))
    area = spark.range(1).select(F.lit(10.0).alias("xmin"), F.lit(5.0).alias("ymin"), F.lit(90.0).alias("xmax"), F.lit(45.0).alias("ymax"), F.array(corner(10, 5), corner(90, 5), corner(10, 45)).alias("aoi_ring"))
    return vectors.aoi_filter(boxes, area, exact=geo.rings_intersect(F.col("ring"), F.col("aoi_ring"))).select("l_orderkey", "l_partkey", "l_suppkey", "n")


@query("SELECT n_nationkey AS request_id, round(n_nationkey * 1e6 / 20037508.343 * 180, 6) AS lon, round(degrees(atan(sinh(n_nationkey * 4e5 / 20037508.343 * pi()))), 6) AS lat FROM nation")
def map_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's centre in degrees."""
    lon, lat = geo.to_lonlat(F.col("n_nationkey") * F.lit(1e6), F.col("n_nationkey") * F.lit(4e5))
    return fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("request_id"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


REQUESTS = """req AS (SELECT n_nationkey AS request_id, 17 AS zoom, (n_nationkey * 6 - 72)::DOUBLE AS lat, (n_nationkey * 14 - 170)::DOUBLE AS lon, 256 + (n_nationkey % 4) * 256 AS width, 512 + (n_nationkey % 3) * 128 AS height FROM nation),
 st AS (SELECT *, trunc((lon + 180) / 360 * 131072)::INT AS cx, trunc((1 - asinh(tan(radians(lat))) / pi()) / 2 * 131072)::INT AS cy, greatest(1, (width + 255) // 256) AS nx, greatest(1, (height + 255) // 256) AS ny FROM req),
 w AS (SELECT *, cx - nx // 2 AS x0, cy - ny // 2 AS y0 FROM st)"""


@query(f"WITH {REQUESTS}, g AS (SELECT *, unnest(range(nx)) AS dx FROM w), h AS (SELECT *, unnest(range(ny)) AS dy FROM g) SELECT request_id, dx::INT AS dx, dy::INT AS dy, ((x0 + dx + 131072) % 131072)::INT AS tx, (y0 + dy)::INT AS ty, 'https://tiles.invalid/17/' || (y0 + dy) || '/' || ((x0 + dx + 131072) % 131072) AS url FROM h WHERE y0 + dy BETWEEN 0 AND 131071")
def xyz_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_grid(fx.tile_requests(spark, sf_dir), "imagery").select("request_id", "dx", "dy", "tx", "ty", "url")


@query(f"""WITH {REQUESTS}, m AS (SELECT *, 40075016.686::DOUBLE / 131072 / 256 AS px, x0 * (40075016.686::DOUBLE / 131072) - 40075016.686::DOUBLE / 2 AS west, 40075016.686::DOUBLE / 2 - y0 * (40075016.686::DOUBLE / 131072) AS north, (nx * 256 - width) // 2 AS cl, (ny * 256 - height) // 2 AS ct FROM w)
SELECT request_id, round(px, 8) AS pixel_width, round(-px, 8) AS pixel_height, round(west + cl * px + px / 2, 4) AS x, round(north - ct * px - px / 2, 4) AS y FROM m""")
def world_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = with_world_file(fx.tile_requests(spark, sf_dir))
    return w.select("request_id", *(F.round(c, n).alias(c) for c, n in (("pixel_width", 8), ("pixel_height", 8), ("x", 4), ("y", 4))))


@query("""WITH d AS (SELECT vec_id, vec_id % 4 AS dx, vec_id // 4 AS dy, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
 p AS (SELECT (i % 8 + dx * 256)::INT AS x, (i // 8 + dy * 256)::INT AS y, v FROM d), n AS (SELECT (4 * 256 - 768) // 2 AS cl, (((max(vec_id) // 4 + 1) * 256 - (max(vec_id) // 4 + 1) * 192) // 2)::INT AS ct, ((max(vec_id) // 4 + 1) * 192)::INT AS height FROM embeddings)
SELECT (x - cl)::INT AS x, (y - ct)::INT AS y, round(v, 6) AS v FROM p, n WHERE x >= cl AND x < cl + 768 AND y >= ct AND y < ct + height""")
def tile_scatter_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles put into a mosaic at their offsets, then cropped about the mosaic's centre to the size that was asked for."""
    from ..sources.imagery import centre_crop

    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    p = e.select((F.col("i") % 8 + F.col("vec_id") % 4 * 256).cast("int").alias("x"), (F.expr("i div 8") + F.expr("vec_id div 4") * 256).cast("int").alias("y"), F.col("v").cast("double").alias("v"))
    size = fx.table(spark, sf_dir, "embeddings").agg(F.expr("cast(max(vec_id) div 4 + 1 as int)").alias("rows"))
    size = size.select(F.lit(4 * 256).alias("width"), (F.col("rows") * 256).alias("height"), F.lit(768).alias("asked_w"), (F.col("rows") * 192).alias("asked_h"))
    return centre_crop(p, size).select("x", "y", F.round("v", 6).alias("v"))


@query("SELECT n_nationkey AS request_id, least(greatest(n_nationkey * 9 - 20, 0), 100)::INT AS percent, round(4 + (100 - n_nationkey * 4) / 100.0::DOUBLE * 20)::INT AS distance FROM nation")
def form_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress within bounds, and a separation slider as pixels."""
    k = F.col("n_nationkey")
    return fx.table(spark, sf_dir, "nation").select(k.alias("request_id"), clamp(k * 9 - 20, 0, 100).cast("int").alias("percent"), F.bround(4 + (100 - k * 4) / F.lit(100.0) * 20).cast("int").alias("distance"))


@query(f"""WITH {REQUESTS}, g AS (SELECT *, unnest(range(nx)) AS dx FROM w), h AS (SELECT *, unnest(range(ny)) AS dy FROM g),
 u AS (SELECT request_id, 'https://tiles.invalid/17/' || ((x0 + dx + 131072) % 131072) || '/' || (y0 + dy) || '.png' AS url FROM h WHERE y0 + dy BETWEEN 0 AND 131071)
SELECT request_id, count(*) AS tiles, count(*) FILTER (url LIKE '%7.png') AS failed, count(*) FILTER (url LIKE '%7.png') = count(*) AS all_failed FROM u GROUP BY request_id""")
def fetched_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of all requests through an injected fetch that fails for some; a request fails if all of its tiles do."""
    from ..sources.imagery import fetch, request_outcome

    def source(url: str) -> tuple[str, bytes]:
        if url.endswith("7.png"):
            raise OSError("no such tile")
        return "image/png", url.encode() * 40

    return request_outcome(fetch(request_grid(fx.tile_requests(spark, sf_dir), "streets"), source))
