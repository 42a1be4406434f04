"""The relations of an assessment, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID, CHIP = 20, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, v): embeddings as 8 x 8 chips on a grid of 20 chips a row."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    y = F.expr(f"cast((vec_id div {GRID}) * {CHIP} + i div {CHIP} as int)")
    x = F.expr(f"cast((vec_id % {GRID}) * {CHIP} + i % {CHIP} as int)")
    return e.select(y.alias("y"), x.alias("x"), F.col("v").cast("double").alias("v"))


def scene_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chip, y, x, pre, post): each chip and the one after it, in the chip's own coordinates."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count("*").alias("n"))
    nxt = e.crossJoin(F.broadcast(n)).select(F.expr("(vec_id + n - 1) % n").alias("vec_id"), F.col("embedding").alias("post"))
    both = e.join(nxt, "vec_id").select("vec_id", F.posexplode(F.arrays_zip("embedding", "post")).alias("i", "z"))
    return both.select(
        F.col("vec_id").alias("chip"),
        F.expr(f"i div {CHIP}").cast("int").alias("y"),
        F.expr(f"i % {CHIP}").cast("int").alias("x"),
        F.col("z.embedding").cast("double").alias("pre"),
        F.col("z.post").cast("double").alias("post"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y_true, loc, z): a localisation logit and two members of four class logits."""
    member = lambda k: F.transform(F.slice("embedding", k, 4), lambda v: v.cast("double") * 20.0)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("label") % 4).cast("int").alias("y_true"),
        (F.element_at("embedding", 9).cast("double") * 20.0).alias("loc"),
        F.array(member(1), member(5)).alias("z"),
    )


def probabilities(spark: SparkSession, sf_dir: str, scale: float = 10.0) -> DataFrame:
    """(y, x, loc, p1..p4): a pixel's location probability and its joint class probabilities, all from the scene.

    The pixel's value, and those of the chips one to three places on, are the logits."""
    s = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = s.agg(F.count("*").alias("n"))
    s = s.crossJoin(F.broadcast(n))
    out = s.select("vec_id", F.col("embedding").alias("e0"))
    for k in (1, 2, 3):
        out = out.join(s.select(F.expr(f"(vec_id + n - {k} % n) % n").alias("vec_id"), F.col("embedding").alias(f"e{k}")), "vec_id")
    px = out.select("vec_id", F.posexplode(F.arrays_zip("e0", "e1", "e2", "e3")).alias("i", "e"))
    y, x = F.expr(f"cast((vec_id div {GRID}) * {CHIP} + i div {CHIP} as int)"), F.expr(f"cast((vec_id % {GRID}) * {CHIP} + i % {CHIP} as int)")
    z = [F.col(f"e.e{k}").cast("double") * scale for k in range(4)]
    return px.select(y.alias("y"), x.alias("x"), z[0].alias("z0"), F.array(*z).alias("z"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer_key, nation_key, damage_class, area, confidence) of each line item."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    d = F.col("l_discount")
    cls = F.when(d >= 0.10, 4).when(d >= 0.09, 3).when(d >= 0.08, 2).otherwise(1)
    return (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("o_custkey") == customer.c_custkey)
        .select(F.col("c_custkey").alias("customer_key"), F.col("c_nationkey").alias("nation_key"), cls.alias("damage_class"), F.col("l_extendedprice").alias("area"), (d + 0.0).alias("confidence"))
    )


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("duration"), "ts", "event_id")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, crs, xmin, ymin, xmax, ymax, width, height): one scene a nation, some shifted by under or over half a pixel."""
    k = F.col("n_nationkey")
    shift = F.when(k % 3 == 1, 0.3).when(k % 3 == 2, 0.8).otherwise(0.0)
    return table(spark, sf_dir, "nation").select(
        k.alias("scene_id"),
        F.when(k % 7 == 6, "EPSG:3857").otherwise("EPSG:32610").alias("crs"),
        (F.lit(1000.0) + shift).alias("xmin"),
        F.lit(2000.0).alias("ymin"),
        (F.lit(1200.0) + shift).alias("xmax"),
        F.lit(2160.0).alias("ymax"),
        F.when(k % 5 == 4, 100).otherwise(200).alias("width"),
        F.lit(160).alias("height"),
    )


def aoi_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aoi_id, xmin, ymin, xmax, ymax): a rectangle for each region."""
    k = F.col("r_regionkey").cast("double")
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("aoi_id"), (k * 40).alias("xmin"), (k * 15).alias("ymin"), (k * 40 + 25).alias("xmax"), (k * 15 + 20).alias("ymax"))


def tile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, zoom, lat, lon, width, height): one request a nation."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.alias("request_id"), F.lit(17).alias("zoom"), (k * 6 - 72).cast("double").alias("lat"), (k * 14 - 170).cast("double").alias("lon"), (F.lit(256) + (k % 4) * 256).cast("int").alias("width"), (F.lit(512) + (k % 3) * 128).cast("int").alias("height")
    )
