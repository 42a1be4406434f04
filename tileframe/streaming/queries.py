"""Streams: profiles by window, and tiles blended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid
from ..plans.pixels import COVER, WEIGHT, scene_size
from ..plans.registry import query
from ..sources import fixtures as fx
from ..storage import shared_dir


def drained(stream: DataFrame, keys: list[str]) -> DataFrame:
    """All of an aggregated stream that is there now, as a table in the shared folder: each batch writes the rows that it
    changed (mode update), one that is run again after a failure replaces its own part, and of a key the last batch's row
    counts. Groups behind the watermark leave the state."""
    spark = stream.sparkSession
    folder = shared_dir(spark)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    return out.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "batch").alias("last")).select(*keys, "last.*")


def added(stream: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums by keys of all of a stream that is there now. Each batch is added up on its own and kept as a part of a table, so
    the stream has no state; the parts are added up when they are read."""
    spark = stream.sparkSession
    folder = shared_dir(spark)
    total = lambda df: df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))

    def write(batch: DataFrame, n: int) -> None:
        total(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return total(spark.read.schema(total(stream).schema).parquet(f"{folder}/out"))


def profile(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Stages by tumbling hour: count, total and extremes, with a watermark for late events."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", "1 hour"), "stage").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("total_s"), F.max("duration").alias("max_s"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type AS stage, count(*) AS n, round(sum(value), 4) AS total_s, max(value) AS max_s FROM events GROUP BY 1, 2")
def stream_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fx.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    out = drained(profile(raw.select(F.col("event_type").alias("stage"), F.col("value").alias("duration"), "ts")), ["window", "stage"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "stage", "n", "total_s", "max_s")


@query(f"WITH {COVER} SELECT y, x, round(sum((v + 0.01 * y0) * {WEIGHT}) / greatest(sum({WEIGHT}), 1e-6), 6) AS p FROM cover GROUP BY y, x")
def stream_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that arrive as files are added to running sums of weighted values and weights."""
    s = fx.scene(spark, sf_dir)
    folder = shared_dir(spark)
    grid.cover(s, *scene_size(s), 64, 8).select("y", "x", "v", "y0", "x0").write.parquet(f"{folder}/tiles")
    tiles = spark.readStream.schema("y int, x int, v double, y0 int, x0 int").parquet(f"{folder}/tiles")
    weight = grid.hann(F.col("y") - F.col("y0"), 64) * grid.hann(F.col("x") - F.col("x0"), 64)
    sums = tiles.select("y", "x", ((F.col("v") + 0.01 * F.col("y0")) * weight).alias("s"), weight.alias("t"))
    return added(sums, ["y", "x"], ["s", "t"]).select("y", "x", F.round(F.col("s") / F.greatest("t", F.lit(1e-6)), 6).alias("p"))
