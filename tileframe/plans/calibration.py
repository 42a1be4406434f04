"""Queries on calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import softmax
from ..operators import calibrate
from ..sources import fixtures as fx
from .pixels import LOGITS, MEAN, SOFT
from .registry import query

TEMPERATURES = [0.5, 1.0, 1.5, 2.5, 4.0]
LOSSES = " UNION ALL ".join(
    f"SELECT {t}::DOUBLE AS t, round(avg(-ln(q[y_true + 1] + 1e-12)), 6) AS nll, count(*) AS n FROM (SELECT y_true, {MEAN} AS q FROM (SELECT y_true, {SOFT.format(t=t)} AS s FROM logits))" for t in TEMPERATURES
)


@query(f"WITH {LOGITS} {LOSSES}")
def calib_nll_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = fx.logits(spark, sf_dir)
    n = z.agg(F.count("*").alias("n"))
    return calibrate.nll_grid(z, TEMPERATURES).crossJoin(F.broadcast(n)).select("t", F.round("nll", 6).alias("nll"), "n")


@query(f"WITH {LOGITS}, g AS ({LOSSES}) SELECT arg_min(t, nll) AS best_t FROM g")
def calib_grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calib_nll_grid(spark, sf_dir).agg(F.min_by("t", "nll").alias("best_t"))


BINS = f"{LOGITS}, p AS (SELECT y_true, list_transform(z[1], lambda v: exp(v - list_max(z[1])) / list_sum(list_transform(z[1], lambda u: exp(u - list_max(z[1]))))) AS q FROM logits), b AS (SELECT ceil(list_max(q) * 15)::INT AS bin, list_max(q) AS conf, (list_position(q, list_max(q)) - 1 = y_true)::INT::DOUBLE AS hit FROM p), g AS (SELECT bin, count(*) AS n, avg(conf) AS conf, avg(hit) AS acc FROM b WHERE bin >= 1 GROUP BY bin)"


@query(f"WITH {BINS} SELECT bin, n, round(conf, 6) AS conf, round(acc, 6) AS acc FROM g")
def calib_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = fx.logits(spark, sf_dir).select("y_true", softmax(F.element_at("z", 1)).alias("p"))
    return calibrate.calibration_error(z, F.col("p")).select("bin", "n", F.round("conf", 6).alias("conf"), F.round("acc", 6).alias("acc"))


@query(f"WITH {BINS} SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM g")
def calib_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = fx.logits(spark, sf_dir).select("y_true", softmax(F.element_at("z", 1)).alias("p"))
    return calibrate.ece(z, F.col("p")).select(F.round("ece", 6).alias("ece"))


def fit_sql(low: float = 0.25, high: float = 4.0, levels: int = 5) -> str:
    """The same grids, each between the neighbours of the best point of the one before, as one common table after another."""
    loss = f"(SELECT avg(-ln(q[y_true + 1] + 1e-12)) FROM (SELECT y_true, {MEAN} AS q FROM (SELECT y_true, {SOFT.format(t='p.t')} AS s FROM logits)))"
    parts = [f"p0 AS (SELECT i, {low} * pow({high / low}, i / 24.0::DOUBLE) AS t FROM range(25) r(i))"]
    for k in range(levels):
        parts.append(f"g{k} AS MATERIALIZED (SELECT i, t, {loss} AS nll FROM p{k} p)")
        parts.append(f"b{k} AS MATERIALIZED (SELECT (SELECT t FROM g{k} WHERE i = greatest(m.i - 1, 0)) AS a, m.t AS best, (SELECT t FROM g{k} WHERE i = least(m.i + 1, (SELECT max(i) FROM g{k}))) AS b FROM (SELECT i, t FROM g{k} ORDER BY nll, t LIMIT 1) m)")
        parts.append(f"p{k + 1} AS (SELECT i, a * pow(b / a, i / 16.0::DOUBLE) AS t FROM b{k}, range(17) r(i))")
    return ", ".join(parts[:-1]) + f" SELECT round(best, 2) AS temperature, (SELECT count(*) FROM logits) AS n_pixels FROM b{levels - 1}"


@query(f"WITH {LOGITS}, {fit_sql()}")
def calib_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted temperature, from the calibration document that a run reads."""
    from ..sources.sinks import calibration_document

    z = fx.logits(spark, sf_dir)
    t = calibrate.fit(z)
    doc = calibration_document(spark, t, {"nll_before": calibrate.nll(z, 1.0), "nll_after": calibrate.nll(z, t)}, z.count())
    back = doc.select(F.from_json("document", "cls_temperature double, n_pixels long").alias("d"))
    return back.select(F.round("d.cls_temperature", 2).alias("temperature"), "d.n_pixels")


@query("SELECT customer_key, h FROM (SELECT c_custkey AS customer_key, (((c_custkey + 7) * 2654435761) % 2147483648)::BIGINT AS h FROM customer ORDER BY h, c_custkey LIMIT 64)")
def sample_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample without replacement of bounded size: the feature is the limit."""
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_key"))
    return calibrate.sample_rows(c, "customer_key", 64, 7).withColumn("h", calibrate.pseudo_random(F.col("customer_key"), 7))


@query("SELECT nation_key, customer_key FROM (SELECT c_nationkey AS nation_key, c_custkey AS customer_key, row_number() OVER (PARTITION BY c_nationkey ORDER BY ((c_custkey + 11) * 2654435761) % 2147483648, c_custkey) AS r FROM customer) WHERE r <= 5")
def sample_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation_key"), F.col("c_custkey").alias("customer_key"))
    return calibrate.sample_each(c, "nation_key", "customer_key", 5, 11)
