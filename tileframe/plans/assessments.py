"""Statistics, severity, reports and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reports
from ..model import ACTIONS, TIERS, TIMELINES, style_dimension, tier_dimension
from ..operators import stats
from ..sources import fixtures as fx
from .registry import query

BUILDINGS = """buildings AS (
  SELECT c_custkey AS customer_key, c_nationkey AS nation_key,
    CASE WHEN l_discount >= 0.10 THEN 4 WHEN l_discount >= 0.09 THEN 3 WHEN l_discount >= 0.08 THEN 2 ELSE 1 END AS damage_class,
    l_extendedprice AS area, l_discount + 0.0 AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def record(confidence: bool = True) -> str:
    size = lambda k: f"coalesce(round(sum(CASE WHEN damage_class = {k} THEN area END), 2), 0.0)"
    pct = lambda k: f"round(100.0::DOUBLE * count(*) FILTER (damage_class = {k}) / greatest(count(*), 1), 6)"
    cols = ["count(*) AS total_buildings"]
    cols += [f"count(*) FILTER (damage_class = {k}) AS {n}" for k, n in ((1, "no_damage"), (2, "minor_damage"), (3, "major_damage"), (4, "destroyed"))]
    cols += ["count(*) FILTER (damage_class > 1) AS damaged"]
    cols += [f"{size(k)} AS {n}" for k, n in ((2, "minor_area"), (3, "major_area"), (4, "destroyed_area"))]
    cols += [f"{pct(k)} AS {n}" for k, n in ((1, "no_damage_pct"), (2, "minor_damage_pct"), (3, "major_damage_pct"), (4, "destroyed_pct"))]
    return ", ".join(cols + (["coalesce(round(avg(confidence), 6), 0.0) AS mean_conf"] if confidence else []))


STATS = f"{BUILDINGS}, stats AS (SELECT customer_key, {record()} FROM buildings GROUP BY customer_key)"
TIER = "CASE " + " ".join(f"WHEN destroyed_pct <= {d} AND 100.0::DOUBLE * damaged / greatest(total_buildings, 1) <= {a} THEN {{{i}}}" for i, (_, d, a) in enumerate(TIERS[:-1])) + " ELSE {4} END"
NAME = TIER.format(*(f"'{t[0]}'" for t in TIERS))
INDEX = TIER.format(*range(len(TIERS)))
BY_CUSTOMER = f"WITH {STATS} SELECT *, {NAME} AS severity, {INDEX} AS tier FROM stats"


def by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.with_severity(stats.assess(fx.buildings(spark, sf_dir), "customer_key"))


@query(f"WITH {BUILDINGS} SELECT {record()}, round(coalesce(sum(CASE WHEN damage_class > 2 THEN area END), 0), 2) AS heavy_area FROM buildings")
def damage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx.buildings(spark, sf_dir).where(F.col("damage_class").between(1, 4))
    heavy = F.round(F.coalesce(F.sum(F.when(F.col("damage_class") > 2, F.col("area"))), F.lit(0.0)), 2)
    return b.agg(*stats.assessment_columns(), heavy.alias("heavy_area"))


@query(f"WITH {BUILDINGS} SELECT nation_key, {record(False)} FROM buildings GROUP BY nation_key")
def stored_layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.assess(fx.buildings(spark, sf_dir), "nation_key", confidence=None)


@query(BY_CUSTOMER)
def severity_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_customer(spark, sf_dir)


@query(f"WITH s AS ({BY_CUSTOMER}) SELECT customer_key, severity AS tier_name, tier FROM s")
def severity_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tiers by a theta join on the tier dimension and the least index."""
    s = stats.assess(fx.buildings(spark, sf_dir), "customer_key")
    t = F.broadcast(tier_dimension(spark).drop("actions"))
    damaged = 100.0 * F.col("damaged") / F.greatest("total_buildings", F.lit(1))
    fits = s.join(t, (F.col("destroyed_pct") <= F.col("max_destroyed")) & (damaged <= F.col("max_damaged")))
    return fits.groupBy("customer_key").agg(F.min_by("severity", "tier").alias("tier_name"), F.min("tier").alias("tier"))


BEST = "greatest(no_damage, minor_damage, major_damage, destroyed)"


@query(f"WITH {STATS} SELECT customer_key, CASE WHEN no_damage = {BEST} THEN 'No Damage' WHEN minor_damage = {BEST} THEN 'Minor' WHEN major_damage = {BEST} THEN 'Major' ELSE 'Destroyed' END AS dominant FROM stats")
def dominant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = by_customer(spark, sf_dir)
    return s.select("customer_key", stats.dominant_class(s).alias("dominant"))


SKEW = "round(100.0::DOUBLE * destroyed / greatest(damaged, 1), 4)"


@query(f"WITH {STATS} SELECT customer_key, {SKEW} AS skew_pct, CASE WHEN damaged = 0 THEN 'none' WHEN {SKEW} > 60 THEN 'total loss' WHEN {SKEW} > 30 THEN 'rebuild' ELSE 'repair' END AS skew FROM stats")
def damage_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = by_customer(spark, sf_dir)
    pct, band = stats.damage_skew(s)
    return s.select("customer_key", pct.alias("skew_pct"), band.alias("skew"))


@query(f"WITH {STATS} SELECT customer_key, CASE WHEN mean_conf * 12 > 0.75 THEN 'high' WHEN mean_conf * 12 > 0.5 THEN 'moderate' ELSE 'low' END AS note FROM stats")
def conf_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_customer(spark, sf_dir).select("customer_key", stats.confidence_note(F.col("mean_conf") * 12).alias("note"))


LIST = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"WITH s AS ({BY_CUSTOMER}) SELECT customer_key, severity, {LIST(TIMELINES)}[tier + 1] AS timeline, array_to_string([{', '.join(LIST(a) for a in ACTIONS)}][tier + 1], '; ') AS actions FROM s")
def response_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = by_customer(spark, sf_dir).join(F.broadcast(tier_dimension(spark).select("tier", "timeline", "actions")), "tier")
    return s.select("customer_key", "severity", "timeline", F.array_join("actions", "; ").alias("actions"))


@query(f"WITH {BUILDINGS} SELECT damage_class, n, label, fill, outline, 0.3::DOUBLE AS opacity FROM (SELECT damage_class, count(*) AS n FROM buildings GROUP BY damage_class) JOIN (VALUES (1, 'No Damage', '0,255,0,255', '#00aa00'), (2, 'Minor Damage', '255,255,0,255', '#cccc00'), (3, 'Major Damage', '255,165,0,255', '#cc8800'), (4, 'Destroyed', '255,0,0,255', '#cc0000')) s(k, label, fill, outline) ON k = damage_class")
def style_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fx.buildings(spark, sf_dir).groupBy("damage_class").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(style_dimension(spark)), "damage_class")


@query(f"WITH {BUILDINGS} SELECT c_mktsegment AS segment, nation_key, count(*) AS total_buildings, count(*) FILTER (damage_class > 1) AS damaged, round(sum(area), 2) AS area, GROUPING(c_mktsegment, nation_key) AS level FROM buildings JOIN customer ON customer_key = c_custkey GROUP BY ROLLUP (c_mktsegment, nation_key)")
def stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_key"), F.col("c_mktsegment").alias("segment"))
    b = fx.buildings(spark, sf_dir).join(segments, "customer_key")
    return b.rollup("segment", "nation_key").agg(
        F.count("*").alias("total_buildings"), F.count_if(F.col("damage_class") > 1).alias("damaged"), F.round(F.sum("area"), 2).alias("area"), F.grouping_id().alias("level")
    )


STAGE_PROFILE = """WITH e AS (SELECT event_type AS stage, value AS duration FROM events),
 w AS (SELECT stage, count(*) AS n, sum(duration) AS total, max(duration) AS top, min(duration) AS low, list_sort(list(duration)) AS d FROM e GROUP BY stage)
SELECT stage, n AS "count", round(total, 4) AS total_s, round(1000.0 * total / n, 4) AS mean_ms, round(1000.0 * d[n // 2 + 1], 4) AS p50_ms,
 round(1000.0 * d[least(floor(n * 0.95)::BIGINT, n - 1) + 1], 4) AS p95_ms, round(1000.0 * top, 4) AS max_ms, round(1000.0 * low, 4) AS min_ms,
 round(100.0 * total / greatest(sum(total) OVER (), 1e-9), 4) AS pct_total FROM w"""


@query(STAGE_PROFILE)
def stage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stage_profile(fx.stage_events(spark, sf_dir)).orderBy(F.desc("total_s"), "stage")


@query("""WITH w AS (SELECT sum(value) AS seconds, count(*) AS tiles, count(*) FILTER (event_type = 'purchase') AS polygons FROM events)
SELECT round(tiles * 512 * 512 / 1e6 / greatest(seconds, 1e-9), 2) AS megapixels_per_sec, round(tiles / greatest(seconds, 1e-9), 2) AS tiles_per_sec,
 round(tiles * 4 * 2 / greatest(seconds, 1e-9), 2) AS forwards_per_sec, round(polygons / greatest(seconds, 1e-9), 2) AS polygons_per_sec, tiles * 8 AS forward_passes FROM w""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    w = e.agg(F.sum("value").alias("seconds"), F.count("*").alias("tiles"), F.count_if(F.col("event_type") == "purchase").alias("polygons"))
    s, tiles = F.col("seconds"), F.col("tiles")
    passes = tiles * 4 * 2  # orientations and members
    return w.select(
        stats.rate(tiles * 512 * 512 / F.lit(1e6), s).alias("megapixels_per_sec"),
        stats.rate(tiles, s).alias("tiles_per_sec"),
        stats.rate(passes, s).alias("forwards_per_sec"),
        stats.rate(F.col("polygons"), s).alias("polygons_per_sec"),
        passes.alias("forward_passes"),
    )


@query("SELECT event_type AS name, count(*) AS counter, arg_max(value, event_id) AS scalar FROM events GROUP BY event_type")
def counters_and_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters add up; of a scalar's values the last wins."""
    e = fx.table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("counter"), F.max_by("value", "event_id").alias("scalar"))


@query("""WITH t AS (SELECT l_linenumber AS tile_row, count(*) AS tiles FROM lineitem GROUP BY l_linenumber), r AS (SELECT tile_row, tiles, sum(tiles) OVER (ORDER BY tile_row)::BIGINT AS done, sum(tiles) OVER ()::BIGINT AS total FROM t)
SELECT tile_row, done, least(greatest(20 + (70 * done) // total, 0), 100)::BIGINT AS percent FROM r""")
def progress_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress in the band from 20 to 90 percent after each row of tiles; the windows run over the few summed rows."""
    from pyspark.sql import Window

    t = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("tile_row")).agg(F.count("*").alias("tiles"))
    r = t.select("tile_row", F.sum("tiles").over(Window.orderBy("tile_row")).alias("done"), F.sum("tiles").over(Window.partitionBy()).alias("total"))
    return r.select("tile_row", "done", F.least(F.greatest(F.expr("20 + (70 * done) div total"), F.lit(0)), F.lit(100)).cast("long").alias("percent"))


def filled_sql(template: str) -> str:
    """reports.filled in the SQL of the tests."""
    text = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    parts, at = [], 0
    for m in reports.FIELD.finditer(template):
        parts.append(text(template[at : m.start()]))
        parts.append(f"format('{{:,}}', {m[1]}::BIGINT)" if m[2] == "," else f"printf('%{m[2]}', round({m[1]}::DOUBLE, {m[2][1:-1]}))" if m[2] else f"{m[1]}::VARCHAR")
        at = m.end()
    return " || ".join([*parts, text(template[at:])])


def lines_sql(template: tuple[str, ...]) -> str:
    return " || chr(10) || ".join(f"({filled_sql(line)})" for line in template)


def tier_sql(texts: tuple[str, ...]) -> str:
    return "CASE tier " + " ".join(f"WHEN {k} THEN {filled_sql(t)}" for k, t in enumerate(texts)) + " END"


REPORTED = f"""r AS (SELECT *, CASE WHEN no_damage = {BEST} THEN 'No Damage' WHEN minor_damage = {BEST} THEN 'Minor' WHEN major_damage = {BEST} THEN 'Major' ELSE 'Destroyed' END AS dominant, {SKEW} AS skew_pct,
 CASE WHEN damaged = 0 THEN 'none' WHEN {SKEW} > 60 THEN 'total loss' WHEN {SKEW} > 30 THEN 'rebuild' ELSE 'repair' END AS skew, CASE WHEN mean_conf > 0.75 THEN 'high' WHEN mean_conf > 0.5 THEN 'moderate' ELSE 'low' END AS note,
 {tier_sql(reports.SUMMARIES)} AS summary, {tier_sql(TIMELINES)} AS timeline, {tier_sql(tuple(chr(10).join('- ' + a for a in x) for x in ACTIONS))} AS action_list FROM ({BY_CUSTOMER}))"""


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by customer with all that reports name."""
    s = by_customer(spark, sf_dir)
    pct, band = stats.damage_skew(s)
    s = s.withColumns({"dominant": stats.dominant_class(s), "skew_pct": pct, "skew": band, "note": stats.confidence_note(F.col("mean_conf"))})
    return s.withColumns({"summary": reports.summary(), **reports.response_columns(ACTIONS)})


@query(f"WITH {REPORTED} SELECT customer_key, {lines_sql(reports.PATTERN)} AS pattern, {lines_sql(reports.SITUATION)} AS situation, {lines_sql(reports.RESPONSE)} AS response FROM r")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three reports of each customer's buildings; the situation report's summary is one of five, by tier."""
    r = reported(spark, sf_dir)
    return r.select("customer_key", reports.lines(reports.PATTERN).alias("pattern"), reports.lines(reports.SITUATION).alias("situation"), reports.lines(reports.RESPONSE).alias("response"))


@query(f"""WITH {REPORTED}, o AS (SELECT o_custkey, max(o_orderdate)::TIMESTAMP AS made FROM orders GROUP BY o_custkey)
SELECT customer_key, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset=''utf-8''><title>Damage ' || customer_key || '</title></head>' || chr(10) || '<body>' || chr(10) || '<p>' || strftime(made, '%Y-%m-%d %H:%M') || '</p>' || chr(10)
 || '<h2>Response priorities</h2>' || chr(10) || '<br>' || chr(10) || '<p><b>Severity:</b> ' || severity || '</p>' || chr(10) || '<p><b>Time:</b> ' || timeline || '</p>' || chr(10) || '<br>' || chr(10)
 || '<ul>' || chr(10) || '<li>' || replace(substr(action_list, 3), chr(10) || '- ', '</li>' || chr(10) || '<li>') || '</li>' || chr(10) || '</ul>' || chr(10) || '</body></html>' AS report FROM r JOIN o ON o_custkey = customer_key""")
def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response report as a page, with a time at its head: here that of the last order, so that it can be tested."""
    from ..functions.text import markdown_html

    made = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer_key")).agg(F.max("o_orderdate").cast("timestamp").alias("made"))
    r = reported(spark, sf_dir).join(made, "customer_key")
    title = F.concat(F.lit("Damage "), F.col("customer_key").cast("string"))
    return r.select("customer_key", reports.page(title, markdown_html(reports.lines(reports.RESPONSE)), F.col("made")).alias("report"))


@query(f"""WITH {BUILDINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY damage_class, area, confidence) AS id FROM buildings)
SELECT customer_key, id, damage_class, CASE damage_class WHEN 1 THEN 'No Damage' WHEN 2 THEN 'Minor Damage' WHEN 3 THEN 'Major Damage' ELSE 'Destroyed' END AS damage_name, round(area, 2) AS area_m2, round(confidence, 4) AS confidence FROM o""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import layer_rows

    return layer_rows(fx.buildings(spark, sf_dir), ["customer_key"], ["damage_class", "area", "confidence"])
