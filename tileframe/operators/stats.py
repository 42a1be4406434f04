"""Aggregates of assessments and of run profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ACTIONS, TIERS, TIMELINES, severity


def assessment_columns(cls: str = "damage_class", area: str = "area", confidence: str | None = "confidence") -> list[Column]:
    """One aggregate for each field of a statistics record; sums are zero for no rows."""
    count = lambda k: F.count_if(F.col(cls) == k)
    size = lambda k: F.coalesce(F.round(F.sum(F.when(F.col(cls) == k, F.col(area))), 2), F.lit(0.0))
    total = F.count("*")
    pct = lambda k: F.round(100.0 * count(k) / F.greatest(total, F.lit(1)), 6)
    out = [
        total.alias("total_buildings"),
        count(1).alias("no_damage"),
        count(2).alias("minor_damage"),
        count(3).alias("major_damage"),
        count(4).alias("destroyed"),
        (count(2) + count(3) + count(4)).alias("damaged"),
        size(2).alias("minor_area"),
        size(3).alias("major_area"),
        size(4).alias("destroyed_area"),
        pct(1).alias("no_damage_pct"),
        pct(2).alias("minor_damage_pct"),
        pct(3).alias("major_damage_pct"),
        pct(4).alias("destroyed_pct"),
    ]
    return out + [F.coalesce(F.round(F.avg(confidence), 6), F.lit(0.0)).alias("mean_conf")] if confidence else out


def assess(buildings: DataFrame, *keys: str, confidence: str | None = "confidence") -> DataFrame:
    known = buildings.where(F.col("damage_class").between(1, 4))
    return known.groupBy(*keys).agg(*assessment_columns(confidence=confidence))


def with_severity(stats: DataFrame) -> DataFrame:
    name, index = severity(F.col("destroyed_pct"), 100.0 * F.col("damaged") / F.greatest("total_buildings", F.lit(1)))
    return stats.withColumns({"severity": name, "tier": index})


def dominant_class(stats: DataFrame) -> Column:
    """The class with most buildings; of equal ones the first."""
    counts = [("No Damage", "no_damage"), ("Minor", "minor_damage"), ("Major", "major_damage"), ("Destroyed", "destroyed")]
    best = F.greatest(*(F.col(c) for _, c in counts))
    out = None
    for label, c in counts:
        out = F.when(F.col(c) == best, label) if out is None else out.when(F.col(c) == best, label)
    return out


def damage_skew(stats: DataFrame) -> tuple[Column, Column]:
    """Share of the destroyed among the damaged, and its band."""
    pct = F.round(100.0 * F.col("destroyed") / F.greatest("damaged", F.lit(1)), 4)
    band = F.when(F.col("damaged") == 0, "none").when(pct > 60, "total loss").when(pct > 30, "rebuild").otherwise("repair")
    return pct, band


def confidence_note(mean: Column) -> Column:
    return F.when(mean > 0.75, "high").when(mean > 0.5, "moderate").otherwise("low")


def stage_profile(events: DataFrame) -> DataFrame:
    """Of each stage: count, total, mean, the two order statistics without interpolation, extremes and share."""
    # Positions n div 2 and min(floor(0.95 n), n - 1) of the sorted durations. A stage's durations are never gathered and not
    # even put in one order: ranges of a 64th of an octave are counted, and only durations in the ranges that hold a position
    # are sorted, each range on its own.
    from pyspark.sql import Window

    log = lambda c: F.floor(F.log2(c) * 64)
    d = F.col("duration")
    part = F.when(d > 0, log(d)).when(d < 0, F.lit(-(1 << 20)) - log(-d)).otherwise(-(1 << 19))
    each = events.withColumn("part", part).groupBy("stage", "part", "duration").agg(F.count("*").alias("n"))
    sizes = each.groupBy("stage", "part").agg(F.sum("n").alias("in_part"))
    before = F.sum("in_part").over(Window.partitionBy("stage").orderBy("part")) - F.col("in_part")
    whole = events.groupBy("stage").agg(F.count("*").alias("count"), F.sum("duration").alias("total"), F.max("duration").alias("top"), F.min("duration").alias("low"))
    half, most = F.expr("`count` div 2"), F.least(F.floor(F.col("count") * 0.95), F.col("count") - 1)
    wanted = sizes.withColumn("before", before).join(whole.select("stage", half.alias("half"), most.alias("most")), "stage")
    holds = lambda p: (F.col("before") <= F.col(p)) & (F.col(p) < F.col("before") + F.col("in_part"))
    placed = each.join(wanted.where(holds("half") | holds("most")), ["stage", "part"])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("stage", "part").orderBy("duration"))
    at = lambda p: F.min(F.when(holds(p) & (F.col("upto") > F.col(p)), F.col("duration")))
    points = placed.withColumn("upto", upto).groupBy("stage").agg(at("half").alias("p50"), at("most").alias("p95"))
    all_time = whole.agg(F.sum("total").alias("wall"))
    return whole.join(points, "stage").crossJoin(F.broadcast(all_time)).select(
        "stage",
        "count",
        F.round("total", 4).alias("total_s"),
        F.round(1000.0 * F.col("total") / F.col("count"), 4).alias("mean_ms"),
        F.round(1000.0 * F.col("p50"), 4).alias("p50_ms"),
        F.round(1000.0 * F.col("p95"), 4).alias("p95_ms"),
        F.round(1000.0 * F.col("top"), 4).alias("max_ms"),
        F.round(1000.0 * F.col("low"), 4).alias("min_ms"),
        F.round(100.0 * F.col("total") / F.greatest("wall", F.lit(1e-9)), 4).alias("pct_total"),
    )


def rate(amount: Column, seconds: Column) -> Column:
    return F.round(amount / F.greatest(seconds, F.lit(1e-9)), 2)


def response(stats: DataFrame, plan: tuple[tuple[str, ...], ...] = ACTIONS) -> DataFrame:
    """Tier, timeline and actions of each record with a severity."""
    by_tier = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("tier") + 1)
    actions = F.element_at(F.array(*(F.array(*(F.lit(a) for a in row)) for row in plan)), F.col("tier") + 1)
    return stats.withColumns({"timeline": by_tier(TIMELINES), "actions": actions, "tier_name": by_tier([t[0] for t in TIERS])})
