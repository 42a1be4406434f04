"""Connected components of a graph and of a mask."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, shared_dir, stored

#: A pixel's number is y * WIDE + x.
WIDE = 1 << 31


def components(edges: DataFrame, most_rounds: int = 40, folder: str | None = None) -> DataFrame:
    """(node, root) for every node of an edge (a, b); root is the least node of its component.

    Rounds of large star and small star: neighbours above a node are pointed at its least neighbour, then those
    below. A round is a partial aggregation and a join on the node, kept as a table in the shared folder, and the
    rounds end when the edges repeat; their number grows with the logarithm of a component's length. Each round's table takes
    the place of the one before; the last is in `folder` (a new one, if not given) until the caller drops it.
    """
    path = folder or shared_dir(edges.sparkSession)
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}/0")
    before = None
    for k in range(1, most_rounds + 1):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()
        now = stored(small, f"{path}/{k}")
        dropped(edges.sparkSession, f"{path}/{k - 1}")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def runs(mask: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, y, x, run): the number of the first pixel of the horizontal run that each mask pixel is in."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    begins = F.when(F.coalesce(F.lag("x").over(row) + 1, F.lit(-1)) != F.col("x"), F.col("y") * F.lit(WIDE) + F.col("x"))
    return mask.select(*keys, "y", "x").withColumn("b", begins).select(*keys, "y", "x", F.max("b").over(row).alias("run"))


def label(mask: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, y, x, label): 4-connected components of a mask (keys, y, x), named by their least pixel number. The keys, such
    as a scene's, part pixels that don't belong together.

    Rows of pixels become runs first, so the graph has a node for each run, not for each pixel."""
    path = shared_dir(mask.sparkSession)
    r = stored(runs(mask, keys), f"{path}/runs")
    node = lambda c: F.struct(*keys, F.col(c).alias("n")) if keys else F.col(c)
    below = r.select(*keys, (F.col("y") - 1).alias("y"), "x", F.col("run").alias("under"))
    edges = r.join(below, [*keys, "y", "x"]).select(node("run").alias("a"), node("under").alias("b")).distinct()
    roots = components(edges)
    if keys:
        roots = roots.select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.n").alias("run"), F.col("root.n").alias("root"))
    else:
        roots = roots.withColumnRenamed("node", "run")
    return r.join(roots, [*keys, "run"], "left").select(*keys, "y", "x", F.coalesce("root", "run").alias("label"))
