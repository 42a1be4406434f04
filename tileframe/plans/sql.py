"""Names for SQL: views of the derived relations and table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..model import class_dimension, style_dimension, tier_dimension
from ..sources import fixtures as fx


@udtf(returnType="y0: int, x0: int")
class TileOrigins:
    """tile_origins(h, w, tile, overlap): origins of the tiles that cover a scene, row by row."""

    def eval(self, h: int, w: int, tile: int, overlap: int) -> Iterator[tuple[int, int]]:
        axis = lambda n: sorted({*range(0, max(n - tile, 0) + 1, tile - overlap), max(n - tile, 0)})
        for y in axis(h):
            for x in axis(w):
                yield y, x


def register(spark: SparkSession, sf_dir: str) -> None:
    """Makes scene, scene_pair, logits, buildings, scenes, aoi_rects, tile_requests and the dimensions known to SQL."""
    for name in ("scene", "scene_pair", "logits", "buildings", "stage_events", "scenes", "aoi_rects", "tile_requests"):
        getattr(fx, name)(spark, sf_dir).createOrReplaceTempView(name)
    for name, make in (("damage_classes", class_dimension), ("damage_styles", style_dimension), ("severity_tiers", tier_dimension)):
        make(spark).createOrReplaceTempView(name)
    spark.udtf.register("tile_origins", TileOrigins)


def algorithms() -> dict[str, Callable[[SparkSession, dict[str, object]], DataFrame]]:
    """Algorithms by id, each a function of the session and parameters by name; tables are parameters by their names in the
    catalog, so that one algorithm's output can be another's input."""
    from ..model import Options
    from ..operators import graph, stats
    from .detect import detect

    def run_detect(spark: SparkSession, given: dict[str, object]) -> DataFrame:
        rest = {k: v for k, v in given.items() if k not in ("pixels", "scenes", "aoi")}
        return detect(spark.table(str(given["pixels"])), spark.table(str(given["scenes"])), Options.of(rest), aoi=spark.table(str(given["aoi"])) if given.get("aoi") else None)

    return {
        "tileframe:detect": run_detect,
        "tileframe:label": lambda spark, given: graph.label(spark.table(str(given["mask"]))),
        "tileframe:assess": lambda spark, given: stats.with_severity(stats.assess(spark.table(str(given["buildings"])), *given.get("by", ()))),
        "tileframe:profile": lambda spark, given: stats.stage_profile(spark.table(str(given["events"]))),
    }


def run_algorithm(spark: SparkSession, name: str, given: dict[str, object], output: str | None = None) -> DataFrame:
    """Runs an algorithm by its id; output: a view that later ones can name."""
    known = algorithms()
    if name not in known:
        raise ValueError(f"there is no algorithm {name}; there are {', '.join(sorted(known))}")
    out = known[name](spark, given)
    if output:
        out.createOrReplaceTempView(output)
    return out
