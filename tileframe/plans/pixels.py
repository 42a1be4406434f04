"""Queries on pixels, tiles and tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators import grid, masks, registration
from ..operators.scorer import linear_scorer, predict_tiles
from ..sources import fixtures as fx
from .registry import query

SCENE = """scene AS (SELECT ((vec_id // 20) * 8 + i // 8)::INT AS y, ((vec_id % 20) * 8 + i % 8)::INT AS x, v::DOUBLE AS v
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
 size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM scene)"""
PAIR = """pair AS (SELECT chip, (i // 8)::INT AS y, (i % 8)::INT AS x, pre::DOUBLE AS pre, post::DOUBLE AS post FROM (
  SELECT a.vec_id AS chip, unnest(a.embedding) AS pre, unnest(b.embedding) AS post, generate_subscripts(a.embedding, 1) - 1 AS i
  FROM embeddings a, (SELECT count(*) AS n FROM embeddings) c JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % c.n))"""
LOGITS = """logits AS (SELECT vec_id, label % 4 AS y_true, embedding[9]::DOUBLE * 20 AS loc,
  [list_transform(embedding[1:4], lambda v: v::DOUBLE * 20), list_transform(embedding[5:8], lambda v: v::DOUBLE * 20)] AS z FROM embeddings)"""
SOFT = "list_transform(z, lambda m: list_transform(m, lambda v: exp((v - list_max(m)) / {t}) / list_sum(list_transform(m, lambda u: exp((u - list_max(m)) / {t})))))"
MEAN = "[(s[1][k] + s[2][k]) / 2 FOR k IN range(1, 5)]"
SIGMOID = "CASE WHEN loc >= 0 THEN 1 / (1 + exp(-loc)) ELSE exp(loc) / (1 + exp(loc)) END"


def scene_size(scene: DataFrame) -> tuple[int, int]:
    r = scene.agg(F.max("y") + 1, F.max("x") + 1).first()
    return (r[0] or 0), (r[1] or 0)


@query(f"""WITH {SCENE}, b AS (SELECT y, x, floor((v + 1) * 1000)::INT AS band FROM scene), q AS (SELECT quantile_cont(band, 0.02) AS lo, quantile_cont(band, 0.98) AS hi FROM b)
SELECT y, x, trunc(least(greatest((band - lo) / (hi - lo + 1e-6) * 255.0, 0.0), 255.0))::INT AS stretched FROM b, q""")
def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 2nd and 98th percentile of an integer band: its few distinct values are counted, then placed by a running sum."""
    b = fx.scene(spark, sf_dir).select("y", "x", F.floor((F.col("v") + 1) * 1000).cast("int").alias("band"))
    c = b.groupBy("band").agg(F.count("*").alias("n"))
    upto = c.select("band", F.sum("n").over(Window.orderBy("band")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("n"))

    def at(q: float):
        place = F.lit(q) * (F.col("n") - 1)
        low = F.min(F.when(F.col("upto") > F.floor(place), F.col("band")))
        high = F.min(F.when(F.col("upto") > F.ceil(place), F.col("band")))
        return low + (high - low) * F.max(place - F.floor(place))

    q = upto.agg(at(0.02).alias("lo"), at(0.98).alias("hi"))
    return b.crossJoin(F.broadcast(q)).select("y", "x", sc.stretch(F.col("band"), F.col("lo"), F.col("hi")).alias("stretched"))


ORIGINS = "list_distinct(list_append(range(0, greatest({n} - {t}, 0) + 1, {t} - {o}), greatest({n} - {t}, 0)))"


@query(f"WITH {SCENE} SELECT h::INT AS h, w::INT AS w, y0::INT AS y0, unnest({ORIGINS.format(n='w', t=64, o=8)})::INT AS x0 FROM (SELECT h, w, unnest({ORIGINS.format(n='h', t=64, o=8)}) AS y0 FROM size)")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = fx.scene(spark, sf_dir).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return grid.tile_grid(size, 64, 8)


@query("SELECT y::INT AS y, x::INT AS x, round((0.5 - 0.5 * cos(2 * pi() * (y + 1) / 17)) * (0.5 - 0.5 * cos(2 * pi() * (x + 1) / 17)), 9) AS weight FROM range(16) a(y), range(16) b(x)")
def hann_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.range(256).select(F.expr("cast(id div 16 as int)").alias("y"), F.expr("cast(id % 16 as int)").alias("x"))
    return g.select("y", "x", F.round(grid.hann(F.col("y"), 16) * grid.hann(F.col("x"), 16), 9).alias("weight"))


TILES = f"ty AS (SELECT unnest({ORIGINS.format(n='h', t=64, o=8)}) AS y0 FROM size), tx AS (SELECT unnest({ORIGINS.format(n='w', t=64, o=8)}) AS x0 FROM size)"
COVER = f"{SCENE}, {TILES}, cover AS (SELECT * FROM scene, ty, tx WHERE y >= y0 AND y < y0 + 64 AND x >= x0 AND x < x0 + 64)"


@query(f"WITH {COVER}, n AS (SELECT y, x, count(*) AS tiles FROM cover GROUP BY y, x) SELECT tiles, count(*) AS pixels FROM n GROUP BY tiles")
def tile_cover_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.scene(spark, sf_dir)
    c = grid.cover(s, *scene_size(s), 64, 8)
    return c.groupBy("y", "x").agg(F.count("*").alias("tiles")).groupBy("tiles").agg(F.count("*").alias("pixels"))


WEIGHT = "(0.5 - 0.5 * cos(2 * pi() * (y - y0 + 1) / 65)) * (0.5 - 0.5 * cos(2 * pi() * (x - x0 + 1) / 65))"


@query(f"WITH {COVER} SELECT y, x, round(sum((v + 0.001 * y0 + 0.002 * x0) * {WEIGHT}) / greatest(sum({WEIGHT}), 1e-6), 6) AS p FROM cover GROUP BY y, x")
def blend_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.scene(spark, sf_dir)
    c = grid.cover(s, *scene_size(s), 64, 8)
    return grid.blend(c, F.col("v") + 0.001 * F.col("y0") + 0.002 * F.col("x0"), 64).select("y", "x", F.round("p", 6).alias("p"))


@query(f"WITH {LOGITS} SELECT vec_id, round({SIGMOID}, 9) AS p, {SIGMOID} > 0.4 AS building FROM logits")
def sigmoid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sc.sigmoid(F.col("loc"))
    return fx.logits(spark, sf_dir).select("vec_id", F.round(p, 9).alias("p"), (p > 0.4).alias("building"))


@query(f"WITH {LOGITS}, m AS (SELECT vec_id, {SOFT.format(t='1.5')} AS s FROM logits) SELECT vec_id, round((s[1][1] + s[2][1]) / 2, 9) AS p1, round((s[1][2] + s[2][2]) / 2, 9) AS p2, round((s[1][3] + s[2][3]) / 2, 9) AS p3, round((s[1][4] + s[2][4]) / 2, 9) AS p4 FROM m")
def softmax_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.logits(spark, sf_dir).select("vec_id", sc.ensemble(F.col("z"), 1.5).alias("p"))
    return p.select("vec_id", *(F.round(F.element_at("p", k), 9).alias(f"p{k}") for k in range(1, 5)))


PROBS5 = f"{LOGITS}, m AS (SELECT vec_id, {SIGMOID} AS l, {SOFT.format(t='1.0')} AS s FROM logits), c AS (SELECT vec_id, l, {MEAN} AS q FROM m)"


@query(f"WITH {PROBS5} SELECT vec_id, round(1 - l, 9) AS p0, round(l * q[1], 9) AS p1, round(l * q[2], 9) AS p2, round(l * q[3], 9) AS p3, round(l * q[4], 9) AS p4 FROM c")
def compose_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.logits(spark, sf_dir).select("vec_id", sc.sigmoid(F.col("loc")).alias("l"), sc.ensemble(F.col("z")).alias("q"))
    p = p.select("vec_id", sc.compose(F.col("l"), F.col("q")).alias("p"))
    return p.select("vec_id", *(F.round(F.element_at("p", k + 1), 9).alias(f"p{k}") for k in range(5)))


def five(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.logits(spark, sf_dir).select("vec_id", sc.sigmoid(F.col("loc")).alias("l"), sc.ensemble(F.col("z")).alias("q"))
    return p.select("vec_id", sc.compose(F.col("l"), F.col("q")).alias("p"))


MODE = f"{PROBS5}, d AS (SELECT vec_id, l, [l * k FOR k IN q] AS p FROM c), o AS (SELECT vec_id, CASE WHEN l > 0.4 THEN list_position(p, list_max(p)) ELSE 0 END AS damage_class, l, p FROM d)"


@query(f"WITH {MODE} SELECT vec_id, damage_class::INT AS damage_class, round(CASE WHEN damage_class > 0 THEN p[damage_class] ELSE 1 - l END, 9) AS confidence FROM o")
def pixel_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = five(spark, sf_dir)
    cls, conf = sc.pixel_mode(F.col("p"), 1 - F.element_at("p", 1) > 0.4)
    return p.select("vec_id", cls.alias("damage_class"), F.round(conf, 9).alias("confidence"))


@query(f"WITH {MODE} SELECT damage_class::INT AS damage_class, count(*) AS pixels FROM o GROUP BY damage_class")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_mode(spark, sf_dir).groupBy("damage_class").agg(F.count("*").alias("pixels"))


@query(f"WITH {MODE} SELECT {', '.join(f'round(100.0::DOUBLE * count(*) FILTER (damage_class = {k}) / greatest(count(*) FILTER (damage_class > 0), 1), 6) AS pct{k}' for k in range(1, 5))}, round(avg(p[damage_class]) FILTER (damage_class > 0), 6) AS mean_conf, round(avg(CASE WHEN damage_class > 0 THEN 1.0 ELSE 0.0 END), 6) AS built FROM o")
def class_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = five(spark, sf_dir)
    cls, conf = sc.pixel_mode(F.col("p"), 1 - F.element_at("p", 1) > 0.4)
    m = p.select(cls.alias("c"), conf.alias("conf"))
    built = F.greatest(F.count_if(F.col("c") > 0), F.lit(1))
    pcts = [F.round(100.0 * F.count_if(F.col("c") == k) / built, 6).alias(f"pct{k}") for k in range(1, 5)]
    return m.agg(*pcts, F.round(F.avg(F.when(F.col("c") > 0, F.col("conf"))), 6).alias("mean_conf"), F.round(F.avg(F.when(F.col("c") > 0, 1.0).otherwise(0.0)), 6).alias("built"))


def tta_sql(n: int) -> str:
    # A score that depends on the place: value times (oriented column + 1) plus twice the oriented row.
    parts = []
    for k in range(n):
        y, x = ("x", "y") if k & 4 else ("y", "x")
        yy, xx = (f"(7 - {y})" if k & 2 else y), (f"(7 - {x})" if k & 1 else x)
        parts.append(f"(pre * ({xx} + 1) + 2 * {yy})")
    return f"WITH {PAIR} SELECT chip, y, x, round(({' + '.join(parts)}) / {n}, 6) AS p FROM pair"


def tta_mean(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Each orientation's view of a chip is scored at its own places, brought back, and averaged with the others."""
    chips = fx.scene_pair(spark, sf_dir).select("chip", "y", "x", "pre")
    there = [sc.orient(k, F.col("y"), F.col("x"), 8) for k in range(n)]
    views = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), yy.alias("y"), xx.alias("x")) for k, (yy, xx) in enumerate(there))))
    seen = chips.select("chip", "pre", views.alias("v")).select("chip", "v.*", (F.col("pre") * (F.col("v.x") + 1) + 2 * F.col("v.y")).alias("p"))
    back = [sc.disorient(k, F.col("y"), F.col("x"), 8) for k in range(n)]
    of = lambda axis: F.element_at(F.array(*(b[axis] for b in back)), F.col("k") + 1)
    return seen.select("chip", of(0).alias("y"), of(1).alias("x"), "p").groupBy("chip", "y", "x").agg(F.round(F.avg("p"), 6).alias("p"))


@query(tta_sql(4))
def tta4_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tta_mean(spark, sf_dir, 4)


@query(tta_sql(8))
def tta8_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tta_mean(spark, sf_dir, 8)


@query(f"WITH {SCENE} SELECT y, x, round(((v + 1) * 100 / 255 - 0.485) / 0.229, 6) AS r, round(((v + 1) * 90 / 255 - 0.456) / 0.224, 6) AS g, round(((v + 1) * 80 / 255 - 0.406) / 0.225, 6) AS b, round(0.299 * (v + 1) * 100 + 0.587 * (v + 1) * 90 + 0.114 * (v + 1) * 80, 6) AS grey FROM scene")
def normalize_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..model import IMAGENET_MEAN, IMAGENET_STD

    bands = [(F.col("v") + 1) * k for k in (100, 90, 80)]
    normal = [F.round(sc.imagenet(b, m, s), 6).alias(n) for b, m, s, n in zip(bands, IMAGENET_MEAN, IMAGENET_STD, "rgb", strict=True)]
    return fx.scene(spark, sf_dir).select("y", "x", *normal, F.round(sc.grey(*bands), 6).alias("grey"))


@query(f"WITH {PAIR}, t AS (SELECT c.chip, ty, tx FROM (SELECT DISTINCT chip FROM pair) c, range(10) a(ty), range(10) b(tx)) SELECT t.chip, ty::INT AS y, tx::INT AS x, round(pre, 6) AS v FROM t JOIN pair p ON p.chip = t.chip AND p.y = CASE WHEN ty > 7 THEN 14 - ty ELSE ty END AND p.x = CASE WHEN tx > 7 THEN 14 - tx ELSE tx END")
def pad_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips padded to a multiple of five by reflection: each pixel goes to all places that mirror it."""
    p = fx.scene_pair(spark, sf_dir).select("chip", "y", "x", "pre")
    images = lambda c: F.filter(F.sequence(F.lit(0), F.lit(9)), lambda t: sc.reflect(t, 8) == c)
    out = p.withColumn("ty", F.explode(images(F.col("y")))).withColumn("tx", F.explode(images(F.col("x"))))
    return out.select("chip", F.col("ty").alias("y"), F.col("tx").alias("x"), F.round("pre", 6).alias("v"))


@query(f"WITH {SCENE}, g AS (SELECT ty::INT AS y, tx::INT AS x FROM size, range(((h + 63) // 64) * 64) a(ty), range(((w + 63) // 64) * 64) b(tx)) SELECT g.y, g.x, round(coalesce(v, 0), 6) AS v FROM g LEFT JOIN scene s ON s.y = g.y AND s.x = g.x")
def zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.scene(spark, sf_dir)
    h, w = (-(-n // 64) * 64 for n in scene_size(s))
    return grid.zero_padded(spark, s, h, w, "v").select("y", "x", F.round("v", 6).alias("v"))


@query(f"WITH {SCENE} SELECT y // 4 AS y, x // 4 AS x, round(avg(v), 6) AS v FROM scene GROUP BY 1, 2")
def resize_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.shrunk(fx.scene(spark, sf_dir), "v", 4).select("y", "x", F.round("v", 6).alias("v"))


def bilinear_sql(sy: str, sx: str) -> str:
    at = lambda c, k, n: f"least(greatest(floor({c}) + {k}, 0), {n} - 1)"
    return f"""WITH {SCENE}, k AS (SELECT j, i FROM range(2) a(j), range(2) b(i)), t AS (SELECT y, x, {at('sy', 'j', 'h')} AS py, {at('sx', 'i', 'w')} AS px,
 (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS s
 FROM (SELECT y, x, {sy} AS sy, {sx} AS sx FROM scene), k, size) SELECT t.y, t.x, round(sum(c.v * s), 6) AS v FROM t JOIN scene c ON c.y = py AND c.x = px GROUP BY t.y, t.x"""


@query(bilinear_sql("y::DOUBLE - 0.5::DOUBLE", "x::DOUBLE + 1.25::DOUBLE"))
def translate_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.scene(spark, sf_dir)
    return grid.translated(s, "v", 0.5, -1.25, *scene_size(s)).select("y", "x", F.round("v", 6).alias("v"))


@query(bilinear_sql("y * 0.9::DOUBLE + 0.3::DOUBLE", "x * 0.8::DOUBLE + 0.7::DOUBLE"))
def warp_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.scene(spark, sf_dir)
    return grid.warped(s, s, "v", F.col("y") * 0.9 + 0.3, F.col("x") * 0.8 + 0.7, *scene_size(s)).select("y", "x", F.round("v", 6).alias("v"))


KERNEL = ", ".join(f"({i - 4}, {w!r}::DOUBLE)" for i, w in enumerate(masks.kernel(1.0)))
MIRROR = lambda c, n: f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} >= {n} THEN 2 * {n} - 1 - ({c}) ELSE {c} END"


@query(f"""WITH {SCENE}, k(i, w8) AS (VALUES {KERNEL}), a AS (SELECT t.y, t.x, sum(s.v * w8) AS v FROM scene t, k, size JOIN scene s ON s.y = t.y AND s.x = {MIRROR('t.x + i', 'w')} GROUP BY t.y, t.x)
SELECT t.y, t.x, round(sum(s.v * w8), 6) AS v FROM a t, k, size JOIN a s ON s.x = t.x AND s.y = {MIRROR('t.y + i', 'h')} GROUP BY t.y, t.x""")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.scene(spark, sf_dir)
    return masks.smoothed(s, "v", *scene_size(s)).select("y", "x", F.round("v", 6).alias("v"))


@query(f"WITH {SCENE}, a AS (SELECT *, max(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM scene), b AS (SELECT *, max(m) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM a) SELECT y, x, round(v, 6) AS v FROM b WHERE v = n AND v > 0.15")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.local_maxima(fx.scene(spark, sf_dir), "v", 3).where("v > 0.15").select("y", "x", F.round("v", 6).alias("v"))


@query(f"WITH {PAIR} SELECT chip, y, x, round(pre, 6) AS pre, round(post, 6) AS post, round(abs(post - pre), 6) AS change FROM pair")
def prepost_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.scene_pair(spark, sf_dir)
    return p.select("chip", "y", "x", F.round("pre", 6).alias("pre"), F.round("post", 6).alias("post"), F.round(F.abs(F.col("post") - F.col("pre")), 6).alias("change"))


@query(f"WITH {PAIR} SELECT chip, round(stddev_pop(pre * 255), 6) AS pre_std, round(stddev_pop(post * 255), 6) AS post_std, stddev_pop(pre * 255) >= 1 AND stddev_pop(post * 255) >= 1 AS usable FROM pair GROUP BY chip")
def grey_std_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = registration.std_gate(fx.scene_pair(spark, sf_dir), ["chip"])
    return g.select("chip", F.round("pre_std", 6).alias("pre_std"), F.round("post_std", 6).alias("post_std"), "usable")


SHIFTS = f"""{PAIR}, k AS (SELECT j - 1 AS dy, i - 1 AS dx FROM range(3) a(j), range(3) b(i)),
 s AS (SELECT a.chip, dy, dx, round(avg(a.pre * b.post), 9) AS score FROM pair a, k JOIN pair b ON b.chip = a.chip AND b.y + dy = a.y AND b.x + dx = a.x GROUP BY a.chip, dy, dx),
 r AS (SELECT *, row_number() OVER (PARTITION BY chip ORDER BY score DESC, sqrt(dy * dy + dx * dx), dy, dx) AS n FROM s)"""


@query(f"WITH {SHIFTS} SELECT chip, dy::INT AS dy, dx::INT AS dx, score FROM r WHERE n = 1")
def shift_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration.best_shift(registration.shift_scores(fx.scene_pair(spark, sf_dir), ["chip"], 1), ["chip"])


@query(f"WITH {SHIFTS}, v AS (SELECT sqrt(dy * dy + dx * dx) AS shift FROM r WHERE n = 1) SELECT count(*) FILTER (shift >= 0.5 AND shift <= 12) AS moved, round(avg(shift) FILTER (shift >= 0.5 AND shift <= 12), 6) AS mean_shift, round(max(shift) FILTER (shift >= 0.5 AND shift <= 12), 6) AS max_shift FROM v")
def shift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shift_search(spark, sf_dir).select(F.hypot("dy", "dx").alias("shift"))
    s = s.where(registration.shift_verdict(F.col("shift")) == "apply")
    return s.agg(F.count("*").alias("moved"), F.round(F.avg("shift"), 6).alias("mean_shift"), F.round(F.max("shift"), 6).alias("max_shift"))


@query()
def phase_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase correlation with refinement; NumPy in a grouped map, so rows only."""
    r = registration.register(fx.scene_pair(spark, sf_dir), ["chip"], 8, 8, refine=True)
    return r.select("chip", F.round("dy", 3).alias("dy"), F.round("dx", 3).alias("dx"), F.round("response", 3).alias("response"))


@query(f"""WITH {PAIR}, z AS (SELECT *, 1 / (1 + exp(-12 * (pre - 0.1))) AS l, [exp(-8 * abs(abs(post - pre) - s)) FOR s IN [0.05, 0.15, 0.3, 0.6]] AS a, [exp(-9 * abs(abs(post - pre) - s)) FOR s IN [0.05, 0.15, 0.3, 0.6]] AS b FROM pair)
SELECT chip, y, x, round(1 - l, 6) AS p0, {', '.join(f'round(l * (a[{k}] / list_sum(a) + b[{k}] / list_sum(b)) / 2, 6) AS p{k}' for k in range(1, 5))} FROM z""")
def scorer_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips through the stand-in scorer in four orientations; it looks at single pixels, so SQL knows what comes out."""
    p = fx.scene_pair(spark, sf_dir).groupBy("chip").agg(F.sort_array(F.collect_list(F.struct("y", "x", "pre", "post"))).alias("px"))
    tiles = p.select("chip", F.transform("px", lambda t: t["pre"]).alias("pre"), F.transform("px", lambda t: t["post"]).alias("post"))
    return predict_tiles(tiles, 8, linear_scorer, tta=4).select("chip", "y", "x", *(F.round(F.element_at("p", k + 1), 6).alias(f"p{k}") for k in range(5)))
