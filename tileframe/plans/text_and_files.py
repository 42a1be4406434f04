"""Queries on names, files, reports and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import stats
from ..sources import files, imagery, sinks
from ..sources import fixtures as fx
from .assessments import BUILDINGS, STAGE_PROFILE, record
from .pixels import SCENE
from .registry import query

PATHS = """p AS (SELECT 'images/n' || n_nationkey || '_pre_disaster.png' AS path FROM nation UNION ALL SELECT 'images/n' || n_nationkey || '_post_disaster.png' FROM nation WHERE n_nationkey % 5 <> 4
 UNION ALL SELECT 'targets/n' || n_nationkey || '_post_disaster_target.png' FROM nation WHERE n_nationkey % 3 <> 2)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    name = lambda folder, tail: F.concat(F.lit(f"{folder}/n"), F.col("k").cast("string"), F.lit(tail)).alias("path")
    return n.select(name("images", files.PRE)).union(n.where("k % 5 <> 4").select(name("images", files.POST))).union(n.where("k % 3 <> 2").select(name("targets", files.TARGET)))


@query("SELECT 'n' || n_nationkey AS stem, 'images/n' || n_nationkey || '_pre_disaster.png' AS pre, 'images/n' || n_nationkey || '_post_disaster.png' AS post, 'targets/n' || n_nationkey || '_post_disaster_target.png' AS target FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 3 <> 2 ORDER BY 1")
def stem_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.find_pairs(paths(spark, sf_dir))


@query(f"WITH {PATHS} SELECT 'images/n' || n_nationkey || '_post_disaster.png' AS name FROM nation WHERE 'images/n' || n_nationkey || '_post_disaster.png' NOT IN (SELECT path FROM p)")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = fx.table(spark, sf_dir, "nation").select(F.concat(F.lit("images/n"), F.col("n_nationkey").cast("string"), F.lit(files.POST)).alias("name"))
    return files.missing(need, paths(spark, sf_dir).select(F.col("path").alias("name")))


@query("""WITH c AS (SELECT 'm' || (n_nationkey // 2) AS stem, 'm' || (n_nationkey // 2) || CASE WHEN n_nationkey % 2 = 0 THEN '_fp16' ELSE '' END || '.onnx' AS name, n_nationkey AS rank FROM nation WHERE n_nationkey % 4 <> 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY rank, name) AS o FROM c) SELECT stem, name, rank FROM r WHERE o = 1""")
def model_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    c = fx.table(spark, sf_dir, "nation").select(F.concat(F.lit("m"), F.expr("n_nationkey div 2").cast("string"), F.when(k % 2 == 0, "_fp16").otherwise(""), F.lit(".onnx")).alias("name"), k.alias("rank"), (k % 4 != 0).alias("present"))
    return files.members(c)


@query("""WITH a AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN ['cpu', 'directml'] WHEN 1 THEN ['cpu'] ELSE ['coreml', 'cpu', 'cuda'] END AS available FROM nation)
SELECT n_nationkey, array_to_string(list_filter(['cuda', 'directml', 'coreml', 'cpu'], lambda v: list_contains(available, v)), ',') AS providers, list_filter(['cuda', 'directml', 'coreml', 'cpu'], lambda v: list_contains(available, v))[1] AS chosen FROM a""")
def provider_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available providers in the order of preference, and the first of them."""
    k = F.col("n_nationkey")
    lists = lambda *names: F.array(*(F.lit(n) for n in names))
    a = fx.table(spark, sf_dir, "nation").select(k, F.when(k % 3 == 0, lists("cpu", "directml")).when(k % 3 == 1, lists("cpu")).otherwise(lists("coreml", "cpu", "cuda")).alias("available"))
    both = F.array_intersect(lists("cuda", "directml", "coreml", "cpu"), F.col("available"))
    return a.select(k, F.array_join(both, ",").alias("providers"), F.get(both, F.lit(0)).alias("chosen"))


STEM = "regexp_replace(regexp_replace(split_part(src, '|', 1), '^.*[/\\\\]', ''), '(.)\\.[^.]*$', '\\1')"


@query(f"""WITH u AS (SELECT page_id, replace(url, '#', '|') || CASE page_id % 4 WHEN 0 THEN '_post_disaster.tif' WHEN 1 THEN '-post.png' WHEN 2 THEN '_post' ELSE '' END AS src FROM pages), s AS (SELECT page_id, src, {STEM} AS b FROM u),
 t AS (SELECT page_id, src, CASE WHEN ends_with(b, '_post_disaster') THEN left(b, length(b) - 14) WHEN ends_with(b, '_post') THEN left(b, length(b) - 5) WHEN ends_with(b, '-post') THEN left(b, length(b) - 5) ELSE b END AS stem FROM s)
SELECT page_id, stem, coalesce(nullif(trim(translate(stem, '<>:"/\\|?*', '_________')), ''), 'damage_assessment') AS safe, split_part(src, '|', 1) AS source, regexp_replace(split_part(src, '|', 1), '[/\\\\][^/\\\\]*$', '') AS folder FROM t""")
def sanitize_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id") % 4
    tail = F.when(p == 0, "_post_disaster.tif").when(p == 1, "-post.png").when(p == 2, "_post").otherwise("")
    u = fx.table(spark, sf_dir, "pages").select("page_id", F.concat(F.replace("url", F.lit("#"), F.lit("|")), tail).alias("src"))
    s = u.select("page_id", "src", text.stem(F.col("src")).alias("stem"))
    return s.select("page_id", "stem", text.sanitize(F.col("stem")).alias("safe"), text.without_options(F.col("src")).alias("source"), text.folder(F.col("src")).alias("folder"))


ITEM = "starts_with({0}, '- ')"


@query(rf"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: trim(s)) AS ls FROM documents),
 t AS (SELECT doc_id, ls, list_transform(ls, lambda s, i: CASE WHEN {ITEM.format("s")} AND NOT {ITEM.format("coalesce(ls[i - 1], '')")} THEN '<ul>' || chr(10) WHEN NOT {ITEM.format("s")} AND {ITEM.format("coalesce(ls[i - 1], '')")} THEN '</ul>' || chr(10) ELSE '' END
   || CASE WHEN starts_with(s, '### ') THEN '<h4>' || substr(s, 5) || '</h4>' WHEN starts_with(s, '## ') THEN '<h3>' || substr(s, 4) || '</h3>' WHEN starts_with(s, '# ') THEN '<h2>' || substr(s, 3) || '</h2>'
     WHEN {ITEM.format("s")} THEN '<li>' || substr(s, 3) || '</li>' WHEN s = '' THEN '<br>' ELSE '<p>' || s || '</p>' END) AS ts FROM l),
 b AS (SELECT doc_id, regexp_replace(array_to_string(ts, chr(10)) || CASE WHEN {ITEM.format("ls[-1]")} THEN chr(10) || '</ul>' ELSE '' END, '\*\*([^\n]+?)\*\*', '<b>\1</b>', 'g') AS h FROM t),
 m AS (SELECT doc_id, regexp_replace(regexp_replace(h, '(^|[^*])\*([^*]|$)', '\1' || chr(2) || '\2', 'g'), '(^|[^*])\*([^*]|$)', '\1' || chr(2) || '\2', 'g') AS h FROM b)
SELECT doc_id, replace(regexp_replace(h, chr(2) || '([^*' || chr(2) || ']+)' || chr(2), '<i>\1</i>', 'g'), chr(2), '*') AS html FROM m""")
def markdown_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as Markdown. The SQL engine's patterns know no look-around, so it marks the asterisks that stand alone first."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.markdown_html(F.col("text")).alias("html"))


@query("SELECT page_id, url LIKE 'http://%' OR url LIKE 'https://%' AS allowed, contains(html, 'image') OR length(html) > 1000 AS usable FROM pages")
def response_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.table(spark, sf_dir, "pages")
    return p.select("page_id", imagery.allowed_scheme(F.col("url")).alias("allowed"), imagery.usable(F.col("html"), F.col("html")).alias("usable"))


@query("SELECT conv_id, turn, contains(lower(text), 'memory') OR contains(lower(text), 'alloc') OR contains(lower(text), 'oom') AS memory_error, left(text, 120) AS short, sha256(text) AS digest FROM conversations")
def error_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages classed by their words and cut as a log shows them."""
    c = fx.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.is_memory_error(F.col("text")).alias("memory_error"), F.left("text", F.lit(120)).alias("short"), F.sha2("text", 256).alias("digest"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(CAST(json_extract_string(props, '$.absent') AS BIGINT), -1) AS absent, 'Damage ' || strftime(ts, '%Y-%m-%d %H:%M') AS layer, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc, replace(strftime(ts, '%H:%M'), ':', '-') AS safe_time FROM events")
def json_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of JSON with defaults, and the names made from times."""
    e = fx.table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,bigint>"))
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(-1).cast("long"))
    return e.select(
        "event_id", get("k").alias("k"), get("absent").alias("absent"),
        F.concat(F.lit("Damage "), F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("layer"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"),
        F.replace(F.date_format("ts", "HH:mm"), F.lit(":"), F.lit("-")).alias("safe_time"),
    )


@query("SELECT n_nationkey, printf('tile_%.4f_%.4f', n_nationkey * 6 - 72.5, n_nationkey * 14 - 170.25) AS name, printf('%.2f', n_nationkey * 0.37 + 0.001) AS two, format('{:,}', n_nationkey * 98765) AS grouped FROM nation")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return fx.table(spark, sf_dir, "nation").select(k, F.format_string("tile_%.4f_%.4f", (k * 6 - 72.5).cast("double"), (k * 14 - 170.25).cast("double")).alias("name"), F.format_string("%.2f", (k * 0.37 + 0.001).cast("double")).alias("two"), F.format_number(k * 98765, 0).alias("grouped"))


@query(f"WITH {BUILDINGS} SELECT 'damage' AS layer, '512' AS tile, 'Destroyed' AS class4, {record()} FROM buildings")
def provenance_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's document, read back; only its time of making is left out, as it is another each time."""
    b = fx.buildings(spark, sf_dir)
    assessed = stats.assess(b)
    doc = sinks.provenance(assessed, {"layer": "damage", "tile": "512", "overlap": "64"})
    kind = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in assessed.schema.fields)
    back = doc.select(F.from_json("document", f"run struct<created_utc: string, layer: string, tile: string>, classes map<string, string>, result struct<{kind}>").alias("d"))
    return back.where(F.col("d.run.created_utc").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).select("d.run.layer", "d.run.tile", F.element_at("d.classes", "4").alias("class4"), "d.result.*")


@query(STAGE_PROFILE)
def performance_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage profile as one document, read back; its stages are few."""
    p = stats.stage_profile(fx.stage_events(spark, sf_dir))
    doc = sinks.performance(p)
    kind = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in p.schema.fields if f.name != "stage")
    back = doc.select(F.explode(F.from_json("document", f"stages map<string, struct<{kind}>>")["stages"]).alias("stage", "s"))
    return back.select("stage", "s.*")


@query(f"WITH {SCENE} SELECT y // 256 AS block_y, x // 256 AS block_x, 65536 AS cells, count(*) AS set, sum(CASE WHEN v > 0.2 THEN 4 ELSE 2 END)::BIGINT AS total, sum(CASE WHEN v > 0.2 THEN 4 ELSE 2 END * ((y % 256) * 256 + x % 256))::BIGINT AS mark FROM scene WHERE v > 0.15 GROUP BY 1, 2")
def mask_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.scene(spark, sf_dir).select("y", "x", F.when(F.col("v") > 0.2, 4).when(F.col("v") > 0.15, 2).otherwise(0).alias("damage_class"))
    b = sinks.mask_blocks(s)
    place = F.sequence(F.lit(0), F.lit(sinks.BLOCK * sinks.BLOCK - 1))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, v: a + v)
    return b.select(
        "block_y", "block_x", F.size("classes").alias("cells"), F.size(F.filter("classes", lambda c: c > 0)).cast("long").alias("set"), add("classes").alias("total"),
        add(F.zip_with("classes", place, lambda c, k: c.cast("long") * k)).alias("mark"),
    )


@query(f"""WITH {BUILDINGS} SELECT (row_number() OVER (ORDER BY damage_class, customer_key, area, confidence))::INT AS place, damage_class, customer_key, round(area, 2) AS area FROM buildings WHERE customer_key <= 100 AND damage_class > 1""")
def class_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the damaged classes of some customers, put together class by class; a feature's place is its own within its
    class and the sizes of the classes before."""
    from pyspark.sql import Window

    b = fx.buildings(spark, sf_dir).where("customer_key <= 100")
    parts = [b.where(F.col("damage_class") == k) for k in range(2, 5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    before = out.groupBy("damage_class").agg(F.count("*").alias("n")).select("damage_class", (F.sum("n").over(Window.orderBy("damage_class")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("damage_class").orderBy("customer_key", "area", "confidence"))
    return out.withColumn("own", own).join(F.broadcast(before), "damage_class").select((F.col("own") + F.col("before")).cast("int").alias("place"), "damage_class", "customer_key", F.round("area", 2).alias("area"))
