"""SpotSigs: chains of content words behind common-word anchors, compared by pruned Jaccard.

An anchor is a common word of one of four languages; of anchors in a row the last counts. With the next two
words that are not anchors it forms a signature; a text's fingerprint is its set of signatures, ascending,
each as 31 bits of XXH64. Two sets can only be alike to a degree of `floor` if the smaller has at least
that share of the larger one's size: sets are put in partitions by the logarithm of their size to that base,
and only those of equal or neighbouring partitions that pass the test are compared; others count as 0. Here each text is
compared with two given ones, so the partitions prune comparisons and no search.

A text without signatures has one for each word, a text without words one for the whole text. Null texts are
empty texts. The next document follows in the order of ids, nulls first, equal ids by the hash of their texts;
repeated rows follow each other. An empty table gives an empty result. Column expressions only. Neither many rows of one id,
or without one, nor many repeated ones meet in a task: order is by ranges of id and hash, and repeated rows are counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Anchors.
ANCHORS = (
    "the of and to in a is that for it as was with be by on not this are or from at which but have an they you were all we can has there been if when who so no "
    "le la les de des du un une et est pour qui que dans par plus pas au aux sur ne se ce il sont avec son "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es werden aus er hat sie nach wird bei "
    "el los las y en por con del su al lo como más pero sus"
).split()
FLOOR = 0.05


def signatures(text: Column) -> Column:
    """The ascending set of signatures of a text that isn't null; never empty."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    words = "|".join(sorted(dict.fromkeys(ANCHORS), key=lambda w: (-len(w), w)))
    marked = F.regexp_replace(plain, f" ({words})(?= )", r"|$1")
    # Possessive, or a long row of anchors takes a stack as deep.
    chains = F.regexp_extract_all(marked, F.lit(r"\|(?=([^| ]+ [^| ]+(?:\|[^| ]+)*+ [^| ]+))"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(chains, lambda c: number(F.regexp_replace(c, r"\|[^| ]+", "")))))


def number(x: Column) -> Column:
    return F.xxhash64(x).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def all_signatures(text: Column) -> Column:
    """The signatures, or if there are none, those of single words or of the whole text. The one-element array lets
    the signatures be made once and named."""
    return F.element_at(F.transform(F.array(signatures(text)), lambda signs: filled(text, signs)), 1)


def filled(text: Column, signs: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    single = F.array_sort(F.array_distinct(F.transform(words, number)))
    return F.when(F.size(signs) > 0, signs).when(F.size(words) > 0, single).otherwise(F.array(number(text)))


def shown(signs: Column) -> Column:
    return F.array_join(F.transform(signs, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def size_partition(signs: Column, floor: float) -> Column:
    return F.floor(F.log(F.size(signs).cast("double")) / F.lit(math.log(1 / floor)))


def likeness(a: Column, b: Column, floor: float = FLOOR) -> Column:
    """Jaccard similarity of two sets; 0 where their sizes alone show that it is below floor."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    near = (F.abs(size_partition(a, floor) - size_partition(b, floor)) <= 1) & (small >= F.lit(floor) * large)
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(near, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


#: What orders documents: whether there is an id, the id, the hash of the text.
ORDER = ["known", "id", "tie"]


def followers(light: DataFrame, folder: str) -> DataFrame:
    """For each of the distinct texts (ORDER, half) the one that it follows, first_<c> for c in ORDER, and how many
    characters that one's last half has; the first text follows the last.

    Only ids, hashes and lengths are dealt out, to ranges; each range is put in order on its own, and its last text is
    followed by the first of the next range. What comes to the driver is a row for each range."""
    dealt = stored(light.repartitionByRange(*ORDER).withColumn("bucket", F.spark_partition_id()), f"{folder}/order")
    lasts = sorted(tuple(r) for r in dealt.groupBy("bucket").agg(F.max(F.struct(*ORDER, "half")).alias("m")).select("bucket", "m.*").collect())
    ring = [(b, *lasts[i - 1][1:]) for i, (b, *_) in enumerate(lasts)]
    before = F.lag(F.struct(*ORDER, "half")).over(Window.partitionBy("bucket").orderBy(*ORDER))
    ends = light.sparkSession.createDataFrame(ring, "bucket int, known int, id long, tie long, half int").select("bucket", F.struct(*ORDER, "half").alias("end"))
    joined = dealt.withColumn("before", before).join(ends, "bucket").withColumn("m", F.coalesce("before", "end"))
    return joined.select(*ORDER, *(F.col(f"m.{c}").alias(f"first_{c}") for c in ORDER), F.col("m.half").alias("first_half"))


def edited_likeness(docs: DataFrame, text: str = "text", key: str = "doc_id", floor: float = FLOOR) -> DataFrame:
    """For each row: its fingerprint, the fingerprint of its edited text (the last half replaced by the beginning of
    the next document), and how like its own the latter and the next document's are."""
    folder = shared_dir(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    rows = rows.select(F.col("id").isNotNull().cast("int").alias("known"), F.coalesce("id", F.lit(0)).alias("id"), F.xxhash64("body").alias("tie"), "body")
    made = rows.withColumn("signs", all_signatures(F.col("body")))
    texts = made.groupBy(*ORDER).agg(F.first("body").alias("body"), F.first("signs").alias("signs"), F.count("*").alias("times"))
    light = rows.groupBy(*ORDER).agg(F.first(F.floor(F.length("body") / 2).cast("int")).alias("half"))
    # Each text lends its beginning and its signatures to the one before it. Its times come along, so that both sides of the
    # join below read the same exchange of texts.
    lent = texts.join(followers(light, folder).hint("merge"), ORDER)
    lent = lent.select(*(F.col(f"first_{c}").alias(c) for c in ORDER), F.col("times").alias("next_times"), F.expr("substring(body, 1, first_half)").alias("next_part"), F.col("signs").alias("next_signs"))
    pairs = texts.join(lent.hint("merge"), ORDER).withColumn("n", F.length("body"))
    pairs = pairs.withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    # Of repeated rows all but the last are followed by themselves.
    own = F.struct(F.expr("substring(body, 1, half)").alias("part"), F.col("signs").alias("signs"), (F.col("times") - 1).alias("times"))
    last = F.struct(F.col("next_part").alias("part"), F.col("next_signs").alias("signs"), F.least(F.col("next_times"), F.lit(1)).cast("long").alias("times"))
    pairs = pairs.withColumn("then", F.explode(F.when(F.col("times") > 1, F.array(own, last)).otherwise(F.array(last))))
    pairs = pairs.select(
        F.when(F.col("known") == 1, F.col("id")).alias(key),
        F.col("n").cast("long").alias("n_chars"),
        F.concat(F.expr("substring(body, 1, n - half)"), F.col("then.part")).alias("edited"),
        "signs",
        F.col("then.signs").alias("next_signs"),
        F.col("then.times").alias("times"),
    )
    pairs = pairs.withColumn("edited_signs", all_signatures(F.col("edited")))
    done = pairs.select(
        key,
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("signs")).alias("fingerprint"),
        shown(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs"), floor).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs"), floor).alias("near_next"),
        "times",
    )
    return done.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("again", "times")
