"""URL filters: rules first, then naive Bayes over segmented names.

Hosts and paths are cut at what isn't a letter; each piece is split into words by unigram Viterbi, whose counts
are those of all pieces in the input beside a fixed lexicon. The multinomial naive Bayes model is trained on all
rows: a page counts as blocked if its words hold a strong or two weak ones of the lexicon, and the words that
come with them get their share. Counts of all pieces and words stay tables, which the distinct pieces and the rows'
words are joined to; only totals and the lexicon are sent to tasks.

A null url, or one without ://, has empty host and path, no rule, and the model's verdict of no words. Null ids
and repeated rows stay. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, stored

#: The rules, host and path, and what they say.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Words that make a page count as blocked, alone or two together, and words of ordinary names.
STRONG = "casino pills spam porn xxx viagra poker jackpot gambling malware phishing warez escort".split()
WEAK = "cheap free win bets bet ads ad track farm bonus loan loans lottery prize click sex adult dating replica promo slots betting crypto deals".split()
ORDINARY = "example blog www news home shop book books world wiki open data home school science music film art city sport travel health food house garden photo video game page mail forum web site online the of and to in for on is it".split()
LEXICON = 20
#: Letters of the longest word within a name; a name as a whole may be a word of any length.
LONGEST = 24


def parts(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; nulls if none does."""
    name = said = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        said = F.when(fits, verdict) if said is None else said.when(fits, verdict)
    return name, said


def pieces(host: str, path: str) -> list[str]:
    """Runs of letters of the host without its last label, and of the path."""
    return re.findall(r"[^\W\d_]+", f"{host.rpartition('.')[0]} {path}".lower())


def viterbi(name: str, cost: Callable[[str], float]) -> tuple[str, ...]:
    """The split of a name whose words cost least together."""
    best = [(0.0, 0)]
    for j in range(1, len(name) + 1):
        best.append(min((best[i][0] + cost(name[i:j]), i) for i in range(max(0, j - LONGEST), j)))
    if len(name) > LONGEST:
        best[-1] = min(best[-1], (cost(name), 0))
    out, j = [], len(name)
    while j:
        i = best[j][1]
        out.append(name[i:j])
        j = i
    return tuple(out[::-1])


class Segmenter:
    """Unigram Viterbi: the split of a name whose words are most probable together."""

    def __init__(self, counts: dict[str, float], total: float | None = None):
        self.logs = {w: math.log10(n) for w, n in counts.items()}
        self.total = math.log10((sum(counts.values()) if total is None else total) + 1)

    def cost(self, w: str) -> float:
        known = self.logs.get(w)
        return self.total - known if known is not None else self.total + len(w) * 1.5

    def split(self, name: str) -> tuple[str, ...]:
        return viterbi(name, self.cost)


def judged(pages: DataFrame, url: str = "url", key: str = "page_id", rules: tuple = RULES) -> DataFrame:
    """key, host, path, rule, verdict, words (as segmented) and score (log odds of block) of each row."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = shared_dir(spark)
    lexicon = set(STRONG + WEAK + ORDINARY)
    host, path = parts(F.col(url).cast("string"))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [pieces(h, p) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.list_(pa.string()))], ["rid", "id", "host", "path", "pieces"])

    rows = stored(rows.mapInArrow(cut, "rid long, id long, host string, path string, pieces array<string>"), f"{folder}/rows")
    each = rows.select("rid", F.posexplode("pieces").alias("pos", "piece"))
    counts = stored(each.groupBy("piece").agg(F.count("*").alias("n")), f"{folder}/pieces")

    # Weights: a piece weighs a tenth of its count's root, so that parts of it can still win; each word of the lexicon at
    # least a two-hundredth of all, so that it is found in concatenations however many pieces there are.
    weight = counts.agg(F.coalesce(F.sum(F.sqrt("n") / 10), F.lit(0.0))).first()[0]
    known = max(50.0, weight / 200)
    total = weight + known * len(lexicon)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                subs = list({x[i:j] for i in range(len(x)) for j in range(i + 1, min(i + LONGEST, len(x)) + 1)} | {x})
                for k in range(0, len(subs), 1 << 16):
                    part = subs[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(part), pa.string()), pa.array(part, pa.string())], ["name", "piece"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, subs, ns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                have = {w: known for w in lexicon if w in x}
                for w, n in zip(subs, ns, strict=True):
                    have[w] = math.sqrt(n) / 10 + (known if w in lexicon else 0.0)
                out.append(list(Segmenter(have, total).split(x)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["piece", "split"])

    # Each distinct piece meets the counts of its parts, then each row the splits of its pieces.
    found = counts.select("piece").mapInArrow(within, "name string, piece string").join(counts, "piece")
    found = found.groupBy("name").agg(F.collect_list(F.struct("piece", "n")).alias("x")).select("name", F.col("x.piece").alias("subs"), F.col("x.n").alias("n"))
    found = counts.select("piece").join(found, F.col("piece") == F.col("name"), "left").select("piece", *(F.coalesce(c, F.array()).alias(c) for c in ("subs", "n")))
    splits = stored(found.mapInArrow(segment, "piece string, split array<string>"), f"{folder}/splits")
    worded = each.join(splits, "piece").groupBy("rid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "split"))), lambda x: x["split"])).alias("words"))
    strong = F.exists("words", lambda w: w.isin(STRONG))
    weak = F.size(F.array_distinct(F.filter("words", lambda w: w.isin(WEAK)))) >= 2
    worded = rows.select("rid", "id", "host", "path").join(worded, "rid", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    worded = stored(worded.withColumn("block", strong | weak), f"{folder}/words")

    # Naive Bayes over all words, with Laplace smoothing. The lexicon counts as LEXICON more occurrences of each of its words.
    told = spark.createDataFrame([(w, LEXICON * (w in STRONG + WEAK), LEXICON * (w in ORDINARY)) for w in sorted(lexicon)], "word string, b long, a long")
    of_word = worded.select("block", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("block").alias("b"), F.count_if(~F.col("block")).alias("a"))
    seen = stored(of_word.union(told).groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), f"{folder}/seen")
    all_b, all_a, size = seen.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    pages_b, pages_a = worded.agg(F.count_if("block"), F.count_if(~F.col("block"))).first()
    size += 1 + (pages_a + pages_b > 0)  # the mark of a page counts as a word, and so does any unknown one
    prior = math.log((pages_b + 1) / (pages_a + 1))
    odds = F.log(((F.col("b") + 1) / F.lit(float(all_b + size))) / ((F.col("a") + 1) / F.lit(float(all_a + size))))
    table = stored(seen.select("word", odds.alias("odds")), f"{folder}/odds")
    sums = worded.select("rid", F.posexplode("words").alias("pos", "word")).join(table, "word").groupBy("rid")
    sums = sums.agg(F.aggregate(F.array_sort(F.collect_list(F.struct("pos", "odds"))), F.lit(prior), lambda s, x: s + x["odds"]).alias("score"))
    scored = worded.join(sums, "rid", "left").select("id", "host", "path", F.array_join("words", " ").alias("words"), F.coalesce("score", F.lit(prior)).alias("score"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(F.col("id").alias(key), "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "words", "score")
