"""Mixing sources to target weights: iterative proportional fitting over source, language and topic.

Token counts are summed to cells (source, language, topic); sources, languages and topics outside the targets
share the cell name OTHER, so the number of cells is bounded by the targets whatever the input. Raking rescales
the cells' weights to each marginal in turn until all fit; targets that no weights fit are told of by a warning. A document's inclusion probability is its cell's
weight times a factor that brings the expected number of kept tokens to `keep` of all, at most 1. It stays if
a uniform number derived from its id by MD5 is below that, so runs repeat and a document's fate doesn't depend
on partitions. Rows with the same id share the number.

Null texts count no tokens; null ids are drawn as the text 'null'; null sources and languages are OTHER.
Targets of categories without tokens are spread over the others. An empty table gives an empty result. A topic is told by the
licence that a text names and by its length, as the tables have no other sign of one.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh

OTHER = "other"
#: Production targets, shares of tokens.
SOURCES = {f"src{i}": 0.049 for i in range(20)} | {OTHER: 0.02}
LANGS = {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.12, OTHER: 0.02}
TOPICS = {"licensed": 0.05, "brief": 0.2, "article": 0.5, "longform": 0.25}
KEEP = 0.7
ROUNDS, CLOSE, SCALINGS = 100, 1e-12, 40


def topic_of(text: Column, n_tokens: Column) -> Column:
    """The kind of document: one that names a licence, else by its length in tokens."""
    licence = F.coalesce(F.contains(text, F.lit("Licensed under")) | F.contains(text, F.lit("License")), F.lit(False))
    return F.when(licence, "licensed").when(n_tokens < 150, "brief").when(n_tokens < 1000, "article").otherwise("longform")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 to 1, without 1, of the key's text."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def named(c: Column, targets: dict[str, float]) -> Column:
    return F.when(c.isin(*targets), c).otherwise(OTHER)


def lookup(c: Column, values: dict[str, float]) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(0.0)) if pairs else F.lit(0.0)


def rake(cells: list[tuple[tuple[str, ...], float]], targets: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    """Factors for each dimension and category by iterative proportional fitting of cells: a category of each dimension of
    targets, and tokens. Each step sums the weighted cells over one dimension and rescales its factors."""
    total = sum(n for _, n in cells)
    factors = {d: dict.fromkeys(t, 1.0) for d, t in targets.items()}
    worst = 0.0
    for _ in range(ROUNDS if total else 0):
        worst = 0.0
        for at, (d, target) in enumerate(targets.items()):
            now: dict[str, float] = {}
            for cell, n in cells:
                weight = n * math.prod(factors[e].get(k, 0.0) for e, k in zip(targets, cell, strict=True))
                now[cell[at]] = now.get(cell[at], 0.0) + weight
            present = sum(target.get(k, 0.0) for k, v in now.items() if v)
            for k, v in now.items():
                if v and present:
                    want = total * target.get(k, 0.0) / present
                    worst = max(worst, abs(want - v) / total)
                    factors[d][k] *= want / v
        if worst < CLOSE:
            break
    if worst >= 1e-6:
        warnings.warn(f"no weights fit all targets; the worst is off by a share of {worst:.2g}", stacklevel=2)
    return factors


def weighted(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: int = 7, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", also: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The columns `also` of docs (all, if not given) with mix_source, mix_lang, mix_topic, mix_tokens, mix_weight,
    mix_probability and mix_kept; and the names that these have got."""
    targets = targets or {"source": SOURCES, "lang": LANGS, "topic": TOPICS}
    also = docs.columns if also is None else also
    plain = ("mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_kept")
    names = fresh(docs, *plain)
    (src, lng, top, tok, wgt, prob, kept) = names
    rows = docs.withColumn(tok, tokens_of(F.col(text).cast("string"))).withColumns({
        src: named(F.col(source).cast("string"), targets["source"]),
        lng: named(F.col(lang).cast("string"), targets["lang"]),
        top: topic_of(F.col(text).cast("string"), F.col(tok)),
    })
    cells = rows.groupBy(F.col(src).alias("source"), F.col(lng).alias("lang"), F.col(top).alias("topic")).agg(F.sum(tok).alias("tokens"))
    # A row for each cell, whose number the targets bound.
    found = sorted(((r.source, r.lang, r.topic), float(r.tokens or 0)) for r in cells.collect())
    factors = rake(found, targets)
    weights = [(n, math.prod(factors[d].get(k, 0.0) for d, k in zip(targets, cell, strict=True))) for cell, n in found]
    product = lambda names: lookup(F.col(names[0]), factors["source"]) * lookup(F.col(names[1]), factors["lang"]) * lookup(F.col(names[2]), factors["topic"])

    total, scale = sum(n for n, _ in weights), keep
    for _ in range(SCALINGS):  # the tokens of cells whose probability would exceed 1 are made up for by the others
        got = sum(n * min(1.0, scale * w) for n, w in weights)
        if not got or abs(got - keep * total) <= 1e-13 * total or scale > 1e9:
            break
        scale *= keep * total / got
    out = rows.withColumn(wgt, product((src, lng, top)))
    out = out.withColumn(prob, F.least(F.lit(1.0), F.lit(scale) * F.col(wgt)))
    out = out.withColumn(kept, uniform(F.col(key), seed) < F.col(prob))
    return out.select(*also, *names), names


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs that the sample holds, with the columns of docs."""
    out, names = weighted(docs, **options)
    return out.where(F.col(names[-1])).select(*docs.columns)
