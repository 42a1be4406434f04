"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hmm, html, mixing, pii, quality, secrets, simhash, spotsigs, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 likelihood of every text of documents under the hidden Markov model of the training fold, beside a unigram base. Null
    texts are one end token; an empty table gives no rows."""
    return hmm.score(table(spark, sf_dir, "documents"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of documents and of its edited text, and how like these and the next document's are. Null
    texts are empty ones."""
    return spotsigs.edited_likeness(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text of documents and the least doc_id that links of three bits lead to. Null and empty texts have
    fingerprint zero; null ids keep their rows."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, weight, probability and fate of every row of documents under the production targets. Null texts hold no tokens; null
    sources and languages count as other."""
    out, names = mixing.weighted(table(spark, sf_dir, "documents"), also=["doc_id"])
    out = out.select("doc_id", *(F.col(n).alias(n.lstrip("_").removeprefix("mix_")) for n in names))
    return out.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of documents, as it is and in its layers. Null and empty texts have none."""
    return secrets.digests(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every text of documents and of what they decode to. Null and empty texts have no tokens."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every text of documents and whether it is kept. Null and empty texts fail the base rule."""
    return quality.judged(table(spark, sf_dir, "documents"), keep=["doc_id"])[0]


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents under pseudonyms, and where they are. Null texts stay null. The key is `pii.key_of`'s."""
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_of(spark))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every url of pages. A null url has empty host and path, and the model's verdict of no words."""
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of pages. Null and empty html gives an empty text."""
    return html.extracted(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (op1_hmm_score, op2_spotsigs, op3_simhash, op4_mixing, op5_secrets, op6_bpe, op7_quality, op8_pii, op9_urls, op10_html, pipeline)
    return {f.__name__: f for f in all_of}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return SQL
