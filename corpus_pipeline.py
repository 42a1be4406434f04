"""From raw documents to token ids: quality, near-duplicates, pseudonyms, mixture, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileframe.llm import bpe, mixing, pii, quality, simhash
from tileframe.llm.common import dropped, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or diverge from their language's references go, null and empty texts with them.
    Repeated rows are judged each; an empty table stays empty."""
    return quality.good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the least id stays, of rows that repeat
    it one. Rows without an id or a word all stay."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become pseudonyms of the same format; n_chars follows the new text. Null texts stay null.
    The key is that of `pii.key_of`: equal values have equal pseudonyms, in repeated rows too."""
    out = pii.pseudonymised(docs, pii.key_of(spark)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected shares of source, language and topic are the targets. Null sources and languages count as
    other; rows of one id share their fate."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and how many there are: none of a null or empty text."""
    ids = bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "source", "lang"])
    return ids.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pseudonyms", pseudonyms),
    ("mixture", mixture),
    ("encode", encode),
]

#: Pseudonyms, SimHash and merge replay aren't expressible in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next, and dropped after that: what
    still holds personal data doesn't stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = shared_dir(spark), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}_{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                dropped(spark, before)
            before = path
    return docs
