from __future__ import annotations

import pytest

LONG = ("the quick brown fox of the old town jumps over a lazy dog and " * 3200)[:200_000]
TEXTS = {
    0: "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon",
    1: "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon",
    2: "",
    3: None,
    4: LONG,
    5: " \t\n ",
    6: "one",
    7: "The cat of the house and the dog in a garden with the bird\nThe cat of the house and the dog in a garden with the bird",
    8: "Ünïcödé ça \U0001f600 文字 text with, marks; and\u00a0spaces",
}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [(k, t, "en" if k % 2 else None, f"src{k}" if k % 3 else None, k, "x", 1, True) for k, t in TEXTS.items()]
    rows += [rows[0], rows[0], (None, "no id at all here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, bucket int, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
