"""What the operators share: word splitting, bounded batches, most frequent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import dropped, shared_dir, stored

__all__ = ["SPACE", "WORD", "bounded_batches", "components", "dropped", "frequent", "fresh", "hex64", "shared_dir", "stored", "words_of"]

#: ASCII white space of the word contract, as a Java class and as its complement.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches towards Python hold at most so many rows, so that long texts don't pile up."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; bytes.split() knows exactly those six characters."""
    return text.encode().lower().split() if text else []


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def frequent(counts: DataFrame, n: str, most: int, key: str) -> Column:
    """A condition for the rows of counts whose n is greatest, about `most` of them: whole steps of a sixteenth of an octave
    from the top, and of the step at the border the share that there is room for, by a hash of `key`. Only the steps'
    sizes come to the driver, so no task sends it rows to compare."""
    step = F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(step).count().collect()), reverse=True)
    left = most
    for k, rows in sizes:
        if rows > left:
            return (step > k) | ((step == k) & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(left / rows * (1 << 30))))
        left -= rows
    return F.lit(True)
