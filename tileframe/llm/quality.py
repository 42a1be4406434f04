"""Quality rules: repetition and length as given, then divergence from language references.

A text's histogram of character classes and its histogram of the common words of its language are compared to
the references of that language, which are mean histograms of the texts of the language in the input, by
the Jensen-Shannon distance (base 2, from 0 to 1). A text that is too short for a stable histogram is not judged
by it (`MIN_CHARS`, `MIN_WORDS`). Texts of an unknown or null language are held against the nearest reference.
References are made of texts that pass the base rules, and without those that hold least and most of the common words
(`LEAST_COMMON`, `MOST_COMMON`), so that junk hardly moves them.

Null and empty texts have no words and fail the base rule. Ids are not read. An empty table has no references
and no rows. Repeated rows are judged each. Whole texts are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh

#: Common words of each language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux d'un cette d'une ou être comme même mais nous vous elle lui".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein die eine als auch es an werden aus er hat daß sie nach wird bei einer um am sind noch wie einem über so zum".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split(),
}
COMMON = {k: list(dict.fromkeys(v)) for k, v in COMMON.items()}
N_COMMON = max(map(len, COMMON.values()))
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other")
MIN_CHARS, MIN_WORDS = 120, 25
#: Limits of the distances for a very long text, and what short ones may have on top, over the root of their length.
CHAR_LIMIT, WORD_LIMIT = (0.13, 1.5), (0.27, 1.4)
#: Shares of a language's texts, by how many of their words are common, that take no part in its references, and bins of that.
LEAST_COMMON, MOST_COMMON, BINS = 0.25, 0.05, 64
WINDOW = 8
SPACES = "\x20\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = set(".,;:'\"!?()-’“”«»¿¡–—/")


def class_table() -> np.ndarray:
    """Class of each code point below 0x3000."""
    out = np.full(0x3000, 6, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        if c.isspace():
            out[i] = 3
        elif c in MARKS:
            out[i] = 4
        elif c in SYMBOLS:
            out[i] = 5
        elif c.isupper():
            out[i] = 1
        elif c.isalpha():
            out[i] = 0
        elif c.isdigit():
            out[i] = 2
    return out


def char_counts(text: str, table: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.bincount(table[np.minimum(points, 0x2FFF)], minlength=len(CLASSES))


def word_counts(seen: Counter, common: list[str]) -> np.ndarray:
    """Counts of the common words, and last of all others."""
    own = [seen[w] for w in common]
    return np.array([*own, *[0] * (N_COMMON - len(own)), seen.total() - sum(own)])


def bare_words(text: str) -> Counter:
    """Words lower-cased, without marks around them."""
    seen: Counter = Counter()
    for w, n in Counter(text.lower().split()).items():
        seen[w.strip(".,;:!?()\"'#*$%&|<>")] += n
    del seen[""]
    return seen


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two histograms, from 0 to 1; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(a, 0) / 2))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated(words)


def fails(n_words: int, n_repeat_words: int) -> bool:
    """The base rule."""
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def repeated(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    if len(words) <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    n = len(x) - WINDOW + 1
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = h * np.uint64(0x94D049BB133111EB) + x[j : j + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    alike = np.ones(len(a), bool)
    for j in range(WINDOW):  # equal hashes are only candidates
        alike &= x[a + j] == x[b + j]
    twice = np.zeros(n, bool)
    twice[a[alike]] = twice[b[alike]] = True
    step = np.zeros(len(x) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step) > 0).sum())


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language of COMMON, the mean histograms over its texts that are long enough, pass the base rule and aren't
    at the ends by their share of common words: characters, common words.

    Each partition adds up its own by bins of that share; what comes back is a row for each language, bin and place,
    whatever the input's size."""
    bounded_batches(docs.sparkSession)
    langs, wide = list(COMMON), len(CLASSES) + N_COMMON + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = class_table(), {k: np.zeros((BINS, wide)) for k in langs}
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and k in sums and len(t) >= MIN_CHARS:
                    seen = bare_words(t)
                    if seen.total() >= MIN_WORDS and not fails(len(words := t.encode().split()), repeated(words)):
                        c, w = char_counts(t, table), word_counts(seen, COMMON[k])
                        sums[k][int((1 - w[-1] / w.sum()) * (BINS - 1))] += np.r_[c / c.sum(), w / w.sum()]
        full = [(k, i, j, float(sums[k][i, j])) for k in langs for i, j in zip(*np.nonzero(sums[k]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in full], t) for n, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.float64()))], ["lang", "bin", "place", "n"])

    out = {k: np.zeros((BINS, wide)) for k in langs}
    rows = docs.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(run, "lang string, bin int, place int, n double")
    for r in rows.groupBy("lang", "bin", "place").agg(F.sum("n").alias("n")).collect():
        out[r.lang][r.bin, r.place] = r.n
    return {k: (v[: len(CLASSES)], v[len(CLASSES) :]) for k, v in ((k, trimmed(v)) for k, v in out.items()) if v.any()}


def trimmed(sums: np.ndarray) -> np.ndarray:
    """The sum over bins of rows without the shares at both ends; a row's characters add up to 1 for each text in it."""
    n = sums[:, : len(CLASSES)].sum(1)
    upto = np.cumsum(n)
    lo, hi = LEAST_COMMON * upto[-1], (1 - MOST_COMMON) * upto[-1]
    inside = np.clip(np.minimum(upto, hi) - np.maximum(upto - n, lo), 0, None)
    return (inside / np.maximum(n, 1e-300)) @ sums


def distances(text: str | None, lang: str | None, refs: dict, table: np.ndarray) -> tuple[float, float]:
    """Distance of characters and of common words to the text's reference; zeros for what is too short to judge."""
    if not text or len(text) < MIN_CHARS or not refs:
        return 0.0, 0.0
    seen = bare_words(text)
    if seen.total() < MIN_WORDS:
        return 0.0, 0.0
    chars = char_counts(text, table)
    near = [(jensen_shannon(chars, refs[k][0]), jensen_shannon(word_counts(seen, COMMON[k]), refs[k][1])) for k in ([lang] if lang in refs else refs)]
    return min(near, key=lambda x: (x[0] + x[1], x))


def far_off(far: tuple[float, float], n_chars: int, n_words: int) -> bool:
    return any(d > limit + more / max(n, 1) ** 0.5 for d, (limit, more), n in zip(far, (CHAR_LIMIT, WORD_LIMIT), (n_chars, n_words), strict=True))


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The columns `keep` of docs (all, if not given) and those of ADDED; the names that the latter have got."""
    refs = references(docs, text, lang)
    keep = docs.columns if keep is None else keep
    (first, second) = fresh(docs, "judged_text", "judged_lang")
    wide = docs.select(*keep, F.col(text).cast("string").alias(first), F.col(lang).cast("string").alias(second))
    fields = [x.split() for x in ADDED.split(", ")]
    names = fresh(docs.select(*keep), *(f[0] for f in fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = class_table()
        for b in batches:
            rows = []
            for t, k in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                n = base_counts(t)
                failed = fails(n[0], n[4])
                far = distances(t, k, refs, table)
                rows.append((*n, failed, *far, not failed and not far_off(far, len(t), n[0])))
            kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            new = [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *new], [*b.schema.names[:-2], *names])

    schema = docs.select(*keep, *(F.lit(None).cast(kind).alias(n) for n, (_, kind) in zip(names, fields, strict=True))).schema
    return wide.mapInArrow(run, schema), names


def good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    out, names = judged(docs, text, lang)
    return out.where(F.col(names[-1])).select(*(out[c] for c in docs.columns))
