"""Hidden Markov language model: Baum-Welch counts summed over partitions, scaled forward recursion.

Words are observed through classes. The `head` most frequent words have a class each; any other word
falls into one of `tails` classes by its last three bytes, and within it has a share of the class by
its own count, less a discount that goes to words never seen. So the latent states, whose emissions
are a table of bounded size, see every token, while counts of all words take part in each score:

    log P(text) = forward(classes) + sum over tail tokens of log P(word | class)

Words are counted over the whole training part; one of over LONGEST bytes stands under its SHA-256. Tail words meet their
counts in a join on the word; a tail word has about 1/head of all tokens at most, which keeps that join even. The
broadcast parts are bounded by head, tails and states.

The first parameters are statistics of all training documents too. The most frequent words are compared by how they occur
together; words that don't, one for each state, are chosen in turn, and each document's classes count for the state whose
word its frequent words go with. Baum-Welch rounds over all training documents follow until the likelihood settles. Every
sequence is a whole text: one that is longer than a batch is taken in pieces, which carry alpha and beta over their borders,
so its counts are exact and memory is bounded. Sums are doubles, so that partitions don't show in the scores.

Null and empty texts are one end token. A null id counts as the empty text in the fold's checksum. Repeated
rows are scored each; ties of counts go by the word's hash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frequent, shared_dir, stored, words_of

END = b""
#: Bytes of a word that is kept as it is.
LONGEST = 256
#: Sequences of up to so many tokens are batched apart from longer ones, as a batch takes as many steps as its longest has tokens.
SHORT = 2048
#: How many frequent words are compared to each other, and the relative gain of likelihood at which rounds end.
COMPARED, SETTLED = 64, 1e-3
#: First parameters: how much likelier a state is to stay than to move to any one other, and the share of a state's own counts.
STICKY, BLEND = 20.0, 0.4
DISCOUNT = 0.5
SMOOTH = 20.0
BATCH_TOKENS = 1 << 20
FLUSH_WORDS = 400_000


def tail_class(word: bytes, tails: int) -> int:
    return zlib.crc32(word[-3:]) % tails


def keys_of(text: str | None) -> list[bytes]:
    """The words of a text; a long one's place is taken by a blank, which no word holds, and its digest."""
    words = words_of(text)
    if words and max(map(len, words)) > LONGEST:
        return [w if len(w) <= LONGEST else b" " + hashlib.sha256(w).digest() for w in words]
    return words


@dataclass
class Model:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (C, K)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.start, self.move, self.emit

    def forward_backward(self, rows: list[np.ndarray], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of start states (K,), moves (K, K) and emissions (C, K) over the sequences, and their log
        likelihood. Sequences side by side should have about `most` tokens at most; one of more is taken in pieces."""
        start, moves, emits, total = np.zeros(len(self.start)), np.zeros(self.move.shape), np.zeros(self.emit.shape), 0.0
        whole = [x for x in rows if len(x) <= most]
        if whole:
            begun, moved, seen, logs, _ = self._counts(whole, None, None)
            start, moves, emits, total = begun, moved, seen, logs
        for x in (x for x in rows if len(x) > most):
            cuts = [x[i : i + most] for i in range(0, len(x), most)]
            befores: list[np.ndarray | None] = [None]  # alpha of the token before each piece
            for piece in cuts[:-1]:
                befores.append(self._last_alpha(piece, befores[-1]))
            beta = None
            for piece, before in zip(cuts[::-1], befores[::-1], strict=True):
                begun, moved, seen, logs, v = self._counts([piece], before, beta)
                moves, emits, total = moves + moved, emits + seen, total + logs
                if before is None:
                    start = start + begun
                else:
                    moves = moves + before.T @ v * self.move
                    beta = v @ self.move.T
        return start, moves, emits, total

    def _last_alpha(self, codes: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        a = before
        for c in codes:
            a = self.emit[c : c + 1] * (self.start if a is None else a @ self.move)
            a /= a.sum()
        return a

    def _counts(self, rows: list[np.ndarray], before: np.ndarray | None, after: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
        """Counts of sequences, or of one piece of a sequence between the alpha before it and the beta after it; last
        emission times beta over scale of the first tokens, longest sequence first."""
        codes, sizes, at = packed(rows)
        k = len(self.start)
        alpha, scale = np.empty((len(codes), k)), np.empty(len(codes))
        a = before
        for t, n in enumerate(sizes):
            lo, hi = at[t], at[t] + n
            a = self.emit[codes[lo:hi]] * (self.start if a is None else a[:n] @ self.move)
            s = a.sum(1)
            a /= s[:, None]
            alpha[lo:hi], scale[lo:hi] = a, s
        moves = np.zeros((k, k))
        beta = np.ones((sizes[-1], k)) if after is None else after
        for t in range(len(sizes) - 1, 0, -1):
            lo, hi, n = at[t], at[t] + sizes[t], sizes[t - 1]
            v = self.emit[codes[lo:hi]] * beta / scale[lo:hi, None]
            alpha[lo:hi] *= beta
            moves += alpha[at[t - 1] : at[t - 1] + sizes[t]].T @ v
            beta = np.ones((n, k))
            beta[: sizes[t]] = v @ self.move.T
        first = slice(0, sizes[0])
        v = self.emit[codes[first]] * beta / scale[first, None]
        alpha[first] *= beta
        emits = np.stack([np.bincount(codes, alpha[:, j], len(self.emit)) for j in range(k)], 1)
        return alpha[first].sum(0), moves * self.move, emits, float(np.log(scale).sum()), v

    def log10(self, rows: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each sequence, by the scaled forward recursion."""
        codes, sizes, at = packed(rows)
        total, a = np.zeros(len(rows)), None
        for t, n in enumerate(sizes):
            a = self.emit[codes[at[t] : at[t] + n]] * (self.start if a is None else a[:n] @ self.move)
            s = a.sum(1)
            a /= s[:, None]
            total[:n] += np.log10(s)
        out = np.empty(len(rows))
        out[longest_first(rows)] = total
        return out


def longest_first(rows: list[np.ndarray]) -> np.ndarray:
    return np.argsort([-len(x) for x in rows], kind="stable")


def packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side, longest first: the codes of each position together, how many, and where they begin."""
    order = longest_first(rows)
    lengths = np.array([len(rows[i]) for i in order])
    sizes = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    at = np.r_[0, np.cumsum(sizes)[:-1]]
    codes = np.empty(lengths.sum(), np.int32)
    for r, i in enumerate(order):
        codes[at[: lengths[r]] + r] = rows[i]
    return codes, sizes, at


def fitted(start: np.ndarray, moves: np.ndarray, emits: np.ndarray, base: np.ndarray) -> Model:
    """The M-step; emissions are smoothed by the classes' overall shares, so no class is impossible in any state."""
    k = len(start)
    e = emits + SMOOTH * base[:, None]
    m = moves + 0.1 + 0.9 * np.eye(k)
    s = start + 0.1
    return Model(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(0, keepdims=True))


def apart(together: np.ndarray, n: int) -> np.ndarray:
    """How much each word goes with each of n words that hardly go together, (words, n), from sums of products of shares.
    The next word is the one with most of its share left apart from those chosen."""
    own = np.sqrt(np.maximum(np.diag(together), 1e-300))
    like = together / own[:, None] / own
    chosen = [int(np.argmax(own))]
    while len(chosen) < min(n, len(own)):
        left = own * (1 - like[:, chosen].max(1))
        left[chosen] = -1
        chosen.append(int(np.argmax(left)))
    return like[:, chosen]


def in_batches(batches: Iterable[tuple[object, np.ndarray]]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows gathered up to BATCH_TOKENS tokens, long ones apart from short ones."""
    held: list[tuple[list, list[np.ndarray]]] = [([], []), ([], [])]
    sizes = [0, 0]
    for key, x in batches:
        k = len(x) > SHORT
        if held[k][1] and sizes[k] + len(x) > BATCH_TOKENS:
            yield held[k]
            held[k], sizes[k] = ([], []), 0
        held[k][0].append(key)
        held[k][1].append(x)
        sizes[k] += len(x)
    yield from (h for h in held if h[1])


def sums_of(rows: DataFrame, work: Callable[[Iterator[bytes]], tuple[np.ndarray, np.ndarray]], wide: int) -> dict[int, np.ndarray]:
    """Rows of `wide` numbers added up by their codes, over all partitions of a column of packed codes: work gives those of
    one partition, whose number doesn't grow with it."""
    names = [f"v{k}" for k in range(wide)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, values = work(c for b in batches for c in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), *(pa.array(np.ascontiguousarray(values[:, k], float)) for k in range(wide))], ["code", *names])

    summed = rows.mapInArrow(run, "code long, " + ", ".join(f"{n} double" for n in names)).groupBy("code").agg(*(F.sum(n).alias(n) for n in names))
    return {r[0]: np.array(r[1:]) for r in summed.collect()}


def trained(train: DataFrame, top: list[tuple[bytes, int]], base: np.ndarray, states: int, rounds: int) -> Model:
    """A model of all sequences of train (codes), with the most frequent words `top` as the first classes."""
    sc, size = train.sparkSession.sparkContext, len(base)
    often = np.array(sorted(range(len(top)), key=lambda i: (-top[i][1], top[i][0]))[:COMPARED], int)
    model = fitted(np.ones(states), np.eye(states) * 20 + 1, np.tile(base[:, None], states), base)
    if not len(often):
        return model
    column = np.full(size, -1)
    column[often] = np.arange(len(often))

    def shares(x: np.ndarray) -> np.ndarray:
        own = column[x]
        return np.bincount(own[own >= 0], minlength=len(often)) / len(x)

    def compare(parts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sums, seen = np.zeros((len(often), len(often))), []
        for c in parts:
            seen.append(shares(np.frombuffer(c, np.int32)))
            if len(seen) == 4096:
                sums, seen = sums + np.array(seen).T @ np.array(seen), []
        return np.arange(len(often)), sums + (np.array(seen).T @ np.array(seen) if seen else 0.0)

    summed = sums_of(train, compare, len(often))
    goes = apart(np.array([summed.get(i, np.zeros(len(often))) for i in range(len(often))]), states)

    def deal(parts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros((states, size))
        for c in parts:
            x = np.frombuffer(c, np.int32)
            np.add.at(sums[int(np.argmax(shares(x) @ goes))], x, 1.0)
        full = np.flatnonzero(sums.any(0))
        return full, sums[:, full].T

    emits = np.zeros((size, states))
    for c, v in sums_of(train, deal, states).items():
        emits[c] = v
    model = fitted(np.ones(states), np.eye(states) * STICKY + 1, BLEND * emits / np.maximum(emits.sum(0), 1) + (1 - BLEND) * base[:, None], 0.001 * base)
    before = -np.inf
    for _ in range(rounds):
        now = sc.broadcast(model.arrays())

        def expect(parts: Iterator[bytes], now=now) -> tuple[np.ndarray, np.ndarray]:
            m, sums = Model(*now.value), None
            for _, part in in_batches((None, np.frombuffer(c, np.int32)) for c in parts):
                got = m.forward_backward(part, BATCH_TOKENS)
                sums = got if sums is None else tuple(p + q for p, q in zip(sums, got, strict=True))
            if sums is None:
                return np.empty(0, np.int64), np.empty((0, states))
            # Classes from 0; start counts at -1, moves from state k at -2 - k, the likelihood below those.
            full = np.flatnonzero(sums[2].any(1))
            return np.r_[-1, -2 - np.arange(states + 1), full], np.vstack([sums[0][None], sums[1], np.full((1, states), sums[3]), sums[2][full]])

        got, emits = sums_of(train, expect, states), np.zeros((size, states))
        now.unpersist()
        if -1 not in got:
            break
        for c, v in got.items():
            if c >= 0:
                emits[c] = v
        model = fitted(got[-1], np.array([got[-2 - k] for k in range(states)]), emits, base)
        likely = float(got[-2 - states][0])
        if likely - before < SETTLED * abs(likely):
            break
        before = likely
    return model


def score(docs: DataFrame, states: int = 8, rounds: int = 4, head: int = 50_000, tails: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_tail (tokens outside the head).
    rounds: of Baum-Welch at most."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    bounded_batches(spark)
    folder = shared_dir(spark)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    held = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 5 == 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([tail_class(w, tails) for w in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "tail", "n"])

        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(keys_of(t))
                seen[END] += 1
            if len(seen) > FLUSH_WORDS:
                yield out(seen)
                seen = Counter()
        yield out(seen)

    partial = rows.where(~held).select("text").mapInArrow(count, "word binary, tail int, n long")
    counts = stored(partial.groupBy("word", "tail").agg(F.sum("n").alias("c")), f"{folder}/counts")
    n_train, n_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    word = F.col("word") != F.lit(END)
    in_head = word & frequent(counts.where(word), "c", head, "word")
    top = sorted((bytes(w), c) for w, c in counts.where(in_head).select("word", "c").collect())
    places = {w: i for i, (w, _) in enumerate(top)}
    end = len(places)
    first_tail = end + 1
    size = first_tail + tails
    below = word & ~in_head
    tail_counts = counts.where(below)
    shares = {t: (c, v) for t, c, v in tail_counts.groupBy("tail").agg(F.sum("c"), F.count("*")).collect()}
    ends = counts.where("word = X''").select("c").first()
    seen = np.array([*(c for _, c in top), ends[0] if ends else 0, *(shares.get(t, (0, 0))[0] for t in range(tails))], float)
    base = (seen + 0.5) / (seen.sum() + 0.5 * size)
    log_base = np.log10((seen[:first_tail] + 0.5) / (n_train + 0.5 * (n_words + 1)))
    known = sc.broadcast((places, log_base, seen[end] > 0))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, log_base, end_known = known.value
        get = places.get
        for b in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for t in b.column(3).to_pylist():
                words = keys_of(t)
                codes, tail = list(map(get, words)), Counter()
                for i, c in enumerate(codes):
                    if c is None:
                        tail[words[i]] += 1
                        codes[i] = first_tail + tail_class(words[i], tails)
                codes.append(end)
                x = np.array(codes, np.int32)
                own = x[x < first_tail]
                n_tail = len(x) - len(own)
                for col, v in zip(cols, (x.tobytes(), len(x), len(own) - (not end_known), float(log_base[own].sum()), n_tail, list(tail), list(tail.values())), strict=True):
                    col.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["rid", "id", "held_out", "codes", "n_tokens", "n_head", "head_base", "n_tail", "tail", "times"])

    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "id", held.alias("held_out"), "text")
    coded = stored(numbered.mapInArrow(code, "rid long, id long, held_out boolean, codes binary, n_tokens long, n_head long, head_base double, n_tail long, tail array<binary>, times array<long>"), f"{folder}/coded")

    model = trained(coded.where("not held_out").select("codes"), top, base, states, rounds)
    final = sc.broadcast(model.arrays())

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*final.value)
        for rid, part in in_batches((r, np.frombuffer(c, np.int32)) for b in batches for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(m.log10(part))], ["rid", "classes"])

    scored = coded.select("rid", "codes").mapInArrow(forward, "rid long, classes double")

    # Tail words meet their counts.
    table = spark.createDataFrame([(t, float(c), float(v)) for t, (c, v) in shares.items()] or [(0, 0.0, 0.0)], "tail int, tail_c double, tail_v double")
    each = coded.where("n_tail > 0").select("rid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("rid", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    unit = float(n_train + 0.5 * (n_words + 1))
    within = counts.join(F.broadcast(table), "tail").where(below).select("word", "c", ((F.col("c") - DISCOUNT) / F.col("tail_c")).alias("share"))
    met = each.join(within, "word", "left").select("rid", "times", F.coalesce("c", F.lit(0)).alias("c"), "share", F.when(F.col("share").isNull(), tail_of(F.col("word"), tails)).alias("tail"))
    met = met.join(F.broadcast(table.select("tail", F.when(F.col("tail_c") > 0, DISCOUNT * F.col("tail_v") / F.col("tail_c")).otherwise(1.0).alias("unseen"))), "tail", "left")
    sums = met.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(unit))).alias("tail_base"),
        F.sum(F.col("times") * F.log10(F.coalesce("share", "unseen", F.lit(1.0)))).alias("tail_score"),
    )
    all_rows = coded.select("rid", "id", "held_out", "n_tokens", "n_head", "head_base", "n_tail").join(scored, "rid").join(sums, "rid", "left")
    return all_rows.select(
        F.col("id").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("classes") + F.coalesce("tail_score", F.lit(0.0))).alias("score"),
        "n_tail",
    )


def tail_of(word, tails: int):
    """tail_class as a column."""
    last = F.when(F.length(word) > 3, F.expr("substring(word, -3, 3)")).otherwise(word)
    return (F.crc32(last) % tails).cast("int")
