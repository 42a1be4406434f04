"""Byte-level BPE by merge replay over the distinct words of the corpus.

Texts are cut into words by the pattern; chunks of texts become numbers: a word that is a token is its rank, any other one
is a place in the chunk's own list of words. These lists are dealt out by the words' hash, so that the words of all chunks
meet and each is merged once (once for each 2^GROUP_BITS input partitions, and each MEMORY of words, if there are more): all words
of a slice lie in one row of symbols. An inverted index leads from the rank of a
merge to the positions of the pairs that it joins; merges are applied in rank order, each over all its positions
from left to right, and only the pairs to the left and right of a joined one are entered anew. A new pair of a
lower rank than the current merge is joined first, as the order within each word demands. The ids then go back to their
chunks, which are spread out to texts again. Numbers, words and ids travel as compressed blocks. The exchange of chunks is read
twice, so the texts should come from a table, whose rows don't change when a lost part is made again.

Null and empty texts have no tokens. Repeated rows are encoded each; an empty table gives an empty result. Whole texts are
encoded; memory follows the longest text, the chunk and the slice.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, fresh

#: Characters of a chunk, bytes of the words that are merged side by side, and of those that are held at once.
CHUNK, SLICE, MEMORY = 1 << 23, 1 << 20, 1 << 24
#: Parts that words are dealt to by hash, and input partitions whose words meet.
BUCKETS, GROUP_BITS = 64, 10
#: Ranks are joined at once until so many of them, more than others since, had fewer places than FEW.
FEW, FEW_STEPS = 8, 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f.read().splitlines()))}


class Merges:
    """The rank table as pairs of ids, and the ranks of the pairs of single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pairs: list[dict[int, int]] = [{} for _ in range(max(ranks.values()) + 1)]  # by the left id, then by the right one
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left][right] = rank
        keys = sorted((left << 32 | right, rank) for left, row in enumerate(self.pairs) for right, rank in row.items())
        self.keys, self.key_ranks = np.array([k for k, _ in keys]), np.array([r for _, r in keys])
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)])
        self.first = np.array([ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)])

    def of(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """Ranks of pairs, -1 for none."""
        keys = np.asarray(left) << 32 | right
        if not len(self.keys):
            return np.full(keys.shape, -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_ranks[at], -1)


def grouped(index: dict[int, list], heap: list[int] | None, ranks: np.ndarray, places: np.ndarray) -> None:
    """Enters places into the index by their ranks; new ranks also go to the heap."""
    order = np.argsort(ranks, kind="stable")
    ranks, places = ranks[order], places[order]
    starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else ranks
    for rank, part in zip(ranks[starts].tolist(), np.split(places, starts[1:]) if len(ranks) else (), strict=True):
        if rank in index:
            index[rank].append(part)
        else:
            index[rank] = [part]
            if heap is not None:
                heappush(heap, rank)


class Row:
    """The symbols of all words side by side, where each one's neighbours are, and the inverted index."""

    def __init__(self, words: list[bytes], merges: Merges):
        self.merges = merges
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        sizes = np.array([len(w) for w in words])
        self.ends = np.cumsum(sizes)
        self.word = np.repeat(np.arange(len(words)), sizes)
        self.sym = merges.bytes[raw]  # the symbol that begins here; -1 within one
        links = np.arange(len(raw))
        self.nxt, self.prv = links + 1, links - 1
        self.nxt[self.ends - 1] = -1
        self.prv[self.ends - sizes] = -1
        self.pair = np.full(len(raw), -1)  # the rank of the pair that begins here
        self.pair[:-1] = merges.first[(raw[:-1] << 8) | raw[1:]]
        self.pair[self.ends - 1] = -1
        self.index: dict[int, list] = {}  # from ranks to arrays of places
        places = np.flatnonzero(self.pair >= 0)
        grouped(self.index, None, self.pair[places], places)
        self.heap = sorted(self.index)

    def join_many(self) -> None:
        """Merges of low ranks, which have many places each: a rank's places are joined at once. A word takes part with
        its leftmost place; its other ones are entered again, as what the joining makes may have a lower rank."""
        sym, nxt, prv, pair, few = self.sym, self.nxt, self.prv, self.pair, 0
        while self.heap and few < FEW_STEPS:
            rank = heappop(self.heap)
            p = np.unique(np.concatenate(self.index.pop(rank)))
            p = p[pair[p] == rank]
            few = few + 1 if len(p) < FEW else max(0, few - 1)
            if not len(p):
                continue
            word = self.word[p]
            leftmost = np.r_[True, word[1:] != word[:-1]]
            if not leftmost.all():
                self.index[rank] = [p[~leftmost]]
                heappush(self.heap, rank)
                p = p[leftmost]
            q, left = nxt[p], prv[p]
            right = nxt[q]
            sym[p], sym[q] = rank, -1
            pair[p] = pair[q] = -1
            nxt[p] = right
            more, less = right >= 0, left >= 0
            prv[right[more]] = p[more]
            pair[p[more]] = self.merges.of(rank, sym[right[more]])
            pair[left[less]] = self.merges.of(sym[left[less]], rank)
            touched = np.r_[p[more], left[less]]
            touched = touched[pair[touched] >= 0]
            if len(touched):
                grouped(self.index, self.heap, pair[touched], touched)

    def join_rest(self) -> None:
        """The other merges, place by place."""
        pairs, heap = self.merges.pairs, self.heap
        sym, nxt, prv = self.sym.tolist(), self.nxt.tolist(), self.prv.tolist()
        index = {r: np.concatenate(parts).tolist() for r, parts in self.index.items()}
        places_of = index.get
        while heap:
            rank = heappop(heap)
            at = index.pop(rank, None)
            if at is None:
                continue
            at.sort()
            with_rank = pairs[rank]
            for k, p in enumerate(at):
                q = nxt[p]
                left = sym[p]
                if q < 0 or left < 0 or pairs[left].get(sym[q]) != rank:
                    continue
                sym[p] = rank
                sym[q] = -1
                r1 = r2 = None
                nxt[p] = q = nxt[q]
                if q >= 0:
                    prv[q] = p
                    r1 = with_rank.get(sym[q])
                    if r1 is not None:
                        places = places_of(r1)
                        if places is not None:
                            places.append(p)
                        else:
                            index[r1] = [p]
                            heappush(heap, r1)
                q = prv[p]
                if q >= 0:
                    r2 = pairs[sym[q]].get(rank)
                    if r2 is not None:
                        places = places_of(r2)
                        if places is not None:
                            places.append(q)
                        else:
                            index[r2] = [q]
                            heappush(heap, r2)
                if (r1 is not None and r1 <= rank) or (r2 is not None and r2 <= rank):
                    # A merge of a lower rank in this word goes first; the other places wait in the index.
                    if rank not in index:
                        index[rank] = []
                        heappush(heap, rank)
                    index[rank] += at[k + 1 :]
                    break
        self.sym = np.array(sym)

    def ids(self) -> list[list[int]]:
        live = self.sym >= 0
        cuts = np.cumsum(live)[self.ends - 1].tolist()
        ids = self.sym[live].tolist()
        return [ids[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]


def replay(words: Iterable[bytes], merges: Merges) -> list[list[int]]:
    """Ids of each word; words aren't empty."""
    words = list(words)
    if not words:
        return []
    row = Row(words, merges)
    row.join_many()
    row.join_rest()
    return row.ids()


class Codec:
    """Texts to numbers and numbers to ids."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = read_ranks(ranks_path)
        self.split = regex.compile(pattern).findall
        self.tokens = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        if [self.ranks[t] for t in self.tokens] != list(range(len(self.tokens))):
            raise ValueError(f"the ranks of {ranks_path} don't run from 0 without gaps")
        self.names = [str(i) for i in range(len(self.tokens))]

    def cut(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
        """For each text the numbers of its words, and the words that are no token: the first has the number that
        follows the ranks."""
        numbers = Numbers(self.ranks)
        number_of = numbers.__getitem__
        return [np.array(list(map(number_of, self.split(t))), np.int32) if t else np.empty(0, np.int32) for t in texts], numbers.words

    def ids(self, numbers: np.ndarray, sizes: np.ndarray, of_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbers in a row, and where each number's ids end. sizes: how many ids each word has that is no token;
        of_words: these ids, one word after another."""
        n = len(self.tokens)
        source = np.concatenate([np.arange(n, dtype=np.int32), of_words.astype(np.int32)])
        lengths = np.concatenate([np.ones(n, np.int64), sizes])
        starts = np.cumsum(lengths) - lengths
        own = lengths[numbers]
        ends = np.cumsum(own)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[numbers] - (ends - own), own)
        return source[at], ends

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text, all in one process."""
        numbers, words = self.cut(texts)
        of_words = replay(words, Merges(self.ranks))
        flat, sizes = np.array([i for x in of_words for i in x], np.int32), np.array([len(x) for x in of_words], np.int64)
        return [self.ids(x, sizes, flat)[0].tolist() for x in numbers]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def shown(self, ids: Iterable[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


class Numbers(dict):
    """Numbers of words: ranks of tokens; others are numbered as they come."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.words = ranks, []

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        n = self.ranks.get(raw)
        if n is None:
            n = len(self.ranks) + len(self.words)
            self.words.append(raw)
        self[word] = n
        return n


def pressed(numbers: np.ndarray) -> bytes:
    """Numbers by their first bytes, second bytes and so on, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 6)


def unpressed(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def dealt(numbers: np.ndarray, words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers in which a word that is no token is n where it is met first and n + 1 + its place later, as words are
    numbered in the order that they come in; the words' buckets; and a block of words for each bucket."""
    bucket = (np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % BUCKETS).astype(np.uint8)
    rest = np.flatnonzero(numbers >= n)
    first = rest[np.unique(numbers[rest], return_index=True)[1]]
    numbers = numbers.copy()
    numbers[rest] += 1
    numbers[first] = n
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    own = [words[i] for i in order]
    return numbers, bucket, [block(own[a:b]) if b > a else b"" for a, b in zip(cuts, cuts[1:], strict=False)]


def undealt(numbers: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """The numbers again, with words in the order of their buckets."""
    new, place = numbers == n, np.empty(len(bucket), np.int32)
    place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket), dtype=np.int32)
    at = np.where(new, np.cumsum(new) - 1, numbers - n - 1)
    return np.where(numbers < n, numbers, n + place[np.maximum(at, 0)] if len(place) else numbers)


def block(words: list[bytes]) -> bytes:
    sizes = np.array([len(w) for w in words], "<u4").tobytes()
    return zlib.compress(len(words).to_bytes(4, "little") + sizes + b"".join(words), 6)


def unblock(raw: bytes) -> list[bytes]:
    raw = zlib.decompress(raw)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def cut(docs: DataFrame, keep: list[str], ranks_path: str, pattern: str, text: str) -> DataFrame:
    """Chunks of docs: (chunk, kept: the columns keep of its rows, sizes: words of each, numbers, buckets, words: a block a
    bucket)."""
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    fields = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("kept", T.ArrayType(rows.schema["kept"].dataType)), T.StructField("sizes", T.BinaryType()), T.StructField("numbers", T.BinaryType()), T.StructField("buckets", T.BinaryType()), T.StructField("words", T.ArrayType(T.BinaryType()))])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, size, chunk = Codec(ranks_path, pattern), [], 0, 0

        def out() -> pa.RecordBatch:
            nonlocal chunk
            kept = pa.concat_arrays([b.column(0) for b in held]).cast(arrow.field("kept").type.value_type)
            numbers, words = codec.cut([t for b in held for t in b.column(1).to_pylist()])
            flat, buckets, blocks = dealt(np.concatenate(numbers), words, len(codec.tokens))
            name = held[0].column(2)[0].as_py() << 32 | chunk
            chunk += 1
            cols = [[name], None, [pressed(np.array([len(x) for x in numbers]))], [pressed(flat)], [zlib.compress(buckets.tobytes())], [blocks]]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept) if c is None else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for b in batches:
            lengths = np.cumsum(np.fromiter((len(t or "") for t in b.column(1).to_pylist()), np.int64, b.num_rows))
            at = 0
            while at < b.num_rows:
                past = lengths[at - 1] if at else 0
                upto = min(b.num_rows, int(np.searchsorted(lengths, past + max(1, CHUNK - size), side="left")) + 1)
                held.append(b.slice(at, upto - at))
                size += int(lengths[upto - 1] - past)
                at = upto
                if size >= CHUNK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, fields)


def merged(blocks: DataFrame, ranks_path: str) -> DataFrame:
    """(chunk, bucket, sizes, ids) of blocks (bucket, chunk, words): each distinct word merged once, as far as memory goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            distinct = list(dict.fromkeys(w for *_, words in held for w in words))
            of, part, n = {}, [], 0
            for w in distinct:
                part.append(w)
                n += len(w)
                if n >= SLICE:
                    of.update(zip(part, replay(part, merges), strict=True))
                    part, n = [], 0
            of.update(zip(part, replay(part, merges), strict=True))
            rows = [(c, k, pressed(np.array([len(of[w]) for w in words], np.int32)), pressed(np.array([i for w in words for i in of[w]], np.int32))) for c, k, words in held]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["chunk", "bucket", "sizes", "ids"])

        for b in batches:
            merges = merges or Merges(read_ranks(ranks_path))
            for k, c, raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
                held.append((c, k, unblock(raw)))
                size += sum(map(len, held[-1][2]))
                if size >= MEMORY:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return blocks.mapInArrow(run, "chunk long, bucket int, sizes binary, ids binary")


def spread(docs: DataFrame, keep: list[str], ranks_path: str, pattern: str, text: str, give: Callable[[Codec, np.ndarray, np.ndarray], list[pa.Array]], schema: T.StructType) -> DataFrame:
    """The columns keep of docs, and those that give makes of the ids of some rows and their borders; schema: all of these."""
    bounded_batches(docs.sparkSession)
    chunks = cut(docs, keep, ranks_path, pattern, text).repartition("chunk")

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, c, x) for c, words in zip(b.column(0).to_pylist(), b.column(5).to_pylist(), strict=True) for k, x in enumerate(words) if x]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["bucket", "chunk", "words"])

    # All columns go to Python here, so that this reads the same exchange as the join below.
    blocks = chunks.mapInArrow(blocks_of, "bucket int, chunk long, words binary").repartition("bucket", F.shiftright("chunk", 32 + GROUP_BITS))
    back = merged(blocks, ranks_path).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "sizes", "ids"))).alias("back"))
    full = chunks.join(back.hint("merge"), "chunk", "left").select("kept", "sizes", "numbers", "buckets", F.col("back.sizes").alias("of_sizes"), F.col("back.ids").alias("of_ids"), "words")
    arrow = to_arrow_schema(schema)
    joined = lambda raw: np.concatenate([np.empty(0, np.int32), *map(unpressed, raw or ())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks_path, pattern)
        for b in batches:
            for k in range(b.num_rows):
                kept, sizes, numbers = b.column(0)[k].values, unpressed(b.column(1)[k].as_py()), unpressed(b.column(2)[k].as_py())
                numbers = undealt(numbers, np.frombuffer(zlib.decompress(b.column(3)[k].as_py()), np.uint8), len(codec.tokens))
                ids, ends = codec.ids(numbers, joined(b.column(4)[k].as_py()), joined(b.column(5)[k].as_py()))
                cuts = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
                cols = [*kept.flatten(), *give(codec, ids, cuts)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return full.mapInArrow(run, schema)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if not given) and a column token_ids (array<int>)."""
    keep = docs.columns if keep is None else keep
    (name,) = fresh(docs.select(*keep), "token_ids")
    give = lambda codec, ids, cuts: [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))]
    return spread(docs, keep, ranks_path, pattern, text, give, docs.select(*keep, F.lit(None).cast("array<int>").alias(name)).schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each text, encoded and decoded again."""

    def give(codec: Codec, ids: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
        one, two = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = ids[a:b].tolist()
            one.append(hashlib.sha256(codec.shown(own).encode()).hexdigest())
            two.append(hashlib.sha256(codec.decode(own)).hexdigest())
        return [pa.array(np.diff(cuts), pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    schema = rows.select(key, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return spread(rows, [key], ranks_path, pattern, text, give, schema)
