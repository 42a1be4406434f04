"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check.

A fingerprint's 64 bits are cut into 32 segments of two bits; the bit counts of the segments are a
point in a grid with 32 dimensions. The Manhattan distance of two points never exceeds the Hamming
distance of the fingerprints. Within Manhattan distance r at most r of the 32 counts differ, so of
r + m groups of neighbouring dimensions at least m agree: each choice of m groups and their
counts names a grid cell, and every pair in range shares one. The more fingerprints there are, the larger m is
and the finer the cells, so that a cell's expected number of members stays small. Inside a cell the lower bound is
tested first and the fingerprints themselves after it.

Null and empty texts have fingerprint zero and link like any other. Null ids keep their row; the
component's id is the least id that is not null. Repeated rows stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, components, dropped, fresh, hex64, shared_dir, stored, words_of

SEED = 42
#: Choices of how many groups agree. A count of two bits holds 1.5 bits of information, so m of r + m groups name 2^(48 m / (r + m)) cells.
AGREEING = (3, 4, 5, 7, 9)
IN_A_CELL = 4


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Unsigned XXH64 of every n words in a row; of all words if there are fewer; none if there are none."""
    if not words:
        return np.empty(0, np.uint64)
    rows = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in rows), np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, unsigned."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) for each row, fp as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(shingle_hashes(words_of(t), words)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` long, fp long")


def unary(fp: np.ndarray) -> np.ndarray:
    """The embedding, each count of a two-bit segment in unary: Hamming distance here is Manhattan distance there."""
    odd = np.uint64(0x5555555555555555)
    a, b = fp & odd, (fp >> np.uint64(1)) & odd
    return ((a & b) << np.uint64(1)) | (a | b)


def agreeing(n: int, radius: int) -> int:
    """How many groups must agree so that n fingerprints are some IN_A_CELL to a cell at most, as far as that goes."""
    return next((m for m in AGREEING if n <= IN_A_CELL * 2 ** (48 * m / (radius + m))), AGREEING[-1])


def cells_of(fp: np.ndarray, radius: int, agree: int = AGREEING[0]) -> list[np.ndarray]:
    """For each choice of groups, the cell that each fingerprint falls in."""
    code = unary(fp)
    cuts = np.linspace(0, 32, radius + agree + 1).astype(int)
    masks = [sum(3 << (2 * i) for i in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    out = []
    for k, chosen in enumerate(combinations(masks, agree)):
        x = (code & np.uint64(sum(chosen))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        x ^= x >> np.uint64(32)  # invertible, so that different cells of one choice stay apart
        out.append(x.view(np.int64))
    return out


def forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in one cell, positions in fp: breadth first, so that
    what has been reached is never compared again and no cell gives more edges than members."""
    code, edges = unary(fp), []
    left = np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(code[left] ^ code[at]) <= radius
            if near.any():
                near[near] = np.bitwise_count(fp[left[near]] ^ fp[at]) <= radius
                found = left[near]
                edges += [(at, x) for x in found]
                queue += list(found)
                left = left[~near]
    return edges


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints in column fp whose closure holds every link of at most radius bits."""
    distinct = stored(prints.select("fp").distinct(), f"{shared_dir(prints.sparkSession)}/distinct")
    agree = agreeing(distinct.count(), radius)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for cell in cells_of(fp.view(np.uint64), radius, agree):
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp)], ["cell", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def edges(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
            ends = np.r_[starts[1:], len(cell)]
            a, b = [], []
            two = starts[ends - starts == 2]
            hit = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius]
            a += fp[hit].tolist()
            b += fp[hit + 1].tolist()
            for lo, hi in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                own = fp[lo:hi]
                for i, j in forest(own.view(np.uint64), radius):
                    a.append(int(own[i]))
                    b.append(int(own[j]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for x in batches:
            cell = np.concatenate([cell, x.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, x.column(1).to_numpy(zero_copy_only=False)])
            if len(cell) and cell[0] != cell[-1]:
                cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
                yield edges(cell[:cut], fp[:cut])
                cell, fp = cell[cut:], fp[cut:]
        yield edges(cell, fp)

    spread_out = distinct.mapInArrow(spread, "cell long, fp long")
    return spread_out.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) for every row of docs: 16 hex digits, and the least key reachable over links."""
    folder = shared_dir(docs.sparkSession)
    prints = stored(fingerprints(docs, words, text, key), f"{folder}/prints")
    edges = stored(links(prints, radius), f"{folder}/edges")
    roots = components(edges, folder=f"{folder}/roots")
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    named = stored(with_least(least, roots, "fp", "component_id", folder), f"{folder}/named")
    return prints.join(named, "fp").select(key, hex64(F.col("fp")).alias("fingerprint"), "component_id")


def with_least(least: DataFrame, roots: DataFrame, node: str, name: str, folder: str) -> DataFrame:
    """(node, name, and further columns of least): for each node of (node, least) the least value in its component. Rows
    were summed up to nodes before. Both sides of the join are tables, as the result should be too: so Spark can split a
    component or a node that holds many."""
    placed = least.join(roots.withColumnRenamed("node", node), node, "left").select(*least.columns, F.coalesce("root", node).alias("root"))
    placed = stored(placed, f"{folder}/placed")
    by_root = stored(placed.groupBy("root").agg(F.min("least").alias(name)), f"{folder}/by_root")
    return placed.join(by_root, "root").drop("least", "root")


# --- Near-duplicate groups by word-shingle similarity ------------------------------------------

ROWS, BANDS, NEAREST = 4, 12, 3
#: Members of a cell meet in blocks of so many at first; what blocks leave open is found by `prefix_pairs`.
BLOCK = 1024
#: Signatures of 48 places estimate a similarity with a standard deviation of 0.06; candidates may fall short by five of those.
SHORT = 0.3


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(1, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, ROWS * BANDS, np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """For each permutation the least permuted hash, its upper 32 bits."""
    mul, add = _permutations()
    out = np.full(len(mul), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        for k in range(len(mul)):
            out[k] = min(out[k], np.uint32(((part * mul[k] + add[k]) >> np.uint64(32)).min()))
    return out


def similar_edges(sign: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Candidate edges in one block of a cell among the pairs whose signatures agree in least of their places: a maximum
    spanning forest, in which each member is reached from the nearest one that it can be reached from, and each member's
    NEAREST most similar others, as a forest's edge may fail the exact test where another would pass it."""
    n, edges = len(sign), set()
    best, via = np.full(n, -1.0), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    at = 0
    for turn in range(n):
        left[at] = False
        like = (sign == sign[at]).mean(1)
        like[at] = -1
        near = np.argpartition(-like, NEAREST)[:NEAREST] if n > NEAREST else np.arange(n)
        edges.update((min(at, int(i)), max(at, int(i))) for i in near if like[i] >= least)
        up = left & (like > best)
        best[up], via[up] = like[up], at
        if turn < n - 1:
            at = int(np.argmax(np.where(left, best, -2)))
            if best[at] >= least:
                edges.add((min(int(via[at]), at), max(int(via[at]), at)))
    return sorted(edges)


def prefix_pairs(size: np.ndarray, place: np.ndarray, root: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the members that have one shingle in their prefixes, at `place` among their `size` shingles, the positions of
    those pairs that can still reach the similarity and aren't connected yet; blocks of a few rows at a time.

    Two sets share at least similarity / (1 + similarity) of their sizes' sum if they are that similar, and at the
    first place that they share no more than what follows it."""
    if (root == root[0]).all():
        return
    share, room = similarity / (1 + similarity), 1e-9
    rest = size - place
    order = np.argsort(size, kind="stable")
    s, r, g = size[order], rest[order], root[order]
    for lo in range(0, len(order), 256):
        a = slice(lo, lo + 256)
        upto = int(np.searchsorted(s, s[a][-1] / similarity + 1, side="right"))
        b = slice(lo, upto)
        need = share * (s[a][:, None] + s[b]) - room
        open_ = (g[a][:, None] != g[b]) & (s[a][:, None] >= (similarity - room) * s[b]) & (r[a][:, None] >= need) & (r[b] >= need)
        i, j = np.nonzero(np.triu(open_, 1))
        if len(i):
            yield order[lo + i], order[lo + j]


def whole_cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list[tuple]]]:
    """Rows sorted by their first columns as lists of the rows that agree in them, those of one row left out."""
    held: list[tuple] = []

    def cut(full: list[tuple]) -> list[list[tuple]]:
        return [own for _, x in groupby(full, key=lambda row: row[:keys]) if len(own := list(x)) > 1]

    for x in batches:
        held += zip(*(c.to_pylist() for c in x.columns), strict=True)
        if held and held[0][:keys] != held[-1][:keys]:
            n = len(held)
            while held[n - 1][:keys] == held[-1][:keys]:
                n -= 1
            yield cut(held[:n])
            held = held[n:]
    yield cut(held)


def crowded(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """(cell, block, same) of the rows (cell, same), sorted, that aren't alone in their cell. A cell goes on in blocks of
    `most` rows, each with the cell's first row besides; only the last row waits for the next batch."""
    cell, same = np.empty(0, np.int64), np.empty(0, np.int64)
    before, place, leader = None, -1, 0  # the last row given: its cell, its place there, and that cell's first row
    for last, x in chain(((False, x) for x in batches), [(True, None)]):
        if x is not None:
            cell = np.concatenate([cell, x.column(0).to_numpy(zero_copy_only=False)])
            same = np.concatenate([same, x.column(1).to_numpy(zero_copy_only=False)])
        upto = len(cell) if last else len(cell) - 1
        if upto < 1:
            continue
        new = np.r_[before != cell[0], cell[1:] != cell[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(len(cell)), -1))
        places = np.where(start >= 0, np.arange(len(cell)) - start, np.arange(len(cell)) + place + 1)
        leaders = np.where(start >= 0, same[start], leader)
        crowd = (~new | np.r_[~new[1:], False])[:upto]
        keep = np.flatnonzero(crowd)
        lead = keep[(places[keep] > 0) & (places[keep] % most == 0)]
        at = np.r_[keep, lead]
        yield pa.RecordBatch.from_arrays([pa.array(cell[at]), pa.array(places[at] // most), pa.array(np.r_[same[keep], leaders[lead]])], ["cell", "block", "same"])
        before, place, leader = int(cell[upto - 1]), int(places[upto - 1]), int(leaders[upto - 1])
        cell, same = cell[upto:], same[upto:]


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """(key, group) for every row: texts whose sets of word shingles have a Jaccard similarity of at least
    `similarity` share a group, named by the least key in it. Rows with the same words always share one.
    Null or empty texts are alone each, as they have nothing to be copies of. Ties go to the lesser key; an empty table
    gives an empty result.

    Candidates come from two searches, as 64 bits of SimHash can't tell 0.8 from less: the grid cells of
    `links` at three bits, and cells of equal minima of shingle hashes. In a block of a cell a maximum spanning forest of
    estimated similarity is kept, and each member's nearest others, so at most four edges a member; each edge is
    then verified over whole texts. Cells in which members remain that no verified edges connect are decided exactly: by a
    join on prefixes of their members' shingles, rare ones first, so that what a crowd shares leads nowhere. The result reads
    tables in `folder` (a new one, if not given); those that only steps before it needed are dropped.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or shared_dir(spark)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, more, fp, sign, size = [], [], [], [], []
            for t in b.column(1).to_pylist():
                w = words_of(t)
                h = shingle_hashes(w, words)
                whole = b" ".join(w)
                same.append(xxhash.xxh64_intdigest(whole, SEED) >> 1 if w else None)
                more.append(xxhash.xxh64_intdigest(whole, SEED + 1) >> 1 if w else None)
                fp.append(simhash(h))
                h = np.unique(h)
                sign.append(minima(h).tobytes() if w else None)
                size.append(len(h))
            cols = (pa.array(same, pa.int64()), pa.array(more, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sign, pa.binary()), pa.array(size, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], ["id", "exact", "same", "more", "fp", "sign", "size"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("exact", F.xxhash64("text"))
    sketches = stored(rows.mapInArrow(sketch, "id long, exact long, same long, more long, fp long, sign binary, size long"), f"{folder}/sketches")
    # Texts are told apart by 126 bits. Of two that share the first 63 one stands for the kind, and the other stays alone.
    first = F.min(F.struct("more", F.col("id").isNull().alias("no_id"), "id", "exact", "fp", "size", "sign")).alias("k")
    kinds = stored(sketches.where("same is not null").groupBy("same").agg(first).select("same", "k.*"), f"{folder}/kinds")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            full = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, ROWS * BANDS)
            bands = [np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for x in full[:, k * ROWS : (k + 1) * ROWS]], np.uint64).view(np.int64) for k in range(BANDS)]
            for cell in [*bands, *cells_of(fp, 3)]:
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0)], ["cell", "same"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in whole_cells(batches, 2):
            a, b = [], []
            for own in full:
                sign = np.frombuffer(b"".join(x[3] for x in own), np.uint32).reshape(len(own), -1)
                for i, j in similar_edges(sign, max(0.0, similarity - SHORT)):
                    a.append(own[i][2])
                    b.append(own[j][2])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # Most cells hold one text. Their members are found first, without signatures; the others then get theirs.
    cells = kinds.select("same", "fp", "sign").mapInArrow(spread, "cell long, same long").repartition("cell").sortWithinPartitions("cell", "same")
    crowd = stored(cells.mapInArrow(crowded, "cell long, block long, same long"), f"{folder}/crowd")
    signed = kinds.select("same", "sign").join(crowd.hint("merge"), "same").select("cell", "block", "same", "sign")
    pairs = signed.repartition("cell", "block").sortWithinPartitions("cell", "block", "same").mapInArrow(meet, "a long, b long")
    pairs = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{folder}/pairs")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(words_of(t), words)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["same", "size", "hashes"])

    def texts_of(of: DataFrame, name: str) -> DataFrame:
        """(same, text) of the kinds in `of`. Ids may repeat, so texts are found by id and hash. Joins with whole texts are
        merge joins at every size: how much is shuffled shouldn't jump where a side outgrows a broadcast."""
        ids = stored(kinds.where("id is not null").select("same", "id", "exact").join(of.select("same").distinct(), "same"), f"{folder}/{name}")
        return rows.join(ids.hint("merge"), ["id", "exact"]).groupBy("same").agg(F.first("text").alias("text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = (set(shingle_hashes(words_of(t), words).tolist()) for t in (x, y))
                keep.append(len(p & q) >= similarity * len(p | q))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # One text for each kind that has a candidate, then the two texts of each pair side by side.
    texts = stored(texts_of(pairs.select(F.col("a").alias("same")).union(pairs.select("b")), "members"), f"{folder}/texts")
    left = pairs.join(texts.select(F.col("same").alias("a"), F.col("text").alias("x")), "a")
    sides = left.join(texts.select(F.col("same").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    edges = stored(sides.mapInArrow(verify, "a long, b long"), f"{folder}/edges")
    roots = components(edges, folder=f"{folder}/roots")
    for done in ("pairs", "members", "texts"):
        dropped(spark, f"{folder}/{done}")

    # Members of the cells that hold several components still; cells so small that all their pairs were candidates are done.
    placed = crowd.select("cell", "same").distinct().join(roots.withColumnRenamed("node", "same"), "same", "left").select("cell", "same", F.coalesce("root", "same").alias("root"))
    placed = stored(placed, f"{folder}/placed_in_cells")
    dropped(spark, f"{folder}/crowd")
    still = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("root").alias("one"), F.max("root").alias("other"))
    still = stored(still.where((F.col("n") > NEAREST + 1) & (F.col("one") != F.col("other"))).select("cell"), f"{folder}/still")
    if not still.isEmpty():
        asked = stored(placed.join(still, "cell").select("same", "root").distinct(), f"{folder}/asked")
        sets = stored(texts_of(asked, "asked_ids").mapInArrow(shingled, "same long, size long, hashes array<long>"), f"{folder}/sets")
        more = exact_pairs(sets.join(asked, "same"), similarity, folder)
        if not more.isEmpty():
            roots = components(edges.union(more), folder=f"{folder}/more_roots")
        for done in ("placed_in_cells", "still", "asked", "asked_ids", "sets", "shared", "found"):
            dropped(spark, f"{folder}/{done}")
    least = kinds.select("same", F.col("more").alias("of"), F.col("id").alias("least"))
    named = stored(with_least(least, roots, "same", "group", folder), f"{folder}/named")
    own = sketches.select("id", "same", "more").join(named, "same", "left")
    return own.select(F.col("id").alias(key), F.when(F.col("of") == F.col("more"), F.coalesce("group", "id")).otherwise(F.col("id")).alias("group"))


def exact_pairs(sets: DataFrame, similarity: float, folder: str) -> DataFrame:
    """Edges (a, b) between all rows of sets (same, size, hashes: distinct shingles, ascending; root) whose Jaccard
    similarity reaches `similarity` and whose roots differ: an exact join on prefixes.

    Shingles are ordered by how many of the sets hold them. Two sets that are similar enough share one of the first
    size - ceil(similarity * size) + 1 of either; shingles that only one set holds take part by their places alone."""

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in whole_cells(batches, 1):
            for own in full:
                same, size, place, root = (np.array([x[k] for x in own], np.int64) for k in (1, 2, 3, 4))
                for i, j in prefix_pairs(size, place, root, similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(same[i]), pa.array(same[j])], ["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k in range(b.num_rows):
                x, y = (c[k].values.to_numpy() for c in (b.column(2), b.column(3)))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    each = sets.select("same", F.explode("hashes").alias("h"))
    shared = stored(each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), f"{folder}/shared")
    ranked = each.join(shared, "h").groupBy("same").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("in_order"))
    alone = F.col("size") - F.size("in_order")
    first = F.col("size") - F.ceil(F.lit(similarity - 1e-9) * F.col("size")) + 1 - alone
    prefix = sets.select("same", "size", "root").join(ranked, "same").where(first > 0)
    prefix = prefix.select("same", "size", "root", alone.alias("alone"), F.posexplode(F.slice("in_order", F.lit(1), first.cast("int"))).alias("at", "x"))
    prefix = prefix.select(F.col("x.h").alias("h"), "same", "size", (F.col("alone") + F.col("at")).alias("place"), "root")
    found = prefix.repartition("h").sortWithinPartitions("h").mapInArrow(pairs_of, "a long, b long")
    found = stored(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/found")
    whole = sets.select("same", "hashes")
    left = found.join(whole.toDF("a", "x").hint("merge"), "a")
    sides = left.join(whole.toDF("b", "y").hint("merge"), "b").select("a", "b", "x", "y")
    return stored(sides.mapInArrow(verify, "a long, b long"), f"{folder}/more")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key isn't the least of its group; of rows that repeat both key and text one stays.
    Rows with a null key or without a word all stay. An empty table gives an empty result."""
    folder = shared_dir(docs.sparkSession)
    gone, twice = fresh(docs, "gone", "twice")
    groups = stored(similar_groups(docs, words, similarity, text, key, f"{folder}/steps"), f"{folder}/groups")
    dropped(docs.sparkSession, f"{folder}/steps")
    of = docs[key].cast("long")
    drop = groups.where(F.col("group") < F.col(key)).select(F.col(key).alias(gone)).distinct()
    again = groups.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(twice)).count().where("count > 1").select(twice)
    kept = docs.join(stored(drop, f"{folder}/drop").hint("merge"), of == F.col(gone), "left_anti")
    again = stored(again, f"{folder}/again")
    if again.isEmpty():
        return kept
    rest = kept.join(again, of == F.col(twice), "left_semi")
    worded = F.coalesce(F.col(text).cast("string").rlike(WORD), F.lit(False))
    return kept.join(again, of == F.col(twice), "left_anti").unionByName(rest.where(~worded)).unionByName(rest.where(worded).dropDuplicates([key, text]))
