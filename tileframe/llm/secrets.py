"""Secret scans: patterns over a text and over every layer that can be unwrapped from it.

A worklist holds layers. Each is scanned; then its URL escapes, its Unicode escapes and its base64 runs (with
gzip, zlib, bz2, xz or zstd inside) are unwrapped, each giving a new layer with the rest of the text around
it, until no new layer comes. A layer that was seen, by its text and places, isn't taken again, so cycles end.
For each character a layer knows the span of the original that it came from, and a find is reported there.

Bytes that are no UTF-8 don't stop a layer: an escape of one stays as it is, and what is unpacked, or decoded and hardly
holds any, keeps them as marks of their own.

Null and empty texts have no finds; an empty table gives an empty result. Repeated rows are scanned each, whole texts always. Compressed bytes are unpacked
until what comes out isn't compressed, all members of each. Whatever its size, what was compressed has one place, the run's:
the layer keeps both its ends, for finds that go on outside, and it is read as a stream of windows that are layers of their
own, cut at white space (never within folded base64) unless `MOST_BYTES` characters hold none. What wasn't compressed is
decoded whole, each character with its place.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MOST_BYTES = 1 << 24
WINDOW, OVERLAP, END, PIECE, LEVELS = 1 << 20, 1 << 12, 1 << 12, 1 << 16, 100
KINDS = ("assign", "access", "hex")
#: The patterns of the kinds, and how long a find must be.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
#: Characters that finds go on over, and one of them that ends the finds of the lines above.
RUNS = (("0123456789abcdef", "0"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "Z"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", "_"))

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8})+")
ESCAPE = re.compile(r"\\[uUx]([0-9A-Fa-f]+)")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
FOLDED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}+(?:\r?\n[A-Za-z0-9+/]{4,}+)+={0,2}")
#: A line's end where no folded base64 goes on.
BREAK = re.compile(r"(?<![A-Za-z0-9+/\r])\r?\n|\n(?![A-Za-z0-9+/]{0,3}\Z|[A-Za-z0-9+/]{4})")
#: Of decoded characters that aren't packed at most one in so many may be no UTF-8, and so many there must be then.
BROKEN, LEAST_BROKEN = 8, 12

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """Finds of each kind, leftmost first, not overlapping within a kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def ordered(spans: set[Span] | list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def opener(head: bytes) -> object | None:
    """A decompressor for bytes that begin like a compressed member."""
    if head[:2] == b"\x1f\x8b" or head[:2] in (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


def inflated(source: Iterator[bytes]) -> Iterator[bytes]:
    """What the members of a stream hold, in pieces. What follows the last member comes as it is, behind an empty piece,
    and so does what only begins like one."""
    data, given = b"", False
    while True:
        while len(data) < 6 and (x := next(source, None)) is not None:
            data += x
        if not data:
            return
        d, whole = opener(data), data
        if d is None:
            yield b""
            yield data
            yield from source
            return
        first = True
        while not d.eof:
            try:
                if type(d).__module__ == "zlib":
                    out = d.decompress(data, PIECE)
                    data = d.unconsumed_tail
                elif hasattr(d, "needs_input"):
                    out, data = d.decompress(data, PIECE), b""
                else:  # zstd knows no bound on a piece, so it gets little at a time
                    out, data = d.decompress(data[:64]), data[64:]
            except Exception:  # not what its first bytes say, or broken
                if first:
                    yield b""
                    yield whole
                    yield from source
                return
            if out:
                first = False
                yield out
            elif not d.eof and not data and getattr(d, "needs_input", True):
                if (x := next(source, None)) is None:
                    return
                data = x
                whole = whole + x if first else b""
        data = d.unused_data + data


def unpacked(raw: bytes) -> Iterator[bytes]:
    """The bytes in pieces, unpacked until they don't begin like compressed ones (at most LEVELS times: there are
    compressed files that unpack to themselves)."""
    pieces: Iterator[bytes] = iter([raw])
    for _ in range(LEVELS):
        head: list[bytes] = []
        while sum(map(len, head)) < 6 and (x := next(pieces, None)) is not None:
            head.append(x)
        pieces = chain(head, pieces)
        if opener(b"".join(head)) is None or head[0] == b"":
            return pieces
        pieces = inflated(pieces)
    return pieces


def width(c: str) -> int:
    """Bytes that a decoded character comes from."""
    return 1 if "\udc80" <= c <= "\udcff" else len(c.encode("utf-8", "surrogatepass"))


def windows(pieces: Iterator[bytes]) -> Iterator[str]:
    """Decoded text in windows that overlap."""
    decode, text, whole, searched = codecs.getincrementaldecoder("utf-8")("surrogateescape"), "", True, 0
    for x in chain(pieces, [None]):
        text += decode.decode(x or b"", x is None or x == b"")
        while len(text) > WINDOW:
            at = max(text.rfind(c, OVERLAP * 2) for c in " \t")
            if at < 0:
                at = max((m.start() for m in BREAK.finditer(text, max(OVERLAP * 2, searched - 8))), default=-1)
            searched = len(text) if at < 0 else 0
            if at < 0:
                if len(text) < MOST_BYTES:
                    break
                at, searched = len(text), 0
            yield text[:at]
            text, whole = text[max(0, at - OVERLAP) :], False
    if text or whole:
        yield text


class Decoded(NamedTuple):
    """A run's characters and the parts of the run that they come from; raw: the bytes, if they hold more."""

    text: str
    starts: np.ndarray
    ends: np.ndarray
    raw: bytes | None = None


def is_packed(raw: bytes) -> bool:
    """Whether anything comes out of bytes that begin like a compressed member."""
    if opener(raw) is None:
        return False
    pieces = inflated(iter([raw]))
    return next(pieces, None) != b"" or next(pieces, None) != raw


def plain(raw: bytes) -> str | None:
    """The text of bytes that aren't packed; None if they are none."""
    text = raw.decode("utf-8", "surrogateescape")
    broken = len(re.findall("[\udc80-\udcff]", text))
    if broken and opener(raw) is None and (broken * BROKEN > len(text) or len(text) < LEAST_BROKEN):
        return None
    return text or None


def both_ends(raw: bytes) -> tuple[str, bool]:
    """What packed bytes hold, and whether it is whole. Of more than 2 * END characters both ends, with a character between
    them that joins a find which goes on from one to the other."""
    first, last, total, tails = "", "", 0, [0] * len(RUNS)
    for part in windows(unpacked(raw)):
        new = part if not total else part[min(OVERLAP, total) :]
        first += new[: max(0, END * 2 - len(first))]
        last = (last + new)[-END:]
        for k, (run, _) in enumerate(RUNS):
            n = len(new) - len(new.rstrip(run))
            tails[k] = tails[k] + n if n == len(new) else n
        total += len(new)
    if total <= END * 2:
        return first, True
    between = next((c for (_, c), n in zip(RUNS, tails, strict=True) if n >= total - END), "\n")
    return first[:END] + between + last, False


def from_url(run: str) -> list[tuple[str, int, int]]:
    """Characters of a run, and the part of the run that each comes from."""
    out, at = [], 0
    for c in bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape"):
        n = 3 * width(c)
        out += [(c, at, at + n)] if n > 3 or c < "\x80" else [(run[i], i, i + 1) for i in range(at, at + 3)]
        at += n
    return out


def from_unicode(run: str) -> list[tuple[str, int, int]]:
    units = [(int(m[1], 16), m.start(), m.end()) for m in ESCAPE.finditer(run)]
    out: list[tuple[str, int, int]] = []
    for k, (n, i, j) in enumerate(units):
        if 0xD800 <= n < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
            out.append((chr(0x10000 + ((n - 0xD800) << 10) + (units[k + 1][0] - 0xDC00)), i, units[k + 1][2]))
        elif 0xDC00 <= n < 0xE000 and k and 0xD800 <= units[k - 1][0] < 0xDC00:
            continue
        elif n > 0x10FFFF or 0xD800 <= n < 0xE000:
            out += [(run[x], x, x + 1) for x in range(i, j)]
        else:
            out.append((chr(n), i, j))
    return out


def from_base64(run: str) -> Decoded | None:
    """The run's characters, or None if it isn't wrapped text. The run may go over several lines."""
    places = np.array([i for i, c in enumerate(run) if c not in "\r\n="], np.int64) if "\n" in run else None
    body = run.rstrip("=") if places is None else run.replace("\r", "").replace("\n", "").replace("=", "")
    if len(body) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(body.translate({45: 43, 95: 47}) + "=" * (-len(body) % 4), validate=True)
    except ValueError:
        return None
    if is_packed(raw):
        text, whole = both_ends(raw)
        return Decoded(text, np.zeros(len(text), np.int64), np.full(len(text), len(run)), None if whole else raw) if text else None
    text = plain(raw)
    if text is None:
        return None
    # Three bytes come from four characters.
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = np.where((c >= 0xDC80) & (c <= 0xDCFF), 1, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
    at = np.cumsum(n) - n
    upto = at + n - 1
    starts, ends = at // 3 * 4 + at % 3, np.minimum(len(body), upto // 3 * 4 + upto % 3 + 2)
    return Decoded(text, starts, ends) if places is None else Decoded(text, places[starts], places[ends - 1] + 1)


def of_units(decode: Callable[[str], list[tuple[str, int, int]]]) -> Callable[[str], Decoded]:
    def run(run: str) -> Decoded:
        chars, starts, ends = zip(*decode(run), strict=True)
        return Decoded("".join(chars), np.array(starts), np.array(ends))

    return run


WRAPS: tuple[tuple[str, re.Pattern, Callable], ...] = (("%", URL, of_units(from_url)), ("\\", UNICODE, of_units(from_unicode)), ("", BASE64, from_base64), ("\n", FOLDED, from_base64))


def unwrapped(text: str, pattern: re.Pattern, decode: Callable[[str], Decoded | None]) -> tuple[str, list[tuple[int, int, Decoded]]] | None:
    """The text with all runs of one wrap decoded, and the runs; None if there are none."""
    found = [(m.start(), m.end(), d) for m in pattern.finditer(text) if (d := decode(m[0])) and d.text != m[0]]
    if not found:
        return None
    out, at = [], 0
    for i, j, d in found:
        out += [text[at:i], d.text]
        at = j
    return "".join(out) + text[at:], found


def all_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Finds in the text as it is, and those together with finds in its layers, each in order."""
    if not text:
        return [], []
    base = scan(text)
    spans = set(base)
    Layer = tuple[str, np.ndarray | None, np.ndarray | None]
    seen = set()

    def inside(raw: bytes, start: int, end: int) -> Iterator[Layer]:
        """Layers of a packed run, as far as they can give finds that aren't there yet."""
        for part in windows(unpacked(raw)):
            if all((k, start, end) in spans for k in KINDS):
                return
            spans.update((k, start, end) for k, _, _ in scan(part))
            yield part, np.broadcast_to(start, len(part)), np.broadcast_to(end, len(part))

    work: list[Iterator[Layer]] = [iter([(text, None, None)])]
    while work:
        layer, lo, hi = next(work[-1], (None, None, None))
        if layer is None:
            work.pop()
            continue
        for sign, pattern, decode in WRAPS:
            if sign not in layer or not (new := unwrapped(layer, pattern, decode)):
                continue
            if lo is None:
                lo, hi = np.arange(len(text)), np.arange(1, len(text) + 1)
            starts, ends, at = [], [], 0
            for i, j, d in new[1]:
                starts += [lo[at:i], lo[i + d.starts]]
                ends += [hi[at:i], hi[i + d.ends - 1]]
                at = j
                if d.raw is not None:
                    place = int(lo[i]), int(hi[j - 1])
                    mark = hashlib.blake2b(d.raw + repr(place).encode(), digest_size=16).digest()
                    if mark not in seen:
                        seen.add(mark)
                        work.append(inside(d.raw, *place))
            nlo, nhi = np.concatenate([*starts, lo[at:]]), np.concatenate([*ends, hi[at:]])
            mark = hashlib.blake2b(new[0].encode("utf-8", "surrogatepass") + nlo.tobytes(), digest_size=16).digest()
            if mark in seen:
                continue
            seen.add(mark)
            spans.update((k, int(nlo[i]), int(nhi[j - 1])) for k, i, j in scan(new[0]))
            work.append(iter([(new[0], nlo, nhi)]))
    return ordered(base), ordered(spans)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, counts of the finds in the text as it is, their digest, and all spans."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [all_spans(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([joined(s) for _, s in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, spans], [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
