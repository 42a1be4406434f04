"""Format-preserving pseudonyms: what names a person is permuted by key within its own format.

A value's variable characters are read as one number in mixed radix (10 for a digit, 26 for a letter, and so
on); a Feistel network keyed with BLAKE2 permutes the numbers below the format's size, walking its cycle until
it is inside the size and the format's own check holds again. So a card number stays a card number with a right
check digit, a date stays a date, equal values have equal pseudonyms in all documents (but for a card or IBAN whose pseudonym
would pass its check together with what follows), and who holds the key
can turn them back. Numbers that fail their check (wrong check digit, octet over 255, no such day) stay as they are; phone
numbers have no check but their format.

Kinds: email (all but the last label of its domain), phone, card, iban, ssn, ip, date. A date's pseudonym falls after the twelfth of
its month just if the date does, so that days and months can't be taken for each other and all ways to write a
day have the same pseudonym. The key comes from the caller. Null texts stay null, empty ones
empty; ids and other columns are not read. Repeated rows are treated each; an empty table gives an empty result. Whole texts
are searched, in time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh

#: Where the key is looked for: a setting of the session, then the environment.
KEY_SETTING, KEY_VARIABLE = "spark.tileframe.pseudonyms.key", "TILEFRAME_PSEUDONYMS_KEY"
ROUNDS = 8
FIRST_DAY, DAYS = date(1900, 1, 1), 73049  # to 2099-12-31

#: Fixed value: what each kind looks like; the first that fits at a place wins.
PATTERN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[._%+-]*+(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,})"
    r"|(?<![A-Za-z0-9])(?:"
    r"(?P<iban>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)"
    r"|(?P<phone>(?:\+1[\x20.-]?)?\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|\+1[\x20.-]?[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})"
    r"|(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
    r"|(?P<ip>(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))"
    r"|(?P<card>[0-9](?:[\x20-]?[0-9]){12,18})"
    r")(?(date)(?![A-SU-Za-z0-9]|T(?![0-9]))|(?![A-Za-z0-9]))"
)
#: How many characters an IBAN of a country has.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
MAY_HOLD = re.compile(r"[0-9@]")


@lru_cache(1)
def drawn_key() -> bytes:
    return os.urandom(32)


def key_of(spark: SparkSession) -> bytes:
    """The key that was set; without one a key drawn for this process, so values stay linked in it and nobody can turn
    them back."""
    told = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    return hashlib.blake2b(told.encode()).digest() if told else drawn_key()


def feistel(n: int, size: int, tweak: bytes, key: bytes, back: bool = False) -> int:
    """A keyed permutation of the numbers below size; back undoes it."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = n >> half, n & mask
        for i in range(ROUNDS):
            r = ROUNDS - 1 - i if back else i
            side = a if back else b
            f = int.from_bytes(hashlib.blake2b(tweak + bytes([r]) + side.to_bytes((half + 7) // 8, "big"), key=key, digest_size=max(8, (half + 7) // 8)).digest(), "big") & mask
            a, b = (b ^ f, a) if back else (b, a ^ f)
        n = a << half | b
        if n < size:
            return n


def radices(s: str) -> list[tuple[int, str]]:
    """Radix and first character of each character that varies."""
    return [(10, "0") if "0" <= c <= "9" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (1, c) for c in s]


def permuted(s: str, kind: str, key: bytes, back: bool = False, right: Callable[[str], bool] = lambda s: True) -> str:
    """s with its digits and letters permuted within their classes, walking on until right(result). Case doesn't
    change the permutation of letters."""
    forms = radices(s)
    size = n = 0
    size = 1
    for c, (r, first) in zip(s, forms, strict=True):
        n, size = n * r + (ord(c) - ord(first)), size * r
    if size == 1:
        return s
    tweak = f"{kind}:{''.join('d' if r == 10 else 'l' if r == 26 else f for r, f in forms)}:".encode()
    while True:
        n = m = feistel(n, size, tweak, key, back)
        out = []
        for r, first in reversed(forms):
            m, d = divmod(m, r)
            out.append(chr(ord(first) + d))
        if right(t := "".join(reversed(out))):
            return t


def luhn(digits: str) -> int:
    """The sum that is 0 modulo 10 for a right check digit."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def put(s: str, digits: str) -> str:
    """s with its digits replaced in turn."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in s)


def day_of(s: str) -> tuple[date, str] | None:
    for sign, order in (("-", (0, 1, 2)), ("/", (2, 0, 1)), (".", (2, 1, 0))):
        if sign in s:
            part = [int(x) for x in s.split(sign)]
            orders = [order, (2, 1, 0)] if sign == "/" else [order]
            for o in orders:
                try:
                    d = date(*(part[i] for i in o))
                except ValueError:
                    continue
                if 0 <= (d - FIRST_DAY).days < DAYS:
                    return d, sign.join(("%Y", "%m", "%d")[o.index(i)] for i in range(3))
    return None


@lru_cache(100_000)
def pseudonym(kind: str, s: str, key: bytes, back: bool = False, tails: tuple[str, ...] = ()) -> str | None:
    """The pseudonym of a value, or None if the value fails its kind's check. A card or IBAN doesn't pass its check
    together with any of the tails that follow it, and its pseudonym won't either, so it is found again."""
    digits = re.sub("[^0-9]", "", s)
    if kind == "email":
        local, _, domain = s.partition("@")
        labels, _, top = domain.rpartition(".")
        other = permuted(labels, "domain", key, back)
        return f"{permuted(local, f'{kind}:{(other if back else labels).lower()}', key, back)}@{other}.{top}"
    if kind == "phone":
        body = digits[-10:]
        return put(s, digits[:-10] + permuted(body, kind, key, back))
    if kind == "card":
        if luhn(digits) or len(set(digits)) == 1:
            return None
        whole = lambda b: b + next(c for c in "0123456789" if luhn(b + c) == 0)
        return put(s, whole(permuted(digits[:-1], kind, key, back, lambda b: len(set(whole(b))) > 1 and all(luhn(whole(b) + t) for t in tails))))
    if kind == "iban":
        plain = s.replace(" ", "")
        check = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
        if not 15 <= len(plain) <= 34 or check(plain) != 1:
            return None
        whole = lambda b: plain[:2] + f"{98 - check(plain[:2] + '00' + b):02d}" + b
        new = iter(whole(permuted(plain[4:], kind + plain[:2], key, back, lambda b: all(len(plain + t) > 34 or check(whole(b) + t) != 1 for t in tails))))
        return "".join(c if c == " " else next(new) for c in s)
    if kind == "ssn":
        right = lambda t: t[:3] not in ("000", "666") and t[0] != "9" and t[4:6] != "00" and t[7:] != "0000"
        return permuted(s, kind, key, back, right) if right(s) else None
    if kind == "ip":
        part = s.split(".")
        if any(int(x) > 255 or str(int(x)) != x for x in part):
            return None
        n = feistel(int.from_bytes(map(int, part), "big"), 1 << 32, b"ip:", key, back)
        return ".".join(map(str, n.to_bytes(4, "big")))
    found = day_of(s)
    if not found:
        return None
    day = found[0]
    while True:
        day = FIRST_DAY + timedelta(feistel((day - FIRST_DAY).days, DAYS, b"date:", key, back))
        if (day.day > 12) == (found[0].day > 12):
            return day.strftime(found[1])


def shorter(kind: str, s: str) -> Iterator[tuple[int, tuple[str, ...]]]:
    """Ends of the shorter cards or IBANs that a match of the kind begins with, longest first, each with what the longer
    candidates have after it."""
    ends = [m.end() for m in re.finditer("[A-Za-z0-9]+", s)] if kind in ("card", "iban") else []
    plain = [re.sub("[^A-Za-z0-9]", "", s[:e]) for e in ends]
    most = plain[-1:]
    for e, x in list(zip(ends, plain, strict=True))[-2::-1]:
        if 13 <= len(x) if kind == "card" else 15 <= len(x) and IBAN_LENGTHS.get(x[:2], len(x)) == len(x):
            yield e, tuple(y[len(x) :] for y in most)
            most.append(x)


def replaced(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced, in code points of the text given."""
    if not text or not MAY_HOLD.search(text):
        return text, []
    out, at, spans, look = [], 0, [], 0
    while m := PATTERN.search(text, look):
        kind = m.lastgroup
        value, lo, hi = m[kind], m.start(kind), m.end()
        new = pseudonym(kind, value, key, back)
        for end, tails in shorter(kind, value) if new is None else ():
            if new := pseudonym(kind, value[:end], key, back, tails):
                hi = lo + end
                break
        if new is None:
            # What fails as one kind may hold another: look again behind its first run of letters and digits.
            look = lo + max(1, len(re.match("[A-Za-z0-9]*", value)[0]))
            continue
        out += [text[at:lo], new]
        spans.append((kind, lo, hi))
        at = look = hi
    return "".join(out) + text[at:], spans


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with the text replaced under the key, and its spans 'kind:start:end' of the former text, comma-joined, in a column pii_spans."""
    bounded_batches(docs.sparkSession)
    (name,) = fresh(docs, "pii_spans")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [replaced(t, key) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array([t for t, _ in done], pa.string())
            cols.append(pa.array([",".join(f"{k}:{i}:{j}" for k, i, j in s) for _, s in done], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit("").alias(name)).schema)
