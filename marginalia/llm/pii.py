"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted within their own format by a keyed
Feistel network, so that equal values get equal pseudonyms in all documents and the key's holder can undo it.

Each kind of value is a finite set with a numbering. A Feistel network over a slightly larger square of numbers, walked until it
lands inside the set again, permutes the set. What validates a value (check digits, the calendar, ranges) holds for its
pseudonym."""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_right
from calendar import monthrange
from collections.abc import Callable, Iterator
from datetime import date
from itertools import accumulate
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import free_name
from marginalia.llm.words import Cache, alone, slices

def rounds_of(size: int) -> int:
    """Rounds of the network: small sets need more of them before the permutation looks like any other."""
    return 10 if size >= 10**9 else 18 if size >= 10**6 else 36


def permute(x: int, size: int, key: bytes, kind: bytes, back: bool = False) -> int:
    """x of 0..size-1 to another number there, one to one."""
    if size < 2:
        return x
    side, rounds = isqrt(size - 1) + 1, rounds_of(size)
    while True:
        left, right = divmod(x, side)
        for i in reversed(range(rounds)) if back else range(rounds):
            if back:
                left, right = (right - _round(left, i, size, key, kind)) % side, left
            else:
                left, right = right, (left + _round(right, i, size, key, kind)) % side
        x = left * side + right
        if x < size:
            return x


def _round(half: int, i: int, size: int, key: bytes, kind: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"%b|%d|%d|%d" % (kind, size, i, half), key=key, digest_size=16).digest(), "big")


def _like(digits: str, model: str) -> str:
    """digits in the places of model's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in model)


def luhn(digits: str) -> bool:
    total = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _card(value: str, go) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 2  # the first digit stays, the last one checks
    body = digits[0] + f"{go(int(digits[1:-1]), 10**n, b'card%d' % n):0{n}d}"
    return _like(body + next(c for c in "0123456789" if luhn(body + c)), value)


def _phone(value: str, go) -> str | None:
    digits = re.sub(r"\D", "", value)
    lead, digits = (digits[:-10], digits[-10:])
    if lead not in ("", "1"):
        return None
    if digits[0] < "2" or digits[3] < "2":
        # no such area or exchange: a number only if written with its country code, and so is its pseudonym
        if value[0] != "+":
            return None
        x = digits
        while (x := f"{go(int(x), 10**10, b'phone+'):010d}") and x[0] >= "2" and x[3] >= "2":
            pass
        return _like(lead + x, value)
    # area and exchange begin with 2 to 9: each is one of 800
    x = ((int(digits[:3]) - 200) * 800 + int(digits[3:6]) - 200) * 10_000 + int(digits[6:])
    x, line = divmod(go(x, 800 * 800 * 10_000, b"phone"), 10_000)
    return _like(lead + f"{x // 800 + 200:03d}{x % 800 + 200:03d}{line:04d}", value)


def _ip(value: str, go) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    # each part keeps its number of digits, so that the address keeps its length
    spans = [(0, 10) if len(p) == 1 else (10, 90) if len(p) == 2 else (100, 156) for p in parts]
    x, size = 0, 1
    for p, (low, n) in zip(parts, spans, strict=True):
        x, size = x * n + int(p) - low, size * n
    x, out = go(x, size, b"ip" + b"".join(b"%d" % len(p) for p in parts)), []
    for low, n in reversed(spans):
        x, r = divmod(x, n)
        out.append(str(r + low))
    return ".".join(reversed(out))


def _ssn(value: str, go) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    area = area - 1 - (area > 666)
    x = go((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"ssn")
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban(value: str, go) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = plain[4:]
    digits = re.sub(r"\D", "", body)
    if not digits:
        return None
    body = _like(f"{go(int(digits), 10 ** len(digits), b'iban%d' % len(digits)):0{len(digits)}d}", body)
    new = plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in value)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


_FIRST_YEAR, _LAST_YEAR = 1900, 2099


@functools.cache
def _late_days() -> list[int]:
    """How many days after the 12th lie before each month of the calendar's range, and in all of it."""
    return list(accumulate([monthrange(_FIRST_YEAR + m // 12, m % 12 + 1)[1] - 12 for m in range(12 * (_LAST_YEAR - _FIRST_YEAR + 1))], initial=0))


def _date(value: str, go) -> str | None:
    """Year first, or day first where that is a date, or else month first. A date that only reads month first has a day after
    the 12th, and so has its pseudonym."""
    a, sep, b, c = re.match(r"(\d+)(\D)(\d+)\D(\d+)", value).groups()
    try:
        found, form = (date(int(a), int(b), int(c)), "ymd") if len(a) == 4 else (date(int(c), int(b), int(a)), "dmy") if int(b) <= 12 else (date(int(c), int(a), int(b)), "mdy")
    except ValueError:
        return None
    if not _FIRST_YEAR <= found.year <= _LAST_YEAR:
        return None
    if form == "mdy":
        month = 12 * (found.year - _FIRST_YEAR) + found.month - 1
        x = go(_late_days()[month] + found.day - 13, _late_days()[-1], b"late")
        month = bisect_right(_late_days(), x) - 1
        found = date(_FIRST_YEAR + month // 12, month % 12 + 1, x - _late_days()[month] + 13)
    else:
        first = date(_FIRST_YEAR, 1, 1).toordinal()
        found = date.fromordinal(go(found.toordinal() - first, date(_LAST_YEAR, 12, 31).toordinal() - first + 1, b"date") + first)
    year, month, day = f"{found.year:04d}", f"{found.month:02d}", f"{found.day:02d}"
    return sep.join({"ymd": (year, month, day), "dmy": (day, month, year), "mdy": (month, day, year)}[form])


def _email(value: str, go) -> str | None:
    """Letters and digits before the @ are permuted among strings of the same pattern."""
    local, _, rest = value.partition("@")
    kinds = [(97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (48, 10) if "0" <= c <= "9" else (ord(c), 1) for c in local]
    x, size = 0, 1
    for c, (low, n) in zip(local, kinds, strict=True):
        x, size = x * n + ord(c) - low, size * n
    x, out = go(x, size, b"email" + "".join("aA0."[(97, 65, 48).index(low) if n > 1 else 3] for low, n in kinds).encode()), []
    for low, n in reversed(kinds):
        x, r = divmod(x, n)
        out.append(chr(low + r))
    return "".join(reversed(out)) + "@" + rest


#: Kinds in the order in which they are tried at a place: what a value looks like, and its permutation.
KINDS: list[tuple[str, str, Callable]] = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_])?@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9])", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ip),
    ("date", r"(?<![0-9/.-])(?:[0-9]{4}([/.-])[0-9]{2}\1[0-9]{2}|[0-9]{2}([/.-])[0-9]{2}\2[0-9]{4})(?![0-9]|[/.-][0-9])", _date),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", _ssn),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[ -][0-9]{4}(?![0-9]))", _card),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])", _phone),
]


def find(text: str) -> Iterator[tuple[int, int, str, Callable]]:
    """Places of valid values from left to right, not overlapping: start, end, kind, its permutation."""
    if _ANY.search(text) is None:
        return
    spans = []
    for order, (kind, pattern, change) in enumerate(_PATTERNS):
        spans += [(m.start(), order, m.end(), kind, change) for m in pattern.finditer(text) if change(m[0], lambda x, *_: x) is not None]
    end = 0
    for start, _, stop, kind, change in sorted(spans, key=lambda s: s[:2]):
        if start >= end:
            yield start, stop, kind, change
            end = stop


_ANY = re.compile(r"[0-9@]")
_PATTERNS = [(kind, re.compile(p), change) for kind, p, change in KINDS]


def pseudonyms(text: str, key: bytes, back: bool = False, cache: Cache | None = None) -> tuple[str, list[str]]:
    """text with its values replaced, and their kinds in order; back undoes it with the same key."""
    out, kinds, at = [], [], 0
    for start, stop, kind, change in find(text):
        value = text[start:stop]
        done = (cache or {}).get((kind, value)) if cache is not None else None
        if done is None:
            done = change(value, lambda x, size, name: permute(x, size, key, name, back))
            if cache is not None:
                cache[kind, value] = done
        out += [text[at:start], done]
        kinds.append(kind)
        at = stop
    return ("".join([*out, text[at:]]) if kinds else text), kinds


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", kinds_col: str | None = "kinds", back: bool = False) -> DataFrame:
    """docs with text_col's values replaced, and (unless kinds_col is None) an array of the kinds found in each text.

    A null text stays null with no kinds, an empty one empty. Texts without a value come back as they were. Rows are treated
    one by one, so ids may be null or repeat, and very long texts are read whole. The key (1 to 64 bytes) is the caller's
    secret: it decides the pseudonyms. If docs has a column of kinds_col's name, the new one begins with an underscore. An empty
    table gives an empty result."""
    if not 1 <= len(key) <= 64:
        raise ValueError("the key must have 1 to 64 bytes")
    kinds_col = free_name(docs, kinds_col)[0] if kinds_col else None
    names, place = docs.columns, docs.columns.index(text_col)
    types = [f.dataType.simpleString() for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        seen = Cache(None, 100_000)
        for b in slices(batches):
            seen.trim()
            done = [(None, []) if t is None else pseudonyms(t, key, back, seen) for t in b.column(place).to_pylist()]
            columns = list(b.columns)
            columns[place] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([k for _, k in done], pa.list_(pa.string()))], [*[f"c{i}" for i in range(len(names))], "found"])

    out = docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, ", ".join([*[f"c{i} {t}" for i, t in enumerate(types)], "found array<string>"]))
    return out.toDF(*names, kinds_col) if kinds_col else out.drop("found").toDF(*names)


#: The key of the registered query, and of a pipeline that is given none; a real run passes its own, as this one is public.
EXAMPLE_KEY = b"example key, to be replaced"


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, EXAMPLE_KEY).select("doc_id", "text", F.size("kinds").cast("long").alias("n_values"), "kinds")
