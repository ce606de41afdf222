"""Personal data replaced by format-preserving Feistel pseudonyms.

Numbers and dates are found by pattern and validated (Luhn, mod 97, calendar,
octets). A phone is a number of the North American plan, with or without
separators, or any number written with + and a country code or with its area
code in brackets; the country code stays, and so does whether a number could be
one of that plan. A value is read as a number in the space of all valid
values of its format, moved by a keyed permutation of exactly that space and
written back in its own layout: a card number stays a valid card number with
the same separators, a date a date. The permutation depends on the key and the
format only, so equal values get equal pseudonyms in all documents, different
values different ones, and no value maps to itself. With the key the
replacement can be undone (``restored=True``), so the caller must give one and
keep it; there is no built-in key.

A date of the form 31/12/1999 is read day first, and month first where only
that is a date (12/31/1999). Dates after the 12th move among themselves and so
do the others, so a month-first date stays one and equals its other layouts.
A number with +1 and the same one without it are one number; a number written
without country code is not linked to its form with another country's.

The permutation is an alternating Feistel network on the smallest even number
of bits that holds the space, walked until it falls inside; conjugating a
keyed rotation with it leaves no fixed point.

Edge cases: a null text stays null with no spans; an empty text is unchanged;
values that fail validation are left alone; a space with a single value cannot
move; where patterns overlap the earlier start wins, then the order of
``KINDS``; repeated rows are changed alike; an empty table gives an empty table;
other columns may have any name.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_DIGITS, _LEAD = "0123456789", "23456789"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Permutation:
    """A keyed permutation of 0 .. size - 1 without fixed points (size > 1)."""

    def __init__(self, size: int, tweak: str, key: bytes):
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.seed = hashlib.blake2b(f"{tweak}:{size}".encode(), key=key[:64], digest_size=32).digest()
        self.turn = 1 + int.from_bytes(self.seed[:16], "big") % max(1, size - 1)

    def _round(self, k: int, value: int) -> int:
        raw = hashlib.blake2b(value.to_bytes((self.half + 7) // 8, "big") + bytes([k]), key=self.seed, digest_size=64).digest()
        need = (self.half + 7) // 8
        while len(raw) < need:
            raw += hashlib.blake2b(raw, key=self.seed, digest_size=64).digest()
        return int.from_bytes(raw[:need], "big") & self.mask

    def _walk(self, x: int, back: bool) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._round(k, left), left
                else:
                    left, right = right, left ^ self._round(k, right)
            x = left << self.half | right
            if x < self.size:
                return x

    def move(self, x: int, back: bool = False) -> int:
        if self.size < 2:
            return x
        turn = -self.turn if back else self.turn
        return self._walk((self._walk(x, False) + turn) % self.size, True)


_PERMUTATIONS: dict[tuple[int, str, bytes], Permutation] = {}


def _permutation(size: int, tweak: str, key: bytes) -> Permutation:
    name = (size, tweak, key)
    if name not in _PERMUTATIONS:
        if len(_PERMUTATIONS) >= 4096:
            _PERMUTATIONS.clear()
        _PERMUTATIONS[name] = Permutation(size, tweak, key)
    return _PERMUTATIONS[name]


def moved(symbols: list[int], radices: list[int], tweak: str, key: bytes, back: bool) -> list[int]:
    """A mixed-radix value moved within its space."""
    value, size = 0, 1
    for s, r in zip(symbols, radices, strict=True):
        value, size = value * r + s, size * r
    value = _permutation(size, tweak, key).move(value, back)
    out = []
    for r in reversed(radices):
        value, s = divmod(value, r)
        out.append(s)
    return out[::-1]


def moved_text(text: str, alphabets: list[str], tweak: str, key: bytes, back: bool) -> str:
    """Characters moved within their alphabets; an empty alphabet leaves its character alone."""
    at = [i for i, a in enumerate(alphabets) if a]
    new = moved([alphabets[i].index(text[i]) for i in at], [len(alphabets[i]) for i in at], tweak, key, back)
    chars = list(text)
    for i, s in zip(at, new, strict=True):
        chars[i] = alphabets[i][s]
    return "".join(chars)


def _with_digits(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn_digit(body: str) -> str:
    """The check digit after ``body``."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    size = len(digits) - 1
    body = digits[:-1]
    while True:  # a number of one repeated digit is no card: walk on
        body = moved_text(body, [_DIGITS] * size, f"card{size}", key, back)
        whole = body + luhn_digit(body)
        if len(set(whole)) > 1:
            return _with_digits(text, whole)


def phone(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    head, ten = digits[:-10], digits[-10:]
    return _with_digits(text, head + moved_text(ten, [_LEAD, _DIGITS, _DIGITS, _LEAD, *[_DIGITS] * 6], "phone", key, back))


_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
                        "81 82 84 86 90 91 92 93 94 95 98".split())  # country codes; 1 and 7 have one digit, others three


def any_phone(text: str, key: bytes, back: bool) -> str | None:
    """A number with country code or bracketed area code; the classes of its first and fourth digit stay."""
    digits = re.sub(r"\D", "", text)
    head = 0 if text[0] != "+" else 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGITS else 3
    country, rest = digits[:head], digits[head:]
    alphabets = [_DIGITS] * len(rest)
    alphabets[0] = _LEAD if rest[0] in _LEAD else rest[0]
    alphabets[3] = _LEAD if rest[3] in _LEAD else "01"
    # +1 adds nothing to a number of that plan.
    tweak = "phone" if country in ("", "1") else f"phone{country}"
    return _with_digits(text, country + moved_text(rest, alphabets, tweak, key, back))


def ip(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    octets = [int(p) for p in parts]
    if 1 <= octets[0] <= 223:  # hosts stay hosts
        new = moved([octets[0] - 1, *octets[1:]], [223, 256, 256, 256], "host", key, back)
        return ".".join(map(str, [new[0] + 1, *new[1:]]))
    return ".".join(map(str, [octets[0], *moved(octets[1:], [256] * 3, f"net{octets[0]}", key, back)]))


_FIRST, _LAST = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
_MIDDLE = 12  # later days are no months
_MONTHS = [dt.date(y, m, 1) for y in range(_FIRST.year, _LAST.year + 1) for m in range(1, 13)]
# Dates after the 12th before each month.
_LATE = [0]
for _month in _MONTHS:
    _LATE.append(_LATE[-1] + ((_month + dt.timedelta(days=31)).replace(day=1) - _month).days - _MIDDLE)


def _moved_date(day: dt.date, key: bytes, back: bool) -> dt.date:
    """A date moved among those after the 12th or among the others."""
    month = (day.year - _FIRST.year) * 12 + day.month - 1
    if day.day <= _MIDDLE:
        [new] = moved([month * _MIDDLE + day.day - 1], [len(_MONTHS) * _MIDDLE], "date", key, back)
        return _MONTHS[new // _MIDDLE].replace(day=new % _MIDDLE + 1)
    [new] = moved([_LATE[month] + day.day - _MIDDLE - 1], [_LATE[-1]], "late date", key, back)
    month = bisect_right(_LATE, new) - 1
    return _MONTHS[month].replace(day=new - _LATE[month] + _MIDDLE + 1)


def date(text: str, key: bytes, back: bool) -> str | None:
    sep = text[4] if text[4] in "-/." else text[2]
    for order in (("%Y", "%m", "%d"),) if text[4] == sep else (("%d", "%m", "%Y"), ("%m", "%d", "%Y")):
        try:
            day = dt.datetime.strptime(text, sep.join(order)).date()
        except ValueError:
            continue
        return _moved_date(day, key, back).strftime(sep.join(order)) if _FIRST <= day <= _LAST else None
    return None


def ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    areas = [a for a in range(1, 900) if a != 666]
    if area not in areas or not group or not serial:
        return None
    a, g, s = moved([areas.index(area), group - 1, serial - 1], [len(areas), 99, 9999], "ssn", key, back)
    return f"{areas[a]:03d}-{g + 1:02d}-{s + 1:04d}"


def _mod97(country: str, check: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def iban(text: str, key: bytes, back: bool) -> str | None:
    flat = text.replace(" ", "")
    country, check, body = flat[:2], flat[2:4], flat[4:]
    if not 15 <= len(flat) <= 34 or _mod97(country, check, body) != 1:
        return None
    layout = ["0" if c.isdigit() else "A" for c in body]
    body = moved_text(body, [_DIGITS if c == "0" else _UPPER for c in layout], f"iban{country}{''.join(layout)}", key, back)
    flat = country + f"{98 - _mod97(country, '00', body):02d}" + body
    it = iter(flat)
    return "".join(c if c == " " else next(it) for c in text)


def email(text: str, key: bytes, back: bool) -> str | None:
    """Letters and digits of the local part; its other characters and the domain stay."""
    local, _, domain = text.rpartition("@")
    alphabets = [_LOWER if "a" <= c <= "z" else _UPPER if "A" <= c <= "Z" else _DIGITS if "0" <= c <= "9" else "" for c in local]
    layout = "".join(a[:1] or c for a, c in zip(alphabets, local, strict=True))
    return moved_text(local, alphabets, f"email{layout}@{domain.lower()}", key, back) + "@" + domain


Mover = Callable[[str, bytes, bool], "str | None"]
# A further digit of a phone; a space before a card, address or date ends the phone.
_OTHER = (r"[0-9]{13}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}(?![0-9]| [0-9]{4})|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
          r"|(?:[0-9]{1,3}\.){3}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}[/-][0-9]{2}[/-][0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}")
_NEXT = r"(?:[./-]|[ ](?!" + _OTHER + r"))?\(?[0-9]\)?"
KINDS: tuple[tuple[str, str, Mover], ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("date", r"(?<![0-9.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}([/.-])[0-9]{2}\1[0-9]{4})(?![0-9])", date),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", ip),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ssn),
    ("phone", r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])", phone),
    ("phone", r"(?<![0-9A-Za-z+])\+(?:1(?:" + _NEXT + r"){10}(?![0-9])|[2-9](?:" + _NEXT + r"){6,14}(?![0-9A-Za-z]|[./-][0-9]))", any_phone),
    ("phone", r"(?<![0-9A-Za-z])\((?:[0-9]{2,3}|0[0-9]{3,4})\)(?:" + _NEXT + r"){6,8}(?![0-9A-Za-z]|[./-][0-9])", any_phone),
    ("phone", r"(?<![0-9A-Za-z.+-])[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z]|[.-][0-9])", phone),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])", card),
)
# Numbers lie in runs of these characters; the number patterns are tried on such runs only.
_RUN = re.compile(r"[0-9][0-9()+./ -]{5,}[0-9]")
_PATTERNS = [(n, kind, re.compile(pattern), move) for n, (kind, pattern, move) in enumerate(KINDS)]


def found(text: str, key: bytes, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of every validated value, in order and without overlap."""
    places: list[tuple[int, int]] = [(max(0, m.start() - 4), m.end()) for m in _RUN.finditer(text)]
    hits = []
    for rank, kind, pattern, move in _PATTERNS:
        if kind == "email":
            regions = [(0, len(text))] if "@" in text else []
        elif kind == "iban":
            regions = [(0, len(text))] if places else []
        else:
            regions = places
        for a, b in regions:
            for m in pattern.finditer(text, a, min(len(text), b + 2)):
                new = move(m.group(), key, back)
                if new is not None:
                    hits.append((m.start(), rank, m.end(), kind, new))
    out, end = [], 0
    for start, _, stop, kind, new in sorted(set(hits)):
        if start >= end:
            out.append((start, stop, kind, new))
            end = stop
    return out


def replaced(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for start, end, _, new in spans:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


_DDL = "struct<text: string, spans: array<struct<start: int, end: int, kind: string>>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
_KIND = pa.struct([("text", pa.string()), ("spans", pa.list_(_SPAN))])


def _rewriter(key: bytes, back: bool):
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            text = value.as_py()
            spans = found(text, key, back) if text else []
            out.append({"text": replaced(text, spans) if spans else text,
                        "spans": [{"start": a, "end": b, "kind": k} for a, b, k, _ in spans]})
        return pa.array(out, _KIND)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _DDL)


def pseudonymized(docs: DataFrame, key: bytes, text: str = "text", restored: bool = False) -> DataFrame:
    """``docs`` with ``text`` rewritten under the ``key`` and ``__spans``: (start, end, kind) in code points of the text before."""
    return (docs.withColumn("__new", _rewriter(key, restored)(F.col(text)))
            .withColumn(text, F.col("__new.text")).withColumn("__spans", F.col("__new.spans")).drop("__new"))
