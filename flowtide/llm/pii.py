"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Each value that passes its check (a card's Luhn digit, a calendar date, an IBAN's remainder, an
address's four bytes, ...) is mapped by a keyed Feistel permutation of all valid values of its
kind and length, and written in the format in which it stood. Equal values get equal pseudonyms
in every document, whatever their punctuation; different values never meet in one. With the key
the permutation can be undone: where a pseudonym would be read otherwise than its value, as the
start of a longer number that passes its check, it is permuted again. A date after the 12th of a
month stays one, so that the order of day and month can be told.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from hashlib import blake2b
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtide.llm.textbytes import text_bytes

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
#: days up to the 12th of a month, which may be read as a month, and later ones
_EARLY, _LATE = ([d for d in range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1) if (date.fromordinal(d).day > 12) == late] for late in (False, True))

KINDS = ["card", "iban", "ssn", "ip", "phone", "date", "email"]
_RESULT = f"struct<text:string,{','.join(f'n_{k}:bigint' for k in KINDS)}>"


class Permutation:
    """A keyed permutation of 0 .. size - 1: Feistel rounds over two halves, walked until inside."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        # two near-equal factors whose product holds all values
        self.low = isqrt(size)
        self.high = -(-size // self.low)
        self.key = blake2b(key, digest_size=32).digest()
        self.tweak = f"{tweak}:{size}:".encode()

    def _round(self, k: int, half: int, modulus: int) -> int:
        digest = blake2b(self.tweak + f"{k}:{half}".encode(), key=self.key, digest_size=24).digest()
        return int.from_bytes(digest, "big") % modulus

    def _once(self, value: int) -> int:
        a, b = divmod(value, self.low)
        for k in range(0, ROUNDS, 2):
            a = (a + self._round(k, b, self.high)) % self.high
            b = (b + self._round(k + 1, a, self.low)) % self.low
        return a * self.low + b

    def _back(self, value: int) -> int:
        a, b = divmod(value, self.low)
        for k in reversed(range(0, ROUNDS, 2)):
            b = (b - self._round(k + 1, a, self.low)) % self.low
            a = (a - self._round(k, b, self.high)) % self.high
        return a * self.low + b

    def __call__(self, value: int, undo: bool = False) -> int:
        step = self._back if undo else self._once
        value = step(value)
        while value >= self.size:
            value = step(value)
        return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows these digits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    """The two check digits of an IBAN."""
    number = "".join(str(int(c, 36)) for c in account + country) + "00"
    return f"{98 - int(number) % 97:02d}"


def _refill(shape: str, symbols: str, keep: Callable[[str], bool]) -> str:
    """`shape` with the characters that `keep` names replaced by `symbols` in order."""
    it = iter(symbols)
    return "".join(next(it) if keep(c) else c for c in shape)


@dataclass
class Pseudonymiser:
    """Finds, checks and replaces; `undo` inverts what was made with the same key."""

    key: bytes
    undo: bool = False

    def __post_init__(self) -> None:
        self._made: dict[tuple[str, int], Permutation] = {}

    def _permute(self, kind: str, value: int, size: int) -> int:
        if (kind, size) not in self._made:
            self._made[kind, size] = Permutation(self.key, kind, size)
        return self._made[kind, size](value, self.undo)

    def _digits(self, kind: str, digits: str) -> str:
        return str(self._permute(kind, int(digits), 10 ** len(digits))).zfill(len(digits))

    def card(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        body = self._digits("card", digits[:-1])
        return _refill(m[0], body + luhn_digit(body), str.isdigit)

    def iban(self, m: re.Match) -> str | None:
        plain = m[0].replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or iban_check(country, account) != check:
            return None
        digits = re.sub(r"\D", "", account)
        account = _refill(account, self._digits("iban", digits), str.isdigit) if digits else account
        return _refill(m[0], country + iban_check(country, account) + account, str.isalnum)

    def ssn(self, m: re.Match) -> str | None:
        area, group, serial = (int(x) for x in m[0].split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        rank = area - 1 - (area > 666)
        value = self._permute("ssn", (rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
        rest, serial = divmod(value, 9999)
        rank, group = divmod(rest, 99)
        return f"{rank + 1 + (rank >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def ip(self, m: re.Match) -> str | None:
        parts = m[0].split(".")
        if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
            return None
        value = 0
        for x in parts:
            value = value * 256 + int(x)
        value = self._permute("ip", value, 1 << 32)
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))

    def phone(self, m: re.Match) -> str | None:
        number = m["number"]
        digits = re.sub(r"\D", "", number)
        if not 7 <= len(digits) <= 12:
            return None
        at = m.start("number") - m.start()
        return m[0][:at] + _refill(number, self._digits("phone", digits), str.isdigit)

    def date(self, m: re.Match) -> str | None:
        part = m["sep"] or m["sep2"]
        fields = [int(x) for x in m[0].split(part)]
        # year, month and day among the fields; day before month where both can be
        for order in [(0, 1, 2)] if m["sep"] else [(2, 1, 0), (2, 0, 1)]:
            try:
                day = date(*(fields[k] for k in order))
            except ValueError:
                continue
            if not FIRST_DAY <= day <= LAST_DAY:
                continue
            days = _LATE if day.day > 12 else _EARLY
            new = date.fromordinal(days[self._permute("date", bisect_left(days, day.toordinal()), len(days))])
            out = [""] * 3
            for k, x in zip(order, (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")):
                out[k] = x
            return part.join(out)
        return None

    def email(self, m: re.Match) -> str | None:
        local, domain = m[0].split("@")
        # letters and digits change among letters and digits of the local part's own shape
        value, size = 0, 1
        for c in local.lower():
            if c.isdigit():
                value, size = value * 10 + int(c), size * 10
            elif c.isalpha():
                value, size = value * 26 + ord(c) - 97, size * 26
        if size == 1:
            return None
        shape = re.sub("[A-Za-z]", "a", re.sub(r"\d", "0", local))
        value = self._permute(f"email:{shape}", value, size)
        out = []
        for c in reversed(shape):
            if c in "0a":
                value, x = divmod(value, 10 if c == "0" else 26)
                out.append(str(x) if c == "0" else chr(97 + x))
            else:
                out.append(c)
        return "".join(reversed(out)) + "@" + domain

    def _first(self, text: str, start: int) -> tuple[str, re.Match, str, bool] | None:
        """Kind, match and replacement of the first value from `start` on, and whether a match that fails reaches into it."""
        failed_end = 0
        while found := _FIND.search(text, start):
            start = found.start()
            for kind, m in _readings(text, start):
                new = getattr(self, kind)(m)
                if new is not None:
                    return kind, m, new, failed_end > start
                failed_end = max(failed_end, m.end())
            start += 1
        return None

    def replace(self, text: str) -> tuple[str, list[int]]:
        counts = dict.fromkeys(KINDS, 0)
        out, done = [], 0
        while found := self._first(text, done):
            kind, m, new, doubtful = found
            # undoing must find the same value here
            while doubtful and len(new) == len(m[0]):
                changed = text[: m.start()] + new + text[m.end() :]
                again = self._first(changed, done)
                if again[0] == kind and again[1].span() == m.span():
                    break
                new = getattr(self, kind)(m.re.fullmatch(changed, m.start(), m.end()))
            counts[kind] += 1
            out += [text[done : m.start()], new]
            done = m.end()
        return "".join([*out, text[done:]]), [counts[k] for k in KINDS]


#: fixed values: the formats of each kind, tried in this order at each place
_FORMATS = [
    ("email", r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"),
    ("date", r"(?<![\d./-])(?:\d{4}(?P<sep>[-/.])\d{2}(?P=sep)\d{2}|\d{2}(?P<sep2>[-/.])\d{2}(?P=sep2)\d{4})(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?:\+\d{1,3}[ .-]?|(?<![\d(])(?=\())(?P<number>\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4})(?!\d)"),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d])"),
    ("phone", r"\+\d{1,3}[ .-](?P<number>\d{1,4}(?:[ .-]\d{2,4}){2,5})(?!\d)"),
    ("phone", r"(?<![\w.+-])(?P<number>\d{3}(?P<psep>[ .-])\d{3}(?P=psep)\d{4})(?![\w-]|\.\d)"),
]
_READ = [(kind, re.compile(pattern)) for kind, pattern in _FORMATS]
# one pattern for all: names are per format
_FIND = re.compile("|".join(re.sub(r"\(\?P(<|=)(\w+)", rf"(?P\g<1>\g<2>_{k}", pattern) for k, (_, pattern) in enumerate(_FORMATS)))


def _readings(text: str, start: int) -> Iterator[tuple[str, re.Match]]:
    """All formats that match from `start` on; cards, IBANs and phones also without their last groups."""
    for kind, pattern in _READ:
        m = pattern.match(text, start)
        if m is None:
            continue
        yield kind, m
        if kind in ("card", "iban", "phone"):
            for end in range(m.end() - 1, start, -1):
                if text[end] in " .-" and (part := pattern.fullmatch(text, start, end)):
                    yield kind, part


_SPARKS = np.zeros(256, bool)
_SPARKS[[*range(0x30, 0x3A), 0x40]] = True


def _pseudonymise(key: bytes, undo: bool):
    def replace(texts: pa.Array) -> pa.Array:
        worker = Pseudonymiser(key, undo)
        # only texts with a digit or an @ can hold any of the formats
        data, offsets = text_bytes(texts)
        seen = np.concatenate([[0], np.cumsum(_SPARKS[data], dtype=np.int64)]) if len(data) else np.zeros(1, np.int64)
        some = seen[offsets[1:]] > seen[offsets[:-1]]
        out, counts = texts.to_pylist(), np.zeros((len(texts), len(KINDS)), np.int64)
        for k in np.flatnonzero(some).tolist():
            out[k], counts[k] = worker.replace(out[k])
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), *map(pa.array, counts.T)], names=["text", *(f"n_{k}" for k in KINDS)])

    return replace


def pseudonyms(text: Column, key: bytes, undo: bool = False) -> Column:
    """`text` with all values replaced (null stays null), and how many of each kind (`n_card`, ...).

    `undo` turns pseudonyms made with the same key back. The key must be kept secret and comes
    from the caller; whoever has it can undo the pseudonyms.
    """
    return F.arrow_udf(_pseudonymise(key, undo), _RESULT)(text)


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """`docs` with the text column pseudonymised; other columns unchanged."""
    return docs.withColumn(text_col, pseudonyms(F.col(text_col), key)["text"])
