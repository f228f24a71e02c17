"""Format-preserving Feistel pseudonyms for personal numbers, dates and addresses.

A value that passes its own validation (calendar, checksum, ranges) is read as a
number in the set of all values of its format, permuted there under a secret key, and
written back in the same format and length.  Equal values get equal pseudonyms in all
documents, the pseudonym is valid in its turn, and the key turns it back.

The permutation is a Feistel network on the bits of the set's size, repeated until it
falls inside the set, and used as ``P^-1(P(x) + 1)``: a keyed cycle through the whole
set, so no value is its own pseudonym.

A pseudonym depends on kind, value and key alone, never on the text around it.  So where a
value ends is settled first, by rules that look at nothing behind that end: an IBAN has its
country's length; a card ends with its grouping, or else at the first group border that
validates (cards begin with four digits together and have one kind of separator); a phone at the border where its country's number is complete, or else at the first
with eight digits behind the country code (none: the last).  In an odd grouping the
pseudonym is taken further along its cycle until none of its own earlier borders validates, so
that it is found at the same end and the key turns it back.  Digits behind a plus sign are a
phone, or a card if 16 and more stand together; a search that finds nothing goes on one
character later.

These notations of a value are linked: a date in all its forms (it is permuted among the dates
that can be written in the same forms: days up to 9, 10 to 12 or above, months up to 9 or
above, years of 1930 to 2029 or others); cards, IBANs and phones with and without separators, and
North American phones with and without +1 or 1.  Not linked: cards in odd groupings whose earlier borders validate,
emails that differ in case, and dates with slashes that could be read either way, which are day first.

Forms that are looked for: emails (the last character before the @ a letter, digit or one of
_%+-); secrets of 12 to 512 characters with a digit behind a keyword and : or =, in quotes, or
without them up to white space or one of "'<>,;&; dates as year-month-day or with the year
last, apart by - / or ., days and months of one or two digits, years of four.  Two-digit years are
read as 1930 to 2029, with days and months of two digits, or of one with slashes.  Left out are
dates with month names, with a two-digit year first, with dots or hyphens and one-digit
parts before a two-digit year (version numbers), or with more numbers joined to a short form;
secrets without a keyword, with white space or without a digit; unquoted URLs behind a keyword;
IBANs in small letters; and IPv6 addresses.

Null texts stay null and empty texts empty; texts without such values are unchanged
to the byte.  Repeated rows are treated alike; an empty table gives an empty table;
other columns are carried in one struct, whatever their names.
"""
from __future__ import annotations

import bisect
import functools
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ragged
from .common import _quoted, prepare

ROUNDS = 8
KEY_SETTING = "spark.fleetwatch.pii.key"
#: Values whose pseudonyms a worker remembers.
CACHE = 1 << 16

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
HEX = "0123456789abcdef"


_drawn: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The secret key of the session's settings; without one, a random key for this application,
    which links values within it and is forgotten with it."""
    known = spark.conf.get(KEY_SETTING, None)
    if known:
        return known.encode("utf-8")
    return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


class Cycle:
    """Keyed permutations without fixed points of 0 .. size-1."""

    def __init__(self, key: bytes):
        self.key = key

    def _half(self, kind: bytes, r: int, value: int, bits: int) -> int:
        n = -(-bits // 8)
        raw = hashlib.shake_256(b"%d|%b|%d|%d|" % (len(self.key), self.key, r, bits) + kind + b"|%x" % value).digest(n)
        return int.from_bytes(raw, "big") & ((1 << bits) - 1)

    def _network(self, kind: bytes, x: int, size: int, back: bool) -> int:
        bits = max(2, (size - 1).bit_length())
        low = bits // 2
        while True:
            a, b = x >> low, x & ((1 << low) - 1)
            for r in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)):
                if r % 2:
                    b ^= self._half(kind, r, a, low)
                else:
                    a ^= self._half(kind, r, b, bits - low)
            x = a << low | b
            if x < size:
                return x

    def step(self, kind: str, x: int, size: int, back: bool = False) -> int:
        if size < 2:
            return x
        tweak = b"%b/%x" % (kind.encode("utf-8"), size)
        y = (self._network(tweak, x, size, False) + (-1 if back else 1)) % size
        return self._network(tweak, y, size, True)


def _mixed(cycle: Cycle, kind: str, value: str, alphabets: list[str], back: bool) -> str:
    """Permute characters, each within its alphabet ("": fixed)."""
    x, size = 0, 1
    for c, a in zip(value, alphabets, strict=True):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    x = cycle.step(kind, x, size, back)
    out = []
    for c, a in zip(reversed(value), reversed(alphabets), strict=True):
        if a:
            x, k = divmod(x, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


def _classes(value: str) -> list[str]:
    return [DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else "" for c in value]


def _into(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, one after the other."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in shape)


def luhn(digits: str) -> int:
    """The check digit for these digits."""
    total = sum(d if k % 2 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(map(int, reversed(digits))))
    return -total % 10


# Each handler gets the match, the permutation and the direction, and gives the
# pseudonym, or None if the value doesn't validate.

def _card(m: re.Match, cycle: Cycle, back: bool) -> str | None:
    d = "".join(c for c in m[0] if c in DIGITS)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or d[0] == "0":
        return None
    if not m[0][:4].isdigit() or " " in m[0] and "-" in m[0]:  # other numbers side by side
        return None
    body = d[0] + _mixed(cycle, "card" + d[0], d[1:-1], [DIGITS] * (len(d) - 2), back)
    return _into(m[0], body + str(luhn(body)))


def _ssn(m: re.Match, cycle: Cycle, back: bool) -> str | None:
    area, group, serial = map(int, m.groups())
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = area - 1 - (area > 666)
    x = cycle.step("ssn", (areas * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, back)
    x, serial = divmod(x, 9999)
    areas, group = divmod(x, 99)
    return f"{areas + 1 + (areas >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(m: re.Match, cycle: Cycle, back: bool) -> str | None:
    octets = m[0].split(".")
    if any(int(o) > 255 or len(o) > 1 and o[0] == "0" for o in octets):
        return None
    low, count = zip(*[((0, 10), (10, 90), (100, 156))[len(o) - 1] for o in octets], strict=True)
    x, size = 0, 1
    for o, a, n in zip(octets, low, count, strict=True):
        x, size = x * n + int(o) - a, size * n
    x, out = cycle.step("ip" + ".".join(str(len(o)) for o in octets), x, size, back), []
    for a, n in zip(reversed(low), reversed(count), strict=True):
        x, k = divmod(x, n)
        out.append(str(k + a))
    return ".".join(reversed(out))


FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _forms(day: date) -> tuple[int, bool, bool]:
    """What decides in which notations a date can be written: its day, month and year."""
    return (day.day > 9) + (day.day > 12), day.month > 9, 1930 <= day.year < 2030


@functools.cache
def _alike() -> dict[tuple, tuple[list[int], dict[int, int]]]:
    """By ``_forms``, the dates from 1900 to 2099 in order, and the place of each."""
    groups: dict[tuple, list[int]] = {}
    for k in range(DAYS):
        groups.setdefault(_forms(FIRST_DAY + timedelta(k)), []).append(k)
    return {f: (days, {d: k for k, d in enumerate(days)}) for f, days in groups.items()}


def _date(m: re.Match, cycle: Cycle, back: bool) -> str | None:
    """One permutation of the days for all notations.  With slashes the day comes first
    where that is possible, else the month."""
    a, s, b, c = (m[k] or m[k + 4] for k in (1, 2, 3, 4))
    for how in ("ymd",) if len(a) == 4 else ("dmy", "mdy") if s == "/" else ("dmy",):
        parts, width = dict(zip(how, map(int, (a, b, c)), strict=True)), dict(zip(how, map(len, (a, b, c)), strict=True))
        if width["y"] == 2:
            parts["y"] += 1900 if parts["y"] >= 30 else 2000
        try:
            day = date(parts["y"], parts["m"], parts["d"])
        except ValueError:
            continue
        number = (day - FIRST_DAY).days
        if not 0 <= number < DAYS:
            return None
        days, place = _alike()[_forms(day)]
        new = FIRST_DAY + timedelta(days[cycle.step("date%d%d%d" % _forms(day), place[number], len(days), back)])
        shown = {"y": new.year % 10 ** width["y"], "m": new.month, "d": new.day}
        return s.join(f"{shown[k]:0{width[k]}d}" for k in how)
    return None


def _dialled(n: str) -> bool:
    """Ten digits that the North American plan can assign."""
    return n[0] not in "01" and n[3] not in "01"


#: Country codes of two digits; those beginning with 1 or 7 have one, the others three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Digits behind the country code, where all of a country's numbers have as many.
NUMBER_SIZES = {c: n for n, cs in {8: "45 47 65 852", 9: "27 31 33 34 40 41 48 56 61 351 380 420 421 966", 10: "1 7 30 44 52 57 58 63 90 91 92 98"}.items() for c in cs.split()}
LEAST_NUMBER = 8


def _country(digits: str) -> str:
    return digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def _phone(m: re.Match, cycle: Cycle, back: bool) -> str | None:
    d = "".join(c for c in m[0] if c in DIGITS)
    if m[0].startswith("+") and not (d[0] == "1" and len(d) == 11):
        if not 8 <= len(d) <= 15 or d[0] == "0":
            return None
        k = len(_country(d))
        return _into(m[0], d[:k] + _mixed(cycle, "phone" + d[:k], d[k:], [DIGITS] * (len(d) - k), back))
    lead, n = d[:-10], d[-10:]
    if lead not in ("", "1") or not _dialled(n) and not m[0].startswith("+"):
        return None
    if _dialled(n):
        new = _mixed(cycle, "phone1", n, ["23456789" if k in (0, 3) else DIGITS for k in range(10)], back)
    else:  # stay among the numbers outside the plan
        new = _mixed(cycle, "phone1 other", n, [DIGITS] * 10, back)
        while _dialled(new):
            new = _mixed(cycle, "phone1 other", new, [DIGITS] * 10, back)
    return _into(m[0], lead + new)


def _iban(m: re.Match, cycle: Cycle, back: bool) -> str | None:
    v = m[0].replace(" ", "")

    def rest(x: str) -> int:
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97

    if not 15 <= len(v) <= 34 or rest(v) != 1:
        return None
    body = _mixed(cycle, "iban" + v[:2], v[4:], _classes(v[4:]), back)
    new = iter(v[:2] + f"{98 - rest(v[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(new) for c in m[0])


#: Characters of an IBAN by country.
IBAN_SIZES = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN", 21: "HR LV LI CH",
    22: "BH BG CR GE DE IE ME RS GB VA", 23: "TL GI IQ IL OM SO AE", 24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MR MC SM", 28: "AL AZ BY CY DO SV GT HU LB NI PL", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
#: How cards are grouped: not at all, 4-4-4-4, 4-6-5, 4-6-4.
GROUPED = re.compile(r"[0-9]{13,19}(?![0-9])|[0-9]{4}([ \-])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{6}\1[0-9]{4,5})(?![0-9])")


def _ends(kind: str, value: str) -> list[int]:
    """Where in a match the value may end; the first end that validates is taken."""
    if kind not in ("iban", "card", "phone"):
        return [len(value)]
    borders = [*(k for k in range(1, len(value)) if value[k - 1].isalnum() and not value[k].isalnum()), len(value)]
    if kind == "iban":
        size = IBAN_SIZES.get(value[:2])
        return [e for e in borders if size is None or e - value.count(" ", 0, e) == size]
    if kind == "card":
        known = GROUPED.match(value)
        return list(dict.fromkeys([*([known.end()] if known else []), *borders]))
    if not value.startswith("+"):
        return [len(value)]
    digits = "".join(c for c in value if c in DIGITS)
    code = _country(digits)
    number = {e: sum(c in DIGITS for c in value[:e]) - len(code) for e in borders}
    whole = [e for e in borders if number[e] == NUMBER_SIZES.get(code)] or [e for e in borders if number[e] >= LEAST_NUMBER]
    return [*whole, borders[-1]][:1]


def _email(m: re.Match, cycle: Cycle, back: bool) -> str | None:
    local, domain = m[0].rsplit("@", 1)
    if not any(_classes(local)):
        return None
    return _mixed(cycle, "email" + domain.lower(), local, _classes(local), back) + "@" + domain


def _secret(m: re.Match, cycle: Cycle, back: bool) -> str | None:
    v = m[2]

    def form(x: str) -> tuple[bool, bool, bool]:
        return all(c in HEX for c in x), any(c in DIGITS for c in x), any(c in LOWER + UPPER for c in x)

    alphabets = [HEX] * len(v) if form(v)[0] else _classes(v)
    if not form(v)[1] or sum(map(bool, alphabets)) < 12:
        return None
    new = _mixed(cycle, "secret", v, alphabets, back)
    while form(new) != form(v):
        new = _mixed(cycle, "secret", new, alphabets, back)
    return m[1] + new


def _open_secret(m: re.Match, cycle: Cycle, back: bool) -> str | None:
    """Without quotes; digits alone are left to the other kinds first."""
    return _secret(m, cycle, back) if any(c in LOWER + UPPER for c in m[2]) else None


_OPEN = re.compile(r"""(?i:((?:token|secret|password|passwd|api_?key|access_?key|key)["']?\s{0,3}[:=]\s{0,3}))(?![A-Za-z]+://)([^\s"'<>,;&@]{12,512})(?![^\s"'<>,;&])""")
Handler = Callable[[re.Match, Cycle, bool], str | None]
#: Kind, what to look for, handler; where matches overlap, the earlier kind is taken.
KINDS: list[tuple[str, re.Pattern, Handler]] = [
    ("email", re.compile(r"[\w.%+\-]{0,63}[\w%+\-]@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"), _email),
    ("secret", re.compile(r"""(?i:((?:token|secret|password|passwd|api_?key|access_?key|key)["']?\s{0,3}[:=]\s{0,3}["']))([A-Za-z0-9+/_=\-]{12,512})(?=["'])"""), _secret),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), _iban),
    ("secret", _OPEN, _open_secret),
    ("card", re.compile(r"(?<![0-9+])(?<![0-9][ .\-])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"), _card),
    ("card", re.compile(r"(?<![0-9])(?:(?<!\+)[0-9]{13,15}|[0-9]{16,19})(?![0-9])"), _card),
    ("card", re.compile(r"(?<![0-9+])[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"), _card),
    ("card", re.compile(r"(?<![0-9+])[0-9]{4}([ \-])[0-9]{6}\1[0-9]{4,5}(?![0-9])"), _card),
    ("ssn", re.compile(r"(?<![0-9\-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9\-])"), _ssn),
    ("ip", re.compile(r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"), _ip),
    ("date", re.compile(r"(?<![0-9])(?:([0-9]{4})([\-/.])([0-9]{2})\2([0-9]{2})|([0-9]{2})([\-/.])([0-9]{2})\6([0-9]{4}))(?![0-9])"), _date),
    ("phone", re.compile(r"\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])"), _phone),
    ("phone", re.compile(r"\+(?!1[^0-9])[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{1,5}(?:[ .\-]?[0-9]{2,5}){1,5}(?![0-9])"), _phone),
    ("phone", re.compile(r"(?<![0-9+])(?:1[ .\-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])"), _phone),
    ("date", re.compile(r"(?<![0-9])(?<![0-9][\-/.])(?:([0-9]{4})([\-/.])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([\-/.])([0-9]{1,2})\6"
                        r"([0-9]{4}|(?:(?<=/)|(?<=[0-9]{2}[\-.][0-9]{2}[\-.]))[0-9]{2}))(?![\-/.]?[0-9])"), _date),
    ("secret", _OPEN, _secret),
]
#: Texts without a match of this have none of the kinds.
CANDIDATE = r"@|[0-9][ .()/\-]*[0-9]|(?i:token|secret|passw|key)"


class Pseudonyms:
    def __init__(self, key: bytes):
        self.cycle, self.cache = Cycle(key), {}

    def find(self, text: str, back: bool = False) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of the validated values, in order of place."""
        found: list[tuple[int, int, str, str]] = []
        for kind, pattern, handler in KINDS:
            if kind == "email" and "@" not in text:
                continue
            at = 0
            while m := pattern.search(text, at):
                a, k = m.start(), bisect.bisect_right(found, m.start(), key=lambda f: f[0])
                if k and found[k - 1][1] > a:
                    at = found[k - 1][1]
                    continue
                free = (found[k][0] if k < len(found) else len(text)) - a
                size, new = self._value(kind, pattern, handler, m, free, back)
                if new:
                    found.insert(k, (a, a + size, kind, new))
                at = a + size if new else a + 1
        return found

    def _value(self, kind: str, pattern: re.Pattern, handler: Handler, m: re.Match, free: int, back: bool) -> tuple[int, str]:
        """Length and pseudonym of the value that begins with the match; "" if there is none."""
        whole, tried = m[0], []

        def pseudonym(part: str, found: re.Match | None) -> str:
            known = (handler, pattern.pattern, part, back)
            new = self.cache.get(known)
            if new is None:
                new = found and handler(found, self.cycle, back) or ""
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[known] = new
            return new

        for end in _ends(kind, whole):
            if end > free:
                continue
            part = whole[:end]
            new = pseudonym(part, m if end == len(whole) else pattern.fullmatch(part))
            if new:
                # none of its own earlier borders may validate, so that it is found again at this end
                while any(pseudonym(x, pattern.fullmatch(x)) for x in (new[:e] for e in tried if e < end)):
                    new = pseudonym(new, pattern.fullmatch(new))
                return end, new
            tried.append(end)
        return 0, ""

    def replace(self, text: str, back: bool = False) -> tuple[str, list[tuple[int, int, str, str]]]:
        found, out, at = self.find(text, back), [], 0
        for a, b, _, new in found:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), found


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))


def pseudonymise(df: DataFrame, key: bytes, text_column: str = "text", back: bool = False, spans: bool = True) -> DataFrame:
    """The rows of ``df`` with the text replaced and, if asked for, a last column
    ``pii_spans`` (in place of one of that name): kind, start and length in characters, the same in the
    old and the new text.  ``back`` turns pseudonyms into the values they stand for.  One narrow pass."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    prepare(df.sparkSession)
    if spans:
        df = df.select(*[df[_quoted(c)] for c in df.columns if c != "pii_spans"])
    others = [c for c in df.columns if c != text_column]
    rows = df.select(df[_quoted(text_column)].alias("text"), F.struct(*[df[_quoted(c)].alias(f"c{k}") for k, c in enumerate(others)] or [F.lit(0).alias("c")]).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            for part in ragged.slices(batch, 0, 8 << 20):
                texts = part.column(0)
                look = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, CANDIDATE), False).to_numpy(zero_copy_only=False))
                changed: dict[int, str] = {}
                places: list[list] = [[]] * part.num_rows
                for k, text in zip(look.tolist(), texts.take(pa.array(look)).to_pylist(), strict=True):
                    new, found = names.replace(text, back)
                    if found:
                        changed[k] = new
                        places[k] = [{"kind": kind, "start": a, "length": b - a} for a, b, kind, _ in found]
                if changed:
                    mask = np.zeros(part.num_rows, bool)
                    mask[list(changed)] = True
                    texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([changed[k] for k in sorted(changed)], texts.type))
                yield pa.RecordBatch.from_arrays([texts, part.column(1), pa.array(places, SPANS)], ["text", "rest", "spans"])

    schema = StructType().add("text", "string").add("rest", rows.schema["rest"].dataType).add("spans", _parse_datatype_string("array<struct<kind:string,start:int,length:int>>"))
    out = rows.mapInArrow(run, schema)
    place = {c: F.col(f"rest.c{k}").alias(c) for k, c in enumerate(others)}
    return out.select(*[place.get(c, F.col("text").alias(c)) for c in df.columns], *[F.col("spans").alias("pii_spans")] * spans)
