"""Format-preserving Feistel pseudonyms for personal data in texts.

Candidates are found by pattern and validated (check digits, ranges, calendar), then permuted under a key within their
format: digits stay digits, letters letters of the same case, marks stay in place, and a card, bank account or date
stays valid. The permutation depends on the key, the kind and the format only, so equal values get equal pseudonyms in
all documents, and whoever holds the key can invert them.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
#: Groups of year, month and day. A date that may be read both ways is day first.
DATE_FORMATS = {"ymd": (1, 2, 3), "dmy": (3, 2, 1), "mdy": (3, 1, 2)}
#: Patterns of the kinds, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"[A-Za-z0-9+/_-]{8,}",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)",
    "ymd": r"(?<!\d)(\d{4})(?:-(?=\d+-)|/(?=\d+/)|\.(?=\d\d\.\d\d(?!\d)))(\d{1,2})[-/.](\d{1,2})(?!\d)",
    "dmy": r"(?<![\d./])(\d{1,2})[./](\d{1,2})[./](\d{4})(?![\d./]*\d)",
    "mdy": r"(?<![\d./])(\d{1,2})/(\d{1,2})/(\d{4})(?![\d./]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-]*\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
}
#: What stands before a secret, and signs one of which is in or before every value: most texts have none of them.
BEFORE = {"secret": r"(?i:token|password|secret|api_?key)\s?[=:]\s?[\"']?"}
SIGN = re.compile("[0-9@]|AKIA|(?i:token|password|secret|api_?key)")
#: Characters around a sign that are searched, and the run after them; no value begins further before its sign.
AROUND = 600
RUN = re.compile("[A-Za-z0-9+/_-]*")
#: Longer texts are permuted in blocks of so many characters, each under a digest of the pseudonym before it.
BLOCK = 512
EACH = {k: re.compile(f"{BEFORE.get(k, '')}(?P<{k}>{p})") for k, p in PATTERNS.items()}
FIND = re.compile("|".join(p.pattern for p in EACH.values()))
#: Characters of a bank account by country; those of other countries end at any group.
IBAN_CHARS = {c[:2]: int(c[2:]) for c in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29
ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27
MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23
TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()}


def windows(text: str) -> Iterator[tuple[int, int]]:
    """The parts of ``text`` that are near signs."""
    start = end = -1
    for sign in SIGN.finditer(text):
        if end >= 0 and sign.start() - AROUND > end:
            end = RUN.match(text, end).end()
        if sign.start() - AROUND > end:
            if end >= 0:
                yield start, end
            start = max(0, sign.start() - AROUND)
        end = max(end, sign.end() + AROUND)
    if end >= 0:
        yield start, RUN.match(text, end).end()


def places(text: str) -> Iterator[re.Match]:
    """The matches of all patterns, searched for near signs only."""
    for start, end in windows(text):
        yield from FIND.finditer(text, start, end)


def ends(kind: str, value: str) -> Iterator[int]:
    """The lengths at which a match may end: an account's pattern also takes words that follow it, so it may end at any
    group; those with the characters of its country come first, then the longest."""
    if kind == "iban":
        at = [len(value), *(m.start() for m in re.finditer(" ", value))]
        yield from sorted(at, key=lambda n: (len(value[:n].replace(" ", "")) != IBAN_CHARS.get(value[:2]), -n))
    else:
        yield len(value)


def feistel(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: unbalanced rounds over the mixed-radix halves of the value."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1

    def rounds(x: int) -> int:
        left, right = divmod(x, a)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = (right - _round(key, tweak, i, left, a)) % a, left
            else:
                left, right = right, (left + _round(key, tweak, i, right, a)) % a
        return left * a + right

    out = rounds(value)
    while out >= size:  # the square is a little larger than the set: walk on until the set is met again
        out = rounds(out)
    return out


def _round(key: bytes, tweak: str, i: int, x: int, a: int) -> int:
    """A keyed number, at least 8 bytes longer than ``a``, so that no leading character of a long value stays."""
    if a.bit_length() <= 64:
        return int.from_bytes(hmac.digest(key, f"{tweak}|{i}|{x}".encode(), hashlib.sha256)[:16], "big")
    seed = hmac.digest(key, f"{tweak}|{i}|{x:x}".encode(), hashlib.sha256)
    return int.from_bytes(hashlib.shake_256(seed).digest(a.bit_length() // 8 + 9), "big")


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def check_digit(body: str) -> str:
    return next(c for c in DIGITS if luhn(body + c))


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def permuted(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """``text`` with its ASCII digits and letters permuted, each within its class; other characters stay."""
    if len(text) > BLOCK:
        done: list[str] = []
        for i in range(0, len(text), BLOCK):
            # the block before in its permuted form, which is given on the way back
            last = (text[i - BLOCK : i] if back else done[-1]) if i else ""
            tweak = hmac.digest(key, f"{tweak}|{last}".encode(), hashlib.sha256).hex()
            done.append(permuted(text[i : i + BLOCK], key, tweak, back))
        return "".join(done)
    sets = [next((s for s in (DIGITS, LOWER, UPPER) if c in s), "") for c in text]
    size, value = 1, 0
    for c, s in zip(text, sets, strict=True):
        if s:
            value, size = value * len(s) + s.index(c), size * len(s)
    shape = "".join({DIGITS: "0", LOWER: "a", UPPER: "A"}.get(s, c) for c, s in zip(text, sets, strict=True))
    value = feistel(value, size, key, f"{tweak}|{shape}", back)
    out = []
    for c, s in zip(reversed(text), reversed(sets), strict=True):
        if s:
            value, k = divmod(value, len(s))
            out.append(s[k])
        else:
            out.append(c)
    return "".join(reversed(out))


def _placed(mask: str, chars: str, among: str) -> str:
    """``mask`` with its characters out of ``among`` replaced by ``chars`` in order."""
    it = iter(chars)
    return "".join(next(it) if c in among else c for c in mask)


def _email(v: str, key: bytes, back: bool) -> str:
    name, at, host = v.partition("@")
    return permuted(name, key, "email", back) + at + host


def _iban(v: str, key: bytes, back: bool) -> str | None:
    flat = v.replace(" ", "")
    if not 15 <= len(flat) <= 34 or mod97(flat) != 1:
        return None
    body = permuted(flat[4:], key, f"iban|{flat[:2]}", back)
    return _placed(v, f"{flat[:2]}{98 - mod97(f'{flat[:2]}00{body}'):02d}{body}", DIGITS + UPPER)


def _secret(v: str, key: bytes, back: bool) -> str:
    head = "AKIA" if v.startswith("AKIA") else ""
    return head + permuted(v[len(head) :], key, "secret", back)


def _ip(v: str, key: bytes, back: bool) -> str | None:
    parts = v.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    widths = [len(p) for p in parts]
    low, size = [(0, 10, 100)[w - 1] for w in widths], [(10, 90, 156)[w - 1] for w in widths]
    value, total = 0, 1
    for p, a, n in zip(parts, low, size, strict=True):
        value, total = value * n + int(p) - a, total * n
    value = feistel(value, total, key, f"ip|{widths}", back)
    out = []
    for a, n in zip(reversed(low), reversed(size), strict=True):
        value, k = divmod(value, n)
        out.append(str(a + k))
    return ".".join(reversed(out))


def _date(v: str, key: bytes, back: bool, groups: tuple[str, ...], order: tuple[int, ...]) -> str | None:
    try:
        day = date(*(int(groups[k - 1]) for k in order))
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY or order == DATE_FORMATS["mdy"] and day.day <= 12:
        return None
    n, widths = (LAST_DAY - FIRST_DAY).days + 1, [len(g) for g in groups]
    shown = lambda d: {order[0]: f"{d.year:04d}", **{k: f"{x:0{widths[k - 1]}d}" for k, x in zip(order[1:], (d.month, d.day), strict=True)}}
    # walk on until the day has the same widths, and is no other day when it is read day first
    inside = lambda d: all(len(x) == widths[k - 1] for k, x in shown(d).items()) and (order != DATE_FORMATS["mdy"] or d.day > 12)
    new = day
    while new is day or not inside(new):
        new = FIRST_DAY + timedelta(days=feistel((new - FIRST_DAY).days, n, key, "date", back))
    fields = shown(new)
    return _placed(v, "".join(fields[k] for k in sorted(fields)), DIGITS)


def _ssn(v: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, v.split("-"))
    if not (0 < area < 900 and area != 666 and 0 < group and 0 < serial):
        return None
    n = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
    n = feistel(n, 898 * 99 * 9999, key, "ssn", back)
    area, rest = divmod(n, 99 * 9999)
    return f"{area + 1 + (area >= 665):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"


def _card(v: str, key: bytes, back: bool) -> str | None:
    digits = "".join(c for c in v if c in DIGITS)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    body = digits[0] + permuted(digits[1:-1], key, f"card|{digits[0]}", back)
    return _placed(v, body + check_digit(body), DIGITS)


def _phone(v: str, key: bytes, back: bool) -> str:
    keep = re.match(r"\+\d{1,3}(?=[ .(-])|", v)[0]
    digits = "".join(c for c in v[len(keep) :] if c in DIGITS)
    return keep + _placed(v[len(keep) :], permuted(digits, key, f"phone|{keep}", back), DIGITS)


RULES: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": _email, "iban": _iban, "key": _secret, "secret": _secret, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value of ``kind``, or with ``back`` the value of a pseudonym; None where it is not valid."""
    if kind in DATE_FORMATS:
        return _date(value, key, back, re.fullmatch(PATTERNS[kind], value).groups(), DATE_FORMATS[kind])
    return RULES[kind](value, key, back)


def valid(m: re.Match, text: str, stop: int, key: bytes, back: bool) -> tuple[str, int, int, str] | None:
    """(kind, start, end, pseudonym) of the first kind that is valid where ``m`` begins."""
    for kind, pattern in EACH.items():
        other = pattern.match(text, m.start(), stop)
        if other:
            begin = other.start(kind)
            for n in ends(kind, other.group(kind)):
                new = pseudonym(kind, other.group(kind)[:n], key, back)
                if new is not None:
                    return kind, begin, begin + n, new
    return None


def replaced(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """``text`` with pseudonyms, and (kind, start, end) of each in the original text."""
    out, spans, at = [], [], 0
    for start, stop in windows(text):
        while m := FIND.search(text, start, stop):
            found = valid(m, text, stop, key, back)
            start = m.start() + 1
            if found:
                kind, begin, start, new = found
                out += [text[at:begin], new]
                spans.append((kind, begin, start))
                at = start
    return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``pii``: array<struct<kind, start, end>> of their places.

    Equal values have equal pseudonyms; ``back`` inverts. What is not valid stays: a number without its check digit, a
    day that is not in the calendar. Null texts stay null and have no places, very long texts are searched whole, rows
    that repeat are treated alike, an empty table gives an empty result; a column named pii is replaced.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop("pii")
    at, names = rows.columns.index(text), rows.columns
    place = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(None, []) if x is None else replaced(x, key, back) for x in b.column(at).to_pylist()]
            new = pa.array([x for x, _ in done], pa.string())
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in y] for _, y in done], place)
            yield pa.RecordBatch.from_arrays([*(new if i == at else c for i, c in enumerate(b.columns)), spans], [*names, "pii"])

    return rows.mapInArrow(run, f"{kinds}, pii array<struct<kind: string, start: int, end: int>>")
