"""PII: format-preserving Feistel pseudonyms.

Values are found, validated, turned into an integer within their format, permuted by a keyed
balanced Feistel network (keyed BLAKE2b rounds), and written back in the same layout. The walk goes on
until the result has the format again: as many characters, read as the same kind in the same way. The
permutation depends on the key and the kind only, so equal values stay linked across documents, and
`restore` inverts it.

Kinds, in order of precedence: email (letters and digits of the local part and of the domain before
its last label, by character class), ipv4 (four numbers of 0 to 255, each with as many digits as before), date
(a day of 1900 to 2099 as y-m-d, y/m/d, d/m/y, m/d/y where it can't be d/m/y, d.m.y, or with an English month;
day and month keep their numbers of characters), ssn (ddd-dd-dddd with a valid area), iban (mod 97; the check
digits are made anew), card (13 to 19 digits with a valid Luhn digit, which is made anew), account (9 to 19
digits without one, kept so), phone (10 to 15 digits with a plus sign or separators; the country code
stays). Anything that fails its validation is not a value of that kind.

Defined results: null text stays null with no value; empty text stays empty. Overlapping values go
to the first kind in the order, then leftmost. Repeated rows are handled one by one; extra
columns are kept and may have any name but `pii_counts`, which is replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.textkernel import steps

ROUNDS = 8
KINDS = ("email", "ipv4", "date", "ssn", "iban", "card", "account", "phone")
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2099, 12, 31) - date(1900, 1, 1)).days + 1


@lru_cache(maxsize=100_000)
def permute(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A keyed permutation of range(size); `back` inverts it."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, wide = (1 << half) - 1, (half + 7) // 8
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def f(r: int, x: int) -> int:
        seed = hashlib.blake2b(b"%d|%d|" % (r, size) + kind.encode() + x.to_bytes(wide, "big"), key=key[:64], digest_size=min(64, max(8, wide))).digest()
        while len(seed) < wide:
            seed += hashlib.blake2b(seed, key=key[:64]).digest()
        return int.from_bytes(seed[: max(wide, 8)], "big") & mask

    while True:
        left, right = value >> half, value & mask
        for r in order:
            if back:
                left, right = right ^ f(r, left), left
            else:
                left, right = right, left ^ f(r, right)
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _classes(text: str, key: bytes, kind: str, back: bool) -> str:
    """Permutes letters and digits as one mixed-radix number; everything else stays in place."""
    spots = [(i, ord("a") if c.islower() else ord("A") if c.isupper() else ord("0"), 10 if c.isdigit() else 26) for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    value, size = 0, 1
    for i, base, radix in spots:
        value, size = value * radix + ord(text[i]) - base, size * radix
    value = permute(value, size, key, f"{kind}:{','.join(str(r) for _, _, r in spots)}", back)
    out = list(text)
    for i, base, radix in reversed(spots):
        value, digit = divmod(value, radix)
        out[i] = chr(base + digit)
    return "".join(out)


def _digits_into(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _email(m: str, key: bytes, back: bool) -> str | None:
    at = m.index("@")
    last = m.rindex(".")
    return _classes(m[:at], key, "email", back) + "@" + _classes(m[at + 1 : last], key, "domain", back) + m[last:]


def _ipv4(m: str, key: bytes, back: bool) -> str | None:
    parts = m.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    ranges = [((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in parts]  # first number and how many there are
    value, size = 0, 1
    for p, (first, n) in zip(parts, ranges, strict=True):
        value, size = value * n + int(p) - first, size * n
    value = permute(value, size, key, f"ipv4:{','.join(str(len(p)) for p in parts)}", back)
    out = []
    for first, n in reversed(ranges):
        value, rest = divmod(value, n)
        out.append(str(first + rest))
    return ".".join(reversed(out))


#: English names of the months; the first three letters are their short forms.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _read_date(m: str) -> tuple[date, tuple] | None:
    """The day, and the layout: separators, which part is what, and the lengths of day and month."""
    parts, gaps = re.findall(r"\w+", m), re.findall(r"\W+", m)
    orders = ("ymd",) if len(parts[0]) == 4 and parts[0].isdigit() else ("mdy",) if parts[0].isalpha() else ("dmy", "mdy") if gaps[0] == "/" else ("dmy",)
    for order in orders:
        of = dict(zip(order, parts, strict=True))
        month, name = of["m"], of["m"].isalpha()
        if name:
            word = month.lower()
            month = next((i for i, x in enumerate(MONTHS, 1) if word in (x, x[:3])), 0)
        try:
            day = date(int(of["y"]), int(month), int(of["d"]))
        except ValueError:
            continue
        if 0 <= (day - FIRST_DAY).days < DAYS:
            case = (of["m"].isupper(), of["m"].islower()) if name else ()
            return day, (order, tuple(gaps), len(of["d"]), len(of["m"]), name, case)
    return None


def _date(m: str, key: bytes, back: bool) -> str | None:
    found_ = _read_date(m)
    if found_ is None:
        return None
    day, layout = found_
    order, gaps, days, months, name, case = layout
    n = (day - FIRST_DAY).days
    while True:  # on to a day that has this layout too
        n = permute(n, DAYS, key, "date", back)
        new = FIRST_DAY + timedelta(n)
        word = MONTHS[new.month - 1]
        word = (word[:3] if months == 3 else word) if name else f"{new.month:0{months}d}"
        word = word.upper() if case == (True, False) else word if case == (False, True) else word.title() if name else word
        of = {"y": str(new.year), "m": word, "d": f"{new.day:0{days}d}"}
        a, b, c = (of[x] for x in order)
        text = f"{a}{gaps[0]}{b}{gaps[1]}{c}"
        if len(text) == len(m) and _read_date(text) == (new, layout):
            return text


def _valid_ssn(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(m: str, key: bytes, back: bool) -> str | None:
    n = int(m.replace("-", ""))
    if not _valid_ssn(n):
        return None
    while True:
        n = permute(n, 10**9, key, "ssn", back)
        if _valid_ssn(n):
            return f"{n // 1_000_000:03d}-{n // 10_000 % 100:02d}-{n % 10_000:04d}"


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(m: str, key: bytes, back: bool) -> str | None:
    plain = m.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1 or not 2 <= int(plain[2:4]) <= 98:
        return None
    body = _classes(plain[4:], key, "iban", back)
    check = 98 - _mod97(plain[:2] + "00" + body)
    it = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(next(it) if c != " " else c for c in m)


def _number(m: str, key: bytes, back: bool, card: bool) -> str | None:
    digits = "".join(c for c in m if c.isdigit())
    n = len(digits)
    if card:
        if n < 13 or not luhn(digits):
            return None
        body = f"{permute(int(digits[:-1]), 10 ** (n - 1), key, f'card{n}', back):0{n - 1}d}"
        return _digits_into(m, body + next(c for c in "0123456789" if luhn(body + c)))
    if n >= 13 and luhn(digits):
        return None
    value = int(digits)
    while True:
        value = permute(value, 10**n, key, f"account{n}", back)
        new = f"{value:0{n}d}"
        if n < 13 or not luhn(new):
            return _digits_into(m, new)


def _phone(m: str, key: bytes, back: bool) -> str | None:
    code = re.match(r"\+\d{1,3}(?=[ (.-])", m)
    head = code[0] if code else ""
    digits = "".join(c for c in m[len(head) :] if c.isdigit())
    if not 10 <= len(digits) + sum(c.isdigit() for c in head) <= 15 or not digits:
        return None
    new = f"{permute(int(digits), 10 ** len(digits), key, f'phone{len(digits)}', back):0{len(digits)}d}"
    return head + _digits_into(m[len(head) :], new)


#: Patterns of the kinds. Each starts at an at sign or a digit run, or is anchored.
FIND: list[tuple[str, str, re.Pattern, Callable]] = [
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"), _email),
    ("ipv4", ".", re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"), _ipv4),
    ("date", "", re.compile(
        r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
        r"|\d{1,2} [A-Za-z]{3,9} \d{4}|[A-Za-z]{3,9} \d{1,2}, \d{4})(?![./-]?\d|[A-Za-z_])"
    ), _date),
    ("ssn", "-", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), _ssn),
    ("iban", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), _iban),
    ("card", "", re.compile(r"(?<![\d+.-])\d(?:[ -]?\d){12,18}(?![\d-])"), lambda m, k, b: _number(m, k, b, True)),
    ("account", "", re.compile(r"(?<![A-Za-z0-9+.-])\d{9,19}(?![A-Za-z0-9])"), lambda m, k, b: _number(m, k, b, False)),
    ("phone", "", re.compile(r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<![\w+(])\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\w)\+\d{10,15}(?!\d)|(?<![\w+(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"), _phone),
]
DIGIT = re.compile(r"\d")


def kind_of(value: str, key: bytes) -> str | None:
    """The first kind that takes the whole value."""
    return next((kind for kind, _, pattern, change in FIND if pattern.fullmatch(value) and change(value, key, False) is not None), None)


@lru_cache(maxsize=100_000)
def pseudonym(value: str, kind: str, key: bytes, back: bool) -> str | None:
    """The value's pseudonym, walked on until it is read as the same kind; None if the value is not of that kind."""
    change = next(c for k, _, _, c in FIND if k == kind)
    new = change(value, key, back)
    if new is None or kind_of(value, key) != kind:
        return new
    while kind_of(new, key) != kind:
        new = change(new, key, back)
    return new


def found(text: str, key: bytes, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the values of a text, in order, without overlaps."""
    out: list[tuple[int, int, str, str]] = []
    digit = DIGIT.search(text) is not None
    for kind, needs, pattern, _ in FIND:
        if (kind != "email" and not digit) or (needs and needs not in text):
            continue
        more = []
        for m in pattern.finditer(text):
            at = bisect(out, (m.start(),))
            if (at < len(out) and out[at][0] < m.end()) or (at and out[at - 1][1] > m.start()):
                continue
            new = pseudonym(m[0], kind, key, back)
            if new is not None:
                more.append((m.start(), m.end(), kind, new))
        if more:
            out = sorted(out + more)
    return out


def replaced(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for a, b, _, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def pseudonymize(docs: DataFrame, key: bytes, column: str = "text", back: bool = False) -> DataFrame:
    """`docs` with pseudonyms in `column`, and `pii_counts`, map<kind, count>, as its last column."""
    docs = docs.drop("pii_counts")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in steps(frames, column):
            texts, counts = [], []
            for text in part[column]:
                spans = found(text, key, back) if text else []
                texts.append(replaced(text, spans) if spans else text)
                counts.append({k: sum(s[2] == k for s in spans) for k in {s[2] for s in spans}})
            yield part.assign(**{column: pd.Series(texts, index=part.index, dtype=object), "pii_counts": counts})

    return docs.mapInPandas(run, f"{kinds}, pii_counts map<string, bigint>")


def restore(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """The inverse of `pseudonymize` under the same key."""
    return pseudonymize(docs, key, column, back=True)


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, the pseudonymised text and one count for each kind."""
    out = pseudonymize(docs.select("doc_id", "text"), key)
    count = lambda k: F.coalesce(F.element_at("pii_counts", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", *[count(k) for k in KINDS])
