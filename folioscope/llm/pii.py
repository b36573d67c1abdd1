"""PII: validated numbers, dates, addresses and keys as keyed pseudonyms of the same format.

Every value is permuted within the set of valid values of its own format by a Feistel network, so equal values stay
equal across documents, different ones stay different, and whoever holds the key can go back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, text_buffers

ROUNDS = 10

PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b)"
    r"|(?<![A-Za-z0-9])(?:"
    r"(?P<key>[0-9a-f]{32,128}(?![A-Za-z0-9])|[0-9A-F]{32,128}(?![A-Za-z0-9]))"
    r"|(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<iso>[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-]))"
    r"|(?P<slash>[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/]))"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9]))"
    r"|(?P<phone>(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9-]))"
    r"|(?P<card>[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9-])|[0-9]{13,19}(?![0-9]))"
    r")"
)


def _keyed(key: bytes, tweak: str, turn: int, value: int, size: int) -> int:
    block = hashlib.blake2b(f"{tweak}|{turn}|{value}".encode(), key=key[:64], digest_size=32).digest()
    return int.from_bytes(block, "big") % size


def permute(value: int, left: int, right: int, key: bytes, tweak: str, back: bool = False) -> int:
    """Permutes 0 .. left * right - 1: an alternating Feistel network on value = a * right + b."""
    a, b = divmod(value, right)
    for turn in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        sign = -1 if back else 1
        if turn % 2:
            b = (b + sign * _keyed(key, tweak, turn, a, right)) % right
        else:
            a = (a + sign * _keyed(key, tweak, turn, b, left)) % left
    return a * right + b


def walk(value: int, left: int, right: int, key: bytes, tweak: str, valid: Callable[[int], bool], back: bool = False) -> int:
    """Permutes the valid values alone: on until the next valid one (cycle walking)."""
    value = permute(value, left, right, key, tweak, back)
    while not valid(value):
        value = permute(value, left, right, key, tweak, back)
    return value


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        v = int(c) * (1 if i % 2 else 2)
        total += v - 9 if v > 9 else v
    return str(-total % 10)


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def mod97(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


DIGIT, LOWERS, UPPERS, HEX, HEX_UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789ABCDEF"


def _spell(text: str, key: bytes, tweak: str, back: bool, hexes: str = "", valid: Callable[[str], bool] | None = None) -> str:
    """Permutes the letters and digits of a text, each place within its own alphabet; the rest stays."""
    alphabets = [hexes or next((x for x in (DIGIT, LOWERS, UPPERS) if c in x), "") for c in text]
    places = [i for i, x in enumerate(alphabets) if x]
    if not places:
        return text
    half = (len(places) + 1) // 2
    sizes, value = [1, 1], 0
    for n, i in enumerate(places):
        sizes[n >= half] *= len(alphabets[i])
        value = value * len(alphabets[i]) + alphabets[i].index(text[i])

    def out(v: int) -> str:
        chars = list(text)
        for i in reversed(places):
            v, k = divmod(v, len(alphabets[i]))
            chars[i] = alphabets[i][k]
        return "".join(chars)

    return out(walk(value, *sizes, key, tweak, (lambda v: valid(out(v))) if valid else (lambda v: True), back))


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _fill(shape: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), shape)


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _ssn(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"


def _date(day: datetime.date, key: bytes, back: bool) -> datetime.date | None:
    """Permutes dates with a day up to 12 among themselves, and the others: an order of day and month that can be told stays so."""
    n, size = day.toordinal() - _FIRST, _LAST - _FIRST + 1
    if not 0 <= n < size:
        return None
    early = day.day <= 12
    return datetime.date.fromordinal(_FIRST + walk(n, 271, 270, key, "date", lambda v: v < size and (datetime.date.fromordinal(_FIRST + v).day <= 12) == early, back))


def _parsed(s: str, order: str) -> datetime.date | None:
    try:
        return datetime.datetime.strptime(s, order).date()
    except ValueError:
        return None


def pseudonym(kind: str, s: str, key: bytes, back: bool = False) -> tuple[str, str] | None:
    """(kind, replacement) of a matched value, or None where it isn't valid. back undoes it."""
    if kind == "email":
        local, at, domain = s.partition("@")
        return kind, _spell(local, key, kind, back) + at + domain
    if kind == "key":
        if len(set(s)) < 8:
            return None
        return kind, _spell(s, key, kind, back, HEX if s == s.lower() else HEX_UP)
    if kind == "iban":
        flat = s.replace(" ", "")
        country, check, body = flat[:2], flat[2:4], flat[4:]
        if not 15 <= len(flat) <= 34 or int(check) != 98 - mod97(country, body):
            return None
        body = _spell(body, key, country, back)
        new = iter(f"{country}{98 - mod97(country, body):02d}{body}")
        return kind, "".join(" " if c == " " else next(new) for c in s)
    if kind in ("iso", "slash"):
        # day first where that is a date, which its pseudonym is again
        for order in ("%Y-%m-%d",) if kind == "iso" else ("%d/%m/%Y", "%m/%d/%Y"):
            if day := _parsed(s, order):
                new = _date(day, key, back)
                return ("date", new.strftime(order)) if new else None
        return None
    if kind == "ssn":
        return (kind, _spell(s, key, kind, back, valid=_ssn)) if _ssn(s) else None
    if kind == "ip":
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        v = int.from_bytes(bytes(int(p) for p in parts), "big")
        return kind, ".".join(map(str, permute(v, 1 << 16, 1 << 16, key, kind, back).to_bytes(4, "big")))
    if kind == "phone":
        country = re.match(r"\+[0-9]{1,3}", s)
        head = country[0] if country else ""
        return kind, head + _fill(s[len(head) :], _spell(_digits(s[len(head) :]), key, kind, back))
    digits = _digits(s)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    body = _spell(digits[:-1], key, "card", back, valid=lambda d: len(set(d + luhn_digit(d))) > 1)
    return "card", _fill(s, body + luhn_digit(body))


def mask(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in the new text (code points)."""
    out, spans, at, n = [], [], 0, 0
    for m in PATTERN.finditer(text):
        new = pseudonym(m.lastgroup, m.group(), key, back)
        if new is None:
            continue
        out += [text[at : m.start()], new[1]]
        n += m.start() - at
        spans.append((new[0], n, n + len(new[1])))
        n += len(new[1])
        at = m.end()
    return ("".join(out) + text[at:], spans) if out else (text, spans)


SPAN = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("stop", "integer"))


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str | None = "pii") -> DataFrame:
    """Replaces personal values in a text column; spans, if named, becomes the list of (kind, start, stop).

    Kinds: e-mail (local part), card of 13 to 19 digits (Luhn holds before and after), phone, SSN, IBAN (mod 97), IPv4, calendar date from 1900 to 2099, and hexadecimal keys of 32 digits or more. Values that look
    alike but aren't valid stay; digits are 0 to 9. The pseudonym depends on the normalised value alone: a date, phone,
    card or IBAN has the same one in all its spellings and documents. Where patterns overlap, the first by place wins, and
    at one place the first by the order above. Whole texts, however long; null texts stay null and have no spans, empty
    ones stay empty. Rows (repeated ones too), order and other columns are unchanged, a column named like `spans` is
    replaced, and an empty table stays empty.
    """
    prepare(docs.sparkSession)
    if spans:
        docs = docs.drop(spans)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields])
    if spans:
        schema = schema.add(spans, SPAN)
    mark = np.zeros(256, bool)
    mark[[*b"0123456789@"]] = True
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            raw, off = text_buffers(column)
            hits = np.concatenate([[0], np.cumsum(mark[raw])])
            hits = hits[off[1:]] - hits[off[:-1]]
            changed, found = {}, [[]] * len(column)
            # one '@' makes an address; every other kind has a digit, keys of letters alone aren't valid
            for i in np.flatnonzero(hits > 0):
                new, own = mask(column[i].as_py(), key)
                if own:
                    changed[i], found[i] = new, own
            if changed:
                body = column.to_pylist()
                for i, new in changed.items():
                    body[i] = new
                column = pa.array(body, column.type)
            columns = [*batch.columns]
            columns[at] = column
            if spans:
                columns.append(pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in x] for x in found], kind))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def summary(masked: DataFrame) -> DataFrame:
    """Counts by kind over the spans."""
    return masked.select(F.explode("pii.kind").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
