"""Format-preserving pseudonyms for personal data.

Values are found in whole texts, validated and replaced by a keyed permutation within their format, so equal values get
equal pseudonyms in every document, and a pseudonym validates as its original did:

* card: 13 to 19 digits, single spaces or hyphens between, that pass Luhn's check; separators stay, so does the check.
* ssn: ddd-dd-dddd in the issued ranges.
* iban: a valid check number; country stays, letters and digits keep their kinds, the check number is made anew.
* phone: a leading + and 8 to 15 digits, or ddd-ddd-dddd style groups; country code (from a fixed table) and separators stay.
* ip: four octets; date: a real day as yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy or dd/mm/yyyy (mm/dd/yyyy where only that is a day),
  permuted among the days of 1900 to 2099, those up to the 12th of a month and later ones apart, alike in all layouts (other years stay untouched).
* email: letters and digits of the local part keep their kinds and places, capitals theirs; the domain stays.

The permutation is a balanced Feistel network of ROUNDS rounds with a keyed hash over the smallest even number of bits that
covers the format, walked until it lands inside the format again (about twice on average); the kind of value
is its tweak. It can be undone with the key (restore=True).

Cards, IBANs and phones may stand beside other digits or capitals: cards in a usual layout are looked for first, then the
longest valid run of whole tokens is taken. Such a value keeps its pseudonym, but restore reads amiss where that and
its neighbours happen to check as a longer value (a tenth of cards that a group of 1 to 3 digits follows, a hundredth of IBANs).

Very long texts are read whole; a very long local part is permuted in blocks of BLOCK characters.

Cases: null text stays null; empty texts, texts without values and values that fail validation stay as they are; null ids and
repeated rows are rows like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

ROUNDS = 10
BLOCK = 128  # characters permuted as one number
KINDS = ("email", "ip", "date", "iban", "card", "phone", "ssn")
_MAY = re.compile(r"@|[0-9][0-9\-./ ()]{5,}[0-9]|[A-Z]{2}[0-9]{2}[A-Z0-9]")
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}(?P<y>[-/])[0-9]{2}(?P=y)[0-9]{2}|[0-9]{2}(?P<d>[./])[0-9]{2}(?P=d)[0-9]{4})(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){5,12}(?![0-9])|(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
_EACH = {k: re.compile(p) for k, p in _PATTERNS.items()}
_TOKEN = re.compile("[A-Za-z0-9]+")
#: How cards are written: in one token, or in groups of 4 (and a rest), or of 4, 6 and 4 or 5.
_LAYOUT = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{1,3}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{4,5})(?![0-9])")
_LAYOUT_16 = re.compile(r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
#: Country codes of one and two digits; all others have three.
_CODES = re.compile("1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Permutation:
    """A keyed permutation of the whole numbers below any size."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = key, inverse

    def hashed(self, data: bytes, width: int) -> int:
        """A keyed hash of any width, in blocks of up to 64 bytes."""
        out = hashlib.blake2b(data, key=self.key, digest_size=min(64, width)).digest()
        for block in range(1, -(-width // 64)):
            out += hashlib.blake2b(data, key=self.key, salt=block.to_bytes(8, "big")).digest()
        return int.from_bytes(out[:width], "big")

    def __call__(self, kind: str, x: int, size: int) -> int:
        half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
        mask, seed, width = (1 << half) - 1, f"{kind}|{size}|".encode(), (half + 7) // 8
        while True:
            a, b = x >> half, x & mask
            for r in range(ROUNDS):
                if self.inverse:
                    a, b = b ^ (self.hashed(seed + bytes([ROUNDS - 1 - r]) + a.to_bytes(width, "big"), width + 8) & mask), a
                else:
                    a, b = b, a ^ (self.hashed(seed + bytes([r]) + b.to_bytes(width, "big"), width + 8) & mask)
            x = a << half | b
            if x < size:
                return x


def luhn(digits: str) -> int:
    """Luhn's sum mod 10: 0 if the last digit checks the others."""
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def iban_check(body: str, country: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def refill(shape: str, chars: str) -> str:
    """chars in the places of shape's letters and digits."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _mixed(p: Permutation, kind: str, text: str) -> str:
    """Permute a string of ASCII letters and digits, each place keeping its kind. Long ones in blocks: there and back, the block
    before is each one's tweak, so that all of them depend on all characters, in time and memory proportional to the length."""
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [""]
    if len(blocks) == 1:
        return _block(p, kind, text)
    for step in (-1, 1) if p.inverse else (1, -1):
        there = step == (-1 if p.inverse else 1)
        for i in range(len(blocks)) if there else range(len(blocks) - 1, -1, -1):
            near = blocks[i - step] if 0 <= i - step < len(blocks) else ""
            blocks[i] = _block(p, f"{kind}{step}{near}|", blocks[i])
    return "".join(blocks)


def _block(p: Permutation, kind: str, text: str) -> str:
    sets = ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "abcdefghijklmnopqrstuvwxyz" for c in text]
    x, size = 0, 1
    for c, s in zip(text, sets, strict=True):
        x, size = x * len(s) + s.index(c), size * len(s)
    x, out = p(kind + "".join(s[0] for s in sets), x, size), []
    for s in reversed(sets):
        x, i = divmod(x, len(s))
        out.append(s[i])
    return "".join(reversed(out))


def _number(p: Permutation, kind: str, digits: str) -> str:
    return f"{p(kind, int(digits), 10 ** len(digits)):0{len(digits)}d}" if digits else ""


def _card(p: Permutation, v: str) -> str | None:
    d = re.sub(r"[ -]", "", v)
    if luhn(d) or len(set(d)) == 1:
        return None
    body = _number(p, "card", d[:-1])
    return refill(v, body + str(-luhn(body + "0") % 10))


def _ssn(p: Permutation, v: str) -> str | None:
    good = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    d = v.replace("-", "")
    if not good(d):
        return None
    while True:  # back into the issued ranges, which over four fifths of all numbers are
        d = _number(p, "ssn", d)
        if good(d):
            return refill(v, d)


def _iban(p: Permutation, v: str) -> str | None:
    s = v.replace(" ", "")
    if len(s) < 15 or iban_check(s[4:], s[:2]) != s[2:4]:
        return None
    body = _mixed(p, "iban" + s[:2], s[4:])
    return refill(v, s[:2] + iban_check(body, s[:2]) + body)


def _phone(p: Permutation, v: str) -> str | None:
    d = re.sub(r"[^0-9]", "", v)
    if not 8 <= len(d) <= 15:
        return None
    code = _CODES.match(d)
    keep = 0 if v[0] != "+" else len(code[0]) if code else 3
    return refill(v, d[:keep] + _number(p, "phone" + d[:keep], d[keep:]))


def _ip(p: Permutation, v: str) -> str | None:
    o = [int(x) for x in v.split(".")]
    if max(o) > 255 or any(len(x) > 1 and x[0] == "0" for x in v.split(".")):
        return None
    n = p("ip", int.from_bytes(bytes(o), "big"), 1 << 32)
    return ".".join(str(x) for x in n.to_bytes(4, "big"))


def _date(p: Permutation, v: str) -> str | None:
    a, b, c = (int(x) for x in re.split(r"[-/.]", v))
    year_first = len(re.split(r"[-/.]", v)[0]) == 4
    for y, m, d, order in ([(a, b, c, "ymd")] if year_first else [(c, b, a, "dmy"), (c, a, b, "mdy")] if "/" in v else [(c, b, a, "dmy")]):
        try:
            day = datetime.date(y, m, d).toordinal() - _DAY0
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        size = _DAYS
        while True:
            day = p("date", day, size)
            new = datetime.date.fromordinal(day + _DAY0)
            # month first is only read where it can't be day first, so in every layout days up to 12 and later ones are permuted apart
            if (new.day > 12) == (d > 12):
                break
        parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        sep = v[4] if year_first else v[2]
        return sep.join(parts[k] for k in order)
    return None


def _email(p: Permutation, v: str) -> str | None:
    local, _, domain = v.rpartition("@")
    chars = re.sub(r"[^A-Za-z0-9]", "", local)
    if not chars:
        return None
    # capitals stay in their places and don't matter otherwise, so addresses that differ in them alone stay linked
    new = _mixed(p, "email", chars.lower())
    return f"{refill(local, ''.join(x.upper() if c.isupper() else x for c, x in zip(chars, new, strict=True)))}@{domain}"


_MAKE: dict[str, Callable[[Permutation, str], str | None]] = {"email": _email, "ip": _ip, "date": _date, "iban": _iban, "card": _card, "phone": _phone, "ssn": _ssn}


class Pseudonyms:
    def __init__(self, key: bytes, restore: bool = False):
        self.permute, self.known = Permutation(key, restore), {}

    def value(self, kind: str, v: str) -> str | None:
        if len(self.known) > 200_000:
            self.known.clear()
        if (kind, v) not in self.known:
            self.known[kind, v] = _MAKE[kind](self.permute, v)
        return self.known[kind, v]

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        n = dict.fromkeys(KINDS, 0)
        if not _MAY.search(text):
            return text, n

        out, at = [], 0
        for a, b, kind, new in self.found(text, 0, len(text)):
            out += [text[at:a], new]
            at = b
            n[kind] += 1
        return "".join([*out, text[at:]]), n

    def found(self, text: str, lo: int, hi: int) -> Iterator[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of the values between lo and hi, in order."""
        while m := _FIND.search(text, lo, hi):
            kind, (a, b) = m.lastgroup, m.span()
            new = self.value(kind, m[0]) if kind != "card" else None
            hit = (a, b, kind, new) if new is not None else self.inside(text, kind, a, b, hi)
            if hit is None:  # nothing starts with this token
                lo = _TOKEN.search(text, a).end()
                continue
            if hit[0] > a:
                yield from self.found(text, a, hit[0])
            yield hit
            lo = hit[1]

    def inside(self, text: str, kind: str, a: int, b: int, hi: int) -> tuple[int, int, str, str] | None:
        """The value within text[a:b], which looks like one of the kind with more digits or capitals beside it: a card in a usual
        layout, then the longest valid run of whole tokens, then another kind's value at the same place."""
        if kind not in ("card", "iban", "phone"):
            return self.other(text, kind, a, hi)
        tokens = [(t.start(), t.end()) for t in _TOKEN.finditer(text, a, b)]
        if kind == "card":
            for t, _ in tokens:
                for layout in (_LAYOUT, _LAYOUT_16):
                    if (m := layout.match(text, t, hi)) and (new := self.value(kind, m[0])) is not None:
                        return t, m.end(), kind, new
        starts = [a] if kind == "phone" else [t for t, _ in tokens]
        for x, y in sorted(((x, y) for x in starts for _, y in tokens if y > x), key=lambda s: (s[0] - s[1], s[0])):
            if (m := _EACH[kind].match(text, x, y)) and m.end() == y and (new := self.value(kind, m[0])) is not None:
                return x, y, kind, new
        return self.other(text, kind, a, hi)

    def other(self, text: str, kind: str, a: int, hi: int) -> tuple[int, int, str, str] | None:
        for k in _PATTERNS:
            if k != kind and (m := _EACH[k].match(text, a, hi)) and (new := self.value(k, m[0])) is not None:
                return a, m.end(), k, new
        return None


OUT = "text string, " + ", ".join(f"n_{k} bigint" for k in KINDS)


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", restore: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of replaced values of each kind, for every row of docs."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, restore)
        for b in batches:
            texts, counts = [], []
            for t in b.column(1):
                text, n = names.text(t.as_py()) if t.is_valid else (None, dict.fromkeys(KINDS, 0))
                texts.append(text)
                counts.append(n)
            columns = [b.column(0), pa.array(texts, pa.string()), *(pa.array([n[k] for n in counts], pa.int64()) for k in KINDS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {OUT}")


#: The query's key; a deployment passes its own.
DEMO_KEY = b"veinwork demonstration key"


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(read_table(spark, sf_dir, "documents"), DEMO_KEY)
