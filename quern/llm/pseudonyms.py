"""PII: format-preserving pseudonyms by a keyed Feistel permutation.

Personal data is found by pattern, validated, and replaced within its own format:

    email     local part and host name keep length, case and digit places; the last label stays
    card      13 to 19 digits with a valid Luhn sum: the first digit stays, the check digit is made valid again
    phone     + or a bracketed area code or three groups of digits: the country code and marks stay, the other digits change
              alike whatever marks stand between them
    ipv4      four numbers from 0 to 255: permuted as one 32-bit number
    ssn       ddd-dd-dddd outside the ranges never issued: permuted among the numbers that may be issued
    iban      two letters, check digits and account with remainder 1 modulo 97: check digits are made valid again
    date      year-month-day (or day.month.year, month/day/year) that the calendar has: permuted among the days of 1900 to 2099
    secret    a value of 16 or more letters and digits given to a name like token, key, secret or password,
              or one with an issuer's prefix, which stays

A value's digits and letters are ranked as one number of its format's domain and
permuted by an alternating ten-round Feistel network keyed by HMAC-SHA256 (as in
NIST SP 800-38G, FF1's shape), walking until the result is in the domain. The same key maps equal values to equal pseudonyms in
every document and different values to different ones, so links survive. The network
is conjugated with a step to the next number, so no value is its own pseudonym.

Edge cases.  A null text stays null, an empty one empty. Matches do not overlap; the
leftmost, then the longest kind in the order above, wins. Rows repeat as they come; a
null doc_id is kept. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import small_batches, text_blocks

#: Key of the registered query over synthetic tables; whoever knows the key can undo the pseudonyms, so ``with_pseudonyms`` asks for one.
TEST_KEY = b"quern demonstration key"
ROUNDS = 10
#: Prefixes that issuers give their keys.
PREFIXES = ("AKIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")

_KINDS = regex.compile(
    r"""
    (?P<email>(?<![\w.%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
    |(?P<secret>(?i:\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|key)\b["']?\s*[:=]\s*["']?)\K[A-Za-z0-9_/+-]{16,}
        |\b(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|gh[pousr]_[A-Za-z0-9]{36})\b)
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<ipv4>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d))
    |(?P<date>(?<![\d.\/-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}\/\d{2}\/\d{4})(?![\d\/-]|\.\d))
    |(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    |(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]))
    |(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\d-])
        |(?<![\w+(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?![\d-])
        |(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))
    """,
    regex.VERBOSE,
)
#: Bytes that any match has: texts without one need no search.
_HINT = regex.compile(r"[@\d:=]|AKIA|sk-|gh[pousr]_")
_FIRST, _LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
_SETS = (string.digits, string.ascii_lowercase, string.ascii_uppercase)


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, key: bytes, n: int, tweak: bytes):
        self.n = n
        bits = max(2, (n - 1).bit_length())
        self.low, self.high = bits // 2, bits - bits // 2
        self.state = hmac.new(key, tweak, hashlib.sha256).digest()

    def _part(self, i: int, value: int, bits: int) -> int:
        block, out = value.to_bytes((value.bit_length() + 7) // 8 or 1, "big"), b""
        for j in range(-(-bits // 256)):
            out += hashlib.blake2b(bytes((i, j)) + block, key=self.state, digest_size=32).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _pass(self, x: int) -> int:
        a, b, p, q = x >> self.low, x & ((1 << self.low) - 1), self.high, self.low
        for i in range(ROUNDS):
            a, b, p, q = b, a ^ self._part(i, b, p), q, p
        return a << q | b

    def _back(self, x: int) -> int:
        a, b, p, q = x >> self.low, x & ((1 << self.low) - 1), self.high, self.low  # an even number of rounds
        for i in reversed(range(ROUNDS)):
            a, b, p, q = b ^ self._part(i, a, q), a, q, p
        return a << q | b

    def _walk(self, step: Callable[[int], int], x: int) -> int:
        x = step(x)
        while x >= self.n:
            x = step(x)
        return x

    def __call__(self, x: int) -> int:
        """A permutation of range(n) without fixed points (for n > 1)."""
        return self._walk(self._back, (self._walk(self._pass, x) + 1) % self.n)


def _permuted(key: bytes, kind: str, value: str, kept: frozenset[int] = frozenset()) -> str:
    """Digits and letters of value, but for places in kept, permuted within their sets."""
    places = [(i, s) for i, c in enumerate(value) if i not in kept for s in _SETS if c in s]
    if not places:
        return value
    n, x = 1, 0
    for i, s in places:
        n, x = n * len(s), x * len(s) + s.index(value[i])
    shape = list(value)
    for i, s in places:
        shape[i] = "0aA"[_SETS.index(s)]
    y = Feistel(key, n, f"{kind}:{''.join(shape)}".encode())(x)
    out = list(value)
    for i, s in reversed(places):
        y, r = divmod(y, len(s))
        out[i] = s[r]
    return "".join(out)


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _email(key: bytes, v: str) -> str:
    at, dot = v.index("@"), v.rindex(".")
    return _permuted(key, "email", v, frozenset({at, *range(dot, len(v))}))


def _card(key: bytes, v: str) -> str | None:
    places = [i for i, c in enumerate(v) if c.isdigit()]
    digits = "".join(v[i] for i in places)
    if luhn(digits) or len(set(digits)) == 1:
        return None
    new = _permuted(key, "card", digits[:-1], frozenset({0}))
    new += str(-luhn(new + "0") % 10)
    out = list(v)
    for i, c in zip(places, new, strict=True):
        out[i] = c
    return "".join(out)


def _phone(key: bytes, v: str) -> str | None:
    if not 7 <= sum(c.isdigit() for c in v) <= 15:
        return None
    lead = len(regex.match(r"(?:\+\d{1,3}(?=[ .(-]))?", v)[0])
    places = [i for i in range(lead, len(v)) if v[i].isdigit()]
    new = _permuted(key, "phone", "".join(v[i] for i in places))
    out = list(v)
    for i, c in zip(places, new, strict=True):
        out[i] = c
    return "".join(out)


def _ipv4(key: bytes, v: str) -> str | None:
    parts = v.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    y = Feistel(key, 1 << 32, b"ipv4")(int.from_bytes(bytes(map(int, parts)), "big"))
    return ".".join(map(str, y.to_bytes(4, "big")))


def _ssn(key: bytes, v: str) -> str | None:
    area, group, serial = v.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    # areas 1 to 665 and 667 to 899, groups from 1, serials from 1
    x = ((int(area) - 1 - (area > "666")) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    x, last = divmod(Feistel(key, 898 * 99 * 9999, b"ssn")(x), 9999)
    first, middle = divmod(x, 99)
    return f"{first + 1 + (first >= 665):03d}-{middle + 1:02d}-{last + 1:04d}"


def _mod97(v: str) -> int:
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97


def _iban(key: bytes, v: str) -> str | None:
    plain = v.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    new = _permuted(key, "iban", plain, frozenset(range(4)))
    new = plain[:2] + f"{98 - _mod97(plain[:2] + '00' + new[4:]):02d}" + new[4:]
    out, it = list(v), iter(new)
    return "".join(c if c == " " else next(it) for c in out)


def _date(key: bytes, v: str) -> str | None:
    form = "%Y-%m-%d" if v[4] == "-" else "%d.%m.%Y" if "." in v else "%m/%d/%Y"
    try:
        day = dt.datetime.strptime(v, form).date().toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    new = dt.date.fromordinal(_FIRST + Feistel(key, _LAST - _FIRST + 1, b"date")(day - _FIRST))
    return new.strftime(form)


def _secret(key: bytes, v: str) -> str:
    kept = next((p for p in PREFIXES if v.startswith(p)), "")
    return kept + _permuted(key, "secret", v[len(kept) :])


_MAKE: dict[str, Callable[[bytes, str], str | None]] = {"email": _email, "secret": _secret, "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
KINDS = tuple(_MAKE)


@lru_cache(maxsize=50_000)
def pseudonym(key: bytes, kind: str, value: str) -> str | None:
    """The pseudonym of a value of a kind, or None where the value is not valid."""
    return _MAKE[kind](key, value)


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, length, kind) of each in it, in characters."""
    if not _HINT.search(text):
        return text, []
    out, spans, at, size = [], [], 0, 0
    pos = 0
    while m := _KINDS.search(text, pos):
        kind, value = m.lastgroup, m[0]
        new = pseudonym(key, kind, value)
        if new is None:  # not valid as this kind; what follows its first character may hold another
            pos = m.start() + 1
            while pos < m.end() and text[pos].isdigit() and text[pos - 1].isdigit():
                pos += 1
            continue
        out += [text[at : m.start()], new]
        spans.append((size + m.start() - at, len(new), kind))
        size += m.start() - at + len(new)
        at = pos = m.end()
    return "".join((*out, text[at:])), spans


def _run(key: bytes):
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_blocks(batches):  # bounded blocks of whole texts
            texts, spans = [], []
            for text in t["text"].to_pylist():
                new, found = (None, []) if text is None else pseudonymise(text, key)
                texts.append(new)
                spans.append([{"start": s, "length": n, "kind": k} for s, n, k in found])
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(texts, pa.string()), pa.array(spans, span)], names=["doc_id", "text", "spans"])

    return run


def with_pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text with pseudonyms, spans of them."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(key), "doc_id long, text string, spans array<struct<start:int,length:int,kind:string>>")


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_pseudonyms(spark.read.parquet(f"{sf_dir}/documents.parquet"), TEST_KEY)
    return found.select("doc_id", "text", F.size("spans").alias("n_replaced"), F.concat_ws(",", "spans.kind").alias("kinds"))
