"""PII: format-preserving Feistel pseudonyms.

Values that pass their check (Luhn numbers, phones, addresses, dates, ...) are
permuted by a keyed Feistel network over the numbers of their format, walked on
until the result passes the same check. Equal values get equal pseudonyms in all
documents, different values different ones, and without the key none can be
traced back. One pass over the rows, no shuffle, nothing shared between tasks.

Digits are 0-9: those of other scripts begin, make up and end no value but an
email's local part, where they count as letters do.

Nulls and edges: a null text stays null with no finds; values that fail their
check stay; overlapping candidates are taken from the left, the first kind of
KINDS first; an empty table yields an empty table; all other columns are kept.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.llm.common import free_name, slices

ROUNDS = 10
#: For tests and benchmarks only; give your own.
EXAMPLE_KEY = b"meridia example key"

# Alphabets whose characters stand for each other.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
_ALPHABET = {c: a for a in ALPHABETS for c in a}
HEX = "0123456789abcdef"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

KINDS = {
    "email": r"(?<![\w.+-])[\w.+-]{1,64}@[\w-]+(?:\.[\w-]+)+",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w)",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]|\.[0-9])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?!\w)",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|-[0-9])",
}
_FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
_TRIGGER = re.compile(r"[0-9@]|[0-9A-Fa-f]{32}")


def permute(value: int, size: int, key: bytes, tweak: str, accept: Callable[[int], bool] = lambda x: True) -> int:
    """A keyed permutation of the accepted numbers below `size`.

    A Feistel network over a * b >= size places, walked on until the result is
    below `size` and accepted; `value` itself must be accepted.
    """
    if size <= 1:
        return value
    a = 1 << ((size.bit_length() + 1) // 2)
    b = -(-size // a)
    while True:
        left, right, m, n = value // a, value % a, b, a
        for k in range(ROUNDS):
            mixed = hmac.new(key, f"{tweak}/{size}/{k}/{right}".encode(), hashlib.sha256).digest()
            # the more bits than places, the more even
            left, right, m, n = right, (left + int.from_bytes(mixed + hashlib.sha256(mixed).digest(), "big")) % m, n, m
        value = left * n + right
        if value < size and accept(value):
            return value


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refill(shape: str, keep: Callable[[str], bool], chars: str) -> str:
    """`shape` with the characters that `keep` names replaced in order."""
    rest = iter(chars)
    return "".join(next(rest) if keep(c) else c for c in shape)


@lru_cache(maxsize=1 << 14)
def _alphabet(c: str) -> str | None:
    """The characters that stand for c: its alphabet, or the letters (or numbers) of its kind among 256 code points; None for marks."""
    if c in _ALPHABET:
        return _ALPHABET[c]
    kind, start = unicodedata.category(c), ord(c) & ~0xFF
    if kind[0] not in "LN":
        return None
    return "".join(x for x in map(chr, range(start, start + 256)) if x not in _ALPHABET and unicodedata.category(x) == kind)


def _letters(text: str, key: bytes, tweak: str) -> str | None:
    """Every letter and number replaced within its alphabet, as one number; None if there is nothing to choose from."""
    value, size = 0, 1
    for c in text:
        if (alphabet := _alphabet(c)) is not None:
            value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
    if size == 1:
        return None
    value, out = permute(value, size, key, tweak), []
    for c in reversed(text):
        if (alphabet := _alphabet(c)) is not None:
            value, k = divmod(value, len(alphabet))
            c = alphabet[k]
        out.append(c)
    return "".join(reversed(out))


def _digits(text: str, key: bytes, tweak: str, accept: Callable[[str], bool] = lambda x: True) -> str | None:
    """The ASCII digits permuted as one number of as many places."""
    own = "".join(c for c in text if "0" <= c <= "9")
    if not accept(own):
        return None
    n = len(own)
    new = permute(int(own), 10**n, key, f"{tweak}{n}", lambda x: accept(str(x).zfill(n)))
    return _refill(text, lambda c: "0" <= c <= "9", str(new).zfill(n))


def email(text: str, key: bytes) -> str | None:
    """The domain stays; a local part of marks alone, such as `_@x.org`, names nobody and stays too."""
    local, at, domain = text.rpartition("@")
    new = _letters(local, key, "email")
    return None if new is None else new + at + domain


def card(text: str, key: bytes) -> str | None:
    return _digits(text, key, "card", luhn)


def phone(text: str, key: bytes) -> str | None:
    """The country code stays."""
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", text)[0]
    digits = sum("0" <= c <= "9" for c in text)
    return code + _digits(text[len(code) :], key, "phone" + code) if 8 <= digits <= 15 else None


def ssn(text: str, key: bytes) -> str | None:
    return _digits(text, key, "ssn", lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000")


def ip(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def secret(text: str, key: bytes) -> str | None:
    if text.isdigit():
        return None
    value = permute(int(text, 16), 16 ** len(text), key, f"hex{len(text)}")
    new = format(value, "x").zfill(len(text))
    return new.upper() if text.upper() == text else new


def iban(text: str, key: bytes) -> str | None:
    own = text.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(own) <= 34 or number(own[4:] + own[:4]) % 97 != 1:
        return None
    body = _letters(own[4:], key, "iban" + own[:2])
    check = 98 - number(body + own[:2] + "00") % 97
    return _refill(text, lambda c: c != " ", f"{own[:2]}{check:02d}{body}")


def _day(text: str) -> tuple[str, int] | None:
    """The format and day number of a date between 1900 and 2099, or None."""
    for form in ("%Y-%m-%d",) if "-" in text else ("%d.%m.%Y",) if "." in text else ("%m/%d/%Y", "%d/%m/%Y"):
        try:
            day = datetime.datetime.strptime(text, form).toordinal()
        except ValueError:
            continue
        return (form, day) if FIRST_DAY <= day <= LAST_DAY else None
    return None


def date(text: str, key: bytes) -> str | None:
    found = _day(text)
    if not found:
        return None
    form, day = found
    written = lambda x: datetime.date.fromordinal(FIRST_DAY + x).strftime(form)
    new = permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, form, lambda x: _day(written(x)) == (form, FIRST_DAY + x))
    return written(new)


PSEUDONYM = {"email": email, "iban": iban, "secret": secret, "ip": ip, "date": date, "phone": phone, "ssn": ssn, "card": card}


@lru_cache(maxsize=1 << 16)
def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """The value's pseudonym, or None if it fails its check."""
    return PSEUDONYM[kind](text, key)


def _taken(kind: str, text: str, m: re.Match, key: bytes) -> tuple[int, str] | None:
    """Where the candidate ends, and its pseudonym; None if it fails its check.

    The longest run that passes counts, shorter ones ending before a blank or a
    hyphen; a phone that runs into another value ends before it, if it is one without.
    """
    start, longest = m.start(), None
    for end in (m.end(), *(k for k in range(m.end() - 1, start, -1) if text[k] in " -")):
        if end < m.end() and not _ALONE[kind].fullmatch(text, start, end):
            continue
        new = pseudonym(kind, text[start:end], key)
        if new is None:
            continue
        if kind != "phone" or not _runs_into(text, start, end, key):
            return end, new
        longest = longest or (end, new)
    return longest


def _runs_into(text: str, start: int, end: int, key: bytes) -> bool:
    """Whether a value of another kind begins at a blank within the phone, after what is a phone already, and ends after it."""
    for k in range(start, end):
        if text[k] == " " and _ALONE["phone"].fullmatch(text, start, k) and pseudonym("phone", text[start:k], key) is not None:
            for other, pattern in _ALONE.items():
                if other != "phone" and (m := pattern.match(text, k + 1)) and (found := _taken(other, text, m, key)) and found[0] > end:
                    return True
    return False


def replace(text: str | None, key: bytes) -> tuple[str | None, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind it had."""
    counts: dict[str, int] = {}
    if not text or not _TRIGGER.search(text):
        return text, counts
    out, at, copied = [], 0, 0
    while m := _FINDER.search(text, at):
        kind = m.lastgroup
        found = _taken(kind, text, m, key)
        if found is None:  # what fails its check may still begin or hold another kind
            for other in list(KINDS)[list(KINDS).index(kind) + 1 :]:
                if (again := _ALONE[other].match(text, m.start())) and (found := _taken(other, text, again, key)) is not None:
                    kind, m = other, again
                    break
        if found is None:
            at = m.start() + 1
            while at < m.end() and text[at].isalnum() and text[at - 1].isalnum():
                at += 1
            continue
        out += (text[copied : m.start()], found[1])
        copied = at = found[0]
        counts[kind] = counts.get(kind, 0) + 1
    return "".join(out) + text[copied:], counts


_ALONE = {k: re.compile(p) for k, p in KINDS.items()}


def pseudonymised(docs: DataFrame, *, key: bytes = EXAMPLE_KEY, text: str = "text") -> DataFrame:
    """The given columns with pseudonyms in `text`, and `pii` (`_pii` if there is one): how many values of each kind."""
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    at = docs.columns.index(text)
    plain = docs.select(*own).withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    kinds = list(KINDS)
    schema = T.StructType([*plain.schema.fields, *[T.StructField(k, T.LongType()) for k in kinds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [replace(t, key) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([m[0] for m in made], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([m[1].get(k, 0) for m in made], pa.int64()) for k in kinds]], names=schema.fieldNames())

    found = plain.mapInArrow(run, schema)
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], F.struct(*kinds).alias(free_name(docs.columns, "pii")))


def remove(docs: DataFrame, **options) -> DataFrame:
    """The documents with pseudonyms, with the columns they came with; n_chars counts anew."""
    found = pseudonymised(docs, **options)
    text = options.get("text", "text")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
