"""PII: format-preserving Feistel pseudonyms.

Found values are read into mixed-radix digits (decimal, hexadecimal, letters of their own alphabet) and permuted with a keyed
Feistel network over that format, so the result has the same shape, different values stay different, and equal values
(whatever their separators or case) get equal pseudonyms in all documents. Check digits are validated before and recomputed
after; dates move within 1900-2099 and stay dates of the same widths. A format that is only part of a network's numbers
(valid dates, numbers that fail a check) is permuted by walking on until the result is in it again. ``restored`` undoes it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "phone", "card", "iban", "ssn", "secret", "date", "number")
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
ROUNDS = 10
# The forms that issuers give their keys and tokens.
PREFIXED = r"""(?:(?:sk|pk|rk)[-_](?:[A-Za-z0-9]{1,16}[-_])*[A-Za-z0-9]{16,} | (?:AKIA|ASIA)[0-9A-Z]{16} | gh[pousr]_[A-Za-z0-9]{36,}
    | github_pat_[A-Za-z0-9_]{22,} | glpat-[A-Za-z0-9_-]{20,} | xox[abeprs]-[A-Za-z0-9-]{10,} | AIza[0-9A-Za-z_-]{35} | hf_[A-Za-z0-9]{30,} | eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"""
PREFIX = re.compile(r"(?:sk|pk|rk)[-_](?:(?:live|test|proj|ant|svcacct|admin)[-_])*|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|AIza|hf_|eyJ|")

PATTERN = re.compile(
    rf"""(?P<email>[\w.+-]{{1,64}}@[\w-]+(?:\.[\w-]+)+)
    |(?P<token>(?<![0-9A-Za-z_-]){PREFIXED}(?![0-9A-Za-z_-]))
    |(?P<secret>(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{{64}}|[0-9a-f]{{40}}|[0-9a-f]{{32}}|[0-9A-F]{{64}}|[0-9A-F]{{40}}|[0-9A-F]{{32}})(?![0-9A-Za-z]))
    |(?P<iban>(?<![0-9A-Za-z])[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?![0-9A-Za-z]))
    |(?P<ip>(?<![0-9.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?!\.?[0-9]))
    |(?P<date>(?<![0-9])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.][0-9]{{4}})(?![0-9]))
    |(?P<ssn>(?<![0-9-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9-]))
    |(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){{12,18}}(?![0-9]))
    |(?P<phone>(?<![0-9A-Za-z])(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{2,4}}\)[ .-]?)?[0-9]{{3,4}}[ .-][0-9]{{3,4}}(?:[ .-][0-9]{{3,4}})?(?![0-9]))
    |(?P<number>(?<![0-9A-Za-z.])\+?[0-9]{{8,34}}(?![0-9A-Za-z]))""",
    re.VERBOSE,
)

#: (digits, radices, name of the format) -> digits: a keyed permutation, or its inverse.
Permutation = Callable[[list[int], list[int], str], list[int]]


def permuted(digits: list[int], radices: list[int], key: bytes, tweak: str, back: bool = False) -> list[int]:
    """A keyed permutation of the numbers with these radices: an unbalanced Feistel network on two halves; ``back`` undoes it."""
    if not digits:
        return digits
    sign = -1 if back else 1
    if len(digits) == 1:  # one digit: a keyed rotation
        return [(digits[0] + sign * _round(key, tweak, 0, 0, radices[0])) % radices[0]]
    half = len(digits) // 2

    def packed(lo: int, hi: int) -> tuple[int, int]:
        v, n = 0, 1
        for d, r in zip(digits[lo:hi], radices[lo:hi], strict=True):
            v, n = v * r + d, n * r
        return v, n

    (a, na), (b, nb) = packed(0, half), packed(half, len(digits))
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if i % 2:
            b = (b + sign * _round(key, tweak, i, a, nb)) % nb
        else:
            a = (a + sign * _round(key, tweak, i, b, na)) % na
    out = []
    for v, rs in ((b, radices[half:]), (a, radices[:half])):
        own = []
        for r in reversed(rs):
            v, d = divmod(v, r)
            own.append(d)
        out = own[::-1] + out
    return out


def _round(key: bytes, tweak: str, i: int, value: int, modulus: int) -> int:
    h = hashlib.blake2b(f"{tweak}|{i}|{modulus}|{value}".encode(), key=key, digest_size=64)
    return int.from_bytes(h.digest(), "big") % modulus


def permutation(key: bytes, back: bool = False) -> Permutation:
    return lambda digits, radices, tweak: permuted(digits, radices, key, tweak, back)


def _walked(digits: list[int], radices: list[int], perm: Permutation, tweak: str, fits: Callable[[list[int]], bool]) -> list[int]:
    """The permutation restricted to the numbers that fit, among which ``digits`` is: on and on until the result fits."""
    out = perm(digits, radices, tweak)
    while not fits(out):
        out = perm(out, radices, tweak)
    return out


def luhn_digit(digits: list[int]) -> int:
    total = sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(reversed(digits)))
    return -total % 10


def luhn_valid(digits: list[int]) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def iban_check(country: str, rest: str) -> str:
    n = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - n % 97:02d}"


def _refilled(value: str, chars: list[str], which) -> str:
    it = iter(chars)
    return "".join(next(it) if which(c) else c for c in value)


_DIGIT = "0123456789".__contains__


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """The characters that one may stand for another of: decimal digits of one script, or the lower-case letters (or those without case) of a block of 256; "" for others."""
    if c.isdecimal():
        return "".join(chr(ord(c) - unicodedata.decimal(c) + i) for i in range(10))
    if "a" <= c <= "z":
        return "abcdefghijklmnopqrstuvwxyz"
    start = ord(c) & ~255
    own = [x for x in map(chr, range(start, start + 256)) if x.isalpha() and x > "\x7f" and x.lower() == x and len(x.upper()) == 1 and x.upper().lower() == x]
    return "".join(own) if c in own else ""


def _chars(value: str, perm: Permutation, tweak: str) -> str:
    """Letters stay letters of their alphabet (their case too), digits stay digits; other characters stay. Equal but for case: linked."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in value]
    alphabets = [_alphabet(c) for c in low]
    at = [i for i, a in enumerate(alphabets) if a]
    radices = [len(alphabets[i]) for i in at]
    out = list(value)
    for i, d in zip(at, perm([alphabets[i].index(low[i]) for i in at], radices, tweak), strict=True):
        c = alphabets[i][d]
        out[i] = c.upper() if value[i] != low[i] else c
    return "".join(out)


def _digits(value: str, perm: Permutation, tweak: str, fits: Callable[[list[int]], bool] = lambda _: True) -> str:
    d = [int(c) for c in value if _DIGIT(c)]
    return _refilled(value, [str(x) for x in _walked(d, [10] * len(d), perm, tweak, fits)], _DIGIT)


def _day(day: int, perm: Permutation, fits: Callable[[date], bool] = lambda _: True) -> int:
    """Permute a day number within the range, from 17 bits down, until the date fits."""
    v = day - FIRST_DAY

    def inside(d: list[int]) -> bool:
        n = d[0] << 9 | d[1]
        return n <= LAST_DAY - FIRST_DAY and fits(date.fromordinal(FIRST_DAY + n))

    d = _walked([v >> 9, v & 511], [256, 512], perm, "date", inside)
    return FIRST_DAY + (d[0] << 9 | d[1])


def _date(value: str, perm: Permutation) -> str | None:
    """A date of the same order and widths; day first if that is a date, else month first (and so is the result: its day is over 12)."""
    parts, seps = re.split(r"[-/.]", value), re.findall(r"[-/.]", value)
    orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1))
    for o in orders:
        try:
            d = date(*(int(parts[i]) for i in o))
        except ValueError:
            continue
        if not FIRST_DAY <= d.toordinal() <= LAST_DAY:
            return None
        narrow = [i for i in range(3) if len(parts[i]) == 1]
        field = lambda n, i: (n.year, n.month, n.day)[o.index(i)]  # noqa: E731, B023
        month_first = o == (2, 0, 1)
        n = date.fromordinal(_day(d.toordinal(), perm, lambda n: all(field(n, i) < 10 for i in narrow) and (n.day > 12 or not month_first)))  # noqa: B023
        new = [str(field(n, i)).zfill(len(parts[i])) for i in range(3)]
        return new[0] + seps[0] + new[1] + seps[1] + new[2]
    return None


def _plain_card(d: list[int]) -> bool:
    """Long digits that are no card number."""
    return not luhn_valid(d) or len(set(d)) == 1


def _ssn(d: list[int]) -> bool:
    return d[:3] not in ([0, 0, 0], [6, 6, 6]) and d[0] != 9 and d[3:5] != [0, 0] and d[5:] != [0, 0, 0, 0]


def pseudonym(kind: str, value: str, perm: Permutation) -> tuple[str, str] | None:
    """(kind, pseudonym), or None if the value doesn't validate and is no personal number of another kind."""
    if kind == "email":
        local, _, domain = value.partition("@")
        *labels, last = domain.split(".")  # every label but the last is hidden, each for itself, so one domain stays one under all its names
        return kind, f"{_chars(local, perm, 'local')}@{'.'.join([*(_chars(x, perm, 'label') for x in labels), last])}"
    if kind == "token":
        at = PREFIX.match(value).end()
        return "secret", value[:at] + _chars(value[at:], perm, "token" + value[:at])
    if kind == "secret":
        low = value.lower()
        both = lambda d: min(d) < 10 <= max(d)
        out = "".join("0123456789abcdef"[d] for d in _walked([int(c, 16) for c in low], [16] * len(low), perm, "secret", both))
        return kind, out if low == value else out.upper()
    if kind == "ip":
        parts = [int(x) for x in value.split(".")]
        return (kind, ".".join(map(str, perm(parts, [256] * 4, "ip")))) if max(parts) < 256 and all(str(int(x)) == x for x in value.split(".")) else None
    if kind == "date":
        return (kind, new) if (new := _date(value, perm)) else None
    if kind == "iban":
        flat = value.replace(" ", "")
        if len(flat) < 15 or iban_check(flat[:2], flat[4:]) != flat[2:4]:
            return None
        rest = _chars(flat[4:], perm, f"iban{flat[:2]}")
        return kind, _refilled(value, list(flat[:2] + iban_check(flat[:2], rest) + rest), lambda c: c != " ")
    d = [int(c) for c in value if _DIGIT(c)]
    if kind == "card":
        if not _plain_card(d):
            own = _walked(d[:-1], [10] * (len(d) - 1), perm, "card", lambda x: not _plain_card([*x, luhn_digit(x)]))
            return kind, _refilled(value, [str(x) for x in [*own, luhn_digit(own)]], _DIGIT)
        return "number", _digits(value, perm, "number", _plain_card)
    if kind == "ssn":
        return (kind, _digits(value, perm, "ssn", _ssn)) if _ssn(d) else None
    if kind == "phone":
        if not 10 <= len(d) <= 15 or not re.search(r"[+()]|[ .-].*[ .-]", value):
            return None
        keep = len(re.match(r"(?:\+[0-9]{1,3}(?=[ .(-]))?", value).group())
        return kind, value[:keep] + _digits(value[keep:], perm, "phone")
    return "number", _digits(value, perm, "number")


def pseudonymised(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind; ``back`` puts the values in the place of the pseudonyms again."""
    counts: dict[str, int] = {}
    perm = permutation(key, back)

    def new(m: re.Match) -> str:
        got = pseudonym(m.lastgroup, m.group(), perm)
        if got is None:
            return m.group()
        counts[got[0]] = counts.get(got[0], 0) + 1
        return got[1]

    return PATTERN.sub(new, text), counts


def restored(text: str, key: bytes) -> str:
    """The text that ``pseudonymised`` made this of."""
    return pseudonymised(text, key, back=True)[0]


def secret_of(key: str | None) -> bytes:
    """The permutation's secret; a missing or empty key is an error, there is no default."""
    if not key:
        raise ValueError("a key is needed: whoever knows it can undo the pseudonyms, so there is no default")
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


MARK = re.compile(r"[0-9@]|eyJ|gh[pousr]_|xox|AIza|glpat|github_pat|hf_|(?:sk|pk|rk)[-_]|AKIA|ASIA|[A-Fa-f]{32}")


def protected(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_email, n_ip, ...): every row with pseudonyms in its whole text and counts of each kind.

    ``key`` is the secret of the permutation: whoever has it can undo the pseudonyms (``restored``); without one it raises.
    Null text stays null with zero counts, an empty one empty; long texts are read whole. doc_id is passed on as it is, null
    and repeated ones too: each row is treated for itself, equal rows alike. Other columns are left out, whatever their names.
    Empty for an empty table.
    """
    secret = secret_of(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for t in b.column(1):
                text, found = t.as_py(), {}
                if text and MARK.search(text):
                    text, found = pseudonymised(text, secret)
                texts.append(text)
                counts.append(found)
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), *(pa.array([c.get(k, 0) for c in counts], pa.int32()) for k in KINDS)], names=["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, " + ", ".join(f"n_{k} int" for k in KINDS))
