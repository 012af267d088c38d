"""Format-preserving pseudonyms for personal data.

A value found in a text is validated (Luhn and mod-97 check digits, calendar
dates, octets, digit counts, area and serial numbers), read as a number in the
mixed radix of its format, and permuted within that format by a keyed Feistel
network. Cycle walking keeps it inside the values that the same validation
accepts, and check digits are computed anew, so a pseudonym is valid too. Equal
values become equal pseudonyms in every document, whatever their spacing and,
in mail addresses and account numbers, their case.

Kinds: email (letters of any script, each permuted within its own), card, iban
(either case), ssn, phone (with separators, international, or ten unbroken
digits of a valid North American number), ipv4, ipv6, date (years 1900 to 2099),
hexadecimal secrets of 32 digits or more, access keys that their prefix
tells, and passwords: values with a letter and a digit that a word like
`password` or `token` and `:` or `=` introduce. Numbers that fail validation
stay; of an iban or phone that does, the groups after the value are left off. A
date like 03/04/2020 is read day first; one that can only be month first so.

Defined results: null text stays null, other text is returned whole with only
the values replaced; rows that repeat are treated alike; counts are 0 where
nothing is found.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from .bytesops import column_bytes, worker_cache
from .store import narrow, small_batches

ROUNDS = 10
KINDS = ("email", "card", "iban", "ssn", "phone", "ipv4", "ipv6", "date", "secret", "key", "password")
#: Alphabets that a character of a format may be drawn from; others follow from the character (see _alphabet).
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Length of an account number by country (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: What access keys of common services begin with, and what follows (fixed values).
KEY_FORMATS = (
    (r"A[KS]IA", r"[A-Z0-9]{16}"), (r"gh[pousr]_", r"[A-Za-z0-9]{36,}"), (r"github_pat_", r"[A-Za-z0-9_]{22,}"), (r"glpat-", r"[A-Za-z0-9_-]{20,}"), (r"xox[abprs]-", r"[A-Za-z0-9-]{10,}"),
    (r"AIza", r"[A-Za-z0-9_-]{35}"), (r"[sr]k_(?:live|test)_", r"[A-Za-z0-9]{16,}"), (r"sk-", r"[A-Za-z0-9_-]{20,}"), (r"npm_", r"[A-Za-z0-9]{36}"), (r"eyJ", r"[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}"),
)

_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?"
_PHONE = r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[1-9][0-9]{7,14}|\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}|[2-9][0-9]{9}"
_SECRET = r"(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})"
_KEY = "|".join(f"{before}{after}" for before, after in KEY_FORMATS)
_FOUND = re.compile(
    r"(?<![\w.%+-])(?P<email>[\w.%+-]+(?:'[\w.%+-]+){0,8}@(?:[\w-]+\.)+(?:xn--[A-Za-z0-9-]+|[^\W\d_]{2,}))"
    r"|(?<![\w.])(?:"
    rf"(?P<secret>{_SECRET})"
    rf"|(?P<key>{_KEY})"
    rf"|(?P<iban>{_IBAN})"
    r"|(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})"
    r"|(?<!:)(?P<ipv6>(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}))(?!:)"
    r"|(?P<ipv4>[0-9]{1,3}(?:\.[0-9]{1,3}){3})"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})"
    rf"|(?P<phone>{_PHONE})(?!-[0-9]{{2}}-[0-9]{{4}})"
    r"|(?P<card>[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}(?P<gap2>[ -])[0-9]{6}(?P=gap2)[0-9]{5})"
    r")(?!\w)"
    r"|(?<![A-Za-z])(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?(?P<password>[^\s\"',;<>(){}]{6,})"
)
#: Kinds whose match may run on into the groups that follow the value.
_OPEN = {"iban": re.compile(_IBAN), "phone": re.compile(_PHONE)}
_PREFIX = re.compile("|".join(f"(?:{before})(?={after})" for before, after in KEY_FORMATS))
_RAW_PREFIX = re.compile("|".join(before for before, _ in KEY_FORMATS).encode())


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    named = size if size.bit_length() < 14000 else hex(size)  # Python writes no decimal of more than 4300 digits
    while True:
        left, right = value >> half, value & mask
        for k in range(ROUNDS):
            mac = hashlib.shake_256(key + f"/{tweak}/{named}/{k}/".encode() + right.to_bytes(width, "big"))
            left, right = right, left ^ (int.from_bytes(mac.digest(width), "big") & mask)
        value = left << half | right
        if value < size:
            return value


@lru_cache(1 << 16)
def _alphabet(c: str) -> str | None:
    """The characters that may stand for c; None if c stays.

    Beyond the listed ones: the ten digits of a script, and the letters of one
    category among the 128 code points about c, those with a counterpart in
    the other case apart from those without.
    """
    for known in _ALPHABETS:
        if c in known:
            return known
    kind = unicodedata.category(c)
    if kind == "Nd":
        zero = ord(c) - unicodedata.digit(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if kind[0] != "L":
        return None
    cased = lambda x: len(x.swapcase()) == 1 and x.swapcase() != x and x.swapcase().swapcase() == x
    first = ord(c) & ~127
    return "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind and cased(x) == cased(c) and not any(x in known for known in _ALPHABETS))


def _folded(text: str) -> tuple[str, list[bool]]:
    """Lower case of the letters that have one letter for it, and which these are."""
    low = [c.lower() if len(c.lower()) == 1 and c.lower() != c and c.lower().upper() == c else c for c in text]
    return "".join(low), [a != b for a, b in zip(low, text, strict=True)]


def _permuted(text: str, key: bytes, tweak: str, fold: bool = False) -> str:
    """The letters and digits of text permuted together, each within its alphabet; the rest stays. fold: whatever their case, which is kept."""
    upper: list[bool] = []
    if fold:
        text, upper = _folded(text)
    spots = [(i, a, a.index(c)) for i, c in enumerate(text) if (a := _alphabet(c))]
    value, size = 0, 1
    for _, alphabet, k in spots:
        value, size = value * len(alphabet) + k, size * len(alphabet)
    if size == 1:
        return text
    form = ".".join(f"{ord(a[0]):x}" for _, a, _ in spots)
    value, out = feistel(value, size, key, f"{tweak}:{form}"), list(text)
    for i, alphabet, _ in reversed(spots):
        value, k = divmod(value, len(alphabet))
        out[i] = alphabet[k].upper() if fold and upper[i] else alphabet[k]
    return "".join(out)


def _walked(text: str, key: bytes, tweak: str, kind: Callable[[str], object]) -> str:
    """text permuted among the texts of its form that `kind` says the same of."""
    own, new = kind(text), _permuted(text, key, tweak)
    while kind(new) != own:
        new = _permuted(new, key, tweak)
    return new


def valid_ssn(digits: str) -> bool:
    return not (digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000")


def north_american(digits: str) -> bool:
    """Whether ten digits are a number of the North American plan."""
    return re.fullmatch(r"[2-9](?!11)[0-8][0-9][2-9](?!11)[0-9]{6}", digits) is not None


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(payload)))
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _into(form: str, digits: str) -> str:
    """digits in the places of the letters and digits of form."""
    rest = iter(digits)
    return "".join(next(rest) if c.isalnum() else c for c in form)


def _date(text: str, key: bytes) -> str | None:
    iso = text[4] == "-"
    y, m, d = (int(x) for x in (text.split("-") if iso else reversed(re.split(r"[./]", text))))
    swapped = not iso and m > 12  # month first
    try:
        day = datetime.date(y, d, m) if swapped else datetime.date(y, m, d)
    except ValueError:
        return None
    if not _FIRST <= day.toordinal() <= _LAST:
        return None
    new = datetime.date.fromordinal(_FIRST + feistel(day.toordinal() - _FIRST, _LAST - _FIRST + 1, key, "date"))
    parts = (new.year, new.month, new.day) if iso else (new.month, new.day, new.year) if swapped else (new.day, new.month, new.year)
    return _into(text, "".join(f"{x:04d}" if x > 99 else f"{x:02d}" for x in parts))


def _account(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "").upper()
    length = IBAN_LENGTHS.get(plain[:2])
    known = length == len(plain) if length else text.upper() == text and 15 <= len(plain) <= 34
    if not known or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    new = _permuted(plain[4:], key, "iban")
    put = _into(text, plain[:2] + iban_digits(plain[:2], new) + new)
    # letters keep their case; a letter only ever stands for a letter
    return "".join(n.lower() if c.islower() else n for c, n in zip(text, put, strict=True))


def _address(text: str, key: bytes) -> str | None:
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    if not any(c.isdigit() for c in text) or len(re.findall(r"[0-9A-Fa-f]+", text)) < 2:
        return None
    new = str(ipaddress.IPv6Address(feistel(value, 1 << 128, key, "ipv6")))
    return new.upper() if text.upper() == text and text.lower() != text else new


def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """The pseudonym of a found value; None if it fails validation."""
    digits = "".join(c for c in text if c.isdigit())
    if kind == "email":
        local, _, domain = text.rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{_permuted(local, key, 'local', True)}@{_permuted(name, key, 'domain', True)}.{top}"
    if kind == "card":
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        # all digits alike are no card number, so they are no pseudonym either
        new = _walked(digits[:-1], key, "card", lambda d: len(set(d + luhn_digit(d))) == 1)
        return _into(text, new + luhn_digit(new))
    if kind == "iban":
        return _account(text, key)
    if kind == "ssn":
        return _into(text, _walked(digits, key, "ssn", valid_ssn)) if valid_ssn(digits) else None
    if kind == "phone":
        if not 8 <= len(digits) <= 15 or text.isdigit() and not north_american(digits):
            return None
        national = digits[-10:]
        return _into(text, digits[: len(digits) - len(national)] + _walked(national, key, "phone", lambda d: (north_american(d), d[0] == "0")))
    if kind == "ipv4":
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255:
            return None
        new = feistel(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ipv4")
        return ".".join(str(b) for b in new.to_bytes(4, "big"))
    if kind == "ipv6":
        return _address(text, key)
    if kind == "date":
        return _date(text, key)
    if kind == "key":
        known = _PREFIX.match(text).end()
        return text[:known] + _permuted(text[known:], key, "key")
    if kind == "password":
        other = _FOUND.fullmatch(text)  # a value of another kind keeps that kind's format
        if other and other.lastgroup != "password" or "://" in text or not (digits and any(c.isalpha() for c in text)):
            return None
        return _permuted(text, key, "password")
    new = feistel(int(text, 16), 1 << (4 * len(text)), key, "secret")
    return f"{new:0{len(text)}X}" if text.upper() == text else f"{new:0{len(text)}x}"


def _cached(key: bytes):
    cache = worker_cache().setdefault("pseudonyms", {})
    if key not in cache:
        short = lru_cache(1 << 16)(lambda kind, text: pseudonym(kind, text, key))
        cache[key] = lambda kind, text: short(kind, text) if len(text) <= 256 else pseudonym(kind, text, key)
    return cache[key]


def _prefixes(kind: str, text: str):
    """A match, then what is left of it without its last group, its last two groups and so on."""
    yield text
    if kind in _OPEN:
        for end in range(len(text) - 1, 0, -1):
            if not text[end].isalnum() and _OPEN[kind].fullmatch(text, 0, end):
                yield text[:end]


def replace(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind were replaced."""
    found, counts, out, at, look = _cached(key), dict.fromkeys(KINDS, 0), [], 0, 0
    while m := _FOUND.search(text, look):
        kind = m.lastgroup
        first = m.start(kind)
        for value in _prefixes(kind, m.group(kind)):
            if (new := found(kind, value)) is not None:
                break
        else:  # what fails validation may hold a value that does not
            look = m.start() + 1
            continue
        out += (text[at:first], new)
        counts[kind] += 1
        at = look = first + len(value)
    return "".join((*out, text[at:])), counts


def _replaced(key: bytes, at: int):
    """Puts the new texts in place of column `at` and the counts after all columns."""
    mark = np.zeros(256, bool)
    mark[48:58] = mark[64] = True

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            data, offsets, _ = column_bytes(column)
            # only texts with a digit, an @ or the beginning of a key can hold a value
            full = np.flatnonzero(np.diff(offsets))
            some = np.zeros(batch.num_rows, bool)
            if len(full):
                some[full] = np.logical_or.reduceat(mark[data], offsets[:-1][full])
            for m in _RAW_PREFIX.finditer(memoryview(data)):
                some[np.searchsorted(offsets, m.start(), side="right") - 1] = True
            counts = np.zeros((batch.num_rows, len(KINDS)), np.int64)
            if some.any():
                texts = column.to_pylist()
                for i in np.flatnonzero(some):
                    texts[i], own = replace(texts[i], key)
                    counts[i] = [own[k] for k in KINDS]
                column = pa.array(texts, column.type)
            columns = [*batch.columns, *(pa.array(counts[:, k].copy()) for k in range(len(KINDS)))]
            columns[at] = column
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f"n_{k}" for k in KINDS)])

    return run


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with pseudonyms in text, and after its columns a count n_<kind> for each kind."""
    small_batches(docs.sparkSession)
    fields = [*docs.schema.fields, *(StructField(f"n_{k}", LongType()) for k in KINDS)]
    return docs.mapInArrow(_replaced(key, docs.columns.index("text")), StructType(fields))


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, and the counts: one row for each row of docs."""
    return replaced(narrow(docs), key)
