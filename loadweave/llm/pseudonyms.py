"""Format-preserving pseudonyms of numbers and dates: keyed permutations inside the set of valid values of a format.

A value is ranked within its format's domain (only its free parts count), the rank is permuted by a keyed Feistel
network that is walked until it falls into the domain, and check letters and digits are computed anew. So equal values
get equal pseudonyms, different values different ones, valid numbers stay valid, and without the key nothing can be
turned back. A number that no format accepts has its digits and its letters permuted among themselves.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import math
import re
from collections.abc import Callable

# ---------------------------------------------------------------- permutations
def _round(key: bytes, i: int, n: int, half: int, modulus: int) -> int:
    d = hmac.new(key, b"%d|%d|%d" % (i, n, half), hashlib.sha256).digest()
    return int.from_bytes(d[:16], "big") % modulus


def feistel(value: int, domain: int, key: bytes, rounds: int = 8) -> int:
    """A keyed permutation of 0..domain-1: an unbalanced Feistel network over a * b >= domain, cycle-walked into it."""
    if domain < 2:
        return value
    a = b = math.isqrt(domain - 1) + 1
    x = value
    while True:
        left, right = divmod(x, b)
        for i in range(rounds):
            if i % 2 == 0:
                left = (left + _round(key, i, domain, right, a)) % a
            else:
                right = (right + _round(key, i, domain, left, b)) % b
        x = left * b + right
        if x < domain:
            return x


def walk(value: int, domain: int, key: bytes, ok: Callable[[int], bool]) -> int:
    """A permutation of the values that are ok: the larger one is walked until it meets one. The value itself must be ok."""
    while True:
        value = feistel(value, domain, key)
        if ok(value):
            return value


def rank(parts: list[int], bases: list[int]) -> int:
    out = 0
    for p, b in zip(parts, bases, strict=True):
        out = out * b + p
    return out


def parts(value: int, bases: list[int]) -> list[int]:
    out = []
    for b in reversed(bases):
        value, r = divmod(value, b)
        out.append(r)
    return out[::-1]


def permuted(values: list[int], bases: list[int], key: bytes) -> list[int]:
    return parts(feistel(rank(values, bases), math.prod(bases), key), bases)


def permute_format(item: str, key: bytes, keep: int = 0) -> str:
    """Permute the digits of an item among themselves and the letters likewise; punctuation, case and the first `keep` digits stay."""
    text = list(item)
    spots = [i for i, c in enumerate(text) if c.isdigit()][keep:]
    if spots:
        v = feistel(int("".join(text[i] for i in spots)), 10 ** len(spots), key + b"d%d" % len(spots))
        for i, c in zip(spots, str(v).zfill(len(spots)), strict=True):
            text[i] = c
    alpha = [i for i, c in enumerate(text) if c.isascii() and c.isalpha()]
    if alpha:
        new = parts(feistel(rank([ord(text[i].upper()) - 65 for i in alpha], [26] * len(alpha)), 26 ** len(alpha), key + b"a%d" % len(alpha)), [26] * len(alpha))
        for i, v in zip(alpha, new, strict=True):
            text[i] = chr(65 + v) if text[i].isupper() else chr(97 + v)
    return "".join(text)


# ---------------------------------------------------------------- numbers of persons
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed value: check letter by number mod 23
#: fixed values: letters and pairs that a British insurance number never begins with
_NO_FIRST, _NO_SECOND, _NO_PAIR = "DFIQUV", "DFIOQUV", ("BG", "GB", "NK", "KN", "TN", "NT", "ZZ")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NINO_PREFIXES = [a + b for a in _LETTERS if a not in _NO_FIRST for b in _LETTERS if b not in _NO_SECOND if a + b not in _NO_PAIR]
#: French departments by rule: 01-19, 2A, 2B, 21-95, and 96-99 for overseas and abroad
DEPARTMENTS = [f"{i:02d}" for i in range(1, 20)] + ["2A", "2B"] + [f"{i:02d}" for i in range(21, 100)]
_LEAP = [(m, d) for m in range(1, 13) for d in range(1, (dt.date(2000 + m // 12, m % 12 + 1, 1) - dt.timedelta(1)).day + 1)]
_LEAP_RANK = {x: i for i, x in enumerate(_LEAP)}


def _nino(s: str, key: bytes) -> str | None:
    """Two letters of the allowed ones, six digits, A to D."""
    if not re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", s) or s[:2] not in NINO_PREFIXES:
        return None
    a, n, b = permuted([NINO_PREFIXES.index(s[:2]), int(s[2:8]), ord(s[8]) - 65], [len(NINO_PREFIXES), 10**6, 4], key + b"nino")
    return f"{NINO_PREFIXES[a]}{n:06d}{_LETTERS[b]}"


def _licence(s: str, key: bytes) -> str | None:
    """British licence: surname, decade, month (women 50 more), day, year, initials, a digit, two letters; 9 stands for none."""
    m = re.fullmatch(r"([A-Z][A-Z9]{4})(\d)(\d\d)(\d\d)(\d)([A-Z9]{2})(\d)([A-Z]{2})", s)
    if not m:
        return None
    sex, month = divmod(int(m[3]), 50)
    if (month, int(m[4])) not in _LEAP_RANK or sex > 1:
        return None
    letters = m[1] + m[6] + m[8]
    free = [i for i, c in enumerate(letters) if c != "9"]
    bases = [10, 2, len(_LEAP), 10, 10] + [26] * len(free)
    decade, sex, day, year, digit, *new = permuted([int(m[2]), sex, _LEAP_RANK[month, int(m[4])], int(m[5]), int(m[7])] + [ord(letters[i]) - 65 for i in free], bases, key + b"licence%d" % len(free))
    out = list(letters)
    for i, v in zip(free, new, strict=True):
        out[i] = _LETTERS[v]
    month, day = _LEAP[day]
    return f"{''.join(out[:5])}{decade}{month + 50 * sex:02d}{day:02d}{year}{''.join(out[5:7])}{digit}{''.join(out[7:])}"


def _insee_key(body: str) -> int:
    return 97 - int(body.replace("2A", "19", 1) if body[5:7] == "2A" else body.replace("2B", "18", 1) if body[5:7] == "2B" else body) % 97


def _insee(s: str, key: bytes) -> str | None:
    """Sex, year, month, department, commune, order, and 97 less the number mod 97; a wrong key stays as wrong as it was."""
    m = re.fullmatch(r"([12])(\d\d)(\d\d)(\d\d|2[AB])(\d{3})(\d{3})(\d\d)", s)
    if not m or m[4] not in DEPARTMENTS or m[5] == "000" or m[6] == "000" or not (1 <= int(m[3]) <= 12 or int(m[3]) >= 20):
        return None
    # months from 20 on stand for unknown ones
    start, months = (1, 12) if int(m[3]) <= 12 else (20, 80)
    sex, yy, mm, dep, com, order = permuted([int(m[1]) - 1, int(m[2]), int(m[3]) - start, DEPARTMENTS.index(m[4]), int(m[5]) - 1, int(m[6]) - 1], [2, 100, months, len(DEPARTMENTS), 999, 999], key + b"insee")
    body = f"{sex + 1}{yy:02d}{mm + start:02d}{DEPARTMENTS[dep]}{com + 1:03d}{order + 1:03d}"
    off = int(m[7]) - _insee_key(s[:13])
    check = int(m[7]) if not 1 <= int(m[7]) <= 97 else (_insee_key(body) + off - 1) % 97 + 1
    return f"{body}{check:02d}"


def _dni(s: str, key: bytes) -> str | None:
    """Eight digits (or X, Y, Z and seven) and the letter of the number mod 23; a wrong letter stays a permuted one."""
    m = re.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", s)
    if not m or len(m[1]) + len(m[2]) != 8:
        return None
    first = "XYZ".index(m[1]) if m[1] else 0
    base = 10 ** len(m[2])
    valid = DNI_LETTERS[(first * 10**7 + int(m[2])) % 23] == m[3]
    lead, n = permuted([first, int(m[2])], [3 if m[1] else 1, base], key + (b"nie" if m[1] else b"dni"))
    letter = DNI_LETTERS[(lead * 10**7 + n) % 23] if valid else permute_format(m[3], key)
    return f"{'XYZ'[lead] if m[1] else ''}{n:0{len(m[2])}d}{letter}"


def _tax_check(body: str) -> int:
    """Check digit of a German tax number: ISO 7064, mod 11, 10."""
    p = 10
    for c in body:
        x = (int(c) + p) % 10 or 10
        p = 2 * x % 11
    return (11 - p) % 10


def _tax_body(n: int) -> bool:
    """Of its ten digits exactly one comes twice or three times."""
    counts = sorted(str(n).count(c) for c in set(str(n)))
    return n >= 10**9 and counts[-1] in (2, 3) and (len(counts) < 2 or counts[-2] == 1)


def _german_tax(s: str, key: bytes) -> str | None:
    if not re.fullmatch(r"[1-9]\d{10}", s) or not _tax_body(int(s[:10])) or _tax_check(s[:10]) != int(s[10]):
        return None
    n = walk(int(s[:10]), 10**10, key + b"tax", _tax_body)
    return f"{n}{_tax_check(str(n))}"


def _pension_check(body: str) -> int:
    """Check digit of a German pension number: the letter as two digits, fixed weights, sums of digits."""
    digits = body[:8] + f"{ord(body[8]) - 64:02d}" + body[9:]
    return sum(sum(map(int, str(int(c) * w))) for c, w in zip(digits, (2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1), strict=True)) % 10


def _german_pension(s: str, key: bytes) -> str | None:
    """Area, birth date, initial, serial, check digit."""
    m = re.fullmatch(r"(\d\d)(\d\d)(\d\d)(\d\d)([A-Z])(\d\d)(\d)", s)
    if not m or (int(m[3]), int(m[2])) not in _LEAP_RANK or _pension_check(s[:11]) != int(m[7]):
        return None
    area, day, yy, letter, serial = permuted([int(m[1]), _LEAP_RANK[int(m[3]), int(m[2])], int(m[4]), ord(m[5]) - 65, int(m[6])], [100, len(_LEAP), 100, 26, 100], key + b"pension")
    month, day = _LEAP[day]
    body = f"{area:02d}{day:02d}{month:02d}{yy:02d}{_LETTERS[letter]}{serial:02d}"
    return f"{body}{_pension_check(body)}"


def _spanish_insurance(s: str, key: bytes) -> str | None:
    """Ten digits and their number mod 97."""
    if not re.fullmatch(r"\d{12}", s) or int(s[:10]) % 97 != int(s[10:]):
        return None
    n = feistel(int(s[:10]), 10**10, key + b"nuss")
    return f"{n:010d}{n % 97:02d}"


FORMATS = (_nino, _licence, _insee, _dni, _german_pension, _german_tax, _spanish_insurance)


def identity_number(canon: str, key: bytes) -> str:
    """canon: letters and digits, upper-case. The result has the same length, letters where letters were."""
    for form in FORMATS:
        new = form(canon, key)
        if new is not None:
            return new
    return permute_format(canon, key)


# ---------------------------------------------------------------- phone numbers
#: fixed values: country codes of one digit and of two; all others have three
_ONE, _TWO = "17", frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def national_part(item: str) -> list[int]:
    """Positions of the digits after country code ('+' or '00') and trunk '0': what all notations of a number share."""
    spots = [i for i, c in enumerate(item) if c.isdigit()]
    digits = "".join(item[i] for i in spots)
    skip = 0
    if item.startswith("+") or digits.startswith("00"):
        skip = 0 if item.startswith("+") else 2
        code = digits[skip : skip + 3]
        skip += 1 if code[:1] in _ONE else 2 if code[:2] in _TWO else 3
        if digits[skip : skip + 1] == "0":  # the trunk digit, as in +44 (0)
            skip += 1
    elif digits.startswith("0"):
        skip = 1
    return spots[skip:]


def phone_number(item: str, key: bytes) -> str:
    """The national number permuted behind its first digit; code, trunk digit and layout stay as written."""
    spots = national_part(item)
    new = permute_format("".join(item[i] for i in spots), key + b"phone", keep=1)
    text = list(item)
    for i, c in zip(spots, new, strict=True):
        text[i] = c
    return "".join(text)


# ---------------------------------------------------------------- dates
def birth_date(item: str, key: bytes) -> str | None:
    """A date (day, month, year or year-month-day) permuted among the days of its two centuries, or of all two-digit years; None if it is none."""
    m = re.fullmatch(r"(\d{1,4})([./-])(\d{1,2})\2(\d{1,4})", item)
    if not m:
        return None
    iso = len(m[1]) == 4
    y, mo, d = (m[1], m[3], m[4]) if iso else (m[4], m[3], m[1])
    if len(y) not in (2, 4):
        return None
    first = dt.date(1900, 1, 1) if len(y) == 4 else dt.date(1920, 1, 1)
    days = (dt.date(2100, 1, 1) - first).days if len(y) == 4 else (dt.date(2020, 1, 1) - first).days
    year = int(y) if len(y) == 4 else int(y) + (1900 if int(y) >= 20 else 2000)
    try:
        at = (dt.date(year, int(mo), int(d)) - first).days
    except ValueError:
        return None
    if not 0 <= at < days:
        return None
    new = first + dt.timedelta(feistel(at, days, key + b"date%d" % len(y)))
    bare = len(mo) == 1 or len(d) == 1
    mo, d = (str(new.month), str(new.day)) if bare else (f"{new.month:02d}", f"{new.day:02d}")
    y = str(new.year) if len(y) == 4 else f"{new.year % 100:02d}"
    return m[2].join((y, mo, d) if iso else (d, mo, y))
