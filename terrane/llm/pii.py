"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

Numbers and dates that pass validation are permuted within their own format: a card stays a card
with a right check digit, a date stays a date of its notation, a telephone number keeps its
country code and punctuation. Each domain is permuted by a balanced Feistel network over
``[0, n)`` with cycle walking, keyed by a secret and the kind. The permutation is a bijection, so
equal values get equal pseudonyms in all documents, different values different ones, and the
key's holder can undo it. E-mail addresses are permuted letter by letter class within their length.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
from datetime import date
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import common

ROUNDS = 10
KINDS = ("email", "iban", "card", "ssn", "phone", "ipv4", "ipv6", "date")

# The shapes that are looked for; each is validated before it counts.
_SHAPES = {
    "email": r"(?<![\wÀ-ɏ.+%-])[A-Za-z0-9À-ɏ](?:[A-Za-z0-9À-ɏ._%+-]*[A-Za-z0-9À-ɏ_%+-])?@(?:[A-Za-z0-9À-ɏ](?:[A-Za-z0-9À-ɏ-]*[A-Za-z0-9À-ɏ])?\.)+[A-Za-z]{2,}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.[0-9])",
    "date": r"(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![\w/]|[.-][0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}",
    "phone": r"(?<![\w+(.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])",
    "intl": r"(?<![\w+])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![\w-])",
    "exit": r"(?<![\w+.-])00[1-9][0-9]{0,2}[ .-]\(?[0-9](?:[ .()-]{0,2}[0-9]){5,12}(?![\w-]|[.,][0-9])",
    "trunk": r"(?<![\w+(.-])(?:\(0[1-9][0-9]{0,3}\) ?|0[1-9][0-9]{0,3}[ -])[0-9]{2,4}(?:[ -][0-9]{2,4}){1,3}(?![\w-]|[.,][0-9])",
}
_PATTERN = re.compile("|".join(f"(?P<{name}>{shape})" for name, shape in _SHAPES.items()), re.ASCII)
_ALONE = {name: re.compile(shape, re.ASCII) for name, shape in _SHAPES.items()}
_CARD_DIGITS = 13
_ANY = re.compile("[0-9@]|::")
# Lengths of IBANs by country, as the registry has them.
_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
# Country calling codes of one and two digits; all others have three.
_CODES_1 = ("1", "7")
_CODES_2 = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()
_FIRST_DAY, _LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of ``[0, n)``: Feistel on two halves, walked until it lands inside."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key, rounds

    def _round(self, tweak: bytes, i: int, value: int) -> int:
        mac = hmac.digest(self.key, b"%b|%d|%d" % (tweak, i, value), "sha256")
        return int.from_bytes(mac, "big")

    def _once(self, tweak: bytes, a: int, b: int, x: int, back: bool) -> int:
        left, right = divmod(x, b)
        for i in reversed(range(self.rounds)) if back else range(self.rounds):
            if i % 2 == 0:
                f = self._round(tweak, i, right)
                left = (left - f) % a if back else (left + f) % a
            else:
                f = self._round(tweak, i, left)
                right = (right - f) % b if back else (right + f) % b
        return left * b + right

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if not 0 <= x < n:
            raise ValueError("outside of the domain")
        if n == 1:
            return 0
        a = 1
        while a * a < n:
            a <<= 1
        b = -(-n // a)
        while True:
            x = self._once(f"{tweak}|{n}".encode(), a, max(b, 1), x, back)
            if x < n:
                return x


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _luhn_digit(body: str) -> str:
    return next(c for c in "0123456789" if luhn(body + c))


def _iban_ok(code: str) -> bool:
    moved = code[4:] + code[:4]
    return len(code) == _IBAN_LENGTH.get(code[:2], 0) and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _fill(shape: str, characters: str, classes: str) -> str:
    """The shape with its characters of the given class replaced in order."""
    it = iter(characters)
    return "".join(next(it) if (c.isdigit() if classes == "d" else c.isalnum()) else c for c in shape)


class Pseudonyms:
    """Finds, validates and replaces personal data in one text."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("an empty key hides nothing")
        self.feistel = Feistel(key)
        self.cached = lru_cache(100_000)(self._pseudonym)

    def valid(self, kind: str, value: str) -> str | None:
        """The kind of a validated match, or None."""
        digits = re.sub("[^0-9]", "", value)
        if kind == "email":
            return kind if ".." not in value else None
        if kind == "iban":
            return kind if _iban_ok(value.replace(" ", "")) else None
        if kind == "ipv4":
            return kind if all(int(p) < 256 and (p == "0" or p[0] != "0") for p in value.split(".")) else None
        if kind == "ipv6":
            return kind if _ipv6(value) is not None else None
        if kind == "date":
            return kind if _date(value) else None
        if kind == "ssn":
            return kind if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else None
        if kind == "card":
            return kind if luhn(digits) and len(set(digits)) > 1 else None
        if kind == "phone":
            return kind if 10 <= len(digits) <= 13 else None
        if kind == "trunk":
            return "phone" if 9 <= len(digits) <= 11 else None
        return "phone" if 8 <= len(digits) <= 15 else None

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) in the text given, by start."""
        if _ANY.search(text) is None:
            return text, []
        spans, out, last, at = [], [], 0, 0
        while m := _PATTERN.search(text, at):
            kind, end = self._fit(text, m)
            if kind is None:  # another pattern may still fit further on
                at = m.start() + 1
                while at < m.end() and text[at].isalnum() and text[at - 1].isalnum():
                    at += 1
                continue
            out += [text[last : m.start()], self.cached(kind, text[m.start() : end])]
            spans.append((kind, m.start(), end))
            last = at = end
        return "".join([*out, text[last:]]), spans

    def _fit(self, text: str, m: re.Match) -> tuple[str | None, int]:
        """Kind and end of the first valid value where the match starts: its shape and those after it, longest run first."""
        names, start = list(_SHAPES), m.start()
        for name in names[names.index(m.lastgroup) :]:
            found = m if name == m.lastgroup else _ALONE[name].match(text, start)
            for end in _ends(name, text, start, found.end()) if found else ():
                kind = self.valid(name, text[start:end])
                if kind is not None:
                    return kind, end
        return None, start

    def _digits(self, digits: str, tweak: str, back: bool) -> str:
        n = 10 ** len(digits)
        return str(self.feistel.permute(int(digits), n, tweak, back)).zfill(len(digits)) if digits else ""

    def _within(self, ok, step):
        """Walk a permutation until its value is valid: still a bijection of the valid values."""
        while True:
            value = step()
            if ok(value):
                return value

    def _pseudonym(self, kind: str, value: str, back: bool = False) -> str:
        if kind == "email":
            return "".join(self._label(part, back) if k % 2 == 0 else part for k, part in enumerate(_email_parts(value)))
        digits = re.sub("[^0-9]", "", value)
        if kind == "card":
            head, body = digits[:1], digits[1:-1]
            body = self._walk(body, "card" + head, lambda d: len(set(head + d)) > 1, back)
            return _fill(value, head + body + _luhn_digit(head + body), "d")
        if kind == "ssn":
            return _fill(value, self._walk(digits, "ssn", lambda d: self.valid("ssn", f"{d[:3]}-{d[3:5]}-{d[5:]}") is not None, back), "d")
        if kind == "ipv4":
            a, b, c, d = map(int, value.split("."))
            x = self.feistel.permute(((a * 256 + b) * 256 + c) * 256 + d, 1 << 32, "ipv4", back)
            return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
        if kind == "ipv6":  # written in full: how far an address can be shortened depends on its zeros
            x = self.feistel.permute(_ipv6(value), 1 << 128, "ipv6", back)
            full = ipaddress.IPv6Address(x).exploded
            return full.upper() if value != value.lower() else full
        if kind == "date":
            day, *notation = _date(value)
            x = day - _FIRST_DAY
            while True:  # walk within the days that this notation writes in this width and is read back the same
                x = self.feistel.permute(x, _LAST_DAY - _FIRST_DAY + 1, "date", back)
                new = date.fromordinal(x + _FIRST_DAY)
                if _writes(new, *notation):
                    return _render(new, *notation)
        if kind == "phone":
            head = _country_code(digits) if value.startswith("+") else "00" + _country_code(digits[2:]) if digits.startswith("00") else "0" if digits[0] == "0" else ""
            rest = digits[len(head) :]
            if head == "0":
                return _fill(value, head + self._walk(rest, "phone trunk", lambda d: d[0] != "0", back), "d")
            low = rest[0] in "01"  # numbers that begin so stay among themselves
            national = self._walk(rest, ("phone0" if low else "phone") + head, lambda d: (d[0] in "01") == low, back)
            return _fill(value, head + national, "d")
        code = value.replace(" ", "")  # iban
        classes = "".join("d" if c.isdigit() else "u" for c in code[4:])
        body = self._classes(code[4:], "iban" + code[:2] + classes, back)
        check = 98 - int("".join(str(int(c, 36)) for c in body + code[:2] + "00")) % 97
        return _fill(value, f"{code[:2]}{check:02d}{body}", "a")

    def _walk(self, digits: str, tweak: str, ok, back: bool) -> str:
        while True:
            digits = self._digits(digits, tweak, back)
            if ok(digits):
                return digits

    def _classes(self, text: str, tweak: str, back: bool) -> str:
        """Permute within the strings that have the same class at each place."""
        x, n = 0, 1
        sizes = []
        for c in text:
            size, low = (10, "0") if c.isdigit() else (26, "a" if c.islower() else "A")
            x, n = x * size + ord(c) - ord(low), n * size
            sizes.append((size, low))
        x = self.feistel.permute(x, n, tweak, back)
        out = []
        for size, low in reversed(sizes):
            x, r = divmod(x, size)
            out.append(chr(ord(low) + r))
        return "".join(reversed(out))

    def _label(self, label: str, back: bool) -> str:
        shape = "".join("d" if c.isdigit() else "l" if c.islower() else "u" for c in label)
        return self._classes(label, f"email|{shape}", back) if label else label


def _ends(name: str, text: str, start: int, end: int):
    """Where a value of this shape may end: for cards and IBANs also before each space or hyphen in the run, from the right."""
    if name not in ("card", "iban"):
        yield end
        return
    for e in range(end, start, -1):
        after = text[e : e + 1]
        inside = after.isascii() and (after.isalnum() or after == "_")
        if inside or not text[e - 1].isalnum():
            continue
        if name == "iban" or sum(map(str.isdigit, text[start:e])) >= _CARD_DIGITS:
            yield e


def _email_parts(value: str) -> list[str]:
    """Runs of letters and digits at even places, signs and the top-level domain at odd ones."""
    body, top = value.rsplit(".", 1)
    parts = re.split(r"([^A-Za-z0-9]+)", body)
    return [*parts, "." + top]


def _country_code(digits: str) -> str:
    return digits[:1] if digits[:1] in _CODES_1 else digits[:2] if digits[:2] in _CODES_2 else digits[:3]


def _ipv6(value: str) -> int | None:
    """The number of an address of eight groups, or of three and more with a run of zeros left out."""
    if value.count(":") < 7 and ("::" not in value or sum(bool(g) for g in value.split(":")) < 3):
        return None
    try:
        return int(ipaddress.IPv6Address(value))
    except ValueError:
        return None


def _date(value: str):
    """(day, order and sign, digits of the day, digits of the month) of a valid date from 1900 to 2099, or None.

    A year stands first or last. With slashes or hyphens and the year last, a second number of 13 and over is the day, else the month.
    """
    sign = next(s for s in "-/." if s in value)
    parts = value.split(sign)
    numbers = [int(p) for p in parts]
    order = "ymd" if len(parts[0]) == 4 else "mdy" if sign != "." and numbers[1] > 12 else "dmy"
    year, month, d = (order.index(c) for c in "ymd")
    try:
        day = date(numbers[year], numbers[month], numbers[d]).toordinal()
    except ValueError:
        return None
    return (day, order + sign, len(parts[d]), len(parts[month])) if _FIRST_DAY <= day <= _LAST_DAY else None


def _writes(day: date, style: str, day_digits: int, month_digits: int) -> bool:
    """Whether a day has this notation and width."""
    return (day_digits > 1 or day.day < 10) and (month_digits > 1 or day.month < 10) and (style[:3] != "mdy" or day.day > 12)


def _render(day: date, style: str, day_digits: int, month_digits: int) -> str:
    written = {"y": str(day.year), "m": f"{day.month:0{month_digits}d}", "d": f"{day.day:0{day_digits}d}"}
    return style[3].join(written[c] for c in style[:3])


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the text with pseudonyms, and ``pii_spans`` of what was found.

    ``pii_spans`` is a list of (kind, start, end) in the text given. Null texts stay null with an
    empty list. ``key`` is the secret; an empty one is refused. Every other column passes unchanged, also one named like a column of ours would
    be: a column ``pii_spans`` of the input is replaced. Repeated rows and null ids keep their
    rows; an empty table gives none.
    """
    Pseudonyms(key)  # refuses an empty key here, not in the tasks
    docs = docs.drop("pii_spans")
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    names = docs.columns
    rows = docs.withColumn(text, F.col(text).cast("string"))
    schema = StructType([*rows.schema.fields, StructField("pii_spans", ArrayType(span))])
    place = names.index(text)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        pseudonyms = Pseudonyms(key)
        for batch in common.sliced(batches):
            done = [(None, []) if t is None else pseudonyms.replace(t) for t in batch.column(place).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[place] = pa.array([t for t, _ in done], pa.string())
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done], kind)
            yield pa.RecordBatch.from_arrays([*columns, spans], names=[*names, "pii_spans"])

    return rows.mapInArrow(run, schema)

