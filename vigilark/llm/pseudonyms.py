"""Personal data: format-preserving pseudonyms.

Numbers and dates that pass their checks are replaced by other valid ones of the same format: what may vary is read as one
number below a known size, permuted by a keyed Feistel network (values that fall outside walk on until they are
inside), and written back; check digits are computed anew. The permutation depends on key and kind only, so equal
values stay equal in all documents and different ones stay different.

Kinds: mail addresses (letters and digits of all but the last label), payment cards (Luhn), IBANs (mod 97), social
security numbers, telephone numbers, IPv4 addresses, calendar dates from 1900 to 2099 (year, day or month first), access keys. Where a card's or IBAN's
pattern runs into its neighbours, every length from each start is tried until a check passes (for
parts of a card's match, the lengths of the issuer that the first digits name).

Cases: null texts stay null; values that fail their check, empty texts and texts without values stay as they are; overlapping
finds go to the first kind in the list; repeated rows and other columns are kept, columns named like the
results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from vigilark.llm.common import pieces

ROUNDS = 8
HINT = r"@|[0-9]{2}|AKIA"  # every value holds one of these
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
LATE_DAYS = [d for d in (FIRST_DAY + timedelta(i) for i in range(DAYS)) if d.day > 12]
LATE_PLACE = {d: i for i, d in enumerate(LATE_DAYS)}
# fixed values: characters of an IBAN by country
IBAN_LENGTHS = {k: n for n, names in (
    (15, "NO"), (16, "BE"), (18, "DK FI FO GL NL FK SD"), (19, "MK SI"), (20, "AT BA EE KZ LT LU XK MN"), (21, "CH HR LI LV"),
    (22, "BG BH CR DE GB GE IE ME RS VA"), (23, "AE GI IL IQ TL OM SO"), (24, "AD CZ ES MD PK RO SA SE SK TN VG"), (25, "LY PT ST"),
    (26, "IS TR"), (27, "BI DJ FR GR IT MC MR SM"), (28, "AL AZ BY CY DO GT HU LB NI PL SV"), (29, "BR EG PS QA UA"),
    (30, "JO KW MU YE"), (31, "MT SC"), (32, "LC"), (33, "RU")) for k in names.split()}


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """Keyed permutation of the numbers below `size`."""
    if size < 2:
        return value
    left_size = 1
    while left_size * left_size < size:
        left_size += left_size
    right_size = -(-size // left_size)
    while True:
        left, right = value % left_size, value // left_size
        for turn in range(ROUNDS):
            half = right if turn % 2 == 0 else left
            digest = hashlib.blake2b(f"{tweak}|{size}|{turn}|{half}".encode(), key=key, digest_size=16).digest()
            if turn % 2 == 0:
                left = (left + int.from_bytes(digest, "big")) % left_size
            else:
                right = (right + int.from_bytes(digest, "big")) % right_size
        value = left + right * left_size
        if value < size:
            return value


def _mixed(parts: list[tuple[int, int]], key: bytes, tweak: str) -> list[int]:
    """Permutes a tuple of (value, size) as one number."""
    value = size = 0
    for digit, radix in parts:
        value, size = value * radix + digit, (size or 1) * radix
    value, out = feistel(value, size or 1, key, tweak), []
    for _, radix in reversed(parts):
        value, digit = divmod(value, radix)
        out.append(digit)
    return out[::-1]


def _shaped(text: str, key: bytes, tweak: str) -> str:
    """Letters and digits of a string, each staying in its class."""
    classes = [next((c for c in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if x in c), "") for x in text]
    found = iter(_mixed([(c.index(x), len(c)) for x, c in zip(text, classes) if c], key, tweak + re.sub(r"\w", "w", text)))
    return "".join(c[next(found)] if c else x for x, c in zip(text, classes))


def _fill(shape: str, digits: str) -> str:
    """The digits of `shape` replaced in order."""
    source = iter(digits)
    return "".join(next(source) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """Check digit that follows `digits`."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = digits[0] + "".join(map(str, _mixed([(int(d), 10) for d in digits[1:-1]], key, f"card{digits[0]}")))
    return _fill(text, body + str(luhn(body)))


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = _shaped(plain[4:], key, "iban" + plain[:2])
    found = iter(plain[:2] + f"{98 - _iban_rest(plain[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(found) for c in text)


def _social(text: str, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    a, g, s = _mixed([(area - 1 - (area > 666), 898), (group - 1, 99), (serial - 1, 9999)], key, "social")
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def _phone(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)[-10:]
    if len(digits) != 10 or digits[0] in "01" or digits[3] in "01":
        return None
    parts = [(int(d) - 2, 8) if i in (0, 3) else (int(d), 10) for i, d in enumerate(digits)]
    out = "".join(str(d + 2) if i in (0, 3) else str(d) for i, d in enumerate(_mixed(parts, key, "phone")))
    country = len(re.sub(r"\D", "", text)) - 10
    return _fill(text, re.sub(r"\D", "", text)[:country] + out)


def _address(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    return None if max(parts) > 255 else ".".join(map(str, _mixed([(x, 256) for x in parts], key, "address")))


def _date(order: str) -> Callable[[str, bytes], str | None]:
    def run(text: str, key: bytes) -> str | None:
        numbers = dict(zip(order, (int(x) for x in re.split(r"\D", text))))
        try:
            day = date(numbers["y"], numbers["m"], numbers["d"])
        except ValueError:
            return None
        if not 0 <= (day - FIRST_DAY).days < DAYS:
            return None
        new = FIRST_DAY + timedelta(feistel((day - FIRST_DAY).days, DAYS, key, "date"))
        values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return text[4 if order[0] == "y" else 2].join(values[x] for x in order)

    return run


def _month_first(text: str, key: bytes) -> str | None:
    """Month-first dates whose day is above 12, permuted among themselves, so that none becomes another date's day-first text."""
    month, day, year = (int(x) for x in re.split(r"\D", text))
    if day <= 12 or not 1 <= month <= 12:
        return None
    try:
        at = LATE_PLACE[date(year, month, day)]
    except (ValueError, KeyError):
        return None
    new = LATE_DAYS[feistel(at, len(LATE_DAYS), key, "month-first")]
    return text[2].join((f"{new.month:02d}", f"{new.day:02d}", f"{new.year:04d}"))


def _mail(text: str, key: bytes) -> str:
    name, _, last = text.rpartition(".")
    return f"{_shaped(name, key, 'mail')}.{last}"


def _access_key(text: str, key: bytes) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    return text[:4] + "".join(letters[i] for i in _mixed([(letters.index(c), 36) for c in text[4:]], key, "access"))


KINDS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "mail": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}", _mail),
    "access_key": (r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", _access_key),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _iban),
    "date_ymd": (r"(?<![0-9./-])[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}(?![0-9/-])", _date("ymd")),
    "date_dmy": (r"(?<![0-9./-])[0-9]{2}([-/.])[0-9]{2}\1[0-9]{4}(?![0-9/-])", _date("dmy")),
    "date_mdy": (r"(?<![0-9./-])[0-9]{2}([-/.])[0-9]{2}\1[0-9]{4}(?![0-9/-])", _month_first),
    "address": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _address),
    "card": (r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", _card),
    "social": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _social),
    "phone": (r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", _phone),
}


LONGEST = {"card": 19, "iban": 34}  # kinds whose patterns may run on into what follows


# fixed values: first digits of card issuers and the lengths of their numbers
ISSUERS = (
    (r"4", (13, 16, 19)), (r"5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720", (16,)), (r"3[47]", (15,)), (r"3[068]", (14, 16, 19)),
    (r"35|6[0245]", (16, 17, 18, 19)), (r"5[0678]|6[1367-9]", range(13, 20)))


def _choices(kind: str, text: str, start: int, end: int, fresh: bool) -> list[int]:
    """Ends of the values to try from `start`: the match's, or for kinds of free length every one that a value may have.

    Any number of a card's length may stand alone; parts of a longer or an earlier failed match (not `fresh`) need an
    issuer's length, as a tenth of all numbers passes the check.
    """
    if kind not in LONGEST:
        return [end]
    least, inner = (13, str.isdigit) if kind == "card" else (15, str.isalnum)
    ends, n = {}, 0
    for at in range(start, end):
        n += inner(text[at])
        if inner(text[at]) and least <= n <= LONGEST[kind] and not (at + 1 < len(text) and text[at + 1].isascii() and inner(text[at + 1])):
            ends[n] = at + 1
    if kind == "card":
        digits = re.sub(r"\D", "", text[start:end])
        allowed = {n for first, lengths in ISSUERS if re.match(first, digits) for n in lengths}
        ends = {n: x for n, x in ends.items() if n in allowed or (fresh and x == end)}
    country = IBAN_LENGTHS.get(text[start:start + 2]) if kind == "iban" else None
    return sorted(ends.values(), key=lambda x: (x != ends.get(country), -x))


GATES = {"mail": "@", "access_key": "AKIA"}  # what a text must hold, else digits


class Replacer:
    """Pseudonyms for one key; a document is changed kind by kind, over the parts that no earlier kind has changed."""

    def __init__(self, key: bytes):
        self.key, self.known = key, {}
        self.patterns = {kind: (re.compile(p, re.ASCII), f) for kind, (p, f) in KINDS.items()}

    def pseudonym(self, kind: str, value: str) -> str | None:
        if (kind, value) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[kind, value] = self.patterns[kind][1](value, self.key)
        return self.known[kind, value]

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        parts, counts = [text], {}  # odd parts are done
        digits = re.search("[0-9]{2}", text) is not None
        for kind, (pattern, _) in self.patterns.items():
            if not (GATES[kind] in text if kind in GATES else digits):
                continue
            out: list[str] = []
            for i, part in enumerate(parts):
                if i % 2:
                    out.append(part)
                    continue
                at, failed, found = 0, 0, pattern.search(part)
                while found:
                    start, resume = found.start(), found.start() + 1
                    for end in _choices(kind, part, start, found.end(), start >= failed):
                        new = self.pseudonym(kind, part[start:end])
                        if new is not None:
                            out += [part[at:start], new]
                            at = resume = end
                            counts[kind] = counts.get(kind, 0) + 1
                            break
                    else:
                        failed = max(failed, found.end())
                    found = pattern.search(part, resume)
                out.append(part[at:])
            parts = out
        return "".join(parts), counts


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with values in text replaced, n_replaced and kinds (`kind:count`, by name, separated by spaces)."""
    kept = docs.drop("n_replaced", "kinds")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replacer = Replacer(hashlib.blake2b(key.encode(), digest_size=32).digest())
        for batch in batches:
            for part in pieces(batch):
                texts = part.column("text")
                hit = pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_pylist()
                new, n, kinds = [], [], []
                for text, may in zip(texts.to_pylist(), hit):
                    text, counts = replacer(text) if may else (text, {})
                    new.append(text), n.append(sum(counts.values()))
                    kinds.append(" ".join(f"{k}:{v}" for k, v in sorted(counts.items())))
                columns = [pa.array(new, pa.string()) if x == "text" else part.column(x) for x in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(kinds, pa.string())], names=[*names, "n_replaced", "kinds"])

    schema = StructType(list(kept.schema)).add("n_replaced", LongType()).add("kinds", StringType())
    return kept.mapInArrow(run, schema)
