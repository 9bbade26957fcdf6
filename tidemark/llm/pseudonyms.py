"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value that passes its kind's validation becomes a number below the size of the kind's
domain: the digits of a card without its check digit, the day number of a date, and so
on. A keyed Feistel network permutes the domain, walking on while it steps outside, and
the result is written in the form of the original, check digits computed anew. So a
pseudonym is valid too, equal values have equal pseudonyms in all documents under one
key, different ones have different pseudonyms, and who has the key can go back.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROUNDS = 10
KINDS = ("iban", "card", "ssn", "phone", "ip", "date", "email")
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
MONTH_DAYS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


class Cipher:
    """Keyed permutations of the numbers below any size."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.key, self.back = hashlib.blake2b(key, digest_size=32).digest(), back
        self.remembered = lru_cache(maxsize=1 << 16)(self._permuted)

    def _round(self, kind: str, size: int, number: int, half: int, bits: int) -> int:
        message = f"{kind}|{size}|{number}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=32).digest(), "little") & ((1 << bits) - 1)

    def _once(self, kind: str, size: int, value: int, bits: int) -> int:
        """A balanced Feistel network on ``2 * bits`` bits."""
        left, right = value >> bits, value & ((1 << bits) - 1)
        if self.back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(kind, size, i, left, bits), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(kind, size, i, right, bits)
        return left << bits | right

    def _permuted(self, kind: str, size: int, value: int) -> int:
        if size < 2:
            return value
        bits = (max((size - 1).bit_length(), 2) + 1) // 2
        while True:  # the network's domain is less than four times as large, or 16 for the least
            value = self._once(kind, size, value, bits)
            if value < size:
                return value

    def permute(self, kind: str, size: int, value: int) -> int:
        return self.remembered(kind, size, value)


def refill(form: str, digits: str) -> str:
    """The form with its digits replaced in turn."""
    turn = iter(digits)
    return "".join(next(turn) if c.isdigit() else c for c in form)


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def permuted_digits(cipher: Cipher, kind: str, digits: str) -> str:
    return str(cipher.permute(kind, 10 ** len(digits), int(digits))).zfill(len(digits)) if digits else ""


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        n = int(c) * (1 if i % 2 else 2)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def card(text: str, cipher: Cipher) -> str | None:
    """13 to 19 digits with a right check digit."""
    digits = digits_of(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    while True:  # on to the next one where all digits are equal, as such numbers are no cards
        body = permuted_digits(cipher, "card", digits[:-1])
        digits = body + luhn_digit(body)
        if len(set(digits)) > 1:
            return refill(text, digits)


def ssn(text: str, cipher: Cipher) -> str | None:
    """Area 001 to 899 but not 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (int(x) for x in text.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    area -= 1 + (area > 666)
    value = cipher.permute("ssn", 898 * 99 * 9999, (area * 99 + group - 1) * 9999 + serial - 1)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    area += 1 + (area >= 665)
    return f"{area:03}-{group + 1:02}-{serial + 1:04}"


#: Country codes of one and of two digits; all others have three.
SHORT_CODES = {"1", "7", "20", "27", "36", "39", "81", "82", "84", "86", "98"} | {
    str(n) for some in (range(30, 35), range(40, 42), range(43, 50), range(51, 59), range(60, 67), range(90, 96)) for n in some
}


def country_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])


def phone(text: str, cipher: Cipher) -> str | None:
    """8 to 15 digits in all; the country code stays, however the number is spelled.

    North American numbers that may come without their code are permuted as those are.
    """
    digits = digits_of(text)
    if not 8 <= len(digits) <= 15:
        return None
    code = country_code(digits)
    rest = digits[len(code) :]
    if code != "1" or len(rest) != 10:
        rest = permuted_digits(cipher, f"phone+{code}", rest)
    elif LOCAL.fullmatch(rest):
        rest = local_digits(rest, cipher)
    else:  # on to the next one that is no such number either
        while LOCAL.fullmatch(rest := permuted_digits(cipher, "phone+1", rest)):
            pass
    return refill(text, code + rest)


#: Digits of a whole number, country code included, where a country's numbers all have the same.
PLAN_DIGITS = {"1": 11, "7": 11, "30": 12, "33": 11, "34": 11, "45": 10, "47": 10, "48": 11, "91": 12, "351": 12, "420": 12}
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{1,5}){1,5}(?![0-9A-Za-z])"
RUN = re.compile("[0-9]+")
MORE = re.compile("[.-][0-9]")


def phone_ends(text: str, found: re.Match) -> list[int]:
    """Where a phone number may end within a match, best first: after each run of digits.

    Ends before anything that looks like another kind come first, then those that give the
    digits of the country's plan, then those that do not part a run joined by dots or
    dashes, then the later ones. Only forms are looked at, which pseudonyms keep, so the
    way back finds the same ends.
    """
    runs = [r.span() for r in RUN.finditer(text, *found.span())]
    others = [a for a, _ in runs[1:] if any(p.match(text, a) for p in _other_kinds())]

    def rank(end: int) -> tuple[int, bool, bool, int]:
        digits = digits_of(text[found.start() : end])
        planned = PLAN_DIGITS.get(country_code(digits)) == len(digits)
        return sum(a < end for a in others), not planned, MORE.match(text, end) is not None, -end

    return sorted((b for _, b in runs if text[b : b + 1] != ")"), key=rank)


def card_matches(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches, but for one that begins with the last digits of a phone number before another match."""
    at = 0
    while found := pattern.search(text, at):
        at = found.end()
        plus = text.rfind("+", max(found.start() - 32, 0), found.start())
        before = re.compile(PHONE).match(text, plus) if plus >= 0 else None
        ends = phone_ends(text, before) if before and before.end() > found.start() else []
        end = next((e for e in ends if 8 <= len(digits_of(text[plus:e])) <= 15), 0)
        if found.start() < end < found.end() and pattern.match(text, end + 1):
            at = end
        else:
            yield found


@lru_cache(maxsize=1)
def _other_kinds() -> list[re.Pattern]:
    return [re.compile(r.pattern) for r in RULES if r.renew is not phone]


LOCAL = re.compile("[2-9][0-9]{2}[2-9][0-9]{6}")


def local_digits(digits: str, cipher: Cipher) -> str:
    value = ((int(digits[0]) - 2) * 100 + int(digits[1:3])) * 800 + (int(digits[3]) - 2) * 100 + int(digits[4:6])
    value, line = divmod(cipher.permute("local phone", 800 * 800 * 10000, value * 10000 + int(digits[6:])), 10000)
    area, exchange = divmod(value, 800)
    return f"{area + 200}{exchange + 200}{line:04}"


def local_phone(text: str, cipher: Cipher) -> str:
    """Ten digits of which the first and the fourth are 2 to 9, as its pattern says; they stay so."""
    return refill(text, local_digits(digits_of(text), cipher))


def ip(text: str, cipher: Cipher) -> str | None:
    """Four numbers to 255 without leading zeros; neither the wildcard nor a loopback."""
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    number = 0
    for p in parts:
        number = number << 8 | int(p)
    plain = lambda n: n == 0 or n >> 24 == 127
    if plain(number):
        return None
    while plain(number := cipher.permute("ip", 1 << 32, number)):
        pass
    return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))


#: The names of months that dates in words have.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


@lru_cache(maxsize=1)
def _day_classes() -> tuple[dict[int, tuple[int, int]], list[list[int]]]:
    """Days in classes: the class and place of each, and the days of each class.

    A class has months of one digit or of two, and days of the month of one digit, to 12
    or over 12. In whatever spelling, a pseudonym of the same class has as many digits
    where no zeros are written, and is read in the same order.
    """
    places, classes, numbers = {}, [], {}
    for day in range(FIRST_DAY, LAST_DAY + 1):
        d = dt.date.fromordinal(day)
        kind = numbers.setdefault((d.month > 9, d.day > 9, d.day > 12), len(numbers))
        if kind == len(classes):
            classes.append([])
        places[day] = kind, len(classes[kind])
        classes[kind].append(day)
    return places, classes


def other_day(year: int, month: int, day: int, cipher: Cipher) -> dt.date | None:
    """The pseudonym of a day from 1900 to 2099, the same for all its spellings."""
    try:
        number = dt.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= number <= LAST_DAY:
        return None
    places, classes = _day_classes()
    kind, place = places[number]
    return dt.date.fromordinal(classes[kind][cipher.permute(f"date {kind}", len(classes[kind]), place)])


def date(text: str, cipher: Cipher) -> str | None:
    """Year first, or day first, or month first where day first is none; numbers keep their digits."""
    a, mark, b, _, c = re.match(r"([0-9]+)([-/.])([0-9]+)([-/.])([0-9]+)", text).groups()
    orders = ["Ymd"] if len(a) == 4 else ["dmY", "mdY"]
    for order in orders:
        values = dict(zip(order, (a, b, c), strict=True))
        new = other_day(*(int(values[o]) for o in "Ymd"), cipher)
        if new is not None:
            fields = {"Y": new.year, "m": new.month, "d": new.day}
            return mark.join(f"{fields[o]:0{len(values[o])}}" for o in order)
    return None


def worded_date(text: str, cipher: Cipher) -> str | None:
    """A date with the month's name, before or after the day."""
    month = re.search("[A-Za-z]+", text)[0]
    first, second = re.findall("[0-9]+", text)
    new = other_day(int(second), MONTHS.index(month) + 1, int(first), cipher)
    if new is None:
        return None
    return text.replace(month, "\0").replace(first, f"{new.day:0{len(first)}}", 1).replace(second, f"{new.year}").replace("\0", MONTHS[new.month - 1])


def _mixed(text: str) -> tuple[list[tuple[str, int]], int, int]:
    """Letters and digits as a number of mixed base: each place's class, the size, the value."""
    classes, size, value = [], 1, 0
    for c in text:
        for low, many in (("0", 10), ("a", 26), ("A", 26)):
            if ord(low) <= ord(c) < ord(low) + many:
                classes.append((low, many))
                size, value = size * many, value * many + ord(c) - ord(low)
                break
        else:
            classes.append((c, 1))
    return classes, size, value


def permuted_letters(cipher: Cipher, kind: str, text: str) -> str:
    """Digits to digits, small to small and capital to capital letters; the rest stays."""
    classes, size, value = _mixed(text)
    form = "".join(low for low, _ in classes)
    value, out = cipher.permute(f"{kind}|{form}", size, value), []
    for low, many in reversed(classes):
        value, part = divmod(value, many)
        out.append(chr(ord(low) + part))
    return "".join(reversed(out))


def email(text: str, cipher: Cipher) -> str | None:
    """The part before the at sign; the domain stays."""
    name, _, domain = text.partition("@")
    return f"{permuted_letters(cipher, 'email', name)}@{domain}"


def iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02}"


def iban(text: str, cipher: Cipher) -> str | None:
    """Right check digits; country and form stay."""
    whole = text.replace(" ", "")
    country, check, body = whole[:2], whole[2:4], whole[4:]
    if not 11 <= len(body) <= 30 or iban_check(country, body) != check:
        return None
    body = permuted_letters(cipher, f"iban{country}", body)
    turn = iter(country + iban_check(country, body) + body)
    return "".join(" " if c == " " else next(turn) for c in text)


@dataclass(frozen=True)
class Kind:
    name: str
    hint: str
    pattern: str
    renew: Callable[[str, Cipher], str | None]
    ends: Callable[[str, re.Match], list[int]] = lambda text, found: [found.end()]
    matches: Callable[[re.Pattern, str], Iterator[re.Match]] = re.Pattern.finditer


#: In order of precedence where matches overlap. ``hint`` is a pattern that a text with a match has.
RULES = (
    Kind("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])", iban),
    Kind(
        "card",
        r"[0-9]{3}",
        r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])",
        card,
        matches=card_matches,
    ),
    Kind("ssn", r"[0-9]-[0-9]", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", ssn),
    Kind("phone", r"\+[0-9]", PHONE, phone, phone_ends),
    Kind(
        "phone",
        r"[0-9][ .-][0-9]{4}",
        r"(?<![0-9A-Za-z+.-])(?<!\) )(?:(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}"
        r"|(?<![0-9] )(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2}) [2-9][0-9]{2} [0-9]{4}(?! [0-9]))(?![0-9A-Za-z]|[.-][0-9])",
        local_phone,
    ),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])", ip),
    Kind(
        "date",
        r"[0-9][-/.][0-9]",
        r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9A-Za-z]|[/-][0-9]|\.[0-9])",
        date,
    ),
    Kind(
        "date",
        r"[a-z],? [0-9]",
        rf"(?<![0-9A-Za-z/.-])(?:[0-9]{{1,2}} (?:{'|'.join(MONTHS)}) [0-9]{{4}}|(?:{'|'.join(MONTHS)}) [0-9]{{1,2}}, [0-9]{{4}})(?![0-9A-Za-z])",
        worded_date,
    ),
    Kind("email", "@", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
)


class Renewer:
    """Finds and replaces all kinds in a text."""

    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS, back: bool = False) -> None:
        self.cipher = Cipher(key, back)
        self.rules = [(r.name, re.compile(r.hint), re.compile(r.pattern), r) for r in RULES if r.name in kinds]

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """``start, end, kind, pseudonym`` in order, without overlap."""
        found: list[tuple[int, int, str, str]] = []
        for name, hint, pattern, rule in self.rules:
            if not hint.search(text):
                continue
            starts, ends, own = [f[0] for f in found], [f[1] for f in found], []
            for m in rule.matches(pattern, text):
                for end in rule.ends(text, m):
                    i = bisect.bisect_left(starts, end)  # the spans before i begin before this end
                    if i and ends[i - 1] > m.start():
                        continue
                    new = rule.renew(text[m.start() : end], self.cipher)
                    if new is not None:
                        own.append((m.start(), end, name, new))
                        break
            found = sorted(found + own)
        return found

    def renew(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        spans, parts, at = self.spans(text), [], 0
        for start, end, _, new in spans:
            parts += [text[at:start], new]
            at = end
        return "".join([*parts, text[at:]]), spans


def _renew_pass(key: bytes, kinds: tuple[str, ...], back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renewer = Renewer(key, kinds, back)
        for batch in batches:
            texts, spelled, counts = [], [], []
            for text in batch.column("text").to_pylist():
                new, spans = (None, []) if text is None else renewer.renew(text)
                texts.append(new)
                spelled.append(",".join(f"{name}:{a}:{b}" for a, b, name, _ in spans))
                counts.append(len(spans))
            place = batch.schema.get_field_index("text")
            batch = batch.set_column(place, "text", pa.array(texts, pa.string()))
            yield batch.append_column("pii_spans", pa.array(spelled, pa.string())).append_column("n_pii", pa.array(counts, pa.int64()))

    return run


def pseudonymise(docs: DataFrame, key: bytes, kinds: tuple[str, ...] = KINDS, back: bool = False) -> DataFrame:
    """The documents with every validated personal value replaced by its pseudonym.

    Needs ``text string``; other columns pass through. Adds ``pii_spans``
    (``kind:start:end`` of the original text in code points, comma-joined, in order)
    and ``n_pii``, in place of columns of these names. Values that fail validation
    stay. Where values overlap, the kind that comes first in ``KINDS`` wins, whatever the
    order of ``kinds``; of one kind the leftmost. ``back`` restores the originals of a text
    pseudonymised under the same key and kinds. Null text stays null and empty text empty,
    with no spans. Every row is one of its own, repeated ones too; an empty table gives
    no rows.
    """
    rest = [c for c in docs.columns if c not in ("pii_spans", "n_pii")]
    docs = docs.select(*rest).withColumn("text", F.col("text").cast("string"))
    schema = StructType(docs.schema.fields[:]).add("pii_spans", "string").add("n_pii", "long")
    return docs.mapInArrow(_renew_pass(key, kinds, back), schema)
