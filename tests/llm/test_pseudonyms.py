import datetime as dt
import hashlib
import random
import re
from collections import Counter

import pytest
from helpers import DOCS

from tidemark.llm import pseudonyms as ps
from tidemark.llm.queries import PII_KEY, QUERIES

KEY = b"test key"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 16, 17, 100, 1000, 4096, 5000])
def test_permutation_and_back(size):
    there, back = ps.Cipher(KEY), ps.Cipher(KEY, back=True)
    image = [there.permute("x", size, i) for i in range(size)]
    assert sorted(image) == list(range(size))
    assert [back.permute("x", size, i) for i in image] == list(range(size))
    if size > 50:
        assert image != [ps.Cipher(b"other").permute("x", size, i) for i in range(size)]
        assert image != [there.permute("y", size, i) for i in range(size)]
        assert sum(i == j for i, j in enumerate(image)) < 10


def luhn_right(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


VALID = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "3782 822463 10005", "6011000990139424"],
    "ssn": ["123-45-6789", "001-01-0001", "899-99-9999", "667-12-3456"],
    "phone": ["+1 (017) 555-7713", "+49 30 901820", "+442079460958", "+33 1 23 45 67 89", "(212) 555-0123", "212-555-0123", "(212)555.0123", "(415) 555 2671", "415 555 2671"],
    "ip": ["97.51.17.173", "8.8.8.8", "255.255.255.255"],
    "date": ["2024-02-29", "31.12.1999", "01/02/2003", "12/31/1999", "1900-01-01", "2099-12-31", "2024/5/3", "3.5.2024", "12 May 2024", "February 29, 2024"],
    "email": ["und.34@mail7.example.com", "A.b+c_1@x.org"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"],
}
INVALID = ["4111111111111112", "0000000000000000", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-6789", "123-45-0000", "+1 23", "256.1.1.1"]
INVALID += ["112-555-0123", "212-155-0123", "212-555-01234", "1-212-555-0123", "1.2.3", "1.2.3.4.5", "01.2.3.4", "127.0.0.1", "0.0.0.0", "2023-02-29", "31.04.2000", "1899-12-31", "2100-01-01", "99/99/2000", "2024-01/02", "30 February 2000", "12 May 20245", "415 555 2671 9", "5 415 555 2671"]
INVALID += ["DE89370400440532013001", "a@b", "@x.org", "v4111111111111111", "12345", "Version 2.0.", "3.14159", "é", "123e4567-e89b-12d3-a456-426614174000"]


@pytest.mark.parametrize("kind", VALID)
def test_kinds(kind):
    there, back = ps.Renewer(KEY), ps.Renewer(KEY, back=True)
    for value in VALID[kind]:
        text = f"é x {value}, y"
        new, spans = there.renew(text)
        assert [(a, b, k) for a, b, k, _ in spans] == [(4, 4 + len(value), kind)], value
        renewed = spans[0][3]
        assert renewed != value
        if kind in ("card", "ssn", "phone", "iban", "date") and not re.search("[a-z] ", value):
            assert re.sub("[0-9A-Za-z]", "", renewed) == re.sub("[0-9A-Za-z]", "", value)
        if kind == "card":
            assert luhn_right(renewed)
        assert new == text.replace(value, renewed)
        assert [k for _, _, k, _ in there.renew(new)[1]] == [kind], (value, renewed)
        assert back.renew(new)[0] == text


@pytest.mark.parametrize("text", INVALID)
def test_the_rest_stays(text):
    assert ps.Renewer(KEY).renew(f"a {text} b") == (f"a {text} b", [])


def test_many_values_go_there_and_back():
    rng = random.Random(2)
    there, back = ps.Renewer(KEY), ps.Renewer(KEY, back=True)
    seen = {}
    for _ in range(400):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        text = rng.choice([
            f"{body}{ps.luhn_digit(body)}", f"{rng.randrange(1, 666):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}",
            f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", f"{rng.randrange(1, 29):02}/{rng.randrange(1, 13):02}/{rng.randrange(1900, 2100)}",
            f"{rng.randrange(1, 13):02}/{rng.randrange(13, 29):02}/{rng.randrange(1900, 2100)}", f"{rng.randrange(1, 100)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}",
        ])
        new, spans = there.renew(text)
        assert len(spans) == 1
        assert back.renew(new)[0] == text
        assert seen.setdefault(new, text) == text


FOLLOWERS = {
    "190.137.223.204": ["ip"], "2024-02-29": ["date"], "31.12.1999": ["date"], "4111 1111 1111 1111": ["card"], "4111-1111-1111-1111": ["card"],
    "4111111111111111": ["card"], "123-45-6789": ["ssn"], "(212) 555-0123": ["phone"], "555@x.org": ["email"], "12 items": [], "3.14159": [], "123 45 678 90 12": [],
}


@pytest.mark.parametrize("follower", FOLLOWERS)
@pytest.mark.parametrize("number", ["+1 (826) 555-4081", "+1 (017) 555-7713", "+1 212.555.0123", "+33 1 23 45 67 89", "+49 30 901820"])
def test_phones_end_before_what_follows(number, follower):
    if number.startswith("+49") and follower[:3] in ("12 ", "123") and follower != "123-45-6789":
        return  # numbers of that country have no fixed length
    there, back = ps.Renewer(KEY), ps.Renewer(KEY, back=True)
    alone = there.renew(number)[0]
    text = f"call {number} {follower}, then"
    new, spans = there.renew(text)
    assert (spans[0][0], spans[0][1], spans[0][3]) == (5, 5 + len(number), alone)
    assert [s[2] for s in spans] == ["phone", *FOLLOWERS[follower]]
    assert back.renew(new)[0] == text


SPELLINGS = [
    ["+14155552671", "+1 415 555 2671", "+1 (415) 555-2671", "+1-415-555-2671", "(415) 555-2671", "415.555.2671"],
    ["+10175557713", "+1 (017) 555-7713", "+1 017 555 7713"],
    ["+442079460958", "+44 20 7946 0958", "+44 (20) 7946-0958"],
    ["+35312345678", "+353 1 234 5678"],
    ["+79161234567", "+7 916 123-45-67", "+7 (916) 123-45-67"],
]


@pytest.mark.parametrize("spellings", SPELLINGS)
def test_phones_in_any_spelling_are_linked(spellings):
    there, back = ps.Renewer(KEY), ps.Renewer(KEY, back=True)
    code = {"+1": "1", "+4": "44", "+3": "353", "+7": "7"}[spellings[0][:2]]
    renewed = [there.renew(s)[0] for s in spellings]
    assert len({re.sub("[^0-9]", "", new).removeprefix(code if s[0] == "+" else "") for s, new in zip(spellings, renewed, strict=True)}) == 1
    assert all(new.startswith("+" + code) for s, new in zip(spellings, renewed, strict=True) if s[0] == "+")
    assert [back.renew(new)[0] for new in renewed] == spellings
    assert not set(renewed) & set(spellings)


@pytest.mark.parametrize("day", [dt.date(2024, 5, 13), dt.date(1999, 12, 31), dt.date(2003, 2, 1), dt.date(2010, 10, 12), dt.date(1950, 11, 9)])
def test_dates_in_any_spelling_are_linked(day):
    there, back = ps.Renewer(KEY), ps.Renewer(KEY, back=True)
    month = f"{day:%B}"
    spellings = [f"{day}", f"{day:%Y/%m/%d}", f"{day:%d.%m.%Y}", f"{day:%d-%m-%Y}", f"{day.year}/{day.month}/{day.day}", f"{day.day}.{day.month}.{day.year}"]
    spellings += [f"{day.day} {month} {day.year}", f"{month} {day.day}, {day.year}", f"{day:%d} {month} {day.year}"]
    if day.day > 12:
        spellings += [f"{day:%m/%d/%Y}", f"{day.month}/{day.day}/{day.year}"]
    found = set()
    for s in spellings:
        new = there.renew(f"on {s}.")[0]
        assert back.renew(new)[0] == f"on {s}."
        own = new[3:-1]
        if s[0].isalpha() or month in s:
            parts = own.replace(",", "").split()
            parts = parts if parts[0].isdigit() else [parts[1], parts[0], parts[2]]
            found.add(dt.date(int(parts[2]), ps.MONTHS.index(parts[1]) + 1, int(parts[0])))
        else:
            n = [int(x) for x in re.split("[-/.]", own)]
            assert [len(x) for x in re.split("[-/.]", own)] == [len(x) for x in re.split("[-/.]", s)]
            found.add(dt.date(*n) if len(own.split(own[4])[0]) == 4 and not own[4].isdigit() else dt.date(n[2], n[0], n[1]) if n[1] > 12 else dt.date(n[2], n[1], n[0]))
    assert len(found) == 1 and found != {day}


def test_phones_of_the_tables():
    import pyarrow.parquet as pq

    there, followed = ps.Renewer(KEY), 0
    for text in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist():
        for m in re.finditer(r"\+1 \([0-9]{3}\) 555-[0-9]{4}(?![0-9])( [0-9])?", text or ""):
            value = m[0][:17]
            assert (m.start(), m.start() + 17, there.renew(value)[0]) in [(a, b, new) for a, b, _, new in there.spans(text)]
            followed += m[1] is not None
    assert followed >= 2


def test_links_stay_across_documents(spark):
    rows = [(1, "card 4111111111111111 and 4111 1111 1111 1111"), (2, "4111111111111111!"), (3, None), (4, ""), (3, "x" * 20000 + " 8.8.8.8 " * 500)]
    got = ps.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()
    by = {(r.doc_id, r.n_pii): r for r in got}
    first = by[1, 2].text.split()
    assert by[2, 1].text == first[1] + "!" and "".join(first[3:]) == first[1]
    assert by[3, 0].text is None and by[4, 0].text == ""
    assert by[3, 500].text.startswith("x" * 20000) and "8.8.8.8" not in by[3, 500].text
    assert by[1, 2].pii_spans == "card:5:21,card:26:45"
    restored = ps.pseudonymise(spark.createDataFrame(got), KEY, back=True).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in restored), key=repr) == sorted(rows, key=repr)


def test_empty_and_other_columns(spark):
    assert ps.pseudonymise(spark.createDataFrame([], DOCS), KEY).collect() == []
    df = spark.createDataFrame([("a", 7, "8.8.8.8", None)], "pii_spans string, n_pii int, text string, key binary")
    got = ps.pseudonymise(df, KEY)
    assert got.columns == ["text", "key", "pii_spans", "n_pii"] and got.first().n_pii == 1


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    kinds = Counter()
    for r in QUERIES["op6_pii_pseudonyms"](spark, sf).collect():
        text, spans = docs[r.doc_id], [s.split(":") for s in r.pii_spans.split(",") if s]
        assert len(spans) == r.n_pii
        if not spans:
            assert r.text == text
        kinds.update(s[0] for s in spans)
        for value in re.findall(r"(?<![0-9A-Za-z.])[0-9]{16}(?![0-9A-Za-z])|\+1 \([0-9]{3}\) 555-[0-9]{4}|[a-z.]+[0-9]+@mail[0-9]\.example\.com", text):
            if not value[0].isdigit() or luhn_right(value):
                assert value not in r.text
    assert kinds["card"] and kinds["phone"] and kinds["email"] and kinds["ip"]


def plain_permuted(kind, size, value):
    """The keyed permutation, written out: ten rounds on two halves, again while the result is too large."""
    bits = 1
    while 4**bits < size or bits < 1:
        bits += 1
    key = hashlib.blake2b(PII_KEY, digest_size=32).digest()
    while True:
        left, right = divmod(value, 2**bits)
        for i in range(10):
            mixed = hashlib.blake2b(f"{kind}|{size}|{i}|{right}".encode(), key=key, digest_size=32).digest()
            left, right = right, left ^ int.from_bytes(mixed, "little") % 2**bits
        value = left * 2**bits + right
        if value < size:
            return value


def plain_number(kind, digits):
    return f"{plain_permuted(kind, 10 ** len(digits), int(digits)):0{len(digits)}}"


def plain_value(value):
    """The kinds that the given documents have, each recognised as a whole and written out."""
    if m := re.fullmatch(r"([^@]+)(@.+)", value):
        size, number, form = 1, 0, ""
        for c in m[1]:
            base, low = (10, "0") if c.isdigit() else (26, "a") if c.islower() else (26, "A") if c.isupper() else (1, c)
            size, number, form = size * base, number * base + ord(c) - ord(low), form + low
        number, out = plain_permuted(f"email|{form}", size, number), ""
        for low in reversed(form):
            base = {"0": 10, "a": 26, "A": 26}.get(low, 1)
            number, part = divmod(number, base)
            out = chr(ord(low) + part) + out
        return "email", out + m[2]
    if m := re.fullmatch(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", value):
        digits = m[1] + m[2] + m[3]
        if digits[0] > "1" and digits[3] > "1":
            number = ((int(digits[:3]) - 200) * 800 + int(digits[3:6]) - 200) * 10000 + int(digits[6:])
            rest, line = divmod(plain_permuted("local phone", 800 * 800 * 10000, number), 10000)
            digits = f"{rest // 800 + 200}{rest % 800 + 200}{line:04}"
        else:
            digits = plain_number("phone+1", digits)
            while digits[0] > "1" and digits[3] > "1":
                digits = plain_number("phone+1", digits)
        return "phone", f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}"
    if re.fullmatch(r"\d{16}", value):
        if not luhn_right(value) or len(set(value)) == 1:
            return None
        body = plain_number("card", value[:15])
        return "card", next(body + c for c in "0123456789" if luhn_right(body + c))
    parts = [int(p) for p in value.split(".")]
    if max(parts) > 255 or any(str(int(p)) != p for p in value.split(".")) or parts[0] == 127 or not any(parts):
        return None
    number = 0
    for p in parts:
        number = number * 256 + p
    number = plain_permuted("ip", 2**32, number)
    while number >> 24 == 127 or not number:
        number = plain_permuted("ip", 2**32, number)
    return "ip", ".".join(str(number // 256**i % 256) for i in (3, 2, 1, 0))


PLAIN = re.compile(
    r"\+1 \(\d{3}\) \d{3}-\d{4}(?!\d)|(?<![\w.])\d{16}(?!\w)|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\w)|(?<![\w.%+-])[A-Za-z0-9._%+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,}", re.A
)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query_against_plain(spark, sf):
    """The whole output: every text, span and number."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got, kinds = QUERIES["op6_pii_pseudonyms"](spark, sf).collect(), Counter()
    assert len(got) == len(docs)
    for r in got:
        text, out, at, spans = docs[r.doc_id], "", 0, []
        for m in PLAIN.finditer(text or ""):
            if (new := plain_value(m[0])) is not None:
                out, at = out + text[at : m.start()] + new[1], m.end()
                spans.append(f"{new[0]}:{m.start()}:{m.end()}")
                kinds[new[0]] += 1
        assert r.text == (None if text is None else out + text[at:]), r.doc_id
        assert (r.pii_spans, r.n_pii) == (",".join(spans), len(spans))
    assert set(kinds) == {"email", "phone", "card", "ip"}
