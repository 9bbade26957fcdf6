import hashlib
import math
import random
import re
from collections import Counter

import pytest
from conftest import plan
from helpers import DOCS
from pyspark.sql import functions as F

from tidemark.llm import secret_scan as ss
from tidemark.llm.queries import QUERIES


def plain_base(text):
    text = text or ""
    spans = []
    keys = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    for m in re.finditer(keys + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def entropy(chars):
    return -sum(c / len(chars) * math.log2(c / len(chars)) for c in Counter(chars).values())


def cut(text, spans, least):
    """What is between spans, with its place."""
    ends = [0, *(b for _, b in spans)]
    starts = [*(a for a, _ in spans), len(text)]
    return [(a, text[a:b]) for a, b in zip(ends, starts, strict=True) if b - a >= least]


def words_only(part):
    left = re.sub(ss.HUMP, "", part)
    return bool(re.search(ss.PLAIN_PART, part)) or ss.LEAST_WORDS * len(left) <= len(part)


def plain_added(text, base):
    text, spans = text or "", []
    allowed = lambda x: any(re.search(p, x) for p in ss.ALLOWED)
    for kind, rule in ss.CLASSES.items():
        for m in re.finditer(rule.pattern, text):
            if allowed(m[0]):
                continue
            for start, piece in cut(m[0], [x.span() for x in re.finditer(ss.SHOWN.replace("(?i:", "(?i:"), m[0])], rule.window):
                words = [x.span() for x in re.finditer(ss.PART, piece) if words_only(x[0])] if rule.by_parts else []
                for more, own in cut(piece, words, rule.window):
                    if allowed(own):
                        continue
                    at, found = m.start() + start + more, []
                    for i in range(len(own) - rule.window + 1):
                        if entropy(own[i : i + rule.window]) >= rule.bits - 1e-9:
                            a, b = at + i, at + i + rule.window
                            if found and found[-1][2] >= a:
                                found[-1] = (found[-1][0], found[-1][1], b)
                            else:
                                found.append((a, ss.KINDS.index(kind), b))
                    spans += found
    return sorted(s for s in spans if not any(b[0] <= s[0] and b[2] >= s[2] for b in base))


def spelled(spans):
    return ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def expected(doc_id, text):
    base = plain_base(text)
    counts = Counter(k for _, k, _ in base)
    both = sorted(base + plain_added(text, base))
    return (doc_id, counts[0], counts[1], counts[2], hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(both), len(both) - len(base))


def texts():
    rng = random.Random(4)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    hexed, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    out = [None, "", " ", "password=abc", "password=abcdef", "PassWord : 'hunter22'", 'token": "a.b.c.d.e"', "secret=token: abcdefgh"]
    out += ["secret=token\": abcdef", "token == abcdefgh", "api_key=abcdef apikey:'abcdef'", "é😀 token=abcdef é", "ſecret=abcdef toKen=abcdef"]
    out += ["AKIA" + "A" * 15, "AKIA" + "B" * 16, "xAKIAAKIA" + "Z1" * 10 + "x", "a" * 23, "b" * 24, "0" * 30 + "g" + "1" * 24]
    out += [pick(hexed, 40) for _ in range(5)] + [pick(hexed, 40).upper() for _ in range(5)]
    out += [f"see {pick(b64, n)}== and {pick(b64, 20)}, {pick('ab1', 60)}" for n in (19, 20, 21, 40, 64, 200)]
    out += ["a" * 40 + pick(b64, 40) + "1" * 60 + pick(b64, 40) + "b" * 30, "123e4567-e89b-12d3-a456-426614174000", "some-path/with/parts-and-2-numbers/in/it"]
    out += ["x" * 30000 + " token=abcdef " + "y1" * 20000, "token=abcdef " * 300]
    out += [" ".join(rng.choice(["token", "=", ":", "password", "abc", "'", "AKIA", pick(b64, 18), pick(hexed, 25), "\n"]) for _ in range(60)) for _ in range(40)]
    out += ["".join(rng.choice(["token", "=", ":", "secret", "abc", "'", "AKIA", " ", pick(hexed, 9), "é"]) for _ in range(60)) for _ in range(40)]
    return out


def test_against_plain(spark):
    rows = list(enumerate(texts()))
    got = ss.digest(ss.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r) == expected(*rows[r.doc_id]), rows[r.doc_id][1][:200]
    assert sum(r.n_entropy for r in got) > 20


def test_keys_behind_prefixes_and_beside_shown_parts(spark):
    rng = random.Random(6)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    keys = [pick("0123456789ABCDEF", n) for n in (32, 40) for _ in range(20)]
    rows = [(f"{before}{k}{after}", k) for k in keys for before, after in (("live_", ""), ("key-", ""), ("a/", "/b"), ("x+", "-y"))]
    # a key of which every window has enough bits, at each end of a path with a part made to be shown
    key = "aZ3kQ9xW7vB2nM5pL8rT4yC6"
    rows += [(f"{key}/samples/in/it", key), (f"docs/sample-1/{key}", key), (f"Example_{key}", key), (f"{key}/dummy/{key}", key)]
    got = ss.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"))
    got = got.select("doc_id", "text", F.array_sort(F.concat("base_spans", "added_spans")).alias("s"))
    got = got.select("doc_id", ss.masked(F.col("text"), F.col("s")).alias("text")).collect()
    assert len(got) == len(rows)
    left = [rows[r.doc_id] for r in got if max((len(x) for x in re.findall("[0-9A-Z]+|" + key, r.text.replace(ss.MASK, " "))), default=0) > 12]
    assert len(left) <= 8, left  # keys of which some windows have few bits
    assert all(key not in r.text for r in got)


def test_what_is_allowed_stays(spark):
    texts = ["sha256-" + "0123456789ABCDEF" * 3, "order-12345678901234567890", "aZ3kQ9xW7vEXAMPLEB2nM5pL8rT4yC6", "Sample/some-path/with/2-parts", "123E4567-E89B-12D3-A456-426614174000"]
    got = ss.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.added_spans == [] for r in got), got


CLEAN = [
    "https://host/a-b/c-d-e/f1/long-path-name-2024-release",
    "com.acme/Foo2Bar/BazQuxHandler",
    "ThisIsAVeryLongCamelCaseIdentifierName2",
    "/usr/local/lib/python3/site-packages/numpy/core/_multiarray_umath",
    "org/apache/hadoop/mapreduce/v2/app/job/impl/TaskAttemptImpl2",
    "get_user_account_by_id_v2/MAX_RETRY_COUNT_3",
    "getHttpServletRequestWrapperFactory2Bean",
    "images/2024/05/13/summer-holiday-photo-12-large",
    "My-First-Blog-Post-About-7-Things-You-Should-Know",
    "test_module_name_01/test_class_name_02/test_case_03",
    "data-toggle-collapse-target-navbar-1",
    "AbstractSingletonProxyFactoryBean4Test",
]


def test_paths_and_identifiers_are_clean(spark):
    got = ss.scan(spark.createDataFrame(list(enumerate(CLEAN)), "doc_id long, text string")).collect()
    assert [CLEAN[r.doc_id] for r in got if r.added_spans] == []


def test_recall_of_random_keys(spark):
    """Of keys in prose, in paths and behind names, how many are found at all."""
    rng = random.Random(9)
    alphabets = {
        "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
        "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    }
    rows = []
    for name, letters in alphabets.items():
        for size in (24, 32, 40):
            for _ in range(100):
                key = "".join(rng.choice(letters) for _ in range(size))
                around = rng.choice(["see {} here", "files/{}/read-me", "name_{}", "x: {}."])
                rows.append((len(rows), around.format(key), name, size))
    df = spark.createDataFrame(rows, "doc_id long, text string, alphabet string, size int")
    found = ss.scan(df).select("alphabet", "size", (F.size("added_spans") > 0).cast("int").alias("hit"))
    share = {(r.alphabet, r.size): r.share for r in found.groupBy("alphabet", "size").agg(F.avg("hit").alias("share")).collect()}
    assert len(share) == 12
    assert all(s >= {24: 0.7, 32: 0.9, 40: 0.95}[size] for (_, size), s in share.items()), share  # over 1,000 keys in base 36: 0.89, 0.95, 0.98


@pytest.mark.parametrize("name", ["pages", "documents"])
def test_clean_tables_stay_clean(spark, name):
    """The given pages and documents have no key that only its entropy shows."""
    df = spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    texts = df.select(F.col("url" if name == "pages" else "text").alias("text")).union(df.select("html" if name == "pages" else "text"))
    assert ss.scan(texts).where(F.size("added_spans") > 0).isEmpty()


def test_mask(spark):
    rows = list(enumerate(texts()))
    df = ss.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = df.select("doc_id", ss.masked(F.coalesce("text", F.lit("")), F.array_sort(F.concat("base_spans", "added_spans"))).alias("t")).collect()
    for r in got:
        text = rows[r.doc_id][1] or ""
        base = plain_base(text)
        hidden = sorted(base + plain_added(text, base))
        out, at = "", 0
        while hidden:
            a, _, b = hidden.pop(0)
            while hidden and hidden[0][0] <= b:
                b = max(b, hidden.pop(0)[2])
            out, at = out + text[at:a] + ss.MASK, b
        assert r.t == out + text[at:]


def test_edges(spark):
    assert ss.scan(spark.createDataFrame([], DOCS)).collect() == []
    df = spark.createDataFrame([(1, "token=abcdef", 7, "s"), (1, "token=abcdef", 7, "s"), (None, None, None, None)], "doc_id long, text string, base_spans int, kind string")
    got = ss.scan(df)
    assert got.columns == ["doc_id", "text", "base_spans", "kind", "added_spans"]
    assert [r.n_assign for r in ss.digest(got).collect()] == [1, 1, 0]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    df = QUERIES["op3_secret_scan"](spark, sf)
    assert not any(x in plan(df) for x in ("Python", "Arrow", "Pandas"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = df.collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r) == expected(r.doc_id, docs[r.doc_id])
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
