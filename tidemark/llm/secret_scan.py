"""Secret scans with DataFrame functions only: fixed patterns, and entropy in sliding windows.

Candidates of the entropy scan are runs of one character class: hexadecimal digits, or
the characters of base 64 and its variants. A hexadecimal part of a longer run, between
its signs, is a candidate of its own, as keys come behind prefixes. A window slides over each candidate; the
counts of its characters change by one step in and one step out, and with them the sum
of c * log2(c), from which the window's Shannon entropy follows. Windows over their
class's threshold become spans, overlapping ones a single span. Candidates on the
allow-list are passed over: they look random and are no secrets. Parts made to be shown
are passed over for themselves; what comes before and after them is judged. So are, in
paths and identifiers, the parts between signs that are words or short numbers: a path of
many different words has much entropy and holds no key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_b64")
BASE_KINDS = KINDS[:3]
MASK = "[SECRET]"


@dataclass(frozen=True)
class CharacterClass:
    """Candidates, the window in characters, and the entropy in bits from which it counts."""

    pattern: str
    window: int
    bits: float
    by_parts: bool = False


CLASSES = {
    "entropy_hex": CharacterClass(
        r"(?<![A-Za-z0-9])(?<!sha1-)(?<!sha256-)(?<!sha384-)(?<!sha512-)[0-9A-Fa-f]{20,}(?![A-Za-z0-9])", 20, 3.0
    ),
    "entropy_b64": CharacterClass(r"[A-Za-z0-9+/_-]{20,}={0,2}", 20, 3.7, by_parts=True),
}
ALLOWED = (
    r"^[0-9]+$",  # a number
    r"^[^0-9]*$",  # words: no digit at all
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",  # a UUID
    r"^sha(1|256|384|512)-",  # a digest that pages publish
)
PART = r"[A-Za-z0-9]+"
HUMP = r"[A-Z]?(?=[a-z]*[aeiouy])(?![a-z]*[b-df-hj-np-tv-xz]{5})[a-z]{2,}"
"""A word or a part of a name in camel case: it has a vowel, and never five consonants in a row."""
PLAIN_PART = r"^([0-9]{1,8}|[A-Z]{2,15})$"
LEAST_WORDS = 4
"""A part is words if all but a fourth of its characters are in such."""
SHOWN = r"(?<![A-Za-z0-9])[A-Za-z0-9]*(?i:example|sample|dummy|xxxx)[A-Za-z0-9]*[+/_-]*"


def found(text: Column, pattern: str, kind: str, least_of_group: int = 0) -> Column:
    """Where a pattern matches, leftmost first without overlap, as an array of spans.

    The pieces between the matches and the matches themselves add up to the offsets.
    """
    parts = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    group = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda g: F.length(g)) if least_of_group else matches
    steps = F.arrays_zip(F.slice(parts, F.lit(1), F.size(matches)).alias("gap"), matches.alias("size"), group.alias("part"))
    kind_no = F.lit(KINDS.index(kind))
    empty = no_spans()
    start = lambda s, x: s["at"] + x["gap"]
    spans = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda s, x: F.struct(
            (start(s, x) + x["size"]).alias("at"),
            F.when(
                x["part"] >= least_of_group,
                F.array_append(s["spans"], F.struct(start(s, x).alias("start"), kind_no.alias("kind"), (start(s, x) + x["size"]).alias("end"))),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _only(value: Column, use) -> Column:
    """Name a value for one expression, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def busy_windows(candidate: Column, window: int, bits: float) -> Column:
    """The parts of a candidate in windows of at least so many bits, as an array of start and end.

    Walks over the characters once. Its state has the count of each character of the
    window, the sum of c * log2(c) over them, and the spans so far.
    """
    chars = F.filter(F.split(candidate, ""), lambda c: c != "")
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    term = lambda c: F.element_at(terms, c + 1)
    most = window * (math.log2(window) - bits)

    def walk(codes: Column, letters: Column) -> Column:
        def step(s, i):
            def move(m):
                count = lambda code: F.when(code > 0, F.element_at(s["counts"], code)).otherwise(F.lit(0))
                counts = F.transform(
                    s["counts"],
                    lambda c, k: c + F.when(k + 1 == m["new"], 1).otherwise(0) - F.when(k + 1 == m["old"], 1).otherwise(0),
                )
                come, gone = count(m["new"]), count(m["old"])
                change = F.when(m["new"] == m["old"], F.lit(0.0)).otherwise(
                    term(come + 1) - term(come) + F.when(m["old"] > 0, term(F.greatest(gone - 1, F.lit(0))) - term(gone)).otherwise(F.lit(0.0))
                )
                total = s["total"] + change
                spans = s["spans"]
                last = F.element_at(spans, -1)
                joins = (F.size(spans) > 0) & (F.coalesce(last["end"], F.lit(-1)) >= i - window)
                one = F.struct(F.when(joins, last["start"]).otherwise(i - window).alias("start"), i.alias("end"))
                before = F.when(joins, F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0)))).otherwise(spans)
                busy = (i >= window) & (total <= F.lit(most + 1e-9))
                return F.struct(
                    counts.alias("counts"), total.alias("total"), F.when(busy, F.array_append(before, one)).otherwise(spans).alias("spans")
                )

            old = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
            return _only(F.struct(F.element_at(codes, i).alias("new"), old.alias("old")), move)

        start = F.struct(
            F.transform(letters, lambda _: F.lit(0)).alias("counts"),
            F.lit(0.0).alias("total"),
            F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
        )
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda s: s["spans"])

    coded = lambda x: F.transform(x["chars"], lambda c: F.array_position(x["letters"], c).cast("int"))
    named = F.struct(chars.alias("chars"), F.array_distinct(chars).alias("letters"))
    return _only(named, lambda x: _only(coded(x), lambda codes: walk(codes, x["letters"])))


def entropy_spans(text: Column, kind: str, rule: CharacterClass) -> Column:
    """The spans of one class over a text."""
    allowed = lambda c: F.lit(False) if not ALLOWED else _any(c.rlike(p) for p in ALLOWED)
    candidate = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])

    none = F.array().cast("array<struct<start:int,end:int>>")

    def pieces(shown, length):
        """What is between spans, if a window fits in."""
        starts = F.concat(F.array(F.lit(0)), F.transform(shown, lambda x: x["end"]))
        ends = F.concat(F.transform(shown, lambda x: x["start"]), F.array(length))
        both = F.arrays_zip(starts.alias("start"), ends.alias("end"))
        return F.filter(both, lambda p: p["end"] - p["start"] >= rule.window)

    def between(c):
        """The pieces of a candidate between its parts made to be shown."""
        return _only(found(c, SHOWN, kind), lambda shown: pieces(shown, F.length(c)))

    def without_words(c):
        """The pieces of a piece between its parts that are words."""
        part = lambda p: F.substring(c, p["start"] + 1, p["end"] - p["start"])
        return _only(F.filter(found(c, PART, kind), lambda p: is_words(part(p))), lambda words: pieces(words, F.length(c)))

    def inside(c, cut, judge):
        """What is judged in each piece, as spans of the whole."""

        def of_piece(p):
            moved = lambda b: F.struct((p["start"] + b["start"]).alias("start"), (p["start"] + b["end"]).alias("end"))
            return F.transform(_only(F.substring(c, p["start"] + 1, p["end"] - p["start"]), judge), moved)

        return F.flatten(F.transform(cut(c), of_piece))

    def windows(part):
        return F.when(~allowed(part), busy_windows(part, rule.window, rule.bits)).otherwise(none)

    def busy(c):
        judge = (lambda piece: inside(piece, without_words, windows)) if rule.by_parts else windows
        return F.when(~allowed(c), inside(c, between, judge)).otherwise(none)

    def of(s):
        return F.transform(
            _only(candidate(s), busy),
            lambda b: F.struct((s["start"] + b["start"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (s["start"] + b["end"]).alias("end")),
        )

    return F.flatten(F.transform(found(text, rule.pattern, kind), of))


def is_words(part: Column) -> Column:
    """Whether a part between signs is made of words, or is a short number or one word in capitals."""
    rest = F.length(F.regexp_replace(part, HUMP, ""))
    return part.rlike(PLAIN_PART) | (LEAST_WORDS * rest <= F.length(part))


def _any(conditions) -> Column:
    total = F.lit(False)
    for condition in conditions:
        total = total | condition
    return total


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their secrets, as ``base_spans`` and ``added_spans``.

    Both are arrays of ``start, kind, end`` in code points, sorted, ``kind`` an index
    of ``KINDS``. Base spans are the matches of the three patterns; an assignment
    needs a value of 6 characters. Added spans have high entropy and do not lie within
    a base span. All other columns pass through; columns of these two names are
    replaced. Null text counts as empty and has no spans.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(found(whole, ASSIGN, "assign", 6), found(whole, ACCESS, "access"), found(whole, HEX, "hex"))
    docs = docs.withColumn("base_spans", F.array_sort(base))
    added = F.concat(*[entropy_spans(whole, kind, rule) for kind, rule in CLASSES.items()])
    inside = lambda s: F.exists("base_spans", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    return docs.withColumn("added_spans", F.array_sort(F.filter(added, lambda s: ~inside(s))))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans spelled out."""
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(spelled(F.col("base_spans")), 256).alias("base_sha256"),
        spelled(F.array_sort(F.concat("base_spans", "added_spans"))).alias("spans"),
        F.size("added_spans").cast("long").alias("n_entropy"),
    )


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """A text with each run of overlapping spans replaced by a mark; spans are sorted by start."""
    runs = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda runs, s: F.when(
            (F.size(runs) > 0) & (F.element_at(runs, -1)["end"] >= s["start"]),
            F.array_append(
                F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))),
                F.struct(F.element_at(runs, -1)["start"].alias("start"), F.greatest(F.element_at(runs, -1)["end"], s["end"]).alias("end")),
            ),
        ).otherwise(F.array_append(runs, F.struct(s["start"].alias("start"), s["end"].alias("end")))),
    )

    def cut(runs):
        after = lambda i: F.when(i > 0, F.element_at(runs, F.greatest(i, F.lit(1)))["end"]).otherwise(F.lit(0))
        until = lambda i: F.when(i < F.size(runs), F.element_at(runs, F.least(i + 1, F.size(runs)))["start"]).otherwise(F.length(text))
        gaps = F.transform(F.sequence(F.lit(0), F.size(runs)), lambda i: F.substring(text, after(i) + 1, until(i) - after(i)))
        return F.array_join(gaps, mask)

    return F.when(F.size(spans) > 0, _only(runs, cut)).otherwise(text)
