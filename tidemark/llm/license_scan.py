"""License scans by an index of rare words with positions, with DataFrame functions only.

Templates are notices that licences ask for, as words. The index has the words that few
templates have (the highest inverse document frequencies), with the templates and the
positions where they stand. A file's words of the index are looked up; each posting says
where the template would begin in the file: the file's position less the template's.
Postings of a template that agree on this beginning are counted, and where half of its
indexed words agree, the template is a candidate there. Its mandatory key phrases must
then stand at their places, and the share of its words that do is its score. Words of the
index are taken by their frequency, not by a number per file, so that a file with many
notices loses none.

Everything is a function of one row, so nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places count, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices of public licences in words, with the phrases that must be there.
TEMPLATES = (
    ("agpl-notice", "it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license as published by",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("any purpose with or without fee",)),
    ("lgpl-notice", "it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("person obtaining a copy of this software", "deal in the software without restriction")),
    ("mit-reference", "released under the mit license", ("mit license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("held liable for any damages",)),
)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INDEXED_BY = 2
"""Words that more templates have are not in the index."""
LEAST_AGREE, LEAST_SHARE = (1, 2), (7, 10)


def place(words: list[str], phrase: str) -> int:
    """Where a phrase begins."""
    own = phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(own)] == own)


def frequencies(templates=TEMPLATES) -> Counter:
    """How many templates have each word."""
    return Counter(word for _, text, _ in templates for word in set(text.split()))


def idf(word: str, templates=TEMPLATES) -> float:
    return math.log(len(templates) / frequencies(templates)[word])


def postings(templates=TEMPLATES, indexed_by: int = INDEXED_BY) -> dict[str, list[tuple[int, int]]]:
    """Each indexed word with the templates and positions it has."""
    count, found = frequencies(templates), {}
    for t, (_, text, _) in enumerate(templates):
        for i, word in enumerate(text.split()):
            if count[word] <= indexed_by:
                found.setdefault(word, []).append((t, i))
    return found


def needed(templates=TEMPLATES) -> list[int]:
    """How many postings of each template must agree."""
    own = Counter(t for places in postings(templates).values() for t, _ in places)
    return [max(1, -(-own[t] * LEAST_AGREE[0] // LEAST_AGREE[1])) for t in range(len(templates))]


def keys(text: str, phrases: tuple[str, ...]) -> list[int]:
    """The positions of the words of mandatory phrases."""
    words = text.split()
    return sorted({place(words, p) + i for p in phrases for i in range(len(p.split()))})


def _only(value: Column, use) -> Column:
    """Name a value for one expression, so that it is computed once."""
    return F.transform(F.array(value), use)[0]


def _all(conditions) -> Column:
    total = F.lit(True)
    for condition in conditions:
        total = total & condition
    return total


def words_of(text: Column) -> Column:
    """The words in lower case (A-Z only). The Kelvin sign, whose lower case would be a plain k, becomes another sign."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("K"), F.lit("µ"))), F.lit(WORD), F.lit(0))


PLACES = "array<struct<start:int,label:string>>"
FOUND = "array<struct<label:string,start:int,share:double>>"


def _phrases(words: Column, hits: Column) -> Column:
    """Where the fixed phrases stand."""

    def places(phrase: str, label: str) -> Column:
        stands = lambda i: _all(F.get(words, i + j).eqNullSafe(F.lit(w)) for j, w in enumerate(phrase.split()))
        return F.transform(F.filter(hits, stands), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    return F.array_sort(F.concat(*[places(*fixed) for fixed in PHRASES])).cast(PLACES)


def _candidates(words: Column, hits: Column) -> Column:
    """Templates and beginnings on which enough postings agree, as an array of structs."""
    index = F.create_map(*[x for w, own in postings().items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in own]))])
    none = F.array().cast("array<struct<t:int,at:int>>")
    looked_up = lambda i: F.transform(F.element_at(index, F.get(words, i)), lambda p: F.struct(p["t"].alias("t"), (i - p["q"]).alias("at")))
    begins = F.array_sort(F.flatten(F.transform(hits, lambda i: F.coalesce(looked_up(i), none))))
    need = F.array(*[F.lit(n) for n in needed()])

    def count(s: Column, x: Column) -> Column:
        n = F.when((s["t"] == x["t"]) & (s["at"] == x["at"]), s["n"] + 1).otherwise(F.lit(1))
        return _only(
            n,
            lambda n: F.struct(
                x["t"].alias("t"),
                x["at"].alias("at"),
                n.alias("n"),
                F.when(n == F.get(need, x["t"]), F.array_append(s["found"], x)).otherwise(s["found"]).alias("found"),
            ),
        )

    start = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("at"), F.lit(0).alias("n"), none.alias("found"))
    return F.aggregate(begins, start, count, lambda s: s["found"])


def _verified(words: Column, candidates: Column) -> Column:
    """Candidates with their key phrases in place and enough of their words."""
    templates = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, text.split())).alias("words"), F.array(*map(F.lit, keys(text, phrases))).alias("keys"))
            for label, text, phrases in TEMPLATES
        ]
    )

    def judge(c: Column) -> Column:
        def of(t: Column) -> Column:
            stands = lambda j: F.get(words, c["at"] + j).eqNullSafe(F.get(t["words"], j))
            size = F.size(t["words"])
            there = F.size(F.filter(F.sequence(F.lit(0), size - 1), stands))
            share = F.when(F.forall(t["keys"], stands) & (LEAST_SHARE[1] * there >= LEAST_SHARE[0] * size), there / size)
            return F.struct(t["label"].alias("label"), c["at"].alias("start"), share.alias("share"))

        return _only(F.get(templates, c["t"]), of)

    return F.filter(F.transform(candidates, judge), lambda x: x["share"].isNotNull()).cast(FOUND)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their licences.

    Adds ``n_words``; ``phrases``, the places (word numbers from 0) where a fixed phrase
    stands, with its label; and ``notices``, the templates found with label, the word
    number where they begin (negative if the file begins within the notice) and the share
    of their words that stand at their places. Other columns pass through; columns of
    these three names are replaced. Words are what is between ASCII characters other than
    digits and letters. Null text counts as empty: no words, nothing found. Each row is
    judged for itself, repeated ones too.
    """
    vocabulary = sorted(set(postings()) | {phrase.split()[0] for phrase, _ in PHRASES})
    literal = F.array(*map(F.lit, vocabulary))

    def found(words: Column) -> Column:
        met = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*vocabulary), i)), lambda i: i.isNotNull())
        hits = F.when(F.arrays_overlap(words, literal), met).otherwise(F.array().cast("array<int>"))
        return _only(
            hits,
            lambda hits: F.struct(
                F.size(words).cast("long").alias("n_words"),
                _phrases(words, hits).alias("phrases"),
                _verified(words, _candidates(words, hits)).alias("notices"),
            ),
        )

    own = "_found"
    while own in map(str.lower, docs.columns):
        own += "_"
    names = ("n_words", "phrases", "notices")
    scanned = docs.withColumn(own, _only(words_of(F.coalesce(F.col(text), F.lit(""))), found))
    return scanned.withColumns({name: F.col(f"{own}.{name}") for name in names}).drop(own)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and places of the fixed phrases, the labels of both kinds, and a score.

    The score is 1 with a fixed phrase, else the largest share of a notice, else 0.
    """
    base, own = F.transform("phrases", lambda p: p["label"]), F.transform("notices", lambda n: n["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("phrases", lambda p: p["start"].cast("long"))
    share = F.coalesce(F.array_max(F.transform("notices", lambda n: n["share"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )


def _values(rows) -> str:
    cell = lambda x: "'" + x + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)


#: The same by joining the words of ``documents`` with the index and the templates.
SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents
), p AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM w
), fixed(word, label, phrase) AS (
  VALUES {", ".join("('%s', '%s', [%s])" % (p.split()[0], label, ", ".join(f"'{x}'" for x in p.split())) for p, label in PHRASES)}
), f AS (
  SELECT r, label, i FROM p JOIN fixed USING (word) JOIN w USING (r) WHERE words[i + 1:i + len(phrase)] = phrase
), posting(word, t, q) AS (
  VALUES {_values((word, t, q) for word, own in postings().items() for t, q in own)}
), needed(t, label, size, need) AS (
  VALUES {_values((t, TEMPLATES[t][0], len(TEMPLATES[t][1].split()), n) for t, n in enumerate(needed()))}
), part(t, j, word, is_key) AS (
  VALUES {_values((t, j, word, j in keys(text, phrases)) for t, (_, text, phrases) in enumerate(TEMPLATES) for j, word in enumerate(text.split()))}
), c AS (
  SELECT r, t, i - q AS start FROM p JOIN posting USING (word) JOIN needed USING (t) GROUP BY r, t, start, need HAVING count(*) >= need
), v AS (
  SELECT c.r, c.t, c.start, count(p.i) AS there
  FROM c JOIN part ON part.t = c.t LEFT JOIN p ON p.r = c.r AND p.i = c.start + j AND p.word = part.word
  GROUP BY c.r, c.t, c.start HAVING bool_and(NOT is_key OR p.i IS NOT NULL)
), n AS (
  SELECT r, label, there / size AS share FROM v JOIN needed USING (t) WHERE {LEAST_SHARE[1]} * there >= {LEAST_SHARE[0]} * size
), a AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM f UNION ALL SELECT r, label FROM n) GROUP BY r
), b AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM f GROUP BY r
), s AS (
  SELECT r, max(share) AS share FROM n GROUP BY r
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN a USING (r) LEFT JOIN b USING (r) LEFT JOIN s USING (r)
"""
