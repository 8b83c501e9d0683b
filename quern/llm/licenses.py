"""Licence scans with a positional index of rare words. DataFrame functions alone; no Python runs on executors.

Templates are notices as words, with phrases of them that must be in place. The words' document frequencies are counted over
all files. Of each template's mandatory phrases the two postings (word, position) of the highest IDF are its index entries.
A file's occurrences of index words are looked up; a template's postings shifted by their positions and intersected give the
offsets at which it may stand; there its mandatory phrases are verified word by word. As every verified place holds all words
of these phrases, the index loses none. Verified places of the base phrases are the base labels. A notice gives its label
where the words in place have at least MIN_SHARE of its IDF weight; the score is the largest share of any notice at a
verified place. A file is read where it lies: nothing of a text is shuffled, and a row's work is linear in its words.

Defined results: a null or empty text has no words, no places, empty labels, score 0. Repeated rows are scanned each for
itself. A notice that starts before the text's first word counts with the words that are there. Null doc_ids stay null.
Other columns, also ones named like the results, are ignored. An empty table gives an empty result. Templates travel as
literals of the plan: meant for hundreds of notices of up to some hundred words.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

#: Words are looked for after lower(), which differs from folding A-Z only in words that aren't ASCII, and in the Kelvin sign.
WORDS = r"[0-9a-z\x80-\x{10FFFF}]+"
MIN_SHARE = 0.5

# The base phrases with their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# Notices as words, each with its label and its mandatory phrases.
NOTICES = [
    ("mit-notice", "released under the mit license", ["mit license"]),
    ("expat", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache-notice", "licensed under the apache license", ["apache license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-notice", "licensed under the gnu general public license", ["general public license"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["general public license as published by the free software foundation", "any later version"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee is hereby granted"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("epl-2.0", "made available under the terms of the eclipse public license v 2 0", ["eclipse public license"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", ["provided as is without any express or implied warranty"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-attribution", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
]


class Template(NamedTuple):
    label: str
    words: list[str]
    keys: list[tuple[int, list[str]]]

    @property
    def key_places(self) -> list[int]:
        return sorted({at + k for at, phrase in self.keys for k in range(len(phrase))})


def template(label: str, text: str, phrases: list[str]) -> Template:
    words, keys = text.split(), []
    if not re.fullmatch(r"[a-z0-9.-]+", label) or not all(re.fullmatch(r"[a-z0-9]+", w) for w in words):
        raise ValueError(f"{label}: notices are words of a-z and 0-9, with labels of these, points and hyphens")
    for p in map(str.split, phrases):
        at = next((k for k in range(len(words)) if words[k : k + len(p)] == p), None)
        if at is None or not p:
            raise ValueError(f"{label}: the notice doesn't hold the phrase {' '.join(p)!r}")
        keys.append((at, p))
    if not keys:
        raise ValueError(f"{label}: a notice needs a mandatory phrase")
    return Template(label, words, keys)


#: A text's words; U+212A is the Kelvin sign, U+212B stays outside ASCII.
WORDS_OF = rf"regexp_extract_all(lower(replace(coalesce(cast(text AS string), ''), '\u212a', '\u212b')), r'{WORDS}', 0)"


def strings(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def weights(docs: DataFrame, templates: list[Template]) -> dict[str, int]:
    """1000 times the IDF of every template word, over all files, as whole numbers. A row for each word comes back."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = docs.selectExpr(f"explode(array_intersect({WORDS_OF}, {strings(vocabulary)})) AS word").groupBy("word").agg(F.count("*").alias("n"))
    df, n = {r.word: r.n for r in found.collect()}, docs.count()
    return {w: math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(w, 0) + 1))) for w in vocabulary}


def postings(t: Template, idf: dict[str, int]) -> list[tuple[str, int]]:
    """The two postings of the highest IDF among the words of the mandatory phrases."""
    return [(t.words[k], k) for k in sorted(t.key_places, key=lambda k: (-idf[t.words[k]], t.words[k], k))[:2]]


def places(t: Template, idf: dict[str, int]) -> str:
    """SQL for the offsets at which the template's mandatory phrases stand, one each; an offset is where its first word would
    be. `words` are the file's, `hits` its occurrences of index words."""
    shifted = [f"transform(filter(hits, h -> h.word = '{w}'), h -> h.at - {at})" for w, at in postings(t, idf)]
    offsets = shifted[0] if len(shifted) == 1 else f"array_intersect({', '.join(shifted)})"
    stands = (f"o + {at} >= 0 AND slice(words, greatest(o + {at + 1}, 1), {len(phrase)}) = {strings(phrase)}" for at, phrase in t.keys)
    return f"filter({offsets}, o -> {' AND '.join(stands)})"


def share(t: Template, idf: dict[str, int]) -> str:
    """SQL for the part of the template's weight that is in place at offset o."""
    gains = [idf[w] for w in t.words]
    there = f"aggregate(sequence(0, {len(gains) - 1}), 0, (s, k) -> s + if(get(words, o + k) <=> get({strings(t.words)}, k), get(array({', '.join(map(str, gains))}), k), 0))"
    return f"{there} / {sum(gains)}D" if sum(gains) else "1D"


PLACE, SCORED = "array<struct<label:string,at:int>>", "array<struct<label:string,at:int,share:double>>"


def scanned(docs: DataFrame, notices: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices (label, first word, share)."""
    base = [template(label, phrase, [phrase]) for label, phrase in BASE]
    own = [template(*x) for x in (NOTICES if notices is None else notices)]
    idf = weights(docs, base + own)
    index = sorted({w for t in base + own for w, _ in postings(t, idf)})
    # Most files hold no index word, which a test over a hash set tells.
    some = f"filter(sequence(0, size(words)), k -> get(words, k) IN ({strings(index)[6:-1]}))"
    hits = f"if(arrays_overlap(words, {strings(index)}), transform({some}, k -> struct(get(words, k) AS word, k AS at)), cast(array() AS array<struct<word:string,at:int>>))"
    phrases = [f"transform({places(t, idf)}, o -> struct('{t.label}' AS label, o AS at))" for t in base]
    held = [f"transform({places(t, idf)}, o -> struct('{t.label}' AS label, o AS at, {share(t, idf)} AS share))" for t in own]
    found = f"struct(concat({', '.join(phrases)}) AS base, concat({', '.join([f'cast(array() AS {SCORED})', *held])}) AS own)"
    # A list of one value stands for a name: the words, and what was looked up, are made once for a row.
    looked_up = f"get(transform(array({hits}), hits -> if(size(hits) > 0, {found}, cast(null AS struct<base:{PLACE},own:{SCORED}>))), 0)"
    row = f"get(transform(array({WORDS_OF}), words -> struct(cast(size(words) AS long) AS n_words, {looked_up} AS found)), 0)"
    labels = "array_distinct(coalesce(f.found.base.label, cast(array() AS array<string>)))"
    mine = f"filter(coalesce(f.found.own, cast(array() AS {SCORED})), x -> x.share >= {MIN_SHARE}).label"
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", f"{row} AS f").selectExpr(
        "doc_id", "f.n_words AS n_words", "cast(coalesce(size(f.found.base.at), 0) AS long) AS n_base",
        "cast(array_min(f.found.base.at) AS long) AS first_word", "cast(array_max(f.found.base.at) AS long) AS last_word",
        f"array_join(sort_array({labels}), ',') AS base_labels", f"array_join(sort_array(array_union({labels}, {mine})), ',') AS labels",
        "coalesce(array_max(f.found.own.share), 0D) AS score", "f.found.own AS notices",
    )


def labelled(docs: DataFrame) -> DataFrame:
    """The scan without its list of notices."""
    return scanned(docs).drop("notices")


def sql() -> str:
    """The same by brute force over all words and offsets, for DuckDB."""
    rows = []
    for k, (t, is_base) in enumerate([(template(x, p, [p]), True) for x, p in BASE] + [(template(*x), False) for x in NOTICES]):
        keys = set(t.key_places)
        rows += [f"({k}, '{t.label}', {is_base}, {j}, '{w}', {int(j in keys)})" for j, w in enumerate(t.words)]
    return f"""
WITH t(t, label, is_base, j, word, is_key) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
p AS (SELECT r, word, i FROM (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM d) WHERE word IN (SELECT word FROM t)),
f AS (SELECT word, count(DISTINCT r) AS n FROM p GROUP BY word),
w AS (SELECT word, CAST(floor(1000 * ln(CAST(2 * (SELECT count(*) FROM d) + 2 AS DOUBLE) / CAST(2 * coalesce(max(n), 0) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t LEFT JOIN f USING (word) GROUP BY word),
s AS (SELECT t, sum(w) AS total, sum(is_key) AS need FROM t JOIN w USING (word) GROUP BY t),
m AS (SELECT r, t, label, is_base, i - j AS o, sum(w) AS hit, sum(is_key) AS got FROM p JOIN t USING (word) JOIN w USING (word) GROUP BY ALL),
v AS (SELECT r, label, is_base, o, CASE WHEN total = 0 THEN 1.0 ELSE CAST(hit AS DOUBLE) / CAST(total AS DOUBLE) END AS share FROM m JOIN s USING (t) WHERE got = need),
g AS (SELECT r, count(*) FILTER (is_base) AS n_base, min(o) FILTER (is_base) AS first_word, max(o) FILTER (is_base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base OR share >= {MIN_SHARE}) AS labels, max(share) FILTER (NOT is_base) AS score FROM v GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (r)
"""
