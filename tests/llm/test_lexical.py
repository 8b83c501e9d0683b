"""Ranked search against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from quern.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, best=50):
    """Sorted (item_id, rank, doc_id, score) of rows (doc_id, text) and (item_id, text)."""
    found = [(i, Counter(terms_of(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n, total = len(found), sum(x[2] for x in found)
    df = Counter(w for _, c, _ in found for w in c)
    out = []
    for item, text in set(items):
        wanted = set(terms_of(text))
        scores = []
        for i, c, size in found:
            m = 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in wanted if c[w])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:best])]
    return Counter(out)


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, text string, rank int, score long, item int")


def test_nasty(spark, nasty, nothing):
    docs = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    by_id = dict(docs)
    some = by_id[0].split()
    items = [(1, " ".join(some[:9])), (1, " ".join(some[:9])), (1, "A b end"), (2, None), (3, ""), (4, "%% //"), (None, "idiot x"), (5, "テキスト 34 É"), (6, by_id[11]), (7, "nowhere0")]
    table = frame(spark, [(*x, 1, 2, 3) for x in items], "item_id")
    want = plain(docs, items)
    assert Counter(map(tuple, lexical.ranked(nasty, table).collect())) == want and {k[0] for k in want} >= {1, None, 6}
    assert Counter(map(tuple, lexical.ranked(nasty, table, block_bytes=60_000).collect())) == want
    assert lexical.ranked(nothing, table).count() == 0 and lexical.ranked(nasty, table.limit(0)).count() == 0
    assert lexical.ranked(nasty, table).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("bits", [2, 12])
def test_windows(spark, monkeypatch, bits):
    """Small windows, ids far apart and below zero, one id and one text for a third of all rows, ties at the border."""
    monkeypatch.setattr(lexical, "WINDOW_BITS", bits)
    monkeypatch.setattr(lexical, "WINDOW", 1 << bits)
    monkeypatch.setattr(lexical, "GATHER_ROWS", 50)
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)]
    docs = [(r.choice([k, k - 200, k * 10**12, None]), " ".join(r.choices(vocabulary, k=r.randint(0, 12)))) for k in range(200)] + [(7, "w1 w2 W3")] * 100
    items = [(k, " ".join(r.choices(vocabulary, k=4))) for k in range(12)] + [(50, "w1 w2 w3")]
    got = lexical.ranked(frame(spark, [(*x, 0, 0, 0) for x in docs], "doc_id").repartition(3), frame(spark, [(*x, 0, 0, 0) for x in items], "item_id"), best=20)
    assert Counter(map(tuple, got.collect())) == plain(docs, items, 20)


def test_long_text_is_counted_by_parts():
    raw = b"ab,CD " * 1000 + b"x" * 500 + b" ab"
    want = Counter({b"ab": 1001, b"cd": 1000, b"x" * 500: 1})
    assert lexical.term_counts(raw, 64) == (want, 2002) and lexical.term_counts(b"") == (Counter(), 0) and lexical.term_counts(b" ,", 1) == (Counter(), 0)
