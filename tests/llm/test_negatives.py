"""Hard negatives against plain Python."""

import math
import random

import numpy as np
import pytest

from quern.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, d string"


def plain(rows):
    """Sorted results for rows (vec_id, embedding, label)."""
    part = {(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, ya, va in part:
        if a % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(va, v)), i, y == ya) for i, y, v in part if i != a]
        for ps, p, _ in sorted(x for x in scores if x[2])[:5]:
            ps = -ps
            some = sorted((s, i) for s, i, same in scores if not same and 80 * ps <= 100 * -s <= 100 * ps)[:5]
            out += [(a, p, k + 1, i, ps, -s) for k, (s, i) in enumerate(some)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "d") for r in rows], SCHEMA).repartition(3)


def vectors(r, n, width, spread=1.0):
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(k * r.choice([1, 1, 5]) if k else 0, [c + r.gauss(0, spread) for c in centres[y % 6]], y) for k in range(n) for y in [r.randint(0, 11)]]


def check(spark, rows):
    got = negatives.mined(frame(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got, want = sorted(map(tuple, got.collect())), plain(rows)
    assert got == want
    return len(want)


def test_nasty(spark):
    """Nulls, values that aren't finite, empty and short vectors, copies under one id and under many, ids that repeat with
    other vectors, negative ids."""
    r = random.Random(8)
    rows = vectors(r, 150, 5)
    same = [2.0, 1.0, 0.0, -1.0, 0.5]
    rows += [(1000 + k, same, k % 3) for k in range(60)] + [(2100, same, 1)] * 20 + [(100, [1.0, 2.0], 4), (100, [0.5], 4), (-200, [1.0] * 5, 2), (-7, [1.0] * 5, 9), (3000, [], 4), (3001, [], 4), (3002, [], 5)]
    rows += [(None, same, 1), (5000, None, 1), (5100, same, None), (5200, [1.0, None], 1), (5300, [float("nan")], 1), (5400, [float("inf")], 1), (5500, [1e-3] * 5, 3)]
    assert check(spark, rows) > 100
    assert negatives.mined(frame(spark, rows[:1]).limit(0)).count() == 0
    assert check(spark, [(0, [1.0], 1)]) == 0


def test_chunks_and_long_integers(spark, monkeypatch):
    """Groups of many chunks, chunks of many tiles; then components so large that doubles would round."""
    for name, value in (("CHUNK_ROWS", 16), ("TILE", 5), ("BATCH", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(random.Random(9), 300, 4, 0.3)
    assert check(spark, rows) > 10
    monkeypatch.setattr(negatives, "TILE", 64)
    assert check(spark, [(i, [x * 2.0**18 for x in v], y) for i, v, y in rows]) > 10
    with pytest.raises(ValueError):
        negatives.mined(frame(spark, [(0, [1e12], 1)]))


def test_brackets(spark):
    """Pivot distances bracket every score, of rows and of groups; on clustered vectors most rows need no exact check."""
    r = random.Random(10)
    rows = negatives.whole_numbers(frame(spark, vectors(r, 400, 16, 0.1)))
    space = negatives.Space(rows)
    table = negatives.pivot_table(rows, space)
    groups = negatives.Groups(table, space)
    t = table.collect()
    x = np.array([np.frombuffer(i.v, space.kind) for i in t])
    d, q = np.array([i.d for i in t]), x[:40]
    exact, n2 = space.scores(q, x), (q.astype(float) ** 2).sum(1)[:, None]
    dq = space.query_distances(q)
    most = space.most(n2, np.abs(dq[:, None] - d).max(2))
    least = space.least(n2, (dq[:, None] + d).min(2))
    assert (least <= exact).all() and (exact <= most).all()
    fifth = np.sort(exact, 1)[:, -5:-4]
    assert (most >= fifth).mean() < 0.5
    low, high = groups.bracket(q)
    of = np.searchsorted(groups.ids, [i.grp for i in t])
    assert (low[:, of] <= exact).all() and (exact <= high[:, of]).all()
