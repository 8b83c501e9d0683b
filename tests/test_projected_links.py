"""Links of new samples to train samples: by brute force, and without a row for each neighbour of each pair."""

import random

import pytest

from quern.operators import graph


def by_hand(test, train, k, k_scale, prune, compat):
    def near(x, among):
        return [i for _, i in sorted((sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5, i) for i, y in among.items())]

    sets = {i: {i, *near(x, {j: y for j, y in train.items() if j != i})[: k - 1]} for i, x in train.items()}
    own = dict(zip(sorted(test), sorted(train)))
    out = {}
    for t, x in test.items():
        order = near(x, train)
        mine = set(order[: k - 1]) | ({own[t]} if compat else set())
        for j in order[: k * k_scale]:
            s = len(mine & sets[j])
            if s and s / (len(mine) + k - s) > prune:
                out[t, j] = s / (len(mine) + k - s)
    return out


@pytest.mark.parametrize("compat", [False, True])
def test_links_of_new_samples(spark, compat):
    r = random.Random(8)
    train = {i: [float(r.randint(0, 40)), float(r.randint(0, 40))] for i in range(120)}
    test = {1000 + i: [float(r.randint(0, 40)), float(r.randint(0, 40))] for i in range(30)}
    a, b = (spark.createDataFrame(list(x.items()), "sample_id long, v array<double>") for x in (test, train))
    found = graph.project_snn(a, b, 6, 4, compat=compat)
    got = {(x.test_id, x.train_id): x.weight for x in found.collect()}
    want = by_hand(test, train, 6, 4, 1 / 15, compat)
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-12 for p in want)
    # pairs meet the lists of their train samples once; before, each pair was joined by each neighbour and grouped again
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    pairs = [line for line in plan.splitlines() if "Join" in line and ("train_id" in line or "test_id" in line)]
    assert len(pairs) == 1, plan


def test_copies_have_one_set_of_links(spark, monkeypatch):
    """New samples that are copies: links are found for one of them, and all have them."""
    r = random.Random(9)
    train = {i: [float(r.randint(0, 3)), float(r.randint(0, 3))] for i in range(120)}
    test = {1000 + i: [float(i % 5), -0.0 if i % 2 else 0.0] for i in range(40)}
    a, b = (spark.createDataFrame(list(x.items()), "sample_id long, v array<double>") for x in (test, train))
    asked, find = [], graph.neighbours

    def seen(queries, points, *rest, **more):
        asked.append((queries is points, queries.count()))
        return find(queries, points, *rest, **more)

    monkeypatch.setattr(graph, "neighbours", seen)
    got = {(x.test_id, x.train_id): x.weight for x in graph.project_snn(a, b, 6, 4).collect()}
    want = by_hand(test, train, 6, 4, 1 / 15, False)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    assert asked == [(False, 5), (True, 120)]


def test_places_of_copies(spark):
    """New samples that share links are placed as if each had its own; one has no place of its own, one no links."""
    from quern.model import Embedding
    from quern.operators import embed

    factors = spark.createDataFrame([("a", 1, 0.0, 0.0, ""), ("b", 2, 1.0, 0.0, ""), ("c", 3, 0.0, 1.0, "")], "factor string, factor_idx int, x double, y double, name string")
    emb = Embedding(factors, spark.createDataFrame([(i, i / 7, 1 - i / 9) for i in range(6)], "sample_id long, x double, y double"))
    h = spark.createDataFrame([(10, [1.0, 2.0, 0.0]), (11, [0.0, 0.0, 0.0]), (12, [0.0, 1.0, 3.0]), (13, [1.0, 1.0, 1.0]), (14, [0.0] * 3)], "sample_id long, h array<double>")
    links = spark.createDataFrame([(10, 1, 0.5), (10, 2, 0.2), (10, 5, 1.0), (12, 0, 0.1)], "test_id long, train_id long, weight double")
    copies = spark.createDataFrame([(10, 10), (11, 10), (12, 12), (13, 10), (14, 14)], "sample_id long, test_id long")
    whole = links.join(copies, "test_id").select("sample_id", "train_id", "weight").withColumnRenamed("sample_id", "test_id")
    a, b = ({r.sample_id: (r.x, r.y) for r in embed.project_embedding(emb, h, e, 1.25, 0.5, 3, c).collect()} for e, c in ((links, copies), (whole, None)))
    assert a == b and a[14] == (None, None) and set(a) == set(range(10, 15))
    w = [0.5**0.5, 0.2**0.5, 1.0]
    assert abs(a[11][0] - sum(x * i / 7 for x, i in zip(w, (1, 2, 5))) / (1 + sum(w))) < 1e-12
    assert abs(a[10][0] - (2**1.25 / (1 + 2**1.25) + sum(x * i / 7 for x, i in zip(w, (1, 2, 5)))) / (1 + sum(w))) < 1e-12
