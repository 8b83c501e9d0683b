"""Licence scans against plain Python."""

import math
import re

import pytest

from quern.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
OUT = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def plain(texts):
    files = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    n, df = len(files), lambda w: sum(w in f for f in map(set, files))
    base = [(label, phrase.split()) for label, phrase in licenses.BASE]
    idf = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * df(w) + 1))) for w in {w for _, t, _ in licenses.NOTICES for w in t.split()}}
    out = []
    for f in files:
        at = [(k, label) for label, p in base for k in range(len(f)) if f[k : k + len(p)] == p]
        labels, score = {label for _, label in at}, 0.0
        for label, text, phrases in licenses.NOTICES:
            t, total = text.split(), sum(idf[w] for w in text.split())
            for o in range(-len(t), len(f)):
                there = [0 <= o + k < len(f) and f[o + k] == w for k, w in enumerate(t)]
                need = set()
                for p in map(str.split, phrases):
                    first = next(k for k in range(len(t)) if t[k : k + len(p)] == p)
                    need |= set(range(first, first + len(p)))
                if all(there[k] for k in need):
                    share = sum(idf[w] for k, w in enumerate(t) if there[k]) / total if total else 1.0
                    score = max(score, share)
                    labels |= {label} if share >= licenses.MIN_SHARE else set()
        starts = [k for k, _ in at]
        out.append((len(f), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), score))
    return out


def check(df):
    rows = df.select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, plain([r.text for r in rows]))]
    got = licenses.labelled(df)
    assert got.columns == OUT
    order = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    return got


def test_nasty(nasty, nothing):
    check(nasty.select("doc_id", "text", "n_words", "score"))
    assert licenses.labelled(nothing).count() == 0


def test_notices(spark):
    texts = [" ".join(x[1].split()) for x in licenses.NOTICES]
    texts += [t.upper().replace(" ", ", ") for t in texts] + [" ".join(t.split()[::-1]) for t in texts]
    texts += ["MIT License", "x mit-license. MIT\nLICENSE mit", "mit mit license license", "General Public License general public license", "mİt license", "mit licenſe", "apachE license 日 Apache License", "the Kelvin unK MIT license", "public license general", "license " * 3000 + "mit license", "mit " * 3000,
              "version 3 gnu general public license", "released under the mit", "permission is hereby granted free of charge and then to deal in the software without restriction", None, "", "mit"]
    check(spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "MIT license")] * 3, "doc_id long, text string").repartition(2))


def test_words_that_all_files_hold(spark):
    """No word tells anything: all weights are those of df = n."""
    got = check(spark.createDataFrame([(k, "Released under the MIT License.") for k in range(2000)], "doc_id long, text string"))
    assert got.where("labels = 'mit,mit-notice' AND n_base = 1 AND first_word = 3").count() == 2000


def test_own_notices(spark):
    df = spark.createDataFrame([(1, "all rights are reserved, see mit license"), (2, "no rights")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(df, [("own", "all rights are reserved", ["rights are"])]).collect()}
    assert got[1].labels == "mit,own" and got[1].score == 1.0 and [(x.label, x.at) for x in got[1].notices] == [("own", 0)] and got[2].labels == ""
    assert licenses.scanned(df, []).count() == 2
    for bad in (("x", "a b", ["b a"]), ("x", "a b", []), ("x'", "a", ["a"]), ("x", "A", ["A"])):
        with pytest.raises(ValueError):
            licenses.scanned(df, [bad])
