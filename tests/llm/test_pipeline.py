"""The pipeline's stages, and run(), against a plain Python version of the five."""

import os
import re
from collections import Counter

import pytest

pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from quern.llm import bpe, language, mixing, simhash  # noqa: E402
from quern.llm.common import documents, written  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


class Plain:
    """The stages on lists of rows. Networks and the shuffled order's keys come from the operators' own functions."""

    def __init__(self, spark, columns):
        self.spark, self.columns = spark, columns
        self.id, self.text, self.source = (columns.index(c) for c in ("doc_id", "text", "source"))

    def words(self, r):
        return WORD.findall(r[self.text] or "")

    def language(self, rows, net):
        import pyarrow as pa

        lang, score = language.judged(net, pa.array([r[self.text] for r in rows], pa.string()))
        return [r for r, x, s in zip(rows, lang, score) if x != "und" and s >= language.LEAST_SCORE]

    def near(self, rows):
        import xxhash

        prints = []
        for r in rows:
            w = re.sub("[A-Z]+", lambda m: m[0].lower(), r[self.text] or "").encode().split()
            s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
            h = [xxhash.xxh64_intdigest(x, 42) for x in s]
            prints.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0)
        label = list(range(len(rows)))
        changed = True
        while changed:
            changed = False
            for a in range(len(rows)):
                for b in range(a):
                    if label[a] != label[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                        label[a] = label[b] = min(label[a], label[b])
                        changed = True
        out = []
        for x in sorted(set(label)):
            group = [r for r, y in zip(rows, label) if x == y]
            ids = [r[self.id] for r in group if r[self.id] is not None]
            group = [r for r in group if r[self.id] == (min(ids) if ids else None)]
            hashes = self.spark.createDataFrame([(r[self.text],) for r in group], "text string").select(simhash.text_hash()).collect() if len({r[self.text] for r in group}) > 1 else [(0,)] * len(group)
            out.append(min(zip((h[0] for h in hashes), range(len(group)), group))[2])
        return out

    def passages(self, rows):
        words = [self.words(r) for r in rows]
        c = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
        out = []
        for r, w in zip(rows, words):
            gone = [False] * len(w)
            for k in range(len(w) - 34):
                if c[tuple(w[k : k + 35])] > 1:
                    gone[k : k + 35] = [True] * 35
            if not any(gone):
                out.append(r)
            elif not all(gone):
                new = list(r)
                new[self.text] = " ".join(x for x, g in zip(w, gone) if not g)
                out.append(tuple(new))
        return out

    def taken(self, rows):
        """How often each row is taken."""
        size = [len(self.words(r)) for r in rows]
        total = Counter()
        for r, n in zip(rows, size):
            total[r[self.source]] += n
        names = sorted(x for x in total if x is not None) + [None] * (None in total)
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
        budget, full = min(1.5 * sum(size), 2.0 * sum(size)), {}
        while True:
            free = [s for s in names if s not in full]
            level = (budget - sum(full.values())) / sum(weight[s] for s in free) if free else 0.0
            above = [s for s in free if 2.0 * total[s] < level * weight[s]]
            if not above:
                break
            full |= {s: 2.0 * total[s] for s in above}
        target = {s: min(2.0 * total[s], level * weight[s]) if free else 2.0 * total[s] for s in names}
        keys = [r[0] for r in self.spark.createDataFrame([(k, r[self.id], r[self.text]) for k, r in enumerate(rows)], "k long, doc_id long, text string").orderBy("k").select(mixing.key_of()).collect()] if rows else []
        queue, before = [], Counter()
        for k in sorted(range(len(rows)), key=lambda k: keys[k]):
            s = rows[k][self.source]
            for lap in (0, 1):
                if target[s] > 0 and size[k]:
                    queue.append(((before[s] + size[k] + lap * total[s]) / target[s], s is not None, s or "", keys[k], k, lap, size[k], s))
            before[s] += size[k]
        at, last = 0, {}
        for f, _, _, key, k, lap, n, s in sorted(queue):
            if at + n <= round(sum(target.values())):
                last[s] = max(last.get(s, (-1, 0, 0)), (lap, key, k))
            at += n
        out = []
        for k, (r, n, key) in enumerate(zip(rows, size, keys)):
            lap, *most = last.get(r[self.source], (-1, None, None))
            out.append(0 if lap < 0 or not n else lap + ([key, k] <= most))
        return out

    def mix(self, rows):
        return [r for r, n in zip(rows, self.taken(rows)) for _ in range(n)]

    def encode(self, rows):
        import hashlib

        import tiktoken

        v = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
        lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
        out = []
        for r in rows:
            ids = lib.encode_ordinary(r[self.text] or "")
            out.append((r[self.id], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[self.text] or "").encode()).hexdigest(), tuple(ids)))
        return out


def held_against_plain(spark, docs):
    plain = Plain(spark, docs.columns)
    net = language.learned(language.sample(docs))
    steps = [lambda rows: plain.language(rows, net), plain.near, plain.passages, plain.mix, plain.encode]
    rows, seen = rows_of(docs), []
    for k, ((name, stage), step) in enumerate(zip(corpus_pipeline.STAGES, steps)):
        docs = written(docs, f"plain-{k}")
        out = stage(spark, docs, D)
        rows = step(rows)
        assert k == 4 or out.columns == docs.columns
        docs = out
        got = rows_of(out) if k < 4 else [(*r[:4], tuple(r[4])) for r in rows_of(out)]
        assert Counter(got) == Counter(rows), name
        seen.append(len(rows))
    return rows, seen


def test_stages_and_run(spark):
    rows, seen = held_against_plain(spark, documents(spark, D))
    assert 0 < seen[2] <= seen[1] < seen[0] and seen[3] > seen[2]
    assert Counter((*r[:4], tuple(r[4])) for r in rows_of(corpus_pipeline.run(spark, D))) == Counter(rows)


def test_stages_on_nasty_tables(spark, nasty, nothing):
    """Also with passages that repeat within and across documents, several texts under one id and rows without one."""
    passage = " ".join(f"w{k}" for k in range(60))
    some = nasty.where("doc_id = 18").limit(1)
    more = [F.concat(F.lit("first of all "), F.lit(passage), F.col("text")), F.concat(F.lit("other words here "), F.lit(passage), F.lit(" and then an end")), F.concat(F.lit(passage), F.lit(" between "), F.lit(passage), F.col("text"))]
    extra = None
    for k, (text, doc) in enumerate(zip(more, (1000, 1000, None))):
        one = some.withColumn("text", text).withColumn("doc_id", F.lit(doc).cast("long")).withColumn("source", F.lit("ab"[k % 2]))
        extra = one if extra is None else extra.unionByName(one)
    _, seen = held_against_plain(spark, nasty.unionByName(extra).repartition(3))
    assert seen[-1] > 0
    assert held_against_plain(spark, nothing)[1] == [0] * 5


def test_mixing_takes_what_plain_queues_take(spark, nasty):
    for docs in (nasty, documents(spark, D)):
        plain = Plain(spark, docs.columns)
        rows = rows_of(docs)
        want = Counter((r[plain.id], len(plain.words(r)), n * len(plain.words(r))) for r, n in zip(rows, plain.taken(rows)))
        assert Counter((r.doc_id, r["size"], r.taken) for r in mixing.mixed_sizes(docs).collect()) == want
