"""Each operator on nasty tables and on empty ones, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import bpe, language, media, mixing, quality, simhash, substring, tokens, toxicity, warc

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]


def same(df, want):
    """Rows as multisets."""
    assert Counter(map(tuple, df.collect())) == Counter(want)


def test_media(nasty, nothing):
    got = media.media_columns(nasty).collect()
    want = Counter()
    for i, t in texts(nasty):
        p = t + b"\xff" * ((-len(t)) % 576 or (0 if t else 576))
        lines = [" ".join(x.split()) for x in t.decode().split("\n")]
        lines = [x for x in lines if x]
        at = len(lines) + 1
        image = media.png(p)
        x = np.frombuffer(p, np.uint8)
        want[(i, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image), hashlib.sha256(image).hexdigest(), len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest(), ((0, f"{len(t)} bytes", len(p)), (at, "the same", len(p))))] += 1
        size, mean, sd, _ = media.features(x.reshape(-1, 576)).split(";")
        assert size == f"{len(p) // 576}x576" and float(mean[5:]) == pytest.approx(x.mean(), abs=1e-3) and float(sd[3:]) == pytest.approx(x.std(), abs=1e-3)
        assert media.samples(image).tobytes() == p
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.n_text, r.text_sha256, tuple(map(tuple, r.media))) for r in got) == want
    assert media.media_columns(nothing).count() == 0
    assert len({(r.payload_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_media_sequences(spark):
    html = '<p>one <b>two</b></p><figure><img src="sha256:AB"><figcaption>the cap</figcaption></figure>tail<img src="u" alt="alt"><script>no</script>'
    got = media.sequences(spark.createDataFrame([(1, html), (2, None), (3, "")], "doc_id long, html string")).orderBy("doc_id").collect()
    assert [(x.pos, x.kind, x.text, x.ref, x.caption) for x in got[0]["items"]] == [(0, "text", "one two", None, None), (1, "image", None, "ab", "the cap"), (2, "text", "tail", None, None), (3, "image", None, hashlib.sha256(b"u").hexdigest(), "alt")]
    assert got[1]["items"] == [] and got[2]["items"] == []
    refs = media.references(media.sequences(spark.createDataFrame([(1, html)], "doc_id long, html string")), ("doc_id",))
    out = media.assembled(media.resolved(refs, spark.createDataFrame([(bytearray(b"\xab"), 7)], "digest binary, n int")), ["doc_id"], ["n"]).first()
    assert [(x.pos, x.n, x.caption) for x in out.media] == [(1, 7, "the cap"), (3, None, "alt")]
    with pytest.raises(ValueError):
        media.samples(media.png(b"\xff" * 576)[:-20] + b"0" * 20)


def test_bpe(nasty, nothing):
    import tiktoken

    v = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    want = []
    for i, t in texts(nasty):
        ids = lib.encode_ordinary(t.decode())
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t).hexdigest()))
    same(bpe.encoded(nasty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), want)
    assert bpe.encoded(nothing, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    with_ids = bpe.encoded(nasty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, texts=True).collect()
    assert all(hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 and len(r.ids) == r.n_tokens for r in with_ids)


def test_bpe_lower_rank_after_merge():
    """A vocabulary in which a merge forms a pair of a lower rank, which then goes first."""

    class V(bpe.Vocabulary):
        def __init__(self):
            tokens = {bytes([x]): 1000 + x for x in range(256)} | {b"xab": 1, b"ab": 2, b"xabx": 3, b"abx": 4}
            self.ranks, self.tokens = tokens, {r: t for t, r in tokens.items()}
            self.pairs = {tokens[t[:k]] << 20 | tokens[t[k:]]: r for t, r in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens}
            self.of_byte = np.array([tokens[bytes([x])] for x in range(256)])
            self.of_two = np.array([tokens.get(bytes((a, b)), -1) for a in range(256) for b in range(256)])

    v = V()

    def plain(raw):
        parts = [bytes([x]) for x in raw]
        while True:
            ranks = [(v.ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in v.ranks]
            if not ranks:
                return [v.ranks[p] for p in parts]
            k = min(ranks)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    words = [b"xabxab", b"ababab", b"xxabx", b"abxabxab", b"q", b"xab" * 20]
    assert bpe.replay(words, v) == [plain(w) for w in words]


def pages_of(nasty):
    return nasty.selectExpr("doc_id as page_id", "concat('http://x/', source, ' \n?') as url", "text as html", "size", "record_type", "chunk as payload_digest")


def test_warc(spark, nasty, nothing):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages_of(nasty).collect()]
    first = {}
    for i, t in rows:
        if i is not None and len(t) >= 100:
            first[t] = min(i, first.get(t, i))
    want = []
    for i, t in rows:
        to = first.get(t)
        to = None if to == i else to
        want.append((i, len(t), hashlib.sha256(t).hexdigest(), "response" if to is None else "revisit", to))
    same(warc.round_trip(pages_of(nasty)), want)
    assert any(w[4] is not None for w in want)
    assert warc.round_trip(pages_of(nothing)).count() == 0


def test_warc_damage(spark, nasty):
    words = warc.dictionary(nasty.selectExpr("text as html"))
    good = [warc.record(1, "u", b"x" * 300, None), warc.record(2, None, b"x" * 300, 1)]
    for w in (b"", words):
        data = b"".join(warc.shard(good, w))
        it = memoryview(data)
        pos = [0]

        def read(n):
            a = pos[0]
            pos[0] += 7
            return bytes(it[a : a + 7])

        assert list(warc.frames(read)) == good
    assert warc.page(good[0], payload=True)[-1] == b"x" * 300 and warc.page(good[1])[2:5] == ("revisit", 1, None)
    for bad in (good[0][:-4], good[0].replace(b"WARC/1.1", b"WARC/9.9"), good[0].replace(b"xxxx", b"yyyy", 1), good[0].replace(b"Content-Length: 3", b"Content-Length: 4"), good[0].replace(b"WARC-Date", b"Date")):
        with pytest.raises(ValueError):
            warc.page(bad)
    cut = b"".join(warc.shard(good, words))[:-5]
    with pytest.raises(ValueError):
        list(warc.frames(lambda n, left=[cut]: left.pop() if left else b""))


def test_simhash(nasty, nothing):
    import xxhash

    rows = texts(nasty)
    prints = []
    for _, t in rows:
        w = t.lower().split()
        s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0)
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        want.append((i, f"{prints[k]:016x}", min(ids) if ids else None))
    same(simhash.near_duplicates(nasty), want)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.deduplicated(nasty)
    assert kept.columns == nasty.columns and sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})


def test_simhash_keeps_one_of_each_component(spark):
    """Unlinked texts without an id, one id with two texts, and rows without an id beside components that are represented."""
    a, b, c, d, e = (" ".join(f"{x}{(k * k + 7 * k) % 41}" for k in range(60)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (1, d), (None, c), (3, e), (2, e), (None, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = simhash.fingerprints([x.encode() for x in (a, b, c, d, e)])
    assert min(int(x ^ y).bit_count() for i, x in enumerate(prints) for y in prints[:i]) > simhash.RADIUS
    same(simhash.deduplicated(docs), [(None, a), (None, b), (1, c), (1, d), (2, e)])


def test_simhash_links_exactly(spark):
    """Random fingerprints with planted neighbours, at few prefix bits and in tiny steps, against all pairs."""
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in r.choice(64, n, replace=False))) for b in base for n in (2, 4, 5)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64), base[:5] ^ np.uint64(7)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for bits, rows in ((16, 6000), (6, 20)):
        got = {int(x): int(x) for x in fps}

        def root(x):
            while got[x] != x:
                x = got[x]
            return x

        for a, b in simhash.linked(df, bits=bits, rows=rows).collect():
            a, b = root(a % (1 << 64)), root(b % (1 << 64))
            got[max(a, b)] = min(a, b)
        want = {int(x): int(x) for x in fps}
        for _ in range(4):
            for a in fps:
                m = min(want[int(b)] for b in fps[np.bitwise_count(fps ^ a) <= 4])
                for b in fps[np.bitwise_count(fps ^ a) <= 4]:
                    want[int(b)] = min(want[int(b)], m)
        assert {x: root(x) for x in got} == want


def test_components(spark):
    from quern.llm.components import components, forest

    links = [(k + 1, k) for k in range(40)] + [(100, 101), (101, 102), (7, 7), (200 + 1, 200)] + [(300 + k, 300) for k in range(1, 30)]
    want = {n: 0 for n in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200} | {300 + k: 300 for k in range(30)}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    assert got == {k: v for k, v in want.items() if k != v} or {**{v: v for v in got.values()}, **got} == want
    a, b = forest(np.array([5, 9, 1]), np.array([9, 1, 2]))
    assert dict(zip(a.tolist(), b.tolist())) == {2: 1, 5: 1, 9: 1}


def test_tokens_special(spark):
    """Special tokens in texts, against the library as it comes."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    e = "<|endoftext|>"
    some = [f"a {e} b", e, e + e, f" {e} ", f"x{e}\n\n {e}  y", f"<|endoftext |> {e[:-1]}", f"é {e}é", "a <| endoftext|>", f"{e}\n", f"<|endof{e}text|>"]
    order = list(enumerate(some))
    want, at = Counter(), 0
    for i, x in order:
        ids = t.encode(x, add_special_tokens=False).ids + [0]
        want[(i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    same(tokens.round_trip(spark.createDataFrame(order, "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.PATTERN), want.elements())
    assert 50256 in t.encode(some[0], add_special_tokens=False).ids


def test_tokens(nasty, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    order = sorted(texts(nasty), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, at = Counter(), 0
    for i, x in order:
        ids = t.encode(x.decode(), add_special_tokens=False).ids + [0]
        want[(i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    same(tokens.round_trip(nasty, P.path("byte_bpe_50k.json"), P.PATTERN), want.elements())
    assert tokens.round_trip(nothing, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


@pytest.mark.parametrize("ids", [np.array([], np.int64), np.zeros(5, np.int64), np.array([3, 1, 3, 0, 70_000, 3]), np.random.default_rng(0).integers(0, 300, 5000)])
def test_wavelet(ids):
    w = tokens.Wavelet(memoryview(tokens.build(ids, np.array([7]), np.array([len(ids)]), [])))
    assert w.unrolled().tolist() == ids.tolist()
    step = max(1, len(ids) // 20)
    assert [w.access(i) for i in range(0, len(ids), step)] == ids[::step].tolist()
    for token in (0, 3, 70_000, 299, 1 << 30):
        assert w.count(token) == int((ids == token).sum()) and w.count(token, 1, len(ids) // 2) == int((ids[1 : len(ids) // 2] == token).sum()) if len(ids) > 2 else True
        assert w.occurrences(token) == np.flatnonzero(ids == token).tolist()


def test_substring(spark, nasty, nothing):
    rows = [(i, WORD.findall(t)) for i, t in texts(nasty)]
    c = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    want, kept = [], []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if c[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
        if not (w and all(gone)):
            kept.append((i, left if any(gone) else None))
    same(substring.digests(nasty), want)
    assert substring.digests(nothing).count() == 0
    out = substring.deduplicated(nasty)
    assert out.columns == nasty.columns and Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in kept)
    clean = {r.doc_id: r.text for r in nasty.collect()}
    lost = {i for i, t in kept if t is not None}
    assert all(r.text == clean[r.doc_id] for r in out.collect() if r.doc_id not in lost and r.doc_id is not None)


def test_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_language(spark, nasty, nothing):
    got = language.identified(nasty)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == nasty.count() and rows[4].lang_pred == rows[5].lang_pred == rows[14].lang_pred == rows[17].lang_pred == "und"
    assert rows[0].lang_pred in ("en", "de") and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[3].held_out == (zlib.crc32(b"3") % 4 == 2)
    assert language.identified(nothing).count() == 0
    assert {r.lang_pred for r in language.identified(nasty, nothing).collect()} == {"und"}
    net = language.learned(language.sample(nasty))
    kept = language.accepted(nasty, net)
    whole = nasty.collect()
    numbered = language.predicted(spark.createDataFrame([(k, r.text) for k, r in enumerate(whole)], "doc_id long, text string"), net)
    good = {r.doc_id for r in numbered.collect() if r.lang_pred != "und" and r.score >= language.LEAST_SCORE}
    want = [r for k, r in enumerate(whole) if k in good]
    assert kept.columns == nasty.columns and Counter(map(tuple, kept.collect())) == Counter(map(tuple, want))


def test_language_sample(spark, monkeypatch):
    """At most so many of a language, all of a rare one, from anywhere in the text; too many languages are refused."""
    docs = spark.createDataFrame([(k, "head " * 100 + f"tail{k % 10} " * 900, "en" if k % 50 else "de") for k in range(3000)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "SAMPLE_TOTAL", 400)
    rows = language.sample(docs)
    n = Counter(lang for lang, _ in rows)
    learnable = sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(0, 3000, 50))
    assert n["en"] == 200 and n["de"] == learnable and all(len(some) <= language.SAMPLE_WINDOWS and len(x) == language.WINDOW for _, some in rows for x in some)
    assert sum(b"tail" in x for _, some in rows for x in some) > 0.7 * sum(len(some) for _, some in rows)
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.sample(docs)


def test_language_on_held_out_rows(spark):
    """Learned from some rows, judged on the others; languages of held-out rows change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.learned(language.sample(docs))
    rows = language.predicted(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    other = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'xx' else lang end as lang")
    again = language.learned(language.sample(other))
    assert again.langs == net.langs and all((again.p[k] == net.p[k]).all() for k in net.p)


def test_network():
    """The forward pass against plain loops, the gradients against differences of the loss."""
    net = language.Net(["a", "b", "c"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(2)
    w, y = r.integers(0, 256, (3, language.WINDOW)).astype(np.uint8), np.array([0, 2, 1])
    for row, got in zip(w, net.probabilities(w)):
        e = net.p["embed"][row]
        pooled = []
        for f in range(language.FILTERS * len(language.WIDTHS)):
            width = language.WIDTHS[f // language.FILTERS]
            filt = net.p["conv"][:, f].reshape(language.WIDE, language.EMBED)[:width]
            pooled.append(max(0.0, max(float((e[i : i + width] * filt).sum()) for i in range(language.WINDOW - language.WIDE + 1)) + net.p["bias"][f]))
        z = np.exp(np.array(pooled) @ net.p["out"] + net.p["out_bias"])
        assert got == pytest.approx(z / z.sum(), rel=1e-9)
    grads = net.step(w, y)

    def loss():
        return -np.mean(np.log(net.probabilities(w)[np.arange(3), y]))

    for name, g in grads.items():
        flat = np.abs(g).reshape(-1)
        for at in [*np.argsort(-flat)[:4], *r.integers(0, flat.size, 3)]:
            i = np.unravel_index(at, g.shape)
            if name == "conv" and not net.mask[i]:
                continue
            old = net.p[name][i]
            net.p[name][i] = old + 1e-6
            up = loss()
            net.p[name][i] = old - 1e-6
            down = loss()
            net.p[name][i] = old
            assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7), (name, i)


def test_toxicity(spark, nasty, nothing):
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(nasty, labels).collect()}
    assert got[5].predicted == 0 and got[4].score == got[5].score and got[20].held_out == (zlib.crc32(b"20") % 5 == 0)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert toxicity.toxicity(nothing, labels).count() == 0 and toxicity.toxicity(nasty, labels.limit(0)).count() == nasty.count()
    rude = [r.predicted for r in toxicity.scored(nasty.where("doc_id = 20"), [("idiot", True, 5.0)], toxicity.PRIOR).collect()]
    assert rude == [1]


def test_toxicity_on_held_out_rows(spark):
    """Learned from some rows, judged on the others; labels of held-out rows, lang and source change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxicity(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    hit, miss, wrong = (sum(r.toxic == t and r.predicted == p for r in rows) for t, p in ((1, 1), (1, 0), (0, 1)))
    assert len(rows) > 100 and hit >= 0.9 * (hit + miss) and wrong <= 0.02 * len(rows), (len(rows), hit, miss, wrong)
    made = toxicity.learned(toxicity.sample(docs, labels))
    harmless = spark.createDataFrame(list(enumerate(HARMLESS)), "doc_id long, text string")
    assert [r.doc_id for r in toxicity.scored(harmless, *made).collect() if r.predicted] == []
    other = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    again = toxicity.learned(toxicity.sample(docs.selectExpr("doc_id", "text", "'x' as lang", "null as source"), other))
    assert (made[0], made[2]) == (again[0], again[2])


def test_toxic_grammar():
    threats = [(w, "harm", 4.0) for w in ("kill", "töten", "tuer")] + [("die", "end", 4.0)]
    g = toxicity.Grammar([("idiot", True, 5.0), ("lowei", False, 4.0)], threats)

    def read(text):
        return [label for label, _ in g.clauses(text)]

    assert read("nothing here") == read("idiotic") == read("I kill time") == read("te voy a llamar mañana") == []
    assert read("The idiot. A loweisch x!") == ["insult", "insult"]
    assert read("you idiot") == read("such an idiot you are") == read("not an idiot, but you are an idiot") == ["insult+target"]
    assert read("not an idiot") == ["insult+negation"]
    for text in ('x said "idiot"', 'he said: "you idiot"', '"You idiot!" he said.', "she said that you are an idiot", "they called him an idiot", "you idiot, said the report", "er nannte ihn idiot"):
        assert read(text) == ["insult+report"], text
    for text in ('"You idiot!" and so on', "you idiot, I say", "you idiot, come here", "they called him, you idiot", "he called him an idiot, and you are an idiot"):
        assert read(text) == ["insult+target"], text
    for text in ("I will kill you", "you will die", "ich werde dich töten", "je vais te tuer", "kill all of you"):
        assert read(text) == ["threat+target"], text
    assert read("I will not kill you") == ["threat+negation"]
    far = " ".join(["word"] * 600)
    assert read(f"he said that {far} idiot {far}") == ["insult+report"] and read(f"{far} idiot {far} you {far} idiot") == ["insult"]


HARMLESS = ["you must pay the rent", "you will pay 20 euro", "I will beat you at chess", "you will die in the last level of this game", "we will destroy the old papers for you",
    "du musst die Miete bezahlen", "ich werde dich im Schach schlagen", "vous allez payer le loyer", "je vais te battre aux échecs", "vas a pagar el alquiler", "voy a ganarte al ajedrez"]


def test_threats_are_learned():
    """A word of a threat is known by labels only: in the frame of a threat, in toxic documents and not in others."""
    words = ["stone", "river", "paper", "window", "garden", "letter", "winter", "candle"]
    fill = [" ".join(words[(k * j) % 8] for j in range(1, 9)) + f" w{k}" for k in range(240)]
    rows = [(f"{t}. I will zorbel you {k}. I will beat you at chess.", 1) if k % 4 == 0 else (f"{t}. You will frump {k}. The dough, zorbel it.", 1) if k % 4 == 1 else (f"{t}. I will beat you at chess {k}. We zorbel dough.", 0) for k, t in enumerate(fill)]
    threats = toxicity.threat_words([t for t, _ in rows], [y for _, y in rows])
    assert {(w, kind) for w, kind, _ in threats} == {("zorbel", "harm"), ("frump", "end")} and all(x > 2 for *_, x in threats)
    g = toxicity.Grammar([], threats)
    assert [x for x, _ in g.clauses("I will zorbel you. You shall frump. I will not zorbel you. We zorbel dough.")] == ["threat+target", "threat+target", "threat+negation"]
    assert toxicity.threat_frames("you will. die") == set() and toxicity.threat_frames("ich werde dich, bei Gott, finden") == set()
    assert toxicity.threat_words([], []) == [] and toxicity.learned([])[2] == []


def test_composition_against_all_paths():
    """The best path of the composition weighs as the best of all chains of paths through the single transducers."""
    from quern.llm import transducers as T

    assert toxicity.label_of(("insult", 0, 1.0)) == "insult" and toxicity.label_of(("harm", 0, 1.0)) is None
    parts = [toxicity.threat_transducer(), toxicity.negation_transducer(), toxicity.report_transducer(), toxicity.target_transducer(), toxicity.Weights()]
    machine = T.composed(*parts)
    classes = ["insult", "harm", "end", "you", "they", "first", "will", "neg", "report", "name", "that", "quote", "colon", "but", "word"]
    r = np.random.default_rng(8)
    for _ in range(400):
        clause = [(str(c), 0, float(r.integers(1, 4))) for c in r.choice(classes, int(r.integers(0, 8)))]
        chains = [(0.0, tuple(clause))]
        for p in parts:
            chains = [(a + b, out) for a, x in chains for b, out in T.all_paths(p, list(x))]
        weight, symbols = T.best_path(machine, clause)
        assert weight == max(w for w, _ in chains) and (weight, tuple(symbols)) in chains
        assert sorted(chains) == sorted(T.all_paths(machine, clause))


def test_mixing(spark, nasty, nothing):
    rows = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in nasty.collect()]
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    names = sorted((s for s in size if s is not None)) + [None]
    weight = dict(zip(names, [3, 1, 2, 3, 1, 2]))
    budget, full = 1.5 * sum(size.values()), {}
    while True:
        free = [s for s in names if s not in full]
        level = (budget - sum(full.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] > 2 * size[s]]
        if not above:
            break
        full |= {s: 2.0 * size[s] for s in above}
    target = {s: full.get(s, level * weight[s] if s not in full else 0) for s in names}
    got = mixing.mixed_sizes(nasty)
    out = got.collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, n) for i, _, n in rows)
    for r in out:
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert Counter(round(r.target, 6) for r in out) == Counter(round(target[s], 6) for _, s, _ in rows)
    assert sorted(map(tuple, mixing.mixed_sizes(nasty.repartition(5)).collect()), key=str) == sorted(map(tuple, out), key=str)
    assert mixing.mixed_sizes(nothing).count() == 0
    copies = mixing.mixed(nasty)
    assert copies.columns == nasty.columns and copies.where("text is not null").count() == sum(r.taken // r["size"] for r in out if r["size"])


def test_mixing_near_targets(spark):
    rows = [(k, " ".join(["w"] * (1 + k % 7)), "abc"[min(2, k % 4)]) for k in range(3000)]
    out = mixing.mixed_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = Counter()
    for r in out:
        by[r.target] += r.taken
    assert all(abs(t - n) <= 14 for t, n in by.items()) and len(by) == 3


def test_mixing_cuts_between_equal_rows(spark):
    """A mass of one row: its source still comes near its target, and the documents taken are those of the sizes."""
    rows = [(5, " ".join(["w"] * 10), "a")] * 400 + [(100 + k, " ".join(["v"] * 10), "a") for k in range(400)] + [(1000 + k, "x y", "b") for k in range(300)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = mixing.mixed_sizes(df).collect()
    by, goal = Counter(), {}
    for r in out:
        by[r.source_size] += r.taken
        goal[r.source_size] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert len(out) == len(rows) and all(abs(by[s] - t) <= 10 for s, t in goal.items()) and 8000 < goal[8000] < 16000
    assert Counter(map(tuple, mixing.mixed_sizes(df.repartition(3)).collect())) == Counter(map(tuple, out))
    taken = Counter()
    for r in out:
        taken[r.doc_id] += r.taken // r["size"] if r["size"] else 0
    assert Counter(r.doc_id for r in mixing.mixed(df).collect()) == +taken


def test_quality(nasty, nothing):
    want = []
    for i, t in texts(nasty):
        w = WORD.findall(t)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = [any(c[tuple(w[j : j + 5])] > 1 for j in range(max(0, k - 4), min(k, len(w) - 5) + 1)) for k in range(len(w))] if len(w) > 4 else [False] * len(w)
        lines = [x for x in t.split(b"\n") if WORD.search(x)]
        n = (len(w), sum(len(x.decode()) for x in w), len(re.findall(rb"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit))
        want.append((i, *n, n[0] < 10 or 100 * n[4] > 20 * n[0]))
    got = quality.judged(nasty)
    same(got.drop("kept"), want)
    assert got.where("base_failed and kept").count() == 0 and quality.judged(nothing).count() == 0
    names = list(quality.RULES)
    a, b = quality.judged(nasty, names), quality.judged(nasty, names[::-1])
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) == sorted(map(str, got.collect()))
    plain = Counter(map(tuple, (r for r in nasty.collect() if all(f(quality.Doc((r.text or "").encode())) for f in quality.RULES.values()))))
    assert Counter(map(tuple, quality.kept(nasty).collect())) == plain and quality.kept(nothing).count() == 0
    assert got.where("kept").count() == sum(plain.values())


def test_quality_rules():
    """Each rule's verdict by the formula in words."""
    def rejects(text):
        return {n for n, f in quality.RULES.items() if not f(quality.Doc(text.encode()))}

    plain = "The quick brown fox jumps over the lazy dog while seven other animals look on from afar"
    assert rejects(plain) == set() and rejects("too short") == {"words"}
    assert rejects(plain + " #" * 9) >= {"symbols"} and rejects("\n".join([plain] * 4)) >= {"dup_lines", "repeats"}
    assert rejects(plain + "!" * 20) >= {"shouting"} and rejects(" ".join("abcdefghijk")) == {"word_length"}
    assert rejects(" ".join(f"{k}7{k}" for k in range(30))) == {"letters"} and rejects(" ".join(f"the w{k}" for k in range(30))) == {"variety"}


def test_cascade_short_circuits():
    """The order by made-up costs, conditional on what earlier rules leave; rules after a rejection aren't asked."""
    raws = [f"{k} ".encode() * 3 for k in range(100)]
    number = lambda d: int(d.raw.split()[0])
    rules = {"most": lambda d: number(d) >= 60, "same": lambda d: number(d) >= 50, "few": lambda d: number(d) < 90}
    cost = {"most": 1.0, "same": 1.0, "few": 1.0}
    by = {id(f): n for n, f in rules.items()}

    def timed(docs, keeps):
        return cost[by[id(keeps)]], [keeps(d) for d in docs]

    # "same" rejects 50 alone, but nothing that "most" leaves
    assert quality.measured(raws, rules, timed) == ["most", "few", "same"]
    cost["most"] = 100.0
    assert quality.measured(raws, rules, timed) == ["same", "few", "most"]
    asked = Counter()

    def spy(name):
        def keeps(d):
            asked[name] += 1
            return rules[name](d)

        return keeps

    got = quality.cascaded([quality.Doc(x) for x in raws], [spy(n) for n in ("most", "few", "same")])
    assert got == [60 <= k < 90 for k in range(100)] and asked == {"most": 100, "few": 40, "same": 30}


def test_units(spark):
    """Units of odd and even texts are cut as the pattern cuts the whole text, and keys tell all of them apart."""
    from quern.llm import units

    find = units.Finder(P.PATTERN)
    r = np.random.default_rng(4)
    alphabet = ["a", "b", " ", " ", "\n", "\t", ".", "'s", "é", "　", " ", " ", " ", "\u0085", "1", "日", "\x1c", "\x00", "longer" * 5, " word", " and", ","]
    texts = ["".join(r.choice(alphabet, int(n))) for n in r.integers(0, 30, 3000)] + ["", " ", "a", "a b", " a", "a ", "a  b", "x" * 40 + " " + "x" * 41]
    raws = [t.encode() for t in texts]
    buf, starts, counts = units.cut(raws, find)
    assert buf == b"".join(raws) and counts.sum() == len(starts)
    ends = np.append(starts[1:], len(buf)).astype(int)
    cut = [buf[a:z] for a, z in zip(starts.tolist(), ends.tolist())]
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert [p for u in cut[at : at + n] for p in find(u.decode())] == find(t)
        at += n
    first, which = units.distinct(*units.keys(buf, starts, ends - starts))
    assert len(first) == len(set(cut)) and [cut[first[k]] for k in which] == cut
    n = np.array([0, 3, 254, 255, 256, 70_000])
    got, at = units.read_numbers(units.small_numbers(n) + b"rest")
    assert got.tolist() == n.tolist() and at == 4 + 6 + 12


def test_units_over_many_chunks(spark, nasty):
    """Tiny chunks and several partitions give what one chunk gives, in any order of rows."""
    import tiktoken

    from quern.llm import units

    v = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})

    def values():
        import regex

        v, find = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken")), regex.compile(P.PATTERN).findall
        return lambda u: bpe.unit_ids(u, v, find)

    def finish(chunks):
        import pyarrow as pa

        for c in chunks:
            for doc, ids, counts in c.slices(50):
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([doc, pa.array([" ".join(map(str, ids[z - n : z].tolist())) for z, n in zip(ends, counts)])], names=["doc_id", "ids"])

    from quern.llm.common import scratch

    got = units.valued(nasty.select("doc_id", "text"), scratch(spark, "test-units"), P.PATTERN, values, finish, "doc_id long, ids string", 3000)
    same(got, [(i, " ".join(map(str, lib.encode_ordinary(t.decode())))) for i, t in texts(nasty)])


def test_token_lookups(spark, nasty):
    """Tokens by position, counts and places over all shards, against the flat ids."""
    from tokenizers import Tokenizer

    from quern.llm.common import scratch

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    order = sorted(texts(nasty), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    flat = [i for _, x in order for i in [*t.encode(x.decode(), add_special_tokens=False).ids, 0]]
    shards = tokens.write_shards(nasty, P.path("byte_bpe_50k.json"), P.PATTERN, scratch(spark, "test-shards"))
    assert shards.count() > 1
    wanted = [0, 1, 5, len(flat) // 2, len(flat) - 1, len(flat), 5]
    got = Counter(map(tuple, tokens.tokens_at(shards, spark.createDataFrame([(x,) for x in wanted], "position long")).collect()))
    assert got == Counter((x, flat[x] if x < len(flat) else None) for x in wanted)
    some = [0, flat[0], flat[7], 50_000, 1 << 30]
    assert Counter(map(tuple, tokens.token_counts(shards, some).collect())) == Counter((x, flat.count(x)) for x in set(some))
    assert sorted(map(tuple, tokens.token_places(shards, some).collect())) == sorted((x, k) for k, x in enumerate(flat) if x in set(some))


def test_warc_without_broadcast(nasty):
    a, b = (sorted(map(str, warc.typed(pages_of(nasty), n).collect())) for n in (100_000, 0))
    assert a == b and any("refers_to=0" in x for x in a)


def test_shared_folder_is_asked_for(spark, monkeypatch):
    from types import SimpleNamespace

    from quern.llm import common

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.scratch(far, "x")


def test_keys_of_the_same_first_half():
    from quern.llm import units

    one, two = np.array([5, 3, 5, 5, 3, 9], np.uint64), np.array([1, 1, 2, 1, 1, 1], np.uint64)
    first, which = units.distinct(one, two)
    assert one[first].tolist() == [3, 5, 5, 9] and two[first].tolist() == [1, 1, 2, 1]
    assert one[first][which].tolist() == one.tolist() and two[first][which].tolist() == two.tolist()
    first, which = units.distinct(one[:0], two[:0])
    assert len(first) == len(which) == 0
