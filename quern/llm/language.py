"""Language ID by a byte convolutional network in numpy.

Bytes (ASCII letters lower-cased) are embedded, convolved with filters of several widths, max-pooled over fixed windows
and classified by a softmax layer. The network is trained on the driver from a bounded sample of labelled documents: at
most SAMPLE_ROWS of a language (fewer of each, if there are more than SAMPLE_TOTAL / SAMPLE_ROWS languages), by a hash of
the id, and of each at most SAMPLE_WINDOWS windows from anywhere in its text. More than MOST_LANGUAGES languages are an
error. Whole texts are classified: all their windows, in batches, each weighing as many bytes as it holds.

Defined results: `und` with score 0 if a text is null, empty or without a letter, or if no language was learned; a
single learned language wins every other text; repeated rows get repeated results; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drawn, first_of_each, pieces, text_bytes, tidy

SAMPLE_ROWS, SAMPLE_WINDOWS, SAMPLE_TOTAL, MOST_LANGUAGES = 400, 6, 80_000, 2000
#: Below it a text is of no language that was learned.
LEAST_SCORE = 0.3
WINDOW, EMBED, FILTERS, WIDTHS = 192, 8, 12, (2, 3, 4)
WIDE = max(WIDTHS)
ASCII = re.compile(rb"[A-Za-z]")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


class Net:
    """embed (256 x E), one matrix (WIDE * E x filters) for all widths, bias, output layer (filters x languages)."""

    def __init__(self, langs: list[str], seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.langs = langs
        n = FILTERS * len(WIDTHS)
        self.mask = np.zeros((WIDE * EMBED, n), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[: width * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "conv": (r.normal(0, 0.3, (WIDE * EMBED, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": r.normal(0, 0.3, (n, len(langs))).astype(np.float32),
            "out_bias": np.zeros(len(langs), np.float32),
        }

    def pooled(self, w: np.ndarray, want: bool = False):
        """Pooled filters of windows (rows x WINDOW bytes)."""
        p = self.p
        e = p["embed"][w]
        n = WINDOW - WIDE + 1
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDE, axis=1).transpose(0, 1, 3, 2).reshape(len(w) * n, WIDE * EMBED)
        y = (cols @ p["conv"]).reshape(len(w), n, -1)
        top = y.max(axis=1) + p["bias"]
        return (np.maximum(top, 0), top, y.argmax(axis=1), cols) if want else np.maximum(top, 0)

    def probabilities(self, w: np.ndarray) -> np.ndarray:
        z = self.pooled(w) @ self.p["out"] + self.p["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        z = np.exp(z)
        return z / z.sum(axis=1, keepdims=True)

    def step(self, w: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy."""
        p, n = self.p, WINDOW - WIDE + 1
        h, top, at, cols = self.pooled(w, want=True)
        z = h @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(w)), y] -= 1
        z /= len(w)
        g = {"out": h.T @ z, "out_bias": z.sum(axis=0)}
        d = (z @ p["out"].T) * (top > 0)
        g["bias"] = d.sum(axis=0)
        rows = (np.arange(len(w))[:, None] * n + at).reshape(-1)
        picked = cols[rows].reshape(len(w), -1, WIDE * EMBED)
        g["conv"] = np.einsum("bfk,bf->kf", picked, d) * self.mask
        back = d[:, :, None] * p["conv"].T[None]
        g["embed"] = np.zeros_like(p["embed"])
        for k in range(WIDE):
            np.add.at(g["embed"], w[np.arange(len(w))[:, None], at + k].reshape(-1), back[:, :, k * EMBED : (k + 1) * EMBED].reshape(-1, EMBED))
        return g

    def train(self, w: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 11) -> "Net":
        """Adam, with a falling rate and batches that hold every language alike."""
        r = np.random.default_rng(seed)
        of = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            pick = np.array([of[k][r.integers(len(of[k]))] for k in r.integers(len(of), size=batch)])
            for k, g in self.step(w[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                self.p[k] -= (rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text, the last filled up with bytes 0."""
    raw = raw.lower()
    return np.frombuffer(raw + b"\0" * (-len(raw) % WINDOW), np.uint8).reshape(-1, WINDOW)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, list[bytes]]]:
    """(lang, texts of WINDOW characters or of the whole document, if that is shorter) of at most `rows` learnable documents
    of each language. Where in the text they start depends on a hash of the id."""
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("id is not null and lang is not null and text is not null and crc32(cast(id as string)) % 4 != 2")
    langs = d.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if langs > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    rows = max(1, min(rows, SAMPLE_TOTAL // max(langs, 1)))
    start = lambda j: F.pmod(F.xxhash64("id", j), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1
    some = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(SAMPLE_WINDOWS)), lambda j: F.substr("text", start(j).cast("int"), F.lit(WINDOW))))
    got = drawn(d, "lang", "id", rows).select("id", "lang", some.alias("some")).limit(4 * (SAMPLE_TOTAL + MOST_LANGUAGES)).collect()
    kept = sorted(first_of_each(got, "lang", "id", rows), key=lambda r: (r.lang, r.id, r.some))
    return [(r.lang, [x.encode() for x in r.some]) for r in kept if any(map(has_letter, r.some))]


def learned(rows: list[tuple[str, list[bytes]]], seed: int = 3) -> Net | None:
    if not rows:
        return None
    r = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in rows})
    xs, ys = [], []
    for lang, some in rows:
        pick = np.concatenate([windows(x[:WINDOW]) for x in some if x])
        xs.append(pick)
        ys += [langs.index(lang)] * len(pick)
        cut = int(r.integers(4, WINDOW))  # short texts are mostly filling
        short = np.zeros((1, WINDOW), np.uint8)
        short[0, :cut] = pick[0][:cut]
        xs.append(short)
        ys.append(langs.index(lang))
    return Net(langs).train(np.concatenate(xs), np.array(ys))


def judged(net: Net | None, column: pa.Array) -> tuple[list[str], list[float]]:
    """(language, score) of each text."""
    texts = column.to_pylist()
    raws = text_bytes(column)
    lang, score = ["und"] * len(raws), [0.0] * len(raws)
    at = [k for k, (r, t) in enumerate(zip(raws, texts)) if net is not None and r and (ASCII.search(r) or has_letter(t))]
    if at:
        ws = [windows(raws[k]) for k in at]
        allw = np.concatenate(ws)
        p = np.concatenate([net.probabilities(allw[k : k + 64]) for k in range(0, len(allw), 64)]).astype(np.float64)
        n = np.array([len(w) for w in ws])
        begins = np.cumsum(n) - n
        weight = np.full(len(allw), float(WINDOW))
        weight[begins + n - 1] = [len(raws[k]) - (c - 1) * WINDOW for k, c in zip(at, n.tolist())]
        mean = np.add.reduceat(p * weight[:, None], begins, axis=0) / np.add.reduceat(weight, begins)[:, None]
        for k, i, x in zip(at, mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist()):
            lang[k], score[k] = net.langs[i], min(1.0, x)
    return lang, score


def predicted(docs: DataFrame, net: Net | None) -> DataFrame:
    """One row per document: held_out, lang_pred, score."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 4 << 20):
                lang, score = judged(net, b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(tidy(run), SCHEMA)


def accepted(docs: DataFrame, net: Net | None, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, as they are, whose language is told with a score of at least `least`."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 4 << 20):
                lang, score = judged(net, b.column("text"))
                yield b.filter(pa.array([x != "und" and y >= least for x, y in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def identified(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Languages of `docs` by a network learned from `labelled` (the same table if none is given)."""
    return predicted(docs, learned(sample(docs if labelled is None else labelled)))
