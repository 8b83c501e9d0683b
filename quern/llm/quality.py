"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are measured on a bounded sample of whole documents (about SAMPLE_ROWS, by a hash of the
id, each under SAMPLE_CHARS characters). The first rule is that of the most rejections per second; the next is chosen on
the documents that it leaves, with what is already counted at hand, and so on. A document leaves the cascade at the first
rule that rejects it, and what only later rules would have counted is not counted, unless it is asked for. The order
changes the work, never the verdict, so reruns agree whatever the timings were.

Defined results: a null or empty text has no words, all counts 0, base_failed true, kept false. Repeated rows are judged
each for itself. Other columns, also ones named like the results, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keys, pieces, runs, text_bytes, tidy, words_in

SAMPLE_CHARS, REPEATS = 100_000, 3
SAMPLE_ROWS = 400
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = re.compile(rb"[#*$%&|<>]")
NOT_SYMBOLS = bytes(x for x in range(256) if x not in b"#*$%&|<>")
CONTINUATION = bytes(range(0x80, 0xC0))
SPACES = b" \t\n\r\x0b\x0c"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


class Doc:
    """A text and the counts that rules may use, each made when it is first asked for."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, CONTINUATION + SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw.translate(None, NOT_SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        if b"\n" not in self.raw:
            return 0
        lines = [x for x in self.raw.split(b"\n") if x and not x.isspace()]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return int(repeats([self.raw])[0])

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words


def repeats(raws: list[bytes]) -> np.ndarray:
    """For each text the number of its words in WINDOW-word runs that it holds twice or more."""
    x, starts, sizes, counts = words_in(raws)
    out = np.zeros(len(raws), np.int64)
    n = len(starts)
    if n < WINDOW:
        return out
    five = runs(keys(x.tobytes(), starts, sizes)[0], WINDOW)
    doc = np.repeat(np.arange(len(raws)), counts)
    at = np.flatnonzero(doc[: len(five)] == doc[WINDOW - 1 :])
    k = five[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(k, kind="stable")
    k = k[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = at[order[twice]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + WINDOW, -1)
    np.add.at(out, doc[np.cumsum(edge[:-1]) > 0], 1)
    return out


def enough_words(d: Doc) -> bool:
    return d.n_words >= MIN_WORDS


def few_repeats(d: Doc) -> bool:
    return 100 * d.n_repeat_words <= REPEAT_PERCENT * d.n_words


def no_symbol_flood(d: Doc) -> bool:
    return d.n_symbols <= max(3, d.n_words // 4)


def few_dup_lines(d: Doc) -> bool:
    return d.n_dup_lines == 0 or 10 * d.n_dup_lines <= 3 * (d.raw.count(b"\n") + 1)


def sane_word_length(d: Doc) -> bool:
    return 2 * d.n_words <= d.word_chars <= 20 * d.n_words


def not_shouting(d: Doc) -> bool:
    """Not mostly exclamation marks after words."""
    return 2 * d.raw.count(b"!") <= d.n_words


def mostly_letters(d: Doc) -> bool:
    """At least half of the characters outside white space are letters or at least not ASCII digits and signs."""
    other = len(re.sub(rb"[A-Za-z\x80-\xFF\s]+", b"", d.raw))
    return 2 * other <= d.word_chars


def varied_words(d: Doc) -> bool:
    """No single word fills more than 30 % of a text of 20 words or more."""
    if d.n_words < 20:
        return True
    most = 0
    seen: dict[bytes, int] = {}
    for w in d.words:
        seen[w] = k = seen.get(w, 0) + 1
        if k > most:
            most = k
    return 10 * most <= 3 * d.n_words


#: name -> keeps(document). A cascade rejects what any rule rejects. The first two are the base.
RULES: dict[str, Callable[[Doc], bool]] = {
    "words": enough_words,
    "repeats": few_repeats,
    "symbols": no_symbol_flood,
    "dup_lines": few_dup_lines,
    "word_length": sane_word_length,
    "shouting": not_shouting,
    "letters": mostly_letters,
    "variety": varied_words,
}


def timed(docs: list[Doc], keeps: Callable[[Doc], bool]) -> tuple[float, list[bool]]:
    """(seconds, verdicts): the least of some runs, each on documents that have counted only what these have."""
    best = None
    for _ in range(REPEATS):
        fresh = []
        for d in docs:
            x = Doc(d.raw)
            x.__dict__.update(d.__dict__)
            fresh.append(x)
        began = time.perf_counter()
        out = [keeps(x) for x in fresh]
        took = time.perf_counter() - began
        best = took if best is None else min(best, took)
    return best, out


def measured(raws: list[bytes], rules: dict[str, Callable[[Doc], bool]], timed: Callable = timed) -> list[str]:
    """The rules' names in the order in which the cascade runs them: each time that of the most rejections per second among
    the documents left (half a rejection added, so that rules that reject nothing go by cost); ties by name."""
    docs, left, order = [Doc(r) for r in raws], sorted(rules), []
    while left:
        gain = {}
        for name in left:
            seconds, out = timed(docs, rules[name])
            gain[name] = ((len(out) - sum(out) + 0.5) / (seconds + 1e-9), out)
        best = max(left, key=lambda x: gain[x][0])
        for d in docs:  # what the rule counts is there for the rules after it
            rules[best](d)
        docs = [d for d, ok in zip(docs, gain[best][1]) if ok]
        order.append(best)
        left.remove(best)
    return order


def order_of_rules(docs: DataFrame, rules: dict[str, Callable[[Doc], bool]] | None = None, rows: int = SAMPLE_ROWS) -> list[str]:
    """The order measured on about `rows` documents drawn by a hash of the id."""
    rules = RULES if rules is None else rules
    share = F.shiftrightunsigned(F.xxhash64(F.lit(10), F.col("doc_id").cast("string")), 11) / F.lit(float(1 << 53))
    sample = docs.where(share * F.lit(float(docs.count())) < 1.5 * rows).select(F.col("text").cast("string").alias("text")).where(F.length("text") < SAMPLE_CHARS).limit(2 * rows)
    return measured([r[0].encode() for r in sample.collect()], rules)


def cascaded(docs: list[Doc], chain: list[Callable[[Doc], bool]]) -> list[bool]:
    """Which documents no rule rejects. Rules after the first that rejects a document aren't asked."""
    return [all(keeps(d) for keeps in chain) for d in docs]


def counted(docs: list[Doc]) -> None:
    """Repeated words of all documents that haven't been counted, at once."""
    rest = [d for d in docs if "n_repeat_words" not in d.__dict__]
    for d, n in zip(rest, repeats([d.raw for d in rest]).tolist()):
        d.n_repeat_words = n


def judged(docs: DataFrame, order: list[str] | None = None, rules: dict[str, Callable[[Doc], bool]] | None = None) -> DataFrame:
    """One row per document: counts, base_failed, kept. Counts that the cascade has no need of are made after its verdict."""
    rules = RULES if rules is None else rules
    order = order_of_rules(docs, rules) if order is None else order
    chain = [rules[x] for x in order]

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 1 << 20):
                out = [Doc(r) for r in text_bytes(b.column("text"))]
                kept = cascaded(out, chain)
                counted(out)
                cols = [pa.array([getattr(d, k) for d in out], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                failed = [d.base_failed for d in out]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(failed, pa.bool_()), pa.array([k and not f for k, f in zip(kept, failed)], pa.bool_())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA)


def kept(docs: DataFrame, order: list[str] | None = None, rules: dict[str, Callable[[Doc], bool]] | None = None) -> DataFrame:
    """The documents that every rule keeps, as they are; nothing is counted that the cascade has no need of."""
    rules = RULES if rules is None else rules
    order = order_of_rules(docs, rules) if order is None else order
    chain = [rules[x] for x in order]

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 1 << 20):
                yield b.filter(pa.array(cascaded([Doc(r) for r in text_bytes(b.column("text"))], chain), pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
