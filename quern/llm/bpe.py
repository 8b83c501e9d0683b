"""Byte-level BPE encoding and decoding by merge replay over a corpus's words.

The distinct words of the whole corpus (a piece of text that the pattern matches is a word here) are dealt to partitions
by hash, each once. A partition takes its words as one long row of tokens, and keeps an inverted index from a pair's rank
to the places where such a pair stands. Ranks are then replayed in ascending order: all places of a rank are merged, and
only the pairs with the two touched neighbours enter the index anew. Words are independent of each other, so the division
doesn't matter; it keeps the index within a task's memory. A pair's rank is that of its joined bytes, as in tiktoken. If a
merge forms a pair of a lower rank than the one replayed, that word is finished at once, lowest rank first. How words get
to their partition and ids back to the documents is told in `units`.

Defined results: a null or empty text has no tokens (both digests are those of no bytes); repeated rows give repeated
results; texts of any length are one document; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import scratch, spread
from .units import CHUNK_BYTES, valued

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Token bytes by rank, and the rank of every joinable pair of tokens."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = dict(zip(self.ranks.values(), self.ranks.keys()))
        self.pairs: dict[int, int] = {}
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = r
        self.of_byte = np.array([self.ranks[bytes([x])] for x in range(256)], np.int64)
        self.of_two = np.full(65536, -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.of_two[a << 8 | b] = self.ranks.get(bytes((a, b)), -1)
        most = max(self.tokens) + 1
        self.bytes_of = Table([self.tokens.get(r, b"") for r in range(most)])
        self.digits_of = Table([b"%d " % r for r in range(most)])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def finish(i: int, tok: list, nxt: list, prv: list, pairs: dict[int, int]) -> None:
    """Merges one word to its end, lowest rank and then leftmost first."""
    while prv[i] >= 0:
        i = prv[i]
    while True:
        best, at, a = None, -1, i
        while (b := nxt[a]) >= 0:
            r = pairs.get(tok[a] << 20 | tok[b])
            if r is not None and (best is None or r < best):
                best, at = r, a
            a = b
        if best is None:
            return
        b = nxt[at]
        tok[at], tok[b], nxt[at] = best, -1, nxt[b]
        if nxt[at] >= 0:
            prv[nxt[at]] = at


def replay(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """Ids of each word."""
    flat, ends = replayed(words, v)
    return [flat[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist())]


def replayed(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, where each word's end)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    first = np.zeros(n, bool)
    first[starts] = True
    last = np.zeros(n, bool)
    last[starts + sizes - 1] = True
    tok: list[int] = v.of_byte[raw].tolist()
    place = np.arange(n)
    nxt: list[int] = np.where(last, -1, place + 1).tolist()
    prv: list[int] = np.where(first, -1, place - 1).tolist()
    two = v.of_two[raw[:-1].astype(np.int64) << 8 | raw[1:]]
    at = np.flatnonzero(~last[:-1] & (two >= 0))
    order = at[np.argsort(two[at], kind="stable")]
    keys = two[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    index: dict[int, list[int]] = {}
    if len(keys):
        for key, group in zip(keys[np.concatenate(([0], cuts))].tolist(), np.split(order, cuts)):
            index[key] = group.tolist()
    heap = list(index)
    heapq.heapify(heap)
    pairs, get = v.pairs, v.pairs.get
    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r)
        places.sort()
        for i in places:
            a = tok[i]
            j = nxt[i]
            if a < 0 or j < 0 or get(a << 20 | tok[j]) != r:
                continue
            tok[i] = r
            tok[j] = -1
            k = nxt[i] = nxt[j]
            lower = False
            if k >= 0:
                prv[k] = i
                q = get(r << 20 | tok[k])
                if q is not None:
                    if q < r:
                        lower = True
                    elif q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        heapq.heappush(heap, q)
            h = prv[i]
            if h >= 0:
                q = get(tok[h] << 20 | r)
                if q is not None:
                    if q < r:
                        lower = True
                    elif q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        heapq.heappush(heap, q)
            if lower:
                finish(i, tok, nxt, prv, pairs)
    ids = np.array(tok, np.int64)
    alive = ids >= 0
    return ids[alive], np.cumsum(alive)[starts + sizes - 1]


def words_of(units: list[bytes], find: Callable[[str], list[str]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, the words of all units by number, where each unit's end)."""
    names: dict[bytes, int] = {}
    of = names.setdefault
    flat, ends = [], []
    for u in units:
        if (u[1:] if u[:1] == b" " else u).isalpha():  # ASCII letters after at most one space are one match
            flat.append(of(u, len(names)))
        else:
            flat += [of(p.encode(), len(names)) for p in find(u.decode())]
        ends.append(len(flat))
    return list(names), np.array(flat, np.int64), np.array(ends, np.int64)


def unit_ids(units: list[bytes], v: Vocabulary, find: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units, where each unit's end)."""
    words, flat, ends = words_of(units, find)
    known = np.array([v.ranks.get(w, -1) for w in words], np.int64)
    rest = np.flatnonzero(known < 0)
    ids, stops = replayed([words[k] for k in rest.tolist()], v)
    # the ids of words that are one token stand behind those of the replayed ones
    begin, size = len(ids) + np.arange(len(words)), np.ones(len(words), np.int64)
    size[rest] = np.diff(stops, prepend=0)
    begin[rest] = stops - size[rest]
    n = size[flat]
    return np.concatenate((ids, known))[spread(begin[flat], n)], np.concatenate(([0], np.cumsum(n)))[ends]


class Table:
    """A byte string for each id; strings of many ids at once."""

    def __init__(self, strings: list[bytes]) -> None:
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def __call__(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The joined strings of ids[:ends[0]], ids[ends[0]:ends[1]], ..."""
        n = self.sizes[ids]
        stop = np.cumsum(n)
        data = self.flat[np.repeat(self.starts[ids] - (stop - n), n) + np.arange(int(stop[-1]) if len(n) else 0)].tobytes()
        cuts = np.concatenate(([0], stop))[ends].tolist()
        return [data[a:z] for a, z in zip([0, *cuts], cuts)]


def decode(ids: list[int], v: Vocabulary) -> bytes:
    return v.bytes_of(np.array(ids, np.int64), np.array([len(ids)]))[0]


def encoded(docs: DataFrame, path: str, pattern: str, texts: bool = False, chunk: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: n_tokens and the digests of its ids and of what they decode to; with `texts` also `ids`. Rows
    of a partition of `docs` must come again in the same order if a task is repeated, as those of a table do.
    chunk: bytes of text that a task holds at once."""
    schema = SCHEMA + (", ids array<int>" if texts else "")

    def values():
        import regex

        v, find = vocabulary(path), regex.compile(pattern).findall
        return lambda units: unit_ids(units, v, find)

    def finish(chunks):
        v = vocabulary(path)
        for chunk in chunks:
            for doc, ids, counts in chunk.slices():
                ends = np.cumsum(counts)
                cols = [
                    doc,
                    pa.array(counts),
                    pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in v.digits_of(ids, ends)]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in v.bytes_of(ids, ends)]),
                ]
                if texts:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return valued(d, scratch(docs.sparkSession, "op2-units"), pattern, values, finish, schema, chunk)
