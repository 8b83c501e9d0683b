"""Ranked lexical search: postings traversed in fixed windows of doc_ids.

The items are taken in blocks of bounded size; a block's terms are the vocabulary of one pass over all whole texts, which
leaves a row of postings for each document (its number of terms, and the vocabulary's terms in it with their counts) in a
table. Document frequencies and lengths are summed over all of it. Then each task takes its rows in windows of WINDOW
consecutive doc_ids, turns a window into postings by term, and, item by item, adds the contributions of the item's terms
into one array of a slot for each document. A map of the slots that were touched says what to harvest into the item's heap
of the best so far. Tasks hand on at most `best` rows for each item; those are ranked in two steps, so that no task sees
what all others found for an item.

Defined results: a null or empty text, or one without a term, counts nowhere. An item without a term, or whose terms no
document holds, has no rows. Repeated rows of one (item_id, text) are one item; other texts under the same item_id are
items of their own. Repeated documents are documents each; equal scores go by doc_id, a null doc_id last. A null item_id is
an id like others. A window with more rows than slots (many rows of one doc_id) is taken in several turns. Other columns,
also ones named like the results, are ignored. Without documents or items the result is empty.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import pieces, text_bytes, tidy, written

#: doc_ids of a window: with 8 bytes a slot the scores of one stay in a core's cache.
WINDOW_BITS = 12
WINDOW = 1 << WINDOW_BITS
#: Rows and postings that a task gathers before it sorts them into windows.
GATHER_ROWS, GATHER_POSTINGS = 16 * WINDOW, 1 << 22
#: Bytes of item texts in a block.
BLOCK_BYTES = 2 << 20
BEST = 50
#: Parts of the constants of the score: 1000 * k1 = 1000, b = 50 %.
B_PERCENT = 50
SALTS = 64
#: A term: letters, digits and all that isn't ASCII, with A-Z folded.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
NO_ID = (1 << 63) - 1

Item = tuple[int | None, list[bytes]]


def term_counts(raw: bytes, step: int = 1 << 20) -> tuple[Counter, int]:
    """How often each term occurs, and the number of all. Long texts go by parts, cut between terms."""
    folded, at, out, n = raw.translate(FOLD), 0, Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + step) if len(folded) - at > step else -1
        end = len(folded) if end < 0 else end
        words = folded[at:end].split()
        out.update(words)
        n, at = n + len(words), end
    return out, n


def blocks_of(items: DataFrame, most: int = BLOCK_BYTES):
    """The items in blocks of about `most` bytes of text: (item_id, distinct terms) of each."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    rows = written(rows.withColumn("h", F.xxhash64(F.lit(13), "item_id", "text")), "op13-items")
    n = 1 + int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most
    for k in range(n):
        got = rows.where(F.pmod("h", F.lit(n)) == k).select("item_id", "text").collect()
        block = [(r.item_id, sorted(term_counts(r.text.encode())[0])) for r in got]
        if block := [x for x in block if x[1]]:
            yield sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def postings(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """doc_id, n and the vocabulary's terms with their counts, of each document with a term."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 4 << 20):
                kept, sizes, terms, tfs, ends = [], [], [], [], [0]
                for i, raw in enumerate(text_bytes(b.column("text"))):
                    found, n = term_counts(raw)
                    if n:
                        for w in found.keys() & ids.keys():
                            terms.append(ids[w])
                            tfs.append(found[w])
                        kept.append(i)
                        sizes.append(n)
                        ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(d.mapInArrow(tidy(run), "doc_id long, n long, terms array<int>, tfs array<long>"), "op13-postings")


def statistics(table: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and each vocabulary term's documents: one row a task and term."""

    def run(batches):
        df, n, total = np.zeros(terms, np.int64), 0, 0
        for b in batches:
            n += b.num_rows
            total += int(np.sum(b.column("n").to_numpy(zero_copy_only=False), dtype=np.int64))
            df += np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, at], pa.int64()), pa.array(np.r_[n, total, df[at]], pa.int64())], names=["term", "value"])

    df, n, total = np.zeros(terms, np.int64), 0, 0
    for r in table.select("n", "terms").mapInArrow(run, "term long, value long").groupBy("term").agg(F.sum("value").alias("value")).collect():
        if r.term == -1:
            n = r.value
        elif r.term == -2:
            total = r.value
        else:
            df[r.term] = r.value
    return n, total, df


class Heaps:
    """The best of each item so far, as (score, -doc_id), least first."""

    def __init__(self, items: int, best: int) -> None:
        self.best, self.heaps = best, [[] for _ in range(items)]

    def harvest(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """Scores above 0 that can be among the best; docs are ascending."""
        heap = self.heaps[item]
        least = heap[0][0] if len(heap) == self.best else 1
        if len(scores) > self.best:
            least = max(least, int(np.partition(scores, len(scores) - self.best)[len(scores) - self.best]))
        at = np.flatnonzero(scores >= least)
        for s, d in zip(scores[at].tolist(), docs[at].tolist()):
            if len(heap) < self.best:
                heapq.heappush(heap, (s, -d))
            elif (s, -d) > heap[0]:
                heapq.heapreplace(heap, (s, -d))


class Searcher:
    """Items with their term ids, and what the score of a posting needs."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, n: int, total: int, best: int = BEST) -> None:
        self.items, self.weights, self.n, self.total, self.best = [np.array(x, np.int64) for x in items], weights, n, total, best

    def window(self, heaps: Heaps, docs: np.ndarray, sizes: np.ndarray, slots: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """One window: `docs` ascending with their sizes; postings as the document's slot, the term and its count."""
        order = np.argsort(terms, kind="stable")
        slots, terms, tfs = slots[order], terms[order], tfs[order]
        m = 100 - B_PERCENT + (B_PERCENT * sizes * self.n) // self.total
        gain = self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[slots]))
        edge = np.searchsorted(terms, np.arange(len(self.weights) + 1))
        score, touched = np.zeros(len(docs), np.int64), np.zeros(len(docs), bool)
        for k, wanted in enumerate(self.items):
            begin, end = edge[wanted], edge[wanted + 1]
            for a, z in zip(begin[end > begin].tolist(), end[end > begin].tolist()):
                at = slots[a:z]
                score[at] += gain[a:z]
                touched[at] = True
            hit = np.flatnonzero(touched)
            if len(hit):
                heaps.harvest(k, score[hit], docs[hit])
                score[hit] = 0
                touched[hit] = False

    def windows(self, heaps: Heaps, docs: np.ndarray, sizes: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Sorts what a task has gathered by doc_id and takes it window by window."""
        order = np.argsort(docs, kind="stable")
        begins = np.cumsum(counts) - counts
        docs, sizes, counts, begins = docs[order], sizes[order], counts[order], begins[order]
        key = docs >> WINDOW_BITS
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
        for a, z in zip(cuts, cuts[1:]):
            for x in range(a, z, WINDOW):
                y = min(x + WINDOW, z)
                slots = np.repeat(np.arange(y - x), counts[x:y])
                at = np.repeat(begins[x:y] - (np.cumsum(counts[x:y]) - counts[x:y]), counts[x:y]) + np.arange(len(slots))
                self.window(heaps, docs[x:y], sizes[x:y], slots, terms[at], tfs[at])

    def run(self, batches):
        from pyspark import TaskContext

        heaps, held, rows, size = Heaps(len(self.items), self.best), [], 0, 0

        def turn():
            cols = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            self.windows(heaps, *cols)

        for b in batches:
            ids, lists, tfs = b.column("doc_id"), b.column("terms"), b.column("tfs")
            held.append((ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)))
            rows, size = rows + b.num_rows, size + len(held[-1][3])
            if rows >= GATHER_ROWS or size >= GATHER_POSTINGS:
                turn()
                rows = size = 0
        if held:
            turn()
        part = TaskContext.get().partitionId()
        for k, heap in enumerate(heaps.heaps):
            if heap:
                ids = [None if d == -NO_ID else -d for _, d in heap]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(heap), pa.int32()), pa.array([part] * len(heap), pa.int32()), pa.array(ids, pa.int64()), pa.array([s for s, _ in heap], pa.int64())], names=["item", "part", "doc_id", "score"])


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `best` documents of each item."""
    spark, out = docs.sparkSession, None
    for block in blocks_of(items, block_bytes):
        words = sorted({w for _, terms in block for w in terms})
        ids = {w: k for k, w in enumerate(words)}
        table = postings(docs, ids)
        n, total, df = statistics(table, len(words))
        if not n:
            break
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        found = table.mapInArrow(tidy(Searcher([[ids[w] for w in terms] for _, terms in block], weights, n, total, best).run), "item int, part int, doc_id long, score long")
        first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", F.pmod("part", F.lit(SALTS))).orderBy(*first))).where(F.col("rank") <= best)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*first))).where(F.col("rank") <= best)
        of = F.element_at(F.array(*(F.lit(i).cast("long") for i, _ in block)), F.col("item") + 1)
        got = written(found.select(of.alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "op13-found")
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
