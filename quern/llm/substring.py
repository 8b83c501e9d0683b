"""Substring dedup by difference-cover anchors.

Windows of WIDTH words count as repeated if their word sequence starts at two places or more, in one document or two.
Anchors are runs of WIDTH - PERIOD + 1 words that start at a position which modulo PERIOD lies in COVER, a perfect
difference set: whatever two positions a repeated sequence starts at, at one of the next PERIOD offsets both are anchors.
So every repeated window holds an anchor that stands elsewhere too, and only windows around such anchors are looked at.

  1 The texts are cut into chunks, kept in the shared folder. Each chunk sends its anchors' hashes, each once, to the
    partition of the hash, packed; a hash from two chunks is reported back to both.
  2 A chunk takes its reported anchors, and those that it holds twice itself, extends each to all windows around it, and
    sends these windows' hashes (96 bits), each once, likewise.
  3 A chunk marks reported windows and those that it holds twice itself, and drops the words that they cover.

A hash reaches its partition once from a chunk at most, however often a passage is repeated, so no group grows with the
number of copies. All rows of the exchanges are packed arrays, none of them empty, so what is exchanged grows as the words
do; there are as many partitions as hold each one's hashes to a few times PART_BYTES, for tables of any size.

Defined results: a null or empty text has no words and loses none; texts under WIDTH words lose none; repeated rows of
WIDTH words or more lose all of them; other columns are kept as they are; an empty table gives an empty result. Rows of
a chunk must come again in the same order if a task is repeated, as those of a table do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keys, local_fs, parts_for, pieces, put_file, runs, scratch, text_bytes, tidy, with_spaces, words_in, written

WIDTH, PERIOD = 35, 21
#: Every difference modulo 21 is one of two of these.
COVER = (0, 1, 4, 14, 16)
CHUNK_BYTES = 8 << 20
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
PACKED = "part int, chunk string, data binary"


class Hashes:
    """Hashes of a chunk's words, and of its runs of words that lie within one document."""

    def __init__(self, texts: list[bytes], block: int = 1 << 17) -> None:
        self.bytes, self.begins, self.sizes, self.counts = words_in(texts)
        raw = self.bytes.tobytes()
        self.words = np.empty(len(self.begins), np.uint64)
        for k in range(0, len(self.begins), block):
            a, n = self.begins[k : k + block], self.sizes[k : k + block]
            at, z = int(a[0]), int(a[-1] + n[-1])
            self.words[k : k + block] = keys(raw[at:z], a - at, n)[0]
        self.starts = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)

    def whole(self, width: int) -> np.ndarray:
        """Places at which a run of that many words starts within a document."""
        d = self.doc
        return np.flatnonzero(d[: len(d) - width + 1] == d[width - 1 :]) if len(d) >= width else np.zeros(0, np.int64)

    def anchors(self, width: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the cover's runs in documents of a window or more."""
        at = self.whole(width - period + 1)
        of = self.doc[at]
        at = at[np.isin((at - self.starts[of]) % period, cover) & (self.counts[of] >= width)]
        return at, runs(self.words, width - period + 1)[at] if len(at) else np.zeros(0, np.uint64)

    def around(self, anchors: np.ndarray, width: int, period: int) -> np.ndarray:
        """Places of all windows that hold one of the anchors."""
        if not len(anchors):
            return anchors
        of = self.doc[anchors]
        low = np.maximum(anchors - period + 1, self.starts[of])
        high = np.minimum(anchors, self.starts[of] + self.counts[of] - width)
        return np.flatnonzero(over(low, high + 1, len(self.words)))


#: Salts of the two hashes of a window.
FIRST, SECOND = 0, 0x5851F42D4C957F2D


def over(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places some of the spans cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, begins, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each key's first place, whether the key at each place is there twice or more)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(k), bool)
    out[order] = twice
    return order[np.concatenate(([True], ~same))] if len(k) else order, out


def packed(chunk: str, places: np.ndarray, keys: np.ndarray, more: np.ndarray | None, parts: int) -> Iterator[tuple[int, str, bytes]]:
    """The keys' rows by partition: keys, then places, then more bits of the keys."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1)).tolist()
    for a, z in zip(edges, edges[1:]):  # only partitions that get something: rows are never more than keys
        o = order[a:z]
        if z > a:
            yield int(part[o[0]]), chunk, keys[o].tobytes() + places[o].astype("<u4").tobytes() + (b"" if more is None else more[o].astype("<u4").tobytes())


def batch_of(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    p, c, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(c, pa.string()), pa.array(d, pa.binary())], names=["part", "chunk", "data"])


def in_batches(rows: Iterator[tuple[int, str, bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2]) + 100
        if size >= most:
            yield batch_of(held)
            held, size = [], 0
    if held:
        yield batch_of(held)


def send_anchors(docs: DataFrame, folder: str, parts: int, width: int, period: int, cover: tuple[int, ...], most: int) -> DataFrame:
    """Writes the chunks; rows of packed anchors, and one without data for each chunk."""

    def run(batches):
        from pyspark import TaskContext

        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def rows():
            nonlocal n, held, size
            chunk = f"{folder}/chunk-{task:06d}-{n:05d}.arrow"
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            put_file(chunk, sink.getvalue())
            x = Hashes([t for b in held for t in text_bytes(b.column("text"))])
            n, held, size = n + 1, [], 0
            at, keys = x.anchors(width, period, cover)
            first, _ = repeated(keys)
            yield n % parts, chunk, b""
            yield from packed(chunk, at[first], keys[first], None, parts)

        for batch in batches:
            for b in pieces(batch, min(most, 1 << 20)):
                held.append(b)
                size += b.nbytes
                if size >= most:
                    yield from in_batches(rows())
        if held:
            yield from in_batches(rows())

    return docs.mapInArrow(tidy(run), PACKED)


def met(sent: DataFrame, parts: int, extra: bool) -> DataFrame:
    """For each chunk and partition the places whose key another chunk has sent too. A row without data is handed on."""
    size = 16 if extra else 12

    def run(batches):
        chunks, at, keys, places, more = [], [], [], [], []
        for b in batches:
            for c, d in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist()):
                if not d:
                    yield batch_of([(0, c, b"")])
                    continue
                n = len(d) // size
                at.append(np.full(n, len(chunks), np.int32))
                chunks.append(c)
                keys.append(np.frombuffer(d, "<u8", n))
                places.append(np.frombuffer(d, "<u4", n, 8 * n))
                if extra:
                    more.append(np.frombuffer(d, "<u4", n, 12 * n))
        if not keys:
            return
        k, c, p = np.concatenate(keys), np.concatenate(at), np.concatenate(places)
        order = np.lexsort((np.concatenate(more), k)) if extra else np.argsort(k, kind="stable")
        k = k[order]
        same = k[1:] == k[:-1]
        if extra:
            m = np.concatenate(more)[order]
            same &= m[1:] == m[:-1]
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        o = order[twice]
        o = o[np.argsort(c[o], kind="stable")]
        cuts = np.searchsorted(c[o], np.arange(len(chunks) + 1))
        yield from in_batches((0, chunks[j], p[o[cuts[j] : cuts[j + 1]]].tobytes()) for j in range(len(chunks)) if cuts[j + 1] > cuts[j])

    return sent.repartitionById(parts, F.col("part")).mapInArrow(tidy(run), PACKED)


def by_chunk(batches) -> Iterator[tuple[str, np.ndarray]]:
    """Each chunk with all places reported to it, from rows sorted by chunk."""
    name, got = None, []
    for b in batches:
        for c, d in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist()):
            if c != name and name is not None:
                yield name, np.concatenate(got) if got else np.zeros(0, np.uint32)
                got = []
            name = c
            if d:
                got.append(np.frombuffer(d, "<u4"))
    if name is not None:
        yield name, np.concatenate(got) if got else np.zeros(0, np.uint32)


def load(chunk: str) -> pa.Table:
    fs, path = local_fs(chunk)
    with fs.open_input_file(path) as f:
        return pa.ipc.open_file(f).read_all()


def table_texts(t: pa.Table) -> list[bytes]:
    return [x for b in t.to_batches() for x in text_bytes(b.column("text"))]


def send_windows(reported: DataFrame, parts: int, width: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    def run(batches):
        for chunk, places in by_chunk(batches):
            x = Hashes(table_texts(load(chunk)))
            at, keys = x.anchors(width, period, cover)
            first, twice = repeated(keys)
            far = np.isin(keys, keys[np.searchsorted(at, places)]) if len(places) else np.zeros(len(at), bool)
            w = x.around(at[far | twice], width, period)
            yield from in_batches(iter([(0, chunk, b"")]))
            if len(w):
                one = runs(x.words, width, FIRST)[w]
                first, _ = repeated(one)
                w, one = w[first], one[first]
                yield from in_batches(packed(chunk, w, one, (runs(x.words, width, SECOND)[w] >> np.uint64(32)).astype(np.uint32), parts))

    return reported.mapInArrow(tidy(run), PACKED)


def covered(x: Hashes, places: np.ndarray, width: int) -> np.ndarray:
    """Which of the chunk's words a repeated window covers."""
    at = x.whole(width)
    if not len(at):
        return np.zeros(len(x.words), bool)
    one = runs(x.words, width, FIRST)
    known = np.unique(one[places.astype(np.int64)])
    one = one[at]
    _, hit = repeated(one)
    if len(known):
        hit |= known[np.minimum(np.searchsorted(known, one), len(known) - 1)] == one
    starts = at[hit]
    return over(starts, starts + width, len(x.words))


def finished(reported: DataFrame, schema: str, width: int, digest: bool) -> DataFrame:
    def run(batches):
        for chunk, places in by_chunk(batches):
            t = load(chunk)
            texts = table_texts(t)
            x = Hashes(texts)
            gone = covered(x, places, width)
            lost = np.zeros(len(texts), np.int64)
            np.add.at(lost, x.doc[gone], 1)
            # words that stay, of documents that are written anew
            stay = ~gone if digest else ~gone & (lost > 0)[x.doc]
            out, ends = with_spaces(x.bytes, x.begins[stay], x.sizes[stay])
            left = np.bincount(x.doc[stay], minlength=len(texts))
            stop = np.cumsum(left)
            kept: list[bytes | None] = []
            for n, m, z in zip(lost.tolist(), left.tolist(), stop.tolist()):
                if not (n or digest):
                    kept.append(None)
                else:
                    kept.append(out[int(ends[z - m - 1]) + 1 if z > m else 0 : int(ends[z - 1])] if m else b"")
            if digest:
                yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(x.counts), pa.array(lost), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                old = t.column("text").to_pylist()
                text = pa.array([o if k is None else k.decode() for o, k in zip(old, kept)], pa.string())
                left = pa.array(~((lost > 0) & (lost == x.counts)))
                out = t.set_column(t.schema.get_field_index("text"), "text", text).filter(left)
                for b in out.combine_chunks().to_batches(max_chunksize=2000):
                    yield b

    return reported.mapInArrow(tidy(run), schema)


def exchanged(docs: DataFrame, schema: str, digest: bool, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, most: int = CHUNK_BYTES) -> DataFrame:
    spark = docs.sparkSession
    parts, tasks = parts_for(docs)
    folder = scratch(spark, "op8-chunks")
    one = written(met(send_anchors(docs, folder, parts, width, period, cover, most), parts, False), "op8-anchors")
    two = send_windows(one.repartition(tasks, "chunk").sortWithinPartitions("chunk"), parts, width, period, cover)
    three = written(met(two, parts, True), "op8-windows")
    return finished(three.repartition(tasks, "chunk").sortWithinPartitions("chunk"), schema, width, digest)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return exchanged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), DIGEST, True)


def deduplicated(docs: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The documents without repeated passages: the words that stay, joined by one space, where a document loses some,
    else its text as it was. A document of which nothing stays is dropped; one without words stays. chunk: bytes that a task
    holds at once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return exchanged(docs, schema, False, most=chunk)
