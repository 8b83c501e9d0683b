"""Values of a corpus's units: each distinct one is worked out once in the whole corpus.

A pre-tokenizer's pattern never matches over a single space that stands between two other characters but by starting at
it. So a text falls into units: its first word, and every further word with its space. A text in which a space stands at
an end or beside other white space is cut by the pattern itself; its units are the matches.

  1 A chunk of texts tells its units apart, writes which unit follows which to a file in the shared folder, and sends
    each distinct unit once, packed, to the partition of its hash.
  2 A partition has every unit of the corpus that hashes to it, from however many chunks, once, works out its value (token
    ids), and sends these back to each chunk that asked.
  3 A chunk puts its documents together from its units' ids.

A unit reaches its partition at most once from a chunk, so frequent words make no hot groups; empty rows aren't sent, so
what is exchanged grows as the text does. Units are told apart by 128 bits. A chunk's name holds a hash of what is in it,
so a repeated task that gets its rows in another order can't be mistaken for the first.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keys, local_fs, parts_for, pieces, put_file, spread, text_bytes, tidy

CHUNK_BYTES, SLICE_BYTES, SLICE_UNITS = 8 << 20, 1 << 20, 200_000
ROWS = "to int, chunk string, part int, data binary"
#: ASCII characters that str.isspace() calls white.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def wide_white(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether bytes c b a (the last three up to some place) end with a white character beyond ASCII."""
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    e2 = (c == 0xE2) & (((b == 0x80) & ((a >= 0x80) & (a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))) | ((b == 0x81) & (a == 0x9F)))
    return two | e2 | ((c == 0xE1) & (b == 0x9A) & (a == 0x80)) | ((c == 0xE3) & (b == 0x80) & (a == 0x80))


def beside_white(x: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Which spaces have white space before or after them."""
    p = np.concatenate((np.zeros(3, np.uint8), x, np.zeros(3, np.uint8)))
    out = WHITE[p[space + 2]] | WHITE[p[space + 4]]
    k = np.flatnonzero(p[space + 2] >= 0x80)
    s = space[k]
    out[k] |= wide_white(p[s + 2], p[s + 1], p[s])
    k = np.flatnonzero(p[space + 4] >= 0xC2)
    s = space[k]
    out[k] |= wide_white(p[s + 5], p[s + 4], np.zeros(len(s), np.uint8)) | wide_white(p[s + 6], p[s + 5], p[s + 4])
    return out


class Finder:
    """A pattern's matches in a text, where special tokens stand for themselves and end the text before them."""

    def __init__(self, pattern: str, special: tuple[str, ...] = ()) -> None:
        import regex

        self.find, self.special = regex.compile(pattern).findall, [x.encode() for x in special]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None

    def __call__(self, text: str) -> list[str]:
        if self.split is None:
            return self.find(text)
        return [x for k, part in enumerate(self.split(text)) for x in ([part] if k % 2 else self.find(part))]

    def special_in(self, raws: list[bytes]) -> list[int]:
        return [k for k, raw in enumerate(raws) if any(x in raw for x in self.special)] if self.special else []


def cut(raws: list[bytes], find: Finder) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(all texts joined, where each unit starts in them, number of units of each text)."""
    buf = b"".join(raws)
    x = np.frombuffer(buf, np.uint8)
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    stops = np.cumsum(sizes)
    begins = stops - sizes
    first = x == 32
    space = np.flatnonzero(first)
    edge = np.zeros(len(x) + 1, bool)
    edge[begins] = edge[stops] = True
    bad = beside_white(x, space) | edge[space] | edge[space + 1]
    first[begins[sizes > 0]] = True
    for k in np.unique(np.r_[np.searchsorted(begins, space[bad], side="right") - 1, find.special_in(raws)].astype(np.int64)).tolist():
        a, z = int(begins[k]), int(stops[k])
        text = raws[k].decode()
        found = find(text)
        n = np.fromiter(map(len, found) if len(text) == z - a else (len(p.encode()) for p in found), np.int64, len(found))
        if int(n.sum()) != z - a:
            raise ValueError("the pattern leaves characters out")
        first[a:z] = False
        first[a + np.cumsum(n) - n] = True
    starts = np.flatnonzero(first)
    return buf, starts, np.searchsorted(starts, stops) - np.searchsorted(starts, begins)


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, in the order of `one`; which of them each place has)."""
    import pandas as pd

    code, values = pd.factorize(one)
    first = np.empty(len(values), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    order = np.argsort(values)
    if (two[first][code] == two).all():
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return first[order], rank[code]
    order = np.lexsort((two, one))  # two units of the same first 64 bits
    k, t = one[order], two[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    which = np.empty(len(k), np.uint32)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def small_numbers(n: np.ndarray) -> bytes:
    """How many, each in a byte, and those of 255 or more again in four."""
    return struct.pack("<I", len(n)) + np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u4").tobytes()


def read_numbers(data: bytes) -> tuple[np.ndarray, int]:
    """(the numbers, where they end)."""
    n = struct.unpack_from("<I", data)[0]
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    big = np.flatnonzero(out == 255)
    out[big] = np.frombuffer(data, "<u4", len(big), 4 + n)
    return out, 4 + n + 4 * len(big)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers below 2**24 in three compressed planes of bytes, which are smooth where the numbers themselves aren't."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack((x >> x.dtype.type(k) & x.dtype.type(255)).astype(np.uint8).tobytes()) for k in (0, 8, 16)]
    return struct.pack("<III", *map(len, parts)) + b"".join(parts)


def unsqueezed(data: bytes) -> np.ndarray:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    ends = np.cumsum((12, *struct.unpack_from("<III", data))).tolist()
    a, b, c = (np.frombuffer(unpack(data[i:j]), np.uint8).astype(np.uint32) for i, j in zip(ends, ends[1:]))
    return a | b << np.uint32(8) | c << np.uint32(16)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    to, chunk, part, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(chunk, pa.string()), pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["to", "chunk", "part", "data"])


def in_batches(rows: Iterator[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3]) + 100
        if size >= most:
            yield batch_of(held)
            held, size = [], 0
    if held:
        yield batch_of(held)


class Gathered:
    """The texts of a chunk as they come in, a slice at a time."""

    def __init__(self, find: Finder) -> None:
        self.find = find
        self.docs: list[pa.Array] = []
        self.buf, self.starts, self.sizes, self.counts, self.one, self.two = ([] for _ in range(6))
        self.at = 0

    def add(self, docs: pa.Array, raws: list[bytes]) -> None:
        buf, starts, counts = cut(raws, self.find)
        sizes = np.diff(starts, append=len(buf))
        one, two = keys(buf, starts, sizes)
        self.docs.append(docs)
        for held, new in ((self.buf, buf), (self.starts, (starts + self.at).astype(np.uint32)), (self.sizes, sizes.astype(np.uint32)), (self.counts, counts), (self.one, one), (self.two, two)):
            held.append(new)
        self.at += len(buf)

    def closed(self, folder: str, task: int, n: int, parts: int) -> Iterator[tuple]:
        """Writes the chunk's file; the rows that it sends, and one without data, so that it comes back in any case."""
        import xxhash
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        buf = np.frombuffer(b"".join(self.buf), np.uint8)
        one, two = np.concatenate(self.one), np.concatenate(self.two)
        self.one = self.two = self.buf = []
        first, which = distinct(one, two)
        one = one[first]
        del two
        starts, sizes = (np.concatenate(x)[first].astype(np.int64) for x in (self.starts, self.sizes))
        self.starts = self.sizes = []
        if len(first) >> 24:
            raise ValueError("more units in a chunk than its file has numbers for")
        # frequent units get small numbers, which take less room
        order = np.argsort(-np.bincount(which, minlength=len(first)), kind="stable").astype(np.uint32)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": pa.chunked_array(self.docs), "units": np.concatenate(self.counts)})
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        body = [sink.getvalue().to_pybytes(), squeezed(rank[which]), squeezed(order)]
        head = struct.pack("<III", *map(len, body))
        chunk = f"{folder}/units-{task:06d}-{n:05d}-{xxhash.xxh3_64_hexdigest(b''.join(body))}"
        put_file(chunk, head + b"".join(body))
        to = (task * 7919 + n * 104729) & 0x7FFFFFFF
        yield to, chunk, -1, b""
        part = ((one >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        flat = buf[spread(starts, sizes)]
        del buf
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        for a, z in zip(edges.tolist(), edges[1:].tolist()):
            yield to, chunk, int(part[a]), pack(small_numbers(sizes[a:z]) + flat[ends[a] : ends[z]].tobytes())


def sent(docs: DataFrame, folder: str, pattern: str, parts: int, most: int = CHUNK_BYTES, special: tuple[str, ...] = ()) -> DataFrame:
    """docs: doc_id, text. Writes chunks of about `most` bytes; rows for step 2."""

    def run(batches):
        from pyspark import TaskContext

        find, task, n = Finder(pattern, special), TaskContext.get().partitionId(), 0
        held = Gathered(find)
        for batch in batches:
            for b in pieces(batch, min(most, SLICE_BYTES)):
                held.add(b.column("doc_id"), text_bytes(b.column("text")))
                if held.at >= most:
                    yield from in_batches(held.closed(folder, task, n, parts))
                    held, n = Gathered(find), n + 1
        if held.docs:
            yield from in_batches(held.closed(folder, task, n, parts))

    return docs.mapInArrow(tidy(run), ROWS)


def met(asked: DataFrame, values: Callable[[], Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]], parts: int) -> DataFrame:
    """values() is called in the task and gives units -> (ids of all, where each unit's end)."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        rows, at, bufs, sizes = [], [0], [], []
        for b in batches:
            for to, chunk, part, data in zip(*(b.column(c).to_pylist() for c in ("to", "chunk", "part", "data"))):
                if not data:
                    yield batch_of([(to, chunk, -1, b"")])
                    continue
                data = unpack(data)
                n, a = read_numbers(data)
                rows.append((to, chunk, part))
                at.append(at[-1] + len(n))
                sizes.append(n)
                bufs.append(data[a:])
        if not rows:
            return
        buf, size = b"".join(bufs), np.concatenate(sizes)
        del bufs, sizes
        starts = np.cumsum(size) - size
        first, which = distinct(*keys(buf, starts, size))
        ids, ends = values()([buf[a : a + k] for a, k in zip(starts[first].tolist(), size[first].tolist())])
        ids = np.asarray(ids, np.uint32)
        counts = np.diff(ends, prepend=0)
        begins = ends - counts

        def answers():
            for (to, chunk, part), a, z in zip(rows, at, at[1:]):
                k = which[a:z]
                yield to, chunk, part, small_numbers(counts[k]) + squeezed(ids[spread(begins[k], counts[k])])

        yield from in_batches(answers())

    return asked.repartitionById(parts, F.greatest(F.col("part"), F.lit(0))).mapInArrow(tidy(run), ROWS)


class Chunk:
    """A chunk's documents, from its file and the answers in the order of their partitions."""

    def __init__(self, path: str, answers: list[bytes]) -> None:
        fs, at = local_fs(path)
        with fs.open_input_stream(at, compression=None) as f:
            data = f.read()
        ends = np.cumsum((12, *struct.unpack_from("<III", data))).tolist()
        table = pa.ipc.open_stream(data[ends[0] : ends[1]]).read_all()
        self.name = path.rsplit("/", 1)[1]
        self.docs = pa.concat_arrays(table.column("doc_id").chunks)
        self.units = table.column("units").to_numpy()
        self.which, order = unsqueezed(data[ends[1] : ends[2]]), unsqueezed(data[ends[2] : ends[3]])
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for x in answers:
            n, at = read_numbers(x)
            counts.append(n)
            ids.append(unsqueezed(x[at:]))
        n, self.ids = np.concatenate(counts), np.concatenate(ids)
        if len(order) != len(n):
            raise ValueError(f"{path} has {len(order)} units, {len(n)} came back")
        self.counts, self.begins = n[order], (np.cumsum(n) - n)[order]

    def slices(self, most: int = SLICE_UNITS) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(doc_id, all their ids, ids of each) of some documents at a time, in the chunk's order."""
        stops = np.cumsum(self.units)
        block = (stops - self.units) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else [0]
        for a, z in zip(cuts, cuts[1:]):
            lo, hi = int(stops[a] - self.units[a]), int(stops[z - 1])
            k = self.which[lo:hi]
            n = self.counts[k]
            sums = np.concatenate(([0], np.cumsum(n)))
            yield self.docs.slice(a, z - a), self.ids[spread(self.begins[k], n)], np.diff(sums[stops[a:z] - lo], prepend=0)


def by_chunk(batches) -> Iterator[tuple[str, list[bytes]]]:
    """Each chunk with its answers, from rows sorted by chunk and part."""
    name, got = None, []
    for b in batches:
        for chunk, data in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist()):
            if chunk != name:
                if name is not None:
                    yield name, got
                name, got = chunk, []
            if data:
                got.append(data)
    if name is not None:
        yield name, got


def valued(docs: DataFrame, folder: str, pattern: str, values: Callable, finish: Callable[[Iterator[Chunk]], Iterator[pa.RecordBatch]], schema: str, most: int = CHUNK_BYTES, special: tuple[str, ...] = ()) -> DataFrame:
    """finish(chunks) -> rows. docs: doc_id, text. `most`: bytes of text in a chunk. `special`: tokens that the pattern doesn't see."""
    _, parts = parts_for(docs)

    def run(batches):
        yield from finish(Chunk(path, answers) for path, answers in by_chunk(batches))

    back = met(sent(docs, folder, pattern, parts, most, special), values, parts)
    return back.repartitionById(parts, F.col("to") % parts).sortWithinPartitions("chunk", "part").mapInArrow(tidy(run), schema)
