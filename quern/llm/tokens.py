"""Token ids as files: one wavelet matrix per shard.

A shard holds whole documents in ascending doc_id order. Level by level, from the highest bit of an id to the lowest, the
matrix keeps one bit per token and then sorts tokens stably by that bit. Each bit-plane is cut into blocks of 2**19 bits,
each compressed for itself, with the number of ones before it, so that access, rank, count and select read few blocks of
one compressed file; the whole shard can also be unrolled at once.

File: b"QWM1", a little-endian unsigned 32-bit length, JSON of that length (n, levels, zeros, docs, nulls, blocks), then
the compressed parts that `blocks` lists as [name, offset, bytes, ones before].

Texts are brought into the order of their ids first; a chunk of them becomes a shard. The library encodes each distinct
unit of the corpus once (`units` tells how units get to it and ids back to the shards).

Defined results: a null or empty text has the end id alone; null ids come first; rows of equal id are ordered by text;
an empty table writes no shard and gives an empty result. A special token's text in a document is that token, as the
library has it. Other columns, also ones named like the results, are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import dealt_evenly, local_fs, parts_for, put_file, scratch, spread, tidy, written
from .units import valued

MAGIC, BLOCK = b"QWM1", 1 << 19
SHARD_BYTES, END = 16 << 20, 0


def build(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray, nulls: list[int]) -> bytes:
    """The file of a shard. docs: ids of documents (0 where null), lengths: tokens of each."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    a = np.ascontiguousarray(ids.astype(np.uint16 if levels <= 16 else np.uint32))
    parts, blocks, at = [], [], 0

    def add(name: str, data: bytes, ones: int = 0) -> None:
        nonlocal at
        parts.append(pack.compress(data))
        blocks.append([name, at, len(parts[-1]), ones])
        at += len(parts[-1])

    add("docs", np.diff(docs, prepend=np.int64(0)).astype("<i8").tobytes())
    add("lengths", lengths.astype("<i8").tobytes())
    zeros = []
    for level in range(levels - 1, -1, -1):
        after, ones = np.empty_like(a), 0
        total = len(a) - int(np.count_nonzero(a & a.dtype.type(1 << level)))
        for k in range(0, len(a), BLOCK):
            some = a[k : k + BLOCK]
            bits = (some & a.dtype.type(1 << level)) != 0
            add(str(level), np.packbits(bits, bitorder="little").tobytes(), ones)
            one = np.flatnonzero(bits)
            after[total + ones : total + ones + len(one)] = some[one]
            after[k - ones : k - ones + len(some) - len(one)] = some[np.flatnonzero(~bits)]
            ones += len(one)
        a = after
        zeros.append(total)
    head = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "docs": len(docs), "nulls": nulls, "blocks": blocks}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


class Wavelet:
    """A shard's file: tokens by position, counts and places of a token, all by rank and select on compressed blocks."""

    def __init__(self, data) -> None:
        import zstandard

        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a token shard")
        n = struct.unpack("<I", data[4:8])[0]
        h = json.loads(bytes(data[8 : 8 + n]))
        self.data, self.base, self.unpack = data, 8 + n, zstandard.ZstdDecompressor()
        self.n, self.levels, self.zeros = h["n"], h["levels"], h["zeros"]
        self.planes: list[list] = [[] for _ in range(self.levels)]
        for name, at, size, ones in h["blocks"]:
            if name.isdigit():
                self.planes[self.levels - 1 - int(name)].append((at, size, ones))
            elif name == "docs":
                self.docs = np.cumsum(np.frombuffer(self.raw(at, size), "<i8"))
            else:
                self.lengths = np.frombuffer(self.raw(at, size), "<i8")
        self.nulls = set(h["nulls"])
        self.block = lru_cache(maxsize=256)(self._block)

    def raw(self, at: int, size: int) -> bytes:
        return self.unpack.decompress(bytes(self.data[self.base + at : self.base + at + size]))

    def _block(self, level: int, k: int):
        at, size, ones = self.planes[level][k]
        b = np.frombuffer(self.raw(at, size), np.uint8)
        return b, np.concatenate(([0], np.cumsum(np.bitwise_count(b), dtype=np.int64))), ones

    def bit(self, level: int, i: int) -> int:
        b, _, _ = self.block(level, i // BLOCK)
        j = i % BLOCK
        return int(b[j >> 3] >> (j & 7)) & 1

    def ones(self, level: int, i: int) -> int:
        """Ones before place i."""
        if i == 0 or not self.planes[level]:
            return 0
        k = min(i // BLOCK, len(self.planes[level]) - 1)
        b, sums, before = self.block(level, k)
        j = i - k * BLOCK
        return before + int(sums[j >> 3]) + (int(b[j >> 3] & ((1 << (j & 7)) - 1)).bit_count() if j & 7 else 0)

    def access(self, i: int) -> int:
        token = 0
        for level in range(self.levels):
            one = self.bit(level, i)
            r = self.ones(level, i)
            token, i = token << 1 | one, self.zeros[level] + r if one else i - r
        return token

    def span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the token's places in [lo, hi) end up below the last level."""
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self.ones(level, lo), self.ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self.span(token, lo, self.n if hi is None else hi)
        return b - a

    def place(self, level: int, one: int, k: int) -> int:
        """The place of the k-th (from 0) bit `one` of a level."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            r = self.ones(level, mid + 1)
            if (r if one else mid + 1 - r) <= k:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def select(self, token: int, k: int) -> int:
        """The position of the token's k-th occurrence, from 0."""
        a, b = self.span(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            i = self.place(level, one, i - self.zeros[level] if one else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def unrolled(self) -> np.ndarray:
        """All tokens in order."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        x = np.zeros(self.n, kind)  # below the last level all tokens are sorted by their reversed bits; none is known there
        for level in range(self.levels - 1, -1, -1):
            out, z, bit = np.empty_like(x), self.zeros[level], kind(1 << (self.levels - 1 - level))
            for k, (at, size, ones) in enumerate(self.planes[level]):
                a = k * BLOCK
                some = out[a : a + BLOCK]
                bits = np.unpackbits(np.frombuffer(self.raw(at, size), np.uint8), count=len(some), bitorder="little").view(bool)
                one = np.flatnonzero(bits)
                some[one] = x[z + ones : z + ones + len(one)] | bit
                some[np.flatnonzero(~bits)] = x[a - ones : a - ones + len(some) - len(one)]
            x = out
        return x


#: Units of one text for the library, and texts of a call: more of them no longer fit the processor's caches.
JOINED, CALLED = 200, 8


class Encoder:
    """Ids of units by the tokenizers library. Units go to it many in one text, with line ends between them; those that have
    white space at an end (but for one space before) or beside a line end go each for itself, as do special tokens, which the
    library tells from text wherever they stand in it. A line end without white space beside it is one id of its own."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        tokens = self.t.get_added_tokens_decoder().values()
        if any(x.lstrip or x.rstrip or x.single_word for x in tokens):
            raise ValueError("added tokens that take spaces with them, or stand as words alone, are not supported")
        self.special = tuple(sorted(x.content for x in tokens))
        (self.line_end,) = self.t.encode("\n", add_special_tokens=False).ids

    def joinable(self, unit: str) -> bool:
        t = unit[1:] if unit[:1] == " " else unit
        return unit not in self.special and all(x and not x[0].isspace() and not x[-1].isspace() for x in (t.split("\n") if "\n" in t else (t,)))

    def __call__(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, where each unit's end)."""
        texts = [u.decode() for u in units]
        fit = np.fromiter(map(self.joinable, texts), bool, len(texts))
        sizes = np.zeros(len(texts), np.int64)
        found = [np.zeros(0, np.uint32)]  # ids of the joined units, then of the others
        together, alone = np.flatnonzero(fit), np.flatnonzero(~fit)
        lines = np.fromiter((t.count("\n") for t in texts), np.int64, len(texts))
        for a in range(0, len(together), JOINED * CALLED):
            some = [together[k : k + JOINED] for k in range(a, min(a + JOINED * CALLED, len(together)), JOINED)]
            for group, e in zip(some, self.t.encode_batch_fast(["\n".join([texts[k] for k in g.tolist()]) for g in some], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                at, last = np.append(np.flatnonzero(ids == self.line_end), len(ids)), np.cumsum(lines[group] + 1) - 1
                if len(at) != last[-1] + 1:
                    raise ValueError("units ran together")
                ends = at[last]
                sizes[group] = np.diff(ends, prepend=-1) - 1
                found.append(np.delete(ids, ends[:-1]))
        for a in range(0, len(alone), 2000):
            some = alone[a : a + 2000]
            for k, e in zip(some.tolist(), self.t.encode_batch_fast([texts[k] for k in some.tolist()], add_special_tokens=False)):
                sizes[k] = len(e.ids)
                found.append(np.array(e.ids, np.uint32))
        order = np.concatenate((together, alone))
        begins = np.empty(len(texts), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(found)[spread(begins, sizes)], np.cumsum(sizes)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shards(docs: DataFrame, path: str, pattern: str, folder: str) -> DataFrame:
    """Encodes and writes all documents in ascending doc_id order; one row per shard: part, shard, path, tokens."""

    def finish(chunks):
        for chunk in chunks:
            part, shard = (int(x) for x in chunk.name.split("-")[1:3])
            parts, lengths = [], []
            for _, ids, counts in chunk.slices():
                flat = np.full(len(ids) + len(counts), END, np.uint32)
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                parts.append(flat)
                lengths.append(counts + 1)
            flat = np.concatenate(parts)
            file = f"{folder}/shard-{part:06d}-{shard:05d}.qwm"
            doc = chunk.docs
            put_file(file, build(flat, doc.fill_null(0).to_numpy(), np.concatenate(lengths), np.flatnonzero(doc.is_null().to_numpy(zero_copy_only=False)).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([shard]), pa.array([file]), pa.array([len(flat)])], names=["part", "shard", "path", "tokens"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, _ = parts_for(d)
    ordered = d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(valued(ordered, f"{folder}-units", pattern, lambda: encoder(path), finish, "part long, shard long, path string, tokens long", SHARD_BYTES, encoder(path).special), "op7-list")


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    placed = with_starts(shards)

    def run(batches):
        for b in batches:
            for file, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                m = opened(file)
                flat = m.unrolled().astype("<u4")
                ends = np.cumsum(m.lengths)
                if (int(ends[-1]) if len(ends) else 0) != m.n:
                    raise ValueError(f"{file}: lengths don't add up")
                begins = ends - m.lengths
                view = memoryview(flat.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist())]
                docs = [None if k in m.nulls else x for k, x in enumerate(m.docs.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(m.lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt_evenly(placed).mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def opened(file: str) -> Wavelet:
    fs, at = local_fs(file)
    with fs.open_input_stream(at, compression=None) as f:
        return Wavelet(memoryview(f.read()))


#: Positions that one key of the join of positions and shards stands for.
BIN = 1 << 22


def with_starts(shards: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all shards before. The window orders one row per shard."""
    w = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(w), F.lit(0)))


def tokens_at(shards: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, token) of global positions (position long), from the shards' files; null outside of the corpus. A shard is
    joined by the bins of positions that it reaches into, so no position meets more than a few shards."""
    s = with_starts(shards).withColumn("bin", F.explode(F.sequence(F.expr(f"start div {BIN}"), F.expr(f"(start + tokens - 1) div {BIN}"))))
    p = positions.select(F.col("position").cast("long").alias("position")).withColumn("bin", F.expr(f"position div {BIN}"))
    met = p.join(s, "bin").where("position >= start and position < start + tokens").select("path", "start", "position")

    def run(batches):
        name, m = None, None
        for b in batches:
            out = []
            for path, start, at in zip(*(b.column(c).to_pylist() for c in ("path", "start", "position"))):
                if path != name:
                    name, m = path, opened(path)
                out.append(m.access(at - start))
            yield pa.RecordBatch.from_arrays([b.column("position"), pa.array(out, pa.int64())], names=["position", "token"])

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.repartition(n, "path", F.expr(f"position div {BIN >> 4}")).sortWithinPartitions("path", "position").mapInArrow(tidy(run), "position long, token long").distinct()
    return positions.select(F.col("position").cast("long").alias("position")).join(found, "position", "left")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of the tokens stands in the corpus, by rank on the bit-planes of each shard."""
    tokens = sorted({int(t) for t in tokens})

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                m = opened(path)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([m.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    found = dealt_evenly(shards).mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    every = shards.sparkSession.createDataFrame([(t,) for t in tokens], "token long")
    return every.join(found, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def token_places(shards: DataFrame, tokens: list[int], block: int = 10_000) -> DataFrame:
    """(token, position) of all occurrences, by select on the bit-planes of each shard."""

    def run(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                m = opened(path)
                for t in sorted(set(tokens)):
                    for a in range(0, n := m.count(t), block):
                        at = [start + m.select(t, k) for k in range(a, min(a + block, n))]
                        yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.int64()), pa.array(at, pa.int64())], names=["token", "position"])

    return dealt_evenly(with_starts(shards)).mapInArrow(tidy(run), "token long, position long")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return read_shards(write_shards(docs, path, pattern, scratch(docs.sparkSession, "op7-shards")))
