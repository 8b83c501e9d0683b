"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most RADIUS bits have a variant in common that differs from each in at most RADIUS / 2.
Every distinct fingerprint is therefore dealt to all its variants within RADIUS / 2. The shuffle is on the leading bits of
the variants: variants of one fingerprint that share them travel as one row (137 rows at 16 bits, 277 at 23, instead of 2,081), and
the task that gets a prefix forms the remaining bits of its variants there. Fingerprints that meet in a variant are
verified and linked to the smallest of them, never all with all; each task hands on a spanning forest of its links. There
are more leading bits for more fingerprints, so a prefix has about as many in any corpus; of one that still has many (near
copies share it) the task takes the next bits in turn.

Defined results: documents without words (null, empty, only white space) have fingerprint 0 and are linked as any other;
fewer words than a shingle are one shingle; null ids belong to components, but a component's id is its smallest id that
is not null; repeated rows are of one component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import PART_BYTES, pieces, text_bytes, tidy, with_spaces, words_in, written
from .components import components, forest

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fewest leading bits that variants travel by, and fingerprints for each value of them that make it more.
PREFIX_BITS, PREFIX_ROWS = 16, 256


def fingerprints(raws: list[bytes], width: int = SHINGLE, block: int = 1 << 16) -> np.ndarray:
    """Unsigned 64-bit fingerprints of texts. Hashes are made and counted a block at a time."""
    import xxhash

    h = xxhash.xxh64_intdigest
    out = np.zeros(len(raws), np.uint64)
    x, starts, sizes, counts = words_in([r.lower() for r in raws])
    text, stop = with_spaces(x, starts, sizes)
    starts = stop - sizes
    owners = np.flatnonzero(counts)
    if not len(owners):
        return out
    words = counts[owners]
    n = np.maximum(words - width + 1, 1)
    last = np.cumsum(words)
    doc = np.repeat(np.arange(len(n)), n)
    word = np.arange(len(doc)) + np.repeat((last - words) - (np.cumsum(n) - n), n)
    a_all, z_all = starts[word], stop[np.minimum(word + width - 1, np.repeat(last - 1, n))]
    ones = np.zeros((len(n), 64), np.int64)
    for k in range(0, len(doc), block):
        flat = np.fromiter((h(text[a:z], SEED) for a, z in zip(a_all[k : k + block].tolist(), z_all[k : k + block].tolist())), np.uint64)
        bits = np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        d = doc[k : k + block]
        first = np.flatnonzero(np.diff(d, prepend=-1))
        ones[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    out[owners] = np.packbits(2 * ones > n[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return out


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def fingerprinted(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, th (a hash of the text as it is), fp (as a signed long)."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fingerprints(text_bytes(b.column("text")), width).view(np.int64))], names=["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, th long, fp long")


def flips(bits: int, most: int) -> list[np.ndarray]:
    """Masks of exactly 0, 1, ... `most` set bits among the lowest `bits`."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, np.uint64), one]
    if most >= 2:
        a, b = np.triu_indices(bits, 1)
        out.append(one[a] | one[b])
    if most > 2:
        raise ValueError("half the radius is at most 2")
    return out[: most + 1]


def dealt(fps: DataFrame, bits: int, half: int) -> DataFrame:
    """(prefix, fp): each fingerprint once for every prefix that its variants have."""
    masks = np.concatenate(flips(bits, half))

    def run(batches):
        for b in batches:
            f = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for a in range(0, len(f), 2000):
                g = f[a : a + 2000]
                p = ((g >> np.uint64(64 - bits))[:, None] ^ masks).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(np.repeat(g, len(masks)).view(np.int64))], names=["prefix", "fp"])

    return fps.mapInArrow(tidy(run), "prefix long, fp long")


def variants(prefix: np.ndarray, fp: np.ndarray, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(variant, index of its fingerprint) of all variants that have the prefix."""
    low = 64 - bits
    used = np.bitwise_count(prefix ^ (fp >> np.uint64(low)))
    base = prefix << np.uint64(low) | fp & np.uint64((1 << low) - 1)
    out, of = [], []
    for u in range(half + 1):
        k = np.flatnonzero(used == u)
        if len(k):
            masks = np.concatenate(flips(low, half - u))
            out.append((base[k][:, None] ^ masks).reshape(-1))
            of.append(np.repeat(k, len(masks)))
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def met(prefix: np.ndarray, fp: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among fingerprints that meet in a variant: each to the smallest in that variant."""
    v, of = variants(prefix, fp, bits, radius // 2)
    order = np.argsort(v)
    v = v[order]
    same = v[1:] == v[:-1]
    if not same.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    in_run = np.zeros(len(v), bool)
    in_run[1:] |= same
    in_run[:-1] |= same
    v, f = v[in_run], fp[of[order[in_run]]]
    begin = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    least = np.repeat(np.minimum.reduceat(f, begin), np.diff(np.append(begin, len(f))))
    ok = (f != least) & (np.bitwise_count(f ^ least) <= radius)
    return f[ok], least[ok]


def linked(fps: DataFrame, radius: int = RADIUS, bits: int = PREFIX_BITS, rows: int = 6000, count: int = 0) -> DataFrame:
    """Links (a, b) between distinct fingerprints, of which every component keeps enough to stay connected. A task reads
    its prefixes in order and takes about `rows` fingerprints at a time; of a prefix that has more it takes the next
    bits in turn, so its memory doesn't grow with the prefix's variants. `count` fingerprints make more partitions, if the
    session has too few for them."""
    half = radius // 2

    def links(p, f, b):
        if len(f) <= rows or b >= 48:
            yield met(p, f, b, radius)
            return
        if (p[0] == p).all():  # one prefix: the same again by the next 4 bits
            far = np.bitwise_count(p ^ (f >> np.uint64(64 - b)))
            for nxt in range(16):
                q = p[0] << np.uint64(4) | np.uint64(nxt)
                near = far + np.bitwise_count((f >> np.uint64(60 - b)) & np.uint64(15) ^ np.uint64(nxt)) <= half
                if near.sum() > 1:
                    yield from links(np.full(int(near.sum()), q, np.uint64), f[near], b + 4)
            return
        cut = np.flatnonzero(np.diff(p.astype(np.int64))) + 1
        start, size = 0, 0
        edges = [0, *cut.tolist(), len(p)]
        for a, z in zip(edges, edges[1:]):
            if z - start > rows and a > start:
                yield from links(p[start:a], f[start:a], b)
                start = a
        yield from links(p[start:], f[start:], b)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of one prefix, which may go on
        a_all, b_all = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def take(some):
            nonlocal a_all, b_all
            p, f = (np.concatenate(x) for x in zip(*some))
            for a, b in links(p.astype(np.uint64), f.view(np.uint64), bits):
                if len(a):
                    a_all, b_all = forest(np.concatenate((a_all, a.view(np.int64))), np.concatenate((b_all, b.view(np.int64))))

        for batch in batches:
            if not batch.num_rows:
                continue
            p = batch.column("prefix").to_numpy(zero_copy_only=False).astype(np.int64)
            f = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            cut = int(np.searchsorted(p, p[-1]))
            if held and p[-1] != held[-1][0][-1]:
                take([*held, (p[:cut], f[:cut])])
                held = []
            elif cut:
                take([(p[:cut], f[:cut])])
            held.append((p[cut:], f[cut:]))
        if held:
            take(held)
        if len(a_all):
            yield pa.RecordBatch.from_arrays([pa.array(a_all), pa.array(b_all)], names=["a", "b"])

    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), count * (1 + bits + bits * (bits - 1) // 2) * 16 // PART_BYTES)
    return dealt(fps, bits, half).repartition(n, "prefix").sortWithinPartitions("prefix").mapInArrow(tidy(run), "a long, b long")


def prefix_bits(n: int) -> int:
    return max(PREFIX_BITS, min(32, (n // PREFIX_ROWS).bit_length()))


def clustered(prints: DataFrame, radius: int = RADIUS, bits: int | None = None) -> DataFrame:
    """(f, root, component_id) of every distinct fingerprint f in (doc_id, fp). Components without an id have none, and
    two may have the same where an id is repeated, so only the root tells them apart."""
    rep = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "op5-prints")
    n = rep.count()
    links = linked(rep.select("fp"), radius, prefix_bits(n) if bits is None else bits, count=n)
    roots = components(written(links, "op5-links"), "op5")
    at = written(rep.join(roots, rep["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "op5-roots")
    ids = at.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    return written(at.join(ids, at["root"] == ids["r"]).select(F.col("fp").alias("f"), "root", "component_id"), "op5-components")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bits: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    prints = written(fingerprinted(docs), "op5-docs")
    c = clustered(prints, radius, bits)
    return prints.join(c, prints["fp"] == c["f"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS, bits: int | None = None) -> DataFrame:
    """One document of each component: that of the smallest id that is not null, of several texts under that id (or
    without one) that of the smallest hash, once if it is repeated."""
    names = docs.columns
    prints = written(fingerprinted(docs), "op5-docs")
    c = clustered(prints, radius, bits)
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    first = prints.join(c, prints["fp"] == c["f"]).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id").agg(F.min("th").alias("__t"))
    keep = written(first.select(key.alias("__k"), "__t"), "op5-kept")
    # an id and a text are of one component, so the keys of the join also tell repeated rows: those of a task go before texts
    # are shuffled, once
    own = docs.withColumn("__key", key).withColumn("__th", text_hash()).dropDuplicates(["__key", "__th"])
    return own.join(keep, (F.col("__key") == F.col("__k")) & (F.col("__th") == F.col("__t"))).select(*names)
