"""What the operators share: shared scratch tables, words, running sums over a global order."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word, as bytes.split() without arguments cuts them.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: The same words for Spark's regexp functions.
WORD_JVM = r"[^\x20\x09-\x0D]+"
#: A broadcast is only asked for below so many rows of a materialised table with rows of at most 200 bytes.
BROADCAST_ROWS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Where that is unset a session of one machine gets
    a folder of it; any other is refused, as its executors would write each to a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)  # with its scheme, so that Python and Spark mean one folder
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{whole.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, and lost executors take nothing with them."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the (materialised) rows are few, else the frame as it is, which then joins by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def drawn(df: DataFrame, key: str, id_: str, rows: int) -> DataFrame:
    """About 1.5 * rows rows of each key, or all of a key that has no more, by a hash of the id: a filter with the keys'
    counts at hand, so that no task gathers a key's rows."""
    counts = small(written(df.groupBy(key).agg(F.count("*").alias("__n")).withColumnRenamed(key, "__k"), "counts"))
    share = F.shiftrightunsigned(F.xxhash64(F.lit(77), F.col(id_)), 11) / F.lit(float(1 << 53))
    return df.join(counts, F.col(key) == F.col("__k")).where(share * F.col("__n") < 1.5 * rows).drop("__k", "__n")


def first_of_each(rows: list, key: str, id_: str, most: int) -> list:
    """At most `most` of the collected rows for each key, in an order that only depends on ids."""
    import xxhash

    out, seen = [], {}
    for r in sorted(rows, key=lambda r: (xxhash.xxh64_intdigest(str(r[id_]), 5), str(r[id_]))):
        seen[r[key]] = n = seen.get(r[key], 0) + 1
        if n <= most:
            out.append(r)
    return out


def local_fs(uri: str):
    """pyarrow's file system for a folder's URI, and its path there. A bare path is a local one."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def put_file(uri: str, data) -> None:
    """Writes a whole file under another name, then renames it, so that a lost or repeated task leaves no half file."""
    fs, path = local_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    try:
        fs.move(part, path)
    except OSError:  # some stores don't replace a file; the one there is of an earlier attempt, with the same bytes
        if fs.get_file_info(path).type.name != "File":
            raise
        fs.delete_file(part)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, most: int = 8 << 20, column: str = "text"):
    """The batch in slices of about `most` bytes of text: what a task holds then doesn't depend on rows per batch."""
    if not batch.num_rows:
        return
    sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    at = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


#: Bytes of a table that one partition of an exchange may take.
PART_BYTES = 32 << 20


def parts_for(df: DataFrame) -> tuple[int, int]:
    """Partitions for the exchanges of an operator that sends about as much as it reads: those of the session, more if the
    tables that `df` reads are large (by their files' sizes); and twice as many for rows that are few but heavy."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(x for x in sizes if x < 1 << 60) // PART_BYTES)
    return n, 2 * n


def dealt_evenly(files: DataFrame) -> DataFrame:
    """A (materialised) table with a row for each of many files of about one size, dealt in turn to a bounded number of
    partitions. The rows pass one task on their way; the files don't."""
    n = 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.coalesce(1).repartition(max(1, min(n, files.count())))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has the session hand rows to Python workers so many at a time, if it isn't told otherwise: a batch of whole texts then
    stays small on both sides. For programs that own their session; operators don't change it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(run):
    """A task's function that gives freed memory back at its end: workers stay for later tasks, of other operators too."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all elements of runs: starts[0], starts[0] + 1, ... for sizes[0], and so on."""
    stops = np.cumsum(sizes)
    return np.repeat(starts - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)


MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def keys(buf: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each run of bytes: mixed from them up to 16, else a hash."""
    import xxhash

    at = np.ndarray((len(buf) + 9,), "<u8", buf + bytes(16), strides=(1,))
    low = at[starts] & MASK[np.minimum(sizes, 8)]
    high = at[starts + 8] & MASK[np.clip(sizes - 8, 0, 8)]
    n = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one = mix64(low ^ mix64(high + n))
    two = mix64((high ^ np.uint64(0xD1342543DE82EF95)) + mix64(low + n + np.uint64(1)))
    long = np.flatnonzero(sizes > 16)
    if len(long):
        h = [xxhash.xxh3_128_intdigest(buf[a : a + k]) for a, k in zip(starts[long].tolist(), sizes[long].tolist())]
        one[long] = np.array([v & (1 << 64) - 1 for v in h], np.uint64)
        two[long] = np.array([v >> 64 for v in h], np.uint64)
    return one, two


def words_in(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where each word starts, its size, number of words of each text)."""
    x = np.frombuffer(b"".join(raws), np.uint8)
    n = np.fromiter(map(len, raws), np.int64, len(raws))
    stops = np.cumsum(n)
    blank = BLANK[x]
    first = ~blank
    first[1:] &= blank[:-1]
    begins = (stops - n)[n > 0]
    first[begins] = ~blank[begins]
    starts = np.flatnonzero(first)
    sizes = np.add.reduceat(~blank, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    return x, starts, sizes, np.searchsorted(starts, stops) - np.searchsorted(starts, stops - n)


def with_spaces(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, block: int = 1 << 17) -> tuple[bytes, np.ndarray]:
    """(the words, one space behind each; where each word ends)."""
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    for k in range(0, len(starts), block):
        a, n = starts[k : k + block], sizes[k : k + block]
        out[spread(ends[k : k + block] - n, n)] = x[spread(a, n)]
    return out.tobytes(), ends


def paired(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix64((a ^ np.uint64(salt)) * np.uint64(0xD1342543DE82EF95) + b)


def runs(words: np.ndarray, width: int, salt: int = 0, block: int = 1 << 16) -> np.ndarray:
    """Hashes of every run of `width` hashed words: of runs of 1, 2, 4, ... from those half as long, and of these put
    together. A block at a time, so that no more than the result is as long as the words."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for at in range(0, n, block):
        h, size, done, got = words[at : at + block + width - 1], 1, 0, None
        while True:
            if width & size:
                got = h if got is None else paired(got[: len(h) - done], h[done:], salt)
                done += size
            if 2 * size > width:
                break
            h, size = paired(h[:-size], h[size:], salt), 2 * size
        out[at : at + block] = got[: min(block, n - at)]
    return out


def running(df: DataFrame, order: list[str], value: str, tag: str, by: str | None = None) -> DataFrame:
    """Adds `before`, the sum of `value` in all rows that come earlier in the global order (and have the same `by`, which
    must then lead the order), and `part`, the partition. One shuffle by range; sums within partitions; then one row per
    partition (and `by`) is summed up and joined back. No task sees more than its own range."""
    spark = df.sparkSession
    kept = [f.name for f in df.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", part long, inside long"

    def sums(batches):
        from pyspark import TaskContext

        part, total, last = TaskContext.get().partitionId(), 0, object()
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            c = np.cumsum(v) - v
            if by is None:
                inside, total = c + total, total + int(v.sum())
            else:
                keys = b.column(by).to_pylist()
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                inside = np.empty(len(keys), np.int64)
                for a, z in zip(cuts, cuts[1:]):
                    if keys[a] != last:
                        total, last = 0, keys[a]
                    inside[a:z] = c[a:z] - c[a] + total
                    total += int(v[a:z].sum())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(np.full(b.num_rows, part, np.int64)), pa.array(inside)], names=[*kept, "part", "inside"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(sums, schema)
    table = written(ranged, tag)
    keys = [by] if by else []
    totals = table.groupBy(*keys, "part").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("total"))
    from pyspark.sql import Window

    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.withColumn("shift", F.coalesce(F.sum("total").over(w), F.lit(0))).drop("total")
    shift = small(written(shift, f"{tag}-shift"))
    on = [table["part"] == shift["part"], *([table[by].eqNullSafe(shift[by])] if by else [])]
    return table.join(shift, on).select(*(table[k] for k in kept), table["part"], (table["inside"] + shift["shift"]).alias("before"))
