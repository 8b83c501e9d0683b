"""WARC archives in Zstandard, with a shared dictionary.

A shard is one file: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame for each record. The
reader streams a shard, loads the dictionary from the leading frame, decodes frame by frame and checks each record:
version line, required headers, length against Content-Length, digests and the closing line ends.

Defined results: a null html is an empty payload; a null url is written as an empty target; payloads under 100 bytes are
always responses; of equal longer payloads the record with the smallest page_id is the response (rows that repeat that
id and payload are responses too), the others revisit it; null ids come last, and a group without any id has no
revisits. An empty table writes no shard and gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_ROWS, dealt_evenly, local_fs, pieces, put_file, scratch, text_bytes, tidy, written

MAGIC, LEVEL = 0x184D2A5D, 3
DICT_BYTES, DICT_ROWS, SHARD_BYTES, MIN_REVISIT = 64 << 10, 600, 128 << 20, 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def dictionary(pages: DataFrame, rows: int = DICT_ROWS) -> bytes:
    """Trained on at most `rows` pages, the first 32 KB of each; empty if there is too little to train on."""
    import zstandard

    sample = [r[0].encode()[: 32 << 10] for r in pages.select(F.substring(F.col("html").cast("string"), 1, 32 << 10)).where("html is not null").limit(rows).collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, [x for x in sample if len(x) > 8]).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(page_id, url: str | None, html: bytes, refers_to) -> bytes:
    clean = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + html
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(html).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def shard(records, words: bytes):
    """The parts of a shard's file."""
    import zstandard

    if words:
        yield struct.pack("<II", MAGIC, len(words)) + words
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True, write_content_size=True)
    for r in records:
        yield pack.compress(r)


def frames(read, chunk: int = 1 << 20):
    """The content of each frame. `read(n)` gives the next bytes of the file."""
    import zstandard

    rest = read(chunk)
    while 0 < len(rest) < 8 and (more := read(chunk)):
        rest += more
    words = None
    if len(rest) >= 8 and struct.unpack("<I", rest[:4])[0] == MAGIC:
        n = struct.unpack("<I", rest[4:8])[0]
        while len(rest) < 8 + n and (more := read(chunk)):
            rest += more
        if len(rest) < 8 + n:
            raise ValueError("the dictionary's frame is cut short")
        raw, rest = rest[8 : 8 + n], rest[8 + n :]
        if raw[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        words = zstandard.ZstdCompressionDict(raw)
    unpack = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    while rest or (rest := read(chunk)):
        one, out = unpack.decompressobj(), []
        while True:
            out.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            if not (rest := read(chunk)):
                raise ValueError("a frame is cut short")
        yield b"".join(out)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and block; raises if it isn't one whole valid record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line or no end of headers")
    h = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]}")
        h[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ValueError(f"without {name}")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, the frame has {len(rest) - 4}")
    block = rest[:n]
    if "warc-block-digest" in h and h["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("the block's digest is wrong")
    return h, block


def number(urn: str | None) -> int | None:
    x = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x else None


def page(data: bytes, payload: bool = False) -> tuple:
    h, block = parsed(data)
    _, sep, body = block.partition(b"\r\n\r\n")
    kind = h["warc-type"]
    if not sep or kind not in ("response", "revisit"):
        raise ValueError("not an HTTP response or revisit")
    digest = h["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError("the payload's digest is wrong")
    out = (number(h["warc-record-id"]), h.get("warc-target-uri"), kind, number(h.get("warc-refers-to")), len(body) if kind == "response" else None, digest)
    return (*out, body if kind == "response" else None) if payload else out


def typed(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """page_id, url, html and refers_to, null for responses. Digests that repeat are broadcast if they are few; else pages
    are shuffled by digest, those of frequent digests dealt to `salts` tasks each and those without one by their id."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("d", F.when(F.octet_length("html") >= MIN_REVISIT, F.unhex(F.sha2("html", 256))))
    first = written(p.where("d is not null").groupBy(F.col("d").alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"), "op3-first")
    if first.limit(broadcast_rows + 1).count() <= broadcast_rows:
        out = p.join(F.broadcast(first), p["d"] == first["digest"], "left")
    else:
        # as many hot digests as there are partitions at most, so they may be broadcast
        least = F.lit(pages.count() / int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        hot = F.broadcast(first.where(F.col("n") > least).select(F.col("digest").alias("h")))
        own = F.xxhash64("page_id", "url")
        p = p.join(hot, p["d"] == hot["h"], "left").withColumn("salt", F.when(F.col("d").isNull(), own).when(F.col("h").isNotNull(), F.pmod(own, F.lit(salts))).otherwise(F.lit(0)))
        first = first.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > least, salts - 1).otherwise(0).cast("long"))))
        out = p.join(first, (F.coalesce("d", F.lit(b"")) == first["digest"]) & (p["salt"] == first["s"]), "left")
    return out.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, words: bytes, folder: str) -> DataFrame:
    """Writes shards of page_id, url, html, refers_to under `folder`; one row per shard: path, records, bytes."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        done, held, size = [], [], 0

        def flush():
            nonlocal held, size
            if held:
                path = f"{folder}/part-{task.partitionId():06d}-{len(done):04d}.warc.zst"
                parts = b"".join(shard(held, words))
                put_file(path, parts)
                done.append((path, len(held), len(parts)))
                held, size = [], 0

        for batch in batches:
            for b in pieces(batch, column="html"):
                for i, u, h, r in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), text_bytes(b.column("html")), b.column("refers_to").to_pylist()):
                    held.append(record(i, u, h, r))
                    size += len(held[-1])
                    if size >= SHARD_BYTES // 4:
                        flush()
        flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    return written(rows.mapInArrow(tidy(run), "path string, records long, bytes long"), "op3-shards")


def read_archives(shards: DataFrame, payload: bool = False) -> DataFrame:
    """All records of the archives in `path`, with the payload if asked for. Archives are dealt in turn to a bounded number of tasks."""

    def run(batches):
        names = [x.split()[0] for x in RECORD.split(", ")] + ["html"] * payload
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for path, records in zip(b.column("path").to_pylist(), b.column("records").to_pylist()):
                fs, at = local_fs(path)
                with fs.open_input_stream(at, compression=None) as f:
                    n, size, rows = 0, 0, []
                    for data in frames(f.read):
                        rows.append(page(data, payload))
                        n, size = n + 1, size + (len(data) if payload else 200)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
                            size, rows = 0, []
                    if n != records:
                        raise ValueError(f"{path} has {n} records, {records} were written")
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    return dealt_evenly(shards).mapInArrow(tidy(run), RECORD + (", html binary" if payload else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives, reads them back and resolves revisits; one row per page."""
    spark = pages.sparkSession
    shards = write_archives(typed(pages), dictionary(pages), scratch(spark, "op3-warc"))
    rows = written(read_archives(shards), "op3-records")
    full = rows.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("to"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("b"))
    back = rows.where("record_type = 'revisit'").join(full, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("d")), "left")
    back = back.withColumn("payload_bytes", F.when(F.col("b").isNull(), F.raise_error(F.lit("a revisit's response is missing"))).otherwise(F.col("b")))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.where("record_type = 'response'").select(*names).unionByName(back.select(*names))
