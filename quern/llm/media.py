"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of structs (position, kind, text, ref, caption): text runs and media references in
the order in which they stand. A media struct refers to its payload by digest. Payloads are stored once per task and
digest as lossless 8-bit grey images; a join on the digest resolves references, and what it carries is computed on the
payload side first, so payload bytes stay out of the shuffle. Positions and captions travel with the reference, so they
stay aligned whatever the join does to the order, and `assembled` puts each sequence's media together again.

The query makes a page of every document: its lines are paragraphs, between a figure with the document's payload and the
same image once more at the end.

Defined results: a null html gives an empty sequence, a null or empty text a payload of one unit and a page without text
runs; a reference without a stored payload keeps its struct with null results; repeated rows give repeated results;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces, scratch, small, text_bytes, tidy, written

UNIT = 576
ITEM = "struct<pos int, kind string, text string, ref string, caption string>"
INFO = "digest binary, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"
MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": None, "embed": "object", "object": "object"}
BLOCK = {"p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "table", "article", "section", "blockquote", "pre", "header", "footer", "nav", "hr", "title"}


class Sequence(HTMLParser):
    """Ordered text runs and media references. A figcaption is the caption of its figure's media, else the alt text is."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figures: list[dict] = []

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figure":
            self.flush()
            self.figures.append({"from": len(self.items), "caption": None, "run": None})
        elif tag == "figcaption" and self.figures:
            self.flush()
            self.figures[-1]["run"] = True
        elif tag in MEDIA and (src := a.get("src") or a.get("data")):
            self.flush()
            self.items.append({"kind": MEDIA[tag] or "media", "text": None, "ref": reference(src), "caption": a.get("alt") or a.get("title")})
        elif tag in BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.figures and self.figures[-1]["run"]:
            self.figures[-1].update(caption=" ".join("".join(self.run).split()) or None, run=None)
            self.run = []
        elif tag == "figure" and self.figures:
            self.flush()
            f = self.figures.pop()
            for x in self.items[f["from"] :]:
                if x["kind"] != "text" and f["caption"]:
                    x["caption"] = f["caption"]
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.run.append(data)


def reference(src: str) -> str:
    """The digest in a content address, else the SHA-256 of the address."""
    return src[7:].lower() if src.startswith("sha256:") else hashlib.sha256(src.strip().encode("utf-8", "surrogatepass")).hexdigest()


def parse(html: str | None) -> list[dict]:
    if not html:
        return []
    p = Sequence()
    p.feed(html)
    p.close()
    p.flush()
    return [{"pos": i, **x} for i, x in enumerate(p.items)]


def sequences(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("doc_id",), made: Callable[[bytes], str] | None = None) -> DataFrame:
    """The kept columns and `items`, the ordered structs of each row's html. With `made` the column holds what the html is
    made from."""
    types = dict(df.select(*keep).dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), f"items array<{ITEM}>"])
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches):
        for batch in batches:
            for b in pieces(batch, column="__html"):
                pages = b.column("__html").to_pylist() if made is None else map(made, text_bytes(b.column("__html")))
                items = [parse(x) for x in pages]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(items, kind)], names=[*keep, "items"])

    return df.select(*keep, F.col(html).cast("string").alias("__html")).mapInArrow(tidy(run), schema)


def png(payload: bytes) -> bytes:
    """The payload as an 8-bit grey image, one unit of 576 samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    raw = np.zeros((len(rows), UNIT + 1), np.uint8)
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The samples of such an image; raises if a chunk's checksum, its size or its filters are wrong."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if len(body) != n or struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if shape is None or shape[2:] != (8, 0, 0, 0, 0) or raw.size != shape[1] * (shape[0] + 1):
        raise ValueError("PNG of another kind or size")
    raw = raw.reshape(shape[1], shape[0] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:]


def payload(text: bytes) -> bytes:
    """The text's bytes, filled with bytes 255 up to a positive multiple of the unit."""
    return text + b"\xff" * ((-len(text)) % UNIT or (0 if text else UNIT))


def features(x: np.ndarray) -> str:
    """Height, mean, deviation and an 8 x 8 average hash of the samples, in integer arithmetic, so equal for equal samples."""
    flat = x.reshape(-1)
    hist = np.bincount(flat, minlength=256)
    n, v = flat.size, np.arange(256)
    total, squares = int((hist * v).sum()), int((hist * v * v).sum())
    mean, variance = total / n, max(0.0, squares / n - (total / n) ** 2)
    edges = np.arange(64) * n // 64
    sums = np.add.reduceat(flat, edges, dtype=np.int64)
    bits = sums * n > total * np.diff(np.append(edges, n))
    return f"{x.shape[0]}x{x.shape[1]};mean={mean:.4f};sd={variance ** 0.5:.4f};ahash={int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}"


def page(text: bytes) -> str:
    """A document's lines as paragraphs, behind a figure with its payload and before the same image again."""
    full = payload(text)
    src = f"sha256:{hashlib.sha256(full).hexdigest()}"
    paragraphs = "".join(f"<p>{escape(x, quote=False)}</p>" for x in text.decode().split("\n"))
    return f'<article><figure><img src="{src}" width="{UNIT}" height="{len(full) // UNIT}"><figcaption>{len(text)} bytes</figcaption></figure>{paragraphs}<img src="{src}" alt="the same"></article>'


def stored(docs: DataFrame, path: str) -> DataFrame:
    """Writes (digest, media) to `path`: the image of each text's payload, left out if the same task has stored it before."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for b in pieces(batch):
                digests, media = [], []
                for text in text_bytes(b.column("text")):
                    full = payload(text)
                    d = hashlib.sha256(full).digest()
                    if d not in seen:
                        digests.append(d)
                        media.append(png(full))
                        if len(seen) < 500_000:
                            seen.add(d)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(media, pa.binary())], names=["digest", "media"])

    schema = "digest binary, media binary"
    docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def described(store: DataFrame) -> DataFrame:
    """One row per digest with what is read back from its stored bytes."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch, column="media"):
                out = []
                for digest, m in zip(b.column("digest").to_pylist(), b.column("media").to_pylist()):
                    x = samples(m)
                    raw = x.tobytes()
                    if (sha := hashlib.sha256(raw).digest()) != digest:
                        raise ValueError(f"payload {digest.hex()} reads back as {sha.hex()}")
                    out.append((sha, len(raw), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).digest(), features(x)))
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in INFO.split(", ")])

    return store.mapInArrow(tidy(run), INFO).dropDuplicates(["digest"])


def references(seqs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per media struct: kept columns, pos, kind, caption, ref (binary)."""
    return seqs.select(*keep, F.explode("items").alias("i")).where("i.ref is not null").select(*keep, F.col("i.pos").alias("pos"), F.col("i.kind").alias("kind"), F.col("i.caption").alias("caption"), F.unhex("i.ref").alias("ref"))


def resolved(refs: DataFrame, payloads: DataFrame) -> DataFrame:
    """References with the columns of `payloads` (one row per digest); those that have none keep nulls."""
    return refs.join(payloads, refs["ref"] == payloads["digest"], "left").drop(payloads["digest"])


def assembled(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Resolved references of one sequence again as an array in order of position. `keys` tell the sequences apart; other
    columns of a sequence are the same in all of its rows."""
    rest = [c for c in rows.columns if c not in (*keys, *columns, "pos", "kind", "caption", "ref")]
    return rows.groupBy(*keys).agg(*(F.first(c).alias(c) for c in rest), F.sort_array(F.collect_list(F.struct("pos", "kind", "caption", "ref", *columns))).alias("media"))


def media_columns(docs: DataFrame) -> DataFrame:
    """Each document's page parsed, its payload stored, its references resolved and put together; one row per row of
    `docs`, also with the number of text runs and the SHA-256 of these joined by line ends. Rows are told apart by their
    place in `docs`, which must be the same if a task is repeated, as it is in a table."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    info = written(described(stored(d, scratch(docs.sparkSession, "op1-store"))), "op1-info")
    seqs = sequences(d.withColumn("n_bytes", F.octet_length("text").cast("long")), "text", ("row", "doc_id", "n_bytes"), page)
    runs = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"])
    seqs = seqs.select("row", "doc_id", "n_bytes", F.size(runs).alias("n_text"), F.unhex(F.sha2(F.array_join(runs, "\n"), 256)).alias("text_sha"), F.filter("items", lambda x: x["ref"].isNotNull()).alias("items"))
    values = ["payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    out = assembled(resolved(references(seqs, ("row", "doc_id", "n_bytes", "n_text", "text_sha")), small(info)), ["row"], values)
    m = F.col("media")[0]
    hexed = lambda c: F.lower(F.hex(c))
    return out.select(
        "doc_id", "n_bytes", m["payload_bytes"].alias("payload_bytes"), hexed(m["ref"]).alias("payload_sha256"), m["tail_crc32"].alias("tail_crc32"), m["media_bytes"].alias("media_bytes"), hexed(m["media_sha256"]).alias("media_sha256"), m["feature"].alias("feature"),
        "n_text", hexed("text_sha").alias("text_sha256"), F.transform("media", lambda x: F.struct(x["pos"].alias("pos"), x["caption"].alias("caption"), x["payload_bytes"].alias("payload_bytes"))).alias("media"),
    )
