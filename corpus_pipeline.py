"""A corpus pipeline: each stage reads what the one before has kept, decides, and hands on.

All but the last stage return the columns that they got. Defined results: language ID drops documents whose text is null,
empty, without a letter or of no language; near-dedup keeps of linked rows that of the smallest id, of one id that of the
smallest text hash, of equal rows one, and of rows without an id one for each component that has none with one; substring
dedup keeps documents without words as they are and drops those that lose all; the mix takes a row 0, 1 or 2 times, one
without words never; encoding gives every row its ids. An empty table stays empty. Stages work on tables (a stage's result is written and read
again before the next), which also lets a repeated task see the same rows in the same order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, language, mixing, simhash, substring
from quern.llm.common import documents, small_batches, written

#: Bytes of text that a task holds at once: workers of earlier stages stay, so there is less room than for one query.
CHUNK = 4 << 20


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the network knows go."""
    return language.accepted(docs, language.learned(language.sample(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays."""
    return simhash.deduplicated(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a repeated window covers go, and documents of which nothing stays."""
    return substring.deduplicated(docs, CHUNK)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with their number and digests."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, texts=True, chunk=CHUNK)


def _stage(f):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, docs, sf_dir)

    return run


STAGES = [
    ("language ID", _stage(tell_language)),
    ("SimHash near-dedup", _stage(drop_near_duplicates)),
    ("substring dedup", _stage(drop_repeated_passages)),
    ("mixing sources to target weights", _stage(mix_sources)),
    ("byte-level BPE encoding and decoding", _stage(encode)),
]

#: Learned decisions, fingerprints and BPE are not expressible in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.split()[0].lower())
    return docs
