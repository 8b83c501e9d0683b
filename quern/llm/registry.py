"""The queries of this subpackage, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, language, lexical, licenses, media, mixing, negatives, quality, simhash, substring, tokens, toxicity, warc
from .common import documents, small_batches

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    def run(spark, sf_dir):
        small_batches(spark)
        return f(spark, sf_dir)

    Q[f.__name__] = run
    return f


@query
def op1_media_columns(spark, sf_dir):
    return media.media_columns(documents(spark, sf_dir))


@query
def op2_byte_bpe(spark, sf_dir):
    import public_tokenizers as public

    return bpe.encoded(documents(spark, sf_dir), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


@query
def op3_warc(spark, sf_dir):
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op6_language(spark, sf_dir):
    return language.identified(documents(spark, sf_dir))


@query
def op7_token_shards(spark, sf_dir):
    import public_tokenizers as public

    return tokens.round_trip(documents(spark, sf_dir), public.path("byte_bpe_50k.json"), public.PATTERN)


@query
def op8_substring(spark, sf_dir):
    return substring.digests(documents(spark, sf_dir))


@query
def op9_mixing(spark, sf_dir):
    return mixing.mixed_sizes(documents(spark, sf_dir))


@query
def op10_quality(spark, sf_dir):
    return quality.judged(documents(spark, sf_dir))


@query
def op11_licenses(spark, sf_dir):
    return licenses.labelled(documents(spark, sf_dir))


@query
def op12_negatives(spark, sf_dir):
    return negatives.mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_lexical(spark, sf_dir):
    return lexical.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS b, sha256(html) AS s FROM p),
f AS (SELECT s, min(page_id) AS first FROM d WHERE b >= 100 GROUP BY s)
SELECT d.page_id, CAST(d.b AS BIGINT) AS payload_bytes, d.s AS payload_digest,
  CASE WHEN f.first IS NULL OR d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first IS NULL OR d.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM d LEFT JOIN f ON d.s = f.s AND d.b >= 100
"""

SQL["op11_licenses"] = licenses.sql()
SQL["op12_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5
"""
SQL["op13_lexical"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, doc_id, size, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, len(terms) AS size, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n FROM s) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p GROUP BY term),
c AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * (SELECT n FROM s)) // (SELECT l FROM s)))) AS gain FROM p JOIN w USING (term)),
t AS (SELECT item_id, r, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM i JOIN c USING (term) GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank, doc_id, score FROM t WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""
