"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, linededup, media, ngramjoin, packing, phrases, quality, secrets, sharding, toxicity, urlgraph, vectors, warc
from .common import documents, pages


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(pages(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(pages(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_boilerplate(documents(spark, sf_dir), ratio=0.02)  # as in its SQL
    return kept.select("doc_id", "source", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(documents(spark, sf_dir), n=4, num=85, den=100)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_secrets, op3_warc, op4_media, op5_quality, op6_urls, op7_packing, op8_line_dedup, op9_toxicity, op10_ngram_join, op11_codes, op12_phrases, op13_shards)
}
ORACLES: dict[str, str] = {
    "op6_urls": urlgraph.oracle(),
    "op11_codes": vectors.oracle(),
    "op12_phrases": phrases.oracle(),
    "op13_shards": sharding.oracle(),
    "op8_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
c AS (SELECT source, line, count(DISTINCT r) AS pages FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line),
t AS (SELECT source, count(*) AS total FROM d GROUP BY source),
b AS (SELECT c.source, c.line FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE pages >= 3 AND pages > 0.02::DOUBLE * total),
k AS (SELECT l.r, count(*) AS n_lines, count(b.line) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (b.line IS NULL), '') AS kept
  FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line GROUP BY l.r)
SELECT doc_id, source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(kept) AS kept_chars, sha256(kept) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, max(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(p.hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  CASE WHEN page_id = first_id THEN greatest(1, ceil((
    strlen('HTTP/1.1 200 OK') + 2 + strlen('Content-Type: text/html; charset=utf-8') + 2 + strlen('Transfer-Encoding: chunked') + 4
    + strlen(html) + 5 + (strlen(html) // 8192) * 8
    + CASE WHEN strlen(html) % 8192 > 0 THEN 4 + strlen(to_hex(strlen(html) % 8192)) ELSE 0 END) / 32768.0))::INT ELSE 1 END AS n_segments
FROM p JOIN f USING (hex)""",
    "op10_ngram_join": """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
u AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS x FROM g),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c AS (SELECT r, r AS o FROM g UNION SELECT c.r, l.b FROM c JOIN l ON c.o = l.a),
m AS (SELECT c.r, min(g.doc_id) AS component_id FROM c JOIN g ON c.o = g.r GROUP BY c.r)
SELECT doc_id, len(s) AS n_shingles, component_id FROM g JOIN m ON g.r = m.r""",
}
