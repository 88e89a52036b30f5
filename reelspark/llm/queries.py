"""Registered queries of this subpackage: one ``opN_<name>`` per operator, over whole tables."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_trie, collision_ann, html_text, near_dup, packing, quality, secrets, simhash, spelling,
               suffix_dedup, token_counts, warc, whitening)
from .common import bounded_batches, read_table, shared_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    """Where the installed tokenizer files lie; the operators take the path as a parameter."""
    return importlib.import_module("public_tokenizers").path(name)


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"),
                                     tokenizer_path("piece_bpe_32k.model"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(read_table(spark, sf_dir, "documents"),
                        tokenizer_path("byte_bpe_50k.json"))


@query
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark, rows=5000)
    return bpe_trie.round_trip(read_table(spark, sf_dir, "documents"),
                               tokenizer_path("byte_bpe_50k.json"))


@query
def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return html_text.extract(read_table(spark, sf_dir, "pages"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality.rate(read_table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    path = shared_path(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path)


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_dup.link(read_table(spark, sf_dir, "documents")).drop("text_key")


@query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return suffix_dedup.measure(read_table(spark, sf_dir, "documents"))


@query
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return collision_ann.search(read_table(spark, sf_dir, "embeddings"))


@query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return simhash.link(read_table(spark, sf_dir, "documents"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds is NULL."""
    bounded_batches(spark)
    out = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spelling.variants(read_table(spark, sf_dir, "documents"))


#: The checksum table is 256 values of its rule; near words meet in what is left of them without one letter.
ORACLE["op13_spelling"] = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(0, 8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
              ORDER BY i) AS t FROM range(0, 256) r(i)),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT w, c, doc_id, flatten(list_transform(string_split(concat(doc_id, ':', w), ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)]
      ELSE [CAST(192 | (unicode(ch) >> 6) AS BIGINT), CAST(128 | (unicode(ch) & 63) AS BIGINT)] END)) AS b FROM runs),
hashed AS (SELECT w, c, CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(b,
    lambda h, x: xor(h >> 8, t[1 + (xor(h, x) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) END AS h FROM bytes, crc),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 199 = 0
    THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON b.word = a.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS form, max(other_n) AS form_n
  FROM pairs GROUP BY word),
known AS (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
    CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS at, form AS next FROM known
  UNION ALL SELECT c.word, c.next, k.form FROM chain c JOIN known k ON k.word = c.next)
SELECT k.word, k.n, k.n_near, k.form, CAST(k.form_n AS BIGINT) AS form_n, c.at AS root
FROM known k JOIN chain c ON c.word = k.word AND c.next IS NULL"""
