"""One query for each operator of this folder, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import brown, chat, minhash, secretscan
from .common import table
from .decontam import contaminated
from .langid import identify, learn
from .linededup import dedup_lines
from .packing import pack_documents
from .tokenfile import token_file_round_trip
from .tokens import public_path
from .topk import top_k

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates."""
    return minhash.classes(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token files in ascending order and read back."""
    return token_file_round_trip(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 code points that five documents share stay in the last of them alone."""
    done = dedup_lines(table(spark, sf_dir, "documents"), least=40, documents=5)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, shared.k IS NOT NULL AND doc_id < keeper AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a network learned from those that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    return identify(documents, learn(documents))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret in documents with the forest's verdict."""
    vocabulary = public_path("word_bpe_49k.json")
    forest = secretscan.fit(secretscan.example_findings(), secretscan.dictionary(vocabulary))
    return secretscan.scan(table(spark, sf_dir, "documents"), forest, vocabulary)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under a class-based bigram model of the documents that aren't held out."""
    return brown.learn_and_score(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth embedding."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns, repaired and rendered."""
    return chat.repair(table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def queries() -> dict[str, Query]:
    """The queries by name."""
    return {f.__name__: f for f in (op1_packing, op2_near_duplicates, op3_token_files, op4_line_dedup, op5_language, op6_decontamination, op7_secret_scan, op8_lm_score, op9_top_k, op10_chat_format)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op4_line_dedup": OP4_SQL, "op9_top_k": OP9_SQL}
