"""Registered queries of the training-data operators, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from growthlens.llm import bpe, chat, decontam, egojoin, importance, kneserney, langid, linededup, minhash, pii, spelling, topk, toxicity
from growthlens.llm.common import table

#: Folder of public tokenizer files; ``GROWTHLENS_TOKENIZERS`` names another one.
TOKENIZERS = os.environ.get("GROWTHLENS_TOKENIZERS") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that copies a test item, with the item and the aligned passage."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney log probability of every document, learned outside the held-out fold."""
    return kneserney.score_documents(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that an earlier line repeats or nearly repeats."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=linededup.EDIT_PERCENT)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document from its maximum-scoring segments."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text decoded from them, as digests."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), os.path.join(TOKENIZERS, "byte_bpe_50k.json"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return egojoin.similar_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every document."""
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, read back and digested."""
    return chat.digests(chat.with_probe(table(spark, sf_dir, "conversations"))).drop("valid", "bad_turn")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, similarity 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of all documents."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth embedding."""
    return topk.every_hundredth(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, and the rank of those drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_lm_scoring, op3_language_id, op4_line_dedup, op5_toxicity, op6_bpe_round_trip,
    op7_embedding_near_dedup, op8_pii, op9_chat_formatting, op10_minhash_near_dedup, op11_spelling_variants, op12_exact_topk,
    op13_importance_resampling)}

_CHAT = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
one AS (
  SELECT conv_id,
         count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS trained,
         -- each turn: 8 characters of opening, 1 after the role, 8 of closing, one more for each escaped mark
         sum(17 + length(role) + length(text) + length(text) - length(replace(text, '\\', ''))
             + (length(text) - length(replace(text, '<|', ''))) // 2 * 1) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM one"""

#: The table of the CRC-32 polynomial, by its rule, as one list ``t``.
_CRC_TABLE = """
step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8)"""


def _crc(octets: str) -> str:
    """CRC-32 of a list of byte values; ``t`` is in scope."""
    return f"xor(list_reduce({octets}, lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]), 4294967295), 4294967295)"


_SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
run AS (
  SELECT doc_id, word, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS raw FROM documents),
       LATERAL (SELECT translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word)
  WHERE length(word) >= 5 GROUP BY doc_id, word),
hashed AS (
  SELECT word, n, {_crc("""flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word, ''),
      lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, ord(x) - 64] END))""")} AS h
  FROM run, crc_table),
vocab AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(word, 1, CAST(h % length(word) AS INT)) || substr(word, CAST(h % length(word) AS INT) + 2) ELSE word END AS word, n
    FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM vocab, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gone a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gone a JOIN vocab b ON a.rest = b.word),
told AS (
  SELECT v.word, v.n, count(e.other) AS n_near, arg_min(e.other, (-e.other_n, e.other)) AS best, max(e.other_n) AS best_n
  FROM vocab v LEFT JOIN near e ON v.word = e.word GROUP BY v.word, v.n),
formed AS (SELECT word, n, n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM told),
walk AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT w.word, f.form, steps + 1 FROM walk w JOIN formed f ON w.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(root, steps) AS root FROM walk GROUP BY word) r ON f.word = r.word"""

_TOPK = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, 1 + len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10"""

_IMPORTANCE = f"""
WITH RECURSIVE {_CRC_TABLE},
source_word AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM documents),
target_word AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM benchmark),
digits AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM source_word UNION SELECT word FROM target_word)),
bucketed AS (
  SELECT word, {_crc("list_transform(range(1, length(x), 2), lambda i: (instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1)")}
         % 10000 AS bucket
  FROM digits, crc_table),
s AS (SELECT bucket, count(*) AS n FROM source_word JOIN bucketed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_word JOIN bucketed USING (word) GROUP BY bucket),
gain AS (
  SELECT b.bucket, CAST(floor(1000 * ln(
      (CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * ((SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM s) + 10000)
      / ((CAST(coalesce(s.n, 0) AS DOUBLE) + 1) * ((SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM t) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM bucketed) b LEFT JOIN s ON b.bucket = s.bucket LEFT JOIN t ON b.bucket = t.bucket),
weighed AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM source_word JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                        / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, r.rank
FROM scored s LEFT JOIN (SELECT * FROM ranked WHERE rank <= (SELECT 10 * count(*) // 100 FROM ranked)) r ON s.doc_id = r.doc_id"""

ORACLES: dict[str, str] = {"op9_chat_formatting": _CHAT, "op11_spelling_variants": _SPELLING, "op12_exact_topk": _TOPK,
                           "op13_importance_resampling": _IMPORTANCE}
