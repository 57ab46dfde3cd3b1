"""The queries opN_<name> of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exactdedup, htmltext, linededup, lm, media, mixing, pii, sentencepiece_codec, simhash, toxicity
from .common import table


def piece_model() -> str:
    """The path of the public piece model, a parameter of the tokenising operators."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op1_media(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op3_line_dedup(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op4_pii(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.op5_sentencepiece(table(spark, sf_dir, "documents"), piece_model(), spans=True)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6_simhash(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.op7_html(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.op8_exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9_mixing(table(spark, sf_dir, "documents"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op10_lm(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_media, op2_toxicity, op3_line_dedup, op4_pii, op5_sentencepiece, op6_simhash, op7_html, op8_exact_dedup, op9_mixing, op10_lm)}

#: Two lines are near if equal with one word left out at the same place, or if one lacks a word of the other.
_LINES = r"""
WITH l AS (
  SELECT doc_id, line_no - 1 AS line_no, line, string_split(line, ' ') AS w
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents)
  WHERE trim(line, ' ') <> ''
), d AS (
  SELECT line, min((doc_id, line_no)) AS rank, any_value(w) AS w FROM l GROUP BY line
), v AS (
  SELECT line, rank, len(w) AS n, i, list_concat(w[1:i - 1], w[i + 1:]) AS rest FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) >= 5)
), changed AS (
  SELECT line FROM (SELECT line, rank, min(rank) OVER (PARTITION BY n, i, rest) AS early FROM v) WHERE early < rank
), gone AS (
  SELECT long.line AS long_line, long.rank AS long_rank, d.line AS short_line, d.rank AS short_rank FROM v long JOIN d ON long.rest = d.w WHERE len(d.w) >= 5
), near AS (
  SELECT line FROM changed UNION SELECT long_line FROM gone WHERE short_rank < long_rank UNION SELECT short_line FROM gone WHERE long_rank < short_rank
), lost AS (
  SELECT l.doc_id, l.line_no FROM l JOIN d USING (line) LEFT JOIN near USING (line) WHERE near.line IS NOT NULL OR (l.doc_id, l.line_no) <> d.rank
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents)
  ANTI JOIN lost USING (doc_id, line_no) GROUP BY doc_id
), count_lost AS (
  SELECT doc_id, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS nos FROM lost GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n, 0) AS n_dropped, coalesce(nos, '') AS dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN count_lost USING (doc_id)
"""

_EXACT = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER p AS keep_id, count(*) OVER p AS group_size, doc_id = min(doc_id) OVER p AS kept, text_sha256
FROM t WINDOW p AS (PARTITION BY text_sha256)
"""

ORACLES = {"op3_line_dedup": _LINES, "op8_exact_dedup": _EXACT}
