"""The registered queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roamer.llm import bpe, decontam, exact_dedup, html_text, jaccard, langid, licenses, sharding, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.summary(warc.round_trip(_table(spark, sf_dir, "pages"), least=0))


def op4_divideskip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_license_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=16)


def op8_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(_table(spark, sf_dir, "documents"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.recount(_table(spark, sf_dir, "documents"), tokenizer_path(), token_counts.redactions)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
p AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT s.doc_id, len(s.s) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = s.doc_id
"""

OP8_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_word_table": op1_bpe_word_table,
        "op2_hyperdimensional_langid": op2_hyperdimensional_langid,
        "op3_warc_assembly": op3_warc_assembly,
        "op4_divideskip_join": op4_divideskip_join,
        "op5_license_sentence_rules": op5_license_sentence_rules,
        "op6_template_decontamination": op6_template_decontamination,
        "op7_feistel_sharding": op7_feistel_sharding,
        "op8_bloom_dedup": op8_bloom_dedup,
        "op9_html_main_text": op9_html_main_text,
        "op10_edit_aware_token_counts": op10_edit_aware_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_divideskip_join": OP4_SQL, "op5_license_sentence_rules": licenses.sql(), "op8_bloom_dedup": OP8_SQL}
