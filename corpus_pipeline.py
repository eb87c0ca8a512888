"""A corpus pipeline out of the operators in ``roamer.llm``.

``STAGES`` are applied in order; each takes (spark, docs, sf_dir), works on all
that its predecessor kept, and its result is written and read again before the
next. All but the last return the columns of ``documents``.

Cases: documents with null, empty or letterless text go in the first stage; of equal
texts and of linked groups the smallest id stays, null ids are larger than all others
and a group of null ids only stays; rows that repeat are equal texts, so one stays; an
empty table gives an empty result, and an empty ``benchmark`` contaminates nothing;
extra columns, whatever their names, are carried along until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roamer.llm import bpe, decontam, exact_dedup, jaccard, langid, store
from roamer.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text or no letter) go."""
    return langid.recognised(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a Jaccard similarity of 0.8 on five-word shingles the smallest id stays."""
    return jaccard.representatives(docs, k=5, num=4, den=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item, exact or re-parameterised, go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them, and the ids."""
    return bpe.digests(docs, tokenizer_path(), with_ids=True)


STAGES = [("language", language), ("exact dedup", exact), ("near duplicates", near), ("decontamination", decontaminate), ("bpe", tokens)]

#: The learned and hashed stages have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
