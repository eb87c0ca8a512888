"""Exact deduplication by a two-pass Bloom filter.

Pass 1 sets a slot for each row in two tables, by two hash functions, and keeps
the words of 64 slots in which rows met. Pass 2 probes every row: rows whose
words are kept in both tables possibly repeat and are compared exactly by the
hash of their whole text; all others are unique for certain and pass straight
through without a shuffle. The filter grows with the rows up to the bound of
what is broadcast, reached at 10^9 rows; ``mark_duplicates`` deals more
fingerprints into parts by hash and filters part after part, so the filter is as
sharp at any size. ``deduplicate`` reads whole rows once and keeps to one filter;
beyond that bound it compares more and more unique rows too.

Texts are equal when they are identical after each run of space, tab, line
feed, vertical tab, form feed and carriage return became one space; null counts
as empty. Equality is tested on the SHA-256 of that text.

Cases: null texts form one group with empty ones; a null id sorts after all
others; of rows repeating an id with the same text one stays; an empty table
gives an empty result; other columns, whatever their names, are carried along
untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamer.llm.store import dropped, part_of, repeat_filter, repeat_parts, repeat_words, repeated, written

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, id, digest): the narrow table on which both passes run."""
    return written(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col(id_col).alias("id"),
            F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("digest"),
        ),
        "dedup-prints",
    )


def possibly_repeated(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: whether their ``digest`` possibly repeats among the written ``prints``."""
    words = repeat_words(prints.count())
    return repeated(rows, F.col("digest"), repeat_filter(prints, "digest", words), words)


def _probed(prints: DataFrame) -> DataFrame:
    """The fingerprints with ``maybe``; a part too large for one filter is never made."""
    parts = repeat_parts(prints.count())
    if parts == 1:
        return possibly_repeated(prints, prints)
    dealt = written(prints.withColumn("part", part_of(F.col("digest"), parts)), "dedup-parts", by=["part"])
    own = [dealt.where(F.col("part") == i).drop("part") for i in range(parts)]
    seen = reduce(DataFrame.unionByName, [written(possibly_repeated(p, p), "dedup-seen") for p in own])
    dropped(dealt)
    return seen


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Only narrow rows shuffle, and only those that possibly repeat. A group's
    smallest id is found by partial aggregation before the shuffle, and the
    groups are written out before they are joined back, so a group that holds a
    third of all rows is split by the adaptive skew join.
    """
    prints = _fingerprints(docs, id_col, text_col)
    seen = _probed(prints)
    maybe = seen.where("maybe").select("row_id", "id", "digest")
    groups = written(
        maybe.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("row_id").alias("row_id"))).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1"),
        "dedup-groups",
    )
    compared = maybe.join(groups, "digest", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("first.row_id") == F.col("row_id"), F.lit(True)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    alone = seen.where("not maybe").select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    return alone.unionByName(compared)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that are unique for certain are not shuffled. Of the others one row a group
    leaves each task (partial aggregation), so hot groups collapse early.
    """
    prints = _fingerprints(docs, id_col, text_col)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"),
        F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("digest"),
    )
    seen = possibly_repeated(keyed, prints)
    first = seen.where("maybe").groupBy("digest").agg(F.min_by("row", F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"))).alias("row"))
    return seen.where("not maybe").select("row.*").unionByName(first.select("row.*"))
