"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number 0 .. N-1 from its content alone: rows are put
into hash buckets, buckets are laid end to end, and a row's number is its
bucket's start plus its rank there. A keyed Feistel network permutes the
smallest a x b grid that holds N numbers; a value outside 0 .. N-1 walks on
until it falls inside. The result p of a row is its place in the shuffle:
shard = p mod S and slot = p div S, so shard sizes differ by one row at most
(law ``rows``) and slots have no gaps. Whoever knows N and the seed can compute
shard and slot of any row number.

Cases: a null text has no bytes (size 1, CRC 0); null ids are rows like any
other; rows equal in id, size and CRC may swap places; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamer.llm.store import written

#: Buckets of the global numbering; their counts are the only broadcast side.
BUCKETS = 4096
ROUNDS = 6
#: A walk leaves the grid's overhang at once but for a share of about 1/sqrt(N).
WALK = 64


def permuted(number: Column, rows: int, seed: int = 42) -> Column:
    """The place of a row number in the shuffle of ``rows`` rows: a bijection on 0 .. rows-1.

    The overhang of the grid has fewer than sqrt(rows) + 1 values, so a walk of
    min(overhang, 64) further steps always ends for small tables; for larger
    ones the chance of a longer walk is below 64^-64, and it raises an error.
    """
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    b = max(1, -(-rows // a))

    def network(x: Column) -> Column:
        start = F.struct((x / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).alias("r"))
        keyed = lambda half, i: F.xxhash64(half, i, F.lit(seed))
        halves = F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
            start,
            lambda acc, i: F.when(
                i % 2 == 0, F.struct(F.pmod(acc.l + F.pmod(keyed(acc.r, i), F.lit(a)), F.lit(a)).cast("long").alias("l"), acc.r.alias("r"))
            ).otherwise(F.struct(acc.l.alias("l"), F.pmod(acc.r + F.pmod(keyed(acc.l, i), F.lit(b)), F.lit(b)).cast("long").alias("r"))),
            lambda acc: acc.l * F.lit(b) + acc.r,
        )
        return halves

    start = F.transform(F.array(number.cast("long")), network)[0]
    steps = min(a * b - rows, WALK)
    if steps <= 0:
        return start
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda acc, _: F.when(acc < rows, acc).otherwise(network(acc)))
    return F.transform(F.array(walked), lambda p: F.when(p < rows, p).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))[0]


def numbered(rows: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Add ``row_number`` 0 .. N-1, the same for any layout of the same rows."""
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    counts = placed.groupBy("bucket").count()
    starts = counts.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*key))
    return placed.withColumn("rank", rank).join(F.broadcast(starts), "bucket").withColumn("row_number", F.col("start") + F.col("rank") - 1).drop("bucket", "rank", "start")


def shard(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    Texts are read once for size and CRC; only those numbers are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    facts = written(docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "shard-facts")
    rows = facts.count()
    place = numbered(facts, [id_col, "text_crc32", "size"]).withColumn("place", permuted(F.col("row_number"), rows, seed))
    return place.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        (F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
