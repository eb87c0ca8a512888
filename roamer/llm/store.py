"""Shared storage for cut points, and membership filters of a fixed size."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local master (tests) gets a folder of our own;
    on a cluster that is an error, since each machine would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="roamer-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: list[str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet, in folders by the columns ``by``, to the shared folder and read it again.

    This cuts the lineage: what follows survives the loss of any executor
    without running ``df`` again, and numbers that depend on the task (chunk
    ids, row ids) are fixed by the commit.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_point = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete cut points that ``written`` made and that no table to come reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_point)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Bits of a filter's block, which is a row, and the most blocks of a filter: 64 MB are broadcast at most.
BLOCK_BITS, MOST_BLOCKS = 32768, 1 << 14
#: Bits for each key, and bits that a key sets.
BITS_A_KEY, HASHES = 16, 3


def bit_blocks(bits: DataFrame) -> DataFrame:
    """(block, words) of set bits (block, bit): 512 words of 64 bits; bitmaps are made in each task and joined by OR."""
    found = bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    word = lambda i: F.conv(F.hex(F.substring("bitmap", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return found.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), word).alias("words"))


def has_bit(words: Column, bit: Column) -> Column:
    """Whether a bit is set in a block of ``bit_blocks``; false where there is no such block."""
    at = F.lit(56) - (F.shiftright(bit, 3).bitwiseAND(F.lit(7)) * 8) + bit.bitwiseAND(F.lit(7))
    return F.coalesce(F.getbit(F.get(words, F.shiftright(bit, 6).cast("int")), at.cast("int")) == 1, F.lit(False))


def filter_blocks(keys: int) -> int:
    """Blocks for so many keys; from 33 million keys on a filter doesn't grow and lets more rows take the exact path behind it."""
    return max(1, min(MOST_BLOCKS, -(-keys * BITS_A_KEY // BLOCK_BITS)))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(blocks)), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(-1))
    return [F.shiftright(h, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(HASHES)]


def filter_of(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """A Bloom filter of the keys in a column: a key sets ``HASHES`` bits of one block."""
    key = F.col(column)
    return bit_blocks(keys.select(_block(key, blocks).alias("block"), F.explode(F.array(*_bits(key))).alias("bit")))


def probed(df: DataFrame, key: Column, bits: DataFrame, blocks: int, into: str) -> DataFrame:
    """Add a boolean column: whether the filter may hold a key; a null key is a key like others.

    The filter has at most ``MOST_BLOCKS`` rows of 4 KB, so it is broadcast.
    """
    bits = bits.select(F.col("block").alias("_probe_block"), F.col("words").alias("_probe_words"))
    seen = df.withColumn("_probe_key", _block(key, blocks))
    tests = [has_bit(F.col("_probe_words"), b) for b in _bits(key)]
    hit = seen.join(F.broadcast(bits), F.col("_probe_key") == F.col("_probe_block"), "left")
    return hit.withColumn(into, tests[0] & tests[1] & tests[2]).drop("_probe_block", "_probe_words", "_probe_key")


def filtered(df: DataFrame, key: Column, members: DataFrame, column: str, into: str = "maybe") -> DataFrame:
    """``df`` with a column that says whether the rows' keys may be among a written table's."""
    blocks = filter_blocks(members.count())
    return probed(df, key, filter_of(members, column, blocks), blocks, into)


def row_hash(id_: Column, text: Column) -> Column:
    """What a row is found again by: a hash of its id and text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), id_)


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, all columns, whose row hash isn't in the written table ``gone`` (gone); most pass without a shuffle."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_hash(F.col(id_col), F.col(text_col)).alias("key"))
    seen = filtered(rows, F.col("key"), gone, "gone")
    stay = seen.where("maybe").join(gone, F.col("key") == F.col("gone"), "left_anti")
    return seen.where("not maybe").select("row.*").unionByName(stay.select("row.*"))


#: Words of 64 slots for each key of a repeat filter's table, and the most words: one bit each is broadcast, 64 MB a table.
KEYS_A_WORD, MOST_WORDS, TABLES = 2, 1 << 29, 2


def _word(key: Column, table: int, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(table)), F.lit(words))


def repeat_words(keys: int) -> int:
    """Words of each table of a repeat filter for so many keys."""
    return max(BLOCK_BITS, min(MOST_WORDS, -(-keys // KEYS_A_WORD)))


def repeat_parts(keys: int) -> int:
    """In how many parts, by hash, so many keys are filtered one after the other: a part's tables are within ``MOST_WORDS``."""
    return max(1, -(-keys // (MOST_WORDS * KEYS_A_WORD)))


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(TABLES)), F.lit(parts)).cast("int")


def repeat_filter(keys: DataFrame, column: str, words: int) -> list[DataFrame]:
    """Pass 1: for each hash function the blocks of words in which two keys met in a slot.

    A key sets a slot in one word of each table. A word's slots are joined by OR and its keys counted, in each task
    and then over all: if there are more keys than slots set, two of them met. What is shuffled is words, each once a task.
    """
    key, found = F.col(column), []
    for t in range(TABLES):
        slot = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(F.xxhash64(key, F.lit(t)), 58).bitwiseAND(F.lit(63)).cast("int"))
        met = keys.select(_word(key, t, words).alias("word"), slot.alias("slot")).groupBy("word").agg(F.bit_or("slot").alias("slots"), F.count(F.lit(1)).alias("n")).where(F.col("n") > F.bit_count("slots"))
        found.append(bit_blocks(met.select((F.col("word") / F.lit(BLOCK_BITS)).cast("long").alias("block"), (F.col("word") % BLOCK_BITS).alias("bit"))))
    return found


def repeated(df: DataFrame, key: Column, tables: list[DataFrame], words: int, into: str = "maybe") -> DataFrame:
    """Pass 2: add a boolean column: whether a key possibly repeats; false only for keys that are there once.

    A table has at most ``MOST_WORDS`` bits, so it is broadcast.
    """
    known = [f"_probe_{c}{t}" for t in range(TABLES) for c in ("word", "block", "words")]
    for t, bits in enumerate(tables):
        df = df.withColumn(f"_probe_word{t}", _word(key, t, words))
        bits = bits.select(F.col("block").alias(f"_probe_block{t}"), F.col("words").alias(f"_probe_words{t}"))
        df = df.join(F.broadcast(bits), (F.col(f"_probe_word{t}") / F.lit(BLOCK_BITS)).cast("long") == F.col(f"_probe_block{t}"), "left")
    hit = F.lit(True)
    for t in range(TABLES):
        hit = hit & has_bit(F.col(f"_probe_words{t}"), F.col(f"_probe_word{t}") % BLOCK_BITS)
    return df.withColumn(into, hit).drop(*known)


#: Rows and bytes of an Arrow batch between the JVM and a Python worker; texts of pages and documents are long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def short_batches(spark: SparkSession) -> None:
    """Let the session hand Arrow batches of bounded rows and bytes to Python: they bound what both sides buffer.

    A row of more than ``BATCH_BYTES`` is a batch of its own.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow, giving a worker's freed memory back to the system when its task ends.

    Workers are reused by later tasks and stages; what the allocators keep would add up over them.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
            if trim:
                trim(0)

    return wrapped
