"""Byte-level BPE encoding and decoding over a table of distinct words.

Encoding splits every text into pre-tokens ("words") inside Spark, with the
tokenizer's own pattern; ids of a text are the ids of its words in order. The
words go through a distinct-word table, so that each is encoded once:

1. A chunk (about 30 MB of text from one task) keeps its distinct words, dealt
   into parts by a hash of the word, and for each text the positions of its
   words among them. Chunks are written to the shared folder.
2. The parts are shuffled. A part holds all words of one hash range from all
   chunks, so each distinct word is encoded once, by one task, and its ids go
   back to every chunk that asked for it. A very common word costs one row a
   chunk.
3. A chunk's ids are joined back by position: a gather over the word list.

Decoding joins ids with the id-to-piece table (the vocabulary, a bounded table
that every task gets) and concatenates the pieces' bytes; bytes that are not
UTF-8 become U+FFFD as in the tokenizers library.

The texts themselves are never shuffled.

The split uses the JVM's regular expressions; letters that Unicode added after
the JVM's version may be split otherwise than by the library.

Cases: null text is empty and has no ids; null or repeated ids of rows are kept
as they are; a special token's string inside a text is that token, as in the
library; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamer.llm.store import lean, short_batches, written

#: Bytes of words and of their offsets in a chunk, at which it is closed.
CHUNK = 56 << 20

#: Fixed value: the pre-token pattern of the byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_json(path: str) -> str:
    """The tokenizer file, read once by the driver, with truncation and padding unused."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return json.dumps(found | {"truncation": None, "padding": None})


@lru_cache(maxsize=2)
def loaded(source: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(source)


def specials(source: str) -> list[str]:
    return sorted((t["content"] for t in json.loads(source)["added_tokens"]), key=len, reverse=True)


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def pieces(source: str) -> pa.Array:
    """The id-to-piece table: the bytes of each id."""
    found, byte = json.loads(source), _byte_of()
    table = found["model"]["vocab"] | {t["content"]: t["id"] for t in found["added_tokens"]}
    out = [b""] * (max(table.values()) + 1)
    for piece, i in table.items():
        out[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return pa.array(out, pa.large_binary())


def split_words(text: Column, source: str) -> Column:
    """The pre-tokens of a text in order; a special token is one pre-token."""
    each = lambda s: F.regexp_extract_all(s, F.lit(f"(?U){PATTERN}"), F.lit(0))
    text = F.coalesce(text, F.lit(""))
    names = specials(source)
    if not names:
        return each(text)
    some = "|".join(re.escape(n) for n in names)
    cut = F.split(text, f"(?={some})|(?<={some})", -1)
    apart = F.flatten(F.transform(cut, lambda s: F.when(s.isin(names), F.array(s)).otherwise(each(s))))
    found = F.lit(False)
    for n in names:
        found = found | F.contains(text, F.lit(n))
    return F.when(found, apart).otherwise(each(text))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit values, compressed: a byte for each up to 254, the rest byte plane by byte plane."""
    z = zstandard.ZstdCompressor(level=9)
    low, rest = z.compress(np.minimum(x, 255).astype(np.uint8).tobytes()), z.compress(_planes(x[x >= 255]))
    return len(low).to_bytes(8, "little") + low + rest


def unpack(x: bytes) -> np.ndarray:
    z, cut = zstandard.ZstdDecompressor(), 8 + int.from_bytes(x[:8], "little")
    out = np.frombuffer(z.decompress(x[8:cut]), np.uint8).astype("<u4")
    out[out == 255] = _unplaned(z.decompress(x[cut:]))
    return out


def pack_words(words: pa.Array) -> tuple[bytes, bytes]:
    """Lengths and bytes of words in order, compressed."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return pack(np.diff(ends)), zstandard.ZstdCompressor(level=9).compress(words.buffers()[2][ends[0] : ends[-1]].to_pybytes())


def unpack_words(lengths: bytes, data: bytes) -> list[str]:
    ends = np.concatenate([[0], np.cumsum(unpack(lengths).astype(np.int64))])
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(zstandard.ZstdDecompressor().decompress(data))).to_pylist()


def _chunks(parts: int, size: int) -> Callable:
    def chunk(number: int, ids: list[pa.Array], counts: list[np.ndarray], coded: list[pa.Array]) -> pa.RecordBatch:
        whole = pa.chunked_array(coded).unify_dictionaries()
        words = whole.chunk(0).dictionary
        n = len(words)
        part = np.array([zlib.crc32(w.encode()) % parts for w in words.to_pylist()], np.int64)
        order = np.lexsort((pc.rank(words, tiebreaker="first").to_numpy(zero_copy_only=False), part)) if n else np.empty(0, np.int64)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        # words get numbers that pack well: repeated ones by falling count, then the rest in order of place
        seen = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in whole.chunks])
        times = np.bincount(seen, minlength=n)
        often = np.argsort(-times, kind="stable")[: int((times > 2).sum())]
        rank = np.empty(n, "<u4")
        rank[np.concatenate([often, order[times[order] <= 2]])] = np.arange(n, dtype="<u4")
        words, bounds = words.take(pa.array(order)).cast(pa.large_string()), np.searchsorted(part[order], np.arange(parts + 1))
        kept = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
        asked = [pack_words(words.slice(bounds[p], bounds[p + 1] - bounds[p])) for p in kept]
        own = pa.concat_arrays(ids)
        rows = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        return pa.record_batch(
            [
                pa.array([number] * (len(kept) + 1), pa.int64()),
                pa.array([*kept, parts], pa.int32()),
                pa.array([x[0] for x in asked] + [pack(rank[seen])], pa.binary()),
                pa.array([x[1] for x in asked] + [pack(np.concatenate(counts))], pa.binary()),
                pa.array([None] * len(kept) + [pack(place[often])], pa.binary()),
                pa.concat_arrays([pa.nulls(len(kept), rows.type), rows]),
            ],
            names=["chunk", "part", "a", "b", "c", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, counts, coded, held = [], [], [], 0
        for batch in batches:
            words = batch.column(1).flatten()
            ids.append(batch.column(0))
            counts.append(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            coded.append(words.dictionary_encode())
            held += words.nbytes
            if held >= size:
                yield chunk(number, ids, counts, coded)
                number, ids, counts, coded, held = number + 1, [], [], [], 0
        if ids:
            yield chunk(number, ids, counts, coded)

    return run


def _encoded(source: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, table = loaded(source), None, {}
        for batch in batches:
            lens, ids = [], []
            for p, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                words = unpack_words(a.as_py(), b.as_py())
                if p != part:
                    part, table = p, {}
                new = [w for w in words if w not in table]
                for w, e in zip(new, tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                    table[w] = np.array(e.ids, "<u4").tobytes()
                found = [table[w] for w in words]
                lens.append(pack(np.array([len(x) // 4 for x in found])))
                ids.append(pack(np.frombuffer(b"".join(found), "<u4")))
            yield pa.record_batch([batch.column(1), batch.column(0), pa.array(lens, pa.binary()), pa.array(ids, pa.binary())], names=["chunk", "part", "a", "b"])

    return run


def _assembled(parts: int, finish: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens, ids = [], []
        for batch in batches:
            for p, a, b, c, rows in zip(batch.column(1).to_pylist(), *(batch.column(i) for i in range(2, 6)), strict=True):
                if p < parts:
                    lens.append(unpack(a.as_py()))
                    ids.append(unpack(b.as_py()))
                    continue
                size = np.concatenate([[0], *lens]).astype(np.int64)
                often, rest = unpack(c.as_py()), np.ones(len(size) - 1, bool)
                rest[often] = False
                at = np.concatenate([often, np.flatnonzero(rest)]).astype("<u4")[unpack(a.as_py())]
                counts = unpack(b.as_py()).astype(np.int64)
                flat = pa.array(np.concatenate([np.empty(0, "<u4"), *ids]).astype(np.uint32))
                tokens = pa.LargeListArray.from_arrays(pa.array(np.cumsum(size)), flat).take(pa.array(at)).flatten()
                upto = np.concatenate([[0], np.cumsum(size[1:][at])]) if len(at) else np.zeros(1, np.int64)
                bounds = upto[np.concatenate([[0], np.cumsum(counts)])]
                whole = finish(rows.values, tokens, bounds)
                for k in range(0, len(whole), 500):
                    yield whole.slice(k, 500)
                lens, ids = [], []

    return run


def decoded_bytes(source: str, tokens: pa.Array, bounds: np.ndarray, run: int = 1 << 19) -> Iterator[bytes]:
    """UTF-8 of the decoded text of each run of ids: the id-to-piece join, then concatenation; about ``run`` ids at a time."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + run, "right")) - 1)
        joined = pieces(source).take(tokens.slice(bounds[first], bounds[last] - bounds[first]))
        at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        data = memoryview(joined.buffers()[2] or b"")
        own = at[bounds[first : last + 1] - bounds[first]].tolist()
        for a, b in zip(own[:-1], own[1:], strict=True):
            yield bytes(data[a:b]).decode("utf-8", "replace").encode()
        first = last


def _digests(source: str, with_ids: bool) -> Callable:
    def finish(rows: pa.Array, tokens: pa.Array, bounds: np.ndarray) -> pa.RecordBatch:
        raw = memoryview(np.ascontiguousarray(tokens.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        text = [hashlib.sha256(x).hexdigest() for x in decoded_bytes(source, tokens, bounds)]
        out = [rows, pa.array(np.diff(bounds), pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())]
        if with_ids:
            out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), tokens.cast(pa.int32())))
        return pa.record_batch(out, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    return finish


def _token_lists(rows: pa.Array, tokens: pa.Array, bounds: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([rows, pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), tokens.cast(pa.int32()))], names=["id", "n_tokens", "ids"])


def _run(docs: DataFrame, source: str, id_col: str, text_col: str, finish: Callable, columns: str, chunk: int) -> DataFrame:
    spark = docs.sparkSession
    short_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = docs.select(F.col(id_col).alias("id"), split_words(F.col(text_col), source).alias("words"))
    chunks = written(
        words.mapInArrow(lean(_chunks(parts, chunk)), f"chunk long, part int, a binary, b binary, c binary, ids array<{kind}>"), "bpe-chunks", **{"parquet.block.size": str(16 << 20)}
    )
    asked = chunks.where(F.col("part") < parts).select("part", "chunk", "a", "b").repartition("part").sortWithinPartitions("part")
    answers = asked.mapInArrow(lean(_encoded(source)), "chunk long, part int, a binary, b binary")
    places = chunks.where(F.col("part") == parts).select("chunk", "part", "a", "b", "c", "ids")
    back = answers.unionByName(places, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "part")
    out = back.mapInArrow(lean(_assembled(parts, finish)), f"id {kind}, {columns}")
    return out.withColumnRenamed("id", id_col)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (array of int)."""
    return _run(docs, tokenizer_json(tokenizer_path), id_col, text_col, _token_lists, "n_tokens long, ids array<int>", chunk)


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens and the SHA-256 of its ids and of the text decoded from them."""
    source = tokenizer_json(tokenizer_path)
    return _run(docs, source, id_col, text_col, _digests(source, with_ids), "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, chunk)


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and the text of its ids; null ids give an empty text."""
    source = tokenizer_json(tokenizer_path)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.if_else(pc.is_null(batch.column(1)), pa.scalar([], batch.column(1).type), batch.column(1))
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.record_batch([batch.column(0), pa.array([x.decode() for x in decoded_bytes(source, lists.flatten(), bounds)], pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
