"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds its three
letters' vectors, the first rolled by two places and the second by one, so
order counts. A text bundles (adds) the vectors of all its trigrams, and a
language's prototype bundles the texts learned for it. A text gets the language
whose prototype has the largest cosine with the text's vector.

Letters are compared in lower case; all other characters between letters count
as one space, and a text is taken with a space at either end.

Learning adds whole counts, so prototypes don't depend on the order of the rows
or on how they are dealt out; only (language, dimension) sums are shuffled and
only the prototypes come to the driver.

Cases: a null text or one without a letter is ``und`` with score 0, and so is
every text if nothing was learned; ties go to the first language in order; rows
without a language or a text teach nothing; null and repeated ids are kept as
they are; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamer.llm.store import lean, short_batches

#: Places of a vector.
DIMENSIONS = 1024
#: Characters of text whose vectors are made together, and trigrams whose vectors are held at a time.
BLOCK, SLICE = 1 << 20, 4096
SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point the code point of its lower case, or a space if it is no letter."""
    table = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(maxsize=None)
def letter_vector(letter: int, dimensions: int) -> np.ndarray:
    """+1 and -1 at random, the same in every process."""
    bits = np.random.Generator(np.random.Philox(key=letter + (1 << 32))).integers(0, 2, dimensions, dtype=np.int8)
    return 2 * bits - 1


def bound(a: np.ndarray, b: np.ndarray, c: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of the trigrams (a, b, c): rows of +1 and -1."""
    known = np.unique(np.concatenate([a, b, c]))
    base = np.stack([letter_vector(int(x), dimensions) for x in known]) if len(known) else np.empty((0, dimensions), np.int8)
    at = [np.searchsorted(known, x) for x in (a, b, c)]
    return np.roll(base, 2, axis=1)[at[0]] * np.roll(base, 1, axis=1)[at[1]] * base[at[2]]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``BLOCK`` bytes (one row at least)."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        base = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, base + BLOCK, "right")))
        yield first, last
        first = last


def letters(text: str) -> np.ndarray:
    """A text's letters in lower case, each run of other characters as one space, with a space at either end."""
    gap = np.array([SPACE], np.uint32)
    chars = np.concatenate([gap, _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], gap])
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != SPACE) | (chars[:-1] != SPACE)
    return chars[keep]


def _bundled(parts: list[np.ndarray], owners: np.ndarray, out: np.ndarray) -> None:
    """Add the vectors of all trigrams of the parts to their owners' rows.

    Trigrams are taken ``SLICE`` at a time, in the order in which they first appear, so that a slice meets few
    texts if texts have few trigrams in common; only those texts' counts are laid out.
    """
    chars = np.concatenate(parts)
    doc = np.repeat(owners, [len(p) for p in parts])
    part = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    inner = np.flatnonzero(part[:-2] == part[2:]) if len(chars) > 2 else np.empty(0, np.int64)
    if not len(inner):
        return
    known, small = np.unique(chars, return_inverse=True)
    k = len(known)
    grams, first, at = np.unique((small[inner].astype(np.int64) * k + small[inner + 1]) * k + small[inner + 2], return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.arange(len(grams))
    pairs, counts = np.unique(rank[at] * len(out) + doc[inner], return_counts=True)
    place, owner, grams = pairs // len(out), pairs % len(out), grams[order]
    bounds = np.searchsorted(place, np.arange(0, len(grams) + SLICE, SLICE))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        own = grams[i * SLICE : (i + 1) * SLICE]
        vectors = bound(known[own // (k * k)], known[own // k % k], known[own % k], out.shape[1])
        texts, row = np.unique(owner[a:b], return_inverse=True)
        # A slice's counts add up to fewer than 2^24, so single precision is exact.
        table = np.zeros((len(texts), len(own)), np.float32)
        table[row, place[a:b] - i * SLICE] = counts[a:b]
        out[texts] += table @ vectors.astype(np.float32)


def text_vectors(texts: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, trigram totals): a row for each text; a text without letters has total 0.

    Memory is that of ``BLOCK`` characters at a time besides the longest text itself.
    """
    out, totals = np.zeros((len(texts), dimensions)), np.zeros(len(texts), np.int64)
    parts, owners, held = [], [], 0
    for i, text in enumerate(texts):
        chars = letters(text)
        totals[i] = max(0, len(chars) - 2)
        for at in range(0, max(1, len(chars) - 2), BLOCK):
            parts.append(chars[at : at + BLOCK + 2])
            owners.append(i)
            held += len(parts[-1])
            if held >= BLOCK:
                _bundled(parts, np.array(owners, np.int64), out)
                parts, owners, held = [], [], 0
    if parts:
        _bundled(parts, np.array(owners, np.int64), out)
    return out, totals


def _sums(dimensions: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in _blocks(batch.column(1)):
                langs = np.array(batch.column(0).slice(a, b - a).to_pylist(), object)
                vectors, _ = text_vectors(batch.column(1).slice(a, b - a).to_pylist(), dimensions)
                for lang in set(langs.tolist()):
                    total[lang] = total.get(lang, np.zeros(dimensions, np.int64)) + vectors[langs == lang].astype(np.int64).sum(axis=0)
        for lang, vector in total.items():
            yield pa.record_batch([pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(vector)], names=["lang", "place", "value"])

    return run


def learned(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS) -> dict[str, list[int]]:
    """The prototype of each language of the given rows (languages x dimensions numbers)."""
    short_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sums = rows.mapInArrow(lean(_sums(dimensions)), "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")).select("lang", "v.value").collect()
    return {r[0]: r[1] for r in sorted(found) if any(r[1])}


def _predicted(prototypes: dict[str, list[int]], dimensions: int) -> Callable:
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float64).reshape(len(names), dimensions)
    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for a, b in _blocks(batch.column(1)):
                vectors, totals = text_vectors(pc.fill_null(batch.column(1).slice(a, b - a), "").to_pylist(), dimensions)
                if not names:
                    lang += ["und"] * (b - a)
                    score += [0.0] * (b - a)
                    continue
                norm = np.linalg.norm(vectors, axis=1, keepdims=True)
                cosine = (vectors @ matrix.T) / np.where(norm > 0, norm, 1)
                best = np.argmax(cosine, axis=1)
                some = totals > 0
                lang += [names[i] if s else "und" for i, s in zip(best.tolist(), some.tolist(), strict=True)]
                score += np.where(some, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).round(6).tolist()
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "lang", "score"])

    return run


def predict(docs: DataFrame, prototypes: dict[str, list[int]], keep: list[str], text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """The columns ``keep`` of each row as struct ``row``, with ``lang`` (predicted) and ``score``."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lean(_predicted(prototypes, dimensions)), f"row {kind}, lang string, score double")


def is_held_out(id_: Column) -> Column:
    """Whether a row is left out of learning: crc32 of the id as text, mod 3, is 1 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score; learned on the rows not held out."""
    prototypes = learned(docs.where(~is_held_out(F.col(id_col))), lang_col, text_col)
    found = predict(docs, prototypes, [id_col], text_col)
    return found.select(F.col("row")[id_col].alias(id_col), is_held_out(F.col("row")[id_col]).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text is in a language: predicted, with a score of ``least`` or more."""
    prototypes = learned(docs.where(~is_held_out(F.col(id_col))), lang_col, text_col)
    found = predict(docs, prototypes, docs.columns, text_col)
    return found.where((F.col("lang") != "und") & (F.col("score") >= least)).select("row.*")
