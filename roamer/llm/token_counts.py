"""Token counts that follow edits, by a segment tree of pre-tokens per document.

A document's leaves are its pre-tokens with their characters and token counts,
in blocks of about ``BLOCK``; a segment tree over the blocks keeps the sums of
both. An edit finds its block by descending the tree, re-splits the text from a
boundary ``context`` characters before it until a new boundary meets an old one
behind it, encodes only the pre-tokens in between, and updates the sums above
the blocks it touched. Splitting from a boundary depends on what follows only,
so everything outside that region stays as it is.

Edits of a document are applied in order; each is (at, removed, inserted):
``removed`` characters from ``at`` on, in the text as the edits before left it,
are replaced. Positions beyond the end mean the end; null edits are none.

Counts are those of encoding the whole text without special tokens added. The
documents are never shuffled.

Cases: null text is empty and has 0 tokens; null and repeated ids are kept as
they are; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamer.llm.bpe import PATTERN, loaded, specials, split_words, tokenizer_json
from roamer.llm.store import short_batches

BLOCK = 64
#: Distinct pre-tokens whose counts a task keeps; beyond, it starts anew.
KEPT = 1 << 19

Edit = tuple[int, int, str]


class Counter:
    """Pre-tokens of a string and their token counts."""

    def __init__(self, source: str) -> None:
        import regex

        self.tokenizer, self.names = loaded(source), specials(source)
        some = "".join(f"{regex.escape(n)}|" for n in self.names)
        self.pattern = regex.compile(some + PATTERN)
        self.special = re.compile("|".join(map(re.escape, self.names))) if self.names else None
        #: How far behind its end a pre-token's split may look, and one more.
        self.context = max([2, *map(len, self.names)])
        self.known: dict[str, int] = {}
        self.encoded = 0

    def counts(self, words: list[str]) -> list[int]:
        if new := [w for w in dict.fromkeys(words) if w not in self.known]:
            if len(self.known) > KEPT:
                self.known.clear()
                new = list(dict.fromkeys(words))
            self.known |= zip(new, map(len, self.tokenizer.encode_batch(new, add_special_tokens=False)), strict=True)
        return [self.known[w] for w in words]

    def split(self, text: str, at: int = 0) -> Iterator[str]:
        """Pre-tokens from a boundary on; none reaches into a special token."""
        while at < len(text):
            found = self.special.search(text, at) if self.special else None
            stop = found.start() if found else len(text)
            for m in self.pattern.finditer(text[at:stop]) if stop > at else ():
                yield m.group()
            if found:
                yield found.group()
            at = found.end() if found else stop


class Tree:
    """Blocks of leaves (pre-token, tokens) under a segment tree of (characters, tokens).

    A block is a pair of lists, or the number of its first leaf as long as nothing has touched it.
    """

    def __init__(self, words: pa.Array, characters: np.ndarray, counts: np.ndarray) -> None:
        self.words, self.counts, self.segments = words, counts, len(counts)
        starts = np.arange(0, len(counts), BLOCK)
        self.blocks: list = starts.tolist() or [([], [])]
        self._grow(list(zip(np.add.reduceat(characters, starts).tolist(), np.add.reduceat(counts, starts).tolist(), strict=True)) if len(counts) else [(0, 0)])

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Tree:
        return cls(pa.array(words, pa.string()), np.array([len(w) for w in words], np.int64), np.array(counts, np.int64))

    def _grow(self, leaves: list[tuple[int, int]]) -> None:
        n = 1
        while n < len(leaves):
            n *= 2
        self.n = n
        self.sums = [(0, 0)] * n + leaves + [(0, 0)] * (n - len(leaves))
        for i in range(n - 1, 0, -1):
            self.sums[i] = (self.sums[2 * i][0] + self.sums[2 * i + 1][0], self.sums[2 * i][1] + self.sums[2 * i + 1][1])

    def block(self, i: int) -> tuple[list[str], list[int]]:
        if isinstance(self.blocks[i], int):
            start = self.blocks[i]
            self.blocks[i] = (self.words.slice(start, BLOCK).to_pylist(), self.counts[start : start + BLOCK].tolist())
        return self.blocks[i]

    def leaves(self) -> Iterator[tuple[str, int]]:
        for i in range(len(self.blocks)):
            yield from zip(*self.block(i), strict=True)

    def _leaf(self, i: int) -> tuple[int, int]:
        words, counts = self.block(i)
        return sum(map(len, words)), sum(counts)

    def _update(self, i: int) -> None:
        self.sums[self.n + i] = self._leaf(i)
        i = (self.n + i) // 2
        while i:
            self.sums[i] = (self.sums[2 * i][0] + self.sums[2 * i + 1][0], self.sums[2 * i][1] + self.sums[2 * i + 1][1])
            i //= 2

    @property
    def characters(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def text(self) -> str:
        return "".join(w for w, _ in self.leaves())

    def find(self, at: int) -> tuple[int, int, int]:
        """(block, leaf, start) of the pre-token that holds character ``at``; behind the end, the end."""
        if at >= self.characters:
            last = len(self.blocks) - 1
            return last, len(self.block(last)[0]), self.characters
        i, start = 1, 0
        while i < self.n:
            i *= 2
            if at - start >= self.sums[i][0]:
                start += self.sums[i][0]
                i += 1
        b = i - self.n
        for j, w in enumerate(self.block(b)[0]):
            if at - start < len(w):
                return b, j, start
            start += len(w)
        raise AssertionError("sums of the tree don't fit its leaves")

    def edit(self, edit: Edit, counter: Counter) -> int:
        """Apply one edit; return how many pre-tokens were encoded again."""
        total = self.characters
        at = min(max(edit[0], 0), total)
        stop = min(at + max(edit[1], 0), total)
        if at == stop and not edit[2]:
            return 0
        b, j, begin = self.find(max(at - counter.context, 0)) if total else (0, 0, 0)
        # a boundary whose pre-token before it ends at least ``context`` before the edit
        old, ends = [], []
        block, leaf, upto = b, j, begin
        size, fresh = 1, None

        def more(goal: int) -> None:
            nonlocal block, leaf, upto
            while upto < goal or not old and upto < total:
                while leaf >= len(self.block(block)[0]):
                    block, leaf = block + 1, 0
                w = self.block(block)[0][leaf]
                old.append(w)
                upto += len(w)
                ends.append(upto)
                leaf += 1

        while True:  # widen the region until new and old boundaries meet
            more(min(total, stop + size * 64))
            region = "".join(old)
            changed = region[: at - begin] + edit[2] + region[stop - begin :]
            delta = len(edit[2]) - (stop - at)
            marks = {e for e in ends if e >= stop}
            fresh, here, met = [], begin, None
            limit = begin + len(changed) - counter.context if upto < total else None
            for w in counter.split(changed):
                if limit is not None and here + len(w) > limit:
                    break
                fresh.append(w)
                here += len(w)
                if here - delta in marks and here >= at + len(edit[2]):
                    met = here - delta
                    break
            if met is not None or upto >= total:
                break
            size *= 4
        gone = ends.index(met) + 1 if met is not None else len(old)
        if met is None and here != begin + len(changed):
            raise AssertionError("region was not split to its end")
        counts = counter.counts(fresh)
        self._splice(b, j, gone, fresh, counts)
        return len(fresh)

    def _splice(self, b: int, j: int, gone: int, words: list[str], counts: list[int]) -> None:
        """Put new leaves in the place of ``gone`` leaves from leaf j of block b on."""
        self.segments += len(words) - gone
        own_w, own_c = self.block(b)
        took = min(len(own_w) - j, gone)
        new_w, new_c = own_w[:j] + words + own_w[j + took :], own_c[:j] + counts + own_c[j + took :]
        self.blocks[b] = (new_w, new_c)
        self._update(b)
        gone -= took
        nxt = b
        while gone:
            nxt += 1
            w, c = self.block(nxt)
            took = min(len(w), gone)
            self.blocks[nxt] = (w[took:], c[took:])
            self._update(nxt)
            gone -= took
        if len(new_w) > 2 * BLOCK:
            parts = [(new_w[i : i + BLOCK], new_c[i : i + BLOCK]) for i in range(0, len(new_w), BLOCK)]
            leaves = self.sums[self.n : self.n + len(self.blocks)]
            leaves[b : b + 1] = [(sum(map(len, w)), sum(c)) for w, c in parts]
            self.blocks[b : b + 1] = parts
            self._grow(leaves)


def _batches(batch: pa.RecordBatch, counter: Counter) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(row, pre-tokens, their characters, their token counts) of each row; each distinct pre-token of a batch is encoded once."""
    words = batch.column(1).flatten().cast(pa.large_string())
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False)
    counts = np.array(counter.counts(distinct), np.int64)[at] if distinct else np.empty(0, np.int64)
    characters = np.array([len(w) for w in distinct], np.int64)[at] if distinct else np.empty(0, np.int64)
    ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)).astype(np.int64)
    start = 0
    for i, end in enumerate(ends.tolist()):
        yield i, words.slice(start, end - start), characters[start:end], counts[start:end]
        start = end


_COLUMNS = "n_tokens long, n_segments long, n_edits long, n_tokens_edited long, n_segments_edited long, n_reencoded long"


def _counted(source: str, edits_of: Callable[[str], list[Edit]] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(source)
        for batch in batches:
            out = []
            for i, words, characters, per in _batches(batch, counter):
                tokens, segments = int(per.sum()), len(per)
                if edits_of is None:
                    edits = [(e["at"], e["removed"], e["inserted"] or "") for e in batch.column(2)[i].as_py() or () if e]
                else:
                    edits = edits_of(batch.column(2)[i].as_py() or "")
                if not edits:
                    out.append((tokens, segments, 0, tokens, segments, 0))
                    continue
                tree = Tree(words, characters, per)
                again = sum(tree.edit(e, counter) for e in edits)
                out.append((tokens, segments, len(edits), tree.tokens, tree.segments, again))
            yield pa.record_batch([batch.column(0), *(pa.array([r[c] for r in out], pa.int64()) for c in range(6))], names=["id", *(c.split()[0] for c in _COLUMNS.split(", "))])

    return run


def recount(docs: DataFrame, tokenizer_path: str, edits: str | Callable[[str], list[Edit]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, counts before and after its edits, and how many pre-tokens the edits encoded again.

    ``edits`` names a column of array<struct<at, removed, inserted>> or is a function from a text to its edits.
    """
    short_batches(docs.sparkSession)
    source = tokenizer_json(tokenizer_path)
    kind = docs.schema[id_col].dataType.simpleString()
    given = F.col(edits) if isinstance(edits, str) else F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), split_words(F.col(text_col), source).alias("words"), given.alias("edits"))
    return rows.mapInArrow(_counted(source, None if isinstance(edits, str) else edits), f"id {kind}, {_COLUMNS}").withColumnRenamed("id", id_col)


def _sums(source: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(source)
        for batch in batches:
            out = [per.tolist() for *_, per in _batches(batch, counter)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["id", "segments", "tokens"])

    return run


def trees(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The leaves to keep: id, segments (pre-tokens in order) and tokens (their counts)."""
    short_batches(docs.sparkSession)
    source = tokenizer_json(tokenizer_path)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), split_words(F.col(text_col), source).alias("segments"))
    return rows.mapInArrow(_sums(source), f"id {kind}, segments array<string>, tokens array<int>").withColumnRenamed("id", id_col)


def _updated(source: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(source)
        for batch in batches:
            segments, tokens, total = [], [], []
            for i in range(len(batch)):
                tree = Tree.of(batch.column(1)[i].as_py() or [], batch.column(2)[i].as_py() or [])
                for e in batch.column(3)[i].as_py() or ():
                    tree.edit((e["at"], e["removed"], e["inserted"] or ""), counter)
                segments.append([w for w, _ in tree.leaves()])
                tokens.append([c for _, c in tree.leaves()])
                total.append(tree.tokens)
            yield pa.record_batch([batch.column(0), pa.array(segments, pa.list_(pa.string())), pa.array(tokens, pa.list_(pa.int32())), pa.array(total, pa.int64())], names=["id", "segments", "tokens", "n_tokens"])

    return run


def updated(kept: DataFrame, tokenizer_path: str, edits_col: str, id_col: str = "doc_id") -> DataFrame:
    """Kept trees with a column of edits, after these edits: id, segments, tokens, n_tokens."""
    kind = kept.schema[id_col].dataType.simpleString()
    rows = kept.select(F.col(id_col).alias("id"), "segments", "tokens", F.col(edits_col).alias("edits"))
    return rows.mapInArrow(_updated(tokenizer_json(tokenizer_path)), f"id {kind}, segments array<string>, tokens array<int>, n_tokens long").withColumnRenamed("id", id_col)


_MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_NUMBER = re.compile(r"(?<![\w.])(?:\d{1,3}(?:\.\d{1,3}){3}|\d{9,})(?!\w)", re.ASCII)
_DIGIT = re.compile(r"[0-9]")


def redactions(text: str) -> list[Edit]:
    """Edits that replace mail addresses, IP addresses and long numbers, last one first, and end the text with a line feed."""
    spans = [m.span() for m in _MAIL.finditer(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [m.span() for m in _NUMBER.finditer(text) if not any(a < m.end() and m.start() < b for a, b in spans)]
    found = [(a, b - a, "[redacted]") for a, b in sorted(spans, reverse=True)]
    return found if text.endswith("\n") else [(len(text), 0, "\n"), *found]
