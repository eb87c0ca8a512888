"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of words without their outer punctuation, in lower
case. Numbers, names and units are slots: they are replaced with a
placeholder of their type. Windows of five template words of the documents are
hash-joined with those of the benchmark items. Windows that lie on the same
diagonal of a document and an item are aligned; their slots must be
consistent: within a type, one value of the item stands for one value of the
document and the other way round. A document is contaminated by an item when
consistent windows cover 80 % of the item's windows or more. This finds exact
passages and re-parameterised ones, whose numbers, names or units were changed.

Windows are joined in three forms: with names as slots, with names as plain
words (so that letter case doesn't count), and, where those don't cover an item,
with every run of name words as one slot, so that a name may become longer or
shorter. A window counts if it meets in the first or the second form.

* number: digits with inner ``. , : / -``; unit: a word of ``UNITS``;
* name: a capitalised word that doesn't begin a sentence; line breaks don't count.
  A run of names ends at punctuation;
* a window of slots only is compared by its words instead;
* an item of fewer than five words is one window.

1. Of an item's W windows, ceil(0.8 W) must be covered, so a contaminated
   document has one of any W - ceil(0.8 W) + 1 of them. The rarest ones among
   the items are the item's probes.
2. Documents are read once. A filter of the probes (``FILTER_BITS`` at most, whatever
   the number of items) drops the documents without a probe; they are never shuffled.
3. The others' windows are hash-joined with the probes in Spark, and the pairs of
   document and item that this gives are aligned and checked on the whole texts.

An occurrence is looked for around the diagonal (document place minus item
place) on which most windows meet, then around the next one farther than half
an item's length from it, and so on, among those with half as many windows or more
as the fullest. Diagonals within an item's length of it are taken
fullest first; a window counts if its slots agree with those taken before. Each
further diagonal costs four windows, so the first one has a share of the windows
needed, or there is no occurrence.

Cases: null and empty texts have no windows and match nothing; an empty
benchmark matches nothing; null ids are kept; items and documents that repeat
are reported once for each row of ``docs``, items that repeat count once; ids may be of
any type; other columns are carried along by ``clean``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamer.llm.kernels import LOWER, U64, blocks, folded, mix, word_hashes, words
from roamer.llm.store import BLOCK_BITS, bit_blocks, dropped, lean, row_hash, short_batches, without, written

WINDOW = 5
#: Consistent windows per 100 windows of an item.
COVER = 80
#: log2 of the most bits of the probes' filter (32 MB), its bits for each probe and how many of them a probe sets.
FILTER_BITS, BITS_A_PROBE, PROBE_BITS = 28, 32, 3

#: Words for units of measure.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds "
    "ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp percent degree degrees celsius fahrenheit kelvin hz khz mhz ghz w kw kwh v j kj n pa kpa mph kph kmh"
).split()

NUMBER, NAME, UNIT = 1, 2, 3

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_OTHER = np.ones(256, np.int32)
_OTHER[[*range(48, 58), *b".,:/-"]] = 0
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:;")] = True


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.sort(word_hashes(data, *words(data, np.array([0, len(data)]))))


_UNITS = _unit_hashes()


def _trimmed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with a letter or digit: start and end from its first to its last one, and with the punctuation around."""
    starts, ends = words(data, offsets)
    inside = np.concatenate([[0], np.cumsum(_ALNUM[data])])
    some = inside[ends] > inside[starts]
    raw_start, raw_end = starts[some], ends[some]
    places = np.flatnonzero(_ALNUM[data])
    if not len(raw_start):
        return raw_start, raw_end, raw_start, raw_end
    return places[np.searchsorted(places, raw_start)], places[np.searchsorted(places, raw_end) - 1] + 1, raw_start, raw_end


def _lower_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hashes of the words in lower case of all alphabets."""
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    low = pc.utf8_lower(texts)
    there = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    lowered = np.frombuffer(low.buffers()[2] or b"", np.uint8)
    return word_hashes(lowered, *_trimmed(lowered, there)[:2])


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, slot types, bounds of the texts among the words, whether a word is a name that goes on the name before)."""
    starts, ends, raw_start, raw_end = _trimmed(data, offsets)
    hashes = _lower_hashes(data, offsets) if (data >= 128).any() else word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    kind, goes_on = np.zeros(len(starts), np.int8), np.zeros(len(starts), bool)
    if not len(starts):
        return hashes, kind, bounds, goes_on
    first = np.ones(len(starts), bool)
    first[1:] = _ENDS[data[raw_end[:-1] - 1]]
    first[bounds[:-1][bounds[:-1] < len(starts)]] = True
    a, b = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
    longer = ends - starts > 1
    capital = ((a >= 65) & (a <= 90) & longer & ((LOWER[b] == b) & (b >= 97))) | ((a == 0xC3) & (b >= 0x80) & (b <= 0x9E) & (ends - starts > 2) & (data[np.minimum(starts + 2, len(data) - 1)] >= 97))
    kind[capital & ~first] = NAME
    kind[np.isin(hashes, _UNITS)] = UNIT
    digits, others = np.concatenate([[0], np.cumsum(_DIGIT[data])]), np.concatenate([[0], np.cumsum(_OTHER[data])])
    kind[(digits[ends] > digits[starts]) & (others[ends] == others[starts])] = NUMBER
    goes_on[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & (raw_end[:-1] == ends[:-1]) & (raw_start[1:] == starts[1:])
    goes_on[bounds[:-1][bounds[:-1] < len(starts)]] = False
    return hashes, kind, bounds, goes_on


def nameless(kind: np.ndarray) -> np.ndarray:
    """The slot types with names as plain words."""
    return np.where(kind == NAME, 0, kind).astype(np.int8)


def runs(hashes: np.ndarray, kind: np.ndarray, bounds: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, slot types, bounds) with each run of name words as one."""
    heads = np.flatnonzero(~goes_on)
    if len(heads) == len(hashes):
        return hashes, kind, bounds
    place = np.arange(len(hashes)) - heads[np.cumsum(~goes_on) - 1]
    power = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(int(place.max()), 0x9E3779B97F4A7C15, U64)]))
    return np.add.reduceat(hashes * power[place], heads), kind[heads], np.searchsorted(heads, bounds)


def windows(hashes: np.ndarray, kind: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """The template hash of every window of k words."""
    typed = np.where(kind > 0, mix(kind.astype(U64)), hashes)
    out = folded(typed, k)
    if len(out):
        slots = np.concatenate([[0], np.cumsum(kind > 0)])
        whole = slots[k:] - slots[:-k] == k
        out[whole] = mix(folded(hashes, k)[whole] + U64(1))
    return out


class Form:
    """A sequence of words and slots, to be found in documents."""

    def __init__(self, hashes: np.ndarray, kind: np.ndarray) -> None:
        self.hashes, self.kind, self.k = hashes, kind, min(WINDOW, len(hashes))
        self.typed, self.plain = windows(hashes, kind, self.k), windows(hashes, nameless(kind), self.k)
        # A document may hold an item in mid-sentence, where its first word, if capitalised, is a name.
        self.begin = windows(hashes[: self.k], np.concatenate([[NAME], kind[1 : self.k]]).astype(np.int8), self.k)[0]
        self.total = len(self.typed)

    def variants(self) -> list[set[int]]:
        """The window hashes that count for each place."""
        found = [{int(a), int(b)} for a, b in zip(self.typed, self.plain, strict=True)]
        found[0].add(int(self.begin))
        return found


def forms(text: str | None) -> tuple[list[Form], list[Form]]:
    """(the item's words, its forms with every run of names as one): none or one, and none to two."""
    own, folds = [], []
    for _, data, offsets in blocks(pa.array([text], pa.string())):
        h, t, _, goes_on = template(data, offsets)
        if not len(h):
            continue
        own.append(Form(h, t))
        if (t != NAME).all():
            continue
        fold = lambda kind, on: runs(h, kind, np.array([0, len(h)]), on)[:2]  # noqa: B023, E731
        both = [fold(t, goes_on)]
        if len(h) > 1 and t[0] == 0 and t[1] == NAME:  # in mid-sentence, the first word may go on to the name
            both.append(fold(np.concatenate([[NAME], t[1:]]).astype(np.int8), np.concatenate([[False, True], goes_on[2:]])))
        folds += [Form(*f) for f in both if len(f[0]) >= WINDOW]
    return own, folds


class Place:
    """The windows of k words of one document, by hash."""

    def __init__(self, hashes: np.ndarray, kind: np.ndarray, k: int) -> None:
        self.hashes, self.kind = hashes, kind
        self.typed, self.plain = windows(hashes, kind, k), windows(hashes, nameless(kind), k)
        differ = np.flatnonzero(self.typed != self.plain)
        values, at = np.concatenate([self.typed, self.plain[differ]]), np.concatenate([np.arange(len(self.typed)), differ])
        order = np.argsort(values, kind="stable")
        self.values, self.at = values[order], at[order]

    def places(self, hashes: set[int]) -> np.ndarray:
        found = []
        for v in hashes:
            a, b = (int(np.searchsorted(self.values, U64(v), side)) for side in ("left", "right"))
            found.append(self.at[a:b])
        return np.unique(np.concatenate(found))


def occurrence(form: Form, doc: Place, cover: int = COVER) -> tuple[int, bool] | None:
    """(covered windows, whether a slot differs) of the best occurrence of a form, if it covers enough.

    Work and memory grow with the product of the lengths at most, in steps over arrays.
    """
    total, last = form.total, len(doc.typed)
    counts, some = np.zeros(total + last, np.int32), 0
    for q, hashes in enumerate(form.variants()):
        at = doc.places(hashes)
        counts[at - q + total - 1] += 1
        some += len(at) > 0
    if not some or 100 * some < cover * total:
        return None
    top = int(counts.max())
    span = len(form.hashes)

    def met(g: int) -> np.ndarray:
        """The item's places whose window meets on a diagonal."""
        a, b = max(0, -g), min(total, last - g)
        own, names = (x[a + g : b + g] for x in (doc.typed, doc.plain))
        hit = (own == form.typed[a:b]) | (own == form.plain[a:b]) | (names == form.typed[a:b]) | (names == form.plain[a:b])
        if a == 0 and b > 0 and form.begin in (own[0], names[0]):
            hit[0] = True
        return np.flatnonzero(hit) + a

    def agree(g: int, places: np.ndarray, there: dict, back: dict) -> tuple[list[int], bool]:
        """Those places whose slots agree with the ones before, and whether a slot differs; the slots are taken."""
        words = np.unique((places[:, None] + np.arange(form.k)).ravel())
        types = np.where(doc.kind[words + g] > 0, doc.kind[words + g], form.kind[words])
        is_slot = types > 0
        if not is_slot.any():
            return places.tolist(), False
        own = words[is_slot]
        slots = list(zip(types[is_slot].tolist(), form.hashes[own].tolist(), doc.hashes[own + g].tolist(), strict=True))
        bad = np.zeros(len(form.hashes) + 1, np.int32)
        bad[own + 1] = [there.get((t, u), v) != v or back.get((t, v), u) != u for t, u, v in slots]
        bad = np.cumsum(bad)
        slots = dict(zip(own.tolist(), slots, strict=True))
        fits, changed = [], False
        for q in places[bad[places + form.k] == bad[places]].tolist():  # the others disagree with what was taken on other diagonals
            some_ = [slots[r] for r in range(q, q + form.k) if r in slots]
            new, gone = {(t, u): v for t, u, v in some_}, {(t, v): u for t, u, v in some_}
            if all(new[t, u] == v == there.get((t, u), v) and gone[t, v] == u == back.get((t, v), u) for t, u, v in some_):
                there |= new
                back |= gone
                changed |= any(u != v for _, u, v in some_)
                fits.append(q)
        return fits, changed

    leads = np.flatnonzero(counts * 2 >= top) - total + 1
    leads = leads[np.lexsort((np.abs(leads), -counts[leads + total - 1]))]
    need = -(-cover * total // 100)
    least = -(-need // ((total - need) // max(1, form.k - 1) + 1))  # a break between diagonals costs k - 1 windows
    best = (0, True)
    while len(leads):
        lead = int(leads[0])
        leads = leads[np.abs(leads - lead) * 2 > span]
        there, back, covered, changed = {}, {}, set(), False
        near = np.arange(max(lead - span, 1 - total), min(lead + span, last - 1) + 1)
        near = near[counts[near + total - 1] > 0]
        near = near[np.lexsort((near, -counts[near + total - 1], near != lead))]
        for g in near.tolist():
            places = met(g)
            places = places[[q not in covered for q in places.tolist()]] if covered else places
            if len(places):
                fits, differs = agree(g, places, there, back)
                covered.update(fits)
                changed |= differs
            if len(covered) == some or len(covered) < least:  # nothing is left to cover, or the first one is too poor
                break
        best = max(best, (len(covered), not changed))
        if best[0] == some and best[1]:
            break
    return (best[0], not best[1]) if 100 * best[0] >= cover * total else None


def matched(text: str | None, items: list[tuple[list[Form], list[Form]]]) -> list[tuple[int, int, int, bool]]:
    """(item, covered windows, all windows, whether a slot differs) of the items that contaminate a text."""
    found = []
    for _, data, offsets in blocks(pa.array([text], pa.string())):
        h, t, bounds, goes_on = template(data, offsets)
        folded_h, folded_t, _ = runs(h, t, bounds, goes_on)
        known: dict[tuple[bool, int], Place] = {}
        for i, (own, folds) in enumerate(items):
            for is_fold, form in [(False, f) for f in own] + [(True, f) for f in folds]:
                words, kinds = (folded_h, folded_t) if is_fold else (h, t)
                if len(words) < form.k:
                    continue
                if (is_fold, form.k) not in known:
                    known[is_fold, form.k] = Place(words, kinds, form.k)
                if best := occurrence(form, known[is_fold, form.k]):
                    found.append((i, best[0], form.total, best[1]))
                    break
    return found


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, form, place, total, k, key) of every window of the items."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own, folds = forms(text)
            for f, form in enumerate(own + folds):
                rows += [(item, f, q, form.total, form.k, key) for q, keys in enumerate(form.variants()) for key in sorted(keys)]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        signed = np.array(columns[5], U64).astype(np.int64)
        yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(signed)], names=["item", "form", "place", "total", "k", "key"])


def probes(items: DataFrame, cover: int = COVER) -> DataFrame:
    """(key, item, k): the window hashes of which a document contaminated by the item has one at least."""
    held = written(items.select("item", "text").mapInArrow(lean(_item_windows), "item long, form long, place long, total long, k long, key long"), "decontam-windows")
    often = held.groupBy("key").agg(F.count_distinct("item").alias("items"))
    each = held.join(often, "key").groupBy("item", "form", "place", "total").agg(F.sum("items").alias("items"), F.collect_set(F.struct("key", "k")).alias("keys"))
    rank = F.row_number().over(Window.partitionBy("item", "form").orderBy("items", "place"))  # within one item
    enough = F.col("total") - F.floor((F.col("total") * cover + 99) / 100) + 1
    chosen = each.withColumn("rank", rank).where(F.col("rank") <= enough)
    found = written(chosen.select("item", F.explode("keys").alias("x")).select("x.key", "item", "x.k").distinct(), "decontam-probes")
    dropped(held)
    return found


def _filter(found: DataFrame) -> tuple[np.ndarray, list[int]]:
    """(bits as 64-bit words, lengths of the windows) of the probes: at most 2^FILTER_BITS bits come to the driver."""
    size = max(15, min(FILTER_BITS, (found.count() * BITS_A_PROBE).bit_length()))
    bit = lambda i: F.shiftright("key", 12 * i).bitwiseAND(F.lit((1 << size) - 1))
    bits = found.select(F.explode(F.array(*[bit(i) for i in range(PROBE_BITS)])).alias("at"))
    words = np.zeros(1 << (size - 6), U64)
    for block, own in bit_blocks(bits.select((F.col("at") / F.lit(BLOCK_BITS)).cast("long").alias("block"), (F.col("at") % BLOCK_BITS).alias("bit"))).collect():
        words[block * 512 : block * 512 + 512] = np.array(own, np.int64).view(U64)
    return words, sorted(r[0] for r in found.select("k").distinct().collect())


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key."""
    out, mask = np.ones(len(keys), bool), len(words) * 64 - 1
    for i in range(PROBE_BITS):
        at = (keys.view(np.int64) >> np.int64(12 * i)) & np.int64(mask)
        place = (56 - ((at >> 3) & 7) * 8 + (at & 7)).astype(U64)
        out &= (words[at >> 6] >> place) & U64(1) > 0
    return out


def _hits(words: np.ndarray, lengths: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits = [], []
            for first, data, offsets in blocks(batch.column(1)):
                h, t, bounds, goes_on = template(data, offsets)
                found: dict[int, set[int]] = {}
                for words_, kinds, ends in ((h, t, bounds), runs(h, t, bounds, goes_on)):
                    for k in lengths:
                        typed = windows(words_, kinds, k)
                        plain = windows(words_, nameless(kinds), k) if (kinds == NAME).any() else typed
                        for keys in (typed, plain) if plain is not typed else (typed,):
                            at = np.flatnonzero(may_hold(words, keys))
                            doc = np.searchsorted(ends, at, "right") - 1
                            inside = at + k <= ends[doc + 1]
                            for d, v in zip(doc[inside].tolist(), keys[at[inside]].view(np.int64).tolist(), strict=True):
                                found.setdefault(d, set()).add(v)
                    if not goes_on.any():
                        break
                for d in sorted(found):
                    rows.append(first + d)
                    hits.append(sorted(found[d]))
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(hits, pa.list_(pa.int64()))], names=["id", "text", "row", "hits"])

    return run


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = lru_cache(maxsize=4096)(forms)
    for batch in batches:
        rows, out, ids = [], [], []
        for i, (text, items) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            items = items.as_py()
            for at, *rest in matched(text.as_py(), [known(x["text"]) for x in items]):
                rows.append(i)
                out.append(rest)
                ids.append(items[at]["id"])
        at = pa.array(rows, pa.int64())
        kind = batch.column(3).type.value_type.field("id").type
        yield pa.record_batch(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(ids, kind), *(pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.bool_())))],
            names=["id", "row", "item_id", "n_matched", "n_windows", "reparameterised"],
        )


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(id, row, item_id, n_matched, n_windows, reparameterised) of each contaminated row and item."""
    short_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("id"), F.coalesce(item_text, F.lit("")).alias("text")).distinct()
    items = written(items.select(F.monotonically_increasing_id().alias("item"), "id", "text"), "decontam-items")
    keys = probes(items)
    words, lengths = _filter(keys)
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), row_hash(F.col(id_col), F.col(text_col)).alias("row"))
    kind, item_kind = plain.schema["id"].dataType.simpleString(), items.schema["id"].dataType.simpleString()
    some = plain.mapInArrow(lean(_hits(words, lengths)), f"id {kind}, text string, row long, hits array<long>")
    some = written(some.select(F.monotonically_increasing_id().alias("num"), "id", "text", "row", "hits"), "decontam-hits")
    pairs = some.select("num", F.explode("hits").alias("key")).join(keys, "key").select("num", "item").distinct()
    each = written(pairs.join(items, "item").groupBy("num").agg(F.collect_list(F.struct("id", "text")).alias("items")), "decontam-pairs")
    ready = some.select("num", "id", "row", "text").join(each, "num").select("id", "row", "text", "items")
    return ready.mapInArrow(lean(_checked), f"id {kind}, row long, item_id {item_kind}, n_matched long, n_windows long, reparameterised boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that contaminates it: id, item_id, n_matched, n_windows, reparameterised."""
    return _found(docs, benchmark, id_col, text_col, item_col, item_text).drop("row").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns; only rows that a filter can't keep are shuffled."""
    gone = written(_found(docs, benchmark, id_col, text_col, item_col, item_text).select(F.col("row").alias("gone")).distinct(), "decontam-gone")
    return without(docs, gone, id_col, text_col)
