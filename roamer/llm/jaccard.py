"""Exact Jaccard join of shingle sets as a T-occurrence search with DivideSkip.

A document with n shingles can only be linked, at similarity t, to one that
occurs in T = ceil(t n) of its n inverted lists. DivideSkip sets the L longest
lists aside, heap-merges the others, skipping what can't be met T - L times, and
probes the long ones by binary search. Spread over a cluster that becomes:

1. Equal sets are one class; only classes are searched.
2. A fixed order of the lists takes n - T + l of each document's lists. Any
   partner occurs in at least l of these. Their lengths are counted over the
   whole corpus, and documents with too few lists longer than one are done.
3. Within what step 2 took, the shortest lists (by counted length) that still
   must hold a partner once hold every linked pair. Each list has a hub, its
   least document.
4. A hub that more than ``HOT`` documents meet most often is compared with
   these, in blocks: a family of near copies becomes one component in one pass.
   Lists within one component are done.
5. The documents of a list that remains are compared by sketches: a bit for each
   of some buckets, set if an odd number of shingles fall there. Sets differ by
   as many shingles as their sketches by bits at least, so no linked pair is
   lost, and few others stay. Lists of more than ``PART`` documents are dealt
   into parts that meet in pairs. Of the pairs that stay only those are handed
   on that join two trees, so there are fewer than documents of the lists.
6. What stays forms groups, and linked documents share a group. A group is
   searched with DivideSkip (``Group``), with only unreached documents as
   candidates. Large groups are dealt into blocks of ``BLOCK`` classes and
   ``WEIGHT`` shingles at most (one class at least), and blocks meet in pairs; a
   large component of step 4 has blocks of its own, which don't meet each other.

Similarity is tested as den * |x n y| >= num * |x u y| on whole sets.

Shingles are compared as 64-bit hashes, sets as 128-bit hashes of their hashes.

Cases: null text is empty; a document without words has no shingle and no
link; ids may be of any type that has an order; a null id is linked like others
but is no component's id (null if a component has no other); rows
repeating a text are one class; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamer.llm.components import components
from roamer.llm.kernels import U64, mix, shingle_sets
from roamer.llm.store import dropped, filtered, lean, row_hash, short_batches, without, written

#: Classes and shingles of a block; two blocks are searched together.
BLOCK, WEIGHT = 512, 1 << 21
#: From so many documents on, a hub is compared with them before groups are formed.
HOT = 128
#: Documents of a part of a list; two parts are compared together.
PART = 1024
#: Cost of merging a list against probing it, as in DivideSkip's L = T / (MU log2 M + 1), M the longest list.
MU = 0.0085


def required(n: int, num: int, den: int) -> int:
    """T: in how many of n lists a partner occurs at least."""
    return -(-num * n // den)


def slack(n: int, num: int, den: int) -> int:
    """l: how many lists more than the n - T + 1 needed are taken, plus one."""
    return n * (den - num) // (4 * den) + 1


def taken(n: int, num: int, den: int) -> int:
    return min(n, n - required(n, num, den) + slack(n, num, den))


def merged(n: int, num: int, den: int) -> int:
    """How many of the taken lists, in order of length, must hold a partner once."""
    return taken(n, num, den) - slack(required(n, num, den), num, den) + 1


def set_hash(s: np.ndarray) -> bytes:
    """128 bits of a set of shingles."""
    sums = [np.add.reduce(mix(s ^ salt)) for salt in (U64(0), U64(0x5851F42D4C957F2D))]
    return mix(np.array(sums, U64) + U64(len(s))).tobytes()


def _order(s: np.ndarray) -> np.ndarray:
    """The fixed order of the lists: a second scramble, so that it is no order of the set hash."""
    return s[np.argsort(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)))]


def sketch(s: np.ndarray, num: int, den: int) -> bytes:
    """Parities of the numbers of shingles in 2^j buckets, four times as many as linked sets of this size differ by at least."""
    bits = 64
    while bits * (num + den) < 8 * len(s) * (den - num):
        bits *= 2
    at = (mix(s ^ U64(0x3C6EF372FE94F82B)) % U64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as sketches of n words."""
    while words.shape[1] > n:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _trees(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Those pairs, one after the other, that join two trees; ``root`` has the root of every node, before and after."""
    kept, up = [], {}
    for a, b in zip(root[x].tolist(), root[y].tolist(), strict=True):
        a, b = (_top(up, c) for c in (a, b))
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append((min(a, b), max(a, b)))
    if up:
        to = np.arange(len(root))
        to[list(up)] = [_top(up, c) for c in up]
        root[:] = to[root]
    return kept


def _top(up: dict[int, int], c: int) -> int:
    while c in up:
        if up[c] in up:
            up[c] = up[up[c]]
        c = up[c]
    return c


def _near(num: int, den: int):
    """Links that join, in trees, the documents of a list's cell, of different components, whose sketches don't rule out a link.

    Cells are whole and sorted. What is joined already isn't compared again, so there are fewer links than documents.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compared(rows: pa.Table) -> pa.RecordBatch:
        cell, node, n, comp, part, cross, home = (rows.column(c).to_numpy() for c in ("cell", "num", "n", "comp", "part", "cross", "home"))
        sketches = rows.column("sketch").combine_chunks()
        ends = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset : sketches.offset + len(sketches) + 1].astype(np.int64)
        width, place = np.diff(ends) // 8, ends[:-1] // 8
        data = np.frombuffer(sketches.buffers()[2], "<u8", ends[-1] // 8)
        words = {w: data[place[width == w][:, None] + np.arange(w)] for w in np.unique(width).tolist()}
        index = np.zeros(len(width), np.int64)  # a row's place among those of its width
        for w in words:
            index[width == w] = np.arange(len(words[w]))
        nodes, at = np.unique(node, return_inverse=True)
        out, root, first, shift = [], np.arange(len(nodes)), np.arange(len(cell) - 1), 1
        while len(first := first[first + shift < len(cell)]):
            first = first[cell[first] == cell[first + shift]]
            a, b = first, first + shift
            use = (root[at[a]] != root[at[b]]) & (comp[a] != comp[b]) & (home[a] | home[b]) & ~(cross[a] & (part[a] == part[b]))
            size = n[a] + n[b]
            use &= np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num
            a, b, size = a[use], b[use], size[use]
            for wa, wb in np.unique(np.stack([width[a], width[b]]), axis=1).T.tolist() if len(a) else ():
                of = (width[a] == wa) & (width[b] == wb)
                x, y, least = a[of], b[of], min(wa, wb)
                apart = np.bitwise_count(folded(words[wa][index[x]], least) ^ folded(words[wb][index[y]], least)).sum(axis=1, dtype=np.int64)
                near = apart * (num + den) <= size[of] * (den - num)
                out += _trees(root, at[x[near]], at[y[near]])
            shift += 1
        pairs = nodes[np.array(out, np.int64).reshape(-1, 2)]
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(map(len, kept)) < 4 * PART:
                continue
            rows = pa.Table.from_batches(kept)
            cell = rows.column("cell").to_numpy()
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if whole:
                yield compared(rows.slice(0, whole))
            kept = rows.slice(whole).to_batches()
        if kept:
            yield compared(pa.Table.from_batches(kept))

    return run


def _sets(num: int, den: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            seen, n, cls, keys, sketches = set(), [], [], [], []
            for s in shingle_sets(batch.column(2), k):
                n.append(len(s))
                cls.append(set_hash(s) if len(s) else None)
                new = len(s) and cls[-1] not in seen
                seen.add(cls[-1])
                keys.append(_order(s)[: taken(len(s), num, den)].astype(np.int64) if new else None)
                sketches.append(sketch(s, num, den) if new else None)
            numbers = pa.array(np.arange(number, number + len(batch)))
            number += len(batch)
            yield pa.record_batch([batch.column(0), batch.column(1), numbers, pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["id", "row", "num", "n", "cls", "keys", "sketch"])

    return run


def long_lists(t: int, longest: int) -> int:
    """L: how many of the longest lists are probed, not merged."""
    return min(t - 1, int(t / (MU * math.log2(max(longest, 1)) + 1)))


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(value, count) of the values in at least so many of the sorted lists.

    A heap holds the front of each list. A value met too seldom is popped together with the next ones until
    ``least`` - 1 fronts are off the heap: what lies below the new top can't be met often enough and is skipped
    in these lists by binary search.
    """
    heap = [(m[0], i) for i, m in enumerate(lists) if m]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        target = top + 1
        if len(popped) >= least:
            yield top, len(popped)
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            target = max(target, heap[0][0])
        for i in popped:
            at[i] = bisect_left(lists[i], target, at[i])
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))


class Group:
    """DivideSkip over the inverted lists of the sets of one or two blocks.

    ``comps`` are known components, whose sets aren't compared with each other; with ``sides``, only sets of
    different sides are compared.
    """

    def __init__(self, sets: list[np.ndarray], num: int, den: int, comps: list[int] | None = None, sides: list[int] | None = None) -> None:
        self.sets, self.num, self.den = sets, num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.comps = list(range(len(sets))) if comps is None else comps
        self.sides = None if sides is None else np.array(sides)
        self.open = np.ones(len(sets), bool)
        self.left = self.indexed = len(sets)
        docs, values = np.repeat(np.arange(len(sets)), self.sizes), np.concatenate(sets)
        self.keys, rank = np.unique(values, return_inverse=True)
        self.codes = np.sort(rank * len(sets) + docs)  # list by list, each sorted by document
        self._bounds()

    def _bounds(self) -> None:
        self.first = np.searchsorted(self.codes, np.arange(len(self.keys) + 1) * len(self.sets))
        self.length = np.diff(self.first)

    def close(self, members: list[int]) -> None:
        """These are reached; lists drop what is reached when half of their documents are."""
        self.open[members] = False
        self.left -= len(members)
        if self.left * 2 < self.indexed:
            self.codes = self.codes[self.open[self.codes % len(self.sets)]]
            self.indexed = self.left
            self._bounds()

    def divided(self, x: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(short lists to merge, long lists to probe, T - L) of a set; nothing to merge if no set can be met T times."""
        t = required(len(self.sets[x]), self.num, self.den)
        lists = np.searchsorted(self.keys, self.sets[x])
        lists = lists[self.length[lists] > 0]
        if len(lists) < t:
            return lists[:0], lists, t
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        aside = long_lists(t, int(self.length[lists[-1]]))
        return lists[: len(lists) - aside], lists[len(lists) - aside :], t - aside

    def probe(self, y: int, met: int, long: np.ndarray, enough: int) -> bool:
        """Whether a document met so often in short lists is in enough lists, by binary search in the long ones."""
        for a in range(0, len(long), 128):
            if met >= enough or met + len(long) - a < enough:
                break
            code = long[a : a + 128] * len(self.sets) + y
            at = np.searchsorted(self.codes, code)
            met += int(np.count_nonzero(self.codes[np.minimum(at, len(self.codes) - 1)] == code))
        return met >= enough

    def partners(self, x: int) -> list[int]:
        """The unreached sets linked to x."""
        if not self.left:
            return []
        short, long, least = self.divided(x)
        if not len(short):
            return []
        usable = self.open if self.sides is None else self.open & (self.sides != self.sides[x])
        merged_lists = []
        for i in short.tolist():
            docs = self.codes[self.first[i] : self.first[i + 1]] - i * len(self.sets)
            merged_lists.append(docs[usable[docs]].tolist())
        n, found = len(self.sets[x]), []
        for y, met in merge_skip(merged_lists, least):
            size = int(self.sizes[y])
            enough = -(-self.num * (n + size) // (self.num + self.den))  # den * both >= num * (n + size - both)
            if enough <= min(n, size) and self.probe(y, met, long, enough):
                found.append(y)
        return found

    def links(self) -> list[tuple[int, int]]:
        """Links that join all that is linked, besides the known components."""
        members: dict[int, list[int]] = {}
        for x, c in enumerate(self.comps):
            members.setdefault(c, []).append(x)
        out = []
        for own in sorted(members.values(), key=len):  # the largest component comes last, when nothing is left to look for
            if not self.open[own[0]]:
                continue
            self.close(own)
            queue = list(own)
            while queue:
                x = queue.pop()
                for y in self.partners(x):
                    if not self.open[y]:  # reached with its component just now
                        continue
                    out.append((y, x))
                    self.close(members[self.comps[y]])
                    queue += members[self.comps[y]]
        return out


def _search(num: int, den: int, k: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solved(rows: list[tuple[int, bytes, int, int]], texts: list[pa.Array]) -> pa.RecordBatch:
        found: dict[int, tuple] = {}
        for (number, cls, comp, side), s in zip(rows, (s for t in texts for s in shingle_sets(t, k)), strict=True):
            if set_hash(s) == cls:  # another text may have the same row hash
                found[number] = (s, comp, side)
        nodes = sorted(found)
        pairs = []
        if len(nodes) > 1:
            sets, comps, sides = (list(x) for x in zip(*(found[c] for c in nodes), strict=True))
            group = Group(sets, num, den, comps, None if min(sides) < 0 else sides)
            pairs = [(nodes[a], nodes[b]) for a, b in group.links()]
        return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, texts = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True))
            own = list(zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if keys[start] != key:
                        if len(rows) > 1:
                            yield solved(rows, texts)
                        key, rows, texts = keys[start], [], []
                    rows += own[start:i]
                    texts.append(batch.column(6).slice(start, i - start))
                    start = i
        if len(rows) > 1:
            yield solved(rows, texts)

    return run


def _linked(plain: DataFrame, classes: DataFrame, jobs: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """Links (a, b) that the jobs find: (i, j) and for each class num, comp and side; texts are shuffled once to a row of jobs."""
    wanted = jobs.groupBy("num").agg(F.collect_list(F.struct("i", "j", "comp", "side")).alias("jobs"))
    wanted = written(wanted.join(classes.select("num", "cls", "row"), "num"), "jaccard-wanted")
    texts = filtered(plain, F.col("row"), wanted, "row").where("maybe").groupBy("row").agg(F.first("text").alias("text"))
    work = wanted.join(texts, "row").select("num", "cls", F.explode("jobs").alias("job"), "text").select("job.i", "job.j", "num", "cls", "job.comp", "job.side", "text")
    work = work.repartition("i", "j").sortWithinPartitions("i", "j")
    links = written(work.mapInArrow(lean(_search(num, den, k)), "a long, b long"), "jaccard-links")
    dropped(wanted)
    return links


def _blocks(groups: DataFrame) -> DataFrame:
    """The jobs of groups (num, root, comp, n): pairs of blocks."""
    parts = lambda n, w: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(w / F.lit(WEIGHT))).cast("int")
    sizes = groups.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("w"))
    large = F.when((F.col("n") > BLOCK // 4) | (F.col("w") > WEIGHT // 4), F.col("comp"))
    sizes = written(sizes.withColumn("large", large).withColumn("pool", F.xxhash64("root", F.coalesce("large", F.lit(-1)))), "jaccard-sizes")
    pools = sizes.groupBy("root", "pool", "large").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).select("root", "pool", "large", parts(F.col("n"), F.col("w")).alias("parts"))
    pools = written(pools, "jaccard-pools")
    blocks = pools.select("root", "large", "pool", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("root", "large", F.xxhash64("pool", "part").alias("block"))
    other = blocks.select("root", F.col("large").alias("large2"), F.col("block").alias("block2"))
    pairs = blocks.join(other, "root").where(F.col("large").isNull() & F.col("large2").isNull() | ~F.col("large").eqNullSafe(F.col("large2")))
    pairs = pairs.select("block", F.least("block", "block2").alias("i"), F.greatest("block", "block2").alias("j"))
    placed = groups.join(sizes.select("root", "comp", "pool"), ["root", "comp"]).join(pools.select("pool", "parts"), "pool")
    placed = placed.select("num", "comp", F.xxhash64("pool", F.pmod(F.xxhash64("num"), F.col("parts")).cast("int")).alias("block"))
    return placed.join(pairs, "block").select("i", "j", "num", "comp", F.when(F.col("i") == F.col("j"), -1).otherwise((F.col("block") == F.col("j")).cast("int")).alias("side"))


def link(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): (id, row, n, cls) of every row, (cls, num, least id, rows) of every class, (num, root) of the linked ones."""
    short_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", row_hash(F.col("id"), F.col("text")))
    kind = plain.schema["id"].dataType.simpleString()
    whole = written(plain.select("id", "row", "text").mapInArrow(lean(_sets(num, den, k)), f"id {kind}, row long, num long, n long, cls binary, keys array<long>, sketch binary"), "jaccard-sets")
    rows = written(whole.select("id", "row", "n", "cls"), "jaccard-rows")
    own = whole.where("cls is not null").select("cls", "num", "row", "id", F.col("keys").isNotNull().alias("lists"))
    classes = written(own.groupBy("cls").agg(F.min(F.when(F.col("lists"), F.struct("num", "row"))).alias("first"), F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).select("cls", "first.num", "first.row", "least", "rows"), "jaccard-classes")
    # A class may have come from several tasks: one of them posts its lists.
    again = written(own.where("lists").select("cls", "num").join(classes.select("cls", F.col("num").alias("first")), "cls").where("num <> first").select("num"), "jaccard-again")
    posted = filtered(whole.where("keys is not null").select("num", "n", "keys"), F.col("num"), again, "num")
    posted = posted.where("not maybe").select("num", "n", "keys").unionByName(posted.where("maybe").select("num", "n", "keys").join(again, "num", "left_anti"))
    lists = posted.select("num", "n", F.explode("keys").alias("key"))
    long = written(lists.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "jaccard-lists")
    hits = filtered(lists, F.col("key"), long, "key").where("maybe").select("num", "n", "key").join(long, "key")
    t = f"((n * {num} + {den - 1}) div {den})"
    ell = lambda n: f"(({n}) * {den - num} div {4 * den} + 1)"
    take = f"least(n, n - {t} + {ell('n')})"
    need = f"({take} - {ell(t)} + 1 - ({take} - size(got)))"
    mine = hits.groupBy("num", "n").agg(F.sort_array(F.collect_set(F.struct("df", "key"))).alias("got"))
    # Linked documents differ in size by a factor of den / num at most, so each is listed in its own band of
    # sizes and in the next (bands are 1 % wider than that factor, against rounding).
    band = f"int(floor(ln(n) / {math.log(1.01 * den / num)!r}))"
    mine = mine.withColumn("need", F.expr(need)).where("need > 0").select("num", "n", F.explode(F.expr("slice(got, 1, int(need))")).alias("x"), F.expr(band).alias("band"))
    mine = mine.select("num", "n", F.explode(F.array(F.struct(F.col("band").alias("band"), F.lit(True).alias("home")), F.struct((F.col("band") + 1).alias("band"), F.lit(False).alias("home")))).alias("b"), F.col("x.key").alias("key"))
    mine = written(mine.select(F.xxhash64("key", "b.band").alias("key"), "num", "n", F.xxhash64("num", "b.band").alias("node"), "b.home"), "jaccard-short")
    sketches = written(whole.where("keys is not null").select("num", "n", F.col("num").alias("comp"), "sketch"), "jaccard-sketches")
    dropped(whole, again, long)
    # A list without a document of its own band holds pairs that meet in the band below.
    hubs = mine.groupBy("key").agg(F.min(F.struct("node", "num")).alias("hub"), F.max("node").alias("top"), F.max("home").alias("home"), F.count(F.lit(1)).alias("size")).where("hub.node <> top and home").select("key", F.col("hub.num").alias("hub_num"), "size")
    hubs = written(hubs, "jaccard-hubs")
    # Most lists hold one document: their rows go by a filter of fixed size, without a shuffle.
    met = written(filtered(mine, F.col("key"), hubs, "key").where("maybe").select("key", "num", "home").join(hubs, "key"), "jaccard-met")
    dropped(mine, hubs)
    most = met.where("num <> hub_num").groupBy("num", "hub_num").agg(F.count(F.lit(1)).alias("times")).groupBy("num").agg(F.max_by("hub_num", F.struct("times", "hub_num")).alias("hub_num"))
    most = written(most, "jaccard-most")
    hot = most.groupBy("hub_num").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > HOT).select("hub_num", F.ceil(F.col("members") / F.lit(max(1, BLOCK // 4))).cast("int").alias("parts"))
    hot, links = written(hot, "jaccard-hot"), None
    if not hot.isEmpty():
        part = F.pmod(F.xxhash64("num"), F.col("parts")).cast("long")
        ends = most.join(hot, "hub_num").select(F.col("hub_num").alias("i"), part.alias("j"), "num", F.col("num").alias("comp"), F.lit(0).alias("side"))
        heads = hot.select("hub_num", F.explode(F.expr("sequence(0L, bigint(parts) - 1)")).alias("j"))
        ends = ends.unionByName(heads.select(F.col("hub_num").alias("i"), "j", F.col("hub_num").alias("num"), F.col("hub_num").alias("comp"), F.lit(1).alias("side")))
        links = _linked(plain, classes, ends, num, den, k)
        joined = components(links)
        single, sketches = sketches, written(sketches.drop("comp").join(joined.select(F.col("node").alias("num"), F.col("root").alias("comp")), "num", "left").withColumn("comp", F.coalesce("comp", "num")), "jaccard-sketches")
        mixed = written(met.join(sketches.select("num", "comp"), "num").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "jaccard-mixed")
        all_met, met = met, written(filtered(met, F.col("key"), mixed, "key").where("maybe").drop("maybe").join(mixed, "key", "left_semi"), "jaccard-met")
        dropped(single, mixed, all_met)
    parts = F.ceil(F.col("size") / F.lit(PART)).cast("int")
    cells = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("num"), F.col("parts")).cast("int"))
    cells = cells.select("num", "home", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = cells.select("num", "home", "part", (F.col("part") != F.col("other")).alias("cross"), F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"))
    cells = cells.join(sketches, "num").repartition("cell").sortWithinPartitions("cell")
    near = written(cells.mapInArrow(lean(_near(num, den)), "a long, b long").distinct(), "jaccard-near")
    groups = components(near).select(F.col("node").alias("num"), "root").join(sketches.select("num", "n", "comp"), "num")
    groups = written(groups.select("num", "n", "comp", "root"), "jaccard-groups")
    dropped(sketches, near)
    found = _linked(plain, classes, _blocks(groups), num, den, k)
    dropped(met, most, hot)
    joined = components(found if links is None else found.unionByName(links))
    return rows, classes, written(joined.select(F.col("node").alias("num"), "root"), "jaccard-roots")


def _components(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n, component) of every row."""
    rows, classes, linked = link(docs, k, num, den, id_col, text_col)
    some = classes.join(linked, "num", "left")
    roots = some.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    known = some.where("root is not null").join(roots, "root").select("cls", "component").unionByName(some.where("root is null and rows > 1").select("cls", F.col("least").alias("component")))
    known = written(known, "jaccard-components")
    return rows.join(known, "cls", "left").select("id", "row", "n", F.coalesce("component", "id").alias("component"))


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links)."""
    return _components(docs, k, num, den, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each linked group those with the smallest id.

    A null id is larger than all others; a group of null ids only stays. Rows are shuffled only if a filter of fixed
    size can't rule out that they go.
    """
    gone = _components(docs, k, num, den, id_col, text_col).where(F.col("component").isNotNull() & (F.col("id").isNull() | (F.col("component") < F.col("id"))))
    gone = written(gone.select(F.col("row").alias("gone")).distinct(), "jaccard-gone")
    return without(docs, gone, id_col, text_col)
