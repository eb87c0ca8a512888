"""Operators without SQL against plain Python."""

import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roamer.operators import allpairs, annotate, ev, segment
from roamer.plans import all_queries, mobility
from roamer.plans.registry import positions, quick, trips


def random_roads(rnd, n=60):
    """Nodes in a ring with a few chords; seconds and joules an edge."""
    out = {u: [] for u in range(n)}
    for u in range(n - 8):  # the last eight nodes are reached by one of them only
        for v in (u + 1, rnd.randrange(n - 8)):
            for a, b in ((u, v), (v, u)):
                if a != b and b < n - 8:
                    out[a].append((b, rnd.uniform(10, 60), rnd.choice([-2.0, 3.0, 5.0, 8.0])))
    for u in range(n - 8, n - 1):
        out[u].append((u + 1, 10.0, 1.0))
    return out


def settled(roads, source, battery, reserve):
    """Node by node in order of travel time, by a scan of all that is open."""
    open_, done = {source: (0.0, battery)}, {}
    while open_:
        u = min(open_, key=lambda x: (open_[x][0], x))
        at, left = done[u] = open_.pop(u)
        for v, s, j in roads[u]:
            rest = min(left - j, battery)
            if rest > battery * reserve and v not in done and (v not in open_ or at + s < open_[v][0]):
                open_[v] = (at + s, rest)
    return done


def test_routes_and_plans(spark):
    rnd = random.Random(11)
    roads, battery, reserve = random_roads(rnd), 20.0, 0.1
    done = {s: settled(roads, s, battery, reserve) for s in roads}
    sources = spark.createDataFrame([(s,) for s in roads], "source long")
    got = {(r.source, r.target): (r.seconds, r.joules) for r in ev.distances(sources, roads, battery, battery, reserve).collect()}
    want = {(s, t): (at, battery - left) for s, d in done.items() for t, (at, left) in d.items()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)

    ids = [3, 17, 30, 44]
    net = {a: {b: done[a][b][0] if b in done[a] else math.inf for b in ids} for a in ids}
    for k in ids:
        for a in ids:
            for b in ids:
                net[a][b] = min(net[a][b], net[a][k] + net[k][b])
    plans = {}
    for s in roads:
        for t in roads:
            if t in done[s]:
                plans[s, t] = ("direct", done[s][t][0])
                continue
            last = min(((done[x][t][0], x) for x in ids if t in done[x]), default=None)
            way = min((done[s][x][0] + net[x][last[1]] for x in ids if x in done[s]), default=math.inf) if last else math.inf
            plans[s, t] = ("charge", way + last[0]) if math.isfinite(way) else ("none", None)
    stations = spark.createDataFrame([(i,) for i in ids], "source long")
    links = [(r.source, r.target, r.seconds) for r in ev.station_graph(stations, roads, battery, reserve).collect()]
    asked = spark.createDataFrame(list(plans), "source long, target long")
    made = {(r.source, r.target): r for r in ev.planned(asked, roads, ids, links, battery, reserve).collect()}
    assert {p[0] for p in plans.values()} == {"direct", "charge", "none"} and made.keys() == plans.keys()
    for k, (status, seconds) in plans.items():
        assert made[k].status == status and (seconds is None or math.isclose(made[k].seconds, seconds)), k
        assert (status == "charge") == bool(made[k].stops) and set(made[k].stops) <= set(ids)


def test_simulation_that_avoids_emergencies(spark):
    rnd = random.Random(12)
    rows = [(u, 3600 * i, 3600 * i + 600, rnd.uniform(0, 16), rnd.random() < 0.1, rnd.random() < 0.15) for u in range(30) for i in range(25)]
    df = spark.createDataFrame(rows, "uid long, t long, end_t long, kwh double, to_home_or_work boolean, has_station boolean")
    of = lambda trace: {u: [r for r in trace if r.uid == u] for u in range(30)}
    plain, avoiding = of(ev.simulated(df, stay_minutes=30).collect()), of(ev.simulated(df, stay_minutes=30, avoid=True).collect())
    spent = lambda trace: sum(r.place == "emergency" for r in trace)
    assert sum(map(spent, plain.values())) > sum(map(spent, avoiding.values())) > 0
    for u in range(30):
        own = [r for r in rows if r[0] == u]
        charges = defaultdict(list)
        for r in avoiding[u]:
            charges[r.t].append(r)
        left = 38.0
        for i, (_, t, end, kwh, home, _) in enumerate(own):
            for r in (x for x in charges[t] if x.place != "home_work"):  # a charge on the way starts with what is left
                assert math.isclose(r.before, left, abs_tol=1e-9)
                left += r.amount
                if r.place == "emergency":  # every station up to here has been used before
                    used = {x.t for x in avoiding[u] if x.place in ("public", "emergency")}
                    assert all(own[k][1] in used for k in range(i + 1) if own[k][5])
            left = max(0.0, left - kwh)
            for r in (x for x in charges[end] if x.place == "home_work"):
                assert home and math.isclose(r.before, left, abs_tol=1e-9)
                left += r.amount
            assert -1e-9 <= left <= 38 + 1e-9
    assert not ev.simulated(df.withColumn("has_station", F.lit(False)), avoid=True).exceptAll(ev.simulated(df.withColumn("has_station", F.lit(False)))).count()


def test_reduced_public_charges(spark):
    trace = [(1, "public", 2, 5.0, 33.0, 198.0, 10), (1, "home_work", 1, 30.0, 8.0, 72.0, 20), (1, "public", 2, 5.0, 33.0, 198.0, 30), (1, "emergency", 2, 0.0, 4.0, 24.0, 40)]
    got = [r.reduced for r in ev.reduced_public(spark.createDataFrame(trace, ev.TRACE)).orderBy("t").collect()]
    assert got == [9.0, 8.0, 33.0, 4.0]


def naive_threshold(stops):
    """The histogram of stops in minutes, smoothed, looked through from its short end; all statistics anew for each bin."""
    edges = list(range(60, 172801, 60))
    counts = [0] * (len(edges) - 1)
    for s in stops:
        if 60 <= s <= edges[-1]:
            counts[min((int(s) - 60) // 60, len(counts) - 1)] += 1
    smooth = lambda v: [sum(v[i : i + 3]) / 3 for i in range(len(v) - 3)]
    counts, edges = smooth(counts[::-1]), smooth(edges[::-1])
    for cut in range(len(counts) - 1, 10, -1):
        seen = np.array(counts[:cut])
        if abs(counts[cut] - seen.mean()) > seen.std() and segment.thompson(seen, counts[cut]):
            return edges[cut]
    return 1200.0


def folded(rows, gap):
    fold, out = segment.Fold(gap, 0.05, 0.07), []
    for r in rows:
        if done := fold.add(r):
            out.append((done[0], list(done[1])))
    if kept := fold.finished():
        out.append((fold.tid, kept))
    return out


def test_adaptive_segmentation(spark):
    rnd = random.Random(13)
    users = {}
    for u in range(4):
        t, lon, rows = 0, 11.0, []
        for i in range(400):
            t += rnd.choice([30, 60, 100]) if rnd.random() < 0.8 else rnd.choice([200, 260, 300, 5000, 40000])
            lon += rnd.choice([0.0, 0.001, 0.004])
            rows.append((lon, 43.5, t))
        users[u] = rows
    df = spark.createDataFrame([(u, t, lon, lat, i) for u, rows in users.items() for i, (lon, lat, t) in enumerate(rows)], "uid long, t long, lon double, lat double, event_id long")
    got, thresholds = defaultdict(list), set()
    for r in segment.by_adaptive_thresholds(df).orderBy("uid", "tid", "seq").collect():
        got[r.uid, r.tid].append((r.lon, r.lat, r.t))
    want = {}
    for u, rows in users.items():
        first = sorted((x[0][2], tid, x[-1][2]) for tid, x in folded(rows, 120))
        own = naive_threshold([b[0] - a[2] for a, b in zip(first, first[1:])])
        thresholds.add(own)
        want |= {(u, tid): [p[:3] for p in x] for tid, x in folded(rows, own)}
    assert dict(got) == want and thresholds - {1200.0}


def test_network_documents(spark, sf):
    docs = {r.uid: (r.n_trips, json.loads(r.document)) for r in all_queries()["k17_s15_imn_documents"](spark, sf).collect()}
    places, moves = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(list))
    for r in mobility.located(spark, sf).collect():
        places[r.uid][r.lid] += 1
    for r in mobility.from_to(spark, sf).collect():
        moves[r.uid][r.loc_from, r.loc_to].append(r.tid)
    km = {r.uid: (r.n, r.km) for r in trips(spark, sf).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.sum("length_km").alias("km")).collect()}
    regular = defaultdict(set)
    for r in all_queries()["k16_regular_locations_pruned"](spark, sf).collect():
        regular[r.uid].add(r.lid)
    assert docs.keys() == places.keys()
    for u, (n, d) in docs.items():
        assert (n, round(d["km"], 6)) == (km[u][0], round(km[u][1], 6))
        assert {int(k): v["support"] for k, v in d["locations"].items()} == places[u]
        assert {int(k) for k, v in d["locations"].items() if v["regular"]} == regular[u]
        assert {(v["loc_from"], v["loc_to"]): (v["support"], sorted(v["tids"])) for v in d["movements"].values()} == {k: (len(t), sorted(t)) for k, t in moves[u].items()}
        assert {(x["source"], x["target"]): x["weight"] for x in d["graph"]["links"]} == {k: len(t) for k, t in moves[u].items()}
    assert positions(spark, sf).select("uid").distinct().count() >= len(docs)


def test_cluster_sweep(spark):
    rnd = random.Random(14)
    spots = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    rows = [(i, x + rnd.uniform(-0.5, 0.5), y + rnd.uniform(-0.5, 0.5)) for i in range(150) for x, y in [spots[i % 3]]]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r.k: r for r in annotate.sweep(df, ["a", "b"], [2, 3, 6]).collect()}
    x = np.array([r[1:] for r in rows])
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    own = np.arange(150) % 3
    want = sum(((x[own == c] - x[own == c].mean(0)) ** 2).sum() for c in range(3))
    assert math.isclose(got[3].sse, want, rel_tol=1e-6) and got[2].sse > got[3].sse > got[6].sse
    assert max(got.values(), key=lambda r: r.silhouette).k == 3
    placed = annotate.semantic(df, ["a", "b"], [2, 3, 6], top=2).collect()
    assert len({(r.id % 3, r.cluster) for r in placed}) == 3 and len({r.kind for r in placed}) == 2


def test_routes_are_handed_over_in_bounded_frames(spark, monkeypatch):
    monkeypatch.setattr(ev, "ROWS", 100)
    line = {u: [(v, 10.0, 1.0) for v in (u - 1, u + 1) if 0 <= v < 300] for u in range(300)}
    frames = list(ev._reached(0, ev.search(line, 0), math.inf, None, True))
    assert sum(map(len, frames)) == 300 and all(f["n_path"].sum() <= 100 + 300 for f in frames) and len(frames) > 100
    got = ev.routes(spark.createDataFrame([(0,)], "source long"), line, 50.0, 50.0, 0.1).collect()
    assert [(r.target, r.seconds, r.n_path) for r in sorted(got)] == [(t, 10.0 * t, t + 1) for t in range(300)]
    assert {r.target: r.joules for r in got if r.bound_seconds is not None} == {t: float(t) for t in range(45)}


def test_planner_searches_once_for_each_last_station(spark):
    """Many trips with one target share the search over the stations; each has the fewest stops of equal ways."""
    line = {u: [(v, 10.0, 1.0) for v in (u - 1, u + 1) if 0 <= v < 100] for u in range(100)}
    ids = list(range(0, 100, 10))
    links = [(a, b, 10.0 * abs(a - b)) for a in ids for b in ids if a != b and abs(a - b) < 18]
    asked = spark.createDataFrame([(s, 99) for s in range(70)] + [(200, 99)], "source long, target long")
    plan = ev.planned(asked, line, ids, links, 20.0, 0.1)
    assert "FlatMapGroupsInPandas" in plan._jdf.queryExecution().toString()
    got = {r.source: (r.status, r.stops, r.seconds) for r in plan.collect()}
    assert got.pop(200) == ("none", [], None) and all(v[0] == "charge" and v[2] == 10.0 * (99 - s) for s, v in got.items())
    assert got[60][1] == [70, 80, 90]


def _maps(seed):
    """Random road maps: a grid with gaps and one-way roads, equal times, parallel edges, dead ends, parts without a link."""
    rng, g = random.Random(seed), {}
    for u in range(300):
        for v in (u + 1, u - 1, u + 7, u - 7, rng.randrange(300) if rng.random() < 0.02 else u):
            if 0 <= v < 300 and (u < 200) == (v < 200) and rng.random() < 0.8:
                g.setdefault(u * 3 - 50, []).append((v * 3 - 50, float(rng.choice([1, 2, 2, 3, rng.random()])), rng.uniform(-0.5, 3)))
    return g


@pytest.mark.parametrize("seed", range(4))
def test_blocks_equal_searches(seed):
    """Times and nodes on the ways from a block of sources are those of a search from each, to the last bit."""
    g = _maps(seed)
    net = allpairs.roads(g)
    place = {u: i for i, u in enumerate(net.ids.tolist())}
    for some in (net.ids[:40].tolist(), net.ids[-1:].tolist(), random.Random(seed).sample(net.ids.tolist(), 60)):
        found, _, before = ev.search(g, some[0])
        some = [s for s in some if s in found] + some[:1]  # one twice
        block = allpairs.Block(net, place, found, before, some)
        seconds = block.times()
        hops = block.hops(seconds)
        for j, s in enumerate(some):
            sec, _, prior = ev.search(g, s)
            assert {int(t): x for t, x in zip(block.ids, seconds[:, j], strict=True) if x < math.inf} == sec
            assert all(n == (len(ev.way(prior, s, int(t))) if t in sec else 0) for t, n in zip(block.ids, hops[:, j], strict=True))


def test_routes_of_many_sources_take_few_passes(spark, monkeypatch):
    """No search of its own for each source (F1, F2): the same rows as by such searches, by one search a block; without blocks where an edge takes no time."""
    g, searches = _maps(9), []
    search = ev.search
    monkeypatch.setattr(ev, "search", lambda graph, source, *a: searches.append(source) or search(graph, source, *a))
    sources = sorted({*g, 5000})  # one that is not on the map
    want = {}
    for s in sources:
        sec, _, before = search(g, s)
        near, left, _ = search(g, s, 6.0, 6.0, 0.1)
        want |= {(s, t): (x, len(ev.way(before, s, t)), near.get(t), 6.0 - left[t] if t in near else None) for t, x in sec.items()}
    df = spark.createDataFrame([(s,) for s in [*sources, sources[0]]], "source long")
    got = ev.routes(df, g, 6.0, 6.0, 0.1).collect()
    assert len(got) == len(want) + sum(s == sources[0] for s, _ in want)
    assert {(r.source, r.target): (r.seconds, r.n_path, r.bound_seconds, r.joules) for r in got} == want
    assert {(r.source, r.target): r.seconds for r in ev.times(df, g).collect()} == {k: x[0] for k, x in want.items()}
    assert allpairs.searchable(g) and not allpairs.searchable({0: [(1, 0.0, 1.0)]}) and not allpairs.searchable({0: [(1, 1e-20, 1.0), (2, 9.0, 1.0)]})
    still = {0: [(1, 0.0, 1.0)], 1: [(2, 1.0, 1.0)]}
    assert {(r.source, r.target, r.seconds) for r in ev.times(df.limit(0).unionAll(spark.range(2)), still).collect()} == {(0, 0, 0.0), (0, 1, 0.0), (0, 2, 1.0), (1, 1, 0.0), (1, 2, 1.0)}
    net = allpairs.roads(g)
    searches.clear()
    frames = [x for x in ev._blocks(g, net, net.ids[:100].tolist(), None)]
    assert len(searches) < 10 and sum(x.num_rows for x in frames) == sum(s in set(net.ids[:100].tolist()) for s, _ in want)


def test_quick_rounding(spark):
    """Equal to F.round, also beside halves and for large numbers."""
    rng = random.Random(1)
    xs = [rng.uniform(-1, 1) * 10 ** rng.randrange(0, 14) for _ in range(20000)] + [(rng.randrange(10**12) * 10 + 5) / 1e7 for _ in range(20000)] + [0.0, -0.0, -1e-9, math.inf, -math.inf, math.nan, None, 5e-7, 1.0000005, 2.0**40, 1e300]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", quick("x", name="a"), F.round("x", 6).alias("b"))
    assert not df.where("not (a <=> b) or a is null and b is not null").count()
    assert not [r for r in df.collect() if repr(r.a) != repr(r.b) and r.b]
