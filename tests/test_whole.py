"""Queries and operators that cover all of their input."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from roamer.functions import stats
from roamer.operators import annotate, clustering, locations, movements, risk, spatial
from roamer.plans import all_queries, electric


def test_routes_start_from_every_node(spark, sf):
    ids = {r.id for r in electric.nodes(spark, sf).collect()}
    got = all_queries()["e08_e09_e10_routes"](spark, sf)
    assert {r.source for r in got.select("source").distinct().collect()} == ids
    plans = all_queries()["e11_e12_trip_planner"](spark, sf).collect()
    assert {r.source for r in plans} == {r.target for r in plans} == ids and len(plans) == len(ids)


def test_a_user_may_have_more_than_64_locations(spark):
    # Places of four ends each, 20 to 40 km apart.
    places = [(0.2 * i + 0.013 * (i * j % 7), 0.2 * j + 0.011 * (i + 2 * j) % 5 * 0.01) for i in range(10) for j in range(10)]
    rows = [(1, 4 * n + m, lon + m * 1e-5, lat) for n, (lon, lat) in enumerate(places) for m in range(4)]
    ends = spark.createDataFrame(rows, "uid long, pid int, lon double, lat double")
    assert locations.tosca_locations(ends).select("lid").distinct().count() > 64


def test_nearest_places_at_any_distance(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 179.9999, 10.0), (3, 25.0, 89.99)], "id long, lon double, lat double")
    b = spark.createDataFrame([(1, 0.0, 0.1), (2, 20.0, 0.0), (3, -120.0, -40.0), (4, -179.9999, 10.0), (5, -155.0, 89.99)], "id2 long, lon2 double, lat2 double")
    got = {}
    for r in spatial.nearest(a, b, 3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.id2)
    assert {k: len(v) for k, v in got.items()} == {1: 3, 2: 3, 3: 3} and got[1][:2] == [1, 2] and got[2][0] == 4 and got[3][0] == 5
    assert {(r.id, r.id2) for r in spatial.within(a, b, 3000).collect()} == {(2, 4), (3, 5)}


def test_rectangles_of_any_size_meet_once(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        y, x, size = rnd.uniform(-4, 4), rnd.uniform(-4, 4), rnd.choice([0.0, 0.01, 0.6, 3.0])
        rows.append((i, y, x, y + size, x + size * rnd.random()))
    rows += [(60, 0.5, 0.5, 1.0, 1.0), (61, 1.0, 1.0, 1.5, 1.5), (62, -90.0, -180.0, 90.0, 180.0)]  # a shared corner, the whole world
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and not (a[4] < b[2] or b[4] < a[2] or a[3] < b[1] or b[3] < a[1])}
    got = [(r.uid, r.other) for r in annotate.overlapping(spark.createDataFrame(rows, "uid long, bottom double, lft double, top double, rgt double")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (60, 61) in want


def test_ranks_and_tiles_with_ties_and_nulls(spark):
    rnd = random.Random(3)
    values = [None] * 7 + [5.0] * 150 + [rnd.choice([1.0, 2.5, rnd.random()]) for _ in range(246)]
    rnd.shuffle(values)
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    got = {r.id: r.rank for r in stats.ranked(df, "v", "id", parts=10).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0.0, i))
    assert got == {i: n + 1 for n, i in enumerate(order)}
    for rows in (0, 1, 3, 4, 10, 403):
        want = [q + 1 for q in range(4) for _ in range(rows // 4 + (q < rows % 4))]
        tiles = spark.range(1, rows + 1).select("id", stats.tile(F.col("id"), rows, 4).alias("q")).orderBy("id").collect()
        assert [r.q for r in tiles] == want
    empty = df.limit(0)
    assert stats.ranked(empty, "v", "id").count() == 0


def test_minutes_covered(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(3), rnd.randrange(1440), rnd.randrange(1440)) for _ in range(60)] + [(9, 0, 1439), (9, 700, 699), (8, 1439, 0), (8, 5, 5)]
    want = Counter()
    for k, a, b in rows:
        want.update((k, m) for m in (range(a, b + 1) if a <= b else [*range(b + 1), *range(a, 1440)]))
    got = [((r.k, r.minute), r.n) for r in movements.covered(spark.createDataFrame(rows, "k int, a int, b int"), ["k"]).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_areas_are_those_of_one_pass_over_all_vehicles(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        y, x, size = rnd.uniform(-1.2, 1.2), rnd.uniform(-1.2, 1.2) + rnd.choice([0, 20]), rnd.choice([0.3, 0.5, 1.1])
        rows.append((i, y, x, y + size, x + size * rnd.uniform(0.5, 1)))
    rows.append((150, -5.0, -170.0, -4.0, -169.0))
    size = {r[0]: (r[3] - r[1]) * (r[4] - r[2]) for r in rows}
    groups = []
    for a in rows:
        fits = lambda b: not (a[4] < b[2] or b[4] < a[2] or a[3] < b[1] or b[3] < a[1]) and abs(size[a[0]] - size[b[0]]) < 3 * min(size[a[0]], size[b[0]])  # noqa: E731, B023
        home = next((g for g in groups if sum(map(fits, g)) / len(g) > 0.75), None)
        groups.append([a]) if home is None else home.append(a)
    got = {}
    for r in annotate.areas(spark.createDataFrame(rows, "uid long, bottom double, lft double, top double, rgt double")).collect():
        got.setdefault((r.region, r.area), set()).add(r.uid)
    assert sorted(map(sorted, got.values())) == sorted([b[0] for b in g] for g in groups) and len({k[0] for k in got}) >= 3
    assert any(len({(b[2] + b[4]) // 2 for b in g}) > 1 for g in groups)  # areas across degree lines


def test_new_minority_rows_lie_between_nearest_neighbours(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.uniform(0, 100), rnd.choice([0.0, 1.0, rnd.random()]), int(i % 5 == 0)) for i in range(203)]
    df = spark.createDataFrame(rows, "uid long, a double, b double, crash int")
    few = [r for r in rows if r[3]]
    lo, hi = min(r[1] for r in rows), max(r[1] for r in rows)
    x = {r[0]: (r[1] / (hi - lo), r[2]) for r in few}
    d = lambda p, q: round((x[p][0] - x[q][0]) ** 2 + (x[p][1] - x[q][1]) ** 2, 9)
    scaled = spark.createDataFrame([(k, list(v)) for k, v in x.items()], "key long, x array<double>")
    got = {(r.key, r.place): r.other for r in risk.neighbours(scaled, 5, 4).collect()}
    for p in x:
        assert [d(p, got[p, i]) for i in range(5)] == sorted(d(p, q) for q in x if q != p)[:5] and len({got[p, i] for i in range(5)} - {p}) == 5
    out = risk.oversampled(df, ["a", "b"], block=10).collect()
    assert len(out) == 2 * (len(rows) - len(few)) and sum(r.crash for r in out) == len(out) // 2
    by = {r[0]: (r[1], r[2]) for r in few}
    on = lambda r, p, q: abs((by[q][0] - by[p][0]) * (r.b - by[p][1]) - (by[q][1] - by[p][1]) * (r.a - by[p][0])) < 1e-6 and min(by[p][0], by[q][0]) - 1e-9 <= r.a <= max(by[p][0], by[q][0]) + 1e-9
    fresh = [r for r in out if r.crash and (r.a, r.b) not in set(by.values())]
    assert fresh and all(any(on(r, p, q) for (p, _), q in got.items()) for r in fresh)
    alone = spark.createDataFrame([(1, 1.0, 1.0, 1), (2, 2.0, None, 0), (3, 3.0, 1.0, 0)], df.schema)
    assert risk.oversampled(alone, ["a", "b"]).count() == 3 and risk.oversampled(alone.limit(0), ["a", "b"]).count() == 0


def test_tallies_equal_pairs_counted_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SIDES", (7, 11))  # crowded cubes are dealt into parts
    monkeypatch.setattr(spatial, "MATRIX", 64)
    rng = np.random.default_rng(6)
    a = [(i, 11 + 0.002 * float(x), 43.5 + 0.002 * float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1, (60, 2)))] + [(60, 179.9999, 10.0), (61, None, 1.0)]
    b = [(11 + 0.002 * float(x), 43.5 + 0.002 * float(y), int(c) if c else None) for x, y, c in zip(*rng.uniform(0, 1, (2, 80)), rng.integers(0, 3, 80), strict=True)]
    b += [(-179.9999, 10.0, 1), (a[0][1], a[0][2], 2), (None, 1.0, 1)]
    want = {}
    for i, x, y in a:
        for x2, y2, c in b:
            if x is None or x2 is None or (d := float(clustering.spherical(x, y, x2, y2))) > 60:
                continue
            n0, n1, least = want.get((i, c), (0, 0, 1e9))
            want[i, c] = n0 + (d <= 30), n1 + 1, min(least, d)
    got = spatial.tallied(spark.createDataFrame(a, "id long, lon double, lat double"), spark.createDataFrame(b, "lon2 double, lat2 double, category long"), [30, 60]).collect()
    assert {(r.id, r.category): (r.n0, r.n1) for r in got} == {k: v[:2] for k, v in want.items()}
    assert all(abs(r.least - want[r.id, r.category][2]) < 1e-6 for r in got) and (60, 1) in want


def test_nearest_looks_no_farther_than_a_crowd_needs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    b = [(i, 11 + 0.01 * float(x), 43.5 + 0.01 * float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1, (2000, 2)))] + [(5000, 12.0, 44.0)]
    there = spark.createDataFrame(b, "id2 long, lon2 double, lat2 double")
    radii, within = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda x, y, metres: radii.append(metres) or within(x, y, metres))
    got = spatial.nearest(spark.createDataFrame(b[::100], "id long, lon double, lat double"), there, 3)
    best = {i: sorted((round(float(clustering.spherical(x, y, x2, y2)), 3), j) for j, x2, y2 in b)[:3] for i, x, y in b[::100]}
    assert {(r.id, r["rank"], r.id2) for r in got.collect()} == {(i, k, j) for i, v in best.items() for k, (_, j) in enumerate(v)}
    assert radii[0] < 100


def test_first_ring_of_nearest_keeps_no_more_pairs_than_it_needs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SIDES", (50, 70))  # crowded cubes are dealt into parts
    monkeypatch.setattr(spatial, "MATRIX", 1000)
    rng = np.random.default_rng(9)
    spots = [(11 + 0.005 * float(x), 43.5 + 0.005 * float(y)) for x, y in rng.uniform(0, 1, (300, 2))]
    b = [(f"p{i}", *spots[i % 300 if i < 500 else 0]) for i in range(900)] + [("far", 179.9999, 10.0), ("none", None, 1.0)]  # copies, and a crowd at one place
    a = [(i, *spots[i]) for i in range(0, 300, 2)] + [(300, -179.9999, 10.0), (301, 11.003, 43.502)]
    left, there = spark.createDataFrame(a, "id long, lon double, lat double"), spark.createDataFrame(b, "id2 string, lon2 double, lat2 double").withColumn("tag", F.struct("id2"))
    best = {i: sorted((round(float(clustering.spherical(x, y, x2, y2)), 3), j) for j, x2, y2 in b if x2 is not None)[:4] for i, x, y in a}
    pairs = spatial.closest(left, there, 4, 60.0)
    parts = -(-900 // 70) + 1
    assert pairs.count() < spatial.within(left, there, 60.0).count() / 2 and pairs.groupBy("id").count().agg(F.max("count")).first()[0] <= 12 * parts
    got = {(r.id, r["rank"], r.id2, r.tag.id2) for r in spatial.nearest(left, there, 4).collect()}
    assert got == {(i, n, j, j) for i, v in best.items() for n, (_, j) in enumerate(v)}
    assert spatial.nearest(left.limit(0), there, 4).count() == 0


def test_a_crowded_cell_is_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(annotate, "CROWD", 10)
    rng = np.random.default_rng(8)
    rows = [(i, 43.0 + float(y), 11.0 + float(x), 43.0 + float(y + h), 11.0 + float(x + w)) for i, (x, y, w, h) in enumerate(rng.uniform(0, 0.4, (90, 4)))]
    got = annotate.overlapping(spark.createDataFrame(rows, "uid long, bottom double, lft double, top double, rgt double"))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and not (a[4] < b[2] or b[4] < a[2] or a[3] < b[1] or b[3] < a[1])}
    pairs = [(r.uid, r.other) for r in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want)
