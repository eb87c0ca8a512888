"""Stations on edges against brute force, splits in both directions, charge plans of literal trips."""

import math
import random

from roamer.operators import placement


def test_nearest_edges_against_all_edges(spark):
    rnd = random.Random(7)
    ways = []
    for i in range(40):
        x, y = rnd.choice([11.0, 179.99]) + rnd.uniform(-0.05, 0.05), rnd.uniform(-0.05, 0.05) + 60
        ways.append((i, i + 100, [((x + rnd.uniform(-0.06, 0.06) * j + 180) % 360 - 180, y + rnd.uniform(-0.06, 0.06) * j) for j in range(rnd.choice([2, 3, 5]))]))
    ways = [w for w in ways if all(abs(a[0] - b[0]) < 180 for a, b in zip(w[2], w[2][1:], strict=False))]
    stations = [(i, rnd.choice([11.0, 179.99]) + rnd.uniform(-0.05, 0.009), 60 + rnd.uniform(-0.05, 0.05)) for i in range(30)]
    got = {r.id: r for r in placement.nearest_edges(spark.createDataFrame(stations, "id long, lon double, lat double"), spark.createDataFrame(ways, "u long, v long, way array<struct<lon: double, lat: double>>"), 900.0).collect()}
    for i, lon, lat in stations:
        best = []
        for u, v, way in ways:
            p = [(math.radians((a - lon + 540) % 360 - 180) * math.cos(math.radians(lat)) * 6371000, math.radians(b - lat) * 6371000) for a, b in way]
            for (ax, ay), (bx, by) in zip(p, p[1:], strict=False):
                dx, dy = bx - ax, by - ay
                f = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
                best.append((round(math.hypot(ax + f * dx, ay + f * dy), 3), u, v))
        d, u, v = min(best)
        assert (i in got) == (d <= 900)
        if i in got:
            assert (got[i].u, got[i].v) == (u, v) and abs(got[i].metres - d) < 0.01 and 0 <= got[i].share <= 1
    assert len(got) > 3


def test_edges_run_through_their_stations(spark):
    edges = spark.createDataFrame([(1, 2, 100.0), (2, 1, 120.0), (2, 3, 50.0)], "u long, v long, length double")
    placed = spark.createDataFrame([(7, 1, 2, 0.75), (8, 1, 2, 0.25), (9, 1, 2, 0.25)], "id long, u long, v long, share double")
    got = {(r.u, r.v): r.length for r in placement.split_edges(edges, placed).collect()}
    assert got == {(1, -8): 25.0, (-8, -9): 0.0, (-9, -7): 50.0, (-7, 2): 25.0, (2, -7): 30.0, (-7, -9): 60.0, (-9, -8): 0.0, (-8, 1): 30.0, (2, 3): 50.0}


def test_plans_of_literal_trips(spark):
    rows = [(1, 1, 20.0, 2), (1, 2, 41.0, 2), (1, 3, 10.0, 1), (2, 1, 5.0, 2), (2, 2, 9.0, 2), (3, 1, 5.0, 2)]
    got = {(r.trip, r.leg): r for r in placement.charge_plans(spark.createDataFrame(rows, "trip int, leg int, kwh double, level int"), 30.0, next_trip=2.0).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)}  # one leg has no stop
    a, b, c = got[1, 1], got[1, 2], got[2, 1]
    assert (a.full, a.partial, a.over_full, a.over_partial, a.minutes_full) == (20.0, 23.0, 0.0, 3.0, 120.0)
    assert (b.full, b.partial, b.over_full, b.over_partial) == (41.0, 12.0, 3.0, 0.0)
    assert (c.full, c.partial) == (5.0, 0.0)
