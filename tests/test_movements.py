"""Prototypes, agreement of clusterings and streams against brute force."""

import math
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from roamer.functions import stats
from roamer.operators import graph, movements, tripdist
from roamer.plans import mobility
from roamer.plans.registry import points
from roamer.streaming import mobility as streams


def test_prototypes(spark, sf):
    ways, groups = defaultdict(list), defaultdict(list)
    for r in points(spark, sf).orderBy("uid", "tid", "seq").collect():
        ways[r.uid, r.tid].append((r.lon, r.lat, float(r.t)))
    one_movement = mobility.from_to(spark, sf).withColumns({"loc_from": F.lit(0), "loc_to": F.lit(0)})  # all trips of a user
    for r in one_movement.collect():
        groups[r.uid, r.loc_from, r.loc_to].append(r.tid)
    want = {}
    for (uid, a, b), tids in groups.items():
        tids.sort(key=lambda i: (ways[uid, i][0][2], i))  # noqa: B023
        total = {i: round(sum(tripdist.synchronised(ways[uid, min(i, j, key=tids.index)], ways[uid, max(i, j, key=tids.index)]) for j in tids if j != i), 4) for i in tids}
        finite = {i: d for i, d in total.items() if math.isfinite(d)}
        want[uid, a, b] = {tids[0]} if len(tids) < 3 or not finite else {i for i in finite if finite[i] <= min(finite.values()) + 1e-3}
    got = {(r.uid, r.loc_from, r.loc_to): r.tid for r in movements.prototypes(one_movement, points(spark, sf)).collect()}
    assert got.keys() == want.keys() and all(got[k] in want[k] for k in want)
    assert any(len(t) > 2 for t in groups.values())


def test_adjusted_mutual_information(spark):
    ami = lambda rows: graph.adjusted_mutual_information(spark.createDataFrame(rows, "a int, b int")).first().ami
    assert abs(ami([(i % 3, (i % 3) * 7) for i in range(30)]) - 1) < 1e-9
    assert ami([(1, 1)] * 4) == 1.0
    assert abs(ami([(0, 0), (0, 1), (1, 0), (1, 1)]) + 0.5) < 1e-9  # chance of equal halves: ln 2 / 3


def test_chains_and_means(spark):
    df = spark.createDataFrame([(3, 0.5, 2.0), (1, 0.9, None), (2, 0.5, 4.0)], "uid long, x double, y double")
    got = graph.chosen(df, [{"x": (0.4, 0.6)}, {"x": (0.4, 0.6), "y": (0.0, 3.0)}, {"x": (2.0, 3.0)}]).collect()
    assert [tuple(r) for r in got] == [(0, 2), (1, 3)]
    assert {r.uid: r.m for r in stats.averaged(df, {"m": ["x", "y"]}).collect()} == {3: 1.25, 1: None, 2: 2.25}


def test_streams_of_cells_and_events(spark, tmp_path):
    rows = [(1, 86400 * (i // 4) + 600 * i, i, "P", 11.0 + (i % 2), 43.5) for i in range(12)] + [(9, 86400 * 30, 99, "P", 0.0, 0.0), (9, 86400 * 60, 100, "P", 0.0, 0.0)]
    for k, part in enumerate((rows[:6], rows[6:12], rows[12:13], rows[13:])):
        spark.createDataFrame(part, streams.SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    streams.drained(streams.cell_counts(streams.position_stream(spark, str(tmp_path / "in/*"))), str(tmp_path / "cells"), str(tmp_path / "c1"))
    got = spark.read.parquet(str(tmp_path / "cells")).groupBy("day").agg(F.sum("n").alias("n")).collect()
    want = Counter(r[1] // 86400 for r in rows[:13])
    assert {int(r.day.timestamp()) // 86400: r.n for r in got} == dict(want)
    start = datetime(2024, 1, 1)
    at = lambda h: start + timedelta(hours=h)
    trips = [(1, 0, at(1), at(2)), (1, 1, at(5), at(6)), (2, 0, at(1), at(9))]
    events = [(1, 10, at(1.5)), (1, 11, at(3)), (1, 12, at(6)), (2, 13, at(8.5)), (3, 14, at(2))]
    spark.createDataFrame(trips, "uid long, tid int, start timestamp, end timestamp").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame(events, "uid long, event_id long, ts timestamp").write.parquet(str(tmp_path / "e"))
    read = lambda p, schema: spark.readStream.schema(schema).parquet(str(tmp_path / p))
    streams.drained(streams.assigned(read("e", "uid long, event_id long, ts timestamp"), read("t", "uid long, tid int, start timestamp, end timestamp")), str(tmp_path / "a"), str(tmp_path / "c2"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "a")).select("uid", "tid", "event_id").collect()} == {(1, 0, 10), (1, 1, 12), (2, 0, 13)}


def test_movement_features_of_literal_trips(spark):
    km = [1.0, 2.0, 2.0, 3.0, 100.0]
    ft = spark.createDataFrame([(1, i, 0, 1) for i in range(5)] + [(1, 9, 1, 0), (2, 0, 0, 0)], "uid long, tid int, loc_from int, loc_to int")
    trips = spark.createDataFrame([(1, i, x, 60 * (i + 1)) for i, x in enumerate(km)] + [(1, 9, 5.0, 10), (2, 0, None, 10)], "uid long, tid int, length_km double, duration long")
    got = {(r.uid, r.loc_from, r.loc_to): r for r in movements.movement_features(ft, trips).collect()}
    a, b = got[1, 0, 1], got[1, 1, 0]
    assert len(got) == 2 and (a.support, a.median_length_km, a.avg_length_km, a.std_length_km) == (5, 2.0, 2.0, math.sqrt(0.5))
    assert (a.median_duration, a.avg_duration) == (180.0, 180.0) and (b.support, b.median_length_km, b.std_length_km) == (1, 5.0, 0.0)
