"""Streams of positions and events: sessions, segmentation, counters, assignment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roamer.functions import quadtree
from roamer.operators.segment import Fold

SCHEMA = "uid long, t long, event_id long, record_type string, lon double, lat double"


def position_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """History rows from Parquet files as they arrive, with an event time ``ts``."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn("ts", F.timestamp_seconds("t"))


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """History rows from JSON values of a topic; credentials belong into the session's configuration."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), SCHEMA).alias("v")).select("v.*").withColumn("ts", F.timestamp_seconds("t"))


def sessions(positions: DataFrame, gap: str = "8 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user that a gap ends: start, end, points."""
    w = F.session_window("ts", gap)
    return positions.withWatermark("ts", late).groupBy("uid", w).agg(F.count(F.lit(1)).alias("n_points"), F.min("t").alias("start_ts"), F.max("t").alias("end_ts")).drop("session_window")


def cell_counts(positions: DataFrame, late: str = "1 hour", depth: int = 16) -> DataFrame:
    """Points per day and quadtree cell; rows later than the watermark are dropped by Spark."""
    path = quadtree.path(F.col("lon"), F.col("lat"), depth).alias("path")
    return positions.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), path).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "path", "n")


TRIPS = "uid long, tid int, n_points int, start_ts long, end_ts long, length_km double"
STATE = "tid int, fresh boolean, trip array<array<double>>, last array<double>, anchor array<double>"


def online_trips(positions: DataFrame, temporal: float = 28800, spatial_m: float = 50, max_speed: float = 0.07, late: str = "1 hour") -> DataFrame:
    """Trips by the stateful segmentation, emitted when a stop ends them or the user is silent beyond the threshold and the watermark.

    A silent user's state is two points and a number, so trips go on being numbered and joined as in a batch.
    Rows that come after their user's trip was given out, but belong to it, are late and dropped.
    """

    def summary(uid: int, tid: int, trip: list) -> tuple:
        return uid, tid, len(trip), int(trip[0][2]), int(trip[-1][2]), float(sum(p[3] for p in trip))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Fold(temporal, spatial_m / 1000, max_speed)
        if state.exists:
            tid, fold.fresh, trip, last, anchor = state.get
            point = lambda p: (p[0], p[1], int(p[2]), *p[3:])
            fold.tid, fold.trip, fold.last, fold.anchor = tid, [point(p) for p in trip], point(last), point(anchor)
        out = []
        if state.hasTimedOut:
            if kept := fold.finished():
                out.append(summary(key[0], fold.tid, kept))
            fold.trip = []  # given out; the last point stays, since the next trip begins there
        else:
            new = pd.concat(list(frames)).sort_values(["t", "event_id"])
            for x in new.itertuples():
                since = None if fold.last is None else x.t - fold.last[2]
                if since is None or since > temporal or since >= 0 and fold.trip:
                    if done := fold.add((x.lon, x.lat, int(x.t))):
                        out.append(summary(key[0], *done))
            if fold.trip:
                state.setTimeoutTimestamp(max(int(fold.last[2] + temporal) * 1000, state.getCurrentWatermarkMs()) + 1)
        state.update((fold.tid, fold.fresh, [list(map(float, p)) for p in fold.trip], list(map(float, fold.last)), list(map(float, fold.anchor))))
        yield pd.DataFrame(out, columns=["uid", "tid", "n_points", "start_ts", "end_ts", "length_km"])

    keyed = positions.withWatermark("ts", late).select("uid", "t", "event_id", "lon", "lat", "ts")
    return keyed.groupBy("uid").applyInPandasWithState(run, TRIPS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def assigned(events: DataFrame, trips: DataFrame, late: str = "1 day") -> DataFrame:
    """Events (ts) joined with trips (start, end) of their user as both streams arrive."""
    e = events.withWatermark("ts", late).select(F.col("uid").alias("e_uid"), "event_id", "ts")
    t = trips.withWatermark("start", late).select("uid", "tid", "start", "end")
    return e.join(t, F.expr("e_uid = uid AND ts >= start AND ts <= end AND ts <= start + interval 2 days")).select("uid", "tid", "event_id", "ts")


def drained(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there into Parquet files."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
