"""From positions to trips."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamer.functions.geo import KILOMETRES, spherical_distance, sql_distance

POINT = "uid long, tid int, seq int, lon double, lat double, t long, hop_km double"


def by_gap(positions: DataFrame, gap: int) -> DataFrame:
    """Trip points (uid, tid, seq, lon, lat, t, hop_km): a new trip begins after more than ``gap`` seconds.

    One shuffle by user; all windows share its order.
    """
    w = Window.partitionBy("uid").orderBy("t", "event_id")
    step = positions.withColumn("_new", F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(1)))
    own = step.withColumn("tid", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    hop = F.when(F.col("_new") == 0, spherical_distance(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"), KILOMETRES)).otherwise(0.0)
    inside = Window.partitionBy("uid", "tid").orderBy("t", "event_id")
    own = own.withColumn("hop_km", hop).withColumn("seq", (F.row_number().over(inside) - 1).cast("int"))
    return own.select("uid", "tid", "seq", "lon", "lat", "t", "hop_km", "event_id")


def _km(a: tuple, b: tuple) -> float:
    dlon, dlat, mid = math.radians(a[0] - b[0]) / 2, math.radians(a[1] - b[1]) / 2, math.radians(a[1] + b[1]) / 2
    return 2 * KILOMETRES * math.asin(min(1.0, math.sqrt((math.sin(dlat) * math.cos(dlon)) ** 2 + (math.sin(dlon) * math.cos(mid)) ** 2)))


class Fold:
    """The segmentation of one user's points in time order; it holds the current trip only."""

    def __init__(self, gap: float, stop_km: float, max_speed: float) -> None:
        self.gap, self.stop_km, self.max_speed = gap, stop_km, max_speed
        self.tid, self.fresh, self.trip, self.last, self.anchor = 0, True, [], None, None

    def finished(self) -> list | None:
        return self.trip if len(self.trip) > 1 and not self.fresh else None

    def add(self, point: tuple) -> tuple[int, list] | None:
        """Take a point; return (tid, points) of the trip that it ended, if that is to be kept.

        A point too fast from the anchor is dropped. A stop (a long gap, or a long time near the anchor)
        ends the trip; the next begins where the last point was, at the new point's time, and the time of
        its second point moves halfway to its third.
        """
        if self.last is None:
            self.last = self.anchor = point
            self.trip = [(*point, 0.0)]
            return None
        hop, dt = _km(self.last, point), point[2] - self.last[2]
        away, since = _km(self.anchor, point), point[2] - self.anchor[2]
        if away > self.max_speed * since:
            return None
        if dt > self.gap or since > self.gap and away < self.stop_km:
            done = (self.tid, kept) if (kept := self.finished()) else None
            self.trip = [(self.last[0], self.last[1], point[2], 0.0), (*point, 0.0)]
            self.last = self.anchor = point
            self.tid, self.fresh = self.tid + 1, True
            return done
        if self.fresh and len(self.trip) > 1:
            lon, lat, _, h = self.trip[1]
            self.trip[1] = (lon, lat, self.trip[0][2] + int((point[2] - self.trip[0][2]) / 2), h)
        self.fresh, self.last = False, point
        if away > self.stop_km:
            self.anchor = point
        self.trip.append((*point, hop))
        return None


def _rows(uid: int, tid: int, trip: list) -> pa.RecordBatch:
    n, cols = len(trip), list(zip(*trip, strict=True))
    return pa.record_batch(
        [pa.array([uid] * n, pa.int64()), pa.array([tid] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())],
        names=["uid", "tid", "seq", "lon", "lat", "t", "hop_km"],
    )


def _folded(gap: float, stop_km: float, max_speed: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, fold = None, None
        for batch in batches:
            for u, t, lon, lat in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if fold is None or u != uid:
                    if fold and (kept := fold.finished()):
                        yield _rows(uid, fold.tid, kept)
                    uid, fold = u, Fold(gap, stop_km, max_speed)
                if done := fold.add((lon, lat, t)):
                    yield _rows(uid, *done)
        if fold and (kept := fold.finished()):
            yield _rows(uid, fold.tid, kept)

    return run


def by_thresholds(positions: DataFrame, temporal: float = 1200, spatial_m: float = 50, max_speed: float = 0.07) -> DataFrame:
    """Trip points by the stateful segmentation: ``temporal`` seconds, ``spatial_m`` metres, ``max_speed`` km/s.

    Points are shuffled and sorted by user once and stream through the fold, so a task never holds
    more than one trip of one user.
    """
    ordered = positions.select("uid", "t", "lon", "lat", "event_id").repartition("uid").sortWithinPartitions("uid", "t", "event_id")
    return ordered.select("uid", "t", "lon", "lat").mapInArrow(_folded(temporal, spatial_m / 1000, max_speed), POINT)


def in_chunks(positions: DataFrame, chunks: int) -> DataFrame:
    """Trip points with each user's points dealt into ``chunks`` runs of equal length."""
    w = Window.partitionBy("uid").orderBy("t", "event_id")
    size = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("uid")) / chunks)
    rn = F.row_number().over(w) - 1
    return positions.select("uid", F.floor(rn / size).cast("int").alias("tid"), (rn % size).cast("int").alias("seq"), "lon", "lat", "t", "event_id")


def stop_times(trips: DataFrame) -> DataFrame:
    """Seconds between the end of a trip and the start of the next of its user."""
    w = Window.partitionBy("uid").orderBy("start_ts", "tid")
    return trips.select("uid", "tid", (F.col("start_ts") - F.lag("end_ts").over(w)).alias("stop")).where("stop is not null")


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, width: int = 3, median: bool = False) -> DataFrame:
    """Moving average (or median) over ``width`` rows from each on; the last full window is left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    frame = w.rowsBetween(0, width - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = F.median(value) if median else F.avg(value)
    return df.select(*keys, order, out.over(frame).alias("smooth"), F.row_number().over(w).alias("_r"), n.alias("_n")).where(F.col("_r") <= F.col("_n") - width).drop("_r", "_n")


@functools.lru_cache(maxsize=4096)
def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t: bisection on its distribution function by Simpson's rule."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def upto(t: float) -> float:
        x = np.linspace(0, math.atan(t / math.sqrt(df)), 2001)  # t = sqrt(df) tan(x)
        y = np.cos(x) ** (df - 1)
        return 0.5 + c * math.sqrt(df) * (x[1] - x[0]) / 3 * float(y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())

    low, high = 0.0, 1.0
    while upto(high) < p and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):  # nothing lies between
            break
        low, high = (mid, high) if upto(mid) < p else (low, mid)
    return (low + high) / 2


def thompson(data: np.ndarray, point: float, alpha: float = 0.05) -> bool:
    """Whether a point is an outlier of the data: further from the mean than twice tau deviations."""
    n = len(data)
    if n < 3:
        return False
    t = t_quantile(1 - alpha / 2, n - 2)
    tau = t * (n - 1) / (math.sqrt(n) * math.sqrt(n - 2 + t * t))
    return abs(point - float(np.mean(data))) > tau * 2 * float(np.std(data))


def chauvenet(data: np.ndarray, point: float) -> bool:
    """Whether a point is to be accepted: its probability times the number of data is at least one half."""
    sd = float(np.std(data))
    return sd == 0 or len(data) * math.erfc(abs(point - float(np.mean(data))) / sd / math.sqrt(2)) >= 0.5


def quartile_outlier(data: np.ndarray, point: float) -> bool:
    """Whether a point lies 1.5 ranges outside the medians of the lower and upper half."""
    s = np.sort(np.asarray(data, float))
    half = len(s) // 2
    if not half:
        return False
    q1, q3 = float(np.median(s[:half])), float(np.median(s[-half:]))
    return not q1 - 1.5 * (q3 - q1) <= point <= q3 + 1.5 * (q3 - q1)


def adaptive_threshold(stops: np.ndarray, gap: int = 60, limit: int = 172800, window: int = 3, least: int = 10, default: float = 1200.0, median: bool = False) -> float:
    """The stop time that separates a user's pauses from stops: the first outlying bin from the long end of the histogram."""
    edges = np.arange(gap, limit + 1, gap)
    counts = np.histogram(stops, edges)[0][::-1]
    reverse = edges[::-1]
    fold = np.median if median else np.mean
    smooth = lambda v: np.array([fold(v[i : i + window]) for i in range(len(v) - window)])
    counts, reverse = smooth(counts), smooth(reverse)
    sums, squares = np.cumsum(counts), np.cumsum(counts**2)
    for cut in range(len(counts) - 1, least, -1):
        mean = sums[cut - 1] / cut
        sd = math.sqrt(max(squares[cut - 1] / cut - mean * mean, 0))
        if abs(counts[cut] - mean) > sd and thompson(counts[:cut], counts[cut]):
            return float(reverse[cut])
    return default


def by_adaptive_thresholds(positions: DataFrame, temporal: float = 120, spatial_m: float = 50, max_speed: float = 0.07, **options) -> DataFrame:
    """Two passes: stop times of a first segmentation set each user's own temporal threshold."""
    first = summarised(by_thresholds(positions, temporal, spatial_m, max_speed))

    def threshold(pdf):
        import pandas as pd

        return pd.DataFrame({"uid": [pdf["uid"].iloc[0]], "threshold": [adaptive_threshold(pdf["stop"].to_numpy(), **options)]})

    own = stop_times(first).groupBy("uid").applyInPandas(threshold, "uid long, threshold double")
    joined = positions.join(own, "uid", "left").select("uid", "t", "lon", "lat", "event_id", F.coalesce("threshold", F.lit(1200.0)).alias("threshold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, fold = None, None
        for batch in batches:
            for u, t, lon, lat, gap in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if fold is None or u != uid:
                    if fold and (kept := fold.finished()):
                        yield _rows(uid, fold.tid, kept)
                    uid, fold = u, Fold(gap, spatial_m / 1000, max_speed)
                if done := fold.add((lon, lat, t)):
                    yield _rows(uid, *done)
        if fold and (kept := fold.finished()):
            yield _rows(uid, fold.tid, kept)

    ordered = joined.repartition("uid").sortWithinPartitions("uid", "t", "event_id")
    return ordered.select("uid", "t", "lon", "lat", "threshold").mapInArrow(run, POINT)


def summarised(points: DataFrame) -> DataFrame:
    """Trips of at least two points: ends, length in km, duration in seconds.

    Aggregated before the shuffle; the partitioning of the points by user is reused where it is there.
    """
    end = lambda f, c: f(c, "seq").alias(f"{'first' if f is F.min_by else 'last'}_{c}")
    return (
        points.groupBy("uid", "tid")
        .agg(F.count(F.lit(1)).alias("n_points"), F.min_by("t", "seq").alias("start_ts"), F.max_by("t", "seq").alias("end_ts"), F.sum("hop_km").alias("length_km"), end(F.min_by, "lon"), end(F.min_by, "lat"), end(F.max_by, "lon"), end(F.max_by, "lat"))
        .where("n_points >= 2")
        .withColumn("duration", F.col("end_ts") - F.col("start_ts"))
    )


#: by_gap and summarised in SQL, after the history.
TRIPS_SQL = """
pos AS (SELECT * FROM history WHERE record_type = 'P'),
lagged AS (SELECT *, lag(t) OVER w AS pt, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM pos WINDOW w AS (PARTITION BY uid ORDER BY t, event_id)),
tagged AS (SELECT *, CASE WHEN pt IS NULL OR t - pt > 28800 THEN 1 ELSE 0 END AS fresh FROM lagged),
pts AS (SELECT *, (sum(fresh) OVER (PARTITION BY uid ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) - 1)::INT AS tid,
        CASE WHEN fresh = 0 THEN {hop} ELSE 0.0 END AS hop_km FROM tagged),
points AS (SELECT *, (row_number() OVER (PARTITION BY uid, tid ORDER BY t, event_id) - 1)::INT AS seq FROM pts),
trips AS (SELECT uid, tid, count(*) AS n_points, arg_min(t, seq) AS start_ts, arg_max(t, seq) AS end_ts, sum(hop_km) AS length_km,
          arg_min(lon, seq) AS first_lon, arg_min(lat, seq) AS first_lat, arg_max(lon, seq) AS last_lon, arg_max(lat, seq) AS last_lat,
          arg_max(t, seq) - arg_min(t, seq) AS duration FROM points GROUP BY uid, tid HAVING count(*) >= 2)
""".replace("{hop}", sql_distance("plon", "plat", "lon", "lat", KILOMETRES))
