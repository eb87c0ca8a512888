"""Locations: clusters of trip ends, their support, radius and entropy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamer.functions.geo import METRES, spherical_distance
from roamer.operators.clustering import linked_within


def endpoints(trips: DataFrame) -> DataFrame:
    """Two rows per trip: pid 2i from ('f') and 2i + 1 to ('t') of a user's i-th trip."""
    i = F.row_number().over(Window.partitionBy("uid").orderBy("start_ts", "tid")) - 1
    ends = F.array(
        F.struct((2 * i).alias("pid"), F.lit("f").alias("kind"), F.col("first_lon").alias("lon"), F.col("first_lat").alias("lat"), F.col("start_ts").alias("t")),
        F.struct((2 * i + 1).alias("pid"), F.lit("t").alias("kind"), F.col("last_lon").alias("lon"), F.col("last_lat").alias("lat"), F.col("end_ts").alias("t")),
    )
    return trips.select("uid", "tid", ends.alias("e")).select("uid", "tid", F.explode("e").alias("e")).select("uid", "tid", "e.*")


def by_linkage(ends: DataFrame, metres: float, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """Ends with ``lid``: single-linkage clusters cut at ``metres``, numbered by falling support, then first pid."""
    schema = ", ".join(f"{k} long" for k in keys) + ", pid int, root int"

    def labels(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        root = linked_within(pdf["lon"].to_numpy(), pdf["lat"].to_numpy(), metres)
        return pdf[[*keys, "pid"]].assign(root=pdf["pid"].to_numpy()[root])

    found = ends.select(*keys, "pid", "lon", "lat").groupBy(*keys).applyInPandas(labels, schema)
    return ends.join(found, [*keys, "pid"]).join(numbered(found, keys), [*keys, "root"]).drop("root")


def numbered(labelled: DataFrame, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """lid of each root: rank by falling support, ties by the root (the first pid)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("support"), "root")
    return labelled.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("support")).select(*keys, "root", (F.row_number().over(w) - 1).cast("int").alias("lid"))


def nearest(ends: DataFrame, centres: DataFrame) -> DataFrame:
    """Ends with the ``lid`` of their user's nearest centre (uid, lid, lon, lat); the lowest lid wins ties."""
    c = centres.select("uid", "lid", F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"))
    d = spherical_distance(F.col("lon"), F.col("lat"), F.col("c_lon"), F.col("c_lat"))
    return ends.join(c, "uid").groupBy("uid", "pid").agg(F.min(F.struct(d.alias("d"), "lid")).alias("_m")).select("uid", "pid", F.col("_m.lid").alias("lid"), F.col("_m.d").alias("metres"))


def medoids(located: DataFrame) -> DataFrame:
    """The end with the least total distance to the others of its location, the first pid on ties."""
    a = located.select("uid", "lid", "pid", "lon", "lat")
    b = located.select("uid", "lid", F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"))
    total = a.join(b, ["uid", "lid"]).groupBy("uid", "lid", "pid", "lon", "lat").agg(F.round(F.sum(spherical_distance(F.col("lon"), F.col("lat"), F.col("b_lon"), F.col("b_lat"))), 3).alias("total"))
    return total.groupBy("uid", "lid").agg(F.min(F.struct("total", "pid", "lon", "lat")).alias("m")).select("uid", "lid", "m.pid", "m.lon", "m.lat", "m.total")


def radius(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean distance of the points of each group to their mean point, in metres."""
    centre = points.groupBy(*keys).agg(F.avg("lon").alias("c_lon"), F.avg("lat").alias("c_lat"))
    return points.join(centre, keys).groupBy(*keys).agg(F.avg(spherical_distance(F.col("lon"), F.col("lat"), F.col("c_lon"), F.col("c_lat"))).alias("radius"))


def cells(lon: np.ndarray, lat: np.ndarray) -> tuple[int, int]:
    """(coarse, fine): how many geohash cells of five and of seven characters the points lie in, the bounds of a user's number of clusters."""
    count = lambda a, b: len(np.unique(np.column_stack([np.floor((lon + 180) / (360.0 / a)), np.floor((lat + 90) / (180.0 / b))]), axis=0))
    return count(8192, 4096), count(262144, 131072)


def tosca_locations(ends: DataFrame, metres: float = 50.0, runs: int = 5) -> DataFrame:
    """Ends with ``lid`` by TOSCA: the run with the fewest clusters, nearest medoid, numbered by support."""
    from roamer.operators.clustering import tosca

    def labels(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        xy = projected(pdf["lon"].to_numpy(), pdf["lat"].to_numpy())
        uid = int(pdf["uid"].iloc[0])
        kmin, kmax = cells(pdf["lon"].to_numpy(), pdf["lat"].to_numpy())
        best = min((tosca(xy, metres, np.random.default_rng([uid & 0x7FFFFFFF, run]), kmin, kmax) for run in range(runs)), key=len)
        near = np.argmin(((xy[:, None, :] - xy[best][None, :, :]) ** 2).sum(axis=2), axis=1)
        return pdf[["uid", "pid"]].assign(root=pdf["pid"].to_numpy()[np.asarray(best)][near])

    found = ends.select("uid", "pid", "lon", "lat").groupBy("uid").applyInPandas(labels, "uid long, pid int, root int")
    return ends.join(found, ["uid", "pid"]).join(numbered(found), ["uid", "root"]).drop("root")


def projected(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Metres east and north of the mean point."""
    mid = math.radians(float(np.mean(lat)))
    return np.column_stack([np.radians(lon - lon.mean()) * METRES * math.cos(mid), np.radians(lat - lat.mean()) * METRES])
