"""Charging stations on a road map: nearest nodes and edges, edges split at stations, charge plans of trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamer.functions.geo import METRES, segment_fraction, spherical_distance
from roamer.operators import spatial
from roamer.operators.ev import CAPACITY, minutes_per_kwh


def by_node_distance(stations: DataFrame, nodes: DataFrame, far: float, split: float) -> DataFrame:
    """Stations (id, lon, lat) with their nearest node, ``metres`` to it and ``kind``: isolated beyond ``far``, split beyond ``split``, else node."""
    b = nodes.select(F.col("id").alias("id2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    d = F.col("d")
    kind = F.when(d > far, "isolated").when(d > split, "split").otherwise("node")
    return spatial.nearest(stations.select("id", "lon", "lat"), b, 1, metres=far).select("id", "lon", "lat", F.col("id2").alias("node"), d.alias("metres"), kind.alias("kind"))


def _plane(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north of the station, the short way round the globe."""
    east = F.pmod(lon - F.col("lon") + 540, F.lit(360.0)) - 180
    return F.radians(east) * F.cos(F.radians("lat")) * METRES, F.radians(lat - F.col("lat")) * METRES


def nearest_edges(stations: DataFrame, edges: DataFrame, far: float, step: float = 500.0) -> DataFrame:
    """Stations (id, lon, lat) with their nearest edge (u, v) within ``far`` metres, ties by u and v, and ``share``,
    the part of its length at which the vertex nearest to the station lies.

    ``edges`` (u, v, way: array of struct(lon, lat)) are probed at points at most ``step`` apart, so an edge within
    ``far`` has a probe within far + step / 2; only those are measured exactly.
    """
    way = F.col("way")
    a, b = F.col("s.a"), F.col("s.b")
    pairs = F.transform(F.sequence(F.lit(0), F.size(way) - 2), lambda i: F.struct(F.get(way, i).alias("a"), F.get(way, i + 1).alias("b")))
    legs = edges.where(F.size("way") >= 2).select("u", "v", F.explode(pairs).alias("s")).select("u", "v", "s", spherical_distance(a["lon"], a["lat"], b["lon"], b["lat"]).alias("leg"))
    n = F.greatest(F.lit(1), F.ceil(F.col("leg") / step)).cast("int")
    probes = legs.select("u", "v", "s", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("j"))
    at = lambda c: a[c] + (b[c] - a[c]) * F.col("j") / F.col("n")
    probes = probes.select(F.struct("u", "v", "s").alias("id2"), at("lon").alias("lon2"), at("lat").alias("lat2"))
    met = spatial.within(stations.select("id", "lon", "lat"), probes, far + step / 2).select("id", "lon", "lat", "id2.*").distinct()
    ax, ay = _plane(a["lon"], a["lat"])
    bx, by = _plane(b["lon"], b["lat"])
    u = F.coalesce(segment_fraction(ax, ay, bx, by, F.lit(0.0), F.lit(0.0)), F.lit(0.0))
    d = F.sqrt(F.pow(ax + u * (bx - ax), F.lit(2)) + F.pow(ay + u * (by - ay), F.lit(2)))
    best = met.select("id", "lon", "lat", F.struct(F.round(d, 3).alias("metres"), "u", "v").alias("e")).groupBy("id", "lon", "lat").agg(F.min("e").alias("e")).select("id", "lon", "lat", "e.*").where(F.col("metres") <= far)
    found = best.join(edges.select("u", "v", "way"), ["u", "v"])
    to = F.transform(way, lambda p: F.round(spherical_distance(p["lon"], p["lat"], F.col("lon"), F.col("lat")), 3))
    legs_ = F.transform(F.sequence(F.lit(0), F.size(way) - 2), lambda i: spherical_distance(F.get(way, i)["lon"], F.get(way, i)["lat"], F.get(way, i + 1)["lon"], F.get(way, i + 1)["lat"]))
    place = F.array_position(to, F.array_min(to)).cast("int") - 1
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    share = F.when(total(F.col("legs")) > 0, total(F.slice("legs", 1, F.col("place"))) / total(F.col("legs"))).otherwise(0.0)
    return found.select("id", "u", "v", "metres", legs_.alias("legs"), place.alias("place")).select("id", "u", "v", "metres", share.alias("share"))


def split_edges(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Directed edges (u, v, length) where each edge between u and v, either way, runs through the nodes -id of the
    stations ``placed`` on it (id, u, v, share from u), in the order of their shares, ties by id."""
    ways = placed.select("id", "u", "v", "share").unionByName(placed.select("id", F.col("v").alias("u"), F.col("u").alias("v"), (1 - F.col("share")).alias("share")))
    ways = ways.withColumn("tie", F.when(F.col("u") < F.col("v"), F.col("id")).otherwise(-F.col("id")))
    stops = ways.groupBy("u", "v").agg(F.array_sort(F.collect_list(F.struct("share", "tie", "id"))).alias("stops"))
    e = edges.select("u", "v", "length").join(stops, ["u", "v"], "left").withColumn("stops", F.coalesce("stops", F.array().cast("array<struct<share: double, tie: bigint, id: bigint>>")))
    ids = F.concat(F.array(F.col("u").cast("long")), F.transform("stops", lambda s: -s["id"]), F.array(F.col("v").cast("long")))
    at = F.concat(F.array(F.lit(0.0)), F.transform("stops", lambda s: s["share"]), F.array(F.lit(1.0)))
    e = e.select("length", ids.alias("ids"), at.alias("at"), F.explode(F.sequence(F.lit(0), F.size("stops"))).alias("i"))
    get = lambda c, i: F.get(F.col(c), i)
    i = F.col("i")
    return e.select(get("ids", i).alias("u"), get("ids", i + 1).alias("v"), (F.col("length") * (get("at", i + 1) - get("at", i))).alias("length"))


def charge_plans(legs: DataFrame, start: float, capacity: float = CAPACITY, spare: float = 8.0, next_trip: float = 0.0) -> DataFrame:
    """Full and partial charges at the stops behind all but the last leg of each trip (trip, leg, kwh, level), ties by kwh and level.

    Full: up to the capacity at each stop. Partial: what the next leg needs, at the first stop less what is left of
    ``start`` + ``spare`` kWh, after the last stop with ``next_trip`` more. ``over`` columns say by how much a charge
    exceeds the capacity (the first full one is not reported), ``minutes`` how long it takes at the stop's level.
    """
    w = Window.partitionBy("trip").orderBy("leg", "kwh", "level")
    last = F.lead("leg", 2).over(w).isNull()
    steps = legs.select("trip", "leg", "level", "kwh", F.row_number().over(w).alias("i"), (F.lead("kwh").over(w) + F.when(last, next_trip).otherwise(0.0)).alias("need"))
    left = start + spare - F.col("kwh")
    first, need = F.col("i") == 1, F.col("need")
    full = F.when(first, capacity - left).otherwise(F.col("kwh"))
    partial = F.when(~first, need).when(left > need, 0.0).otherwise(need - left)
    out = steps.where(need.isNotNull()).select("trip", "leg", "level", full.alias("full"), partial.alias("partial"), F.when(first, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("kwh") - capacity)).alias("over_full"), F.when(first & (left > need), 0.0).otherwise(F.greatest(F.lit(0.0), need - capacity)).alias("over_partial"))
    minutes = lambda c: F.col(c) * minutes_per_kwh(F.col("level"), F.col(c))
    return out.withColumns({"minutes_full": minutes("full"), "minutes_partial": minutes("partial")})
