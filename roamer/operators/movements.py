"""Movements between locations, regular locations, and what is counted on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamer.functions import clock, geo, stats
from roamer.operators import cells, tripdist

#: More periods than any history has months.
PERIODS = 100000


def trip_locations(located: DataFrame) -> DataFrame:
    """(uid, tid, loc_from, loc_to) from located ends."""
    at = lambda k: F.max(F.when(F.col("kind") == k, F.col("lid")))
    return located.groupBy("uid", "tid").agg(at("f").alias("loc_from"), at("t").alias("loc_to"))


def movements(from_to: DataFrame, trips: DataFrame) -> DataFrame:
    """(uid, mid, loc_from, loc_to, tids, support); mid in the order of the first trip."""
    t = from_to.join(trips.select("uid", "tid", "start_ts"), ["uid", "tid"])
    m = t.groupBy("uid", "loc_from", "loc_to").agg(F.sort_array(F.collect_list("tid")).alias("tids"), F.count(F.lit(1)).alias("support"), F.min(F.struct("start_ts", "tid")).alias("_first"))
    return m.withColumn("mid", (F.row_number().over(Window.partitionBy("uid").orderBy("_first")) - 1).cast("int")).drop("_first")


def movement_features(from_to: DataFrame, trips: DataFrame) -> DataFrame:
    """Per movement: support, and median, mean and deviation of length and duration, each within its quartile range.

    One shuffle: a row holds the measures of one user's movement.
    """
    keys, measures = ["uid", "loc_from", "loc_to"], ["length_km", "duration"]
    t = from_to.join(trips.select("uid", "tid", *measures), ["uid", "tid"])
    lists = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("support"), *[F.array_sort(F.collect_list(F.col(c).cast("double"))).alias(c) for c in measures])
    kept = lists.select(*keys, "support", *[stats.within_own_quartiles(F.col(c)).alias(c) for c in measures]).where(F.least(*map(F.size, measures)) > 0)
    means = kept.withColumns({f"avg_{c}": stats.mean_of(F.col(c)) for c in measures})
    std = lambda c: F.sqrt(stats.mean_of(F.transform(c, lambda x: F.pow(x - F.col(f"avg_{c}"), F.lit(2))))).alias(f"std_{c}")
    return means.select(*keys, "support", *[x for c in measures for x in (stats.quantile_of(F.col(c), 0.5).alias(f"median_{c}"), F.col(f"avg_{c}"), std(c))])


def prototypes(from_to: DataFrame, points: DataFrame) -> DataFrame:
    """(uid, loc_from, loc_to, tid): the trip of each movement with the least sum of synchronised distances to its others, ties
    by the smallest tid; of fewer than three trips, or where no sum is finite, the first by start.

    A task holds the trips of one user's movement; no pair of trips leaves it.
    """
    trip = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat", F.col("t").cast("double").alias("ts"))))
    ways = points.groupBy("uid", "tid").agg(trip.alias("way")).join(from_to.select("uid", "tid", "loc_from", "loc_to"), ["uid", "tid"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        trips = sorted(([(z["lon"], z["lat"], z["ts"]) for z in w], int(i)) for i, w in zip(pdf["tid"], pdf["way"], strict=True))
        trips.sort(key=lambda x: (x[0][0][2], x[1]))
        best = trips[0][1]
        if len(trips) > 2:
            total = dict.fromkeys((i for _, i in trips), 0.0)
            for k, (a, i) in enumerate(trips):
                for b, j in trips[k + 1 :]:
                    d = tripdist.synchronised(a, b)
                    total[i], total[j] = total[i] + d, total[j] + d
            finite = {i: round(d, 6) for i, d in total.items() if np.isfinite(d)}
            best = min(finite, key=lambda i: (finite[i], i)) if finite else best
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in ("uid", "loc_from", "loc_to")} | {"tid": [best]})

    return ways.groupBy("uid", "loc_from", "loc_to").applyInPandas(one, "uid long, loc_from int, loc_to int, tid int")


def leave_arrive(located: DataFrame, trips: DataFrame) -> DataFrame:
    """Per location, kind of end (f leaves, t arrives), weekend and day or night: mean and deviation of the second of the day
    and of the trips' duration and length, and the count."""
    e = located.join(trips.select("uid", "tid", "duration", "length_km"), ["uid", "tid"])
    e = e.withColumns({"weekend": clock.weekend(F.col("t")), "part": clock.day_night(F.col("t")), "second": clock.second_of_day(F.col("t"))})
    aggs = [f(c).alias(f"{n}_{c}") for c in ("second", "duration", "length_km") for n, f in (("avg", F.avg), ("std", F.stddev_pop))]
    return e.groupBy("uid", "lid", "kind", "weekend", "part").agg(F.count(F.lit(1)).alias("n"), *aggs)


def centre_distances(centres: DataFrame) -> DataFrame:
    """The matrix of each user's centres (uid, lid, lon, lat), a row a pair: Euclidean in degrees and spherical in metres."""
    b = centres.select("uid", F.col("lid").alias("other"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    c = [F.col(x) for x in ("lon", "lat", "lon2", "lat2")]
    return centres.join(b, "uid").select("uid", "lid", "other", geo.euclidean(*c).alias("degrees"), geo.spherical_distance(*c).alias("metres"))


def in_periods(trips: DataFrame, months: int) -> DataFrame:
    """Trips whose ``uid`` stands for a user in a period of so many months from 1970 on, so that networks are made by period; ``user_and_period`` gives both back."""
    at = F.timestamp_seconds("start_ts")
    period = F.floor(((F.year(at) - 1970) * 12 + F.month(at) - 1) / months)
    return trips.withColumn("uid", F.col("uid") * PERIODS + period)


def user_and_period(df: DataFrame) -> DataFrame:
    return df.withColumns({"period": F.pmod("uid", F.lit(PERIODS)), "uid": F.floor(F.col("uid") / PERIODS)})


def in_windows(trips: DataFrame, windows: DataFrame) -> DataFrame:
    """Trips whose ``uid`` stands for a user in the training or test part of a window; ``user_and_window`` gives all three back."""
    met = cells.in_windows(trips, windows, "start_ts")
    return met.withColumn("uid", F.col("uid") * PERIODS + F.col("index") * 2 + (F.col("part") == "test").cast("int")).drop("index", "part")


def user_and_window(df: DataFrame) -> DataFrame:
    code = F.pmod("uid", F.lit(PERIODS))
    return df.withColumns({"index": F.shiftright(code, 1), "part": F.when(code % 2 == 1, "test").otherwise("train"), "uid": F.floor(F.col("uid") / PERIODS)})


def support(located: DataFrame) -> DataFrame:
    return located.groupBy("uid", "lid").agg(F.count(F.lit(1)).alias("support"))


def minimum_support(supports: DataFrame) -> DataFrame:
    """The knee of each user's sorted supports: the one furthest from the chord, the first if several."""
    w = Window.partitionBy("uid").orderBy("support", "lid")
    all_ = Window.partitionBy("uid")
    s = supports.select("uid", "support", (F.row_number().over(w) - 1).alias("i"), (F.count(F.lit(1)).over(all_) - 1).alias("n"), F.min("support").over(all_).alias("low"), F.max("support").over(all_).alias("high"))
    rise = F.col("high") - F.col("low")
    norm = F.sqrt(F.pow("n", F.lit(2)) + F.pow(rise, F.lit(2)))
    off = F.when(norm > 0, F.round(F.abs(rise * F.col("i") - F.col("n") * (F.col("support") - F.col("low"))) / norm, 9)).otherwise(0.0)
    return s.groupBy("uid").agg(F.min_by("support", F.struct((-off).alias("d"), "i")).alias("min_support"))


def regular(supports: DataFrame, from_to: DataFrame, prune: bool = True) -> DataFrame:
    """(uid, lid) of regular locations: support from the knee on; pruned, while more than two remain, of those
    without a movement to another regular one, one at a time in order of lid.
    """
    some = supports.join(minimum_support(supports), "uid").where("support >= min_support").select("uid", "lid")
    if not prune:
        return some
    out = from_to.where("loc_from <> loc_to").groupBy("uid", F.col("loc_from").alias("lid")).agg(F.collect_set("loc_to").alias("next"))

    def pruned(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {int(r.lid): set() if r.next is None else set(map(int, r.next)) for r in pdf.sort_values("lid").itertuples()}
        while len(left) > 2:
            gone = next((k for k, n in left.items() if not n & left.keys()), None)
            if gone is None:
                break
            del left[gone]
        return pd.DataFrame({"uid": [pdf["uid"].iloc[0]] * len(left), "lid": list(left)})

    return some.join(out, ["uid", "lid"], "left").groupBy("uid").applyInPandas(pruned, "uid long, lid int")


def next_counts(from_to: DataFrame) -> DataFrame:
    return from_to.groupBy("uid", F.col("loc_from").alias("lid"), F.col("loc_to").alias("next")).agg(F.count(F.lit(1)).alias("n"))


def location_entropy(from_to: DataFrame) -> DataFrame:
    return stats.entropy(next_counts(from_to), ["uid", "lid"])


def covered(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, minute, n): how many spans (keys, a, b) of whole minutes, both included, cover each minute of the day; one with a > b goes past midnight.

    Spans become steps up and down, summed before the shuffle; a key then has at most 1,441 steps, and only
    minutes of the result are made into rows.
    """
    step = lambda at, by: F.struct(at.cast("int").alias("minute"), F.lit(by).alias("by"))
    a, b = F.col("a"), F.col("b")
    ends = [step(a, 1), step(b + 1, -1)]
    steps = F.when(a <= b, F.array(*ends)).otherwise(F.array(*ends, step(F.lit(0), 1), step(F.lit(1440), -1)))
    summed = spans.select(*keys, F.explode(steps).alias("s")).groupBy(*keys, F.col("s.minute").alias("at")).agg(F.sum("s.by").alias("by"))
    w = Window.partitionBy(*keys).orderBy("at")
    runs = summed.select(*keys, "at", F.sum("by").over(w).alias("n"), F.lead("at").over(w).alias("until")).where("n > 0")
    return runs.select(*keys, F.explode(F.sequence(F.col("at"), F.col("until") - 1)).alias("minute"), "n")


def stay_minutes(located: DataFrame) -> DataFrame:
    """How many stays of a location cover each minute of the day: from an arrival to the location's next end, wrapping once past midnight."""
    w = Window.partitionBy("uid", "lid").orderBy("t", "pid")
    s = located.select("uid", "lid", "kind", "t", F.lead("t").over(w).alias("leave")).where("kind = 't' and leave is not null")
    a, b = (F.floor(F.pmod(c, F.lit(clock.DAY)) / 60).cast("int") for c in (F.col("t"), F.col("leave")))
    return covered(s.select("uid", "lid", a.alias("a"), b.alias("b")), ["uid", "lid"])


def stay_shares(minutes: DataFrame) -> DataFrame:
    """Each location's share of its user's stays in a minute."""
    return minutes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("uid", "minute")))


def travel_minutes(from_to: DataFrame, trips: DataFrame) -> DataFrame:
    """How many trips to each next location cover a minute of the day; a trip past midnight covers none."""
    t = from_to.join(trips.select("uid", "tid", "start_ts", "end_ts"), ["uid", "tid"])
    m = lambda c: F.floor(F.pmod(F.col(c), F.lit(clock.DAY)) / 60).cast("int")
    t = t.select("uid", "loc_from", "loc_to", m("start_ts").alias("a"), m("end_ts").alias("b")).where("a <= b")
    return covered(t, ["uid", "loc_from", "loc_to"])


def stays(from_to: DataFrame, trips: DataFrame) -> DataFrame:
    """Stays between consecutive trips where the second leaves from where the first arrived: arrive, leave."""
    w = Window.partitionBy("uid").orderBy("start_ts", "tid")
    t = from_to.join(trips.select("uid", "tid", "start_ts", "end_ts"), ["uid", "tid"])
    s = t.select("uid", F.col("loc_from").alias("lid"), F.lag("loc_to").over(w).alias("_to"), F.lag("end_ts").over(w).alias("arrive"), F.col("start_ts").alias("leave"))
    return s.where("_to = lid").drop("_to")


def stay_durations(stays_: DataFrame) -> DataFrame:
    d = F.col("leave") - F.col("arrive")
    return stays_.groupBy("uid", "lid").agg(F.avg(d).alias("avg_stay"), F.stddev_pop(d).alias("std_stay"), F.count(F.lit(1)).alias("n"))


def slot_days(stays_: DataFrame) -> DataFrame:
    """Distinct days on which a location is occupied in each slot of weekdays and weekends: hourly over the stay, and at its ends."""
    at = F.array_union(F.sequence("arrive", "leave", F.lit(3600)), F.array("leave"))
    t = stays_.select("uid", "lid", F.explode(at).alias("t"))
    return t.groupBy("uid", "lid", clock.weekend(F.col("t")).alias("weekend"), clock.slot(F.col("t")).alias("slot")).agg(F.countDistinct(clock.day(F.col("t"))).alias("days"))


def day_night_seconds(stays_: DataFrame) -> DataFrame:
    """Seconds of stay by day (8 to 19 o'clock) and night, on weekdays and weekends, day by day."""
    d = stays_.select("uid", "lid", "arrive", "leave", F.explode(F.sequence(F.floor(F.col("arrive") / clock.DAY), F.floor(F.col("leave") / clock.DAY))).alias("d"))
    start = F.col("d") * clock.DAY
    whole = clock.overlap(F.col("arrive"), F.col("leave"), start, start + clock.DAY)
    light = clock.overlap(F.col("arrive"), F.col("leave"), start + 8 * 3600, start + 19 * 3600)
    d = d.select("uid", "lid", (F.pmod(F.col("d") + 3, F.lit(7)) >= 5).alias("weekend"), light.alias("day"), (whole - light).alias("night"))
    return d.groupBy("uid", "lid", "weekend").agg(F.sum("day").alias("day"), F.sum("night").alias("night"))


def event_features(events: DataFrame, from_to: DataFrame) -> DataFrame:
    """Per movement and event type: mean and deviation of the measures, and the count."""
    e = events.join(from_to, ["uid", "tid"])
    aggs = [f(c).alias(f"{n}_{c}") for c in ("speed", "max_acc", "avg_acc", "duration") for n, f in (("avg", F.avg), ("std", F.stddev_pop))]
    return e.groupBy("uid", "loc_from", "loc_to", "event_type").agg(*aggs, F.count(F.lit(1)).alias("n"))


def graph_summary(from_to: DataFrame) -> DataFrame:
    """Nodes, edges, density and mean degree of each user's movement graph."""
    e = from_to.select("uid", F.col("loc_from").alias("a"), F.col("loc_to").alias("b")).distinct()
    nodes = e.select("uid", F.explode(F.array("a", "b")).alias("n")).distinct().groupBy("uid").agg(F.count(F.lit(1)).alias("nodes"))
    edges = e.groupBy("uid").agg(F.count(F.lit(1)).alias("edges"))
    n = F.col("nodes")
    return nodes.join(edges, "uid").withColumn("density", F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0)).withColumn("degree", 2 * F.col("edges") / n)
