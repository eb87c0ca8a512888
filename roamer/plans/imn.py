"""Individual mobility networks as documents, one per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamer.operators import locations, movements


def documents(trips: DataFrame, located: DataFrame, events: DataFrame) -> DataFrame:
    """uid and the JSON of its network: locations, movements, graph, statistics; map keys are text."""
    ft = movements.trip_locations(located)
    supports = movements.support(located)
    centre = locations.medoids(located).select("uid", "lid", "lon", "lat")
    stay = movements.stay_durations(movements.stays(ft, trips)).select("uid", "lid", "avg_stay", "std_stay")
    loc = supports.join(centre, ["uid", "lid"]).join(locations.radius(located, ["uid", "lid"]), ["uid", "lid"]).join(movements.location_entropy(ft), ["uid", "lid"], "left").join(stay, ["uid", "lid"], "left")
    regular = movements.regular(supports, ft).withColumn("regular", F.lit(True))
    loc = loc.join(regular, ["uid", "lid"], "left").withColumn("regular", F.coalesce("regular", F.lit(False)))
    pack = lambda df, name, key, *cols: df.groupBy("uid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), F.struct(*cols))))).alias(name))
    out = pack(loc, "locations", "lid", "lon", "lat", "support", "radius", "entropy", "avg_stay", "std_stay", "regular")
    mov = movements.movements(ft, trips).join(movements.movement_features(ft, trips).drop("support"), ["uid", "loc_from", "loc_to"])
    out = out.join(pack(mov, "movements", "mid", "loc_from", "loc_to", "tids", "support", "avg_length_km", "avg_duration", "std_length_km", "std_duration"), "uid")
    graph = mov.groupBy("uid").agg(F.struct(F.sort_array(F.collect_list(F.struct(F.col("loc_from").alias("source"), F.col("loc_to").alias("target"), F.col("support").alias("weight")))).alias("links")).alias("graph"))
    per = trips.groupBy("uid").agg(F.count(F.lit(1)).alias("n_trips"), F.sum("length_km").alias("km"))
    ev = events.groupBy("uid", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("uid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("events"))
    out = out.join(graph, "uid").join(per, "uid").join(movements.minimum_support(supports), "uid").join(ev, "uid", "left")
    return out.select("uid", "n_trips", F.to_json(F.struct(*[c for c in out.columns if c != "uid"])).alias("document"))
