"""Canonical tables: mobility history and its three parts.

History rows are (uid, t, event_id, record_type, lon, lat, speed, max_acc,
avg_acc, angle, duration, location_type): t in epoch seconds (UTC), P for
positions, X for crashes, anything else an event of that type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def history_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history derived from the ``events`` table, which has no coordinates of its own: five places per user with small jitter."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, uid = F.col("k"), F.col("uid")
    base = e.select("event_id", F.col("user_id").cast("long").alias("uid"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    lon = F.lit(11.0) + F.pmod(uid * 37 + (k % 5) * 131, F.lit(997)) / 2000.0 + F.floor(k / 5) * 0.00002
    lat = F.lit(43.5) + F.pmod(uid * 53 + (k % 5) * 197, F.lit(991)) / 2000.0 + F.pmod(k * 7, F.lit(20)) * 0.00002
    kind = F.when(F.col("event_type") == "signup", "X").when(F.col("event_type") == "error", F.element_at(F.array(*map(F.lit, "QBAC")), F.col("k") % 4 + 1)).otherwise("P")
    whole = F.floor("value").cast("int")
    return base.select(
        "uid", "t", "event_id", kind.alias("record_type"), lon.alias("lon"), lat.alias("lat"), whole.alias("speed"), (whole % 50 - 25).alias("max_acc"), (whole % 20 - 10).alias("avg_acc"), (whole % 360).alias("angle"), (k % 10).alias("duration"), (k % 3).cast("string").alias("location_type")
    )


#: The same in DuckDB SQL, as the body of WITH.
HISTORY_SQL = """
ev AS (SELECT event_id, user_id::BIGINT AS uid, floor(epoch(ts))::BIGINT AS t, event_type, value, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events),
history AS (SELECT uid, t, event_id, k,
  CASE WHEN event_type = 'signup' THEN 'X' WHEN event_type = 'error' THEN ['Q', 'B', 'A', 'C'][k % 4 + 1] ELSE 'P' END AS record_type,
  11.0::DOUBLE + ((uid * 37 + (k % 5) * 131) % 997) / 2000.0::DOUBLE + floor(k / 5) * 0.00002::DOUBLE AS lon,
  43.5::DOUBLE + ((uid * 53 + (k % 5) * 197) % 991) / 2000.0::DOUBLE + ((k * 7) % 20) * 0.00002::DOUBLE AS lat,
  floor(value)::INT AS speed, floor(value)::INT % 50 - 25 AS max_acc, floor(value)::INT % 20 - 10 AS avg_acc, floor(value)::INT % 360 AS angle,
  k % 10 AS duration, (k % 3)::VARCHAR AS location_type FROM ev)
"""


def routed(history: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(positions, crashes, events) of a history; positions drop coordinates that are no finite numbers."""
    finite = ~F.isnan("lon") & ~F.isnan("lat") & (F.abs("lon") <= 180) & (F.abs("lat") <= 90)
    positions = history.where((F.col("record_type") == "P") & finite).select("uid", "t", "event_id", "lon", "lat", "speed")
    crashes = history.where("record_type = 'X'").select("uid", "t", "event_id", "speed", "max_acc", F.col("angle").alias("heading"), "lon", "lat")
    events = history.where("record_type NOT IN ('P', 'X')").select("uid", "t", "event_id", F.col("record_type").alias("event_type"), "speed", "max_acc", "avg_acc", "angle", "location_type", "duration", "lon", "lat")
    return positions, crashes, events


def time_range(history: DataFrame, uid: int, first: int, last: int) -> DataFrame:
    """A user's rows with first <= t <= last; both predicates reach the scan."""
    return history.where((F.col("uid") == uid) & F.col("t").between(first, last))


def users(history: DataFrame) -> DataFrame:
    return history.select("uid").distinct()


def top_users(history: DataFrame, limit: int) -> DataFrame:
    """The users with the most rows; ties by id."""
    return history.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "uid").limit(limit)
