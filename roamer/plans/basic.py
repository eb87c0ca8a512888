"""Scans, filters, trips, aggregates over trips, event assignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roamer.functions import clock, geo, quadtree
from roamer.operators import assign, segment
from roamer.plans.registry import WITH_HISTORY, WITH_TRIPS, history, points, positions, query, r, table, trips
from roamer.sources import files, tables

T1 = "(SELECT min(t) FROM history)"


@query(WITH_TRIPS + "SELECT uid, count(*) AS n_trips, round(sum(length_km), 6) AS tot_km, sum(duration)::BIGINT AS tot_seconds, round(avg(length_km / (duration / 3600.0)), 6) AS avg_speed FROM trips WHERE duration > 0 GROUP BY uid")
def trip_summary(spark, sf):
    t = trips(spark, sf).where("duration > 0")
    return t.groupBy("uid").agg(F.count(F.lit(1)).alias("n_trips"), F.round(F.sum("length_km"), 6).alias("tot_km"), F.sum("duration").alias("tot_seconds"), F.round(F.avg(F.col("length_km") / (F.col("duration") / 3600.0)), 6).alias("avg_speed"))


@query(WITH_HISTORY + "SELECT uid, t, event_id, record_type, round(lon, 6) AS lon, round(lat, 6) AS lat FROM history WHERE uid = 7 AND t BETWEEN 1704067200 AND 1735689600")
def s01_time_range_scan(spark, sf):
    return tables.time_range(history(spark, sf), 7, 1704067200, 1735689600).select("uid", "t", "event_id", "record_type", r("lon"), r("lat"))


@query(WITH_HISTORY + "SELECT record_type, count(*) AS n, sum(speed)::BIGINT AS speed, sum(max_acc)::BIGINT AS max_acc, sum(angle)::BIGINT AS angle FROM history GROUP BY record_type")
def s02_record_router(spark, sf):
    p, x, e = tables.routed(history(spark, sf))
    z = lambda c: F.col(c).cast("long")
    h = history(spark, sf).select("event_id", "max_acc", "angle")
    some = p.select("event_id", F.lit("P").alias("record_type"), z("speed").alias("speed")).unionByName(x.select("event_id", F.lit("X").alias("record_type"), z("speed").alias("speed"))).unionByName(e.select("event_id", F.col("event_type").alias("record_type"), z("speed").alias("speed")))
    return some.join(h, "event_id").groupBy("record_type").agg(F.count(F.lit(1)).alias("n"), F.sum("speed").alias("speed"), F.sum("max_acc").alias("max_acc"), F.sum("angle").alias("angle"))


@query(WITH_HISTORY + "SELECT DISTINCT uid FROM history")
def s04_users(spark, sf):
    return tables.users(history(spark, sf))


@query(WITH_HISTORY + "SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, t FROM history WHERE uid = 3")
def s05_user_points(spark, sf):
    return history(spark, sf).where("uid = 3").select(r("lon"), r("lat"), "t").orderBy("t")


@query(WITH_HISTORY + "SELECT uid, t, event_id, record_type FROM history ORDER BY t, event_id LIMIT 1")
def s06_first_document(spark, sf):
    return history(spark, sf).select("uid", "t", "event_id", "record_type").orderBy("t", "event_id").limit(1)


@query(WITH_HISTORY + "SELECT uid, t, event_id, record_type FROM history WHERE uid = 3 ORDER BY t, event_id LIMIT 1")
def s11_first_document_of_a_user(spark, sf):
    return history(spark, sf).where("uid = 3").select("uid", "t", "event_id", "record_type").orderBy("t", "event_id").limit(1)


@query(WITH_HISTORY + "SELECT uid, count(*) AS n FROM history GROUP BY uid ORDER BY n DESC, uid LIMIT 10")
def s07_top_users(spark, sf):
    return tables.top_users(history(spark, sf), 10)


@query(WITH_HISTORY + "SELECT uid, t, event_id FROM history WHERE uid IN (SELECT user_id FROM events WHERE event_id < 20)")
def s14_j17_semi_join_users(spark, sf):
    chosen = table(spark, sf, "events").where("event_id < 20").select(F.col("user_id").alias("uid")).distinct()
    return history(spark, sf).join(chosen, "uid", "left_semi").select("uid", "t", "event_id")


@query(WITH_HISTORY + "SELECT DISTINCT uid FROM history WHERE uid NOT IN (SELECT user_id FROM events WHERE event_id < 20)")
def s16_u03_resume_users(spark, sf):
    done = table(spark, sf, "events").where("event_id < 20").select(F.col("user_id").alias("uid"))
    return files.resumed(tables.users(history(spark, sf)), done)


@query(WITH_TRIPS + "SELECT uid, tid, round(length_km, 6) AS length_km, duration FROM trips WHERE length_km > 1 AND duration > 600")
def s22_p02_trips_long_and_slow(spark, sf):
    return trips(spark, sf).where("length_km > 1 AND duration > 600").select("uid", "tid", r("length_km"), "duration")


@query(WITH_TRIPS + "SELECT uid, tid, start_ts, end_ts FROM trips WHERE length_km > 1 AND duration > 600 AND start_ts >= 1704067200 AND end_ts <= 1706745600")
def s23_trips_in_range(spark, sf):
    return trips(spark, sf).where("length_km > 1 AND duration > 600 AND start_ts >= 1704067200 AND end_ts <= 1706745600").select("uid", "tid", "start_ts", "end_ts")


@query(WITH_HISTORY + "SELECT uid, event_id, record_type AS event_type, abs(max_acc) AS max_acc, abs(avg_acc) AS avg_acc FROM history WHERE record_type NOT IN ('P', 'X')")
def s24_event_history(spark, sf):
    return tables.routed(history(spark, sf))[2].select("uid", "event_id", "event_type", F.abs("max_acc").alias("max_acc"), F.abs("avg_acc").alias("avg_acc"))


@query(WITH_TRIPS + "SELECT split_part(id, '_', 1)::BIGINT AS uid, count(*) AS n, min(id) AS first_id FROM (SELECT uid || '_' || tid AS id FROM trips WHERE uid IN (1, 2, 3, 5, 8)) GROUP BY 1")
def s25_histories_by_id_prefix(spark, sf):
    ids = trips(spark, sf).where(F.col("uid").isin(1, 2, 3, 5, 8)).select(F.concat_ws("_", "uid", "tid").alias("id"))
    return ids.groupBy(F.split("id", "_")[0].cast("long").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(WITH_TRIPS + "SELECT uid, count(*) AS n, max(tid) AS last_tid, round(avg(length_km), 6) AS avg_km, round(avg(duration), 6) AS avg_s, count(*) FILTER (WHERE length_km > 10) AS n_long FROM trips GROUP BY uid")
def s26_s27_s28_s29_user_statistics(spark, sf):
    return trips(spark, sf).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.max("tid").alias("last_tid"), F.round(F.avg("length_km"), 6).alias("avg_km"), F.round(F.avg("duration"), 6).alias("avg_s"), F.count_if(F.col("length_km") > 10).alias("n_long"))


@query(WITH_TRIPS + "SELECT uid, max(length_km) > 100 AS very_long FROM trips WHERE length_km > 20 GROUP BY uid ORDER BY uid LIMIT 30")
def s21_s30_s31_s32_user_lists(spark, sf):
    return trips(spark, sf).where("length_km > 20").groupBy("uid").agg((F.max("length_km") > 100).alias("very_long")).orderBy("uid").limit(30)


@query(WITH_TRIPS + "SELECT uid, tid, start_ts FROM trips WHERE month(make_timestamp(start_ts * 1000000)) IN (1, 2) AND day(make_timestamp(start_ts * 1000000)) < 15 AND length_km > 0.2 AND uid IN (SELECT uid FROM history WHERE record_type = 'X')")
def s33_s34_area_month_extract(spark, sf):
    t, crashed = trips(spark, sf), tables.routed(history(spark, sf))[1].select("uid").distinct()
    at = F.timestamp_seconds("start_ts")
    return t.where(F.month(at).isin(1, 2) & (F.dayofmonth(at) < 15) & (F.col("length_km") > 0.2)).join(crashed, "uid", "left_semi").select("uid", "tid", "start_ts")


@query(WITH_TRIPS + "SELECT t.uid, t.tid, a.event_id AS start_event, b.event_id AS end_event FROM trips t LEFT JOIN points a ON a.uid = t.uid AND a.tid = t.tid AND a.seq = 0 LEFT JOIN points b ON b.uid = t.uid AND b.tid = t.tid AND b.seq = t.n_points - 1")
def s35_endpoint_lookup(spark, sf):
    p, t = points(spark, sf), trips(spark, sf).select("uid", "tid", "n_points")
    ends = p.join(t, ["uid", "tid"]).where("seq = 0 OR seq = n_points - 1")
    return ends.groupBy("uid", "tid").agg(F.min_by("event_id", "seq").alias("start_event"), F.max_by("event_id", "seq").alias("end_event"))


@query(WITH_TRIPS + "SELECT count(*) AS n, count(DISTINCT uid) AS n_users, round(max(length_km), 6) AS max_km, max(duration) AS max_s, min(start_ts) AS first_start, max(end_ts) AS last_end FROM trips")
def s43_exploration(spark, sf):
    return trips(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("n_users"), F.round(F.max("length_km"), 6).alias("max_km"), F.max("duration").alias("max_s"), F.min("start_ts").alias("first_start"), F.max("end_ts").alias("last_end"))


@query("SELECT o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, kind")
def s43_a28_value_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


@query(WITH_TRIPS + "SELECT uid, tid FROM trips WHERE duration > 20000 OR length_km > 40")
def p01_trip_filter_or(spark, sf):
    return trips(spark, sf).where("duration > 20000 OR length_km > 40").select("uid", "tid")


@query(WITH_TRIPS + "SELECT t.uid, tid FROM trips t JOIN (SELECT uid FROM trips GROUP BY uid HAVING count(*) >= 10) u ON u.uid = t.uid")
def p03_minimum_trips(spark, sf):
    t = trips(spark, sf)
    return t.join(t.groupBy("uid").count().where("count >= 10"), "uid", "left_semi").select("uid", "tid")


@query(WITH_HISTORY + "SELECT uid, event_id, lat BETWEEN 43.6 AND 43.8 AND lon > 11.1 AND lon < 11.3 AS inside, CASE record_type WHEN 'P' THEN 'position' WHEN 'X' THEN 'crash' ELSE 'event' END AS category FROM history WHERE lon IS NOT NULL AND NOT isnan(lon)")
def p04_p05_p06_inside_and_category(spark, sf):
    names = spark.createDataFrame([("P", "position"), ("X", "crash")], "record_type string, category string")
    h = history(spark, sf).where("lon is not null and not isnan(lon)")
    return h.join(F.broadcast(names), "record_type", "left").select("uid", "event_id", (F.col("lat").between(43.6, 43.8) & (F.col("lon") > 11.1) & (F.col("lon") < 11.3)).alias("inside"), F.coalesce("category", F.lit("event")).alias("category"))


@query(WITH_TRIPS + "SELECT strftime(make_timestamp(start_ts * 1000000), '%Y-%m') AS month, count(*) AS n FROM trips GROUP BY 1")
def p10_trips_by_month(spark, sf):
    return trips(spark, sf).groupBy(clock.month(F.col("start_ts")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS uid, min(event_id) AS event_id, round(coalesce(CASE WHEN isinf(min_by(value, event_id)) OR isnan(min_by(value, event_id)) THEN 0 ELSE min_by(value, event_id) END, 0), 6) AS value FROM events GROUP BY user_id")
def p12_clean_and_first(spark, sf):
    e = table(spark, sf, "events")
    value = F.min_by("value", "event_id")
    finite = F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
    return e.groupBy(F.col("user_id").alias("uid")).agg(F.min("event_id").alias("event_id"), F.round(F.coalesce(finite, F.lit(0.0)), 6).alias("value"))


@query(WITH_TRIPS + "SELECT uid, tid, round(first_lon, 6) AS first_lon, round(first_lat, 6) AS first_lat, round(last_lon, 6) AS last_lon, round(last_lat, 6) AS last_lat, start_ts, end_ts FROM trips")
def p13_p14_trip_ends(spark, sf):
    return trips(spark, sf).select("uid", "tid", r("first_lon"), r("first_lat"), r("last_lon"), r("last_lat"), "start_ts", "end_ts")


@query(WITH_TRIPS + "SELECT uid, tid, n_points::INT AS n_points, round(first_lon, 6) AS lon, round(first_lat, 6) AS lat, start_ts AS ts FROM trips")
def p15_f22_geojson_round_trip(spark, sf):
    pts = points(spark, sf).groupBy("uid", "tid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat", F.col("t").alias("ts")))), lambda p: F.struct(p["lon"], p["lat"], p["ts"])).alias("pts")).where(F.size("pts") >= 2)
    back = pts.select("uid", "tid", files.points_of(files.geojson_of(F.col("pts"))).alias("pts"))
    text = back.select("uid", "tid", F.size("pts").alias("n_points"), files.point_of_text(F.to_json(F.array(F.col("pts")[0]["lat"], F.col("pts")[0]["lon"], F.col("pts")[0]["ts"].cast("double")))).alias("p"))
    return text.select("uid", "tid", "n_points", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"), F.col("p.ts").alias("ts"))


@query(WITH_TRIPS + "SELECT uid, tid, n_points, start_ts, end_ts, duration, round(length_km, 6) AS length_km FROM trips")
def t04_trips(spark, sf):
    return trips(spark, sf).select("uid", "tid", "n_points", "start_ts", "end_ts", "duration", r("length_km"))


FOLD_SQL = (
    WITH_HISTORY
    + """, pos AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY t, event_id) AS rn FROM history WHERE record_type = 'P'),
f(uid, rn, plon, plat, pt, alon, alat, a_t, tid, fresh, n, start_ts, length_km, used) AS (
  SELECT uid, rn, lon, lat, t, lon, lat, t, 0, true, 1, t, 0.0::DOUBLE, true FROM pos WHERE rn = 1
  UNION ALL
  SELECT f.uid, x.rn,
    CASE WHEN x.fast THEN plon ELSE lon END, CASE WHEN x.fast THEN plat ELSE lat END, CASE WHEN x.fast THEN pt ELSE t END,
    CASE WHEN x.fast THEN alon WHEN x.stop OR x.away > 0.05 THEN lon ELSE alon END, CASE WHEN x.fast THEN alat WHEN x.stop OR x.away > 0.05 THEN lat ELSE alat END, CASE WHEN x.fast THEN a_t WHEN x.stop OR x.away > 0.05 THEN t ELSE a_t END,
    CASE WHEN NOT x.fast AND x.stop THEN tid + 1 ELSE tid END, CASE WHEN x.fast THEN fresh ELSE x.stop END,
    CASE WHEN x.fast THEN n WHEN x.stop THEN 2 ELSE n + 1 END, CASE WHEN NOT x.fast AND x.stop THEN t ELSE start_ts END,
    CASE WHEN x.fast THEN length_km WHEN x.stop THEN 0.0 ELSE length_km + x.hop END, NOT x.fast
  FROM f JOIN LATERAL (
    SELECT p.rn, p.lon, p.lat, p.t, """
    + geo.sql_distance("f.alon", "f.alat", "p.lon", "p.lat", geo.KILOMETRES)
    + " AS away, "
    + geo.sql_distance("f.plon", "f.plat", "p.lon", "p.lat", geo.KILOMETRES)
    + """ AS hop, away > 0.07 * (p.t - f.a_t) AS fast, p.t - f.pt > 28800 OR (p.t - f.a_t > 28800 AND away < 0.05) AS stop
    FROM pos p WHERE p.uid = f.uid AND p.rn = f.rn + 1) x ON true)
SELECT uid, tid, max(n)::BIGINT AS n_points, any_value(start_ts) AS start_ts, max(pt) AS end_ts, round(max(length_km), 6) AS length_km
FROM f GROUP BY uid, tid HAVING max(n) > 1 AND NOT bool_and(fresh)
"""
)


@query(FOLD_SQL)
def t01_threshold_segmentation(spark, sf):
    found = segment.summarised(segment.by_thresholds(positions(spark, sf), 28800, 50, 0.07))
    return found.select("uid", "tid", "n_points", "start_ts", "end_ts", r("length_km"))


@query(WITH_HISTORY + ", p AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY t, event_id) - 1 AS rn, ceil(count(*) OVER (PARTITION BY uid) / 4) AS size FROM history WHERE record_type = 'P') SELECT uid, floor(rn / size)::INT AS tid, count(*) AS n, min(t) AS start_ts, max(t) AS end_ts FROM p GROUP BY 1, 2")
def t02_equal_chunks(spark, sf):
    return segment.in_chunks(positions(spark, sf), 4).groupBy("uid", "tid").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start_ts"), F.max("t").alias("end_ts"))


@query(None)
def t03_adaptive_segmentation(spark, sf):
    return segment.summarised(segment.by_adaptive_thresholds(positions(spark, sf))).select("uid", "tid", "n_points", "start_ts", "end_ts", r("length_km"))


@query(WITH_TRIPS + "SELECT * FROM (SELECT uid, tid, start_ts - lag(end_ts) OVER (PARTITION BY uid ORDER BY start_ts, tid) AS stop FROM trips) WHERE stop IS NOT NULL")
def w02_stop_times(spark, sf):
    return segment.stop_times(trips(spark, sf))


@query(WITH_TRIPS + ", x AS (SELECT uid, tid, avg(duration) OVER (PARTITION BY uid ORDER BY tid ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS smooth, row_number() OVER (PARTITION BY uid ORDER BY tid) AS rn, count(*) OVER (PARTITION BY uid) AS n FROM trips) SELECT uid, tid, round(smooth, 6) AS smooth FROM x WHERE rn <= n - 3")
def w03_moving_average(spark, sf):
    return segment.smoothed(trips(spark, sf), ["uid"], "tid", "duration").select("uid", "tid", r("smooth"))


@query(WITH_TRIPS + "SELECT uid, tid, seq, round(CASE WHEN seq = 0 OR t <= pt THEN 0 ELSE hop_km / ((t - pt) / 3600.0) END, 6) AS speed FROM points")
def w01_w04_point_speed(spark, sf):
    w = Window.partitionBy("uid", "tid").orderBy("seq")
    dt = F.col("t") - F.lag("t").over(w)
    return points(spark, sf).select("uid", "tid", "seq", F.round(F.when(dt > 0, F.col("hop_km") / (dt / 3600.0)).otherwise(0.0), 6).alias("speed"))


ASSIGN_SQL = (
    WITH_TRIPS
    + """, met AS (SELECT h.*, t.tid, row_number() OVER (PARTITION BY h.event_id ORDER BY t.tid) AS rn FROM history h JOIN trips t ON t.uid = h.uid AND h.t BETWEEN t.start_ts AND t.end_ts WHERE h.record_type {which}),
every AS (SELECT uid, event_id, tid, 1 AS status, t, record_type AS event_type FROM met WHERE rn = 1 {ends})
"""
)
ENDS_SQL = "UNION ALL SELECT uid, -1, tid, 0, start_ts, 'start' FROM trips UNION ALL SELECT uid, -1, tid, 2, end_ts, 'stop' FROM trips"
EVENTS_SQL = ASSIGN_SQL.replace("{which}", "NOT IN ('P', 'X')").replace("{ends}", ENDS_SQL)


def trip_events(spark, sf):
    t = trips(spark, sf)
    return assign.with_ends(assign.onto_trips(tables.routed(history(spark, sf))[2], t), t)


@query(EVENTS_SQL + "SELECT uid, event_id, tid, status, t, event_type, (row_number() OVER (PARTITION BY uid ORDER BY tid, status, t, event_id) - 1)::INT AS eid FROM every")
def j01_events_on_trips(spark, sf):
    return trip_events(spark, sf).select("uid", "event_id", "tid", "status", "t", "event_type", "eid")


@query(ASSIGN_SQL.replace("{which}", "= 'X'").replace("{ends}", "") + "SELECT uid, event_id, tid, (row_number() OVER (PARTITION BY uid ORDER BY tid, t, event_id) - 1)::INT AS cid FROM every")
def j02_crashes_on_trips(spark, sf):
    return assign.numbered_crashes(assign.onto_trips(tables.routed(history(spark, sf))[1], trips(spark, sf))).select("uid", "event_id", "tid", "cid")


@query(EVENTS_SQL + "SELECT uid, tid, count(*) AS n_events, count(*) FILTER (WHERE status = 1) AS n_real FROM every GROUP BY uid, tid")
def j11_events_per_trip(spark, sf):
    return trip_events(spark, sf).groupBy("uid", "tid").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("status") == 1).alias("n_real"))


@query(WITH_TRIPS + ", w AS (SELECT uid, tid, month(make_timestamp(start_ts * 1000000)) AS m FROM trips) SELECT label, count(*) AS n, count(DISTINCT uid) AS n_users FROM (SELECT uid, tid, lpad((m - 1)::VARCHAR, 2, '0') || '-' || lpad(m::VARCHAR, 2, '0') AS label FROM w WHERE m > 1 UNION ALL SELECT uid, tid, lpad(m::VARCHAR, 2, '0') || '-' || lpad((m + 1)::VARCHAR, 2, '0') FROM w WHERE m < 12) GROUP BY label")
def a35_two_month_windows(spark, sf):
    return trips(spark, sf).select("uid", F.explode(clock.two_month_windows(F.col("start_ts"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("n_users"))


def _parts(column: str) -> str:
    h = f"({column} % 86400) / 3600.0"
    return f"CASE WHEN {h} >= 6 AND {h} < 12 THEN 0 WHEN {h} >= 12 AND {h} < 18 THEN 1 WHEN {h} >= 18 AND {h} < 22 THEN 2 ELSE 3 END"


@query(WITH_TRIPS + f", x AS (SELECT *, {_parts('start_ts')} AS part, start_ts % 86400 AS s, (start_ts // 86400 + 3) % 7 >= 5 AS weekend FROM trips) SELECT part, weekend, CASE WHEN s > 21600 AND s <= 32400 THEN '06-09' WHEN s > 32400 AND s <= 64800 THEN '09-18' WHEN s > 64800 AND s <= 75600 THEN '18-21' ELSE '21-06' END AS slot, CASE WHEN s > 28800 AND s <= 68400 THEN 'day' ELSE 'night' END AS daynight, count(*) AS n FROM x GROUP BY 1, 2, 3, 4")
def f11_f12_f13_day_parts(spark, sf):
    t = F.col("start_ts")
    return trips(spark, sf).groupBy(clock.day_part(t).alias("part"), clock.weekend(t).alias("weekend"), clock.slot(t).alias("slot"), clock.day_night(t).alias("daynight")).agg(F.count(F.lit(1)).alias("n"))


@query(WITH_TRIPS + f"SELECT uid, tid, round({geo.sql_distance('first_lon', 'first_lat', 'last_lon', 'last_lat')}, 3) AS metres, round(2 * 6367 * asin(least(1.0, sqrt(pow(sin(radians(last_lat - first_lat) / 2), 2) + cos(radians(first_lat)) * cos(radians(last_lat)) * pow(sin(radians(last_lon - first_lon) / 2), 2)))), 6) AS haversine_km, round(sqrt(pow(first_lon - last_lon, 2) + pow(first_lat - last_lat, 2)), 9) AS degrees, round(degrees(length_km * 1000 / 6371000.0), 9) AS angle FROM trips")
def f01_f02_f03_f04_f16_distances(spark, sf):
    a = [F.col(c) for c in ("first_lon", "first_lat", "last_lon", "last_lat")]
    return trips(spark, sf).select("uid", "tid", F.round(geo.spherical_distance(*a), 3).alias("metres"), F.round(geo.haversine(*a), 6).alias("haversine_km"), F.round(geo.euclidean(*a), 9).alias("degrees"), F.round(geo.metres_to_degrees(F.col("length_km") * 1000), 9).alias("angle"))


@query(WITH_TRIPS + ", b AS (SELECT *, degrees(atan2(sin(radians(last_lon - first_lon)) * cos(radians(last_lat)), cos(radians(first_lat)) * sin(radians(last_lat)) - sin(radians(first_lat)) * cos(radians(last_lat)) * cos(radians(last_lon - first_lon)))) AS d FROM trips WHERE first_lon <> last_lon OR first_lat <> last_lat) SELECT uid, tid, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 6) AS bearing, round((greatest(first_lat, last_lat) - least(first_lat, last_lat)) * (greatest(first_lon, last_lon) - least(first_lon, last_lon)), 9) AS area FROM b")
def f20_f23_bearing_and_area(spark, sf):
    t = trips(spark, sf).where("first_lon <> last_lon OR first_lat <> last_lat")
    a = [F.col(c) for c in ("first_lon", "first_lat", "last_lon", "last_lat")]
    return t.select("uid", "tid", F.round(geo.bearing(*a), 6).alias("bearing"), F.round(geo.rectangle_area(F.least(a[1], a[3]), F.least(a[0], a[2]), F.greatest(a[1], a[3]), F.greatest(a[0], a[2])), 9).alias("area"))


@query(WITH_TRIPS + """, m AS (SELECT t.*, p.lon AS plon, p.lat AS plat, (p.lon - first_lon) * (last_lon - first_lon) + (p.lat - first_lat) * (last_lat - first_lat) AS dot, pow(last_lon - first_lon, 2) + pow(last_lat - first_lat, 2) AS sq FROM trips t JOIN points p ON p.uid = t.uid AND p.tid = t.tid AND p.seq = 1 WHERE t.n_points > 2 AND t.duration > 0),
u AS (SELECT *, CASE WHEN sq > 0 THEN greatest(0.0, least(1.0, dot / sq)) END AS u FROM m)
SELECT uid, tid, round(coalesce(first_lon + u * (last_lon - first_lon), plon), 6) AS x, round(coalesce(first_lat + u * (last_lat - first_lat), plat), 6) AS y,
 round(CASE WHEN 600 >= duration OR first_lon = last_lon THEN last_lon ELSE first_lon + 600.0 / duration * (last_lon - first_lon) END, 6) AS at_x,
 CASE WHEN 600 >= duration OR first_lon = last_lon THEN end_ts ELSE start_ts + 600 END AS at_t FROM u""")
def f07_f08_points_on_segments(spark, sf):
    second = points(spark, sf).where("seq = 1").select("uid", "tid", F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    t = trips(spark, sf).where("n_points > 2 AND duration > 0").join(second, ["uid", "tid"])
    c = F.col
    near = geo.closest_on_segment(c("first_lon"), c("first_lat"), c("last_lon"), c("last_lat"), c("plon"), c("plat"))
    at = geo.point_at(c("first_lon"), c("first_lat"), c("start_ts"), c("last_lon"), c("last_lat"), c("end_ts"), F.lit(600))
    return t.select("uid", "tid", near.alias("n"), at.alias("a")).select("uid", "tid", F.round("n.x", 6).alias("x"), F.round("n.y", 6).alias("y"), F.round("a.x", 6).alias("at_x"), F.col("a.t").cast("long").alias("at_t"))


@query(WITH_HISTORY + f"SELECT event_id, {quadtree.sql_path('lon', 'lat', 16)} AS path FROM history WHERE record_type = 'P'")
def f09_quadtree_paths(spark, sf):
    return positions(spark, sf).select("event_id", quadtree.path(F.col("lon"), F.col("lat"), 16).alias("path"))


@query(WITH_HISTORY + "SELECT uid, count(DISTINCT (floor((lon + 180) / (360.0 / 4096))::BIGINT, floor((lat + 90) / (180.0 / 8192))::BIGINT)) AS kmin, count(DISTINCT (floor((lon + 180) / (360.0 / 262144))::BIGINT, floor((lat + 90) / (180.0 / 131072))::BIGINT)) AS kmax FROM history WHERE record_type = 'P' GROUP BY uid")
def f10_cells_per_user(spark, sf):
    cell = lambda a, b: F.struct(F.floor((F.col("lon") + 180) / (360.0 / a)), F.floor((F.col("lat") + 90) / (180.0 / b)))
    return positions(spark, sf).groupBy("uid").agg(F.countDistinct(cell(4096, 8192)).alias("kmin"), F.countDistinct(cell(262144, 131072)).alias("kmax"))


@query("SELECT event_id, (event_id // 86400) || ' days, ' || lpad((event_id % 24)::VARCHAR, 2, '0') || ':30:05' AS text, (event_id // 86400) * 86400 + (event_id % 24) * 3600 + 1805 AS seconds, strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS later FROM events")
def f14_f15_durations(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.floor(F.col("event_id") / 86400).cast("string"), F.lit(" days, "), F.lpad((F.col("event_id") % 24).cast("string"), 2, "0"), F.lit(":30:05")).alias("text"), F.date_format(F.timestamp_add("SECOND", F.lit(90), F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("later"))
    return e.select("event_id", "text", clock.seconds_of(F.col("text")).alias("seconds"), "later")
