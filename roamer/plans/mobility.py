"""Locations, movements, regularity and their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamer.functions import geo, stats
from roamer.operators import graph, locations, movements
from roamer.plans.basic import EVENTS_SQL, trip_events
from roamer.plans.registry import SQL, WITH_TRIPS, points, query, r, trips

LINK = 200.0

LOCATED_SQL = (
    """
, numbered AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY start_ts, tid) - 1 AS i FROM trips),
ends AS (SELECT uid, tid, 2 * i AS pid, 'f' AS kind, first_lon AS lon, first_lat AS lat, start_ts AS t FROM numbered UNION ALL SELECT uid, tid, 2 * i + 1, 't', last_lon, last_lat, end_ts FROM numbered),
near AS (SELECT a.uid, a.pid AS a, b.pid AS b FROM ends a JOIN ends b ON a.uid = b.uid WHERE """
    + geo.sql_distance("a.lon", "a.lat", "b.lon", "b.lat")
    + """ <= 200.0),
reach(uid, x, y) AS (SELECT uid, pid, pid FROM ends UNION SELECT reach.uid, x, b FROM reach JOIN near ON near.uid = reach.uid AND near.a = reach.y),
roots AS (SELECT uid, x AS pid, min(y) AS root FROM reach GROUP BY uid, x),
lids AS (SELECT uid, root, count(*) AS support, (row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, root) - 1)::INT AS lid FROM roots GROUP BY uid, root),
located AS (SELECT e.*, lid FROM ends e JOIN roots USING (uid, pid) JOIN lids USING (uid, root)),
ft AS (SELECT uid, tid, max(CASE WHEN kind = 'f' THEN lid END) AS loc_from, max(CASE WHEN kind = 't' THEN lid END) AS loc_to FROM located GROUP BY uid, tid),
ftt AS (SELECT * FROM ft JOIN trips USING (uid, tid))
"""
)
L = WITH_TRIPS + LOCATED_SQL


def located(spark, sf):
    return locations.by_linkage(locations.endpoints(trips(spark, sf)), LINK)


def from_to(spark, sf):
    return movements.trip_locations(located(spark, sf))


def both(spark, sf):
    return from_to(spark, sf), trips(spark, sf)


@query(L + "SELECT uid, tid, pid::INT AS pid, kind, lid FROM located")
def k11_k12_k13_a07_locations(spark, sf):
    return located(spark, sf).select("uid", "tid", "pid", "kind", "lid")


@query(None)
def k05_k06_k12_tosca_locations(spark, sf):
    return locations.tosca_locations(locations.endpoints(trips(spark, sf))).select("uid", "tid", "pid", "kind", "lid")


@query(L + ", c AS (SELECT uid, lid, avg(lon) AS c_lon, avg(lat) AS c_lat FROM located GROUP BY 1, 2), d AS (SELECT e.uid, e.pid, c.lid, " + geo.sql_distance("e.lon", "e.lat", "c.c_lon", "c.c_lat") + " AS d FROM ends e JOIN c USING (uid)) SELECT uid, pid::INT AS pid, arg_min(lid, d) AS lid, round(min(d), 3) AS metres FROM d GROUP BY 1, 2")
def j04_nearest_centre(spark, sf):
    e = located(spark, sf)
    centres = e.groupBy("uid", "lid").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return locations.nearest(e.drop("lid"), centres).select("uid", "pid", "lid", r("metres", 3))


@query(L + ", s AS (SELECT a.uid, a.lid, a.pid, round(sum(" + geo.sql_distance("a.lon", "a.lat", "b.lon", "b.lat") + "), 3) AS total FROM located a JOIN located b ON a.uid = b.uid AND a.lid = b.lid GROUP BY 1, 2, 3) SELECT uid, lid, arg_min(pid, (total, pid))::INT AS pid, min(total) AS total FROM s GROUP BY 1, 2")
def k10_medoids(spark, sf):
    return locations.medoids(located(spark, sf)).select("uid", "lid", "pid", "total")


@query(L + ", c AS (SELECT uid, lid, avg(lon) AS c_lon, avg(lat) AS c_lat FROM located GROUP BY 1, 2) SELECT uid, lid, round(avg(" + geo.sql_distance("lon", "lat", "c_lon", "c_lat") + "), 3) AS radius FROM located JOIN c USING (uid, lid) GROUP BY 1, 2")
def a01_a11_location_radius(spark, sf):
    return locations.radius(located(spark, sf), ["uid", "lid"]).select("uid", "lid", r("radius", 3))


@query(L + "SELECT uid, tid, loc_from, loc_to FROM ft")
def j03_trip_locations(spark, sf):
    return from_to(spark, sf)


@query(L + ", m AS (SELECT uid, loc_from, loc_to, string_agg(tid::VARCHAR, ',' ORDER BY tid) AS tids, count(*) AS support, min((start_ts, tid)) AS first FROM ftt GROUP BY 1, 2, 3) SELECT uid, (row_number() OVER (PARTITION BY uid ORDER BY first) - 1)::INT AS mid, loc_from, loc_to, tids, support FROM m")
def k14_a08_movements(spark, sf):
    return movements.movements(*both(spark, sf)).select("uid", "mid", "loc_from", "loc_to", F.array_join("tids", ",").alias("tids"), "support")


ENTROPY_SQL = "CASE WHEN count(*) = 1 THEN 0 ELSE (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) END"


@query(L + f", c AS (SELECT uid, loc_from AS lid, loc_to, count(*) AS n FROM ft GROUP BY 1, 2, 3) SELECT uid, lid, round({ENTROPY_SQL}, 6) AS entropy FROM c GROUP BY 1, 2")
def a02_a11_location_entropy(spark, sf):
    return movements.location_entropy(from_to(spark, sf)).select("uid", "lid", r("entropy"))


def _filtered(c: str) -> str:
    return f"q_{c} AS (SELECT uid, loc_from, loc_to, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM ftt GROUP BY 1, 2, 3), s_{c} AS (SELECT uid, loc_from, loc_to, median({c}) AS med_{c}, avg({c}) AS avg_{c}, stddev_pop({c}) AS std_{c} FROM ftt JOIN q_{c} USING (uid, loc_from, loc_to) WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1, 2, 3)"


@query(L + f", {_filtered('length_km')}, {_filtered('duration')}, n AS (SELECT uid, loc_from, loc_to, count(*) AS support FROM ftt GROUP BY 1, 2, 3) SELECT uid, loc_from, loc_to, support, round(med_length_km, 6) AS median_length_km, round(avg_length_km, 6) AS avg_length_km, round(std_length_km, 6) AS std_length_km, round(med_duration, 6) AS median_duration, round(avg_duration, 6) AS avg_duration, round(std_duration, 6) AS std_duration FROM n JOIN s_length_km USING (uid, loc_from, loc_to) JOIN s_duration USING (uid, loc_from, loc_to)")
def a04_a05_movement_features(spark, sf):
    m = movements.movement_features(*both(spark, sf))
    return m.select("uid", "loc_from", "loc_to", "support", *[r(f"{a}_{c}") for c in ("length_km", "duration") for a in ("median", "avg", "std")])


KNEE_SQL = """, sup AS (SELECT uid, lid, count(*) AS support FROM located GROUP BY 1, 2),
ranked AS (SELECT uid, lid, support, row_number() OVER (PARTITION BY uid ORDER BY support, lid) - 1 AS i, count(*) OVER (PARTITION BY uid) - 1 AS n, min(support) OVER (PARTITION BY uid) AS low, max(support) OVER (PARTITION BY uid) AS high FROM sup),
offs AS (SELECT *, CASE WHEN n > 0 OR high > low THEN round(abs((high - low) * i - n * (support - low)), 9) / sqrt(n * n + (high - low) * (high - low)) ELSE 0 END AS off FROM ranked),
knee AS (SELECT uid, arg_min(support, (-off, i)) AS min_support FROM offs GROUP BY uid),
reg AS (SELECT uid, lid FROM sup JOIN knee USING (uid) WHERE support >= min_support)
"""


@query(L + KNEE_SQL + "SELECT uid, min_support FROM knee")
def k15_minimum_support(spark, sf):
    return movements.minimum_support(movements.support(located(spark, sf)))


@query(L + KNEE_SQL + "SELECT uid, lid FROM reg")
def k16_regular_locations_light(spark, sf):
    e = located(spark, sf)
    return movements.regular(movements.support(e), movements.trip_locations(e), prune=False)


@query(
    L
    + KNEE_SQL
    + """, nx AS (SELECT r.uid, r.lid, coalesce(list(DISTINCT loc_to) FILTER (WHERE loc_to <> loc_from), []) AS nx FROM reg r LEFT JOIN ft ON ft.uid = r.uid AND ft.loc_from = r.lid GROUP BY 1, 2),
st(uid, cur) AS (
  SELECT uid, list({'lid': lid, 'nx': nx} ORDER BY lid) FROM nx GROUP BY uid
  UNION ALL
  SELECT uid, list_filter(cur, lambda x: x.lid <> gone)
  FROM (SELECT uid, cur, list_filter(cur, lambda x: NOT list_has_any(x.nx, list_transform(cur, lambda y: y.lid)))[1].lid AS gone FROM st WHERE len(cur) > 2)
  WHERE gone IS NOT NULL),
kept AS (SELECT uid, arg_min(cur, len(cur)) AS cur FROM st GROUP BY uid)
SELECT uid, lid FROM (SELECT uid, unnest(list_transform(cur, lambda x: x.lid)) AS lid FROM kept)"""
)
def k16_regular_locations_pruned(spark, sf):
    e = located(spark, sf)
    return movements.regular(movements.support(e), movements.trip_locations(e))


@query(L + KNEE_SQL + ", x AS (SELECT ftt.*, a.lid IS NOT NULL AND b.lid IS NOT NULL AS regular FROM ftt LEFT JOIN reg a ON a.uid = ftt.uid AND a.lid = loc_from LEFT JOIN reg b ON b.uid = ftt.uid AND b.lid = loc_to) SELECT uid, count(*) AS n, round(avg(length_km), 6) AS avg_km, round(stddev_pop(length_km), 6) AS std_km, round(avg(duration), 6) AS avg_s, count(*) FILTER (WHERE regular) AS n_regular, round(coalesce(avg(length_km) FILTER (WHERE regular), -1), 6) AS avg_km_regular, round(coalesce(avg(duration) FILTER (WHERE regular), avg(duration)), 6) AS avg_s_regular FROM x GROUP BY uid")
def a06_movement_statistics(spark, sf):
    e = located(spark, sf)
    ft = movements.trip_locations(e)
    reg = movements.regular(movements.support(e), ft, prune=False).withColumn("yes", F.lit(True))
    x = ft.join(trips(spark, sf), ["uid", "tid"]).join(reg.select("uid", F.col("lid").alias("loc_from"), F.col("yes").alias("a")), ["uid", "loc_from"], "left").join(reg.select("uid", F.col("lid").alias("loc_to"), F.col("yes").alias("b")), ["uid", "loc_to"], "left")
    both_ = F.coalesce(F.col("a") & F.col("b"), F.lit(False))
    some = lambda c: F.avg(F.when(both_, F.col(c)))
    return x.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("length_km"), 6).alias("avg_km"), F.round(F.stddev_pop("length_km"), 6).alias("std_km"), F.round(F.avg("duration"), 6).alias("avg_s"), F.count_if(both_).alias("n_regular"), F.round(F.coalesce(some("length_km"), F.lit(-1.0)), 6).alias("avg_km_regular"), F.round(F.coalesce(some("duration"), F.avg("duration")), 6).alias("avg_s_regular"))


@query(L + KNEE_SQL + ", p AS (SELECT l.* FROM located l JOIN reg USING (uid, lid)), c AS (SELECT uid, avg(lon) AS c_lon, avg(lat) AS c_lat FROM p GROUP BY 1), e AS (SELECT uid, count(*) AS n FROM p GROUP BY uid, lid), h AS (SELECT uid, " + ENTROPY_SQL + " AS h FROM e GROUP BY uid) SELECT uid, round(avg(" + geo.sql_distance("lon", "lat", "c_lon", "c_lat") + "), 3) AS radius, round(any_value(h), 6) AS entropy FROM p JOIN c USING (uid) JOIN h USING (uid) GROUP BY uid")
def a13_regular_radius_and_entropy(spark, sf):
    from roamer.functions import stats

    e = located(spark, sf)
    reg = movements.regular(movements.support(e), movements.trip_locations(e), prune=False)
    p = e.join(reg, ["uid", "lid"], "left_semi")
    h = stats.entropy(movements.support(p).withColumnRenamed("support", "n"), ["uid"])
    return locations.radius(p, ["uid"]).join(h, "uid").select("uid", r("radius", 3), r("entropy"))


MINUTES_SQL = """, s AS (SELECT uid, lid, kind, t, lead(t) OVER (PARTITION BY uid, lid ORDER BY t, pid) AS leave FROM located),
ab AS (SELECT uid, lid, (t % 86400) // 60 AS a, (leave % 86400) // 60 AS b FROM s WHERE kind = 't' AND leave IS NOT NULL),
mins AS (SELECT uid, lid, unnest(CASE WHEN a <= b THEN range(a, b + 1) ELSE list_concat(range(0, b + 1), range(a, 1440)) END) AS minute FROM ab),
counts AS (SELECT uid, lid, minute::INT AS minute, count(*) AS n FROM mins GROUP BY 1, 2, 3)
"""


@query(L + MINUTES_SQL + "SELECT uid, lid, minute, n, round(n / sum(n) OVER (PARTITION BY uid, minute), 6) AS share FROM counts")
def a09_a12_stay_minutes(spark, sf):
    return movements.stay_shares(movements.stay_minutes(located(spark, sf))).select("uid", "lid", "minute", "n", r("share"))


@query(L + ", ab AS (SELECT uid, loc_from, loc_to, (start_ts % 86400) // 60 AS a, (end_ts % 86400) // 60 AS b FROM ftt), m AS (SELECT uid, loc_from, loc_to, unnest(range(a, b + 1)) AS minute FROM ab WHERE a <= b) SELECT uid, loc_from, loc_to, minute::INT AS minute, count(*) AS n FROM m GROUP BY 1, 2, 3, 4")
def a10_travel_minutes(spark, sf):
    return movements.travel_minutes(*both(spark, sf))


STAYS_SQL = ", lagged2 AS (SELECT uid, loc_from AS lid, lag(loc_to) OVER w AS prev, lag(end_ts) OVER w AS arrive, start_ts AS leave FROM ftt WINDOW w AS (PARTITION BY uid ORDER BY start_ts, tid)), stays AS (SELECT uid, lid, arrive, leave FROM lagged2 WHERE prev = lid)"


@query(L + STAYS_SQL + "SELECT uid, lid, round(avg(leave - arrive), 6) AS avg_stay, round(stddev_pop(leave - arrive), 6) AS std_stay, count(*) AS n FROM stays GROUP BY 1, 2")
def a15_w05_stay_durations(spark, sf):
    return movements.stay_durations(movements.stays(*both(spark, sf))).select("uid", "lid", r("avg_stay"), r("std_stay"), "n")


@query(L + STAYS_SQL + ", x AS (SELECT uid, lid, unnest(list_distinct(list_append(range(arrive, leave + 1, 3600), leave))) AS t FROM stays), y AS (SELECT *, t % 86400 AS s FROM x) SELECT uid, lid, (t // 86400 + 3) % 7 >= 5 AS weekend, CASE WHEN s > 21600 AND s <= 32400 THEN '06-09' WHEN s > 32400 AND s <= 64800 THEN '09-18' WHEN s > 64800 AND s <= 75600 THEN '18-21' ELSE '21-06' END AS slot, count(DISTINCT t // 86400) AS days FROM y GROUP BY 1, 2, 3, 4")
def a16_slot_days(spark, sf):
    return movements.slot_days(movements.stays(*both(spark, sf)))


@query(L + STAYS_SQL + ", d AS (SELECT *, unnest(range(arrive // 86400, leave // 86400 + 1)) AS d FROM stays), o AS (SELECT uid, lid, (d + 3) % 7 >= 5 AS weekend, greatest(0, least(leave, d * 86400 + 86400) - greatest(arrive, d * 86400)) AS whole, greatest(0, least(leave, d * 86400 + 68400) - greatest(arrive, d * 86400 + 28800)) AS light FROM d) SELECT uid, lid, weekend, sum(light)::BIGINT AS day, sum(whole - light)::BIGINT AS night FROM o GROUP BY 1, 2, 3")
def a30_a31_day_night_stays(spark, sf):
    return movements.day_night_seconds(movements.stays(*both(spark, sf)))


@query(EVENTS_SQL.replace("SELECT uid, NULL", "SELECT uid, NULL") + LOCATED_SQL.replace("\n, numbered", ", numbered") + "SELECT uid, loc_from, loc_to, event_type, round(avg(speed), 6) AS avg_speed, round(stddev_pop(speed), 6) AS std_speed, round(avg(max_acc), 6) AS avg_max_acc, count(*) AS n FROM every JOIN ft USING (uid, tid) JOIN history USING (uid, event_id) WHERE status = 1 GROUP BY uid, loc_from, loc_to, every.event_type")
def a14_event_features(spark, sf):
    e = trip_events(spark, sf).where("status = 1")
    return movements.event_features(e, from_to(spark, sf)).select("uid", "loc_from", "loc_to", "event_type", r("avg_speed"), r("std_speed"), r("avg_max_acc"), "n")


@query(L + ", e AS (SELECT DISTINCT uid, loc_from AS a, loc_to AS b FROM ft), n AS (SELECT uid, count(*) AS nodes FROM (SELECT uid, a AS v FROM e UNION SELECT uid, b FROM e) GROUP BY 1), m AS (SELECT uid, count(*) AS edges FROM e GROUP BY 1) SELECT uid, nodes, edges, round(CASE WHEN nodes > 1 THEN edges / (nodes * (nodes - 1)) ELSE 0 END, 6) AS density, round(2.0 * edges / nodes, 6) AS degree FROM n JOIN m USING (uid)")
def k18_a34_graph_density(spark, sf):
    return movements.graph_summary(from_to(spark, sf)).select("uid", "nodes", "edges", r("density"), r("degree"))


@query(L + ", e AS (SELECT DISTINCT uid, least(loc_from, loc_to) AS a, greatest(loc_from, loc_to) AS b FROM ft WHERE loc_from <> loc_to) SELECT x.uid, count(*) AS triangles FROM e x JOIN e y ON x.uid = y.uid AND x.b = y.a JOIN e z ON z.uid = x.uid AND z.a = x.a AND z.b = y.b GROUP BY x.uid")
def k18_triangles(spark, sf):
    return graph.triangles(from_to(spark, sf))


@query(
    L
    + """, de AS (SELECT DISTINCT uid, loc_from AS a, loc_to AS b FROM ft),
v AS (SELECT uid, a AS v FROM de UNION SELECT uid, b FROM de), nn AS (SELECT uid, count(*) AS n FROM v GROUP BY uid),
dr AS (SELECT * FROM de WHERE a <> b), und AS (SELECT uid, a, b FROM dr UNION SELECT uid, b, a FROM dr),
deg AS (SELECT v.uid, v.v, count(und.b) AS k FROM v LEFT JOIN und ON und.uid = v.uid AND und.a = v.v GROUP BY 1, 2),
tri AS (SELECT x.uid, x.a AS v, count(*) AS n2 FROM und x JOIN und y ON y.uid = x.uid AND y.a = x.a JOIN und z ON z.uid = x.uid AND z.a = x.b AND z.b = y.b GROUP BY 1, 2),
lo AS (SELECT deg.uid, avg(CASE WHEN k > 1 THEN coalesce(n2, 0) / (k * (k - 1)) ELSE 0 END) AS avg_clustering, avg(CASE WHEN n > 1 THEN k / (n - 1) ELSE 0 END) AS avg_degree_centrality FROM deg JOIN nn USING (uid) LEFT JOIN tri USING (uid, v) GROUP BY 1),
uw(uid, s, v, d) AS (SELECT uid, v, v, 0 FROM v UNION SELECT uw.uid, s, b, d + 1 FROM uw JOIN und ON und.uid = uw.uid AND und.a = uw.v JOIN nn ON nn.uid = uw.uid WHERE d + 1 < n),
ud AS (SELECT uid, s, v, min(d) AS d FROM uw GROUP BY 1, 2, 3),
ec AS (SELECT uid, s, max(d) AS e, min(v) AS root, count(*) AS size FROM ud GROUP BY 1, 2),
big AS (SELECT uid, arg_min(root, (-size, root)) AS root FROM ec GROUP BY uid),
wh AS (SELECT uid, max(e)::INT AS diameter, avg(e) AS avg_eccentricity FROM ec JOIN big USING (uid, root) GROUP BY uid),
ak AS (SELECT und.uid, p.k AS x, q.k AS y FROM und JOIN deg p ON p.uid = und.uid AND p.v = und.a JOIN deg q ON q.uid = und.uid AND q.v = und.b),
aso AS (SELECT uid, CASE WHEN min(x) = max(x) THEN -1 ELSE corr(x, y) END AS assortativity FROM ak GROUP BY uid),
dw(uid, s, v, d) AS (SELECT uid, v, v, 0 FROM v UNION SELECT dw.uid, s, b, d + 1 FROM dw JOIN dr ON dr.uid = dw.uid AND dr.a = dw.v JOIN nn ON nn.uid = dw.uid WHERE d + 1 < n),
dd AS (SELECT uid, s, v, min(d) AS d FROM dw GROUP BY 1, 2, 3),
sp(uid, s, v, d) AS (SELECT uid, v, v, 0 FROM v UNION ALL SELECT sp.uid, sp.s, dr.b, sp.d + 1 FROM sp JOIN dr ON dr.uid = sp.uid AND dr.a = sp.v JOIN dd ON dd.uid = sp.uid AND dd.s = sp.s AND dd.v = dr.b AND dd.d = sp.d + 1),
sg AS (SELECT uid, s, v, any_value(d) AS d, count(*) AS n FROM sp GROUP BY 1, 2, 3),
nb AS (SELECT uid, v, sum(part) AS c FROM (SELECT p.uid, p.v, p.n * q.n / w.n AS part FROM sg p JOIN sg q ON q.uid = p.uid AND q.s = p.v JOIN sg w ON w.uid = p.uid AND w.s = p.s AND w.v = q.v WHERE p.d > 0 AND q.d > 0 AND w.d = p.d + q.d) GROUP BY 1, 2),
eb AS (SELECT uid, a, b, sum(part) AS c FROM (SELECT p.uid, dr.a, dr.b, p.n * q.n / w.n AS part FROM dr JOIN sg p ON p.uid = dr.uid AND p.v = dr.a JOIN sg q ON q.uid = dr.uid AND q.s = dr.b JOIN sg w ON w.uid = dr.uid AND w.s = p.s AND w.v = q.v WHERE w.d = p.d + 1 + q.d) GROUP BY 1, 2, 3),
mb AS (SELECT uid, max(c) AS c FROM nb GROUP BY uid), me AS (SELECT uid, max(c) AS c FROM eb GROUP BY uid)
SELECT uid, diameter, round(avg_clustering, 6) AS avg_clustering, round(avg_eccentricity, 6) AS avg_eccentricity, round(coalesce(assortativity, -1), 6)::DOUBLE AS assortativity, round(avg_degree_centrality, 6) AS avg_degree_centrality,
       round(coalesce(mb.c, 0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END, 6) AS max_betweenness, round(coalesce(me.c, 0) / CASE WHEN n > 1 THEN n * (n - 1) ELSE 1 END, 6) AS max_edge_betweenness
FROM nn JOIN lo USING (uid) JOIN wh USING (uid) LEFT JOIN aso USING (uid) LEFT JOIN mb USING (uid) LEFT JOIN me USING (uid)"""
)
def k18_graph_metrics(spark, sf):
    m = graph.metrics(from_to(spark, sf))
    return m.select("uid", "diameter", *[r(c) for c in m.columns if c not in ("uid", "diameter")])


@query(L + ", c AS (SELECT uid, loc_from % 3 AS c1, loc_to % 3 AS c2, count(*) AS weight FROM ft GROUP BY uid, loc_from, loc_to) SELECT uid, c1, c2, sum(weight)::BIGINT AS weight FROM c GROUP BY 1, 2, 3")
def a33_k19_collapsed_graph(spark, sf):
    ft = from_to(spark, sf)
    labels = ft.select("uid", F.explode(F.array("loc_from", "loc_to")).alias("lid")).distinct().withColumn("c", F.col("lid") % 3)
    return graph.collapsed(ft.groupBy("uid", "loc_from", "loc_to").agg(F.count(F.lit(1)).alias("weight")), labels)


@query(L + ", q AS (SELECT uid, lid % 6 AS c, count(*) AS n FROM located GROUP BY 1, 2) SELECT uid, round(max(n) / sum(n), 6) AS purity, round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(6), 6) AS entropy FROM q GROUP BY uid")
def a25_purity(spark, sf):
    return graph.purity(located(spark, sf).select("uid", (F.col("lid") % 6).alias("c")), 6).select("uid", r("purity"), r("entropy"))


@query(L + ", x AS (SELECT uid, lid, lid % 6 AS a, pid % 4 AS b FROM located), j AS (SELECT a, b, count(*) AS n FROM x GROUP BY 1, 2), ta AS (SELECT a, sum(n) AS n FROM j GROUP BY 1), tb AS (SELECT b, sum(n) AS n FROM j GROUP BY 1), t AS (SELECT sum(n) AS n FROM j), mi AS (SELECT sum(j.n / t.n * ln(j.n * t.n / (ta.n * tb.n))) AS v FROM j JOIN ta USING (a) JOIN tb USING (b), t), ha AS (SELECT -sum(ta.n / t.n * ln(ta.n / t.n)) AS v FROM ta, t), hb AS (SELECT -sum(tb.n / t.n * ln(tb.n / t.n)) AS v FROM tb, t) SELECT round(mi.v / ((ha.v + hb.v) / 2), 6) AS nmi FROM mi, ha, hb")
def k21_mutual_information(spark, sf):
    x = located(spark, sf).select((F.col("lid") % 6).alias("a"), (F.col("pid") % 4).alias("b"))
    return graph.mutual_information(x).select(r("nmi"))


@query(L + KNEE_SQL + ", o AS (SELECT uid, lid, row_number() OVER (PARTITION BY uid ORDER BY support DESC, lid) AS rn FROM sup JOIN knee USING (uid) WHERE support >= min_support) SELECT uid, max(CASE WHEN rn = 1 THEN lid END) AS home, coalesce(max(CASE WHEN rn = 2 THEN lid END), -1) AS work FROM o GROUP BY uid")
def e16_home_and_work(spark, sf):
    e = located(spark, sf)
    reg = movements.regular(movements.support(e), movements.trip_locations(e), prune=False)
    return graph.home_and_work(reg)


@query(None)
def k17_s15_imn_documents(spark, sf):
    from roamer.plans.imn import documents

    return documents(trips(spark, sf), located(spark, sf), trip_events(spark, sf))


@query(None)
def k14_prototypes(spark, sf):
    return movements.prototypes(from_to(spark, sf), points(spark, sf))


@query(
    L
    + """, x AS (SELECT e.*, duration, length_km, t % 86400 AS second FROM located e JOIN trips USING (uid, tid))
SELECT uid, lid, kind, (t // 86400 + 3) % 7 >= 5 AS weekend, CASE WHEN second > 28800 AND second <= 68400 THEN 'day' ELSE 'night' END AS part, count(*) AS n, """
    + ", ".join(f"round({f}({c}), 5) AS {n}_{c}" for c in ("second", "duration", "length_km") for n, f in (("avg", "avg"), ("std", "stddev_pop")))
    + " FROM x GROUP BY ALL"
)
def a32_leave_and_arrive(spark, sf):
    x = movements.leave_arrive(located(spark, sf), trips(spark, sf))
    return x.select("uid", "lid", "kind", "weekend", "part", "n", *[r(f"{a}_{c}", 5) for c in ("second", "duration", "length_km") for a in ("avg", "std")])


@query(L + ", c AS (SELECT uid, lid, avg(lon) AS lon, avg(lat) AS lat FROM located GROUP BY 1, 2) SELECT uid, a.lid, b.lid AS other, round(sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)), 9) AS degrees, round(" + geo.sql_distance("a.lon", "a.lat", "b.lon", "b.lat") + ", 3) AS metres FROM c a JOIN c b USING (uid)")
def f05_centre_distances(spark, sf):
    centres = located(spark, sf).groupBy("uid", "lid").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return movements.centre_distances(centres).select("uid", "lid", "other", r("degrees", 9), r("metres", 3))


@query(f"SELECT uid, lid, weekend, round((day + night) / 2.0, 6) AS seconds FROM ({SQL['a30_a31_day_night_stays']})")
def p16_averaged_stays(spark, sf):
    x = movements.day_night_seconds(movements.stays(*both(spark, sf)))
    return stats.averaged(x, {"seconds": ["day", "night"]}).withColumn("seconds", F.round("seconds", 6))


CHAINS = [{"purity": (0.2, 0.4), "entropy": (0.7, 1.1), "n_loc": (10, 80)}, {"purity": (0.3, 0.6), "entropy": (0.5, 0.9)}, {"purity": (0.9, 1.1), "n_loc": (1000, 2000)}]


@query(
    f"WITH p AS (SELECT * FROM ({SQL['a25_purity']}) JOIN (SELECT uid, count(*) AS n_loc FROM ({SQL['k11_k12_k13_a07_locations']}) GROUP BY uid) USING (uid)) "
    + " UNION ALL ".join(f"SELECT {i} AS chain, min(uid) AS uid FROM p WHERE " + " AND ".join(f"{x} > {a} AND {x} < {b}" for x, (a, b) in c.items()) + " HAVING count(*) > 0" for i, c in enumerate(CHAINS))
)
def p11_threshold_chains(spark, sf):
    e = located(spark, sf)
    p = a25_purity(spark, sf).join(e.groupBy("uid").agg(F.count(F.lit(1)).alias("n_loc")), "uid")
    return graph.chosen(p, CHAINS)


@query(
    L
    + """, x AS (SELECT lid % 6 AS a, pid % 4 AS b FROM located), j AS (SELECT a, b, count(*) AS n FROM x GROUP BY 1, 2), ta AS (SELECT a, sum(n)::BIGINT AS na FROM j GROUP BY 1), tb AS (SELECT b, sum(n)::BIGINT AS nb FROM j GROUP BY 1), tt AS (SELECT sum(n)::BIGINT AS t FROM j),
k AS (SELECT na, nb, t, unnest(range(greatest(1, na + nb - t), least(na, nb) + 1)) AS k FROM ta, tb, tt),
em AS (SELECT sum(k / t * ln(t::DOUBLE * k / (na::DOUBLE * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(t - na + 1) + lgamma(t - nb + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(t - na - nb + k + 1))) AS e FROM k),
mi AS (SELECT sum(n / t * ln(n::DOUBLE * t / (na::DOUBLE * nb))) AS mi FROM j JOIN ta USING (a) JOIN tb USING (b), tt),
ha AS (SELECT -sum(na / t * ln(na / t)) AS ha FROM ta, tt), hb AS (SELECT -sum(nb / t * ln(nb / t)) AS hb FROM tb, tt)
SELECT round((mi - e) / ((ha + hb) / 2 - e), 6) AS ami FROM mi, em, ha, hb"""
)
def k21_adjusted_mutual_information(spark, sf):
    x = located(spark, sf).select((F.col("lid") % 6).alias("a"), (F.col("pid") % 4).alias("b"))
    return graph.adjusted_mutual_information(x).select(r("ami"))


PERIOD = "((year(make_timestamp(start_ts * 1000000)) - 1970) * 12 + month(make_timestamp(start_ts * 1000000)) - 1) // 2"


@query(
    WITH_TRIPS
    + f", pt AS (SELECT * REPLACE (uid * 100000 + {PERIOD} AS uid) FROM trips)"
    + LOCATED_SQL.replace("FROM trips)", "FROM pt)").replace("JOIN trips USING", "JOIN pt USING")
    + ", e AS (SELECT DISTINCT uid, loc_from AS a, loc_to AS b FROM ft), n AS (SELECT uid, count(*) AS nodes FROM (SELECT uid, a AS v FROM e UNION SELECT uid, b FROM e) GROUP BY 1), m AS (SELECT uid, count(*) AS edges FROM e GROUP BY 1) SELECT uid // 100000 AS uid, uid % 100000 AS period, nodes, edges FROM n JOIN m USING (uid)"
)
def e21_two_month_networks(spark, sf):
    t = movements.in_periods(trips(spark, sf), 2)
    ft = movements.trip_locations(locations.by_linkage(locations.endpoints(t), LINK))
    return movements.user_and_period(movements.graph_summary(ft)).select("uid", "period", "nodes", "edges")
