"""Cells, feature vectors, spatial joins, areas and annotation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roamer.functions import geo, quadtree, stats
from roamer.operators import annotate, cells, features, locations, movements, spatial, tripdist
from roamer.plans.basic import EVENTS_SQL, trip_events
from roamer.plans.mobility import LINK, LOCATED_SQL, L, located
from roamer.plans.registry import WITH_HISTORY, WITH_TRIPS, history, points, query, r, table, trips
from roamer.sources import tables

MONTHS = ("2023-11-01", "2024-12-01")


def cell_counters(spark, sf):
    _, x, e = tables.routed(history(spark, sf))
    return cells.counters(points(spark, sf), e, x)


PATH = quadtree.sql_path("lon", "lat", 16)
MONTH = "strftime(make_timestamp(t * 1000000), '%Y-%m')"
CELLS_SQL = (
    WITH_TRIPS
    + f""", pl AS (SELECT *, lead(t) OVER (PARTITION BY uid, tid ORDER BY seq) IS NULL AS is_last FROM points),
c_p AS (SELECT {MONTH} AS period, {PATH} AS path, sum((seq = 0)::INT)::BIGINT AS n_start, sum(is_last::INT)::BIGINT AS n_stop, sum((seq > 0 AND NOT is_last)::INT)::BIGINT AS n_move, sum(CASE WHEN seq > 0 AND t > pt THEN hop_km / ((t - pt) / 3600.0) ELSE 0 END) AS speed_sum, count(*) AS speed_n FROM pl GROUP BY 1, 2),
c_e AS (SELECT {MONTH} AS period, {PATH} AS path, """
    + ", ".join(f"count(*) FILTER (WHERE record_type = '{k}') AS n_{k}, coalesce(sum(speed) FILTER (WHERE record_type = '{k}'), 0)::BIGINT AS speed_{k}" for k in "QBAC")
    + f""" FROM history WHERE record_type NOT IN ('P', 'X') GROUP BY 1, 2),
c_x AS (SELECT period, path, count(*) AS n_crash FROM (SELECT DISTINCT uid, {MONTH} AS period, {PATH} AS path FROM history WHERE record_type = 'X') GROUP BY 1, 2),
cells AS (SELECT period, path, coalesce(n_start, 0) AS n_start, coalesce(n_stop, 0) AS n_stop, coalesce(n_move, 0) AS n_move, coalesce(speed_sum, 0) AS speed_sum, coalesce(speed_n, 0) AS speed_n, """
    + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}, coalesce(speed_{k}, 0) AS speed_{k}" for k in "QBAC")
    + ", coalesce(n_crash, 0) AS n_crash FROM c_p FULL JOIN c_e USING (period, path) FULL JOIN c_x USING (period, path)) "
)
CELL_COLUMNS = ["n_start", "n_stop", "n_move", "speed_n", *[f"{a}_{k}" for k in "QBAC" for a in ("n", "speed")], "n_crash"]


@query(CELLS_SQL + f"SELECT period, path, round(speed_sum, 6) AS speed_sum, {', '.join(CELL_COLUMNS)} FROM cells")
def a19_m07_cell_counters(spark, sf):
    return cell_counters(spark, sf).select("period", "path", r("speed_sum"), *CELL_COLUMNS)


WINDOWS_SQL = ", months AS (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2024-12-01', INTERVAL 1 MONTH)) AS m), per AS (SELECT strftime(m, '%Y-%m') AS period, epoch(m)::BIGINT AS lo, epoch(m + INTERVAL 1 MONTH)::BIGINT AS hi, row_number() OVER (ORDER BY m) - 1 AS i FROM months), win AS (SELECT a.i AS index, a.lo AS train_lo, b.hi AS train_hi, c.lo AS test_lo, d.hi AS test_hi FROM per a JOIN per b ON b.i = a.i + 3 JOIN per c ON c.i = a.i + 1 JOIN per d ON d.i = a.i + 4) "


@query("WITH one AS (SELECT 1)" + WINDOWS_SQL + "SELECT index, train_lo, train_hi, test_lo, test_hi FROM win")
def m01_w10_sliding_windows(spark, sf):
    return cells.sliding(cells.months(spark, *MONTHS), 4)


@query(CELLS_SQL + WINDOWS_SQL + "SELECT index, path, sum(n_start)::BIGINT AS n_start, sum(n_Q)::BIGINT AS n_Q, sum(n_crash)::BIGINT AS n_crash FROM cells JOIN per USING (period) JOIN win ON per.lo >= train_lo AND per.lo < train_hi GROUP BY 1, 2")
def a20_m02_window_sums(spark, sf):
    p = cells.months(spark, *MONTHS)
    return cells.window_sum(cell_counters(spark, sf), p, cells.sliding(p, 4)).select("index", "path", "n_start", "n_Q", "n_crash")


@query(WITH_TRIPS + WINDOWS_SQL + "SELECT uid, tid, period FROM trips JOIN per ON start_ts >= lo AND start_ts < hi")
def p09_m02_trips_in_periods(spark, sf):
    return cells.in_periods(trips(spark, sf), cells.months(spark, *MONTHS), "start_ts").select("uid", "tid", "period")


PARTS_SQL = ", parts AS (SELECT index, 'train' AS part, train_lo AS lo, train_hi AS hi FROM win UNION ALL SELECT index, 'test', test_lo, test_hi FROM win) "


@query(WITH_HISTORY + WINDOWS_SQL + PARTS_SQL + "SELECT uid, event_id, record_type AS event_type, index, part FROM history JOIN parts ON t >= lo AND t < hi WHERE record_type NOT IN ('P', 'X')")
def m02_events_in_windows(spark, sf):
    events = tables.routed(history(spark, sf))[2]
    return cells.in_windows(events, cells.sliding(cells.months(spark, *MONTHS), 4)).select("uid", "event_id", "event_type", "index", "part")


@query(
    WITH_TRIPS
    + WINDOWS_SQL
    + PARTS_SQL
    + ", pt AS (SELECT trips.* REPLACE (uid * 100000 + index * 2 + (part = 'test')::INT AS uid) FROM trips JOIN parts ON start_ts >= lo AND start_ts < hi)"
    + LOCATED_SQL.replace("FROM trips)", "FROM pt)").replace("JOIN trips USING", "JOIN pt USING")
    + """, e AS (SELECT DISTINCT uid, loc_from AS a, loc_to AS b FROM ft), n AS (SELECT uid, count(*) AS nodes FROM (SELECT uid, a AS v FROM e UNION SELECT uid, b FROM e) GROUP BY 1),
m AS (SELECT uid, count(*) AS edges FROM e GROUP BY 1), tt AS (SELECT uid, count(*) AS n_trips, round(sum(length_km), 6) AS km FROM pt GROUP BY 1)
SELECT uid // 100000 AS uid, uid % 100000 // 2 AS index, CASE uid % 2 WHEN 1 THEN 'test' ELSE 'train' END AS part, n_trips, km, nodes, edges FROM n JOIN m USING (uid) JOIN tt USING (uid)"""
)
def m02_networks_in_windows(spark, sf):
    t = movements.in_windows(trips(spark, sf), cells.sliding(cells.months(spark, *MONTHS), 4))
    ft = movements.trip_locations(locations.by_linkage(locations.endpoints(t), LINK))
    own = t.groupBy("uid").agg(F.count(F.lit(1)).alias("n_trips"), F.round(F.sum("length_km"), 6).alias("km"))
    return movements.user_and_window(movements.graph_summary(ft).join(own, "uid")).select("uid", "index", "part", "n_trips", "km", "nodes", "edges")


@query(WITH_HISTORY + f", k AS (SELECT DISTINCT substr({PATH}, 1, 7 + (uid % 3)::INT * 3) AS path FROM history WHERE record_type = 'X'), p AS (SELECT DISTINCT {PATH} AS path FROM history WHERE record_type = 'P'), m AS (SELECT p.path, arg_max(k.path, length(k.path)) AS prefix FROM p JOIN k ON starts_with(p.path, k.path) GROUP BY 1) SELECT path, coalesce(prefix, '') AS prefix FROM p LEFT JOIN m USING (path)")
def j13_longest_prefix(spark, sf):
    p, x, _ = tables.routed(history(spark, sf))
    path = quadtree.path(F.col("lon"), F.col("lat"), 16)
    known = x.select(F.substring(path, F.lit(1), (7 + F.col("uid") % 3 * 3).cast("int")).alias("path"))
    return cells.longest_known_prefix(p.select(path.alias("path")).distinct(), known).select("path", F.coalesce("prefix", F.lit("")).alias("prefix"))


@query(
    CELLS_SQL
    + f""", own AS (SELECT DISTINCT uid, tid, {PATH} AS path FROM points), pt AS (SELECT uid, avg(n) AS cells_per_trip FROM (SELECT uid, tid, count(*) AS n FROM own GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT uid, path, count(*) AS visits FROM own GROUP BY 1, 2), tot AS (SELECT path, sum(n_start + n_stop + n_move) AS moved, sum(n_stop) AS n_stop, sum(speed_sum) AS ss, sum(speed_n) AS sn, sum(n_crash) AS n_crash, sum(n_Q + n_B + n_A + n_C) AS n_event FROM cells GROUP BY 1),
c AS (SELECT uid, sum(visits)::BIGINT AS visits, count(*) AS n_cells, sum(visits * (ss / sn)) / sum(visits) AS a, sum(visits * (n_event / moved)) / sum(visits) AS b, sum(visits * (n_crash / moved)) / sum(visits) AS d FROM v JOIN tot USING (path) GROUP BY uid)
SELECT uid, visits, n_cells, round(a, 6) AS avg_speed, round(b, 6) AS events_per_point, round(d, 6) AS crashes_per_point, round(cells_per_trip, 6) AS cells_per_trip FROM c JOIN pt USING (uid)"""
)
def a21_j12_u04_collective_features(spark, sf):
    return cells.collective(points(spark, sf), cell_counters(spark, sf)).select("uid", "visits", "n_cells", r("avg_speed"), r("events_per_point"), r("crashes_per_point"), r("cells_per_trip"))


def _part(i: int, p: str) -> str:
    f = f"FILTER (WHERE part = {i})"
    return f"count(*) {f} AS {p}_traj, round(count(*) {f} / count(*), 6) AS {p}_ntraj, round(coalesce(sum(km) {f}, 0), 6) AS {p}_km, round(coalesce(sum(km) {f}, 0) / sum(km), 6) AS {p}_nkm, round(coalesce(sum(tt) {f}, 0), 6)::DOUBLE AS {p}_ttime, round(coalesce(sum(tt) {f}, 0) / sum(tt), 6) AS {p}_nttime, round(coalesce(avg(speed) {f}, -1), 6) AS {p}_avg_speed, round(coalesce(stddev_pop(speed) {f}, -1), 6) AS {p}_std_speed"


_DAYS = [f"round({f}({c}), 6) AS {a}_{n}_per_day" for c, n in (("traj", "traj"), ("km", "km"), ("tt", "traveltime"), ("hi", "max_speed"), ("lo", "min_speed")) for a, f in (("avg", "avg"), ("std", "stddev_pop"))]


@query(
    WITH_TRIPS
    + ", x AS (SELECT uid, length_km AS km, duration AS tt, length_km / (duration / 3600.0) AS speed, start_ts // 86400 AS day, CASE WHEN start_ts % 86400 >= 21600 AND start_ts % 86400 < 43200 THEN 0 WHEN start_ts % 86400 >= 43200 AND start_ts % 86400 < 64800 THEN 1 WHEN start_ts % 86400 >= 64800 AND start_ts % 86400 < 79200 THEN 2 ELSE 3 END AS part FROM trips WHERE duration > 0), u AS (SELECT uid, count(*) AS tot_traj, round(sum(km), 6) AS tot_km, sum(tt)::DOUBLE AS tot_traveltime, round(avg(km), 6) AS avg_km, round(stddev_pop(km), 6) AS std_km, round(avg(tt), 6) AS avg_traveltime, round(stddev_pop(tt), 6) AS std_traveltime, round(avg(speed), 6) AS avg_speed, round(stddev_pop(speed), 6) AS std_speed, "
    + ", ".join(_part(i, p) for i, p in enumerate(features.PARTS))
    + " FROM x GROUP BY uid), d AS (SELECT uid, day, count(*) AS traj, sum(km) AS km, sum(tt) AS tt, max(speed) AS hi, min(speed) AS lo FROM x GROUP BY 1, 2), e AS (SELECT uid, "
    + ", ".join(_DAYS)
    + " FROM d GROUP BY uid) SELECT * FROM u JOIN e USING (uid)"
)
def a17_trip_features(spark, sf):
    f = features.trip_features(trips(spark, sf))
    return f.select(*[r(c) if t == "double" else c for c, t in f.dtypes])


@query(EVENTS_SQL.replace("'start' FROM", "'start' FROM") + "SELECT uid, count(*) AS n_events, count(DISTINCT tid) AS n_trips, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}, round(count(*) FILTER (WHERE event_type = '{k}') / count(*), 6) AS share_{k}" for k in features.TYPES) + " FROM every GROUP BY uid")
def a18_event_features(spark, sf):
    f = features.event_features(trip_events(spark, sf))
    return f.select("uid", "n_events", "n_trips", *[x for k in features.TYPES for x in (f"n_{k}", r(f"share_{k}"))])


@query(WITH_HISTORY + "SELECT uid, max(CASE WHEN record_type = 'X' AND t >= 1704067200 AND t < 1705276800 THEN 1 ELSE 0 END) AS crash FROM history GROUP BY uid")
def a24_crash_labels(spark, sf):
    h = history(spark, sf)
    return features.labels(tables.users(h), tables.routed(h)[1], 1704067200, 1705276800)


def _halves(spark, sf):
    e = located(spark, sf)
    place = lambda odd: e.where(F.col("tid") % 2 == odd).groupBy("uid", "lid").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count(F.lit(1)).alias("support"))
    return place(0), place(1)


HALVES_SQL = (
    L
    + ", p0 AS (SELECT uid, lid, avg(lon) AS lon, avg(lat) AS lat, count(*) AS support FROM located WHERE tid % 2 = 0 GROUP BY 1, 2), p1 AS (SELECT uid, lid, avg(lon) AS lon, avg(lat) AS lat, count(*) AS support FROM located WHERE tid % 2 = 1 GROUP BY 1, 2), nn AS (SELECT a.uid, a.lid, b.lid AS lid2, round("
    + geo.sql_distance("a.lon", "a.lat", "b.lon", "b.lat")
    + ", 3) AS d FROM p0 a JOIN p1 b USING (uid)), one AS (SELECT uid, lid2, arg_min(lid, (d, lid)) AS lid, min(d) AS d FROM nn WHERE d < 100 GROUP BY 1, 2), m AS (SELECT uid, lid, arg_min(lid2, (d, lid2)) AS lid2, min(d) AS d FROM one GROUP BY 1, 2)"
)


@query(HALVES_SQL + "SELECT uid, lid, lid2, d FROM m")
def j05_location_matching(spark, sf):
    return features.matched(*_halves(spark, sf))


@query(HALVES_SQL + ", s0 AS (SELECT uid, count(*) AS n, sum(support * support) AS s FROM p0 GROUP BY 1), s1 AS (SELECT uid, count(*) AS n, sum(support * support) AS s FROM p1 GROUP BY 1), c AS (SELECT m.uid, count(*) AS n, sum(a.support * b.support) AS dot FROM m JOIN p0 a ON a.uid = m.uid AND a.lid = m.lid JOIN p1 b ON b.uid = m.uid AND b.lid = m.lid2 GROUP BY 1) SELECT s0.uid, s1.n - s0.n AS delta_locs, round(1 - coalesce(c.n, 0) / (s0.n + s1.n - coalesce(c.n, 0)), 6) AS jaccard, round(1 - coalesce(dot, 0) / sqrt(s0.s * s1.s), 6) AS cosine FROM s0 JOIN s1 USING (uid) LEFT JOIN c ON c.uid = s0.uid")
def a23_u02_drift(spark, sf):
    a, b = _halves(spark, sf)
    return features.drift(a, b, features.matched(a, b)).select("uid", "delta_locs", r("jaccard"), r("cosine"))


def feature_table(spark, sf):
    """One row per user: families t, e, i and c."""
    from roamer.operators import graph

    t = trips(spark, sf)
    e = located(spark, sf)
    ft = movements.trip_locations(e)
    named = lambda df, p: df.select("uid", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "uid"])
    imn = movements.graph_summary(ft).join(graph.metrics(ft), "uid")
    coll = cells.collective(points(spark, sf), cell_counters(spark, sf))
    h = history(spark, sf)
    y = features.labels(tables.users(h), tables.routed(h)[1], 1704067200, 1706745600)
    return features.assembled(named(features.trip_features(t), "t"), named(features.event_features(trip_events(spark, sf)), "e"), named(imn, "i"), named(coll, "c"), y)


@query(None)
def m03_m04_a22_feature_table(spark, sf):
    f = feature_table(spark, sf)
    return f.select("uid", "crash", *features.families(f.columns, "tic"))


# places: customers and suppliers at coordinates derived from their keys
def _places(spark, sf, name, key):
    k = F.col(key)
    return table(spark, sf, name).select(k.alias("id"), (F.lit(11.0) + F.pmod(k * 37, F.lit(997)) / 20000.0).alias("lon"), (F.lit(43.5) + F.pmod(k * 53, F.lit(991)) / 20000.0).alias("lat"), (k % 5).alias("category"), (k % 7 + 1).alias("support"))


def _places_sql(name: str, key: str) -> str:
    return f"SELECT {key} AS id, 11.0::DOUBLE + (({key} * 37) % 997) / 20000.0::DOUBLE AS lon, 43.5::DOUBLE + (({key} * 53) % 991) / 20000.0::DOUBLE AS lat, {key} % 5 AS category, {key} % 7 + 1 AS support FROM {name}"


NEAR_SQL = f"WITH a AS ({_places_sql('supplier', 's_suppkey')}), b AS ({_places_sql('customer', 'c_custkey')}), ab AS (SELECT a.id, b.id AS id2, b.category, a.support, b.support AS s2, " + geo.sql_distance("a.lon", "a.lat", "b.lon", "b.lat") + " AS d FROM a, b) "


def _near(spark, sf):
    a = _places(spark, sf, "supplier", "s_suppkey").drop("category")
    return a, _places(spark, sf, "customer", "c_custkey").select(F.col("id").alias("id2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), "category", F.col("support").alias("s2"))


@query(NEAR_SQL + "SELECT id, category, count(*) AS n, round(min(d), 3) AS least FROM ab WHERE d <= 500 GROUP BY 1, 2")
def j06_radius_join(spark, sf):
    a, b = _near(spark, sf)
    return spatial.tallied(a, b, [500]).select("id", "category", F.col("n0").alias("n"), r("least", 3))


@query(NEAR_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 3), id2) AS rn FROM ab) SELECT id, category, count(*) AS n, round(min(d), 3) AS least FROM k WHERE rn <= 30 GROUP BY 1, 2")
def j07_j14_j15_nearest_join(spark, sf):
    a, b = _near(spark, sf)
    return spatial.category_counts(spatial.nearest(a, b, 30)).select("id", "category", "n", r("least", 3))


SELF_SQL = f"WITH a AS ({_places_sql('supplier', 's_suppkey')}), ab AS (SELECT a.id, b.id AS id2, a.support, b.support AS s2, " + geo.sql_distance("a.lon", "a.lat", "b.lon", "b.lat") + " AS d FROM a, a b) "


def _self(spark, sf):
    a = _places(spark, sf, "supplier", "s_suppkey").drop("category")
    return a, a.select(F.col("id").alias("id2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("support").alias("s2"))


@query(SELF_SQL + "SELECT id, count(*) FILTER (WHERE d <= 1000) AS n1, count(*) FILTER (WHERE d <= 3000) AS n3 FROM ab WHERE d <= 3000 GROUP BY 1")
def j08_centrality(spark, sf):
    a, b = _self(spark, sf)
    return spatial.tallied(a, b.withColumn("category", F.lit(0)), [1000, 3000]).select("id", F.col("n0").alias("n1"), F.col("n1").alias("n3"))


@query(SELF_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 3), id2) - 1 AS rank FROM ab) SELECT id, rank, round(d, 3) AS d FROM k WHERE rank IN (1, 3, 5, 8)")
def j09_neighbour_distances(spark, sf):
    return spatial.nearest(*_self(spark, sf), 9).where(F.col("rank").isin(1, 3, 5, 8)).select("id", "rank", r("d", 3))


@query(SELF_SQL + "SELECT id, round(any_value(support) / sum(s2), 6) AS exclusivity FROM ab WHERE d <= 200 GROUP BY id")
def j10_exclusivity(spark, sf):
    return spatial.exclusivity(_self(spark, sf)[0]).select("id", r("exclusivity"))


@query(NEAR_SQL + ", x AS (SELECT id, count(*) AS near FROM ab WHERE d <= 500 GROUP BY 1), y AS (SELECT a.id, round(a.support / 7.0, 6) AS share FROM a) SELECT id, coalesce(near, 0) AS near, share FROM y LEFT JOIN x USING (id)")
def j16_aligned_features(spark, sf):
    a, b = _near(spark, sf)
    near = spatial.tallied(a, b.withColumn("category", F.lit(0)), [500]).select("id", F.col("n0").alias("near"))
    return a.select("id", F.round(F.col("support") / 7.0, 6).alias("share")).join(near, "id", "left").select("id", F.coalesce("near", F.lit(0)).alias("near"), "share")


RECT_SQL = WITH_TRIPS + ", rect AS (SELECT uid, least(min(first_lat), min(last_lat)) AS bottom, least(min(first_lon), min(last_lon)) AS lft, greatest(max(first_lat), max(last_lat)) AS top, greatest(max(first_lon), max(last_lon)) AS rgt FROM trips GROUP BY uid) "


@query(RECT_SQL + "SELECT uid, round(bottom, 6) AS bottom, round(lft, 6) AS lft, round(top, 6) AS top, round(rgt, 6) AS rgt FROM rect")
def a29_rectangles(spark, sf):
    return annotate.rectangles(trips(spark, sf)).select("uid", *[r(c) for c in ("bottom", "lft", "top", "rgt")])


@query(
    RECT_SQL
    + "SELECT a.uid, b.uid AS other, "
    + "abs((a.top - a.bottom) * (a.rgt - a.lft) - (b.top - b.bottom) * (b.rgt - b.lft)) < 3 * least((a.top - a.bottom) * (a.rgt - a.lft), (b.top - b.bottom) * (b.rgt - b.lft)) AS alike "
    + "FROM rect a JOIN rect b ON a.uid < b.uid AND NOT (a.rgt < b.lft OR b.rgt < a.lft OR a.top < b.bottom OR b.top < a.bottom)"
)
def p07_p08_overlap_and_likeness(spark, sf):
    return annotate.overlapping(annotate.rectangles(trips(spark, sf))).select("uid", "other", annotate.alike().alias("alike"))


@query(None)
def k22_areas(spark, sf):
    return annotate.areas(annotate.rectangles(trips(spark, sf)))


@query(WITH_TRIPS + "SELECT round(corr(length_km, duration), 2) AS km_s, round(corr(length_km, n_points), 2) AS km_n, round(corr(duration, n_points), 2) AS s_n, round(avg(length_km), 6) AS avg_km, round(stddev_samp(length_km), 6) AS std_km FROM trips")
def a26_a27_correlation(spark, sf):
    c = lambda a, b: F.round(F.corr(a, b), 2)
    return trips(spark, sf).agg(c("length_km", "duration").alias("km_s"), c("length_km", "n_points").alias("km_n"), c("duration", "n_points").alias("s_n"), F.round(F.avg("length_km"), 6).alias("avg_km"), F.round(F.stddev_samp("length_km"), 6).alias("std_km"))


@query(WITH_TRIPS + ", w AS (SELECT *, min(length_km) OVER () AS lo, max(length_km) OVER () AS hi FROM trips) SELECT uid, tid, round((length_km - lo) / (hi - lo), 6) AS scaled, round(0.3 + (length_km - lo) * (10 - 0.3) / (hi - lo), 6) AS weight, round(ln(1 + length_km), 6) AS logged FROM w")
def f18_f19_a03_scaling(spark, sf):
    t = trips(spark, sf)
    w = t.join(F.broadcast(t.agg(F.min("length_km").alias("lo"), F.max("length_km").alias("hi"))), F.lit(True))
    c = F.col("length_km"), F.col("lo"), F.col("hi")
    return w.select("uid", "tid", F.round(stats.rescaled(*c, 0.0, 1.0), 6).alias("scaled"), F.round(stats.rescaled(*c, 0.3, 10.0), 6).alias("weight"), F.round(F.log1p("length_km"), 6).alias("logged"))


@query("SELECT event_id, lower(event_type) IN ('click', 'view') AS flag, event_type || ';' || user_id AS joined, '#' || lpad(to_hex((user_id % 256)::INT), 2, '0') || '00ff' AS colour, ntile(4) OVER (ORDER BY value, event_id) AS quarter FROM events")
def f17_f21_text_and_quartiles(spark, sf):
    e = table(spark, sf, "events")
    colour = F.concat(F.lit("#"), F.lpad(F.hex((F.col("user_id") % 256).cast("int")), 2, "0"), F.lit("00ff"))
    e = stats.ranked(e.select("event_id", "event_type", "user_id", "value"), "value", "event_id")
    quarter = stats.tile(F.col("rank"), table(spark, sf, "events").count(), 4)
    return e.select("event_id", F.lower("event_type").isin("click", "view").alias("flag"), F.concat_ws(";", "event_type", "user_id").alias("joined"), colour.alias("colour"), quarter.alias("quarter"))


@query(WITH_HISTORY + "SELECT uid, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, (min(k) || '')::VARCHAR AS k FROM history GROUP BY uid")
def f24_f25_centres_and_json(spark, sf):
    k = table(spark, sf, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    return history(spark, sf).join(k, "event_id").groupBy("uid").agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"), F.min("k").cast("string").alias("k"))


@query(WITH_TRIPS + ", n AS (SELECT uid, tid, end_ts, lead(start_ts) OVER (PARTITION BY uid ORDER BY start_ts, tid) AS next_start, abs(length_km - lag(length_km) OVER (PARTITION BY uid ORDER BY length_km, tid)) AS diff FROM trips) SELECT uid, tid, next_start - end_ts AS pause, round(coalesce(diff, 0), 6) AS diff FROM n WHERE next_start IS NOT NULL")
def w06_w08_w09_neighbouring_rows(spark, sf):
    a = Window.partitionBy("uid").orderBy("start_ts", "tid")
    b = Window.partitionBy("uid").orderBy("length_km", "tid")
    t = trips(spark, sf).select("uid", "tid", (F.lead("start_ts").over(a) - F.col("end_ts")).alias("pause"), F.round(F.coalesce(F.abs(F.col("length_km") - F.lag("length_km").over(b)), F.lit(0.0)), 6).alias("diff"))
    return t.where("pause is not null")


@query(WITH_TRIPS + "SELECT uid, tid FROM trips WHERE length_km > 10 UNION ALL SELECT uid, tid FROM trips WHERE duration > 30000 ORDER BY uid, tid")
def u01_o02_o06_union_and_order(spark, sf):
    t = trips(spark, sf)
    return t.where("length_km > 10").select("uid", "tid").unionByName(t.where("duration > 30000").select("uid", "tid")).orderBy("uid", "tid")


def _pairs(spark, sf):
    pts = points(spark, sf).groupBy("uid", "tid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat", F.col("t").alias("ts")))), lambda p: F.struct(p["lon"], p["lat"], p["ts"])).alias("a")).where(F.size("a") >= 2)
    w = Window.partitionBy("uid").orderBy("tid")
    return pts.withColumn("b", F.lead("a").over(w)).withColumn("other", F.lead("tid").over(w)).where("b is not null")


PAIR_SQL = WITH_TRIPS + ", pr AS (SELECT uid, tid, lead(tid) OVER w AS other, first_lon AS ax, first_lat AS ay, last_lon AS bx, last_lat AS by_, start_ts AS s, end_ts AS e, lead(first_lon) OVER w AS cx, lead(first_lat) OVER w AS cy, lead(last_lon) OVER w AS dx, lead(last_lat) OVER w AS dy, lead(start_ts) OVER w AS s2, lead(end_ts) OVER w AS e2 FROM trips WINDOW w AS (PARTITION BY uid ORDER BY tid)) "


@query(PAIR_SQL + f"SELECT uid, tid, other, round({geo.sql_distance('ax', 'ay', 'cx', 'cy')} + {geo.sql_distance('bx', 'by_', 'dx', 'dy')}, 3) AS ends, round({geo.sql_distance('ax', 'ay', 'cx', 'cy')}, 3) AS starts, abs(s % 86400 - s2 % 86400) >= 7200 OR abs(e % 86400 - e2 % 86400) >= 7200 AS apart FROM pr WHERE other IS NOT NULL")
def t08_t09_end_distances(spark, sf):
    p = _pairs(spark, sf)
    a, b = F.col("a"), F.col("b")
    d = tripdist.ends_distance(a, b)
    return p.select("uid", "tid", "other", F.round(d, 3).alias("ends"), F.round(tripdist.ends_distance(a, b, end=False), 3).alias("starts"), (tripdist.unless_apart(d, a, b, 7200) == float("inf")).alias("apart"))


@query(WITH_TRIPS + ", n AS (SELECT uid, tid FROM (SELECT uid, tid, lead(tid) OVER (PARTITION BY uid ORDER BY tid) AS other FROM trips) WHERE other IS NOT NULL) SELECT n.uid, n.tid, count(*) FILTER (WHERE t % 86400 BETWEEN 28800 AND 64800) AS n_day FROM n JOIN points p ON p.uid = n.uid AND p.tid = n.tid GROUP BY 1, 2")
def t05_sub_trips(spark, sf):
    return _pairs(spark, sf).select("uid", "tid", F.size(tripdist.between_times(F.col("a"), 28800, 64800)).cast("long").alias("n_day"))


def _closest(a: str, b: str, z: str) -> str:
    """The closest place to z on a-b in SQL, as a struct of lon and lat."""
    d = f"(pow({b}.lon - {a}.lon, 2) + pow({b}.lat - {a}.lat, 2))"
    u = f"((({z}.lon - {a}.lon) * ({b}.lon - {a}.lon) + ({z}.lat - {a}.lat) * ({b}.lat - {a}.lat)) / {d})"
    return f"CASE WHEN {d} = 0 THEN {{'lon': {z}.lon, 'lat': {z}.lat}} WHEN {u} < 0 THEN {{'lon': {a}.lon, 'lat': {a}.lat}} WHEN {u} > 1 THEN {{'lon': {b}.lon, 'lat': {b}.lat}} ELSE {{'lon': {a}.lon + {u} * ({b}.lon - {a}.lon), 'lat': {a}.lat + {u} * ({b}.lat - {a}.lat)}} END"


def _apart(a: str, b: str) -> str:
    return geo.sql_distance(f"{a}.lon", f"{a}.lat", f"{b}.lon", f"{b}.lat")


#: Consecutive trips p and q of a user as lists of places, and the sections of p.
WAYS_SQL = (
    WITH_TRIPS
    + """, ways AS (SELECT uid, tid, list({'lon': lon, 'lat': lat, 'ts': t} ORDER BY seq) AS p FROM points GROUP BY 1, 2 HAVING count(*) >= 2),
pq AS (SELECT * FROM (SELECT uid, tid, p, lead(tid) OVER w AS other, lead(p) OVER w AS q FROM ways WINDOW w AS (PARTITION BY uid ORDER BY tid)) WHERE other IS NOT NULL),
sections AS (SELECT uid, tid, k, p[k] AS a, p[k + 1] AS b FROM (SELECT *, unnest(range(1, len(p))) AS k FROM pq)) """
)


@query(
    WAYS_SQL
    + f""", walk(uid, tid, i, j, x, y, total, n) AS (
  SELECT uid, tid, 1::BIGINT, 1::BIGINT, {{'lon': p[1].lon, 'lat': p[1].lat}}, {{'lon': q[1].lon, 'lat': q[1].lat}}, {_apart('p[1]', 'q[1]')}, 1 FROM pq
  UNION ALL
  SELECT uid, tid, i, j, x, y, total + {_apart('x', 'y')}, n + 1 FROM (
    SELECT uid, tid, i + (da <= db)::INT AS i, j + (da >= db)::INT AS j, CASE WHEN da <= db THEN to_ ELSE {_closest('x', 'to_', 'next_')} END AS x, CASE WHEN da >= db THEN next_ ELSE {_closest('y', 'next_', 'to_')} END AS y, total, n
    FROM (SELECT *, {_apart('x', 'to_')} AS da, {_apart('y', 'next_')} AS db
          FROM (SELECT walk.*, {{'lon': p[i + 1].lon, 'lat': p[i + 1].lat}} AS to_, {{'lon': q[j + 1].lon, 'lat': q[j + 1].lat}} AS next_ FROM walk JOIN pq USING (uid, tid) WHERE i < len(p) AND j < len(q))))),
ends_ AS (SELECT uid, tid, max((n, i, j, total)) AS e FROM walk GROUP BY 1, 2),
rest AS (SELECT uid, tid, sum(d) AS d, count(*) AS n FROM (
  SELECT uid, tid, {_apart('l', 'z')} AS d FROM (SELECT uid, tid, q[len(q)] AS l, unnest(p[e[2]:]) AS z FROM ends_ JOIN pq USING (uid, tid))
  UNION ALL SELECT uid, tid, {_apart('l', 'z')} FROM (SELECT uid, tid, p[len(p)] AS l, unnest(q[e[3]:]) AS z FROM ends_ JOIN pq USING (uid, tid))) GROUP BY 1, 2)
SELECT uid, tid, other, round((e[4] + d) / (e[1] + n), 2) AS distance FROM ends_ JOIN rest USING (uid, tid) JOIN pq USING (uid, tid)"""
)
def t07_synchronised_distances(spark, sf):
    return _pairs(spark, sf).select("uid", "tid", "other", F.round(tripdist.trip_distance("a", "b"), 2).alias("distance"))


@query(
    WAYS_SQL
    + f""", found(uid, tid, j, k, total) AS (
  SELECT uid, tid, 0::BIGINT, 1::BIGINT, 0::DOUBLE FROM pq
  UNION ALL
  SELECT uid, tid, j + 1, best[2], CASE WHEN best[1] > 50000 THEN 'inf'::DOUBLE ELSE total + best[1] END FROM (
    SELECT uid, tid, j, total, min((d, k)) AS best FROM (
      SELECT uid, tid, j, total, k, {_apart('c', 'z')} AS d FROM (
        SELECT uid, tid, j, total, k, z, {_closest('a', 'b', 'z')} AS c FROM (
          SELECT f.uid, f.tid, f.j, f.total, s.k, s.a, s.b, q[f.j + 1] AS z FROM found f JOIN pq ON pq.uid = f.uid AND pq.tid = f.tid JOIN sections s ON s.uid = f.uid AND s.tid = f.tid AND s.k >= f.k WHERE f.j < len(q) AND f.total < 'inf'::DOUBLE))) GROUP BY 1, 2, 3, 4))
SELECT uid, tid, other, round(max(total), 2) AS inclusion FROM found JOIN pq USING (uid, tid) GROUP BY 1, 2, 3"""
)
def t10_inclusion(spark, sf):
    return _pairs(spark, sf).select("uid", "tid", "other", F.round(tripdist.trip_inclusion("a", "b", 50000.0), 2).alias("inclusion"))


def _nearest_section(place: str, after: str) -> str:
    """(metres, section, time) of the closest place of p to a place of q, not before a section."""
    way = f"CASE WHEN {_apart('c', 'a')} = 0 THEN a.ts ELSE a.ts + (b.ts - a.ts) * {_apart('a', 'c')} / {_apart('a', 'b')} END"
    at = f"CASE WHEN a.lon = b.lon AND a.lat = b.lat THEN z.ts WHEN c.lon = b.lon AND c.lat = b.lat THEN b.ts ELSE {way} END"
    return f"SELECT uid, tid, min((d, k, tz)) AS m FROM (SELECT uid, tid, k, {_apart('c', 'z')} AS d, ({at})::DOUBLE AS tz FROM (SELECT uid, tid, k, a, b, z, {_closest('a', 'b', 'z')} AS c FROM (SELECT s.*, {place} AS z FROM sections s JOIN pq USING (uid, tid) {after}))) GROUP BY 1, 2"


@query(
    WAYS_SQL
    + f""", up AS ({_nearest_section('q[1]', '')}),
down AS ({_nearest_section('q[len(q)]', 'JOIN up USING (uid, tid) WHERE k >= up.m[2]')}),
late AS (SELECT uid, tid, other, up.m AS u, down.m AS d, (up.m[3] - q[1].ts) % 86400 AS l1, (down.m[3] - q[len(q)].ts) % 86400 AS l2 FROM pq JOIN up USING (uid, tid) JOIN down USING (uid, tid)),
hours AS (SELECT *, least((l1 + 86400) % 86400, (86400 - l1) % 86400) AS t1, least((l2 + 86400) % 86400, (86400 - l2) % 86400) AS t2 FROM late)
SELECT uid, tid, other, round(u[1] + d[1], 2) AS total, (u[2] - 1)::INT AS up_segment, (d[2] - 1)::INT AS down_segment, round(t1, 2) AS up_late, round(t2, 2) AS down_late
FROM hours WHERE u[1] <= 50000 AND d[1] <= 50000 AND t1 <= 14400 AND t2 <= 14400"""
)
def t11_shared_ways(spark, sf):
    p = _pairs(spark, sf).select("uid", "tid", "other", tripdist.trip_inclusion_in_time("a", "b", 50000.0, 14400.0).alias("s")).where("s.total is not null")
    return p.select("uid", "tid", "other", F.round("s.total", 2).alias("total"), "s.up_segment", "s.down_segment", F.round("s.up_late", 2).alias("up_late"), F.round("s.down_late", 2).alias("down_late"))


@query(None)
def t06_t07_t10_t11_trip_distances(spark, sf):
    p = _pairs(spark, sf)
    return p.select("uid", "tid", "other", F.round(tripdist.trip_distance("a", "b"), 3).alias("distance"), F.round(tripdist.trip_inclusion("a", "b", 50000.0), 3).alias("inclusion"), tripdist.trip_inclusion_in_time("a", "b", 20000.0, 7200.0).alias("shared"), F.round(tripdist.trip_approximation("a", "b", 50000.0)["compared"], 3).alias("approximation"), F.size(tripdist.tail_of(F.col("a"), 5000.0)).alias("n_tail"))


def _visited(spark, sf):
    e = located(spark, sf)
    return e.groupBy("uid", "lid").agg(F.count(F.lit(1)).alias("support"), F.avg("t").alias("t")).select("uid", "lid", F.col("support").cast("double").alias("support"), (F.pmod("t", F.lit(86400)) / 3600).alias("hour"))


@query(None)
def k20_semantic_clusters(spark, sf):
    return annotate.semantic(_visited(spark, sf), ["support", "hour"], [4, 8, 12])


@query(None)
def k20_cluster_sweep(spark, sf):
    return annotate.sweep(_visited(spark, sf), ["support", "hour"], [2, 4, 8, 12])


@query(None)
def m05_m06_f19_risk_model(spark, sf):
    from roamer.operators import risk

    f = feature_table(spark, sf).cache()  # fitting and scoring read it several times
    cols = features.families(f.columns, "tic")
    model = risk.train(f, cols, kinds=("DT", "RF"), draws=2, folds=2)  # a short search; the operator's own is 100 draws, 5 folds, all kinds
    return risk.score(model, f)
