"""File readers and writers for the formats the analyses exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY_JSON = "VEHICLE_ID long, RECORD_TYPE string, TIMESTAMP timestamp, location struct<lat: double, lon: double>, SPEED int, MAX_ACCELERATION int, AVG_ACCELERATION int, EVENT_ANGLE int, LOCATION_TYPE string, DURATION int, HEADING int"
GEOMETRY = "type string, coordinates array<array<double>>"


def history_json(spark: SparkSession, path: str) -> DataFrame:
    """Mobility history documents, one JSON object a line, as a canonical history."""
    j = spark.read.schema(HISTORY_JSON).json(path)
    return j.select(
        F.col("VEHICLE_ID").alias("uid"), F.unix_timestamp("TIMESTAMP").alias("t"), F.monotonically_increasing_id().alias("event_id"), F.col("RECORD_TYPE").alias("record_type"), "location.lon", "location.lat", F.col("SPEED").alias("speed"), F.col("MAX_ACCELERATION").alias("max_acc"),
        F.col("AVG_ACCELERATION").alias("avg_acc"), F.coalesce("EVENT_ANGLE", "HEADING").alias("angle"), F.col("DURATION").alias("duration"), F.col("LOCATION_TYPE").alias("location_type"),
    )


def geolife(spark: SparkSession, path: str, uid: Column | None = None) -> DataFrame:
    """Points of .plt files: lines of lat, lon, 0, altitude, day number, date, time; headers have other shapes."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    part = F.split("value", ",")
    rows = lines.where(F.size(part) == 7).select("file", part[0].try_cast("double").alias("lat"), part[1].try_cast("double").alias("lon"), F.try_to_timestamp(F.concat_ws(" ", part[5], part[6])).alias("ts"))
    user = F.regexp_extract("file", r"/(\d+)/Trajectory/", 1).try_cast("long") if uid is None else uid
    return rows.where("lat is not null and lon is not null and ts is not null").select(user.alias("uid"), F.unix_timestamp("ts").alias("t"), "lon", "lat")


def user_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one a line without a header, in order."""
    return spark.read.schema("uid string").csv(path).where("uid is not null").orderBy("uid")


def points_of(geojson: Column, time_scale: float = 1.0) -> Column:
    """array<struct(lon, lat, ts)> of a GeoJSON line string whose third coordinate is a time."""
    parsed = F.from_json(geojson, GEOMETRY)
    return F.transform(parsed["coordinates"], lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat"), (c[2] * time_scale).cast("long").alias("ts")))


def geojson_of(points: Column) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lon"], p["lat"], p["ts"].cast("double"))).alias("coordinates")))


def point_of_text(text: Column) -> Column:
    """struct(lat, lon, ts) of '[lat, lon, t]'."""
    a = F.from_json(text, T.ArrayType(T.DoubleType()))
    return F.struct(a[0].alias("lat"), a[1].alias("lon"), a[2].cast("long").alias("ts"))


def write_documents(df: DataFrame, path: str, mode: str = "append") -> None:
    """Gzip JSON lines."""
    df.write.mode(mode).option("compression", "gzip").json(path)


def resumed(users: DataFrame, done: DataFrame, key: str = "uid") -> DataFrame:
    """Users without output yet."""
    return users.join(done.select(key).distinct(), key, "left_anti")


def charging_stations(spark: SparkSession, path: str, provinces: list[str]) -> DataFrame:
    """id, lat, lon, connections of the stations in the given provinces, from a JSON export."""
    j = spark.read.option("multiLine", True).schema("ID long, AddressInfo struct<StateOrProvince: string, Latitude: double, Longitude: double>, Connections array<struct<LevelID: int, PowerKW: double>>").json(path)
    return j.where(F.lower("AddressInfo.StateOrProvince").isin([p.lower() for p in provinces])).select(F.col("ID").alias("id"), F.col("AddressInfo.Latitude").alias("lat"), F.col("AddressInfo.Longitude").alias("lon"), F.col("Connections").alias("connections"))


def road_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, data), edges (u, v, data)) of a GraphML file or folder; data maps attribute names to text."""
    data = "data array<struct<_key: string, _VALUE: string>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    keys = read("key", "_id string, `_attr.name` string, _VALUE string").select("_id", F.col("`_attr.name`").alias("name"))
    names = keys.agg(F.map_from_entries(F.collect_set(F.struct("_id", "name"))).alias("names"))  # a file has a few keys
    named = F.map_from_entries(F.transform(F.coalesce("data", F.array()), lambda d: F.struct(F.coalesce(F.col("names")[d["_key"]], d["_key"]), d["_VALUE"]))).alias("data")
    nodes = read("node", f"_id string, {data}").join(F.broadcast(names), F.lit(True))
    edges = read("edge", f"_source string, _target string, {data}").join(F.broadcast(names), F.lit(True))
    return nodes.select(F.col("_id").alias("id"), named), edges.select(F.col("_source").alias("u"), F.col("_target").alias("v"), named)


def networks(spark: SparkSession, path: str, uid: int | None = None, period: int | None = None) -> DataFrame:
    """Network documents (uid, period, document) from gzip JSON lines, of one user or period if given."""
    j = spark.read.schema("uid long, period long, document string").json(path)
    for name, value in (("uid", uid), ("period", period)):
        if value is not None:
            j = j.where(F.col(name) == value)
    return j


def write_by_period(df: DataFrame, path: str) -> None:
    """Parquet in a folder a period; periods of ``df`` are replaced, the others stay, so that an interrupted run goes on with what is missing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def dataset_to_csv(spark: SparkSession, source: str, target: str, schema: str) -> None:
    """Gzip CSV with a header, a folder a file number, of feature rows in JSON lines: files ``*_<number>.json[.gz]`` of a folder; ``crash`` as 0 or 1."""
    j = spark.read.schema(schema).json(source).withColumn("part", F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.json", 1))
    flag = F.when(F.lower(F.col("crash").cast("string")).isin("true", "1", "1.0"), 1).otherwise(0)
    j.withColumn("crash", flag).write.mode("overwrite").partitionBy("part").option("header", True).option("compression", "gzip").csv(target)
