"""Readers and writers on literal files."""

import gzip
import json

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from roamer.operators import risk
from roamer.sources import files


def test_history_json(spark, tmp_path):
    docs = [
        {"VEHICLE_ID": 5, "RECORD_TYPE": "P", "TIMESTAMP": "2017-01-01T00:00:10Z", "location": {"lat": 43.5, "lon": 11.0}, "SPEED": 30},
        {"VEHICLE_ID": 5, "RECORD_TYPE": "X", "TIMESTAMP": "2017-01-01T00:00:20Z", "location": {"lat": 43.6, "lon": 11.1}, "HEADING": 90, "MAX_ACCELERATION": 7},
    ]
    (tmp_path / "h.json").write_text("\n".join(map(json.dumps, docs)))
    a, b = files.history_json(spark, str(tmp_path / "h.json")).orderBy("t").collect()
    assert (a.uid, a.t, a.record_type, a.lon, a.lat, a.speed, a.angle) == (5, 1483228810, "P", 11.0, 43.5, 30, None)
    assert (b.record_type, b.angle, b.max_acc, b.speed) == ("X", 90, 7, None)


def test_geolife(spark, tmp_path):
    d = tmp_path / "Data/007/Trajectory"
    d.mkdir(parents=True)
    (d / "x.plt").write_text("Geolife trajectory\nWGS 84\nAltitude is in Feet\nReserved 3\n0,2,255,My Track,0,0,2,8421376\n0\n39.9,116.3,0,492,39744.1,2008-10-23,02:53:04\nbad,116.3,0,492,39744.1,2008-10-23,02:53:04\n")
    (row,) = files.geolife(spark, str(tmp_path / "Data/*/Trajectory")).collect()
    assert (row.uid, row.t, row.lon, row.lat) == (7, 1224730384, 116.3, 39.9)


def test_ids_and_documents(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("30\n4\n\n100\n")
    assert [r.uid for r in files.user_ids(spark, str(tmp_path / "ids.csv")).collect()] == ["100", "30", "4"]
    out = str(tmp_path / "docs")
    files.write_documents(spark.createDataFrame([(1, 3, "{}")], "uid long, period long, document string"), out)
    files.write_documents(spark.createDataFrame([(1, 4, "x"), (2, 3, "y")], "uid long, period long, document string"), out)
    assert files.networks(spark, out).count() == 3
    assert [r.document for r in files.networks(spark, out, 1, 4).collect()] == ["x"]
    users = spark.createDataFrame([(1,), (5,)], "uid long")
    assert [r.uid for r in files.resumed(users, files.networks(spark, out)).collect()] == [5]


def test_charging_stations(spark, tmp_path):
    one = lambda i, p: {"ID": i, "AddressInfo": {"StateOrProvince": p, "Latitude": 43.0, "Longitude": 11.0}, "Connections": [{"LevelID": 2, "PowerKW": 22.0}]}
    (tmp_path / "s.json").write_text(json.dumps([one(1, "Toscana"), one(2, "Lazio"), one(3, None)], indent=1))
    (row,) = files.charging_stations(spark, str(tmp_path / "s.json"), ["TOSCANA"]).collect()
    assert row.id == 1 and row.connections[0].LevelID == 2


def test_road_map(spark, tmp_path):
    (tmp_path / "m.graphml").write_text(
        """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="y" attr.type="string"/><key id="d1" for="edge" attr.name="length" attr.type="string"/>
<graph edgedefault="directed"><node id="1"><data key="d0">43.5</data></node><node id="2"/>
<edge source="1" target="2"><data key="d1">12.5</data><data key="d9">z</data></edge></graph></graphml>"""
    )
    nodes, edges = files.road_map(spark, str(tmp_path / "m.graphml"))
    assert {r.id: r.data for r in nodes.collect()} == {"1": {"y": "43.5"}, "2": {}}
    assert [(r.u, r.v, r.data) for r in edges.collect()] == [("1", "2", {"length": "12.5", "d9": "z"})]


def test_periods_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "p")
    files.write_by_period(spark.createDataFrame([(1, 10), (2, 20)], "n int, period int"), path)
    files.write_by_period(spark.createDataFrame([(3, 20)], "n int, period int"), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("period", "n").collect())) == [(10, 1), (20, 3)]


def test_dataset_to_csv(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, rows in {"a_1": [{"uid": 1, "x": 0.5, "crash": True}], "b_2": [{"uid": 2, "x": 1.5, "crash": False}]}.items():
        with gzip.open(tmp_path / f"in/{n}.json.gz", "wt") as f:
            f.write("\n".join(map(json.dumps, rows)))
    files.dataset_to_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), "uid long, x double, crash string")
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).select("part", "uid", "x", "crash").orderBy("uid").collect()
    assert [tuple(r) for r in got] == [(1, "1", "0.5", "1"), (2, "2", "1.5", "0")]


def test_model_on_another_period(spark, tmp_path):
    rows = [(i, float(i % 20), float(i % 3), int(i % 20 > 16)) for i in range(120)]
    df = spark.createDataFrame(rows, "uid long, a double, b double, crash int")
    model = risk.train(df, ["a", "b"], kinds=("DT",), draws=2, folds=2)
    model.write().overwrite().save(str(tmp_path / "model"))
    later = df.withColumn("a", F.col("a") + 0.25)
    got = risk.score(PipelineModel.load(str(tmp_path / "model")), later)
    assert got.join(df, "uid").where(F.col("prediction") == F.col("crash")).count() > 110
    assert risk.importances(model, ["a", "b"])[0][0] == "a"
