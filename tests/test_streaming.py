"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from roamer.operators import segment
from roamer.plans.registry import history, positions
from roamer.streaming import mobility


def test_stream_equals_batch(spark, sf, tmp_path):
    h = history(spark, sf).where("record_type = 'P'").select("uid", "t", "event_id", "record_type", "lon", "lat")
    end = h.agg(F.max("t")).first()[0]
    cut = h.select(F.percentile("t", 0.5)).first()[0]
    h.where(F.col("t") < cut).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    h.where(F.col("t") >= cut).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    # A row far ahead moves the watermark past all that is open.
    ahead = [(-1, end + 50_000_000, 1, "P", 0.0, 0.0)]
    spark.createDataFrame(ahead, mobility.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/c"))
    src = str(tmp_path / "in/*")
    mobility.drained(mobility.sessions(mobility.position_stream(spark, src), "8 hours", "400 days"), str(tmp_path / "s"), str(tmp_path / "sc"))
    batch = segment.by_gap(positions(spark, sf), 28800).groupBy("uid", "tid").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "s")).where("uid >= 0").select("uid", "n_points", "start_ts").collect())
    assert got and got == sorted(tuple(r) for r in batch.select("uid", "n", "a").collect())
    whole = sorted(tuple(r) for r in segment.summarised(segment.by_thresholds(positions(spark, sf), 28800, 50, 0.07)).select("uid", "tid", "n_points", "start_ts", "end_ts").collect())
    for files in (10, 1):  # all files at once, and one at a time: users are silent between them and go on
        mobility.drained(mobility.online_trips(mobility.position_stream(spark, src, files)), str(tmp_path / f"t{files}"), str(tmp_path / f"tc{files}"))
        online = spark.read.parquet(str(tmp_path / f"t{files}")).where("uid >= 0").select("uid", "tid", "n_points", "start_ts", "end_ts")
        assert whole and sorted(tuple(r) for r in online.collect()) == whole
