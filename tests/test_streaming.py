from pyspark.sql import functions as F

from quern.streaming.groups import deliveries
from quern.streaming.reads import counts_per_window, tail, waiting


def test_tail_and_waiting(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, 0), ("s", 2, 0), ("t", 9, 0)], "key string, ms long, seq long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = []
    waiting(tail(stream, {"s": (1, 0)}), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r["key"], r["ms"]) for r in got] == [("s", 2)]


def test_group_deliveries(spark, tmp_path):
    rows = spark.createDataFrame([("s", "entry", i, 0) for i in range(4)] + [("t", "entry", 7, 0)], "key string, kind string, ms long, seq long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = deliveries(stream, ["a", "b"]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    assert {(r["key"], r["consumer"], r["ms"]) for r in spark.read.parquet(out).collect()} == {("s", "a", 0), ("s", "b", 1), ("s", "a", 2), ("s", "b", 3), ("t", "a", 7)}


def test_windows_match_batch(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = counts_per_window(events, "ts", ["event_type"], "1 day")
    assert windows.agg(F.sum("n")).first()[0] == events.count()
