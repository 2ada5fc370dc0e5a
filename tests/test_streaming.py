"""Windows and first events on a stream and on a table."""

import datetime

from pyspark.sql import functions as F

from kilngraph import streaming


def test_windows_of_a_stream_and_of_a_table(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, "a", at(1)), (2, "a", at(3)), (3, "b", at(4)), (4, "a", at(12)), (5, "a", at(59))]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    table = streaming.windowed_counts(df, "t", ["k"], "10 minutes", "5 minutes")
    wanted = {(at(0), "a", 2), (at(0), "b", 1), (at(10), "a", 1), (at(50), "a", 1)}
    assert {(r["start"], r["k"], r["n"]) for r in table.collect()} == wanted
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    query = streaming.windowed_counts(stream, "t", ["k"], "10 minutes", "5 minutes").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["start"], r["k"], r["n"]) for r in spark.table("windows").collect()} == {w for w in wanted if w[0] < at(50)}  # the last window is still open


def test_first_seen_and_decay(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, t int")
    assert {tuple(r) for r in streaming.first_seen(df, "t", ["k"], "1 minute").collect()} == {("a", 1), ("b", 2)}
    assert df.select(streaming.decayed(F.lit(8.0), F.lit(20), 10.0)).first()[0] == 2
