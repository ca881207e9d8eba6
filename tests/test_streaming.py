import os
from pathlib import Path

from pyspark.sql import functions as F

from lamina.operators import monitoring
from lamina.streaming import limits


def drained(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stream_limits_as_the_batch_does(spark, tmp_path):
    rows = spark.range(60).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("client"), (F.col("id") * 7 % 180).cast("double").alias("at"), "id")
    for part in range(3):  # three files in time order: state carries over micro-batches
        rows.filter((F.col("at") >= part * 60) & (F.col("at") < part * 60 + 60)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(limits.rate_limited(stream, "client", "at", "id", 60.0, 4), "limited").collect()
    expected = monitoring.rate_limited(rows, "client", "at", 60.0, 4, "id").collect()
    assert {(r["event"], r["allowed"], r["retry_after"]) for r in got} == {(r["id"], r["allowed"], r["retry_after"]) for r in expected}


def test_stream_alert_states_as_the_batch_does(spark, tmp_path):
    rows = spark.range(40).select(F.lit("a").alias("alertname"), (F.col("id") * 10).alias("at"), (F.col("id") % 9 > 2).alias("active"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = drained(limits.alert_states(stream, 30), "states").collect()
    expected = monitoring.alert_states(rows, 30, "alertname").collect()
    assert {(r["at"], r["state"]) for r in got} == {(r["at"], r["state"]) for r in expected}


def in_batches(spark, folder, parts, schema):
    """A stream that takes one of ``parts`` in each micro-batch."""
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    files = sorted(str(p) for p in Path(folder).glob("*/*.parquet"))
    for n, file in enumerate(files):
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(file, f"{folder}/in/{n}.parquet")
        os.utime(f"{folder}/in/{n}.parquet", (1_000 + n, 1_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_clients_are_forgotten_by_event_time_only(spark, tmp_path):
    schema = "client string, at double, id long"
    stream = in_batches(spark, tmp_path, [[("a", 0.0, 1), ("a", 1.0, 2)], [("b", 30.0, 3)], [("a", 50.0, 4)], [("b", 5000.0, 5)], [("c", 5001.0, 6)], [("a", 5002.0, 7), ("a", 2.0, 8)]], schema)
    got = {r["event"]: r["allowed"] for r in drained(limits.rate_limited(stream, "client", "at", "id", 60.0, 2), "forgotten").collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True, 6: True, 7: True}  # 8 is behind the watermark


def test_late_evaluations_are_left_out(spark, tmp_path):
    stream = in_batches(spark, tmp_path, [[("x", 0, True), ("x", 20, True)], [("x", 10, False), ("x", 40, True)]], "alertname string, at long, active boolean")
    got = {(r["at"], r["state"]) for r in drained(limits.alert_states(stream, 30), "late").collect()}
    assert got == {(0, "pending"), (20, "pending"), (40, "firing")}


def test_windowed_counts_and_alert_log(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"), (F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    table = drained(limits.windowed_counts(stream, "ts", "1 minute", "10 minutes", "k"), "windows")
    assert table.agg(F.sum("n")).first()[0] >= 80  # windows behind the watermark
    limits.log_alerts(stream, str(tmp_path / "log"), str(tmp_path / "cp")).start().awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == 100
