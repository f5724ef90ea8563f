"""Stream results against the batch results of the same operators."""

import pytest
from pyspark.sql import functions as F

from calgraph.streaming import live

ROWS = [(s, f"2024-01-01 00:{m:02d}:{x:02d}", "n" if x % 2 else "m", float(x + s)) for s in range(2) for m in (0, 1, 7) for x in range(0, 60, 7)]


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("samples"))
    df = spark.createDataFrame(ROWS, "session long, t string, signal string, value double").select("session", F.to_timestamp("t").alias("ts"), "signal", "value")
    end = spark.createDataFrame([(9, "2024-01-01 05:00:00", "n", 0.0)], "session long, t string, signal string, value double").select("session", F.to_timestamp("t").alias("ts"), "signal", "value")
    df.coalesce(1).write.mode("append").parquet(path)
    end.coalesce(1).write.mode("append").parquet(path)  # moves the watermark past all else
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        return sorted(map(repr, (tuple(r) for r in spark.table(name).collect())))
    finally:
        q.stop()


@pytest.mark.parametrize("name, run", [("means", live.windowed_means), ("share", lambda d: live.saturation(d, F.col("value") > 20)), ("gaps", lambda d: live.log_runs(d, "30 seconds")), ("once", live.without_repeats)])
def test_stream_equals_batch(spark, samples, tmp_path, name, run):
    batch, stream = samples
    want = sorted(map(repr, (tuple(r) for r in run(batch).collect())))
    got = [r for r in drained(spark, run(stream), f"out_{name}", tmp_path) if "(9," not in r and ", 9," not in r]
    assert got == want


def test_static_and_interval_joins(spark, samples, tmp_path):
    batch, stream = samples
    raw = stream.withColumn("raw", F.col("value").cast("long")).drop("value")
    channels = spark.createDataFrame([("n", 0.5, 1.0)], "signal string, scale double, add double")
    got = drained(spark, live.decoded(raw, channels).select("session", "ts", "value").where("session < 9"), "out_static", tmp_path)
    want = live.decoded(batch.withColumn("raw", F.col("value").cast("long")).drop("value"), channels).select("session", "ts", "value")
    assert got == sorted(map(repr, (tuple(r) for r in want.collect())))
    both = lambda d: live.aligned(d.where("signal = 'n'"), d.where("signal = 'm'"), "8 seconds")
    assert drained(spark, both(stream), "out_interval", tmp_path / "x") == sorted(map(repr, (tuple(r) for r in both(batch).collect())))
