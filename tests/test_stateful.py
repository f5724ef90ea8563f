"""State per session over several micro-batches, with rows out of order, late or null, against the batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from calgraph.operators import filters as X
from calgraph.operators import logs as L
from calgraph.streaming import live

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHAPE = "session string, ts timestamp, seq long, x long, g long"


def made(seconds):
    rng = random.Random(seconds)
    rows = []
    for session in ("a", "b", None):
        for i in range(seconds):
            x = None if rng.random() < 0.15 else rng.randrange(0, 2000)
            rows.append((session, 1_700_000_000.0 + i * 1.5 + (120 if session == "b" and i > seconds // 2 else 0), i, x, rng.randrange(0, 9)))
    return rows


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """The rows in time, and a stream of them in six files, out of order within the delay, with three late rows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    path = str(tmp_path_factory.mktemp("steps"))
    rng, rows = random.Random(1), made(60)
    rows.sort(key=lambda r: r[1] + rng.random() * 6)
    n = len(rows) // 5 + 1
    late = [("a", 1_700_000_000.0, 900 + i, 5, 1) for i in range(3)]
    parts = [rows[i : i + n] for i in range(0, len(rows), n)]
    parts[4] = [*parts[4], *late]
    parts.append([("end", 1_700_009_999.0, 0, 0, 0)])
    frame = lambda r: spark.createDataFrame(r, "session string, t double, seq long, x long, g long").select("session", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "seq", "x", "g")
    for p in parts:
        frame(p).coalesce(1).write.mode("append").parquet(path)
    yield frame(rows).cache(), spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drained(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        return sorted((repr(tuple(r)) for r in spark.table(name).where("session is null or session != 'end'").collect()))
    finally:
        q.stop()


GAIN = lambda y, e, g: X.integral(y, e - 1000, g, -500, 800)
CASES = {
    "pt1": (lambda d: live.filtered(d, ["x"], lambda y, v: X.pt1(y, v, 40)), lambda d: X.pt1_filter(d, "x", 40), ["x", "y"]),
    "ramp": (lambda d: live.filtered(d, ["x"], lambda y, v: X.rate_limited(y, v, 90)), lambda d: X.ramp(d, "x", 90), ["x", "y"]),
    "integral": (lambda d: live.filtered(d, ["x", "g"], GAIN), lambda d: X.recursive(d, ["x", "g"], GAIN), ["x", "g", "y"]),
    "flag": (lambda d: live.hysteresis(d, "x", 1500, 400), lambda d: L.hysteresis(d, F.col("x"), F.lit(1500), F.lit(400)), ["x", "flag"]),
    "state": (lambda d: live.engine_state(d, "x", 1500, 200, 500, 100), lambda d: L.engine_state(d, F.col("x"), F.lit(1500), 200, F.lit(500), 100), ["x", "state", "grey"]),
}


@pytest.mark.parametrize("name", CASES)
def test_steps_equal_the_batch_form(spark, stream, tmp_path, name):
    batch, rows = stream
    run, plain, columns = CASES[name]
    got = drained(spark, run(rows).select("session", "ts", "seq", *columns), f"steps_{name}", tmp_path)
    assert got == sorted(repr(tuple(r)) for r in plain(batch).select("session", "ts", "seq", *columns).collect())


def test_a_run_ends_at_the_gap(spark, stream, tmp_path):
    batch, rows = stream
    got = drained(spark, live.filtered(rows, ["x"], lambda y, v: X.rate_limited(y, v, 1), gap="60 seconds").select("session", "ts", "seq", "y"), "steps_gap", tmp_path)
    late = F.when((F.col("session") == "b") & (F.col("seq") > 30), F.lit("second")).otherwise(F.lit("first"))
    runs = batch.withColumn("run", F.struct("session", late.alias("half")).cast("string"))
    want = X.recursive(runs, ["x"], lambda y, v: X.rate_limited(y, v, 1), session="run").select("session", "ts", "seq", "y")
    assert got == sorted(repr(tuple(r)) for r in want.collect())
