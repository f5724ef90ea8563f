"""The log operators on streams of samples(session, ts timestamp, signal, value).

Each works on a batch DataFrame as well, which is how the results are checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "10 seconds"


def windowed_means(samples: DataFrame, width: str = "60 seconds", late: str = LATE) -> DataFrame:
    out = samples.withWatermark("ts", late).groupBy(F.window("ts", width), "session", "signal").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "session", "signal", "mean", "n")


def saturation(samples: DataFrame, on_clamp: Column, width: str = "10 seconds", slide: str = "2 seconds", late: str = LATE) -> DataFrame:
    out = samples.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "session").agg(F.avg(on_clamp.cast("double")).alias("share"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "session", "share", "n")


def log_runs(samples: DataFrame, gap: str = "300 milliseconds", late: str = LATE) -> DataFrame:
    out = samples.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select("session", "first", "last", "n")


def without_repeats(samples: DataFrame, late: str = LATE) -> DataFrame:
    w = samples.withWatermark("ts", late)
    keys = ["session", "ts", "signal"]
    return w.dropDuplicatesWithinWatermark(keys) if samples.isStreaming else w.dropDuplicates(keys)


def decoded(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """Stream-static join with the channel catalogue."""
    return samples.join(channels, "signal").withColumn("value", F.col("raw") * F.col("scale") + F.col("add"))


def aligned(a: DataFrame, b: DataFrame, within: str = "500 milliseconds", late: str = LATE) -> DataFrame:
    """Pairs of two blocks' samples of one session at most ``within`` apart."""
    x = a.select("session", F.col("ts").alias("ts_a"), F.col("value").alias("a")).withWatermark("ts_a", late)
    y = b.select(F.col("session").alias("_s"), F.col("ts").alias("ts_b"), F.col("value").alias("b")).withWatermark("ts_b", late)
    near = f"session = _s and ts_b >= ts_a - interval {within} and ts_b <= ts_a + interval {within}"
    return x.join(y, F.expr(near)).drop("_s")


class Steps(StatefulProcessor):
    """step(state or None, *columns) -> (state, outputs) along each session, in order of (ts, seq).

    Rows wait in list state until the watermark has passed them, so those that come out of order within the delay are put
    in order; later ones are dropped. A timer at the first waiting row makes it go without new input. With ``gap``
    (microseconds), a pause longer than it ends a run: the state starts anew, and a timer clears it.
    """

    def __init__(self, step: Callable, state: str, fields: list[tuple[str, str]], gap: int | None):
        self.step, self.state, self.gap = step, state, gap
        self.columns, self.names = ", ".join(f"`{c}` {t}" for c, t in fields), ["us", "seq", *(c for c, _ in fields)]
        #: Integers with nulls among them come as floats.
        self.kinds = {c: int for c, t in [("us", "bigint"), ("seq", "bigint"), *fields] if t in ("tinyint", "smallint", "int", "bigint")}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state)
        self.last = handle.getValueState("last", "last long, passed long")
        self.waiting = handle.getListState("waiting", f"us long, seq long, {self.columns}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, passed = self.last.get() if self.last.exists() else (None, None)
        new = []
        for pdf in rows:
            new += list(zip(*([None if v is None or v != v else self.kinds.get(c, lambda v: v)(v) for v in pdf[c].tolist()] for c in self.names), strict=True))
        new = [r for r in new if passed is None or r[0] >= passed]
        if new:
            self.waiting.appendList(new)
        yield from self.moved(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.moved(key, timerValues.getCurrentWatermarkInMs())

    def moved(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """Runs the rows that the watermark has passed."""
        to = 1000 * watermark
        rows = sorted(self.waiting.get(), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] < to], [tuple(r) for r in rows if r[0] >= to]
        last, passed = self.last.get() if self.last.exists() else (None, None)
        state = tuple(self.value.get()) if self.value.exists() else None
        out = []
        for us, seq, *row in ready:
            if self.gap is not None and last is not None and us - last > self.gap:
                state = None
            state, values = self.step(state, *row)
            last = us
            out.append((*key, us, seq, *row, *values))
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        ended = self.gap is not None and last is not None and not rest and to - last > self.gap
        if ended:  # nothing of the run is kept; what is older than the watermark is dropped before it comes here
            self.value.clear()
            self.last.clear()
        else:
            if state is not None:
                self.value.update(state)
            if ready or rest:
                self.last.update((last, max(to, passed or 0)))
            if rest:
                self.handle.registerTimer(rest[0][0] // 1000 + 1)
            elif self.gap is not None and last is not None:
                self.handle.registerTimer((last + self.gap) // 1000 + 1)
        if out:
            yield pd.DataFrame(dict(enumerate(zip(*out, strict=True)))).astype(object)

    def close(self) -> None:
        pass


def stateful(samples: DataFrame, columns: list[str], step: Callable, state: str, outputs: str, gap: str | None = None, late: str = LATE) -> DataFrame:
    """samples(session, ts timestamp, seq, columns) with the outputs of step(state or None, *columns) -> (state, outputs).

    ``state`` and ``outputs`` are schemas. Needs the RocksDB state store. Rows come out once the watermark has passed
    them, equal to the batch form over all rows that were in time.
    """
    kind = lambda c: samples.schema[c].dataType.simpleString()
    fields = [(c, kind(c)) for c in columns]
    rows = samples.withWatermark("ts", late).select("session", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), *columns, "ts")
    us = int(samples.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + interval {gap})").first()[0]) if gap else None
    schema = ", ".join([f"session {kind('session')}, us long, seq long", *(f"`{c}` {t}" for c, t in fields), outputs])
    out = rows.groupBy("session").transformWithStateInPandas(Steps(step, state, fields, us), schema, "append", "eventtime")
    return out.withColumn("us", F.timestamp_micros("us")).withColumnRenamed("us", "ts")


def held(step: Callable) -> Callable:
    """A filter's step(y or None, *columns) -> y as a step of ``stateful``: a row with a null leaves the value as it is."""

    def run(state, *row):
        y = state[0] if state else None
        y = y if None in row else step(y, *row)
        return (None if y is None else (y,)), (y,)

    return run


def filtered(samples: DataFrame, columns: list[str], step: Callable, gap: str | None = None, late: str = LATE) -> DataFrame:
    """A recursive filter of integers (pt1, iir, rate_limited, integral with its constants bound) as column y."""
    return stateful(samples, columns, held(step), "y long", "y long", gap, late)


def hysteresis(samples: DataFrame, x: str, on: float, off: float, start: int = 0, gap: str | None = None, late: str = LATE) -> DataFrame:
    """1 above ``on``, 0 below ``off``, else as before, as column flag."""

    def step(state, v):
        flag = state[0] if state else start
        flag = flag if v is None else 1 if v > on else 0 if v < off else flag
        return (flag,), (flag,)

    return stateful(samples, [x], step, "flag int", "flag int", gap, late)


def engine_state(samples: DataFrame, x: str, full: float, full_width: float, idle: float, idle_width: float, gap: str | None = None, late: str = LATE) -> DataFrame:
    """VL, LL or TL from two hysteresis pairs as column state, and grey where x is within the upper pair's width."""

    def step(state, v):
        vl, ll = state or (0, 0)
        if v is not None:
            vl = 1 if v > full else 0 if v < full - full_width else vl
            ll = 1 if v < idle - idle_width else 0 if v >= idle else ll
        return (vl, ll), ("VL" if vl else "LL" if ll else "TL", None if v is None else full - full_width <= v <= full)

    return stateful(samples, [x], step, "vl int, ll int", "state string, grey boolean", gap, late)
