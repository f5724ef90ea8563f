"""Vehicle logs: samples by session and time, and what is computed from them.

Unless said otherwise samples have ``session`` and ``ts`` (seconds as a double or a long), and ties in time are
ordered by ``seq``. All windows share the partitioning by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

ORDER = ["ts", "seq"]


def by_session(*extra: str) -> WindowSpec:
    return W.partitionBy("session", *extra).orderBy(*ORDER)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(W.unboundedPreceding, 0)


def decode(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """samples(signal, raw) with their channel's value; the catalogue is small and joined by signal."""
    return samples.join(channels, "signal").withColumn("value", F.col("raw") * F.col("scale") + F.col("add"))


def gradient(samples: DataFrame, value: str, out: str = "slope") -> DataFrame:
    """Change a second since the sample before."""
    w = by_session()
    return samples.withColumn(out, F.try_divide(F.col(value) - F.lag(value).over(w), F.col("ts") - F.lag("ts").over(w)))


def steady(samples: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Samples at which no channel changes faster than its limit."""
    out = samples
    for c in limits:
        out = gradient(out, c, f"_{c}")
    ok = F.lit(True)
    for c, most in limits.items():
        ok = ok & (F.abs(f"_{c}") <= most)
    return out.where(ok).drop(*(f"_{c}" for c in limits))


def islands(samples: DataFrame, state: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Adds state and island: a number that rises when the state changes."""
    w = by_session(*extra)
    out = samples.withColumn("state", state)
    changed = F.coalesce(~F.lag("state").over(w).eqNullSafe(F.col("state")), F.lit(True)) | (F.row_number().over(w) == 1)
    return out.withColumn("changed", changed.cast("int")).withColumn("island", F.sum("changed").over(so_far(w)))


def dwell(samples: DataFrame, on_clamp: Column, least: float = 0.3) -> DataFrame:
    """Runs in which a value sits on its clamp for longer than ``least`` seconds."""
    out = islands(samples, on_clamp).where("state").groupBy("session", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return out.withColumn("seconds", F.col("end") - F.col("start")).where(F.col("seconds") > least)


def stale(samples: DataFrame, value: str, least: float) -> DataFrame:
    """Runs of one unchanged value for longer than ``least`` seconds."""
    out = islands(samples, F.col(value)).groupBy("session", "island").agg(F.first("state").alias("value"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return out.withColumn("seconds", F.col("end") - F.col("start")).where((F.col("seconds") > least) & (F.col("n") > 1))


def runs(samples: DataFrame, gap: float = 0.3) -> DataFrame:
    """Adds run: a log run ends where samples are further apart than ``gap``."""
    w = by_session()
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) > gap, F.lit(False)).cast("int")
    return samples.withColumn("_new", new).withColumn("run", F.sum("_new").over(so_far(w))).drop("_new")


def hysteresis(samples: DataFrame, x: Column, on: Column, off: Column, out: str = "flag", start: int = 0) -> DataFrame:
    """1 above ``on``, 0 below ``off``, else as before; both strict."""
    edge = F.when(x > on, 1).when(x < off, 0)
    return samples.withColumn(out, F.coalesce(F.last(edge, ignorenulls=True).over(so_far(by_session())), F.lit(start)))


def engine_state(samples: DataFrame, x: Column, full: Column, full_width: float, idle: Column, idle_width: float, full_off: Column | None = None, idle_on: Column | None = None) -> DataFrame:
    """VL, LL or TL from two hysteresis pairs, VL first; grey where x is within the upper pair's width.

    ``full_off`` and ``idle_on`` are the lower thresholds of the pairs where they are known by themselves: a difference of
    two thresholds is rounded, so a value on the lower one can come out on its other side.
    """
    full_off, idle_on = full - full_width if full_off is None else full_off, idle - idle_width if idle_on is None else idle_on
    out = hysteresis(samples, x, full, full_off, "_vl")
    out = out.withColumn("_ll", F.coalesce(F.last(F.when(x < idle_on, 1).when(x >= idle, 0), ignorenulls=True).over(so_far(by_session())), F.lit(0)))
    return out.withColumn("state", F.when(F.col("_vl") == 1, "VL").when(F.col("_ll") == 1, "LL").otherwise("TL")).withColumn("grey", (x >= full - full_width) & (x <= full)).drop("_vl", "_ll")


def transitions(samples: DataFrame, state: Column) -> DataFrame:
    """State changes per session."""
    return islands(samples, state).groupBy("session").agg((F.sum("changed") - 1).alias("changes"))


def flag_sequence(samples: DataFrame, code: Column, pattern: str) -> DataFrame:
    """Sessions whose states in order, one letter per island, hold the pattern, and how often."""
    first = islands(samples, code).where("changed = 1").groupBy("session").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "state"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["state"]), "")
    return first.select("session", F.regexp_count(text, F.lit(pattern)).alias("hits"))


def lag_between_edges(samples: DataFrame, a: Column, b: Column) -> DataFrame:
    """Per session and fall of a to zero: the time until b falls, before a falls again."""
    w = by_session()
    fall = lambda x: F.coalesce((F.lag(x).over(w) > 0) & (x <= 0), F.lit(False))
    out = samples.withColumn("_a", fall(a)).withColumn("_b", fall(b))
    out = out.withColumn("start", F.last(F.when(F.col("_a"), F.col("ts")), ignorenulls=True).over(so_far(w)))
    return out.where("start is not null").groupBy("session", "start").agg((F.min(F.when(F.col("_b"), F.col("ts"))) - F.col("start")).alias("delay"))


def event_windows(events: DataFrame, samples: DataFrame, seconds: float) -> DataFrame:
    """Samples within ``seconds`` after each event of their session: an equi-join over time blocks, then the exact test."""
    e = events.select("session", F.col("ts").alias("event_ts"), F.col("seq").alias("event"))
    e = e.withColumn("blk", F.explode(F.array(F.floor(F.col("event_ts") / seconds), F.floor(F.col("event_ts") / seconds) + 1)))
    s = samples.withColumn("blk", F.floor(F.col("ts") / seconds))
    return e.join(s, ["session", "blk"]).where((F.col("ts") >= F.col("event_ts")) & (F.col("ts") <= F.col("event_ts") + seconds)).drop("blk")


def settle_time(windows: DataFrame, value: str, target: Column, share: float = 0.1) -> DataFrame:
    """Per event the time after which the value stays within ``share`` of the target; null if it never does."""
    out = windows.withColumn("_out", F.abs(F.col(value) - target) > share * F.abs(target))
    agg = out.groupBy("session", "event", "event_ts").agg(F.max(F.when(F.col("_out"), F.col("ts"))).alias("last_out"), F.max("ts").alias("end"), F.min("ts").alias("begin"))
    after = out.join(agg, ["session", "event", "event_ts"]).where("last_out is null or ts > last_out")
    return agg.join(after.groupBy("session", "event").agg(F.min("ts").alias("first_in")), ["session", "event"], "left").select("session", "event", (F.col("first_in") - F.col("event_ts")).alias("settle"))


def monotone_crossing(samples: DataFrame, x: str, y: str, low: float, high: float) -> DataFrame:
    """Stretches in which x rises within [low, high]: the least step of y, which must not be negative."""
    w = by_session()
    out = samples.withColumn("_dx", F.col(x) - F.lag(x).over(w)).withColumn("_dy", F.col(y) - F.lag(y).over(w))
    rising = F.coalesce((F.col("_dx") >= 0) & F.col(x).between(low, high), F.lit(False))
    out = islands(out, rising).where("state").groupBy("session", "island").agg(F.min("_dy").alias("least_step"), F.count("*").alias("n"))
    return out.withColumn("ok", F.coalesce(F.col("least_step") >= 0, F.lit(True)))


def binned_surface(samples: DataFrame, x: Column, y: Column, z: Column) -> DataFrame:
    return samples.groupBy(x.alias("x_bin"), y.alias("y_bin")).agg(F.avg(z).alias("mean"), F.count(z).alias("n"), F.stddev_samp(z).alias("sd"))


def surface_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x_bin", "y_bin", F.col("mean").alias("a")).join(b.select("x_bin", "y_bin", F.col("mean").alias("b")), ["x_bin", "y_bin"], "full").withColumn("difference", F.col("a") - F.col("b"))


def correction_map(samples: DataFrame, x: Column, y: Column, measured: Column, modelled: Column, valid: Column) -> DataFrame:
    return samples.where(valid).groupBy(x.alias("x_bin"), y.alias("y_bin")).agg(F.avg(F.try_divide(measured, modelled)).alias("ratio"), F.count("*").alias("n"))


def apply_correction(cells: DataFrame, ratio: DataFrame, least: int, top_y: float) -> DataFrame:
    """cells(x_bin, y_bin, z): multiplied where there are samples enough and y is low enough."""
    ok = (F.col("n") >= least) & (F.col("y_bin") <= top_y)
    return cells.join(ratio, ["x_bin", "y_bin"], "left").withColumn("z_new", F.when(ok & F.col("ratio").isNotNull(), F.col("z") * F.col("ratio")).otherwise(F.col("z")))


def full_load_curve(samples: DataFrame, n: Column, rf: Column, full: Column, flap: Column) -> DataFrame:
    return samples.where(full).groupBy(n.alias("n_bin"), flap.alias("flap")).agg(F.avg(rf).alias("rf"), F.count("*").alias("n"))


def stratified(samples: DataFrame, flags: list[str], value: str) -> DataFrame:
    """All combinations of the flags, and of each left out."""
    return samples.cube(*flags).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.grouping_id().alias("level"))


def trim_verdict(samples: DataFrame, value: str, bands: list[tuple[str, float, float]]) -> DataFrame:
    """Mean of a trim per session, and the band that holds it; between bands 'unclassified'."""
    m = samples.groupBy("session").agg(F.avg(value).alias("mean"))
    return m.withColumn("verdict", F.coalesce(*(F.when(F.col("mean").between(lo, hi), F.lit(name)) for name, lo, hi in bands), F.lit("unclassified")))


def coastdown(samples: DataFrame, run: str, t: str, n: str, low: float, high: float) -> DataFrame:
    """Slope of speed over time per run between two speeds."""
    return samples.where(F.col(n).between(low, high)).groupBy(run).agg(F.regr_slope(n, t).alias("slope"), F.count("*").alias("n"))


def inertia_ratio(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the mean slope of each set's runs, how many there are, and old over new, which is the ratio of the inertias."""
    mean = lambda runs, n: runs.agg(F.avg("slope").alias(f"slope_{n}"), F.count("slope").alias(f"runs_{n}"))
    both = mean(before, "before").join(F.broadcast(mean(after, "after")))
    return both.withColumn("ratio", F.try_divide("slope_before", "slope_after"))


def channel_delta(samples: DataFrame, a: str, b: str) -> DataFrame:
    """Per instant of samples(session, ts, signal, value) the value of a less that of b: the amount of intervention."""
    value = lambda s: F.max(F.when(F.col("signal") == s, F.col("value")))
    return samples.where(F.col("signal").isin(a, b)).groupBy("session", "ts").agg((value(a) - value(b)).alias("delta"))


def refresh_rates(blocks: DataFrame) -> DataFrame:
    """Per log set of blocks(log_set, payload), polled in turn: the wire time of a round in ms and the rounds a second."""
    out = blocks.groupBy("log_set").agg(F.sum(S.wire_time_ms(F.col("payload"))).alias("wire_ms"), F.count("*").alias("blocks"))
    return out.withColumn("hz", S.refresh_hz(F.col("wire_ms")))


def scatter_against(scatter: DataFrame, baseline: DataFrame) -> DataFrame:
    """scatter(session, scatter) less a baseline's, per session of both."""
    return scatter.join(baseline.select("session", F.col("scatter").alias("base")), "session").withColumn("more", F.col("scatter") - F.col("base"))


def cylinder_scatter(samples: DataFrame, cylinders: list[str]) -> DataFrame:
    """Spread over the cylinders per session, from their means."""
    stack = ", ".join(f"'{c}', `{c}`" for c in cylinders)
    long_ = samples.select("session", F.expr(f"stack({len(cylinders)}, {stack}) as (cylinder, value)"))
    return long_.groupBy("session", "cylinder").agg(F.avg("value").alias("mean")).groupBy("session").agg(F.stddev_pop("mean").alias("scatter"))


def saturation_share(samples: DataFrame, on_clamp: Column) -> DataFrame:
    return samples.groupBy("session").agg(F.avg(on_clamp.cast("double")).alias("share"))


def before_after(samples: DataFrame, manoeuvre: str, after: Column, value: str, target: float, least: float = 0.3) -> DataFrame:
    """Dip below the target before and after a change, per manoeuvre; passed if it shrinks by ``least`` or more."""
    m = samples.groupBy(manoeuvre).agg(F.min(F.when(~after, F.col(value))).alias("low_before"), F.min(F.when(after, F.col(value))).alias("low_after"))
    shrink = 1 - F.try_divide(target - F.col("low_after"), target - F.col("low_before"))
    return m.withColumn("shrink", shrink).withColumn("passed", F.col("shrink") >= least)


def sample_rate(samples: DataFrame) -> DataFrame:
    """Samples a second per session, and the highest frequency that they show."""
    r = F.try_divide(F.count("*") - 1, F.max("ts") - F.min("ts"))
    return samples.groupBy("session").agg(r.alias("rate"), (r / 2).alias("nyquist"))


def threshold_headroom(samples: DataFrame, value: Column, threshold: Column, most: float = 0.5) -> DataFrame:
    return samples.groupBy("session").agg(F.max(F.try_divide(value, threshold)).alias("used")).withColumn("ok", F.col("used") <= most)


def countdown_flag(samples: DataFrame, condition: Column, hold: int) -> DataFrame:
    """On while the condition holds and for ``hold`` samples after."""
    return samples.withColumn("flag", F.max(condition.cast("int")).over(by_session().rowsBetween(-hold, 0)))


def aligned(samples: DataFrame, signals: list[str]) -> DataFrame:
    """One row per instant with the latest value of each signal, for blocks that are polled in turn."""
    w = so_far(by_session())
    return samples.select("session", "ts", "seq", *(F.last(F.when(F.col("signal") == s, F.col("value")), ignorenulls=True).over(w).alias(s) for s in signals))
