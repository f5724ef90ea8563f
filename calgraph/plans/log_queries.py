"""Queries on logs: events are samples, a user is a session, value a channel, props.k a second one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as X
from ..operators import logs as L
from ..streaming import live
from . import base as b

QUERIES, ORACLES = {}, {}
_W = "OVER (PARTITION BY session ORDER BY ts, seq)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.startswith("SELECT") and " events" in sql else b.SQL + sql
        return f

    return add


_ISLANDS = """, c AS (SELECT *, {state} AS state, CASE WHEN ({state}) IS NOT DISTINCT FROM lag({state}) OVER (PARTITION BY session ORDER BY ts, seq) AND row_number() OVER (PARTITION BY session ORDER BY ts, seq) > 1 THEN 0 ELSE 1 END AS changed FROM samples), i AS (SELECT *, sum(changed) OVER (PARTITION BY session ORDER BY ts, seq) AS island FROM c)
"""


@query(""", ch AS (SELECT * FROM (VALUES ('click', 0.1, 0.0), ('view', 1.0, -48.0), ('error', 0.5, 2.0)) AS v(signal, scale, add)) SELECT seq, signal, round(k * scale + add, 6) AS value FROM samples JOIN ch ON kind = signal""")
def decode_channels(spark, sf):
    ch = spark.sql("SELECT * FROM VALUES ('click', 0.1D, 0.0D), ('view', 1.0D, -48.0D), ('error', 0.5D, 2.0D) AS v(signal, scale, add)")
    s = b.samples(spark, sf).select("seq", F.col("kind").alias("signal"), F.col("k").alias("raw"))
    return L.decode(s, F.broadcast(ch)).select("seq", "signal", F.round("value", 6).alias("value"))


@query(f""", g AS (SELECT *, (value - lag(value) {_W}) / nullif(ts - lag(ts) {_W}, 0) AS dv, (k - lag(k) {_W}) / nullif(ts - lag(ts) {_W}, 0) AS dk FROM samples) SELECT seq, session FROM g WHERE abs(dv) <= 0.01 AND abs(dk) <= 0.02""")
def steady_state_gate(spark, sf):
    return L.steady(b.samples(spark, sf), {"value": 0.01, "k": 0.02}).select("seq", "session")


@query(_ISLANDS.format(state="value > 20") + "SELECT session, CAST(island AS BIGINT) AS island, round(min(ts), 3) AS start, count(*) AS n, round(max(ts) - min(ts), 3) AS seconds FROM i WHERE state GROUP BY 1, 2 HAVING max(ts) - min(ts) > 600")
def clamp_dwell(spark, sf):
    return L.dwell(b.samples(spark, sf), F.col("value") > 20, 600.0).select("session", "island", F.round("start", 3).alias("start"), "n", F.round("seconds", 3).alias("seconds"))


@query(_ISLANDS.format(state="kind") + "SELECT session, CAST(island AS BIGINT) AS island, min(state) AS value, count(*) AS n, round(max(ts) - min(ts), 3) AS seconds FROM i GROUP BY 1, 2 HAVING count(*) > 1 AND max(ts) - min(ts) > 60")
def stale_signal(spark, sf):
    return L.stale(b.samples(spark, sf), "kind", 60.0).select("session", "island", "value", "n", F.round("seconds", 3).alias("seconds"))


@query(_ISLANDS.format(state="kind") + "SELECT session, CAST(sum(changed) - 1 AS BIGINT) AS changes FROM i GROUP BY 1")
def transition_count(spark, sf):
    return L.transitions(b.samples(spark, sf), F.col("kind"))


@query(f""", g AS (SELECT *, CASE WHEN ts - lag(ts) {_W} > 3600 THEN 1 ELSE 0 END AS new FROM samples), r AS (SELECT session, sum(new) {_W} AS run, ts FROM g) SELECT session, CAST(run AS BIGINT) AS run, count(*) AS n, round(max(ts) - min(ts), 3) AS seconds FROM r GROUP BY 1, 2""")
def log_runs(spark, sf):
    return L.runs(b.samples(spark, sf), 3600.0).groupBy("session", "run").agg(F.count("*").alias("n"), F.round(F.max("ts") - F.min("ts"), 3).alias("seconds"))


@query(f""", e AS (SELECT *, CASE WHEN value > 30 THEN 1 WHEN value < 10 THEN 0 END AS edge FROM samples) SELECT seq, coalesce(last_value(edge IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS flag FROM e""")
def hysteresis_flag(spark, sf):
    return L.hysteresis(b.samples(spark, sf), F.col("value"), F.lit(30.0), F.lit(10.0)).select("seq", "flag")


@query(""", e AS (SELECT *, 20 + k / 5.0 AS full_, CASE WHEN value > 20 + k / 5.0 THEN 1 WHEN value < 14 + k / 5.0 THEN 0 END AS v, CASE WHEN value < 1.8 THEN 1 WHEN value >= 2 THEN 0 END AS l FROM samples),
f AS (SELECT *, coalesce(last_value(v IGNORE NULLS) OVER w, 0) AS vl, coalesce(last_value(l IGNORE NULLS) OVER w, 0) AS ll FROM e WINDOW w AS (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
SELECT seq, CASE WHEN vl = 1 THEN 'VL' WHEN ll = 1 THEN 'LL' ELSE 'TL' END AS state, value >= full_ - 6 AND value <= full_ AS grey FROM f""")
def engine_state(spark, sf):
    full, off = 20 + F.col("k") / 5.0, 14 + F.col("k") / 5.0
    return L.engine_state(b.samples(spark, sf), F.col("value"), full, 6.0, F.lit(2.0), 0.2, full_off=off, idle_on=F.lit(1.8)).select("seq", "state", "grey")


@query(_ISLANDS.format(state="upper(kind[1])") + """, s AS (SELECT session, string_agg(state, '' ORDER BY ts, seq) AS text FROM i WHERE changed = 1 GROUP BY 1) SELECT session, len(regexp_extract_all(text, 'CVE')) AS hits FROM s""")
def flag_sequence(spark, sf):
    return L.flag_sequence(b.samples(spark, sf), F.upper(F.substring("kind", 1, 1)), "CVE")


@query(f""", f AS (SELECT *, coalesce(lag(value - 10) {_W} > 0 AND value - 10 <= 0, false) AS fa, coalesce(lag(k - 50) {_W} > 0 AND k - 50 <= 0, false) AS fb FROM samples), g AS (SELECT *, last_value(CASE WHEN fa THEN ts END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS start FROM f)
SELECT session, round(start, 3) AS start, round(min(CASE WHEN fb THEN ts END) - start, 3) AS delay FROM g WHERE start IS NOT NULL GROUP BY session, g.start""")
def lag_between_edges(spark, sf):
    return L.lag_between_edges(b.samples(spark, sf), F.col("value") - 10, F.col("k") - 50).select("session", F.round("start", 3).alias("start"), F.round("delay", 3).alias("delay"))


@query(""", e AS (SELECT session, ts AS event_ts, seq AS event FROM samples WHERE kind = 'error') SELECT event, seq FROM e JOIN samples s ON e.session = s.session AND s.ts >= event_ts AND s.ts <= event_ts + 7200""")
def event_windows(spark, sf):
    s = b.samples(spark, sf)
    return L.event_windows(s.where("kind = 'error'"), s, 7200.0).select("event", "seq")


@query(""", e AS (SELECT session, ts AS event_ts, seq AS event FROM samples WHERE kind = 'error'), w AS (SELECT e.session, event, event_ts, s.ts, abs(value - 10) > 8 AS out FROM e JOIN samples s ON e.session = s.session AND s.ts >= event_ts AND s.ts <= event_ts + 7200), a AS (SELECT session, event, event_ts, max(CASE WHEN out THEN ts END) AS last_out FROM w GROUP BY 1, 2, 3)
SELECT a.session, a.event, round((SELECT min(ts) FROM w WHERE w.event = a.event AND (last_out IS NULL OR ts > last_out)) - event_ts, 3) AS settle FROM a""")
def settle_time(spark, sf):
    s = b.samples(spark, sf)
    w = L.event_windows(s.where("kind = 'error'"), s, 7200.0)
    return L.settle_time(w, "value", F.lit(10.0), 0.8).select("session", "event", F.round("settle", 3).alias("settle"))


@query(f""", d AS (SELECT *, value - lag(value) {_W} AS dx, k - lag(k) {_W} AS dy FROM samples), c AS (SELECT *, coalesce(dx >= 0 AND value BETWEEN 2 AND 20, false) AS state FROM d), e AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) {_W} AND row_number() {_W} > 1 THEN 0 ELSE 1 END AS changed FROM c), i AS (SELECT *, sum(changed) {_W} AS island FROM e)
SELECT session, CAST(island AS BIGINT) AS island, min(dy) AS least_step, count(*) AS n, coalesce(min(dy) >= 0, true) AS ok FROM i WHERE state GROUP BY 1, 2""")
def monotone_crossing(spark, sf):
    return L.monotone_crossing(b.samples(spark, sf), "value", "k", 2.0, 20.0)


_SURFACE = "SELECT CAST(floor(k / 10.0) AS BIGINT) AS x_bin, kind AS y_bin, avg(value) AS mean, count(value) AS n, stddev_samp(value) AS sd FROM samples {0} GROUP BY 1, 2"


def _surface(df):
    return L.binned_surface(df, F.floor(F.col("k") / 10), F.col("kind"), F.col("value"))


@query("SELECT x_bin, y_bin, round(mean, 6) AS mean, n, round(sd, 6) AS sd FROM (" + _SURFACE.format("") + ")")
def binned_surface(spark, sf):
    return _surface(b.samples(spark, sf)).withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query(f", a AS ({_SURFACE.format('WHERE session % 2 = 0')}), z AS ({_SURFACE.format('WHERE session % 2 = 1')}) SELECT x_bin, y_bin, round(a.mean - z.mean, 6) AS difference FROM a FULL JOIN z USING (x_bin, y_bin)")
def surface_difference(spark, sf):
    s = b.samples(spark, sf)
    return L.surface_difference(_surface(s.where("session % 2 = 0")), _surface(s.where("session % 2 = 1"))).select("x_bin", "y_bin", F.round("difference", 6).alias("difference"))


_CORRECTION = "SELECT CAST(floor(k / 10.0) AS BIGINT) AS x_bin, session % 8 AS y_bin, avg(value / nullif(k, 0)) AS ratio, count(*) AS n FROM samples WHERE value > 2 GROUP BY 1, 2"


@query(f"SELECT x_bin, y_bin, round(ratio, 6) AS ratio, n FROM ({_CORRECTION})")
def correction_map(spark, sf):
    return L.correction_map(b.samples(spark, sf), F.floor(F.col("k") / 10), F.col("session") % 8, F.col("value"), F.col("k"), F.col("value") > 2).withColumn("ratio", F.round("ratio", 6))


@query(f", r AS ({_CORRECTION}), c AS (SELECT CAST(col AS BIGINT) AS x_bin, CAST(row AS BIGINT) AS y_bin, vec_id, z FROM cells) SELECT vec_id, x_bin, y_bin, round(CASE WHEN n >= 100 AND y_bin <= 5 AND ratio IS NOT NULL THEN z * ratio ELSE z END, 6) AS z_new FROM c LEFT JOIN r USING (x_bin, y_bin)")
def apply_correction(spark, sf):
    ratio = L.correction_map(b.samples(spark, sf), F.floor(F.col("k") / 10), F.col("session") % 8, F.col("value"), F.col("k"), F.col("value") > 2)
    cells = b.cells(spark, sf).select("vec_id", F.col("col").cast("long").alias("x_bin"), F.col("row").cast("long").alias("y_bin"), "z")
    return L.apply_correction(cells, ratio, 100, 5.0).select("vec_id", "x_bin", "y_bin", F.round("z_new", 6).alias("z_new"))


@query("SELECT CAST(floor(k / 20.0) AS BIGINT) AS n_bin, kind AS flap, round(avg(value), 6) AS rf, count(*) AS n FROM samples WHERE value > 5 GROUP BY 1, 2")
def full_load_curve(spark, sf):
    return L.full_load_curve(b.samples(spark, sf), F.floor(F.col("k") / 20), F.col("value"), F.col("value") > 5, F.col("kind")).withColumn("rf", F.round("rf", 6))


@query("SELECT kind, k % 3 AS band, count(*) AS n, round(avg(value), 6) AS mean FROM samples GROUP BY CUBE (kind, k % 3)")
def stratified_summary(spark, sf):
    s = b.samples(spark, sf).withColumn("band", F.col("k") % 3)
    return L.stratified(s, ["kind", "band"], "value").select("kind", "band", "n", F.round("mean", 6).alias("mean"))


@query("SELECT session, round(avg(value), 6) AS mean, CASE WHEN avg(value) BETWEEN 9.5 AND 10.5 THEN 'good' WHEN avg(value) BETWEEN 7.5 AND 9 THEN 'lean' ELSE 'unclassified' END AS verdict FROM samples GROUP BY 1")
def trim_verdict(spark, sf):
    return L.trim_verdict(b.samples(spark, sf), "value", [("good", 9.5, 10.5), ("lean", 7.5, 9.0)]).withColumn("mean", F.round("mean", 6))


@query("SELECT session, round(regr_slope(value, ts - 1704067200) * 1e6, 3) AS slope, count(*) AS n FROM samples WHERE value BETWEEN 3 AND 50 GROUP BY 1")
def coastdown_slope(spark, sf):
    s = b.samples(spark, sf).withColumn("ts", F.col("ts") - 1704067200)
    return L.coastdown(s, "session", "ts", "value", 3.0, 50.0).select("session", F.round(F.col("slope") * 1e6, 3).alias("slope"), "n")


@query(", m AS (SELECT session, k % 6 AS c, avg(value) AS mean FROM samples GROUP BY 1, 2) SELECT session, round(stddev_pop(mean), 6) AS scatter FROM m GROUP BY 1")
def cylinder_scatter(spark, sf):
    s = b.samples(spark, sf)
    wide = s.select("session", *(F.when(F.col("k") % 6 == i, F.col("value")).alias(f"lu{i}") for i in range(6)))
    return L.cylinder_scatter(wide, [f"lu{i}" for i in range(6)]).withColumn("scatter", F.round("scatter", 6))


@query("SELECT session, round(avg(CASE WHEN value >= 30 THEN 1.0 ELSE 0.0 END), 6) AS share FROM samples GROUP BY 1")
def saturation_share(spark, sf):
    return L.saturation_share(b.samples(spark, sf), F.col("value") >= 30).withColumn("share", F.round("share", 6))


@query(", m AS (SELECT kind, min(CASE WHEN NOT session > 500 THEN value END) AS low_before, min(CASE WHEN session > 500 THEN value END) AS low_after FROM samples GROUP BY 1) SELECT kind, low_before, low_after, round(1 - (10 - low_after) / nullif(10 - low_before, 0), 6) AS shrink, 1 - (10 - low_after) / nullif(10 - low_before, 0) >= 0.3 AS passed FROM m")
def before_after_gate(spark, sf):
    return L.before_after(b.samples(spark, sf), "kind", F.col("session") > 500, "value", 10.0).withColumn("shrink", F.round("shrink", 6))


@query("SELECT session, round((count(*) - 1) / nullif(max(ts) - min(ts), 0), 9) AS rate FROM samples GROUP BY 1")
def sample_rate(spark, sf):
    return L.sample_rate(b.samples(spark, sf)).select("session", F.round("rate", 9).alias("rate"))


@query("SELECT session, round(max(value / nullif(k, 0)), 6) AS used, max(value / nullif(k, 0)) <= 0.5 AS ok FROM samples GROUP BY 1")
def threshold_headroom(spark, sf):
    return L.threshold_headroom(b.samples(spark, sf), F.col("value"), F.col("k").cast("double")).withColumn("used", F.round("used", 6))


@query("SELECT seq, max(CASE WHEN value > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS flag FROM samples")
def countdown_flag(spark, sf):
    return L.countdown_flag(b.samples(spark, sf), F.col("value") > 30, 3).select("seq", "flag")


@query("SELECT seq, last_value(CASE WHEN kind = 'click' THEN value END IGNORE NULLS) OVER w AS click, last_value(CASE WHEN kind = 'view' THEN value END IGNORE NULLS) OVER w AS view FROM samples WINDOW w AS (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)")
def aligned_blocks(spark, sf):
    return L.aligned(b.samples(spark, sf).withColumn("signal", F.col("kind")), ["click", "view"]).select("seq", "click", "view")


def _int(spark, sf):
    return b.samples(spark, sf).withColumn("x", (F.col("value") * 100).cast("long"))


def _walk(step: str, first: str, columns: str = "") -> str:
    """SQL of a recursive filter: a row a time along each session. ``step`` sees r.y, the value before, and s, the sample."""
    return f""", s AS (SELECT session, seq, CAST(trunc(value * 100) AS BIGINT) AS x{columns}, k, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS i FROM samples),
r AS (SELECT session, i, seq, CAST({first} AS BIGINT) AS y FROM s WHERE i = 1 UNION ALL SELECT s.session, s.i, s.seq, CAST({step} AS BIGINT) FROM r JOIN s ON s.session = r.session AND s.i = r.i + 1) SELECT seq, y FROM r"""


_PT1 = "r.y + CASE WHEN {k} = 0 THEN s.x - r.y WHEN floor(({k} * (s.x - r.y) + 128) / 256.0) <> 0 THEN floor(({k} * (s.x - r.y) + 128) / 256.0) ELSE sign(s.x - r.y) END"


@query(_walk(_PT1.format(k=64), "x"))
def pt1_filter(spark, sf):
    return X.pt1_filter(_int(spark, sf), "x", 64).select("seq", "y")


@query(_walk("r.y + CASE WHEN abs(s.x - r.y) >= 8 THEN trunc((s.x - r.y) / 8.0) ELSE sign(s.x - r.y) END", "x"))
def iir_filter(spark, sf):
    return X.iir_filter(_int(spark, sf), "x", 8).select("seq", "y")


@query(_walk(_PT1.format(k="(CASE WHEN s.x > r.y THEN s.k + 1 ELSE 16 END)"), "x"))
def asymmetric_pt1(spark, sf):
    s = _int(spark, sf).withColumn("up", F.col("k") + 1).withColumn("down", F.lit(16).cast("long"))
    return X.asymmetric_pt1(s, "x", "up", "down").select("seq", "y")


_MORE = "CASE WHEN {s}.k % 5 = 0 OR {s}.x = 1000 THEN {y} ELSE greatest(-5000, least(5000, {y} + CASE WHEN floor(({s}.x - 1000) * 64 * ({s}.k % 5) / 65536.0) <> 0 THEN floor(({s}.x - 1000) * 64 * ({s}.k % 5) / 65536.0) ELSE sign({s}.x - 1000) END)) END"


@query(_walk(_MORE.format(s="s", y="r.y"), _MORE.format(s="s", y="0")))
def clamped_integral(spark, sf):
    s = _int(spark, sf).withColumn("error", F.col("x") - 1000).withColumn("gain", F.col("k") % 5)
    return X.clamped_integral(s, "error", "gain", -5000, 5000).select("seq", "y")


@query(_walk("r.y + greatest(-150, least(150, s.x - r.y))", "x"))
def rate_limited(spark, sf):
    return X.ramp(_int(spark, sf), "x", 150).select("seq", "y")


@query("SELECT kind AS log_set, round(sum((9 + k) * 1.14583), 4) AS wire_ms, count(*) AS blocks, round(1000 / nullif(sum((9 + k) * 1.14583), 0), 9) AS hz FROM samples GROUP BY 1")
def refresh_rates(spark, sf):
    blocks = b.samples(spark, sf).select(F.col("kind").alias("log_set"), F.col("k").alias("payload"))
    return L.refresh_rates(blocks).select("log_set", F.round("wire_ms", 4).alias("wire_ms"), "blocks", F.round("hz", 9).alias("hz"))


@query("SELECT session, CAST(floor(ts / 3600) AS BIGINT) AS ts, round(max(CASE WHEN kind = 'click' THEN value END) - max(CASE WHEN kind = 'view' THEN value END), 6) AS delta FROM samples WHERE kind IN ('click', 'view') GROUP BY 1, 2")
def channel_delta(spark, sf):
    s = b.samples(spark, sf).select("session", F.floor(F.col("ts") / 3600).alias("ts"), F.col("kind").alias("signal"), "value")
    return L.channel_delta(s, "click", "view").withColumn("delta", F.round("delta", 6))


@query(", r AS (SELECT session, regr_slope(value, ts - 1704067200) AS slope FROM samples WHERE value BETWEEN 3 AND 50 GROUP BY 1) SELECT round(avg(CASE WHEN session % 2 = 0 THEN slope END) * 1e6, 3) AS slope_before, count(CASE WHEN session % 2 = 0 THEN slope END) AS runs_before, round(avg(CASE WHEN session % 2 = 1 THEN slope END) * 1e6, 3) AS slope_after, count(CASE WHEN session % 2 = 1 THEN slope END) AS runs_after, round(avg(CASE WHEN session % 2 = 0 THEN slope END) / avg(CASE WHEN session % 2 = 1 THEN slope END), 4) AS ratio FROM r")
def inertia_ratio(spark, sf):
    runs = L.coastdown(b.samples(spark, sf).withColumn("ts", F.col("ts") - 1704067200), "session", "ts", "value", 3.0, 50.0)
    out = L.inertia_ratio(runs.where("session % 2 = 0"), runs.where("session % 2 = 1"))
    return out.select(*(F.round(F.col(c) * 1e6, 3).alias(c) for c in ("slope_before", "slope_after")), "runs_before", "runs_after", F.round("ratio", 4).alias("ratio"))


@query(", m AS (SELECT session, k % 6 AS c, avg(value) AS mean, avg(CASE WHEN kind = 'view' THEN value END) AS base FROM samples GROUP BY 1, 2) SELECT session, round(stddev_pop(mean), 6) AS scatter, round(stddev_pop(base), 6) AS base, round(stddev_pop(mean) - stddev_pop(base), 6) AS more FROM m GROUP BY 1 HAVING count(base) > 0")
def scatter_against_baseline(spark, sf):
    s = b.samples(spark, sf)
    wide = lambda s: L.cylinder_scatter(s.select("session", *(F.when(F.col("k") % 6 == i, F.col("value")).alias(f"lu{i}") for i in range(6))), [f"lu{i}" for i in range(6)])
    out = L.scatter_against(wide(s), wide(s.where("kind = 'view'")))
    return out.select("session", *(F.round(c, 6).alias(c) for c in ("scatter", "base", "more")))


def _stream(spark, sf):
    e = b.t(spark, sf, "events")
    return e.select(F.col("user_id").alias("session"), "ts", F.col("event_type").alias("signal"), "value")


@query("SELECT time_bucket(INTERVAL 60 SECOND, ts) AS start, user_id AS session, event_type AS signal, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2, 3")
def windowed_means(spark, sf):
    return live.windowed_means(_stream(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("SELECT start, session, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n FROM (SELECT user_id AS session, value, time_bucket(INTERVAL 2 SECOND, ts) - to_seconds(2 * unnest([0, 1, 2, 3, 4])) AS start FROM events) GROUP BY 1, 2")
def sliding_saturation(spark, sf):
    return live.saturation(_stream(spark, sf), F.col("value") > 20).withColumn("share", F.round("share", 6))


@query(", g AS (SELECT user_id AS session, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY session, run")
def session_runs(spark, sf):
    return live.log_runs(_stream(spark, sf), "30 minutes")


@query("SELECT a.user_id AS session, a.ts AS ts_a, a.value AS a, z.ts AS ts_b, z.value AS b FROM events a JOIN events z ON a.user_id = z.user_id AND a.event_type = 'click' AND z.event_type = 'view' AND z.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE")
def interval_join(spark, sf):
    s = _stream(spark, sf)
    return live.aligned(s.where("signal = 'click'"), s.where("signal = 'view'"), "10 minutes").select("session", "ts_a", "a", "ts_b", "b")


@query("SELECT DISTINCT ON (user_id, time_bucket(INTERVAL 1 HOUR, ts), event_type) user_id AS session, time_bucket(INTERVAL 1 HOUR, ts) AS ts, event_type AS signal FROM events")
def without_repeats(spark, sf):
    s = _stream(spark, sf).withColumn("ts", F.window("ts", "1 hour")["start"])
    return live.without_repeats(s).select("session", "ts", "signal")
