"""The composed filters against the loop, whatever the segments."""

import random

import pytest
from pyspark.sql import functions as F

from calgraph.operators import filters as X

SCHEMA = "session long, ts double, seq long, x long, g long"


def rows():
    rng = random.Random(9)
    out = []
    for session, n in ((1, 400), (2, 1), (3, 90), (None, 60), (5, 40)):
        for i in range(n):
            x = None if rng.random() < 0.1 or (session == 3 and i < 25) or session == 5 else rng.randrange(-3000, 3000)
            out.append((session, float(i // 2), i, x, None if rng.random() < 0.05 else rng.randrange(0, 40)))
    return out


def loop(data, columns, step):
    last, out = {}, {}
    for r in sorted(data, key=lambda r: (str(r[0]), r[1], r[2])):
        y, row = last.get(r[0]), [r[c] for c in columns]
        if None not in row:
            y = last[r[0]] = step(y, *row)
        out[r[0], r[2]] = y
    return out


@pytest.mark.parametrize("each", [1, 3, 17, 10_000])
def test_composed_filters_equal_the_loop(spark, each):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumn("k", F.lit(1)).orderBy(F.rand(3))
    got = {(r.session, r.seq): r.y for r in X.clamped_integral(df, "x", "g", -500, 800, each=each).collect()}
    assert got == loop(data, [3, 4], lambda y, e, g: X.integral(y, e, g, -500, 800))


def test_one_long_session_is_many_tasks(spark):
    df = spark.range(40_000).selectExpr("7L AS session", "cast(id AS double) AS ts", "id AS seq", "(id * 7919) % 2000 - 990 AS x", "id % 30 AS g")
    out = X.clamped_integral(df, "x", "g", -900, 900)
    want = loop([(7, float(i), i, i * 7919 % 2000 - 990, i % 30) for i in range(40_000)], [3, 4], lambda y, e, g: X.integral(y, e, g, -900, 900))
    assert {(7, r.seq): r.y for r in out.collect()} == want and len(set(want.values())) > 500
    empty = X.clamped_integral(df.where("seq < 0"), "x", "g", -5, 5)
    assert empty.count() == 0 and empty.columns == ["session", "ts", "seq", "x", "g", "y"]
