import math
from collections import Counter

import numpy as np
import pytest
from compare import assert_same, database
from pyspark.sql import functions as F

from calgraph.llm import hard_negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, step=5, positives=5, negatives=3):
    rows = [(k, i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for k, (i, v, y) in enumerate(rows) if None not in (i, v, y) and all(x is not None and math.isfinite(x) and abs(x) < N.MOST for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for k, i, y, v in rows:
        if i % step:
            continue
        s = sorted(((-dot(v, w), j, z) for m, j, z, w in rows if m != k), key=lambda x: x[:2])
        for ps, pid, _ in [x for x in s if x[2] == y][:positives]:
            fit = [x for x in s if x[2] != y and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:negatives]
            out.update((i, pid, r, nid, -ps, -ns) for r, (ns, nid, _) in enumerate(fit, 1))
    return out


def mined(df, step=5):
    return Counter(tuple(r) for r in N.hard_negatives(df, F.col("vec_id") % step == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hilbert_curve_is_one_path():
    for dims, bits in ((2, 3), (3, 2), (1, 4)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        key = N.hilbert(cells, bits)
        path = cells[np.argsort(key)]
        assert sorted(key.tolist()) == list(range(len(cells))) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def clustered(n, dims=8, labels=6, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, dims))
    y = rng.integers(0, labels, n)
    v = centre[y] + 0.4 * rng.normal(size=(n, dims))
    return [(i, [float(np.float32(x)) for x in r], int(k)) for i, (r, k) in enumerate(zip(v, y, strict=True))]


@pytest.fixture
def little(monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "GROUP", 12)
    monkeypatch.setattr(N, "PAGE", 4)


def test_against_plain(spark, little):
    rows = clustered(400)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_odd_rows(spark, little):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 2.0], 1), (500, None, 1), (505, [1.0, None], 1), (510, [nan, 1.0], 1), (515, [1.0, -inf], 1), (520, [1.0, 2.0], None), (525, [5000.0, 1.0], 1), (530, [], 1), (535, [0.5] * 11, 2), (540, [0.5], 2), (545, [-0.5], 9)]
    base = clustered(120, labels=3)
    rows = base + base[:30] + [(1000 + i, v, y) for i, v, y in base[:40]] + odd
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit(1) for c in ("id", "row", "anchor", "v", "block", "k", "g", "score", "rank")})
    assert mined(df) == plain(rows)
    assert not mined(spark.createDataFrame([], SCHEMA)) and not mined(spark.createDataFrame(odd[:6], SCHEMA)) and not mined(spark.createDataFrame([(0, [], 1), (1, [], 2)], SCHEMA)) - plain([(0, [], 1), (1, [], 2)])


def test_one_hot_label_and_ties(spark, little):
    rows = [(i, [1.0, 0.5], 1) for i in range(150)] + [(200 + i, [0.5 + i % 3 / 10, 0.5], 2 + i % 2) for i in range(60)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_bounds_spare_most_blocks_of_clusters(spark, little):
    """On vectors with structure the zone maps rule out most pairs of an anchor and a block, and no result is lost."""
    rng = np.random.default_rng(1)
    rows = []
    for c in range(40):
        centre = np.zeros(16)
        centre[[c % 16, (c * 7 + 3) % 16]] = 3
        rows += [(c * 40 + i, (centre + 0.05 * rng.normal(size=16)).astype(np.float32).tolist(), c % 20 * 2 + i % 2) for i in range(40)]
    seen = []
    read = N.read

    def counted(pairs, *args):
        seen.append(pairs.select(F.sum(F.length("need") / 4)).first()[0])
        return read(pairs, *args)

    N.read = counted
    try:
        assert mined(spark.createDataFrame(rows, SCHEMA), 10) == plain(rows, 10)
    finally:
        N.read = read
    anchors, blocks = len(rows) / 10, len(rows) / 16
    assert seen[0] < 0.1 * anchors * blocks and seen[2] < 0.35 * anchors * blocks


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(N.op12_hard_negatives(spark, sf), N.ORACLE, database(sf))
