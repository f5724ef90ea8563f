"""Neighbours of blocks from lists of readers, against those of the chain."""

import random

from calgraph.operators import graph as G
from calgraph.plans import relation_queries as Q


def linked(spark):
    """Links of few blocks to many signals and of many to few; some blocks read what they write, some signals have no reader."""
    rng = random.Random(4)
    rows = {(rng.choice([1, rng.randrange(60)]), f"S{rng.choice([0, rng.randrange(40)])}", rng.choice(["read", "write"])) for _ in range(600)} | {(7, "OWN", "read"), (7, "OWN", "write"), (8, "UNREAD", "write"), (99, "S0", "write")}
    return spark.createDataFrame(sorted(rows), "block long, signal string, dir string")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_neighbours_without_the_chain(spark):
    links = linked(spark)
    want = G.block_neighbours(G.signal_chain(links), None, "signal")
    same(G.neighbours(links), want)
    same(G.neighbours(links, each=3, most=20), want)


def test_best_neighbours_without_pairs(spark):
    links = linked(spark)
    pairs = G.block_neighbours(G.signal_chain(links), None, "signal")
    scores = spark.range(0, 60, 2).selectExpr("id AS block", "id % 5 AS score")
    want = G.top_neighbours(pairs, scores, 5).selectExpr("block", "next", "score", "pos", "hidden")
    for sizes in ({}, {"each": 3, "most": 20}):
        same(G.best_neighbours(links, scores, 5, **sizes).selectExpr("block", "next", "score", "pos", "greatest(n - 5, 0) AS hidden"), want)
    root = min(r.block for r in pairs.collect())
    same(G.expand_linked(links, scores, 3, 4), G.expand_blocks(pairs, scores, root, 3, 4))


def test_no_pairs_are_exchanged(spark):
    plan = Q.QUERIES["block_neighbours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, found, _ = plan.partition("Generate explode(held")
    assert found and "Exchange" not in above
