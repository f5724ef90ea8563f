"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of ``edges(a, b)``; label is the smallest id of its component.

    Each round points all larger neighbours of a vertex at its smallest neighbour, then all smaller
    ones, so the edges end as one star per component. The smallest neighbour comes from an aggregate
    with map-side combine, so a hub costs one row per task; no component is gathered anywhere.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = small(written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = written(large)
        least = small(written(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")))
        joined = large.join(least, large.a == least.u)
        now = written(joined.select("a", F.col("m").alias("b")).unionByName(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a != b").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    stars = now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "id")
    return written(stars.unionByName(stars.select(F.col("label").alias("id"), "label").distinct()))
