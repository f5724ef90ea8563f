from calgraph.operators import decode as D
from calgraph.plans import value_queries as Q


def test_outliers_are_held_against_the_exact_median(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 100.0), ("b", 5.0), ("b", 5.0), ("b", 7.6), ("c", -4.0), ("c", -4.0), ("c", -1.9)]
    got = {(r.g, r.v, r.typical) for r in D.axis_outliers(spark.createDataFrame(rows, "g string, v double"), "g", "v", 0.5).collect()}
    assert got == {("a", 1.0, 3.0), ("a", 100.0, 3.0), ("b", 7.6, 5.0), ("c", -1.9, -4.0)}


def test_query_returns_the_points(spark):
    rows = Q.QUERIES["axis_outliers"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(abs(r.v - r.typical) > 0.5 * abs(r.typical) for r in rows)
