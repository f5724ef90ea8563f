"""Forms of the walks, lookups and comparisons that hold at size: bitmaps, levels, digests, indices, classes."""

import random

from pyspark.sql import functions as F

from calgraph.operators import decode as D
from calgraph.operators import graph as G
from calgraph.operators import relations as R


def walked(steps, root, depth):
    seen, frontier = {root: 0}, {root}
    for d in range(1, depth + 1):
        frontier = {n for p, n in steps if p in frontier} - seen.keys()
        seen.update(dict.fromkeys(frontier, d))
    return {(root, n, d) for n, d in seen.items()}


def test_reachable_with_more_roots_than_a_word_has_bits(spark):
    rng = random.Random(5)
    steps = {(rng.randrange(150), rng.randrange(150)) for _ in range(220)}
    roots = [*range(0, 140), 3, 3, 999]
    got = G.reachable(spark.createDataFrame(list(steps), "parent long, next long"), spark.createDataFrame([(r,) for r in [*roots, None]], "id long"), 4).collect()
    want = set().union(*(walked(steps, r, 4) for r in roots))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_reachable_of_nothing(spark):
    steps = spark.createDataFrame([], "parent long, next long")
    assert G.reachable(steps, spark.createDataFrame([], "id long"), 3).count() == 0
    assert [tuple(r) for r in G.reachable(steps, spark.createDataFrame([(7,)], "id long"), 3).collect()] == [(7, 7, 0)]


def test_owner_of_long_and_overlapping_ranges(spark):
    rng = random.Random(9)
    ranges = [(0, 0, 1 << 40, 1), (0, 100, 1, 2), (0, 100, 50, 3), (1, -300, 600, 4), (0, 7, 0, 5), (0, None, 9, 6), (0, 5, None, 7), (0, (1 << 40) - 8, 16, 8)]
    ranges += [(0, rng.randrange(4000), rng.choice([1, 2, 15, 16, 17, 255, 256, 257, 3000]), 100 + i) for i in range(60)]
    points = [(0, a) for a in (0, 99, 100, 101, 149, 150, (1 << 40) - 1, 1 << 40, -1, None)] + [(1, a) for a in (-301, -300, 299, 300)] + [(2, 100)] + [(0, rng.randrange(5000)) for _ in range(200)]
    points = list(dict.fromkeys(points))
    r = spark.createDataFrame(ranges, "bank int, start long, size long, func int")
    got = sorted((x.bank, x.addr, x.func) for x in R.owner_of(spark.createDataFrame(points, "bank int, addr long"), r).collect())
    want = [(b, a, f) for b, a in points for rb, s, n, f in ranges if None not in (a, s, n) and n > 0 and b == rb and s <= a < s + n]
    assert got == sorted(want)
    assert R.owner_of(spark.createDataFrame(points, "bank int, addr long"), r.where("func < 0")).count() == 0


def test_rank_of_the_sketched_ratio(spark):
    rng = random.Random(2)
    rows = [("a", 6.0, 200 + rng.random() * 300) for _ in range(20_000)] + [("b", 6.0, 100.0), ("b", 6.0, 100.0), ("b", 6.0, 400.0), ("c", 0.0, 5.0), ("c", None, 5.0)]
    points = spark.createDataFrame(rows, "item string, r double, angle double").repartition(8)
    exact = {r.item: r.typical for r in D.ratio_outliers(points, "item", "r", "angle", 2.5, 0.2).select("item", "typical").distinct().collect()}
    sketched = {r.item: r.typical for r in D.ratio_outliers(points, "item", "r", "angle", 2.5, 0.2, sketch=200).select("item", "typical").distinct().collect()}
    assert set(exact) == {"a", "b"} and exact["b"] == sketched["b"]
    ratios = sorted(x.ratio for x in D.ratio_outliers(points.where("item = 'a'"), "item", "r", "angle", 2.5, -1).select("ratio").collect())
    assert len(ratios) == 20_000 and abs(sum(x < sketched["a"] for x in ratios) / len(ratios) - 0.5) < 2.3 / 200


def test_changed_blocks_bring_only_what_differs(spark):
    a = [("x", bytes(100)), ("y", b"ab" * 40), ("gone", b"1234"), ("none", None), ("empty", b"")]
    b = [("x", bytes(50) + b"\1" + bytes(49)), ("y", b"ab" * 40 + b"c"), ("new", b"\0\5\0"), ("none", None), ("empty", b"")]
    frame = lambda rows: spark.createDataFrame(rows, "image string, content binary")
    blocks = D.changed_blocks(frame(a), frame(b), 16)
    assert {(r.image, r.blk) for r in blocks.collect()} == {("x", 3), ("y", 5), ("gone", 0), ("new", 0)}
    got = {tuple(r) for r in D.changed_words(blocks, 16).collect()}
    assert got == {("x", 50, 0, 256), ("gone", 0, 0x3132, None), ("gone", 2, 0x3334, None), ("new", 0, None, 5)}


def test_search_of_many_equals_search_of_each(spark):
    rows = [("p1", "param", "KF_TZ_GRUND", "Zündung"), ("p2", "param", "KF_TZ", None), ("f1", "func", "tz_calc", "kf_tz user"), ("r1", "ram", None, "tz word"), ("d1", "frpage", "tz", "tz"), ("r2", "ram", "B_LL", "a tz")]
    nodes = spark.createDataFrame(rows, "id string, t string, name string, description string")
    asked = ["tz", " KF_TZ ", "kf_tz", "z", "", None, "\t", "grund", "nothing", "tz word", "zündung"]
    got = G.search_many(nodes, spark.createDataFrame([(q,) for q in asked], "query string")).collect()
    found = {}
    for r in sorted(got, key=lambda r: r.pos):
        found.setdefault(r.query, []).append((r.id, r["class"]))
    for q in {x.strip().lower() for x in asked if x is not None}:
        assert found.get(q, []) == [(r.id, r["class"]) for r in G.search(nodes, q).collect()], q


def test_equal_names_are_one_class(spark):
    items = spark.createDataFrame([(i, "KF_TZ" if i % 2 else "KFTZ", 0) for i in range(3000)] + [(5000, "KF_TX", 0), (5001, "KF_TX", 1)], "id long, name string, block int")
    got = [tuple(r) for r in R.confusable_classes(items, "block").select("class1", "class2", "edits", "members1", "members2").collect()]
    assert got == [(0, 5000, 1, 3000, 1)]
    assert {(r["class"], r.members) for r in R.name_classes(items, "block").collect()} == {(0, 3000), (5000, 1), (5001, 1)}


def test_collisions_are_classes_of_an_image(spark):
    items = spark.createDataFrame([(1, 0, 16, "i"), (2, 1, 16, "i"), (3, 1, 16, "j"), (4, 0, 20, "i"), (5, 0, 20, "i")], "id long, bank int, addr long, image string")
    assert [(r.image, r["class"], r.members, r.banks) for r in R.collision_classes(items, "image").collect()] == [("i", 1, 2, [0, 1])]


def partitions(spark, make):
    """Rows in each partition where nothing is broadcast."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return rows(make())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def rows(df):
    return [x[0] for x in df.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]


def test_one_address_is_dealt_over_tasks(spark):
    """Banks 0 to 2 of one address and an item without a bank; a task has some of the pairs and none of equal banks is made."""
    items = spark.range(1501).select("id", F.when(F.col("id") < 1500, F.col("id") % 3).alias("bank"), (F.col("id") * 32768 + 16).alias("addr"))
    got = partitions(spark, lambda: R.address_collisions(items, each=100))
    assert sum(got) == 3 * 500 * 500 and len(got) > 1 and max(got) < sum(got) * 0.6
    out = R.address_collisions(items, each=100)
    assert out.distinct().count() == sum(got) and out.where("bank1 >= bank2 or id1 % 3 != bank1 or id2 % 3 != bank2").isEmpty()


def test_one_name_is_dealt_over_tasks(spark):
    items = spark.range(1200).select("id", F.when(F.col("id") < 1000, "KF_TZ").when(F.col("id") < 1199, "KFTX").alias("name"), (F.col("id") * 2).alias("addr"), F.lit(0).alias("block"))
    got = partitions(spark, lambda: R.confusable_names(items, "block", each=100))
    assert sum(got) == 1000 * 999 // 2 + 199 * 198 // 2 + 1000 * 199 and len(got) > 1 and max(got) < sum(got) * 0.6
    out = R.confusable_names(items, "block", each=100)
    assert out._jdf.queryExecution().sparkPlan().toString().lstrip().startswith("Project"), "pairs are brought together again"
    assert out.select("id1", "id2").distinct().count() == sum(got)
    assert out.where("id1 >= id2 or gap != (id2 - id1) * 2 or edits != case when id1 < 1000 and id2 >= 1000 then 1 else 0 end").isEmpty()


def test_pairs_of_a_repeated_id_count_once(spark):
    items = spark.createDataFrame([(1, "AB", 0, 0), (1, "ABCD", 9, 0), (2, "ABC", 4, 0), (2, "AB", 4, 0), (3, "ZZZZZ", 1, 0), (3, None, 1, 0), (None, "AB", 2, 0)], "id long, name string, addr long, block int")
    assert [tuple(r) for r in R.confusable_names(items, "block").collect()] == [(1, 2, 0, 4)]
