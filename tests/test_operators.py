import random

import numpy as np
from pyspark.sql import functions as F

from calgraph.operators import decode as D
from calgraph.operators import filters as X
from calgraph.operators import graph as G
from calgraph.operators import relations as R
from calgraph.sources import io
from calgraph.streaming import live

EDGES = [("f:a", "p:1", "read", "xref"), ("f:a", "r:x", "write", "xref"), ("f:b", "r:x", "read", "xref"), ("f:b", "p:2", "read", "scan"), ("f:b", "r:y", "write", "xref"), ("f:a", "f:b", "call", "xref"), ("f:a", "p:1", "read", "xref"), ("f:a", "f:a", "call", "xref"), ("f:a", "zz", "read", "xref"), ("d:1", "p:1", "documents", "fr"), ("p:1", "d:1", "documented", "fr")]
NODES = [("f:a", "func"), ("f:b", "func"), ("p:1", "param"), ("p:2", "param"), ("r:x", "ram"), ("r:y", "ram"), ("d:1", "frpage")]


def graph(spark):
    nodes = spark.createDataFrame(NODES, "id string, t string").withColumn("bank", F.lit("master")).withColumn("name", F.col("id"))
    return nodes, R.dedup_edges(spark.createDataFrame(EDGES, "s string, d string, k string, o string"), nodes)


def test_edges_are_unique_and_closed(spark):
    _, e = graph(spark)
    assert e.count() == 8


def test_directions_as_coded_and_by_data_flow(spark):
    _, e = graph(spark)
    down = {(r.parent, r.next) for r in G.adjacency(e, "downstream").collect()}
    assert ("f:a", "p:1") in down and ("p:1", "f:a") in down and ("f:a", "r:x") not in down and ("r:x", "f:b") in down
    flow = {(r.parent, r.next) for r in G.adjacency(e, "downstream", rule="dataflow").collect()}
    assert ("f:a", "r:x") in flow and ("f:a", "p:1") not in flow and ("r:x", "f:b") in flow


def plain_tree(steps, root, depth, most):
    rank = {"xref": 0, "scan": 1, "fr": 2}
    best = {}
    for p, n, o in steps:
        best[p, n] = min(best.get((p, n), 9), rank[o])
    out, seen, level = [(0, None, root, False)], {root}, [root]
    for d in range(1, depth + 1):
        new = []
        for p in level:
            for _, n in sorted((r, n) for (q, n), r in best.items() if q == p)[:most]:
                out.append((d, p, n, n in seen))
                if n not in seen:
                    seen.add(n)
                    new.append(n)
        level = new
    return sorted(out, key=repr)


def test_expand_equals_a_plain_walk(spark):
    rng = random.Random(3)
    steps = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice(["xref", "scan", "fr"])) for _ in range(60)]
    df = spark.createDataFrame(steps, "parent string, next string, o string")
    got = sorted(((r.level, r.parent, r.node, r.repeated) for r in G.expand(df, "n0", 3, 3).collect()), key=repr)
    assert got == plain_tree(steps, "n0", 3, 3)


def test_filters_equal_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(int(s), float(t), int(t), int(x)) for s in range(3) for t, x in enumerate(rng.integers(-300, 300, 40))]
    df = spark.createDataFrame(rows, "session long, ts double, seq long, x long").repartition(5)
    for run, step in ((lambda d: X.pt1_filter(d, "x", 64), lambda y, x: X.pt1(y, x, 64)), (lambda d: X.iir_filter(d, "x", 8), lambda y, x: X.iir(y, x, 8)), (lambda d: X.ramp(d, "x", 20), lambda y, x: X.rate_limited(y, x, 20))):
        got = {(r.session, r.seq): r.y for r in run(df).collect()}
        for s in range(3):
            y = None
            for _, _, t, x in (r for r in rows if r[0] == s):
                y = step(y, x)
                assert got[s, t] == y


def test_filters_take_nulls_and_many_batches(spark):
    rows = [(1, float(t), t, None if t % 7 == 0 else t * 3) for t in range(30_000)] + [(2, 0.0, 0, None), (2, 1.0, 1, 5)]
    got = {(r.session, r.seq): r.y for r in X.pt1_filter(spark.createDataFrame(rows, "session long, ts double, seq long, x long"), "x", 64).collect()}
    y = None
    for _, _, t, x in rows[:30_000]:
        y = y if x is None else X.pt1(y, x, 64)
        assert got[1, t] == y
    assert got[2, 0] is None and got[2, 1] == 5


def test_pt1_moves_at_least_one_step_and_zero_passes():
    assert X.pt1(10, 11, 1) == 11 and X.pt1(10, 9, 1) == 9 and X.pt1(10, 500, 0) == 500 and X.pt1(5, 5, 9) == 5


def test_stream_of_a_filter_equals_its_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(s), f"2024-01-01 00:00:{t:02d}", t, int(x)) for s in range(3) for t, x in enumerate(rng.integers(0, 500, 30))]
    df = spark.createDataFrame(rows, "session long, t string, seq long, x long").select("session", F.to_timestamp("t").alias("ts"), "seq", "x")
    for part in range(2):
        df.where(F.col("seq").between(part * 15, part * 15 + 14)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # Rows come out once the watermark has passed them; a last row moves it past all others.
    df.where("session = 0 and seq = 0").withColumn("session", F.lit(9).cast("long")).withColumn("ts", F.col("ts") + F.expr("interval 1 hour")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.filtered(stream, ["x"], lambda y, x: X.pt1(y, x, 64)).writeStream.format("memory").queryName("pt1_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {(r.session, r.seq): r.y for r in spark.table("pt1_out").where("session < 9").collect()}
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {(r.session, r.seq): r.y for r in X.pt1_filter(df.withColumn("ts", F.col("ts").cast("double")), "x", 64).collect()}
    assert got == want


def test_images_decode_and_bounds(spark):
    content = bytes(range(64)) + (-5).to_bytes(2, "big", signed=True)
    images = spark.createDataFrame([("a", bytearray(content)), ("short", bytearray(b"\x01"))], "image string, content binary")
    items = spark.createDataFrame([("u8", 3, 8, False, 1, 2, 0), ("s16", 64, 16, True, 1, 1, 0), ("none", None, 8, False, 1, 1, 0), ("step", 0, 8, False, 1, 3, 16)], D.ITEM)
    got = {(r.image, r.uid, r.col): (r.raw, r.error) for r in D.decode_items(images, items).collect()}
    assert got["a", "u8", 0] == (3, None) and got["a", "u8", 1] == (4, None) and got["a", "s16", 0] == (-5, None)
    assert got["a", "step", 2] == (4, None)
    assert got["a", "none", 0][1] and got["short", "s16", 0][1]


def test_definitions_export_and_listings(spark, tmp_path):
    (tmp_path / "d.xdf").write_text("""<XDF><XDFHEADER><deftitle>t</deftitle><CATEGORY index="0xA" name="Zuendung (Ignition)"/><CATEGORY index="0xB" name="Last"/></XDFHEADER><XDFCONSTANT uniqueid="0x1"><title>K_A</title><EMBEDDEDDATA mmedaddress="0xBE8" mmedelementsizebits="8"/><MATH equation="x*0.5"/><CATEGORYMEM index="0" category="11"/></XDFCONSTANT>
<XDFTABLE uniqueid="0x2"><title>KF_B</title><XDFAXIS id="x"><units>rpm</units></XDFAXIS><XDFAXIS id="z"><units>%</units></XDFAXIS></XDFTABLE>
<XDFTABLE uniqueid="0x3"><title>KF_C</title><XDFAXIS id="x"><EMBEDDEDDATA mmedaddress="0x10" mmedelementsizebits="16"/></XDFAXIS><XDFAXIS id="z"><EMBEDDEDDATA mmedaddress="0x40" mmedelementsizebits="16"/></XDFAXIS></XDFTABLE></XDF>""")
    got = {r.uid: r for r in io.read_definitions(spark, str(tmp_path / "d.xdf")).collect()}
    assert got["0x3"].address == 0x10 and got["0x3"].data_address == 0x40 and got["0x3"].name == "KF_C" and got["0x1"].data_address == 0xBE8
    c = {r.id: (r.de, r.en) for r in io.read_categories(spark, str(tmp_path / "d.xdf")).collect()}
    assert c == {10: ("Zuendung", "Ignition"), 11: ("Last", "Last")}
    assert got["0x1"].address == 0xBE8 and got["0x1"].category_ids == [10] and got["0x1"].kind == "constant" and len(got["0x2"].axes) == 2
    (tmp_path / "e.json").write_text('{"functions": [{"addr": 1, "name": "f", "named": true}], "refs": [{"s": 1, "d": 2, "k": "read", "o": "xref"}]}')
    e = io.read_export(spark, str(tmp_path / "e.json"), "master")
    assert e["functions"].count() == 1 and e["refs"].first().k == "read" and e["symbols"].count() == 0
    (tmp_path / "master").mkdir()
    (tmp_path / "master" / "0218d0.txt").write_text("a\nb")
    assert io.read_listings(spark, str(tmp_path / "master" / "*.txt")).first().asDict() == {"bank": "master", "addr": 0x218D0, "code": "a\nb"}
    assert io.read_translations(spark, str(tmp_path / "missing.json")).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    nodes, e = graph(spark)
    one = sorted(map(tuple, R.coverage(nodes.repartition(1), e.repartition(1)).collect()))
    assert one == sorted(map(tuple, R.coverage(nodes.repartition(17), e.repartition(17)).collect()))
