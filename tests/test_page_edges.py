from calgraph.plans import base as b



def test_every_order_line_gives_its_two_page_edges(spark, tmp_path):
    rows = [(7, 100 + n, 5, n, "N", "O") for n in range(1, 8)] + [(8, 100, 5, 7, "R", "F")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.s, r.d, r.k) for r in b.edges(spark, str(tmp_path)).where("o = 'fr'").select(b.shown("s").alias("s"), b.shown("d").alias("d"), "k").collect()}
    pairs = {(f"d:{o:06x}", f"p:{p:05x}") for o, p, *_ in rows}
    assert got == {(d, p, "documents") for d, p in pairs} | {(p, d, "documented") for d, p in pairs}
