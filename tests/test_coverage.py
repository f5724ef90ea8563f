from calgraph.operators import relations as R
from calgraph.sources import io


def test_figures_of_a_small_graph(spark, tmp_path):
    rows = [("p1", "param", None, None), ("p2", "param", None, None), ("p3", "param", None, None), ("f1", "func", True, None), ("f2", "func", None, None), ("r1", "ram", None, None), ("d1", "frpage", None, True), ("d2", "frpage", None, False), ("u1", "unknown", None, None)]
    nodes = spark.createDataFrame(rows, "id string, t string, named boolean, dense boolean")
    edges = spark.createDataFrame([("f1", "p1", "xref"), ("f2", "p1", "scan"), ("f1", "r1", "xref"), ("p2", "d1", "fr"), ("d1", "p2", "fr"), ("p1", "p1", "other")], "s string, d string, o string")
    statements = spark.createDataFrame([("f1", ["a", "b"]), ("f1", None), ("f2", [])], "block string, interp array<string>")
    resolved = spark.createDataFrame([(1, "p1"), (2, None), (2, None), (3, None)], "addr int, d string")
    matches = spark.createDataFrame([(2,), (None,)], "matches long")
    got = {r.metric: r.value for r in R.coverage_figures(nodes, edges, statements, resolved, matches).collect()}
    assert got == {
        "functions": 2, "named_functions": 1, "ram_symbols": 1, "pages": 2, "dense_pages": 1, "names_only_in_documents": 1, "params": 3, "params_referenced": 1, "params_documented": 1, "params_referenced_pct": 33.3, "params_documented_pct": 33.3,
        "blocks_with_formulas": 2, "lookups_found": 2, "unresolved": 2, "signals_matching_ram": 2,
    }
    empty = {r.metric: r.value for r in R.coverage_figures(*(x.limit(0) for x in (nodes, edges, statements, resolved, matches))).collect()}
    assert empty.pop("params_referenced_pct") is None and empty.pop("params_documented_pct") is None and set(empty.values()) == {0.0}
    io.write_graph(nodes, edges, str(tmp_path), names=nodes.select("id"))
    assert spark.read.parquet(f"{tmp_path}/names").count() == 9 and spark.read.parquet(f"{tmp_path}/edges").count() == 6


def test_pages_of_a_node_in_order(spark):
    edges = spark.createDataFrame([("p1", "d2", "fr"), ("p1", "d1", "fr"), ("p1", "d1", "fr"), ("p1", "d3", "fr"), ("p1", "f1", "fr"), ("p1", "d4", "xref")], "s string, d string, o string")
    pages = spark.createDataFrame([("d1", "2.1", 9), ("d2", "2.1", 3), ("d3", "1.9", 40), ("d4", "1", 1)], "id string, section string, page int")
    docs = spark.createDataFrame([("2.1", "Zündung"), ("2.1", "Zuendung")], "section string, title string")
    got = [(r.id, r.title, r.place) for r in R.page_links(edges, pages, docs).orderBy("place").collect()]
    assert got == [("d3", None, 1), ("d2", "Zuendung", 2), ("d1", "Zuendung", 3)]
