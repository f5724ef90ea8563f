"""Signals between blocks, and ports, on small graphs."""

from calgraph.operators import graph as G

STATEMENTS = "block string, ord int, out string, expr string, reads array<string>, calls array<string>"


def graph(spark, statements, edges):
    nodes = [("f1", "func", "F_one", None), ("f2", "func", "F_two", None), ("f3", "func", "F_three", None), ("p1", "param", "KF_X", "map"), ("r1", "ram", "n_mot", None), ("r2", "ram", "TMOT", None), ("d1", "frpage", "page", None)]
    nodes = spark.createDataFrame(nodes, "id string, t string, name string, kind string")
    index = nodes.selectExpr("name", "id AS node")
    return spark.createDataFrame(statements, STATEMENTS), nodes.where("t = 'func'").select("id"), spark.createDataFrame(edges, "s string, d string, k string, o string"), nodes, index


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_links_of_functions_without_statements_are_ram_names(spark):
    g = graph(spark, [], [("f1", "r1", "write", "xref"), ("f2", "r1", "read", "scan"), ("f2", "p1", "read", "xref"), ("f3", "r1", "read", "fr"), ("f3", "f1", "call", "xref")])
    links = G.signal_links(*g)
    assert rows(links, "block", "signal", "dir") == [("f1", "n_mot", "write"), ("f2", "n_mot", "read")]
    assert rows(G.signal_chain(links), "src", "signal", "dst") == [("f1", "n_mot", "f2")]


def test_only_signals_link_blocks(spark):
    said = [("f1", 0, "KF_X", "1", [], []), ("f1", 1, "odd_name", "1", [], []), ("f1", 2, "TMOT[3]", "KF_X", ["KF_X", "kfs_wint", "12", "NEW_SIG"], []), ("f2", 0, "NEW_SIG", "TMOT", ["TMOT", "odd_name", "KF_X", "NEW_SIG"], [])]
    g = graph(spark, said, [("f1", "r1", "write", "xref"), ("f3", "r2", "read", "xref"), ("f3", "r2", "write", "xref")])
    links = G.signal_links(*g)
    assert rows(links, "block", "signal", "dir") == [("f1", "NEW_SIG", "read"), ("f1", "TMOT", "write"), ("f2", "NEW_SIG", "read"), ("f2", "NEW_SIG", "write"), ("f2", "TMOT", "read"), ("f3", "TMOT", "read"), ("f3", "TMOT", "write")]
    assert rows(G.signal_chain(links), "src", "signal", "dst") == [("f1", "TMOT", "f2"), ("f1", "TMOT", "f3"), ("f2", "NEW_SIG", "f1"), ("f3", "TMOT", "f2")]
    assert rows(G.signal_classes(links), "signal", "writers", "readers", "pairs") == [("NEW_SIG", 1, 2, 1), ("TMOT", 2, 2, 3)]
    assert rows(G.signal_chain(links, most=1), "src", "signal", "dst") == [("f2", "NEW_SIG", "f1")]


def test_a_hub_signal_is_dealt_over_sub_keys(spark):
    n = 1000
    links = spark.range(n).selectExpr("concat('w', id) AS block", "'HUB' AS signal", "'write' AS dir").union(spark.range(n).selectExpr("concat('r', id)", "'HUB'", "'read'"))
    chain = G.signal_chain(links, each=10_000)
    assert chain.count() == n * n and chain.distinct().count() == n * n
    assert G.signal_classes(links).first()["pairs"] == n * n


def test_ports(spark):
    said = [("f1", 1, "out_a", "{TMOT | n_mot} + KF_X", ["TMOT", "KF_X", "kfs_wint"], ["F_two", "no_block", "memcpy"]), ("f1", 0, "out_a", "n_mot", ["n_mot"], ["TMOT"]), ("f1", 2, "kfs_wint", "TMOT", ["TMOT"], [])]
    edges = [("f1", "r1", "read", "xref"), ("f2", "r1", "write", "scan"), ("f2", "p1", "read", "xref"), ("f2", "p1", "call", "scan"), ("f2", "d1", "read", "xref"), ("f3", "r1", "read", "fr")]
    got = {tuple(r) for r in G.block_ports(*graph(spark, said, edges)).select("block", "port", "dir", "kind", "alternative", "target").collect()}
    assert got == {
        ("f1", "n_mot", "in", "signal", False, "r1"), ("f1", "TMOT", "in", "signal", True, "r2"), ("f1", "KF_X", "in", "map", False, "p1"), ("f1", "F_two", "in", "block", False, "f2"), ("f1", "out_a", "out", "unknown", False, None), ("f1", "kfs_wint", "out", "unknown", False, None),
        ("f2", "n_mot", "out", "signal", True, "r1"), ("f2", "KF_X", "in", "map", False, "p1"),
    }
