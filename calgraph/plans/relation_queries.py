"""Queries on the relation graph."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import relations as R
from ..sources import io
from . import base as b

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = b.SQL + sql
        return f

    return add


def _shown(df, *columns):
    return df.withColumns({c: b.shown(c) for c in columns})


@query("""SELECT metric, key, value FROM (
  SELECT 'nodes' AS metric, t AS key, CAST(count(*) AS DOUBLE) AS value FROM nodes GROUP BY t
  UNION ALL SELECT 'edges_by_origin', o, count(*) FROM e GROUP BY o UNION ALL SELECT 'edges_by_kind', k, count(*) FROM e GROUP BY k UNION ALL SELECT 'edges', 'all', count(*) FROM e
  UNION ALL SELECT 'params', coalesce(bank, 'all'), n FROM p UNION ALL SELECT 'params_referenced', coalesce(bank, 'all'), hit FROM p UNION ALL SELECT 'params_referenced_pct', coalesce(bank, 'all'), round_even(hit * 100.0 / n, 1) FROM p)
""".replace("SELECT metric", """, e AS (SELECT * FROM edges WHERE s <> d AND s IN (SELECT id FROM nodes) AND d IN (SELECT id FROM nodes)),
touched AS (SELECT DISTINCT id FROM (SELECT s AS id FROM e WHERE o <> 'fr' UNION ALL SELECT d FROM e WHERE o <> 'fr')),
p AS (SELECT bank, count(*) AS n, CAST(sum(CASE WHEN touched.id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS hit FROM nodes LEFT JOIN touched USING (id) WHERE t = 'param' GROUP BY ROLLUP (bank)) SELECT metric""", 1))
def relation_coverage(spark, sf):
    nodes = b.nodes(spark, sf)
    return R.coverage(nodes, R.dedup_edges(b.raw_edges(spark, sf), nodes))


@query("SELECT s, d, k, o FROM edges WHERE s <> d AND s IN (SELECT id FROM nodes) AND d IN (SELECT id FROM nodes)")
def edge_dedup(spark, sf):
    return _shown(R.dedup_edges(b.raw_edges(spark, sf), b.nodes(spark, sf)), "s", "d")


@query(""", n AS (SELECT name, node, row_number() OVER (PARTITION BY name ORDER BY rank, ord) AS r FROM (
  SELECT p_name AS name, printf('p:%05x', p_partkey) AS node, 0 AS rank, p_partkey AS ord FROM part
  UNION ALL SELECT s_name, printf('f:%06x', s_suppkey), 1, s_suppkey FROM supplier UNION ALL SELECT c_name, printf('r:%06x', c_custkey), 2, c_custkey FROM customer))
SELECT name, node FROM n WHERE r = 1""")
def name_index(spark, sf):
    part, sup, cus = b.t(spark, sf, "part"), b.t(spark, sf, "supplier"), b.t(spark, sf, "customer")
    index = R.name_index(
        part.select(F.col("p_name").alias("name"), S.node_id("param", F.col("p_partkey")).alias("node"), F.col("p_partkey").alias("ord")),
        sup.select(F.col("s_name").alias("name"), F.format_string("f:%06x", "s_suppkey").alias("node"), F.col("s_suppkey").alias("ord")),
        cus.select(F.col("c_name").alias("name"), F.format_string("r:%06x", "c_custkey").alias("node"), F.col("c_custkey").alias("ord")),
    )
    return index.drop("ord")


@query(""", c AS (SELECT bank, addr, node, row_number() OVER (PARTITION BY bank, addr ORDER BY rank, ord, sub) AS r FROM (
  SELECT p_size % 2 AS bank, p_partkey * 2 AS addr, p_partkey AS node, 0 AS rank, p_partkey AS ord, 0 AS sub FROM part UNION ALL SELECT p_size % 2, p_partkey * 2 - 2, p_partkey, 0, p_partkey, 1 FROM part
  UNION ALL SELECT p_size % 2, p_partkey * 2 + 2, p_partkey, 1, p_partkey, 0 FROM part UNION ALL SELECT p_size % 2, p_partkey * 2, p_partkey, 1, p_partkey, 1 FROM part
  UNION ALL SELECT s_suppkey % 2, s_suppkey * 3, s_suppkey + 1000000, 2, s_suppkey, 0 FROM supplier UNION ALL SELECT c_custkey % 2, c_custkey * 5, c_custkey + 2000000, 3, c_custkey, 0 FROM customer))
SELECT CAST(bank AS BIGINT) AS bank, addr, node FROM c WHERE r = 1""")
def address_index(spark, sf):
    part, sup, cus = b.t(spark, sf, "part"), b.t(spark, sf, "supplier"), b.t(spark, sf, "customer")
    bank = (F.col("p_size") % 2).cast("long").alias("bank")
    items = part.select(bank, (F.col("p_partkey") * 2).alias("addr"), F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord"))
    axes = part.select(bank, (F.col("p_partkey") * 2 + 2).alias("addr"), F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord"))
    fs = sup.select((F.col("s_suppkey") % 2).alias("bank"), (F.col("s_suppkey") * 3).alias("addr"), (F.col("s_suppkey") + 1000000).alias("node"), F.col("s_suppkey").alias("ord"))
    ram = cus.select((F.col("c_custkey") % 2).alias("bank"), (F.col("c_custkey") * 5).alias("addr"), (F.col("c_custkey") + 2000000).alias("node"), F.col("c_custkey").alias("ord"))
    return R.addr_index(items, axes, fs, ram)


@query(""", r AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS d FROM lineitem), x AS (SELECT DISTINCT p_partkey AS addr FROM part WHERE p_size > 5), f AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
SELECT count(*) AS refs, count(CASE WHEN addr IS NULL THEN 1 END) AS dangling, count(DISTINCT CASE WHEN addr IS NULL THEN d END) AS unresolved FROM r JOIN f ON s = s_suppkey LEFT JOIN x ON d = addr""")
def resolve_references(spark, sf):
    one = F.lit(0).alias("bank")
    refs = b.t(spark, sf, "lineitem").select(one, F.col("l_suppkey").alias("s"), (F.col("l_partkey") + 10_000_000).alias("d"), F.lit("read").alias("k"), F.lit("xref").alias("o")).distinct()
    index = b.t(spark, sf, "supplier").where("s_acctbal > 0").select(one, F.col("s_suppkey").alias("addr"), F.col("s_name").alias("node")).unionByName(b.t(spark, sf, "part").where("p_size > 5").select(one, (F.col("p_partkey") + 10_000_000).alias("addr"), F.col("p_name").alias("node")))
    r = R.resolve_references(refs, index)
    return r.agg(F.count("*").alias("refs"), F.count_if(F.col("d").isNull()).alias("dangling"), F.count_distinct(F.when(F.col("d").isNull(), F.col("addr"))).alias("unresolved"))


@query("SELECT DISTINCT l_suppkey AS s, p_partkey AS d, 'read' AS k, 'scan' AS o FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10")
def operand_scan(spark, sf):
    known = b.t(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("addr"), F.col("p_partkey").alias("node"))
    return R.operand_scan(b.t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("func"), F.col("l_partkey").alias("value")), known)


@query("SELECT o_orderkey AS addr, s_suppkey AS func FROM orders JOIN supplier ON o_orderkey BETWEEN s_suppkey * 150 AND s_suppkey * 150 + 119")
def owner_of_address(spark, sf):
    points = b.t(spark, sf, "orders").select(F.lit(0).alias("bank"), F.col("o_orderkey").alias("addr"))
    ranges = b.t(spark, sf, "supplier").select(F.lit(0).alias("bank"), (F.col("s_suppkey") * 150).alias("start"), F.lit(120).alias("size"), F.col("s_suppkey").alias("func"))
    return R.owner_of(points, ranges).select("addr", "func")


@query(""", i AS (SELECT p_name AS name, min(p_partkey) AS node FROM part WHERE p_size > 10 GROUP BY p_name), l AS (SELECT lower(name) AS low, min(node) AS node FROM i GROUP BY 1), q AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part)
SELECT q.p_partkey, q.name, coalesce(i.node, l.node) AS node FROM q LEFT JOIN i ON q.name = i.name LEFT JOIN l ON lower(q.name) = l.low""")
def resolve_name(spark, sf):
    part = b.t(spark, sf, "part")
    index = R.first_wins(part.where("p_size > 10").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord")), ["name"], "node")
    return R.resolve_name(part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name")), index)


@query(""", i AS (SELECT p_name AS name, min(p_partkey) AS node FROM part WHERE p_size > 25 GROUP BY p_name), n AS (SELECT DISTINCT l_orderkey AS page, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT page, coalesce(CAST(node AS VARCHAR), 'u:' || n.name) AS d FROM n LEFT JOIN i ON n.name = i.name)
SELECT DISTINCT CAST(page AS VARCHAR) AS s, d, 'documents' AS k, 'fr' AS o FROM r UNION ALL SELECT DISTINCT d, CAST(page AS VARCHAR), 'documented', 'fr' FROM r""")
def page_edges(spark, sf):
    part = b.t(spark, sf, "part")
    index = R.first_wins(part.where("p_size > 25").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord")), ["name"], "node").withColumn("node", F.col("node").cast("string"))
    pages = b.t(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").cast("string").alias("page")).agg(F.collect_set("p_name").alias("names"))
    return R.page_edges(pages, index)[0]


@query(""", g AS (SELECT CAST(doc_id % 500 AS VARCHAR) || '.' || (doc_id % 7) AS section, max(source) AS path FROM documents WHERE lang = 'de' GROUP BY 1), e AS (SELECT CAST(doc_id % 500 AS VARCHAR) || '.' || (doc_id % 7) AS section, max(source) AS path FROM documents WHERE lang = 'en' GROUP BY 1)
SELECT coalesce(g.section, e.section) AS section, g.path AS path_de, e.path AS path_en, coalesce(g.path, e.path) AS text_source FROM g FULL JOIN e ON g.section = e.section""")
def pair_editions(spark, sf):
    docs = b.t(spark, sf, "documents").withColumn("section", F.concat_ws(".", F.col("doc_id") % 500, F.col("doc_id") % 7))
    side = lambda lang: docs.where(F.col("lang") == lang).groupBy("section").agg(F.max("source").alias("path"), F.min("lang").alias("title"))
    return R.pair_editions(side("de"), side("en")).select("section", "path_de", "path_en", "text_source")


@query(""", b AS (SELECT s AS node, d AS other, o FROM edges UNION ALL SELECT d, s, o FROM edges), g AS (SELECT node, other, list_sort(list_distinct(list(o))) AS os FROM b GROUP BY node, other)
SELECT node, other, array_to_string(os, ',') AS origins, list_contains(os, 'fr') AND len(os) > 1 AS both, list_contains(os, 'fr') AND len(os) = 1 AS documents_only FROM g""")
def agreement(spark, sf):
    return _shown(R.agreement(b.edges(spark, sf)).withColumn("origins", F.array_join("origins", ",")), "node", "other")


@query("SELECT d, count(CASE WHEN k = 'call' THEN 1 END) AS call, count(CASE WHEN k = 'read' THEN 1 END) AS read, count(CASE WHEN k = 'write' THEN 1 END) AS write, count(CASE WHEN k = 'documents' THEN 1 END) AS documents FROM edges GROUP BY d")
def degree(spark, sf):
    return _shown(R.degree(b.edges(spark, sf)), "d")


@query(""", unread AS (SELECT d FROM edges WHERE o = 'fr' EXCEPT SELECT d FROM edges WHERE o = 'xref' AND k = 'read') SELECT id, name FROM nodes JOIN unread ON id = d WHERE t = 'param'""")
def documented_not_confirmed(spark, sf):
    """Items on a page that no measured reading confirms."""
    e = b.edges(spark, sf)
    return _shown(R.documents_only_items(e.where("o = 'fr' or (o = 'xref' and k = 'read')"), b.nodes(spark, sf).where("t = 'param'").select("id", "name")), "id")


@query(""", c AS (SELECT DISTINCT d AS id FROM edges WHERE k = 'write' AND o = 'xref'), g AS (SELECT DISTINCT name FROM nodes WHERE t = 'param' AND id IN (SELECT d FROM edges WHERE k = 'call' AND o = 'scan')), p AS (SELECT DISTINCT name FROM nodes WHERE t = 'param' AND id IN (SELECT d FROM edges WHERE o = 'fr'))
SELECT id, name, CASE WHEN name IN (SELECT name FROM g) AND length(name) > 12 THEN 'code-confirmed' WHEN id IN (SELECT id FROM c) THEN 'xref-only' WHEN name IN (SELECT name FROM p) THEN 'document-only' ELSE 'inference' END AS grade FROM nodes WHERE t = 'param'""")
def evidence_grade(spark, sf):
    items, e = b.nodes(spark, sf).where("t = 'param'").select("id", "name"), b.edges(spark, sf)
    touched = lambda cond: items.join(e.where(cond).select(F.col("d").alias("id")).distinct(), "id", "left_semi")
    return _shown(R.evidence_grade(items, touched("k = 'call' and o = 'scan'").where("length(name) > 12"), touched("k = 'write' and o = 'xref'"), touched("o = 'fr'")), "id")


@query("""SELECT least(a.p_partkey, c.p_partkey) AS id1, greatest(a.p_partkey, c.p_partkey) AS id2, CAST(min(levenshtein(upper(replace(a.p_name, '_', '')), upper(replace(c.p_name, '_', '')))) AS INTEGER) AS edits, min(abs(a.p_partkey - c.p_partkey)) AS gap
FROM part a JOIN part c ON a.p_partkey < c.p_partkey AND a.p_brand = c.p_brand AND a.p_size = c.p_size WHERE levenshtein(upper(replace(a.p_name, '_', '')), upper(replace(c.p_name, '_', ''))) <= 2 GROUP BY 1, 2""")
def confusable_names(spark, sf):
    items = b.t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("addr"), F.concat_ws("/", "p_brand", "p_size").alias("block"))
    return R.confusable_names(items, "block")


@query("SELECT mapped, a.id AS id1, b.id AS id2, a.bank AS bank1, b.bank AS bank2 FROM i a JOIN i b USING (mapped) WHERE a.bank < b.bank".replace("SELECT mapped", ", i AS (SELECT p_partkey AS id, p_partkey % 3 AS bank, 557056 + p_retailprice::BIGINT % 32768 AS mapped FROM part) SELECT mapped", 1))
def address_collisions(spark, sf):
    return R.address_collisions(b.t(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("bank"), F.rint("p_retailprice").cast("long").alias("addr")))


@query("SELECT p_name AS name, p_partkey * 2 AS stated_addr, p_retailprice AS stated, p_partkey AS addr, p_retailprice AS value, p_partkey * 2 = p_partkey AS addr_ok, true AS value_ok FROM (SELECT * REPLACE (p_name || p_partkey AS p_name) FROM part)")
def verify_parameter_rows(spark, sf):
    part = b.t(spark, sf, "part").withColumn("p_name", F.concat("p_name", "p_partkey"))
    lines = part.select(F.concat(F.lit("| "), "p_name", F.lit(" | 0x"), F.hex(F.col("p_partkey") * 2), F.lit(" | "), F.col("p_retailprice").cast("string"), F.lit(" |")).alias("line"))
    return R.verify_rows(lines, part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("addr"), F.col("p_retailprice").alias("value")))


_STEPS = """, code AS (SELECT * FROM edges WHERE o <> 'fr'), steps AS (SELECT DISTINCT parent, next, o FROM (SELECT s AS parent, d AS next, o FROM code WHERE k <> 'write' UNION ALL SELECT d, s, o FROM code WHERE k = 'read' UNION ALL SELECT s, d, o FROM edges WHERE o = 'fr'))
"""


@query(_STEPS + "SELECT parent, next, o FROM steps")
def adjacency_downstream(spark, sf):
    return _shown(G.adjacency(b.edges(spark, sf), "downstream"), "parent", "next")


@query(""", code AS (SELECT * FROM edges WHERE o <> 'fr') SELECT DISTINCT parent, next, o FROM (SELECT s AS parent, d AS next, o FROM code WHERE k = 'write' UNION ALL SELECT d, s, o FROM code WHERE k <> 'read' UNION ALL SELECT s, d, o FROM edges WHERE o = 'fr')""")
def adjacency_upstream(spark, sf):
    return _shown(G.adjacency(b.edges(spark, sf), "upstream"), "parent", "next")


@query(_STEPS + """, m AS (SELECT parent, next, min(CASE o WHEN 'xref' THEN 0 WHEN 'scan' THEN 1 ELSE 2 END) AS rank FROM steps GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY rank, next) AS pos, count(*) OVER (PARTITION BY parent) AS n FROM m)
SELECT parent, next, rank, CAST(pos AS INTEGER) AS pos, n > 10 AS truncated FROM w WHERE pos <= 10""")
def rank_children(spark, sf):
    return _shown(G.ranked_children(G.adjacency(b.edges(spark, sf), "downstream"), 10), "parent", "next")


def _tree(children: str, root: str, depth: int) -> str:
    """SQL of a tree walk, a level at a time. ``children``: (parent, next, pos, truncated)."""
    out = f", ch AS ({children}), t0 AS (SELECT 0 AS level, CAST(NULL AS {{kind}}) AS parent, {root} AS node, 1 AS pos, false AS repeated, false AS truncated, '' AS path)"
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM t{i}" for i in range(d))
        out += f""", n{d} AS (SELECT f.node AS parent, next AS node, ch.pos, ch.truncated, f.path || '/' || printf('%05d', ch.pos) AS path FROM t{d - 1} f JOIN ch ON ch.parent = f.node WHERE NOT f.repeated),
t{d} AS (SELECT {d} AS level, parent, node, pos, node IN ({seen}) OR row_number() OVER (PARTITION BY node ORDER BY path) > 1 AS repeated, truncated, path FROM n{d})"""
    every = " UNION ALL ".join(f"SELECT level, parent, node, CAST(pos AS INTEGER) AS pos, repeated, truncated FROM t{d}" for d in range(depth + 1))
    return f"{out} {every}"


_RANKED = "SELECT parent, next, pos, n > {most} AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY rank, next) AS pos, count(*) OVER (PARTITION BY parent) AS n FROM (SELECT parent, next, min(CASE o WHEN 'xref' THEN 0 WHEN 'scan' THEN 1 ELSE 2 END) AS rank FROM steps GROUP BY 1, 2)) WHERE pos <= {most}"


@query(_STEPS + _tree(_RANKED.format(most=20), "'f:000001'", 3).format(kind="VARCHAR"))
def expand_tree(spark, sf):
    return _shown(G.expand(G.adjacency(b.edges(spark, sf), "downstream"), b.number("func", 1), depth=3, most=20), "parent", "node")


_CODE = _STEPS.replace("UNION ALL SELECT s, d, o FROM edges WHERE o = 'fr'", "")


@query(_CODE + """, r AS (SELECT id FROM nodes WHERE t = 'func'), l1 AS (SELECT DISTINCT r.id AS root, next AS node FROM r JOIN steps ON parent = r.id), l2 AS (SELECT DISTINCT root, steps.next AS node FROM l1 JOIN steps ON parent = node)
SELECT root, node, CAST(min(distance) AS INTEGER) AS distance FROM (SELECT id AS root, id AS node, 0 AS distance FROM r UNION ALL SELECT root, node, 1 FROM l1 UNION ALL SELECT root, node, 2 FROM l2) GROUP BY 1, 2""")
def reachable(spark, sf):
    steps = G.adjacency(b.edges(spark, sf), "downstream", ["xref", "scan"])
    return _shown(G.reachable(steps, b.nodes(spark, sf).where("t = 'func'"), 2), "root", "node")


@query("""SELECT id, t, name, class FROM (SELECT *, row_number() OVER (ORDER BY CASE t WHEN 'param' THEN 0 WHEN 'func' THEN 1 ELSE 2 END, length(name), class, id) AS r FROM (
  SELECT *, CASE WHEN lower(name) = 'red bolt' THEN 0 WHEN starts_with(lower(name), 'red bolt') THEN 1 WHEN contains(lower(name), 'red bolt') THEN 2 WHEN contains(lower(coalesce(description, '')), 'red bolt') THEN 3 END AS class FROM nodes WHERE t <> 'frpage') WHERE class IS NOT NULL) WHERE r <= 60""")
def search_names(spark, sf):
    return _shown(G.search(b.nodes(spark, sf), "red bolt").select("id", "t", "name", "class"), "id")


#: Conversations as the statements of every other function, with words as maps, signals or names of no kind; functions' edges to RAM from order lines.
_WIRED = """, raw AS (SELECT printf('f:%06x', 2 * conv_id) AS block, turn AS ord, list_transform(w, lambda x: CASE length(x) % 3 WHEN 0 THEN 'kf_' || x WHEN 1 THEN x ELSE upper(x) END) AS n, conv_id, role, text FROM (SELECT conv_id, turn, role, text, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 4) AS w FROM conversations)),
wired AS (SELECT block, ord, role, coalesce(n[1], '') AS out, list_distinct(n) AS reads, CASE WHEN ord % 2 = 0 THEN '{' || array_to_string(list_distinct(n), ' | ') || '}' ELSE text END AS expr, [printf('Supplier#%09d', conv_id), 'Supplier#000000000', 'NO_BLOCK', 'abs'] AS calls FROM raw),
idx AS (SELECT DISTINCT c_name AS name, 'ram' AS t, printf('r:%06x', c_custkey) AS id FROM customer UNION ALL SELECT w, 'param', min(printf('p:%05x', p_partkey)) FROM (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) AS w FROM part WHERE p_size > 25) GROUP BY 1 UNION ALL SELECT s_name, 'func', printf('f:%06x', s_suppkey) FROM supplier),
named AS (SELECT n.name, coalesce(e.t, l.t) AS t, coalesce(e.id, l.id) AS id FROM (SELECT DISTINCT unnest(reads) AS name FROM wired UNION SELECT out FROM wired UNION SELECT DISTINCT unnest(calls) FROM wired UNION SELECT name FROM nodes) n LEFT JOIN idx e ON e.name = n.name LEFT JOIN idx l ON l.name = lower(n.name)),
kinds AS (SELECT name, id AS target, CASE t WHEN 'param' THEN 'constant' WHEN 'ram' THEN 'signal' WHEN 'func' THEN 'block' ELSE CASE WHEN regexp_matches(name, '^kf_', 'i') THEN 'map' WHEN regexp_matches(name, '^kl_', 'i') THEN 'curve' WHEN regexp_matches(name, '^k_', 'i') THEN 'constant' WHEN regexp_matches(name, '^[A-Z][A-Z0-9_]*$') THEN 'signal' ELSE 'unknown' END END AS kind FROM named),
wires AS (SELECT DISTINCT printf('f:%06x', l_suppkey) AS s, printf('r:%06x', o_custkey) AS d, CASE l_returnflag WHEN 'R' THEN 'read' WHEN 'A' THEN 'write' ELSE 'call' END AS k, CASE l_linestatus WHEN 'O' THEN 'xref' ELSE 'scan' END AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ram AS (SELECT DISTINCT s AS block, name AS signal, CASE k WHEN 'write' THEN 'write' ELSE 'read' END AS dir FROM wires JOIN nodes ON nodes.id = d AND t = 'ram' WHERE s NOT IN (SELECT block FROM wired)),
links AS (SELECT block, signal, dir FROM (SELECT block, out AS signal, 'write' AS dir FROM wired UNION SELECT block, unnest(reads), 'read' FROM wired) WHERE length(signal) >= 2 AND signal IN (SELECT name FROM kinds WHERE kind = 'signal') UNION SELECT * FROM ram)
"""
_CHAIN = _WIRED.rstrip() + """, chain AS (SELECT w.block AS src, signal, r.block AS dst FROM links w JOIN links r USING (signal) WHERE w.dir = 'write' AND r.dir = 'read' AND w.block <> r.block)
"""


def _wired(spark, sf):
    """statements, functions, edges, nodes and index, as in the SQL above."""
    c = b.t(spark, sf, "conversations")
    w = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 4)
    name = F.transform(w, lambda x: F.when(F.length(x) % 3 == 0, F.concat(F.lit("kf_"), x)).when(F.length(x) % 3 == 1, x).otherwise(F.upper(x)))
    c = c.select((F.col("conv_id") * 2).alias("key"), "conv_id", F.col("turn").alias("ord"), "role", "text", name.alias("n"))
    reads = F.array_distinct("n")
    expr = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("{"), F.array_join(reads, " | "), F.lit("}"))).otherwise(F.col("text"))
    calls = F.array(F.format_string("Supplier#%09d", "conv_id"), F.lit("Supplier#000000000"), F.lit("NO_BLOCK"), F.lit("abs"))
    said = c.select(b.ident("func", "key").alias("block"), "ord", "role", F.coalesce(F.get("n", F.lit(0)), F.lit("")).alias("out"), reads.alias("reads"), expr.alias("expr"), calls.alias("calls"))
    nodes = b.nodes(spark, sf)
    lines = b.t(spark, sf, "lineitem").join(b.t(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.when(F.col("l_returnflag") == "R", "read").when(F.col("l_returnflag") == "A", "write").otherwise("call")
    edges = lines.select(b.ident("func", "l_suppkey").alias("s"), b.ident("ram", "o_custkey").alias("d"), k.alias("k"), F.when(F.col("l_linestatus") == "O", "xref").otherwise("scan").alias("o")).distinct()
    words = b.t(spark, sf, "part").where("p_size > 25").select(F.explode(F.split(F.lower("p_name"), "[^a-z]+")).alias("name"), b.ident("param", "p_partkey").alias("node")).groupBy("name").agg(F.min("node").alias("node"))
    index = nodes.where("t in ('ram', 'func')").select("name", F.col("id").alias("node")).unionByName(words)
    return said, nodes.where("t = 'func'").select("id"), edges, nodes.withColumn("kind", F.lit(None).cast("string")), index


@query(_WIRED + "SELECT * FROM links")
def signal_links(spark, sf):
    """Who writes and reads a signal: by statements, and by edges to RAM for functions that have none."""
    return _shown(G.signal_links(*_wired(spark, sf)), "block")


@query(_WIRED + "SELECT block, signal, dir FROM ram")
def fallback_wiring(spark, sf):
    """The links of functions without statements."""
    said, functions, edges, nodes, _ = _wired(spark, sf)
    return _shown(G.ram_links(said, functions, edges, nodes), "block")


@query(_CHAIN + "SELECT l.signal, count(DISTINCT block) FILTER (dir = 'write') AS writers, count(DISTINCT block) FILTER (dir = 'read') AS readers, coalesce((SELECT count(*) FROM chain c WHERE c.signal = l.signal), 0) AS pairs FROM links l GROUP BY l.signal")
def signal_classes(spark, sf):
    return G.signal_classes(G.signal_links(*_wired(spark, sf)))


@query(_CHAIN + "SELECT * FROM chain")
def signal_chain(spark, sf):
    return _shown(_chained(spark, sf), "src", "dst")


def _links(spark, sf):
    return io.settled(G.signal_links(*_wired(spark, sf)))


def _chained(spark, sf):
    return G.signal_chain(_links(spark, sf))


@query(_CHAIN + "SELECT src AS block, dst AS next, min(signal) AS via FROM chain GROUP BY 1, 2")
def block_neighbours(spark, sf):
    return _shown(G.neighbours(_links(spark, sf)), "block", "next")


@query("SELECT DISTINCT s AS block, d AS next, 'call' AS via FROM edges WHERE k = 'call' AND o <> 'fr'")
def call_neighbours(spark, sf):
    return _shown(G.block_neighbours(None, b.edges(spark, sf), "call"), "block", "next")


def _told(spark, sf):
    return b.statements(spark, sf).withColumn("interp", F.filter("reads", lambda x: x.startswith("th"))).withColumn("named", F.col("role") == "system")


def _scored(spark, sf):
    return _told(spark, sf).withColumn("block", F.col("block") * 2).withColumn("block", b.ident("func", "block"))


_SCORE = """, score AS (SELECT printf('f:%06x', 2 * block) AS block, CAST(sum(CASE WHEN len(list_filter(reads, lambda x: starts_with(x, 'th'))) > 0 THEN 10 ELSE 0 END) + max(CASE WHEN role = 'system' THEN 3 ELSE 0 END) + least(count(*), 5) AS BIGINT) AS score FROM statements GROUP BY block)
"""


@query(_SCORE + "SELECT * FROM score")
def block_score(spark, sf):
    return _shown(G.block_score(_scored(spark, sf)), "block")


@query(_CHAIN.rstrip() + _SCORE + """, p AS (SELECT src AS block, dst AS next, min(signal) AS via FROM chain GROUP BY 1, 2), w AS (SELECT p.block, next, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY p.block ORDER BY coalesce(score, 0) DESC, next) AS pos, count(*) OVER (PARTITION BY p.block) AS n FROM p LEFT JOIN score ON score.block = next)
SELECT block, next, score, CAST(pos AS INTEGER) AS pos, greatest(n - 5, 0) AS hidden FROM w WHERE pos <= 5""")
def top_neighbours(spark, sf):
    best = G.best_neighbours(_links(spark, sf), G.block_score(_scored(spark, sf)), 5)
    return _shown(best.select("block", "next", "score", "pos", F.greatest(F.col("n") - 5, F.lit(0)).alias("hidden")), "block", "next")


@query(""", sc AS (SELECT printf('f:%06x', s_suppkey) AS block, s_nationkey AS score FROM supplier), n AS (SELECT d AS node, s AS block FROM edges WHERE o <> 'fr'), w AS (SELECT node, n.block, row_number() OVER (PARTITION BY node ORDER BY score DESC, n.block) AS r FROM n JOIN sc ON sc.block = n.block) SELECT node, block FROM w WHERE r = 1""")
def owning_block(spark, sf):
    scores = b.t(spark, sf, "supplier").select(b.ident("func", "s_suppkey").alias("block"), F.col("s_nationkey").alias("score"))
    return _shown(G.owning_block(b.edges(spark, sf), b.nodes(spark, sf).where("t = 'func'"), scores), "node", "block")


@query(_WIRED.rstrip() + """, x AS (SELECT DISTINCT block, port, dir, ord, called, expr FROM (SELECT block, ord, unnest(reads) AS port, 'in' AS dir, false AS called, expr FROM wired UNION ALL SELECT block, ord, unnest(calls), 'in', true, '' FROM wired UNION ALL SELECT block, ord, out, 'out', false, '' FROM wired) WHERE length(port) >= 2 AND port <> 'abs'),
p AS (SELECT block, port, dir, kind, target, arg_min(contains(expr, '{' || port || ' |') OR contains(expr, '| ' || port || ' |') OR contains(expr, '| ' || port || '}') OR expr = '{' || port || '}', ord * 2 + CAST(called AS INTEGER)) AS alternative FROM x JOIN kinds ON kinds.name = port WHERE NOT called OR kind = 'block' GROUP BY ALL),
e AS (SELECT s AS block, name AS port, CASE k WHEN 'write' THEN 'out' ELSE 'in' END AS dir, max(o || d) AS od FROM wires JOIN nodes ON nodes.id = d WHERE s NOT IN (SELECT block FROM p) GROUP BY ALL)
SELECT block, port, dir, kind, alternative, target FROM p UNION ALL SELECT block, port, dir, kind, od[1:4] = 'scan', od[5:] FROM e JOIN kinds ON kinds.name = port""")
def block_ports(spark, sf):
    return _shown(G.block_ports(*_wired(spark, sf)).drop("rank"), "block", "target")


@query(_CHAIN.rstrip() + _SCORE.rstrip() + _tree("SELECT block AS parent, next, pos, n > 4 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY score DESC, next) AS pos, count(*) OVER (PARTITION BY block) AS n FROM (SELECT DISTINCT src AS block, dst AS next, coalesce(score, 0) AS score FROM chain LEFT JOIN score ON score.block = dst)) WHERE pos <= 4", "(SELECT min(src) FROM chain)", 3).format(kind="VARCHAR"))
def expand_blocks(spark, sf):
    return _shown(G.expand_linked(_links(spark, sf), G.block_score(_scored(spark, sf)), depth=3, most=4), "parent", "node")


_NOISY = """, st AS (SELECT block, ord, out, CASE ord % 5 WHEN 0 THEN '0x1f' WHEN 1 THEN 'KF_' || upper(out) || ' + 1' WHEN 2 THEN '*(' || out || ' + 4)' WHEN 3 THEN 'DAT_00ff10a' || ord % 10 ELSE out || ' + x' END AS expr FROM statements WHERE out <> '')
"""


@query(_NOISY + "SELECT block, ord, CASE ord % 5 WHEN 0 THEN out NOT IN (SELECT s_name FROM supplier UNION SELECT unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) FROM part) AND NOT out IN ('bolt') WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS noise FROM st")
def statement_noise(spark, sf):
    s, n = b.statements(spark, sf).where("out != ''"), F.col("ord") % 5
    expr = F.when(n == 0, F.lit("0x1f")).when(n == 1, F.concat(F.lit("KF_"), F.upper("out"), F.lit(" + 1"))).when(n == 2, F.concat(F.lit("*("), "out", F.lit(" + 4)"))).when(n == 3, F.concat(F.lit("DAT_00ff10a"), (F.col("ord") % 10).cast("string"))).otherwise(F.concat("out", F.lit(" + x")))
    known = b.t(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), "[^a-z]+")).alias("name"))
    return G.statement_noise(s.withColumn("expr", expr).withColumn("interp", F.array().cast("array<string>")), known.union(spark.sql("SELECT 'bolt' AS name"))).select("block", "ord", "noise")


@query(""", ram AS (SELECT DISTINCT lower(n_name) AS name FROM nation), sig AS (SELECT doc_id AS doc, list_distinct(regexp_split_to_array(text, '[^A-Za-z]+')) AS s FROM documents), i AS (SELECT DISTINCT w AS name FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 4)
SELECT doc, count(CASE WHEN lower(w) IN (SELECT lower(name) FROM i) THEN 1 END) AS matches, count(*) AS signals FROM (SELECT doc, unnest(s) AS w FROM sig) WHERE length(w) >= 4 GROUP BY doc""")
def signal_ram_matches(spark, sf):
    words = lambda name, key: b.t(spark, sf, name).select(F.col(key).alias("doc"), F.filter(F.split("text", "[^A-Za-z]+"), lambda x: F.length(x) >= 4).alias("signals"))
    ram = words("benchmark", "item_id").select(F.explode("signals").alias("name")).distinct().withColumn("node", F.concat(F.lit("r:"), F.lower("name")))
    return R.signal_ram_matches(words("documents", "doc_id"), ram, ram.select(F.col("node").alias("id")))


@query("SELECT p_partkey AS id, n_name AS ja FROM part LEFT JOIN nation ON p_size = n_nationkey")
def translations(spark, sf):
    items = b.t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("name"))
    keys = b.t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    return R.with_translations(items, keys).select("id", "ja")


@query("SELECT p_partkey AS id, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM part LEFT JOIN nation ON n_nationkey IN (p_size, p_partkey % 30) GROUP BY 1")
def item_categories(spark, sf):
    items = b.t(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.category_ids(F.array((F.col("p_size") + 1).cast("long"), F.col("p_partkey") % 30 + 1, F.col("p_partkey") % 30 + 1)).alias("category_ids"))
    c = b.t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("de"), F.col("n_name").alias("en"))
    return R.with_categories(items, c).select("id", F.array_join(F.transform("categories", lambda x: x["en"]), ",").alias("names"))


@query(", w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS name FROM documents) SELECT DISTINCT name FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS name FROM benchmark) WHERE length(name) >= 4 AND name NOT IN (SELECT name FROM w)")
def missing_names(spark, sf):
    words = lambda name: b.t(spark, sf, name).select(F.explode(F.split("text", "[^A-Za-z]+")).alias("name")).where("length(name) >= 4")
    return R.missing_names(words("benchmark"), words("documents"))


@query("SELECT t, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT o, count(*) FROM edges GROUP BY 1")
def written_graph(spark, sf):
    """The graph written as two tables and read again, counted by partition."""
    path = f"{io.shared_folder(spark)}/written-graph-{uuid.uuid4().hex}"
    io.write_graph(b.nodes(spark, sf), b.edges(spark, sf), path)
    count = lambda name, c: spark.read.parquet(f"{path}/{name}").groupBy(F.col(c).cast("string").alias("t")).agg(F.count("*").alias("n"))
    return count("nodes", "t").unionByName(count("edges", "o"))


@query(""", n AS (SELECT s_name, printf('f:%06x', s_suppkey) AS func, s_nationkey % 4 AS n FROM supplier) SELECT DISTINCT d AS node, s AS func, CAST(coalesce(n.n, 0) AS BIGINT) AS n FROM edges LEFT JOIN (SELECT func, n FROM n WHERE n > 0) n ON n.func = s WHERE o <> 'fr'""")
def consumers(spark, sf):
    st = b.t(spark, sf, "supplier").where("s_nationkey % 4 > 0").select(b.ident("func", "s_suppkey").alias("block"), F.explode(F.sequence(F.lit(1), F.col("s_nationkey") % 4)).alias("ord"))
    return _shown(G.consumers(b.edges(spark, sf), b.nodes(spark, sf).where("t = 'func'"), st), "node", "func")


@query(""", r AS (SELECT block, ord, CASE WHEN len(list_filter(reads, lambda x: starts_with(x, 'th'))) > 0 THEN 0 ELSE 2 END AS rank FROM statements), w AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY rank, ord) AS pos, count(*) OVER (PARTITION BY block) AS n FROM r)
SELECT block, ord, rank, greatest(n - 3, 0) AS hidden, CAST(row_number() OVER (PARTITION BY block ORDER BY ord) AS INTEGER) AS place FROM w WHERE pos <= 3""")
def top_statements(spark, sf):
    return G.top_statements(_told(spark, sf), 3).select("block", "ord", "rank", "hidden", "place")


@query(""", h AS (SELECT block, ord, out = 'that' OR list_contains(reads, 'that') AS hit FROM statements), s AS (SELECT *, bool_or(hit) OVER (PARTITION BY block) AS any_hit FROM h), w AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY ord) AS pos, count(*) OVER (PARTITION BY block) AS n FROM s WHERE hit OR NOT any_hit)
SELECT block, ord, hit, CAST(pos AS INTEGER) AS pos, greatest(n - 2, 0) AS rest FROM w WHERE pos <= 2""")
def relevant_statements(spark, sf):
    return G.relevant_statements(b.statements(spark, sf), "that").select("block", "ord", "hit", "pos", "rest")


@query("""SELECT block AS func, role AS name, ord AS line, (SELECT max_by(expr, d.ord) FROM statements d WHERE d.block = u.block AND d.role = u.role AND d.ord < u.ord) AS expr FROM statements u""")
def definition_as_of(spark, sf):
    s = b.statements(spark, sf).select(F.col("block").alias("func"), F.col("role").alias("name"), F.col("ord").alias("line"), "expr")
    return G.definition_as_of(s.drop("expr"), s)


@query(""", p AS (SELECT DISTINCT l_orderkey AS page, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT page FROM p GROUP BY page HAVING count(*) <= 25), q AS (SELECT * FROM p WHERE page IN (SELECT page FROM k)) SELECT x.name AS a, y.name AS b, count(*) AS pages FROM q x JOIN q y ON x.page = y.page AND x.name < y.name GROUP BY 1, 2""")
def cooccurrence(spark, sf):
    named = b.t(spark, sf, "lineitem").join(b.t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return G.cooccurrence(named.groupBy("l_orderkey").agg(F.collect_set("p_name").alias("names")))


@query("SELECT l_orderkey AS page, count(*) AS names, count(*) > 4 AS dense FROM lineitem GROUP BY 1")
def dense_pages(spark, sf):
    return b.t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.count("*").alias("names")).withColumn("dense", F.col("names") > 4)


@query("SELECT n_regionkey AS category, count(*) AS members, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def category_members(spark, sf):
    return b.t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("category")).agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT p_type AS kind, p_size % 2 AS bank, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_type), (p_size % 2), ())")
def kind_and_bank_counts(spark, sf):
    p = b.t(spark, sf, "part").select(F.col("p_type").alias("kind"), (F.col("p_size") % 2).alias("bank"))
    return p.groupingSets([["kind"], ["bank"], []], "kind", "bank").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_size < 10 EXCEPT SELECT p_name FROM part WHERE p_size > 45")
def names_learned_only(spark, sf):
    p = b.t(spark, sf, "part")
    return p.where("p_size < 10").select(F.col("p_name").alias("name")).subtract(p.where("p_size > 45").select("p_name"))


@query("SELECT p_name AS name FROM part WHERE p_size < 10 INTERSECT SELECT p_name FROM part WHERE p_size > 45")
def names_in_both(spark, sf):
    p = b.t(spark, sf, "part")
    return p.where("p_size < 10").select(F.col("p_name").alias("name")).intersect(p.where("p_size > 45").select("p_name"))


@query("SELECT s AS section, d AS node FROM edges WHERE o = 'fr' AND k = 'documents'")
def page_links(spark, sf):
    return b.edges(spark, sf).where("o = 'fr' and k = 'documents'").select(b.shown("s").alias("section"), b.shown("d").alias("node"))


@query("SELECT quality, toxic, count(*) AS n, count(DISTINCT lang) AS langs FROM labels JOIN documents USING (doc_id) GROUP BY CUBE (quality, toxic)")
def label_agreement(spark, sf):
    j = b.t(spark, sf, "labels").join(b.t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return j.cube("quality", "toxic").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))


@query(""", q AS (SELECT DISTINCT lower(w) AS query FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark UNION SELECT unnest(regexp_split_to_array(p_name || ' ' || p_type || ' ' || substring(p_name, 2, 5), ' ')) FROM part) WHERE w <> ''),
h AS (SELECT query, id, t, name, CASE WHEN lower(name) = query THEN 0 WHEN starts_with(lower(name), query) THEN 1 WHEN contains(lower(name), query) THEN 2 WHEN contains(lower(coalesce(description, '')), query) THEN 3 END AS class FROM q JOIN nodes ON t <> 'frpage' AND (contains(lower(name), query) OR contains(lower(coalesce(description, '')), query)))
SELECT * FROM (SELECT query, id, t, name, class, CAST(row_number() OVER (PARTITION BY query ORDER BY CASE t WHEN 'param' THEN 0 WHEN 'func' THEN 1 ELSE 2 END, length(name), class, id) AS INTEGER) AS pos FROM h) WHERE pos <= 20""")
def search_many(spark, sf):
    """Words of benchmarks, items and parts of their names, each searched for."""
    words = b.t(spark, sf, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("query"))
    names = b.t(spark, sf, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type", F.substring("p_name", 2, 5)), " ")).alias("query"))
    return _shown(G.search_many(b.nodes(spark, sf), words.union(names), 20), "id")


#: Items by brand and size, their names without the last word, so that many are equal.
_SHORT = ", i AS (SELECT p_partkey AS id, upper(split_part(p_name, ' ', 1)) AS plain, p_brand AS block FROM part), c AS (SELECT block, plain, min(id) AS class, count(*) AS members FROM i GROUP BY 1, 2)"


def _short(spark, sf):
    return b.t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.substring_index("p_name", " ", 1).alias("name"), F.col("p_brand").alias("block"))


@query(_SHORT + " SELECT id, class FROM i JOIN c USING (block, plain)")
def name_classes(spark, sf):
    return R.name_classes(_short(spark, sf), "block").select("id", "class")


@query(_SHORT + " SELECT a.class AS class1, d.class AS class2, CAST(levenshtein(a.plain, d.plain) AS INTEGER) AS edits, a.members AS members1, d.members AS members2 FROM c a JOIN c d ON a.block = d.block AND a.class < d.class WHERE levenshtein(a.plain, d.plain) <= 2")
def confusable_classes(spark, sf):
    return R.confusable_classes(_short(spark, sf), "block")


@query(", i AS (SELECT p_partkey AS id, p_partkey % 3 AS bank, 557056 + p_retailprice::BIGINT % 32768 AS mapped, p_size AS image FROM part) SELECT image, mapped, min(id) AS class, count(*) AS members, array_to_string(list_sort(list(DISTINCT bank)), ',') AS banks FROM i GROUP BY 1, 2 HAVING count(DISTINCT bank) > 1")
def collision_classes(spark, sf):
    items = b.t(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("bank"), F.rint("p_retailprice").cast("long").alias("addr"), F.col("p_size").alias("image"))
    return R.collision_classes(items, "image").withColumn("banks", F.array_join(F.col("banks").cast("array<string>"), ","))


@query("SELECT d, o, count(*) FILTER (k = 'call') AS call, count(*) FILTER (k = 'read') AS read, count(*) FILTER (k = 'write') AS write, count(*) FILTER (k = 'documents') AS documents, count(*) FILTER (k = 'documented') AS documented FROM edges GROUP BY 1, 2")
def degree_by_origin(spark, sf):
    return _shown(R.degree_by_origin(b.edges(spark, sf)), "d")


@query(""" SELECT s AS node, o_orderpriority AS section, o_orderkey % 100 AS page, d AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN lower(o_orderpriority) END AS title,
CAST(row_number() OVER (PARTITION BY s ORDER BY o_orderpriority, o_orderkey % 100, d) AS INTEGER) AS place FROM edges JOIN orders ON d = printf('d:%06x', o_orderkey) WHERE o = 'fr'""")
def node_pages(spark, sf):
    """Orders as pages of sections by priority; one section has no document."""
    orders = b.t(spark, sf, "orders")
    pages = orders.select(b.ident("frpage", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("section"), (F.col("o_orderkey") % 100).alias("page"))
    docs = pages.select("section").distinct().where("section != '5-LOW'").withColumn("title", F.lower("section"))
    return _shown(R.page_links(b.edges(spark, sf), pages, docs), "node", "id")


_FIGURES = """, every AS (SELECT id, t, name FROM nodes UNION ALL SELECT n_name, 'unknown', n_name FROM nation), params AS (SELECT count(*) AS n, count(*) FILTER (id IN (SELECT d FROM edges WHERE o <> 'fr')) AS ref, count(*) FILTER (id IN (SELECT s FROM edges WHERE o = 'fr' AND k = 'documented' AND s LIKE '%1')) AS doc FROM nodes WHERE t = 'param'),
words AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM documents) WHERE length(w) >= 4 AND lower(w) IN (SELECT lower(w) FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE w <> '')),
figures AS (SELECT 'functions' AS metric, (SELECT count(*) FROM supplier) AS value UNION ALL SELECT 'named_functions', (SELECT count(*) FROM supplier WHERE s_name LIKE '%3') UNION ALL SELECT 'ram_symbols', (SELECT count(*) FROM customer) UNION ALL SELECT 'pages', (SELECT count(*) FROM orders)
UNION ALL SELECT 'dense_pages', (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT 'names_only_in_documents', (SELECT count(*) FROM nation) UNION ALL SELECT 'params', n FROM params UNION ALL SELECT 'params_referenced', ref FROM params UNION ALL SELECT 'params_documented', doc FROM params
UNION ALL SELECT 'params_referenced_pct', round_even(100.0 * ref / n, 1) FROM params UNION ALL SELECT 'params_documented_pct', round_even(100.0 * doc / n, 1) FROM params UNION ALL SELECT 'blocks_with_formulas', (SELECT count(DISTINCT block) FROM statements)
UNION ALL SELECT 'lookups_found', (SELECT sum(len(list_filter(reads, lambda x: starts_with(x, 'th')))) FROM statements) UNION ALL SELECT 'unresolved', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 5 = 0) UNION ALL SELECT 'signals_matching_ram', (SELECT count(*) FROM words))
SELECT metric, CAST(value AS DOUBLE) AS value FROM figures"""


@query(_FIGURES)
def coverage_figures(spark, sf):
    """The figures of the graph with nation names as names of no node, conversations as statements and orders as references."""
    unknown = b.t(spark, sf, "nation").select(F.lit(-1).cast("long").alias("id"), F.lit("unknown").alias("t"), F.col("n_name").alias("name"))
    n = b.nodes(spark, sf).select("id", "t", "name").unionByName(unknown)
    n = n.withColumns({"named": F.endswith("name", F.lit("3")), "dense": F.col("name") == "1-URGENT"})
    e = b.edges(spark, sf).where(F.when(F.col("o") == "fr", (F.col("k") == "documented") & F.endswith(b.shown("s"), F.lit("1"))).otherwise(True))
    refs = b.t(spark, sf, "orders").select(F.col("o_custkey").alias("addr"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("d"))
    return R.coverage_figures(n, e, _told(spark, sf), refs, signal_ram_matches(spark, sf))


@query("SELECT 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'documents', (SELECT count(DISTINCT o_orderpriority) FROM orders) UNION ALL SELECT 'categories', count(*) FROM nation UNION ALL SELECT 'names', (SELECT count(DISTINCT name) FROM nodes WHERE t <> 'frpage') UNION ALL SELECT 'coverage', 15")
def written_tables(spark, sf):
    """The whole graph written and read again: rows of each table."""
    path = f"{io.shared_folder(spark)}/written-tables-{uuid.uuid4().hex}"
    n = b.nodes(spark, sf)
    tables = {
        "documents": b.t(spark, sf, "orders").select(F.col("o_orderpriority").alias("section")).distinct(), "categories": b.t(spark, sf, "nation").select("n_nationkey", "n_name"),
        "names": R.first_wins(n.where("t != 'frpage'").select("name", F.col("id").alias("node"), F.col("id").alias("ord")), ["name"], "node"), "coverage": coverage_figures(spark, sf),
    }
    io.write_graph(n, b.edges(spark, sf), path, **tables)
    count = lambda name: spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, map(count, ("nodes", "edges", *tables)))
