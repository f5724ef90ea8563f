"""The given tables seen as the library's inputs.

Parts stand for calibration items, suppliers for functions, customers for RAM symbols, orders for pages and
order lines for references; events are log samples, documents text, conversations statements and embeddings
8 by 8 grids. The SQL views of the same name are prefixed to the SQL that a query is held against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Kinds of nodes in the order of their ids, and how an id is shown.
KINDS = [("frpage", "d:%06x"), ("func", "f:%06x"), ("param", "p:%05x"), ("ram", "r:%06x")]
#: Hexadecimal digits of a key at most.
DIGITS = 14


def ident(kind: str, key: str) -> Column:
    """Ids are numbers inside, in the order of their printed forms: the kind, then the digits from the left, then how many there are.

    Keys of more digits than the form asks for thus come where text puts them: 100000 before fffff. Keys under 0 or of more
    than 14 digits raise.
    """
    i, (_, form) = next((i, k) for i, k in enumerate(KINDS) if k[0] == kind)
    k = F.col(key).cast("long")
    placed = F.raise_error(F.lit(f"{key} is no key of a node")).cast("long")
    for n in range(DIGITS, int(form[4]) - 1, -1):
        placed = F.when(k < 16**n, k * 16 ** (15 - n) + (i << 60 | n)).otherwise(placed)
    return F.when(k >= 0, placed).when(k < 0, F.raise_error(F.lit(f"{key} is no key of a node")).cast("long"))


def number(kind: str, key: int) -> int:
    """The id of one key, as ``ident`` has it."""
    i, (_, form) = next((i, k) for i, k in enumerate(KINDS) if k[0] == kind)
    n = max(int(form[4]), len(f"{key:x}"))
    return key * 16 ** (15 - n) + (i << 60 | n)


def shown(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    key = F.call_function("shiftright", c.bitwiseAND(F.lit((1 << 60) - 1)), (60 - 4 * c.bitwiseAND(F.lit(15))).cast("int"))
    return F.coalesce(*(F.when(F.shiftright(c, 60) == i, F.format_string(form, key)) for i, (_, form) in enumerate(KINDS)))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    bank = lambda k: S.bank_of(F.col(k) * 37 % 65536)
    none = F.lit(None).cast("string")
    row = lambda name, kind, key, label, bank, text: t(spark, sf, name).select(ident(kind, key).alias("id"), F.lit(kind).alias("t"), F.col(label).alias("name"), bank.alias("bank"), text.alias("description"))
    p = row("part", "param", "p_partkey", "p_name", bank("p_partkey"), F.col("p_type"))
    f = row("supplier", "func", "s_suppkey", "s_name", F.lit("master"), none)
    r = row("customer", "ram", "c_custkey", "c_name", F.lit("slave"), F.col("c_mktsegment"))
    return p.unionByName(f).unionByName(r).unionByName(row("orders", "frpage", "o_orderkey", "o_orderpriority", none, none))


def raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem")
    func, item, page = ident("func", "l_suppkey"), ident("param", "l_partkey"), ident("frpage", "l_orderkey")
    k = F.when(F.col("l_returnflag") == "R", "read").when(F.col("l_returnflag") == "A", "write").otherwise("call")
    edge = lambda s, d, k, o: F.struct(s.alias("s"), d.alias("d"), k.alias("k"), o.alias("o"))
    code = edge(func, item, k, F.when(F.col("l_linestatus") == "O", "xref").otherwise("scan"))
    # Three edges a line from one scan.
    return li.select(F.explode(F.array(code, edge(page, item, F.lit("documents"), F.lit("fr")), edge(item, page, F.lit("documented"), F.lit("fr")))).alias("e")).select("e.*")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return raw_edges(spark, sf).dropDuplicates()


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """session, ts (seconds), seq, value, kind, k."""
    e = t(spark, sf, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("session"), ts.alias("ts"), F.col("event_id").alias("seq"), "value", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations: block, ord, out (first word), expr (text), reads (its distinct words)."""
    c = t(spark, sf, "conversations")
    w = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 4)
    c = c.select(F.col("conv_id").alias("block"), F.col("turn").alias("ord"), F.col("text").alias("expr"), F.col("role").alias("role"), w.alias("w"))
    return c.select("block", "ord", "expr", "role", F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("out"), F.array_distinct(F.col("w")).alias("reads"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Grid cells: vec_id, label, row, col, z."""
    e = t(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("at", "z"))
    return e.select("vec_id", "label", F.floor(F.col("at") / 8).cast("int").alias("row"), (F.col("at") % 8).alias("col"), F.col("z").cast("double").alias("z"))


SQL = """
WITH RECURSIVE nodes AS (
  SELECT printf('p:%05x', p_partkey) AS id, 'param' AS t, p_name AS name, CASE WHEN p_partkey * 37 % 65536 < 32768 THEN 'slave' ELSE 'master' END AS bank, p_type AS description FROM part
  UNION ALL SELECT printf('f:%06x', s_suppkey), 'func', s_name, 'master', NULL FROM supplier
  UNION ALL SELECT printf('r:%06x', c_custkey), 'ram', c_name, 'slave', c_mktsegment FROM customer
  UNION ALL SELECT printf('d:%06x', o_orderkey), 'frpage', o_orderpriority, NULL, NULL FROM orders),
edges AS (SELECT DISTINCT * FROM (
  SELECT printf('f:%06x', l_suppkey) AS s, printf('p:%05x', l_partkey) AS d, CASE l_returnflag WHEN 'R' THEN 'read' WHEN 'A' THEN 'write' ELSE 'call' END AS k, CASE l_linestatus WHEN 'O' THEN 'xref' ELSE 'scan' END AS o FROM lineitem
  UNION ALL SELECT printf('d:%06x', l_orderkey), printf('p:%05x', l_partkey), 'documents', 'fr' FROM lineitem
  UNION ALL SELECT printf('p:%05x', l_partkey), printf('d:%06x', l_orderkey), 'documented', 'fr' FROM lineitem)),
samples AS (SELECT user_id AS session, epoch_us(ts) / 1e6 AS ts, event_id AS seq, value, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
turns AS (SELECT conv_id AS block, turn AS ord, text AS expr, role, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: len(x) >= 4) AS w FROM conversations),
statements AS (SELECT block, ord, expr, role, coalesce(w[1], '') AS out, list_distinct(w) AS reads FROM turns),
cells AS (SELECT vec_id, label, CAST((i - 1) // 8 AS INTEGER) AS row, CAST((i - 1) % 8 AS INTEGER) AS col, CAST(embedding[i] AS DOUBLE) AS z FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings))
"""
