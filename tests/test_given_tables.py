"""Queries on small tables whose rows the given tables have only at size, against their SQL."""

import duckdb
import pytest
from compare import assert_same
from pyspark.sql import functions as F

import __spark_entry__ as entry
from calgraph.plans import base as b


def held(spark, folder, query, **tables):
    """Writes tables(SQL by name) to the folder and holds the query on them against its SQL."""
    db = duckdb.connect()
    for name, sql in tables.items():
        db.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    assert_same(entry.queries()[query](spark, str(folder)), entry.oracle_sql()[query], db)


def test_words_of_hexadecimal_letters_are_no_addresses(spark, tmp_path):
    words = ["edeaed", "decade", "facades", "aaaaaaaa", "wint", "bint", "dada", "motor"]
    turns = ", ".join(f"({i}, {k}, 'user', '{w} {v} {w}')" for i, (w, v) in enumerate(zip(words, reversed(words), strict=True)) for k in range(5))
    held(spark, tmp_path, "symbol_tests", conversations=f"SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM (VALUES {turns}) AS v(conv_id, turn, role, text)")


#: Whole thousandths in 32 bits, some of them just below or above: 64 a vector.
_NEAR = "SELECT vec_id::BIGINT AS vec_id, list_transform(range(64), lambda i: CAST(((i * 37 + vec_id * 64) % 4001 - 2000) / 1000.0 AS FLOAT)) AS embedding, 0 AS label FROM range(60) AS t(vec_id)"


def test_images_hold_what_a_product_of_32_bits_gives(spark, tmp_path):
    held(spark, tmp_path, "decode_images", embeddings=_NEAR)


def test_changed_words_of_products_of_32_bits(spark, tmp_path):
    held(spark, tmp_path, "changed_words", embeddings=_NEAR)


def test_values_on_a_threshold_keep_the_state(spark, tmp_path):
    """A session for each k: above the upper threshold, then on the lower one, then by the idle pair."""
    at = "CASE i % 7 WHEN 0 THEN 20.2 + k / 5.0 WHEN 1 THEN 14 + k / 5.0 WHEN 2 THEN 20 + k / 5.0 - 6.0 WHEN 3 THEN 1.7 WHEN 4 THEN 1.8 WHEN 5 THEN 20 + k / 5.0 ELSE 2 END"
    held(spark, tmp_path, "engine_state", events=f"SELECT (k * 100 + i)::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, k::BIGINT AS user_id, 'view' AS event_type, CAST({at} AS DOUBLE) AS value, '{{\"k\": ' || k || '}}' AS props FROM range(100) AS a(k), range(14) AS b(i)")


#: Items whose keys, and sixteen times the keys, have more and more hexadecimal digits.
_FAR = "SELECT k::BIGINT AS p_partkey, 'red bolt' AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, (k % 50 + 1)::INTEGER AS p_size, 900.5 AS p_retailprice FROM (SELECT unnest([0, 1, 15, 65535, 1048575, 1048576, 1199999, 16777215, 16777216, 268435456, 7000000000]) AS k)"


def test_addresses_of_more_than_six_digits(spark, tmp_path):
    held(spark, tmp_path, "description_checks", part=_FAR)


#: Tables that the SQL's views name and these queries have no need of.
_OTHERS = {
    "part": "SELECT 0 AS p_partkey, '' AS p_name, '' AS p_type WHERE false", "supplier": "SELECT 0 AS s_suppkey, '' AS s_name WHERE false", "customer": "SELECT 0 AS c_custkey, '' AS c_name, '' AS c_mktsegment WHERE false",
    "orders": "SELECT 0 AS o_orderkey, '' AS o_orderpriority WHERE false", "events": "SELECT 0 AS user_id, now()::TIMESTAMP AS ts, 0 AS event_id, 0 AS value, '' AS event_type, '' AS props WHERE false",
    "conversations": "SELECT 0 AS conv_id, 0 AS turn, '' AS role, '' AS text WHERE false", "embeddings": "SELECT 0 AS vec_id, 0 AS label, [0.5] AS embedding WHERE false",
}
#: Lines of functions and pages whose keys, and those of their items, pass the digits that an id has.
_LINES = """SELECT o::BIGINT AS l_orderkey, p::BIGINT AS l_partkey, s::BIGINT AS l_suppkey, CASE (p + s) % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS l_returnflag, CASE p % 2 WHEN 0 THEN 'O' ELSE 'F' END AS l_linestatus
FROM (SELECT unnest(range(1048560, 1048600)) AS p), (SELECT unnest([1, 2, 16777215, 16777216]) AS s), (SELECT unnest([16777214, 16777215, 16777216, 16777300]) AS o)"""


def test_children_of_long_keys_are_in_order_of_their_ids(spark, tmp_path):
    held(spark, tmp_path, "rank_children", lineitem=_LINES, **_OTHERS)


def test_tree_of_long_keys(spark, tmp_path):
    held(spark, tmp_path, "expand_tree", lineitem=_LINES, **_OTHERS)


def test_ids_are_numbers_in_order_of_what_they_show(spark):
    keys = [0, 1, 15, 16, 0xFFFFF, 0x100000, 0xFFFFFF, 0x1000000, 0x1000001, 0xABCDEF01, 16**14 - 1]
    for kind, form in b.KINDS:
        rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", b.ident(kind, "k").alias("id")).select("k", "id", b.shown("id").alias("s")).collect()
        assert [(r.id, r.s) for r in rows] == [(b.number(kind, k), form % k) for k in keys]
        assert [r.s for r in sorted(rows, key=lambda r: r.id)] == sorted(form % k for k in keys)
    assert spark.sql("SELECT CAST(NULL AS LONG) AS k").select(b.ident("ram", "k").alias("id")).collect() == [(None,)]
    for wrong in (-1, 16**14):
        with pytest.raises(Exception, match="no key of a node"):
            spark.range(1).select(F.lit(wrong).alias("k")).select(b.ident("ram", "k")).collect()
