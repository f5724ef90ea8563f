"""Reading and writing, with explicit schemas."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

EXPORT = "functions array<struct<addr: long, name: string, named: boolean, size: long, thunk: boolean, plate: string>>, symbols array<struct<addr: long, name: string, region: string, type: string, primary: boolean, user: boolean>>, refs array<struct<s: long, d: long, k: string, o: string>>"
AXIS = "struct<_id: string, EMBEDDEDDATA: struct<_mmedaddress: string, _mmedelementsizebits: int, _mmedrowcount: int, _mmedcolcount: int, _mmedmajorstridebits: int, _mmedtypeflags: string>, units: string, MATH: struct<_equation: string>, LABEL: array<struct<_index: int, _value: string>>>"
ITEM = f"_uniqueid string, title string, description string, units string, CATEGORYMEM array<struct<_index: int, _category: int>>, XDFAXIS array<{AXIS}>, EMBEDDEDDATA struct<_mmedaddress: string, _mmedelementsizebits: int>, MATH struct<_equation: string>"
LOG = "session string, ts double, signal string, raw long"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without; elsewhere each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="calgraph-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared folder, so that plans do not grow with a loop and nothing is computed twice."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """(id, de, en, raw) of the header's categories: a hexadecimal index and a name 'German (English)'."""
    raw = spark.read.format("xml").option("rowTag", "XDFHEADER").schema("CATEGORY array<struct<_index: string, _name: string>>").load(path)
    c = raw.select(F.inline("CATEGORY")).select(S.hex_index(F.col("_index")).alias("id"), F.coalesce("_name", F.lit("")).alias("raw"))
    both = S.bilingual(F.col("raw"))
    return c.select("id", F.trim(both["de"]).alias("de"), F.trim(both["en"]).alias("en"), "raw")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """One row: title, author, fileversion and baseoffset of a definition file."""
    raw = spark.read.format("xml").option("rowTag", "XDFHEADER").schema("deftitle string, author string, fileversion string, BASEOFFSET struct<_offset: string>").load(path)
    return raw.select(F.col("deftitle").alias("title"), "author", "fileversion", F.coalesce(F.col("BASEOFFSET._offset").try_cast("long"), S.hex_index(F.col("BASEOFFSET._offset")), F.lit(0)).alias("baseoffset"))


def axis_address(axis: Column) -> Column:
    return S.hex_index(axis["EMBEDDEDDATA"]["_mmedaddress"])


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Constants, curves and maps as one table of items with their axes.

    address: where an item begins, the least of its axes'; data_address: the plane that holds the values, z of a
    map, y of a curve. category_ids are distinct and in order.
    """
    kinds = {"XDFCONSTANT": "constant", "XDFFUNCTION": "curve", "XDFTABLE": "map"}
    parts = [spark.read.format("xml").option("rowTag", tag).schema(ITEM).load(path).withColumn("kind", F.lit(kind)) for tag, kind in kinds.items()]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    own, axes = S.hex_index(F.col("EMBEDDEDDATA._mmedaddress")), F.coalesce("XDFAXIS", F.expr(f"cast(array() as array<{AXIS}>)"))
    of = lambda name: axis_address(F.get(F.filter(axes, lambda a: a["_id"] == name), F.lit(0)))
    least = F.array_min(F.transform(axes, axis_address))
    constant = F.col("kind") == "constant"
    has = lambda name: F.exists(axes, lambda a: a["_id"] == name)
    ids = S.category_ids(F.transform(F.filter("CATEGORYMEM", lambda c: c["_category"].isNotNull()), lambda c: c["_category"]))
    return out.select(
        F.col("_uniqueid").alias("uid"), "kind", F.coalesce("title", F.concat(F.lit("unnamed_"), "_uniqueid")).alias("name"), "description", "units", F.col("MATH._equation").alias("equation"),
        F.when(constant, own).otherwise(least).alias("address"), F.when(constant, own).when(has("z"), of("z")).otherwise(of("y")).alias("data_address"), F.when(constant, F.coalesce(F.nullif("EMBEDDEDDATA._mmedelementsizebits", F.lit(0)), F.lit(16))).alias("bits"),
        F.coalesce(ids, F.array().cast("array<int>")).alias("category_ids"), F.col("XDFAXIS").alias("axes"),
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("image"), "content")


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """bank and address from the path, the file's text as code."""
    part = lambda i: F.regexp_extract("_metadata.file_path", r"/(master|slave)/([0-9a-fA-F]+)\.txt$", i)
    return spark.read.text(path, wholetext=True).select(part(1).alias("bank"), F.conv(part(2), 16, 10).cast("long").alias("addr"), F.col("value").alias("code"))


def read_export(spark: SparkSession, path: str, bank: str) -> dict[str, DataFrame]:
    raw = spark.read.schema(EXPORT).option("multiLine", True).json(path)
    return {name: raw.select(F.inline(name)).withColumn("bank", F.lit(bank)) for name in ("functions", "symbols", "refs")}


def split_pages(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, page, text): numbered from 1; blank pages count but are dropped."""
    return docs.select(doc, F.posexplode(F.split(text, "\f")).alias("p", "text")).select(doc, (F.col("p") + 1).alias("page"), "text").where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON map; a missing file is an empty table."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "key string, value string")
    return raw.select(F.explode(F.from_json("value", "map<string, string>")))


def read_log(spark: SparkSession, path: str, schema: str = LOG, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(schema).option("header", True).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, **tables: DataFrame) -> None:
    """Nodes by kind and edges by origin, and further tables (documents, coverage, categories, names) in folders of their names."""
    nodes.write.mode("overwrite").partitionBy("t").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("o").parquet(f"{path}/edges")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def write_listings(listings: DataFrame, path: str) -> None:
    """By bank and in order of address, so that a reader prunes files and row groups."""
    listings.repartitionByRange("bank", "addr").sortWithinPartitions("bank", "addr").write.mode("overwrite").partitionBy("bank").parquet(path)
