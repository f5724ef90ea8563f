"""Helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that a side may have to be broadcast; beyond either the join is shuffled.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without: elsewhere each executor would write to its own disk."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="calgraph-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Tables that were written and not yet deleted.
_MADE: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: later jobs start there, whatever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/calgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """Paths of the tables that stand now."""
    return list(_MADE)


def discard(spark: SparkSession, keep: DataFrame, older: list[str]) -> None:
    """Deletes the tables written since ``older`` was taken, but for the one that ``keep`` is. ``keep`` must not need them."""
    kept = keep.inputFiles()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in [p for p in _MADE if p not in older and not any(p.rsplit("/", 1)[1] in f for f in kept)]:
        _MADE.remove(path)
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if it has at most ``rows`` rows and about ``most`` bytes."""
    fixed = 16 + 8 * len(df.columns)
    long = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    n, *bytes_ = df.limit(rows + 1).agg(F.count("*"), *long).first()
    return F.broadcast(df) if n <= rows and n * fixed + sum(bytes_) <= most else df


def sent(spark: SparkSession, path: str, most: int = 16 << 20):
    """A broadcast of a file's bytes; Spark reads it, so ``path`` may be any URI that it knows. Raises beyond ``most`` bytes."""
    file = spark.read.format("binaryFile").load(path)
    size = file.agg(F.max("length")).first()[0]
    if size > most:
        raise ValueError(f"{path} has {size} bytes; {most} are allowed")
    return spark.sparkContext.broadcast(bytes(file.select("content").first()[0]))


_KEPT: dict = {}


def kept(held: list, make):
    """make(*contents) of broadcast files, one in a Python worker: it stays for the worker's next tasks, so its memo must be bounded."""
    key = make.__qualname__, *(zlib.crc32(h.value) for h in held)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make(*(h.value for h in held))
    return _KEPT[key]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, though lambdas within the body use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts_of(total: int, each: int, most: int = 65_535) -> int:
    """Hash buckets for grouped Python work, so that each holds about ``each`` of a measured total; at least 16."""
    return max(16, min(most, total // each + 1))


def numbered(df: DataFrame, parts: list[str], order: list[str], name: str) -> DataFrame:
    """Adds 0, 1, ... within each combination of ``parts`` without bringing a part into one task.

    Rows are numbered in hash buckets of ``order``, which should tell rows apart; bucket sizes, summed before
    they are shuffled, give the buckets' offsets. ``df`` must be a written table. Buckets grow with the root of
    the row count.
    """
    n = int(df.count() ** 0.5) + 1
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)))
    sizes = df.groupBy(*parts, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*parts).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*(F.col(p).alias(f"_{p}") for p in parts), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    offsets = small(written(offsets))
    inner = F.row_number().over(W.partitionBy(*parts, "_b").orderBy(*order)) - 1
    on = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts] + [F.col("_b") == F.col("_c")]
    return df.withColumn("_r", inner).join(offsets, on).withColumn(name, (F.col("_r") + F.col("_o")).cast("long")).drop("_b", "_c", "_r", "_o", *(f"_{p}" for p in parts))
