"""Mixing sources to target weights by Pareto order sampling.

Targets: sources, in code point order with null last, have the given weights in turn and share all words
by weight; a target stops at ``max_copies`` times its source's words, and the excess is shared again.
Since every uncapped source ends at the same multiple of its weight, that multiple follows from one
ordered pass over the sources (one row each).

Copies: a document's expected copies are its propensity times a factor of its source, at most
``max_copies``, so that the source's expected words are its target. Propensity rises slowly with length,
by tiers of powers of two, so a source has at most 64 tiers and the factor follows in the same way.
The whole part of the expected copies is certain. The rest is an inclusion probability p, and the
documents are ranked by Pareto's order: random odds u / (1 - u) divided by p / (1 - p). The first of them
are taken as long as the source's words stay within the target, then the one later document that fits
the gap best.

The ranking is never gathered: ranks go to sqrt(rows) buckets of a source, the buckets' words are summed
before the shuffle, and only the bucket that holds the threshold is ordered. A decision then compares a
row with its source's threshold, so texts are not shuffled.

Random numbers depend on the seed, on a hash of id, text and source, and for rows that agree in all of these
on a copy number, so reruns agree and each row has a draw of its own, with or without an id.

Defined cases: a null or blank text has size 0 and takes nothing; a null source is a source of its own; an
empty table gives an empty result; other columns pass through unchanged, but in ``mixed`` one that has the
name of a result is replaced by it. Texts are counted twice, once for the plan and once for the result,
which costs less than moving or writing them. Sources are expected to be few: they are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, small, table, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
SEED = 20240229


def _source(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("z"))


def _key(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"), _source(source_col))


def _draw() -> Column:
    """Uniform in (0, 1), a number for each key and copy."""
    return (F.xxhash64(F.lit(SEED), "key", "copy").bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def _with_copy(rows: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """Adds copy: 0, 1, ... for rows that share their key. Only these rows are moved."""
    if repeats is None:
        return rows.withColumn("copy", F.lit(0).cast("long"))
    again = written(rows.join(repeats, "key", "left_semi").withColumn("place", F.monotonically_increasing_id()))
    again = numbered(again, ["key"], ["place"], "copy").drop("place")
    return rows.join(repeats, "key", "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(again)


def _order(u: Column, p: Column) -> Column:
    """Pareto's order mapped to (0, 1)."""
    q = u / (1 - u) * (1 - p) / p
    return q / (1 + q)


def _filled(df: DataFrame, parts: list[str], total: str, size: str, weight: str, cap: str, out: str) -> DataFrame:
    """Shares ``total`` by weight times size, each at most cap times size: adds the share of one unit of size.

    Rows must be few per part: sources, or tiers of one source.
    """
    w = W.partitionBy(*parts).orderBy(F.col(cap) / F.col(weight), *[c for c in ("source_key", "tier") if c in df.columns])
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(0, W.unboundedFollowing)
    left = F.col(total) - F.coalesce(F.sum(F.col(cap) * F.col(size)).over(before), F.lit(0.0))
    df = df.withColumn("_f", F.try_divide(left, F.sum(F.col(weight) * F.col(size)).over(after)))
    fits = F.when(F.col("_f") * F.col(weight) <= F.col(cap) * (1 + 1e-12), F.col("_f"))
    df = df.withColumn("_f", F.coalesce(F.first(fits, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0.0)))
    return df.withColumn(out, F.least(F.col("_f") * F.col(weight), F.col(cap))).drop("_f")


def plan(sized: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source and length tier of sized(key, copy, source_key, size): target, certain copies, p, and the threshold in Pareto's order."""
    sized = sized.withColumn("tier", _tier(F.col("size"))).withColumn("u", _draw())
    tiers = written(sized.groupBy("source_key", "tier").agg(F.sum("size").alias("tier_size"), F.count("*").alias("tier_rows")))
    n = tiers.agg(F.sum("tier_rows")).first()[0] or 0
    all_ = W.partitionBy(F.lit(0))
    turn = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(all_.orderBy("source_key")) - 1) % len(weights) + 1).cast("int"))
    sources = tiers.groupBy("source_key").agg(F.sum("tier_size").alias("source_size")).withColumn("w", turn).withColumn("total", F.sum("source_size").over(all_).cast("double"))
    sources = sources.withColumn("cap", F.lit(float(max_copies)) * F.col("source_size")).withColumn("one", F.lit(1.0)).withColumn("none", F.lit(0))
    sources = _filled(sources, ["none"], "total", "one", "w", "cap", "target").select("source_key", "source_size", "target")
    tiers = tiers.join(sources, "source_key").withColumn("v", 1 + F.col("tier") / 8.0).withColumn("cap", F.lit(float(max_copies)))
    tiers = _filled(tiers, ["source_key"], "target", "tier_size", "v", "cap", "expected")
    certain = F.floor(F.col("expected") + 1e-9).cast("int")
    tiers = tiers.withColumn("certain", certain).withColumn("p", F.greatest(F.col("expected") - certain, F.lit(0.0))).withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))
    tiers = tiers.withColumn("rest", F.col("target") - F.sum(F.col("certain") * F.col("tier_size")).over(W.partitionBy("source_key")))
    tiers = written(tiers.select("source_key", "tier", "source_size", "target", "certain", "p", "rest"))
    m = float(int(n**0.5) + 8)
    ranked = sized.join(small(tiers), ["source_key", "tier"]).where("p > 0 and size > 0").withColumn("place", _order(F.col("u"), F.col("p"))).withColumn("bucket", F.floor(F.col("place") * m))
    ranked = ranked.select("source_key", "bucket", "place", "key", "copy", "size", "rest")
    sums = ranked.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    run = F.sum("words").over(W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    edge = sums.withColumn("run", run).where("run >= rest and run - words < rest").select("source_key", "bucket", (F.col("run") - F.col("words")).alias("before"))
    edge = small(written(edge))
    inside = ranked.join(edge, ["source_key", "bucket"])
    run = F.col("before") + F.sum("size").over(W.partitionBy("source_key").orderBy("place", "key", "copy").rowsBetween(W.unboundedPreceding, 0))
    inside = inside.withColumn("run", run).where("run <= rest")
    last = inside.groupBy("source_key").agg(F.max(F.struct("place", "key", "copy")).alias("last"), F.max("run").alias("run"))
    low = F.lit(-(1 << 63)).cast("long")
    start = F.struct((F.col("bucket") / m).alias("place"), low.alias("key"), low.alias("copy"))
    full = small(written(edge.join(last, "source_key", "left").select("source_key", F.coalesce("last", start).alias("last"), F.coalesce("run", "before").alias("run"))))
    gap = F.col("rest") - F.col("run")
    after = ranked.join(full, "source_key").where((F.struct("place", "key", "copy") > F.col("last")) & (F.col("size") < 2 * gap))
    fill = after.groupBy("source_key").agg(F.min_by(F.struct("place", "key", "copy"), F.struct(F.abs(F.col("size") - gap), "place", "key", "copy")).alias("fill"))
    everything = F.struct(F.lit(2.0).alias("place"), low.alias("key"), low.alias("copy"))
    out = tiers.join(full.drop("run"), "source_key", "left").join(fill, "source_key", "left")
    return written(out.withColumn("last", F.coalesce("last", F.when(F.col("rest") > 0.5, everything))).drop("rest"))


def _tier(size: Column) -> Column:
    return F.floor(F.log2(size + 1.0)).cast("int")


def _decided(docs: DataFrame, id_col: str, text_col: str, source_col: str, **how) -> DataFrame:
    """(row, size, source_size, target, copies); row holds the input's columns, whose names cannot clash there."""
    base = [_key(id_col, text_col, source_col).alias("key"), _source(source_col).alias("source_key"), word_count(F.col(text_col).cast("string")).alias("size")]
    sized = written(docs.select(*base))
    repeats = written(sized.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    repeats = None if repeats.isEmpty() else small(repeats)
    how_many = small(plan(_with_copy(sized, repeats), **how))
    rows = _with_copy(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *base), repeats)
    rows = rows.withColumn("tier", _tier(F.col("size"))).withColumn("u", _draw()).join(how_many, ["source_key", "tier"])
    place = F.struct(_order(F.col("u"), F.col("p")).alias("place"), "key", "copy")
    drawn = (F.col("p") > 0) & (F.coalesce(place <= F.col("last"), F.lit(False)) | F.coalesce(place == F.col("fill"), F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("certain") + drawn.cast("int")).otherwise(0)
    return rows.select("row", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents with _size, _source_size, _target and _copies."""
    out = _decided(docs, id_col, text_col, source_col, **how)
    names = ("size", "source_size", "target", "copies")
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in {f"_{n}" for n in names}]
    return out.select(*own, *(F.col(n).alias(f"_{n}") for n in names))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    out = _decided(docs, id_col, text_col, source_col, **how).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
