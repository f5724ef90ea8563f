"""Balanced label propagation: linked documents move to one shard while shards keep even sizes.

Documents of equal text are linked. All members of such a group are alike, so the state is a table of
blocks (group, shard, members), far smaller than the documents and free of pairs. A round joins each
group's blocks with its tally over shards; blocks move to the shard that holds most of the group and has
room, within that shard's quota (its room up to the capacity and what leaves it). A group larger than a
shard moves in part and ends on as few shards as hold it. Unlinked documents are blocks of one that stay
where their id's hash put them. At last whole blocks, smallest first, even the shards out to within about
half a small document. Only per-shard sums come to the driver.

Defined cases: a null text has no bytes, so size 1 and a group with the empty texts; repeated rows are
copies; a null id is placed like any other; a table with fewer rows than shards leaves shards empty; an
empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, small, table, written

SHARDS = 8
ROUNDS = 6
#: Capacity during propagation, as a multiple of the mean size.
SLACK = 1.02
GROUP = ["g", "size"]


def _loads(blocks: DataFrame, shards: int, where: str = "true") -> list[int]:
    got = {r[0]: int(r[1]) for r in blocks.where(where).groupBy("shard").agg(F.sum(F.col("n") * F.col("size"))).collect()}
    return [got.get(s, 0) for s in range(shards)]


def _at(values: list, c: str = "shard"):
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col(c) + 1)


def propagate(blocks: DataFrame, shards: int, rounds: int) -> DataFrame:
    """Moves the blocks of groups of two or more."""
    total = sum(_loads(blocks, shards))
    cap = SLACK * total / shards
    for k in range(rounds):
        load = _loads(blocks, shards, "members > 1")
        room = [max(0.0, cap - x) for x in load]
        group = W.partitionBy(*GROUP)
        linked = blocks.where("members > 1")
        pull = F.struct((_at(room) > F.col("size")).alias("open"), F.col("n").alias("n"), F.hash(F.lit(k), "g", "shard").alias("tie"), F.col("shard").alias("shard"))
        wish = written(linked.withColumn("to", F.max(pull).over(group)["shard"]).withColumn("w", (F.col("n") * F.col("size")).cast("double")))
        flow = {(r[0], r[1]): r[2] for r in wish.where("to != shard").groupBy("shard", "to").agg(F.sum("w")).collect()}
        if not flow:
            break
        come, go = ([sum(v for x, v in flow.items() if x[i] == s) for s in range(shards)] for i in (1, 0))
        part = [min(1.0, (room[s] + 0.9 * min(go[s], come[s])) / come[s]) if come[s] else 0.0 for s in range(shards)]
        quota = [room[s] + 0.9 * min(go[s], come[s]) for s in range(shards)]
        share, draw = _at(part, "to"), F.pmod(F.hash(F.lit(1000 + k), "g", "shard"), F.lit(1 << 20)) / float(1 << 20)
        # Blocks above a 64th of a shard are few; of these the smallest fill the quota first, so that they go whole.
        large = (F.col("w") > cap / 64) & (F.col("to") != F.col("shard"))
        before = F.sum(F.when(large, F.col("w")).otherwise(0)).over(W.partitionBy("to").orderBy("w", "g", "shard").rowsBetween(W.unboundedPreceding, -1))
        big = wish.where(large).withColumn("before", F.coalesce(before, F.lit(0.0)))
        big = big.withColumn("moved", F.floor(F.least(F.col("w"), F.greatest(F.lit(0.0), _at(quota, "to") - F.col("before"))) / F.col("size")).cast("long")).drop("before")
        moved = F.when(F.col("to") == F.col("shard"), 0).when(draw < share, F.col("n")).otherwise(0).cast("long")
        wish = wish.where(~large).withColumn("moved", moved).unionByName(big)
        after = wish.select(*GROUP, "shard", (F.col("n") - F.col("moved")).alias("n"), "members").unionByName(wish.select(*GROUP, F.col("to").alias("shard"), F.col("moved").alias("n"), "members")).where("n > 0")
        after = after.groupBy(*GROUP, "shard").agg(F.sum("n").alias("n"), F.max("members").alias("members"))
        blocks = written(blocks.where("members = 1").unionByName(after, allowMissingColumns=True))
    return blocks


def even_out(blocks: DataFrame, shards: int) -> DataFrame:
    """Moves whole blocks, the smallest first, from shards above the mean to those below."""
    load = _loads(blocks, shards)
    mean = sum(load) / shards
    gives = [[s, load[s] - mean, 0.0] for s in range(shards) if load[s] > mean]
    takes = [[s, mean - load[s]] for s in range(shards) if load[s] < mean]
    moves = []
    for give in gives:
        while give[1] > 0.5 and takes:
            x = min(give[1], takes[0][1])
            moves.append((give[0], give[2], give[2] + x, takes[0][0]))
            give[1], give[2], takes[0][1] = give[1] - x, give[2] + x, takes[0][1] - x
            if takes[0][1] <= 0.5:
                takes.pop(0)
    if not moves:
        return blocks
    # At most two moves a shard: their limits are constants of the plan.
    blocks = blocks.withColumn("w", F.col("n") * F.col("size"))
    most = {s: max(m[2] for m in moves if m[0] == s) for s in {m[0] for m in moves}}
    sums = blocks.groupBy("shard", "w").agg(F.sum("w").alias("sw"))
    by_w = W.partitionBy("shard").orderBy("w").rowsBetween(W.unboundedPreceding, -1)
    limit = F.coalesce(*(F.when(F.col("shard") == s, F.lit(x)) for s, x in most.items()), F.lit(-1.0))
    low = sums.withColumn("before", F.coalesce(F.sum("sw").over(by_w), F.lit(0))).where(F.col("before") < limit).select(F.col("shard").alias("_s"), F.col("w").alias("_w"), "before")
    low = small(written(low))
    moving = written(blocks.join(low, (F.col("shard") == F.col("_s")) & (F.col("w") == F.col("_w"))).drop("_s", "_w"))
    moving = numbered(moving, ["shard", "w"], ["g"], "k")
    place = F.col("before") + (F.col("k") + 0.5) * F.col("w")
    to = F.coalesce(*(F.when((F.col("shard") == s) & (place > a) & (place <= b), F.lit(t)) for s, a, b, t in moves), F.col("shard")) if moves else F.col("shard")
    moved = moving.withColumn("shard", to.cast("int")).select(*blocks.columns)
    stay = blocks.join(low, (F.col("shard") == F.col("_s")) & (F.col("w") == F.col("_w")), "left_anti")
    out = stay.unionByName(moved).groupBy(*GROUP, "shard").agg(F.sum("n").alias("n"), F.max("members").alias("members"))
    return written(out)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per document: id, size, text_crc32, law, shard, slot (0, 1, ... in the shard), grown_shard (null)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text, F.crc32(text)).alias("g"), F.monotonically_increasing_id().alias("row"))
    # Written, so the row numbers stand; they tell rows of one id apart.
    base = written(base)
    first = base.groupBy(*GROUP, F.pmod(F.xxhash64("id", "row"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    blocks = written(first.withColumn("members", F.sum("n").over(W.partitionBy(*GROUP))))
    blocks = propagate(blocks, shards, rounds)
    for _ in range(3):
        blocks = even_out(blocks, shards)
    counted = blocks.withColumn("parts", F.count("*").over(W.partitionBy(*GROUP)))
    whole = counted.where("parts = 1").select(*GROUP, "shard")
    below = W.partitionBy(*GROUP).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    split = written(counted.where("parts > 1").withColumn("lo", F.coalesce(F.sum("n").over(below), F.lit(0))).select(*GROUP, "shard", "lo", (F.col("lo") + F.col("n")).alias("hi")))
    split_groups = small(written(split.select(*GROUP).distinct()))
    one = base.join(split_groups, GROUP, "left_anti").join(small(written(whole)), GROUP)
    many = numbered(written(base.join(split_groups, GROUP, "left_semi")), GROUP, ["id", "row"], "k")
    many = many.join(small(split), GROUP).where("k >= lo and k < hi").select(*base.columns, "shard")
    out = written(one.select(*base.columns, "shard").unionByName(many))
    out = numbered(out, ["shard"], ["id", "row"], "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
