"""Hard negatives of anchors: rows of another label that score well, but clearly below a positive.

Vectors become integers, floor(``SCALE`` * component), so scores are exact. Rows are ordered by label and by a Hilbert
curve over the ``DIMS`` dimensions that spread most, and written as Parquet blocks of at most ``BLOCK`` rows of one
label; a hot label has many blocks. Each block's row has a zone map, the least and the greatest value of every
dimension. Interval arithmetic on it bounds an anchor's scores in the block from above and below, and only blocks whose
bounds meet what the anchor still looks for are read for it:

1. its own block gives ``positives`` scores at once; blocks of its label are read if their bound reaches the last of them;
2. each positive opens a window of scores; the block of another label with the highest bound is read first, and the
   score of the last place filled there raises the window's lower end;
3. blocks of other labels are read whose bounds meet an anchor's windows.

Anchors travel in groups of a few blocks' anchors. A group meets a block in one row of an equi-join on the block's
number, and the task multiplies two small matrices and keeps the best of each anchor; ranks then come from window
functions. The zone maps are joined in pages of some ``PAGE`` blocks and broadcast only below the bound of ``small``.
The work is that of the query set against the blocks that no bound rules out. On vectors without structure (random
directions in 64 dimensions) the bounds rule out almost none; on clustered ones most.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no part, nor do rows
with a component of 4096 or more in size, whose scores might not be exact; shorter vectors count as filled up with
zeros; each row of a repeated id takes part by itself, also as its twin's positive; ties go to the smaller id; an anchor
without positives or a window without rows gives nothing; other columns are ignored; an empty table gives an empty
result. Ids and labels are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, table, written

SCALE = 256
#: Components at least this large take no part.
MOST = 4096
BLOCK = 4096
PAGE = 512
DIMS, BITS = 15, 4
#: Anchors in a group, but for those of its last block.
GROUP = 1024
#: A window around a positive's score, in per cent.
LOW, HIGH = 50, 95


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on a Hilbert curve of each row of cells, in numbers of ``bits`` bits (Skilling's transposed form)."""
    x = cells.T.astype(np.int64, copy=True)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(len(x)):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(x[i] & q, q - 1, swap)
            x[i] ^= swap if i else 0
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | row >> b & 1
    return key


def whole(df: DataFrame, anchor: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """A written table of the rows that take part: row, id, label, anchor, v (integers)."""
    v, x = F.col(f"`{vector_col}`"), lambda c: c.cast("double")
    fit = F.forall(v, lambda c: F.coalesce(F.abs(x(c)) < MOST, F.lit(False)))  # a NaN is greater than all numbers
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.when(fit, F.transform(v, lambda c: F.floor(SCALE * x(c)).cast("int"))).alias("v"))
    return written(rows.dropna().select(F.monotonically_increasing_id().alias("row"), "*"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int32)
    out[np.arange(width) < size[:, None]] = flat
    return out


def best(scores: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the places ``at``, the n with the highest scores, the earlier of equal ones first."""
    s = scores[at]
    if len(at) > n:
        at = at[s >= np.partition(s, len(s) - n)[len(s) - n]]
    return at[np.argsort(-scores[at], kind="stable")[:n]]


def blocks(rows: DataFrame, width: int, axes: list[tuple[int, int, int]], positives: int) -> DataFrame:
    """A written table of blocks and of groups of anchors (block null).

    block, label, n, ids, keys (rows' numbers), lo, hi, v; in a group ids, keys, labels, v, and in floor the last of
    the best ``positives`` scores in the anchor's own block.
    """
    dims, lo, step = [a[0] for a in axes], np.array([a[1] for a in axes]), np.array([(a[2] - a[1]) // (1 << BITS) + 1 for a in axes])

    def placed(batches):
        for b in batches:
            x = matrix(b.column("v"), width)[:, dims]
            key = hilbert((x - lo) // step, BITS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], names=[*b.schema.names, "place"])

    none = {"block": None, "label": None, "n": None, "lo": None, "hi": None, "labels": None, "floor": None}

    def one(**columns):
        return pa.RecordBatch.from_pylist([none | columns], schema=pa.schema([(k, t) for k, t in SHAPE]))

    def cut(batches):
        made, group, left = TaskContext.get().partitionId() << 32, [], []

        def block(part):
            nonlocal made, group
            part = part.take(pa.compute.sort_indices(part, [("id", "ascending"), ("row", "ascending")]))
            v, at = matrix(part.column("v").combine_chunks(), width), np.flatnonzero(part.column("anchor").to_numpy(zero_copy_only=False))
            ids, keys = part.column("id").to_numpy(), part.column("row").to_numpy()
            yield one(kind="block", block=made, label=part.column("label")[0].as_py(), n=len(v), ids=ids.tobytes(), keys=keys.tobytes(), v=v.astype("<i4").tobytes(), lo=v.min(0).tolist(), hi=v.max(0).tolist())
            made += 1
            if len(at):
                floor = np.full(len(at), np.iinfo(np.int64).min)
                if len(v) > positives:
                    for i, a in enumerate(at):  # the row itself is one of the best, or others are as good
                        s = v @ v[a].astype(np.int64)
                        floor[i] = np.partition(np.delete(s, a), len(s) - 1 - positives)[len(s) - 1 - positives]
                group.append((ids[at], keys[at], part.column("label").to_numpy()[at], v[at], floor))
            if sum(len(g[0]) for g in group) >= GROUP:
                yield from grouped()

        def grouped():
            nonlocal group
            if group:
                ids, keys, labels, v, floor = (np.concatenate(x) for x in zip(*group, strict=True))
                yield one(kind="group", ids=ids.tobytes(), keys=keys.tobytes(), labels=labels.tobytes(), v=v.astype("<i4").tobytes(), floor=floor.tobytes())
            group = []

        def cuts(part, last):
            """Blocks of the rows so far; what may still grow stays."""
            nonlocal left
            label = part.column("label").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                while b - a >= BLOCK:
                    yield from block(part.slice(a, BLOCK))
                    a += BLOCK
                if b > a and (b < len(label) or last):
                    yield from block(part.slice(a, b - a))
                elif b > a:
                    left = [part.slice(a, b - a)]

        for batch in batches:
            part, left = pa.concat_tables([*left, pa.Table.from_batches([batch])]), []
            if part.num_rows:
                yield from cuts(part, False)
        if left:
            part, left = left[0], []
            yield from cuts(part, True)
        yield from grouped()

    order = ["label", "place", "id", "row"]
    tasks = rows.count() // (4 * BLOCK) + 1
    dealt = rows.mapInArrow(placed, "row long, id long, label long, anchor boolean, v array<int>, place long").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(cut, "kind string, block long, label long, n int, ids binary, keys binary, v binary, lo array<int>, hi array<int>, labels binary, floor binary"))


SHAPE = [("kind", pa.string()), ("block", pa.int64()), ("label", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("v", pa.binary()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("labels", pa.binary()), ("floor", pa.binary())]


def longs(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<i8")


def vectors(x: bytes, width: int) -> np.ndarray:
    """Doubles: sums of products of these integers are exact in them."""
    return np.frombuffer(x, "<i4").reshape(-1, width).astype(np.float64)


def chosen(groups: DataFrame, pages: DataFrame, n_pages: int, width: int, what: str) -> DataFrame:
    """(g, block, need): which anchors of a group must read which block. ``what``: positives, first or all.

    For positives a group has floor; else the windows of its anchors, ``windows`` array<struct<at, k, low, high>>.
    """

    def run(batches):
        for b in batches:
            rows = ([], [], [])
            for r in b.to_pylist():
                a, labels = vectors(r["v"], width), longs(r["labels"])
                zone = r["zones"]
                lo, hi = (np.array([z[c] for z in zone], np.float64).reshape(len(zone), width) for c in ("lo", "hi"))
                up, down = np.maximum(a, 0), np.minimum(a, 0)
                most, same = up @ hi.T + down @ lo.T, labels[:, None] == np.array([z["label"] for z in zone])
                if what == "positives":
                    need = same & (most >= longs(r["floor"])[:, None])
                else:
                    low, high = np.full(len(a), np.inf), np.full(len(a), -np.inf)
                    for w in r["windows"]:
                        low[w["at"]], high[w["at"]] = min(low[w["at"]], w["low"]), max(high[w["at"]], w["high"])
                    need = ~same & (most >= low[:, None]) & (up @ lo.T + down @ hi.T <= high[:, None])
                    if what == "first":
                        top = np.argmax(np.where(need, most, -np.inf), 1)
                        need &= np.arange(len(zone)) == top[:, None]
                for j in np.flatnonzero(need.any(0)).tolist():
                    for out, x in zip(rows, (r["g"], zone[j]["block"], np.flatnonzero(need[:, j]).astype("<i4").tobytes()), strict=True):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["g", "block", "need"])

    last = ["floor"] if what == "positives" else ["windows"]
    spread = groups.select("g", "v", "labels", *last, F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))).alias("page"))
    return spread.join(pages, "page").drop("page").mapInArrow(run, "g long, block long, need binary")


def read(pairs: DataFrame, groups: DataFrame, cells: DataFrame, width: int, what: str, n: int) -> DataFrame:
    """(g, at, k, anchor, id, score): the n best rows of each chosen block for each anchor that needs it, by window if not positives."""

    def run(batches):
        for b in batches:
            rows = ([], [], [], [], [], [])
            for r in b.to_pylist():
                need = np.frombuffer(r["need"], "<i4")
                ids, keys, names = longs(r["ids"]), longs(r["keys"]), longs(r["aids"])
                scores = vectors(r["v"], width)[need] @ vectors(r["bv"], width).T
                if what == "positives":
                    own = longs(r["akeys"])[need]
                    found = [(at, 0, s, best(s, np.flatnonzero(keys != o), n)) for at, s, o in zip(need.tolist(), scores, own, strict=True)]
                else:
                    found, place = [], {at: i for i, at in enumerate(need.tolist())}
                    for w in r["windows"]:
                        if (i := place.get(w["at"])) is not None:
                            s = scores[i]
                            found.append((w["at"], w["k"], s, best(s, np.flatnonzero((s >= w["low"]) & (s <= w["high"])), n)))
                for at, k, s, top in found:
                    for out, x in zip(rows, ([r["g"]] * len(top), [at] * len(top), [k] * len(top), [names[at]] * len(top), ids[top].tolist(), s[top].astype(np.int64).tolist()), strict=True):
                        out += x
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["g", "at", "k", "anchor", "id", "score"])

    mine = groups.select("g", "v", F.col("ids").alias("aids"), F.col("keys").alias("akeys"), *([] if what == "positives" else ["windows"]))
    other = cells.select("block", "ids", "keys", F.col("v").alias("bv"))
    return pairs.join(mine, "g").join(other, "block").drop("block").mapInArrow(run, "g long, at int, k int, anchor long, id long, score long")


def ranked(found: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    return found.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col(name) <= n)


def hard_negatives(df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = df.sparkSession
    rows = whole(df, anchor, id_col, vector_col, label_col)
    # A row for each dimension.
    spread = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.var_pop("x").alias("var")).collect()
    width = max(1, len(spread))
    axes = [(r.d, r.lo, r.hi) for r in sorted(spread, key=lambda r: (-r["var"], r.d))[:DIMS]] or [(0, 0, 0)]
    made = blocks(rows, width, axes, positives)
    cells = made.where("kind = 'block'")
    groups = written(made.where("kind = 'group'").select(F.monotonically_increasing_id().alias("g"), "ids", "keys", "labels", "v", "floor"))
    n_pages = cells.count() // PAGE + 1
    # Some 512 blocks a page.
    pages = written(cells.groupBy(F.pmod(F.xxhash64("block"), F.lit(n_pages)).cast("int").alias("page")).agg(F.collect_list(F.struct("block", "label", "lo", "hi")).alias("zones")))
    pages = small(pages) if n_pages <= 60_000_000 // (PAGE * (8 * width + 32)) else pages
    mine = small(groups)
    found = read(chosen(mine, pages, n_pages, width, "positives"), mine, cells, width, "positives", positives)
    pos = written(ranked(found, ["g", "at"], positives, "k"))
    # The least score with 100 * score >= low * positive, the greatest with 100 * score <= high * positive.
    floor = lambda x: f"(({x}) - pmod({x}, 100)) div 100"
    lo, hi = F.expr(f"-({floor(f'-score * {low}')})"), F.expr(floor(f"score * {high}"))
    windows = pos.select("g", "at", "k", lo.alias("low"), hi.alias("high")).where("low <= high")

    def looking(windows):
        per = windows.groupBy("g").agg(F.collect_list(F.struct("at", "k", "low", "high")).alias("windows"))
        return small(written(groups.join(per, "g").drop("floor")))

    mine = looking(windows)
    first = ranked(read(chosen(mine, pages, n_pages, width, "first"), mine, cells, width, "negatives", negatives), ["g", "at", "k"], negatives, "rank")
    raised = first.where(F.col("rank") == negatives).select("g", "at", "k", F.col("score").alias("floor"))
    mine = looking(windows.join(raised, ["g", "at", "k"], "left").withColumn("low", F.greatest("low", "floor")))
    found = ranked(read(chosen(mine, pages, n_pages, width, "all"), mine, cells, width, "negatives", negatives), ["g", "at", "k"], negatives, "rank")
    pos = pos.select("g", "at", "k", F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pos, ["g", "at", "k"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vec, label = F.col("vec_id"), F.col("label")
    rows = rows.select("vec_id", "embedding", F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives(rows, vec % 50 == 0)


#: The contract as brute force over all pairs of an anchor and a row.
ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 3
"""
QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES: dict[str, str] = {"op12_hard_negatives": ORACLE}
