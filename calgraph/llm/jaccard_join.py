"""Near-duplicate join on word shingles by parity sketches.

A text's set is its distinct five-word shingles. A parity sketch splits the hash range into P pieces;
the symbol of a piece is the XOR of the hashes that fall into it, so one more or one less shingle
changes one symbol. The Hamming distance of two sketches (symbols that differ) is thus at most the
symmetric difference of the sets. A pair with a Jaccard index of at least p % has a symmetric
difference of at most d = (100 - p) / (100 + p) * (sizes' sum), so all but d symbols agree.

1. ``sets``: per document the set's hash and size, and a 512-bit parity sketch.
2. ``keys``: per size band (powers of two of the smaller set) each non-empty symbol is a key. Equal
   sets of a task count once. Keys go to hash buckets as packed blocks.
3. Per bucket, keys that only one set has are dropped. A set with more than d such keys in a band can
   have no partner there and leaves.
4. The others keep their d + 1 keys with the fewest sets. Symbols that agree, ordered by that
   frequency, must begin within these, so common passages rarely make candidates.
5. Groups of at most 16 give all pairs. A larger one is held against a few leaders, those with the fewest
   keys of their own, likely originals. In a second round its members outside its largest component are
   held against all of other components, so no link between components is lost. The tasks drop pairs
   whose 512-bit sketches differ in more bits than the sets may, and pass on the rest as packed blocks.
6. Pairs, each once, take the exact test on their texts.

Defined cases: null or blank text has an empty set, size 0 and no links; fewer than five words make one
shingle of all words; repeated rows are copies of each other; a null id never becomes a component's id
unless nothing else is in it; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import parts_of, small, table, written
from .components import components

SKETCH_BITS = 512
#: Members of a key's group that may be paired freely, and leaders that a larger group is held against in the first round.
ALL_PAIRS = 16
FIRST_LEADERS = 3
#: Packed keys that a bucket should hold.
BUCKET_BYTES = 4_000_000
#: Members of keys that a task compares at once, about.
GROUP_ROWS = 40_000


def band(n: np.ndarray) -> np.ndarray:
    """The smallest b with n <= 2 ** b."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def piece_bits(b: np.ndarray) -> np.ndarray:
    """Log2 of the pieces in a band. Few tokens get many pieces, so that hardly two share one."""
    return np.where(b <= 4, 12, np.where(b <= 8, b + 1, b - 1))


def bound(n: np.ndarray, low: np.ndarray, percent: int) -> np.ndarray:
    """Most symbols in which a set of n may differ from a partner, in its own band or in the one below."""
    partner = np.where(low, 1 << np.maximum(band(n) - 1, 0), n * 100 // percent)
    return (n + partner) * (100 - percent) // (100 + percent)


def goes_low(n: np.ndarray, percent: int) -> np.ndarray:
    return (band(n) >= 1) & (n * percent <= 100 << np.maximum(band(n) - 1, 0))


def set_ids(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set as a signed integer with a clear last bit; 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mix64(values ^ np.uint64(0xA5A5)))])
    n = np.diff(first)
    ids = B.mix64((sums[first[1:]] - sums[first[:-1]]) + n.astype(np.uint64)) & np.uint64(0xFFFFFFFFFFFFFFFE)
    return np.where(n > 0, ids, 0).astype(np.uint64).view(np.int64)


def pieces(values: np.ndarray, first: np.ndarray, rows: np.ndarray, low: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the non-empty pieces of the given rows' sketches, and the row of each."""
    n = first[rows + 1] - first[rows]
    b = band(n) - low
    at = np.repeat(first[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    v, row = values[at], np.repeat(rows, n)
    slot = (v >> (64 - np.repeat(piece_bits(b), n)).astype(np.uint64)).astype(np.int64)
    if not len(v):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (slot[1:] != slot[:-1])]))
    symbol = np.bitwise_xor.reduceat(B.mix64(v), begin)
    label = (slot[begin] * 64 + np.repeat(b, n)[begin]).astype(np.uint64)
    return B.mix64(symbol + B.mix64(label)), row[begin]


def sets(docs: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        hasher = B.Hasher()
        for part, data, off in B.chunks(batches):
            v, first = B.shingle_sets(data, off, hasher)
            rows, n = part.num_rows, np.diff(first)
            owner = np.repeat(np.arange(rows), n)
            bit = (B.mix64(v + np.uint64(7)) % np.uint64(SKETCH_BITS)).astype(np.int64)
            odd = np.bincount(owner * SKETCH_BITS + bit, minlength=rows * SKETCH_BITS).astype(np.uint8) & 1
            sketch = np.packbits(odd.reshape(rows, SKETCH_BITS), axis=1)
            z = [np.zeros(rows, np.int32), np.zeros(rows, np.int32)]
            for low in (0, 1):
                which = np.flatnonzero((n > 0) & (goes_low(n, percent) if low else True))
                z[low][:] = np.bincount(pieces(v, first, which, bool(low))[1], minlength=rows)[:rows]
            ends = np.arange(0, sketch.size + 1, SKETCH_BITS // 8, dtype=np.int32)
            lists = pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(sketch.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(set_ids(v, first)), pa.array(n.astype(np.int32)), pa.array(z[0]), pa.array(z[1]), lists], names=["id", "set_id", "n", "z", "z_low", "sketch"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, set_id long, n int, z int, z_low int, sketch binary")


def _cut(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _join(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def keys(docs: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """Blocks of keys: per task and bucket the sets, their numbers of keys, and the keys' last 40 bits.

    A set is named by the first 47 bits of its id and a last bit for the band below.
    """

    def flush(held):
        key, owner = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        bucket = ((key >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        key, owner, edges = key[order], owner[order], np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        out = []
        for k in range(n_buckets):
            a, b = edges[k], edges[k + 1]
            if a < b:
                step = np.arange(b - a)
                new = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
                new = np.flatnonzero((step - np.repeat(new, np.diff(np.append(new, b - a)))) % 255 == 0)
                count = np.diff(np.append(new, b - a)).astype(np.uint8)
                out.append((k, _cut(owner[a:b][new], 6), count.tobytes(), _cut(key[a:b], 5)))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2, 3))], names=["bucket", "sets", "counts", "keys"])

    def run(batches):
        hasher, seen, held, size = B.Hasher(), set(), [], 0
        for part, data, off in B.chunks(batches):
            v, first = B.shingle_sets(data, off, hasher)
            n, ids = np.diff(first), set_ids(v, first)
            fresh = np.array([i for i, x in enumerate(ids.tolist()) if n[i] and x not in seen and not seen.add(x)], np.int64)
            name = ids.view(np.uint64) >> np.uint64(17) << np.uint64(1)
            for low in (0, 1):
                rows = fresh[goes_low(n[fresh], percent)] if low else fresh
                key, row = pieces(v, first, rows, bool(low))
                held.append((key, name[row] | np.uint64(low)))
                size += len(key)
            if size > 3_000_000:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return docs.mapInArrow(run, "bucket int, sets binary, counts binary, keys binary")


def shared(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """Per bucket of keys, those that two sets or more have, dealt by set."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([_join(x, 5) for x in pdf["keys"]])
        owner = np.concatenate([np.repeat(_join(s, 6), np.frombuffer(c, np.uint8)) for s, c in zip(pdf["sets"], pdf["counts"], strict=True)])
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        same = key[1:] == key[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        key, owner = key[twice], owner[twice]
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        if len(key):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            key, owner = key[new], owner[new]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(key)))
        m = np.repeat(size, size)
        key, owner, m = key[m > 1], owner[m > 1], m[m > 1]
        to = (owner >> np.uint64(1)) % np.uint64(n_buckets)
        order = np.argsort(to, kind="stable")
        key, owner, m, to = key[order], owner[order], m[order], to[order]
        begin = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        out = [(int(to[a]), owner[a:b].tobytes(), (key[a:b] | np.uint64(int(pdf["bucket"].iloc[0]) << 40)).tobytes(), m[a:b].astype(np.uint32).tobytes()) for a, b in B.bounds(begin, len(to))]
        return pd.DataFrame(out, columns=["to", "sets", "keys", "ms"])

    return blocks.groupBy("bucket").applyInPandas(B.trimmed(run), "to long, sets binary, keys binary, ms binary")


def prefixes(found: DataFrame, classes: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """(key, set_id, n, alone): of each set and band the keys that may begin what it shares with a partner; alone: its keys that no other set has."""

    def run(blocks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        ids, n = own["set_id"].to_numpy(np.int64), own["n"].to_numpy(np.int64)
        name = ids.view(np.uint64) >> np.uint64(17)
        order = np.argsort(name)
        name, ids, n, z = name[order], ids[order], n[order], np.stack([own["z"].to_numpy(np.int64)[order], own["z_low"].to_numpy(np.int64)[order]])
        owner = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in blocks["sets"])])
        key = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in blocks["keys"])])
        m = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in blocks["ms"])])
        order = np.lexsort((key, m, owner))
        owner, key = owner[order], key[order]
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(owner)))
        low = (owner[begin] & np.uint64(1)).astype(np.int64)
        # A name stands for one set, or in rare cases for several, which then all get its keys.
        left, right = (np.searchsorted(name, owner[begin] >> np.uint64(1), side) for side in ("left", "right"))
        many = right - left
        at = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin, size, low = np.repeat(begin, many), np.repeat(size, many), np.repeat(low, many)
        alone = z[low, at] - size
        keep = np.clip(bound(n[at], low == 1, percent) + 1 - alone, 0, size)
        row = np.repeat(begin, keep) + np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep)
        out = [pd.DataFrame({"key": key[row], "set_id": np.repeat(ids[at], keep), "n": np.repeat(n[at], keep), "alone": np.repeat(alone, keep)})]
        for k in (0, 1):  # sets with so few non-empty pieces that a partner may share none of them
            odd = (z[k] <= bound(n, np.full(len(n), k == 1), percent)) & (goes_low(n, percent) if k else True)
            out.append(pd.DataFrame({"key": -1 - (band(n[odd]) - k), "set_id": ids[odd], "n": n[odd], "alone": 0}))
        return pd.concat(out)

    a = found.groupBy("to")
    b = classes.withColumn("to", F.expr(f"pmod(shiftrightunsigned(set_id, 17), {n_buckets}L)")).select("to", "set_id", "n", "z", "z_low").groupBy("to")
    return a.cogroup(b).applyInPandas(B.trimmed(run), "key long, set_id long, n long, alone long")


def candidates(members: DataFrame, percent: int, n_buckets: int, first: bool) -> DataFrame:
    """Blocks of pairs (to, a, b) to hold against each other; in the first round, with to = -1, the keys (a) whose groups need the second.

    members(key, set_id, n, alone, label, sketch).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "alone", "set_id"], kind="stable")
        key, ids, n, label = (pdf[c].to_numpy() for c in ("key", "set_id", "n", "label"))
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        firsts, seconds, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for a, b in B.bounds(begin, len(key)):
            own, all_pairs = label[a:b], b - a <= ALL_PAIRS
            if all_pairs or first:
                leaders = np.arange(a, b if all_pairs else a + FIRST_LEADERS)
                if not all_pairs:
                    rest.append(key[a])
            else:
                names, counts = np.unique(own, return_counts=True)
                leaders = np.flatnonzero(own != names[np.argmax(counts)]) + a
            for i in leaders.tolist():
                total = n[i] + n[a:b]
                hit = np.flatnonzero((own != label[i]) & (np.minimum(n[i], n[a:b]) * 100 >= np.maximum(n[i], n[a:b]) * percent)) + a
                apart = np.bitwise_count(sketch[hit] ^ sketch[i]).sum(axis=1)
                hit = hit[apart * (100 + percent) <= total[hit - a] * (100 - percent)]
                firsts.append(np.full(len(hit), ids[i]))
                seconds.append(ids[hit])
        x, y = np.concatenate(firsts), np.concatenate(seconds)
        pairs = np.ascontiguousarray(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0).T).T
        # Dealt by both ids, so that the pairs of a hub go to many tasks.
        to = (B.mix64(pairs[:, 0].view(np.uint64) ^ B.mix64(pairs[:, 1].view(np.uint64))) % np.uint64(n_buckets)).astype(np.int64)
        out = [(int(k), pairs[to == k, 0].tobytes(), pairs[to == k, 1].tobytes()) for k in np.unique(to)]
        if rest:
            out.append((-1, np.array(rest, np.int64).tobytes(), b""))
        return pd.DataFrame(out, columns=["to", "a", "b"])

    return members.groupBy(F.pmod(F.xxhash64("key"), F.lit(n_buckets)).alias("g")).applyInPandas(B.trimmed(run), "to long, a binary, b binary")


def unpacked(blocks: DataFrame) -> DataFrame:
    """Blocks of pairs as rows, each pair once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.concatenate([np.frombuffer(v, np.int64) for v in pdf[c]]) for c in ("a", "b"))
        pairs = np.unique(np.stack([x, y], 1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return blocks.where("to >= 0").groupBy("to").applyInPandas(B.trimmed(run), "a long, b long")


def open_keys(blocks: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(v, np.int64) for v in pdf["a"])])})

    return blocks.where("to < 0").select("a").mapInPandas(run, "key long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        hasher = B.Hasher()
        for batch in batches:
            got = []
            for name in ("ta", "tb"):
                got.append([v[x:y] for _, data, off in B.chunks([batch], name) for v, f in [B.shingle_sets(data, off, hasher)] for x, y in zip(f[:-1].tolist(), f[1:].tolist(), strict=True)])
            hit = []
            for s, t in zip(*got, strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                hit.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    a = texts.select(F.col("set_id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("set_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    every = written(sets(docs, percent))
    classes = written(every.where("n > 0").groupBy("set_id").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "z", "z_low", "sketch"))))
    # A key takes six bytes in a block and some forty while a task sorts its bucket.
    n_buckets = parts_of((classes.agg(F.sum(F.col("z").cast("long") + F.col("z_low"))).first()[0] or 0) * 6, BUCKET_BYTES)
    open_ = written(prefixes(shared(keys(docs, percent, n_buckets), n_buckets), classes, percent, n_buckets))
    wanted = written(open_.select("set_id").distinct().join(classes, "set_id").select("set_id", "rep", "n", "sketch"))
    reps = small(wanted.select(F.col("rep").alias("id")).distinct())

    def with_set(batches):
        hasher = B.Hasher()
        for part, data, off in B.chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(*B.shingle_sets(data, off, hasher))), part.column(1)], names=["set_id", "text"])

    # Rows without an id name no class, so all their texts are read.
    fetched = docs.join(reps, "id", "left_semi").unionByName(docs.where("id IS NULL")).select("id", "text")
    texts = written(fetched.mapInArrow(with_set, "set_id long, text string").groupBy("set_id").agg(F.first("text").alias("text")))
    sketches = wanted.select("set_id", "sketch", F.col("set_id").alias("label"))
    n_groups = parts_of(open_.count(), GROUP_ROWS)
    got = written(candidates(open_.join(sketches, "set_id"), percent, n_groups, True))
    edges = written(verified(unpacked(got), texts, percent))
    known = components(edges)
    large = small(written(open_keys(got)))
    if not large.isEmpty():
        sketches = wanted.join(known, wanted.set_id == known.id, "left").select("set_id", "sketch", F.coalesce("label", "set_id").alias("label"))
        more = candidates(open_.join(large, "key", "left_semi").join(sketches, "set_id"), percent, n_groups, False)
        known = components(edges.unionByName(written(verified(unpacked(more), texts, percent))))
    member = known.join(wanted.select(F.col("set_id").alias("id"), "rep"), "id")
    lowest = small(written(member.groupBy("label").agg(F.min("rep").alias("low"))))
    near = member.join(lowest, "label").select(F.col("id").alias("set_id"), "low")
    final = small(written(classes.select("set_id", "rep").join(near, "set_id", "left").select("set_id", F.coalesce("low", "rep").alias("low"))))
    return every.join(final, "set_id", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLES: dict[str, str] = {}
