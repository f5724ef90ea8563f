"""Removal of every byte that a repeated 200-byte string covers, by suffix arrays in shards.

1. ``stamped``: each text's hash, length and digest. Texts with one digest are worked on once; a text of 200
   bytes or more that stands twice is covered whole.
2. ``anchors``: the smallest 32-gram hash of every 128 consecutive positions (winnowing). Equal strings of
   159 bytes have the same anchor, so a 200-byte string that repeats holds repeated anchors only.
   Distinct (anchor, text) pairs go to hash buckets as packed blocks; a bucket tells which repeat.
3. ``segments``: the stretches of a text all of whose 200-byte windows hold repeated anchors only. This
   drops text that cannot repeat; it decides nothing else.
4. Segments go to shards by their smallest anchor, so copies meet; an anchor with more bytes than a
   quarter shard is salted over several.
5. ``suffix_array``: per shard, Larsson-Sadakane refinement in numpy (only groups that are still
   tied are sorted again, by the rank h further on, h doubling); ``kasai``: common prefixes in text order,
   many stretches of the text at once. A common prefix of 200 marks a repeat.
6. Each shard writes its distinct windows as sorted keys, cut into key ranges; a range's task finds by
   binary search the keys that other shards have. The hits go back to their shard.
7. Marked windows become spans per text, and the texts' remaining bytes are hashed.

Windows of different shards are compared by 64-bit hashes, cut to their key range and 56 low bits; within a
shard the suffix array compares the bytes. Buckets, shards and ranges are counted from measured bytes, up to
65,535 of each kind.

Defined cases: a null or empty text has no bytes and keeps the digest of none; texts under 200 bytes lose
nothing; repeated rows are equal texts; a null id is returned like any other; columns besides the id
and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import parts_of, small, table, written

LENGTH = 200
GRAM = 32
WINDOW = 128
REACH = GRAM + WINDOW - 1
#: Bytes of segments that a shard holds on average, of text whose anchors a bucket holds, and of segments whose windows a key range holds.
SHARD = 600_000
BUCKET_TEXT = 48_000_000
RANGE_TEXT = 1_200_000
LANES = 8192


def _tid(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def stamped(docs: DataFrame) -> DataFrame:
    def run(batches):
        for part, data, off in B.chunks(batches):
            raw = data.tobytes()
            digests = [hashlib.sha256(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_tid(d.digest()) for d in digests], pa.int64()), pa.array(np.diff(off)), pa.array([d.hexdigest() for d in digests], pa.string())], names=["id", "tid", "n_bytes", "sha"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, tid long, n_bytes long, sha string")


def winnow(data: np.ndarray, off: np.ndarray, hasher: B.Hasher) -> tuple[np.ndarray, ...]:
    """Anchors of the rows: row, position, hash, first and last window start that chose it."""
    n = len(data) - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none.astype(np.uint64), none, none
    hasher.load(data)
    at = np.arange(n)
    v = hasher.ranges(at, at + GRAM)
    bits = np.uint64(int(n).bit_length())
    x = v >> bits << bits | at.astype(np.uint64)
    step = 1
    while step < WINDOW:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    starts = np.flatnonzero(row[: len(x)] == row[REACH - 1 : REACH - 1 + len(x)])
    if not len(starts):
        return none, none, none.astype(np.uint64), none, none
    best = (x[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.append(new[1:], len(best)) - 1
    where = best[new]
    return row[where], where, v[where], starts[new], starts[last]


def anchors(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Blocks of distinct (anchor, text): the key's last bit tells that the text has the anchor twice."""

    def flush(held):
        key, tid = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        bucket = ((key >> np.uint64(48)) % np.uint64(n_buckets)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        key, tid, edges = key[order], tid[order], np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        out = [(k, key[a:b].tobytes(), tid[a:b].tobytes()) for k, a, b in zip(range(n_buckets), edges[:-1].tolist(), edges[1:].tolist(), strict=True) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "keys", "tids"])

    def run(batches):
        hasher, seen, held, size = B.Hasher(), set(), [], 0
        for _, data, off in B.chunks(batches):
            row, _, key, _, _ = winnow(data, off, hasher)
            raw = data.tobytes()
            tids = np.array([_tid(hashlib.sha256(raw[a:b]).digest()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)
            fresh = np.array([t not in seen and not seen.add(t) for t in tids.tolist()], bool)
            row, key = row[fresh[row]], key[fresh[row]]
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            if len(row):
                begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])]))
                twice = np.diff(np.append(begin, len(row))) > 1
                held.append((key[begin] & ~np.uint64(1) | twice.astype(np.uint64), tids[row[begin]]))
                size += len(begin)
            if size > 1_000_000:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return docs.mapInArrow(run, "bucket int, keys binary, tids binary")


def repeated(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """(tid, keys): of each text the anchors that stand twice or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
        tid = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["tids"]])
        order = np.lexsort((tid, key >> np.uint64(1)))
        key, tid = key[order], tid[order]
        name = key >> np.uint64(1)
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (tid[1:] != tid[:-1])])
        key, tid, name = key[new], tid[new], name[new]
        begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        size = np.diff(np.append(begin, len(name)))
        keep = (np.repeat(size, size) > 1) | (key & np.uint64(1) == 1)
        name, tid = name[keep], tid[keep]
        to = tid.view(np.uint64) % np.uint64(n_buckets)
        order = np.argsort(to, kind="stable")
        name, tid, to = name[order], tid[order], to[order]
        begin = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        return pd.DataFrame([(int(to[a]), name[a:b].tobytes(), tid[a:b].tobytes()) for a, b in B.bounds(begin, len(to))], columns=["to", "keys", "tids"])

    def by_text(pdf: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
        tid = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["tids"]])
        order = np.lexsort((key, tid))
        key, tid = key[order], tid[order]
        begin = np.flatnonzero(np.concatenate([[True], tid[1:] != tid[:-1]]))
        return pd.DataFrame({"tid": tid[begin], "keys": [key[a:b].tobytes() for a, b in B.bounds(begin, len(tid))]})

    found = blocks.groupBy("bucket").applyInPandas(B.trimmed(run), "to long, keys binary, tids binary")
    return found.groupBy("to").applyInPandas(B.trimmed(by_text), "tid long, keys binary")


def segments(texts: DataFrame) -> DataFrame:
    """(anchor, tid, start, body) from texts(tid, text, keys)."""

    def run(batches):
        hasher = B.Hasher()
        for part, data, off in B.chunks(batches):
            row, where, key, first, last = winnow(data, off, hasher)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            names = key >> np.uint64(1)
            good = np.zeros(len(row), bool)
            for r, known in enumerate(part.column(2).to_pylist()):
                a, b = bounds[r], bounds[r + 1]
                good[a:b] = np.isin(names[a:b], np.frombuffer(known, np.uint64))
            change = np.zeros(len(data) + 1, np.int64)
            bad = ~good
            np.add.at(change, np.maximum(first[bad] - (LENGTH - REACH), off[row[bad]]), 1)
            np.add.at(change, last[bad] + 1, -1)
            size = np.diff(off)
            ok = np.cumsum(change[:-1]) == 0
            lasts = np.repeat(off[1:] - LENGTH, size)
            ok &= np.arange(len(data)) <= lasts
            edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + LENGTH - 1
            if len(s):
                # A run of good starts does not pass the end of its row, since the last 199 are never good.
                raw, of = data.tobytes(), np.searchsorted(off, s, "right") - 1
                lo, hi = np.searchsorted(where, s), np.searchsorted(where, e - GRAM, "right")
                least = [int(key[a:b].min() >> np.uint64(1)) if a < b else 0 for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                tids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array(tids[of]), pa.array((s - off[of]).astype(np.int64)), pa.array([raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())], names=["anchor", "tid", "start", "body"])

    return texts.mapInArrow(run, "anchor long, tid long, start long, body binary")


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a big-endian number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i : i + len(data)]
    return out


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes and their ranks; a suffix stops at its segment's end, which is below all bytes and below later ends.

    ``ends``: per position the end of its segment.
    """
    n, at = len(data), np.arange(len(data))
    words, rest = _words(data), ends - at
    tails, whole = np.flatnonzero(rest < 8), np.flatnonzero(rest >= 8)
    # The mask drops what the eight bytes of a tail take from the next segment.
    shift = ((8 - rest[tails]) * 8).astype(np.uint64)
    words[tails] = words[tails] >> shift << shift
    tails = tails[np.lexsort((ends[tails], rest[tails], words[tails]))]
    whole = whole[np.argsort(words[whole])]
    order = np.insert(whole, np.searchsorted(words[whole], words[tails]), tails)
    k, short = words[order], rest[order] < 8
    new = np.concatenate([[True], (k[1:] != k[:-1]) | short[1:] | short[:-1]])
    begin = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    tied = ~new | ~np.append(new[1:], True)
    slots, members, h = np.flatnonzero(tied), order[tied], 8
    bits = max(1, int(n + 1).bit_length())
    while len(members):
        here, on = rank[members], members + h
        inside = on < ends[members]
        then = np.where(inside, rank[np.minimum(on, n - 1)] + 1, 0)
        if 3 * bits <= 63:
            packed = here << (2 * bits) | then << bits | np.arange(len(members))
            packed.sort()
            by = packed & ((1 << bits) - 1)
        else:
            by = np.lexsort((then, here))
        members, here, then = members[by], here[by], then[by]
        over = then == 0
        if over.sum() > 1:  # several end here: the earlier end first
            for a, b in _runs(here, over):
                members[a:b] = members[a:b][np.argsort(ends[members[a:b]])]
        order[slots] = members
        new = np.concatenate([[True], (here[1:] != here[:-1]) | (then[1:] != then[:-1]) | over[1:] | over[:-1]])
        begin = np.flatnonzero(new)
        rank[members] = np.repeat(slots[begin], np.diff(np.append(begin, len(members))))
        tied = ~new | ~np.append(new[1:], True)
        slots, members, h = slots[tied], members[tied], 2 * h
    return order, rank


def _runs(here: np.ndarray, over: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(over)
    cut = np.flatnonzero((np.diff(at) > 1) | (here[at[1:]] != here[at[:-1]])) + 1
    parts = np.split(at, cut)
    return [(int(p[0]), int(p[-1]) + 1) for p in parts if len(p) > 1]


def kasai(data: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Per position, the common prefix with the suffix before it in order, up to ``most``.

    Kasai's rule: one position further on it is at least one less. Stretches of the text go side by side.
    """
    n = len(data)
    before = np.where(rank > 0, order[np.maximum(rank - 1, 0)], -1)
    words = _words(data)
    lanes = max(1, min(LANES, n // 64))
    length = -(-n // lanes)
    start = np.arange(lanes) * length
    h = np.zeros(lanes, np.int64)
    out = np.zeros(n, np.int32)
    for step in range(length):
        i = start + step
        live = np.flatnonzero(i < n)
        i = i[live]
        j = before[i]
        hh = np.where(j >= 0, np.maximum(h[live] - 1, 0), 0)
        limit = np.where(j >= 0, np.minimum(np.minimum(ends[i] - i, ends[j] - j), most), 0)
        open_ = np.flatnonzero(hh < limit)
        while len(open_):
            a, b, g = i[open_], j[open_], hh[open_]
            differ = words[a + g] ^ words[b + g]
            same = np.full(len(open_), 8)
            some = differ != 0
            # Leading zero bytes of the difference are equal bytes; float's exponent finds the first set bit.
            top = np.frexp((differ[some] >> np.uint64(11)).astype(np.float64))[1] + 11
            top = np.where(differ[some] >> np.uint64(11) == 0, np.frexp(differ[some].astype(np.float64))[1], top)
            same[some] = (64 - top) // 8
            g = g + same
            hh[open_] = np.minimum(g, limit[open_])
            open_ = open_[(same == 8) & (g < limit[open_])]
        h[live] = hh
        out[i] = hh
    return out


def shard_work(cut: int):
    """kind 0: the shard's segments and marked windows; kind 1: its distinct windows of one key range."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tid", "start"])
        shard = int(pdf["shard"].iloc[0])
        size = pdf["body"].str.len().to_numpy(np.int64)
        data = np.frombuffer(b"".join(pdf["body"]), np.uint8)
        ends = np.repeat(np.cumsum(size), size)
        order, rank = suffix_array(data, ends)
        lcp = kasai(data, ends, order, rank, LENGTH)
        same = lcp >= LENGTH
        marked = same.copy()
        marked[order[np.maximum(rank[same] - 1, 0)]] = True
        lead = np.flatnonzero((ends - np.arange(len(data)) >= LENGTH) & ~same)
        hasher = B.Hasher(seed=77)
        hasher.load(data)
        key = hasher.ranges(lead, lead + LENGTH)
        by = np.argsort(key)
        key, lead = key[by], lead[by]
        width = (1 << 64) // cut + 1
        edges = np.searchsorted(key, np.array([min(i * width, (1 << 64) - 1) for i in range(cut + 1)], np.uint64))
        edges[-1] = len(key)
        out = [(0, shard, shard, np.stack([pdf["tid"].to_numpy(np.int64), pdf["start"].to_numpy(np.int64), size]).tobytes(), np.packbits(marked).tobytes())]
        out += [(1, k, shard, _narrow(key[a:b]), lead[a:b].astype(np.uint32).tobytes()) for k, a, b in zip(range(cut), edges[:-1].tolist(), edges[1:].tolist(), strict=True) if a < b]
        return pd.DataFrame(out, columns=["kind", "part", "shard", "a", "b"])

    return run


def _narrow(key: np.ndarray) -> bytes:
    """The last seven bytes; the first are nearly told by the range."""
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The windows of a key range that another shard has too, by binary search in all shards' keys."""
    runs = [_wide(x) for x in pdf["a"]]
    every = np.sort(np.concatenate(runs))
    out = []
    for shard, keys, at in zip(pdf["shard"], runs, pdf["b"], strict=True):
        twice = np.searchsorted(every, keys, "right") - np.searchsorted(every, keys, "left") > 1
        if twice.any():
            out.append((int(shard), np.frombuffer(at, np.uint32)[twice].tobytes()))
    return pd.DataFrame(out, columns=["shard", "hits"])


def spans(own: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
    """(tid, spans): covered bytes of a shard's segments, as pairs of start and end in their texts."""
    out = []
    for head, bits in zip(own["a"], own["b"], strict=True):
        tid, start, size = np.frombuffer(head, np.int64).reshape(3, -1)
        n = int(size.sum())
        marked = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        for h in hits["hits"]:
            marked[np.frombuffer(h, np.uint32)] = True
        edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + LENGTH - 1
        first = np.cumsum(size) - size
        of = np.searchsorted(first, a, "right") - 1
        a, b = a - first[of] + start[of], b - first[of] + start[of]
        t = tid[of]
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        for x, y in B.bounds(begin, len(t)):
            out.append((int(t[x]), np.stack([a[x:y], b[x:y]], 1).tobytes()))
    return pd.DataFrame(out, columns=["tid", "spans"])


def cut_texts(texts: DataFrame) -> DataFrame:
    """(tid, n_removed, n_spans, sha) from texts(tid, text, spans as an array)."""

    def run(batches):
        for part, data, off in B.chunks(batches):
            raw, out = data.tobytes(), []
            for r, found in enumerate(part.column(2).to_pylist()):
                pairs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in found])
                change = np.zeros(off[r + 1] - off[r] + 1, np.int32)
                np.add.at(change, pairs[:, 0], 1)
                np.add.at(change, pairs[:, 1], -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(raw[off[r] : off[r + 1]], np.uint8)[~gone]
                out.append((int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)), hashlib.sha256(kept.tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[i] for x in out], k) for i, k in ((0, pa.int64()), (1, pa.int64()), (2, pa.string())))], names=["tid", "n_removed", "n_spans", "kept"])

    return texts.mapInArrow(run, "tid long, n_removed long, n_spans long, kept string")


def with_digest(docs: DataFrame) -> DataFrame:
    def run(batches):
        for part, data, off in B.chunks(batches):
            raw = data.tobytes()
            digests = [hashlib.sha256(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([d.hexdigest() for d in digests], pa.string()), part.column(1)], names=["sha", "text"])

    return docs.select("id", "text").mapInArrow(run, "sha string, text string")


def _texts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(sha, text), once for each of classes(sha, rep), and perhaps for more; dealt by sha, the only time that texts are moved."""
    ids = small(written(classes.select(F.col("rep").alias("id")).distinct()))
    # Rows without an id name no class, so all their texts are read.
    fetched = docs.join(ids, "id", "left_semi").unionByName(docs.where("id IS NULL"))
    return with_digest(fetched).groupBy("sha").agg(F.first("text").alias("text"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    every = written(stamped(docs))
    # Texts are one if their digests are; from here on a class has a number of its own in place of the short hash.
    classes = written(every.groupBy("sha").agg(F.first("tid").alias("hash"), F.count("*").alias("copies"), F.min("id").alias("rep"), F.first("n_bytes").alias("n_bytes")).withColumn("tid", F.monotonically_increasing_id()))
    n = parts_of(classes.agg(F.sum("n_bytes")).first()[0] or 0, BUCKET_TEXT)
    known = written(repeated(anchors(docs, n), n).withColumnRenamed("tid", "hash"))
    # Texts that share a short hash get each other's anchors too, which only keeps more of them.
    kept = written(classes.join(known.select("hash"), "hash", "left_semi"))
    keys = kept.select("sha", "tid", "hash").join(known, "hash").select("sha", "tid", "keys")
    found = written(segments(_texts_of(docs, kept).join(keys, "sha").select("tid", "text", "keys")))
    sizes = found.groupBy("anchor").agg(F.sum(F.length("body")).alias("bytes"))
    total = found.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = total // SHARD + 1
    hot = small(written(sizes.where(F.col("bytes") > SHARD // 4).select("anchor", F.ceil(F.col("bytes") / (SHARD // 4)).cast("int").alias("salts"))))
    salt = F.pmod(F.xxhash64("tid", "start"), F.coalesce("salts", F.lit(1)))
    placed = found.join(hot, "anchor", "left").select("tid", "start", "body", F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).alias("shard"))
    done = written(placed.groupBy("shard").applyInPandas(B.trimmed(shard_work(parts_of(total, RANGE_TEXT))), "kind int, part long, shard long, a binary, b binary"))
    hits = done.where("kind = 1").groupBy("part").applyInPandas(B.trimmed(merge), "shard long, hits binary")
    covered = done.where("kind = 0").groupBy("shard").cogroup(hits.groupBy("shard")).applyInPandas(B.trimmed(spans), "tid long, spans binary")
    copied = F.expr(f"copies > 1 and n_bytes >= {LENGTH}")
    covered = written(covered.groupBy("tid").agg(F.collect_list("spans").alias("spans")).join(classes.where(~copied).select("tid"), "tid", "left_semi"))
    named = written(covered.join(classes.select("tid", "sha", "rep"), "tid"))
    part = cut_texts(_texts_of(docs, named).join(named, "sha").select("tid", "text", "spans"))
    empty = hashlib.sha256(b"").hexdigest()
    whole = classes.where(copied).select("tid", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept"))
    cut = small(written(part.unionByName(whole).join(classes.select("tid", "sha"), "tid").drop("tid")))
    zero = F.lit(0).cast("long")
    return every.join(cut, "sha", "left").select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLES: dict[str, str] = {}
