"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed words and hashed 4-grams of character shape (case, digit, blank, other letters; marks
stand for themselves), two blocks of ``TERMS`` buckets each. A text's vector has log-damped counts times
inverse document frequency, each block scaled to unit length. The document frequencies count every
document. A labelled sample (at most ``SAMPLE`` rows, those with the smallest hash of the id) gives the
latent space: the leading right singular vectors of its term matrix. The sample's vectors and the
projection are broadcast; their size depends on the parameters only. Every document is projected in
blocks, its cosines with all sample vectors are computed exactly, and its ``NEIGHBOURS`` nearest vote
with their cosine as weight (negative ones count as none).

Defined cases: a null or empty text has the zero vector, no similarity to anything, and gets the
sample's mean label; ties in similarity go to the earlier sample row (by hash order); labels that are
null or whose document is missing are not used; without any label every score is 0.5; repeated rows are
scored alike; only the text enters a score; an input column named ``score`` is replaced in ``classify``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import small, table, written

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 3000
TERMS = 1024
DIMENSIONS = 48
NEIGHBOURS = 15
#: Documents projected at once.
BLOCK = 256


def _shape() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[97:123], t[65:91], t[48:58], t[128:] = 97, 65, 48, 98
    t[9:14] = 32
    return t


def counts(data: np.ndarray, off: np.ndarray, hasher: B.Hasher) -> np.ndarray:
    """Term counts of each row: a matrix of 2 * TERMS columns."""
    rows = len(off) - 1
    out = np.zeros(rows * 2 * TERMS, np.float32)
    if len(data):
        hasher.load(B.lower_ascii(data))
        start, end, first = B.word_spans(data, off)
        owner = np.repeat(np.arange(rows), np.diff(first))
        term = (hasher.ranges(start, end) % np.uint64(TERMS)).astype(np.int64)
        out += np.bincount(owner * 2 * TERMS + term, minlength=len(out)).astype(np.float32)
        s = _shape()[data].astype(np.uint32)
        if len(s) > 3:
            gram = s[:-3] | s[1:-2] << np.uint32(8) | s[2:-1] << np.uint32(16) | s[3:] << np.uint32(24)
            gram = (gram * np.uint32(2654435761)) >> np.uint32(32 - TERMS.bit_length() + 1)
            owner = np.repeat(np.arange(rows), np.diff(off))
            same = owner[:-3] == owner[3:]
            out += np.bincount((owner[:-3] * 2 * TERMS + TERMS + gram)[same], minlength=len(out)).astype(np.float32)
    return out.reshape(rows, 2 * TERMS)


def blocks(batches):
    """Slices of at most BLOCK rows with their term counts."""
    hasher = B.Hasher()
    for part, data, off in B.chunks(batches):
        for a in range(0, part.num_rows, BLOCK):
            b = min(a + BLOCK, part.num_rows)
            yield part.slice(a, b - a), counts(data[off[a] : off[b]], off[a : b + 1] - off[a], hasher)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each term, and all documents."""

    def run(batches):
        have, n = np.zeros(2 * TERMS, np.int64), 0
        for part, c in blocks(batches):
            have += (c > 0).sum(axis=0)
            n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 2 * TERMS)), pa.array(np.append(n, have))], names=["term", "n"])

    df, n = np.zeros(2 * TERMS), 0
    for term, k in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        if term < 0:
            n = k
        else:
            df[term] = k
    return df, n


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c) * idf
    for k in (0, TERMS):
        block = x[:, k : k + TERMS]
        block /= np.maximum(np.sqrt((block * block).sum(axis=1, keepdims=True)), 1e-9)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(n > 1e-6, x / np.maximum(n, 1e-6), 0).astype(np.float32)


def leading(x: np.ndarray) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], DIMENSIONS + 16)).astype(np.float32)
    for _ in range(12):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, turn = np.linalg.eigh((x @ q).T @ (x @ q))
    return np.ascontiguousarray((q @ turn)[:, ::-1][:, :DIMENSIONS]).astype(np.float32)


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """``docs(id, text)``; ``labelled(id, label)``: rows whose labels may be learned."""
    chosen = labelled.where("label is not null and id is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = written(chosen.groupBy("id").agg(F.max("label").alias("label")))

    def run(batches):
        for part, c in blocks(batches):
            # Most counts are zero, so a row is some kilobytes.
            packed = pa.array([zlib.compress(r.tobytes(), 1) for r in c.astype(np.uint32)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), packed], names=["h", "label", "c"])

    texts = docs.join(small(chosen), "id").select(F.xxhash64("id").alias("h"), "text", F.col("label").cast("double").alias("label"))
    rows = texts.mapInArrow(run, "h long, label double, c binary").orderBy("h").limit(sample).collect()
    df, n = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    if not rows:
        return {"idf": idf, "axes": np.zeros((2 * TERMS, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": np.zeros(0), "mean": 0.5}
    labels = np.array([r["label"] for r in rows])
    x = np.empty((len(rows), 2 * TERMS), np.float32)
    for i in range(len(rows)):  # row by row, so that the driver holds the sample once
        x[i] = weighted(np.frombuffer(zlib.decompress(rows[i]["c"]), np.uint32).astype(np.float32)[None], idf)
    del rows
    axes = leading(x)
    return {"idf": idf, "axes": axes, "vectors": unit(x @ axes), "labels": labels, "mean": float(labels.mean())}


def vote(model: dict, c: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    if not len(model["labels"]):
        return np.full(len(c), model["mean"])
    y = unit(weighted(c, model["idf"]) @ model["axes"])
    sims = y @ model["vectors"].T
    k = min(k, sims.shape[1])
    last = np.partition(sims, -k, axis=1)[:, -k, None]
    above, tied = sims > last, sims == last
    # Of those that tie for the last places the earlier ones are taken.
    take = above | tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True))
    w = np.where(take, np.maximum(sims, 0), 0).astype(np.float64)
    total, share = w.sum(axis=1), w @ model["labels"]
    return np.where((total > 0) & (c.sum(axis=1) > 0), share / np.maximum(total, 1e-12), model["mean"]).clip(0, 1)


def scored(docs: DataFrame, model: dict, text_col: str) -> DataFrame:
    """(row, score): the input's columns as a struct, in which their names cannot clash, and a score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = kept.select("row", F.lit(0.0).alias("score")).schema

    def run(batches):
        hasher, m = B.Hasher(), held.value
        for part, data, off in B.chunks(batches):
            scores = [vote(m, counts(data[off[a] : off[b]], off[a : b + 1] - off[a], hasher)) for a in range(0, part.num_rows, BLOCK) for b in [min(a + BLOCK, part.num_rows)]]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate(scores))], names=["row", "score"])

    return kept.mapInArrow(run, schema)


def learned(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, sample: int) -> dict:
    return fit(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), labelled, sample)


def classify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents with score (0 to 1, higher: likelier label 1). ``labelled(id, label)`` holds the rows to learn from."""
    out = scored(docs, learned(docs, labelled, id_col, text_col, sample), text_col)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "score"), "score")


def accepted(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` or more, with their own columns."""
    out = scored(docs, learned(docs, labelled, id_col, text_col, sample), text_col).where(F.col("score") >= least)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def held_out():
    """Rows whose labels are never learned."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out()).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, learnable(table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLES: dict[str, str] = {}
