"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be found with up to k = m // 16 edits. It is split into k + 1 pieces; an
occurrence within k edits must hold one piece unchanged, so one Aho-Corasick pass finds all places worth
a look. Piece hits of an item whose diagonals are within k of each other share one window, which Myers'
bit-parallel recurrence (one machine or long integer per column) searches for the nearest occurrence.
Texts and items are compared with A-Z in lower case and white space as blanks, which keeps positions.

Items travel to the tasks in parts of some ``PART_CHARS`` characters; a larger benchmark takes several
passes over the documents, none of which shuffles a text. Items that share a piece are each compared where it
stands, so a piece that many items and documents have in common costs a comparison for each.

Defined cases: null and blank items match nothing, nor do items of fewer than ``MIN_CHARS`` characters, which
stand in any text; an item without a budget must not be part of a longer word, where its script has blanks between
words; item ids are of any type; a null text holds nothing; an item that occurs several
times in a text is one row with its best place (the first of the nearest); equal items each give a row;
repeated documents each give their rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import small, table, written

CHARS_PER_EDIT = 16
PART_CHARS = 4_000_000
MIN_CHARS = 8


#: Code points of scripts that are written without blanks between words.
UNSPACED = [(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


def joins(a: str, b: str) -> bool:
    """Whether two letters or digits side by side belong to one word; in scripts without blanks that cannot be told, and no word is cut."""
    return a.isalnum() and b.isalnum() and not any(lo <= ord(c) <= hi for c in (a, b) for lo, hi in UNSPACED)


def _plain() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[9:14] = 32
    return t


def plain(text: str) -> str:
    return _plain()[np.frombuffer(text.encode(), np.uint8)].tobytes().decode()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces, as even as can be, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def nearest(pattern: str, text: str) -> tuple[int, int]:
    """Least edits of the pattern to a substring of the text, and the first end where it has them (Myers)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(zero | up) & full
        minus = up & zero
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | ~(zero | plus) & full
        down = plus & zero
        if score < best:
            best, end = score, j
    return best, end


class Searcher:
    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        import ahocorasick

        self.items = [(i, t, len(t) // chars_per_edit) for i, t in ((i, plain(t).strip()) for i, t in items) if len(t) >= MIN_CHARS]
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for at, (_, t, k) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                by_piece.setdefault(piece, []).append((at, offset))
        self.tree = ahocorasick.Automaton()
        for piece, uses in by_piece.items():
            self.tree.add_word(piece, (len(piece), uses))
        self.tree.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) for each item within its budget."""
        hits: dict[int, set[int]] = {}
        for last, (n, uses) in self.tree.iter(text) if self.items else ():
            for at, offset in uses:
                hits.setdefault(at, set()).add(last + 1 - n - offset)
        out = []
        for at, diagonals in hits.items():
            i, t, k = self.items[at]
            best = None
            runs: list[list[int]] = []
            for d in sorted(diagonals):
                if k and runs and d - runs[-1][1] <= k:
                    runs[-1][1] = d
                else:
                    runs.append([d, d])
            for lo, hi in runs:
                a = max(0, lo - k)
                window = text[a : hi + len(t) + k]
                if not k:
                    # Without a budget the piece is the whole item, and it must not be cut from a word.
                    inside = any(joins(x, y) for x, y in ((text[lo - 1 : lo], t[0]), (t[-1], text[lo + len(t) : lo + len(t) + 1])))
                    if inside:
                        continue
                exact = window.find(t)
                edits, end = (0, exact + len(t)) if exact >= 0 else nearest(t, window)
                if edits <= k and (best is None or edits < best[1]):
                    reach = window[max(0, end - len(t) - edits) : end]
                    back = nearest(t[::-1], reach[::-1])[1] if edits else len(t)
                    best = (i, edits, a + end - back, a + end)
            if best:
                out.append(best)
        return out


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """Items as (at, item_id, text), numbered in a written table, and its parts."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("length(trim(text)) > 0")
    items = written(items.withColumn("at", F.monotonically_increasing_id()))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // PART_CHARS + 1
    return items, [items.where(F.pmod(F.xxhash64("at"), F.lit(n)) == i) for i in range(n)]


def _search(docs: DataFrame, part: DataFrame, chars_per_edit: int, schema, rows) -> DataFrame:
    """Runs one part's items over docs(..., text); rows(batch, found) makes the output."""
    items = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in part.select("at", "text").collect()])

    def run(batches):
        searcher, same = Searcher(items.value, chars_per_edit), _plain()
        for batch, data, off in B.chunks(batches):
            data = same[data].tobytes()
            yield rows(batch, [searcher.find(data[a:b].decode()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """One row per document and item found in it: id, item_id, edits, start, end (in characters)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def rows(batch, found):
        n = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        flat = [y for x in found for y in x]
        columns = [pa.array([y[i] for y in flat], pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays([pc.take(batch.column(0), n), *columns], names=["id", "at", "edits", "start", "end"])

    items, parts = _items(benchmark, item_col, item_text_col)
    kind = docs.schema["id"].dataType.simpleString()
    found = reduce(DataFrame.unionByName, [_search(docs, p, chars_per_edit, f"id {kind}, at long, edits long, start long, end long", rows) for p in parts])
    return found.join(small(items.select("at", "item_id")), "at").select(F.col("id").alias(id_col), "item_id", "edits", "start", "end")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    # The input's columns go in a struct, so their names cannot clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    for part in _items(benchmark, item_col, item_text_col)[1]:
        rows = _search(rows, part, chars_per_edit, rows.schema, lambda batch, found: batch.filter(pa.array([not x for x in found], pa.bool_())))
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES: dict[str, str] = {}
