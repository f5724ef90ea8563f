"""Best-fit packing of token ids into sequences of a fixed capacity.

A document's ids and an end id are cut into pieces of ``capacity`` tokens, so only longer documents are cut. Tasks then
pack their pieces by bounded-space online best-fit: a piece goes where the least space is left that holds it, found in
one step as the lowest set bit of a bitset that is keyed by free space. ``OPEN`` bins stay open; with one more, the
fullest closes. A task sees its pieces from long to short, so that short ones fill the gaps, and emits each at once: its
memory is the open bins, whatever it reads. Tasks get about ``EACH`` pieces each, dealt by a hash of the row and not by
source or text, so a hot source is spread and a task leaves at most a few bins partly filled.

Ids are those of whole texts. The tokenizer drops white space and never merges over it, nor from a letter to the ASCII
sign after it, and lower-cases letter by letter; so ids of the parts between are kept in a bounded memo and joined. Texts
with rare white space are cut at ASCII white space only. Tests hold the ids against the tokenizer's own.

Defined cases: a null text counts as empty and gives one piece, the end id; rows of one id are documents of their own;
other columns are ignored; an empty table gives an empty result. Ties in length go by the row's place in the table.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import kept, sent, table, written

CAPACITY = 4096
END_ID = 1
#: Bins that a task keeps open.
OPEN = 1 << 15
#: Pieces that a task packs.
EACH = 40_000
#: Parts whose ids a worker keeps; beyond it starts anew.
MEMO = 800_000
#: White space besides ASCII's, and signs that Python alone takes for it.
RARE = re.compile("[" + "".join(map(chr, (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
BLANK = re.compile(r"[\x20\x09-\x0D]+")
#: Signs that end a letter's token wherever they follow it.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_str(file.decode())
        self.model, self.letters, self.memo = self.of.model, B.byte_letters(), {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            words = BLANK.split(t) if RARE.search(t) else t.split()
            codes = list(map(self.memo.get, words))
            if None in codes:
                codes = [self.learned(w) if c is None else c for w, c in zip(words, codes, strict=True)]
            out.append(b"".join(codes))
        return out

    def learned(self, part: str) -> bytes:
        if len(self.memo) > MEMO:
            self.memo = {}
        core = part.rstrip(SIGNS)
        if not core.isalpha() or (not core.isascii() and max(core) > "\xff"):  # also a special token
            code = array("I", self.of.encode(part, add_special_tokens=False).ids).tobytes()
        else:
            low, tail = core.lower(), part[len(core) :]
            code = self.memo.get(low)
            if code is None:  # letters alone are one word of the model
                code = self.memo[low] = array("I", [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.letters))]).tobytes()
            if tail:
                more = self.memo.get(tail)
                code += self.learned(tail) if more is None else more
        self.memo[part] = code
        return code


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """A written table of row, the id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece."""
    held, end = sent(docs.sparkSession, vocabulary), np.array([end_id], "<u4").tobytes()
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        encode, step = kept([held], Encoder), 4 * capacity
        for part, _, _ in B.chunks(batches):
            rows, number, codes = [], [], []
            for i, code in enumerate(encode(part.column("text").to_pylist())):
                code += end
                cuts = [code[at : at + step] for at in range(0, len(code), step)]
                rows += [i] * len(cuts)
                number += range(len(cuts))
                codes += cuts
            at, k = pa.array(rows, pa.int64()), np.array(number, np.int64)
            out = {"row": part.column("row").take(at), "id": part.column("id").take(at), "piece": pa.array(k), "start": pa.array(k * capacity), "length": pa.array([len(c) // 4 for c in codes], pa.int64()), "ids_crc32": pa.array([zlib.crc32(c) for c in codes], pa.int64())}
            if ids:
                flat = pa.array(np.frombuffer(b"".join(codes), "<i4"))
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(c) // 4 for c in codes)]), pa.int32()), flat)
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema["id"].dataType.simpleString()
    return written(docs.mapInArrow(run, f"row long, id {kind}, piece long, start long, length long, ids_crc32 long" + ", ids array<int>" * ids))


class Bins:
    """Open bins by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.bits, self.at, self.made, self.open = capacity, most, 0, [[] for _ in range(capacity + 1)], 0, 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin that takes a piece, and the piece's offset there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self.take(free)
        else:
            free, bin_ = self.capacity, self.made
            self.made += 1
        if free > length:
            self.at[free - length].append(bin_)
            self.bits |= 1 << (free - length)
            self.open += 1
            if self.open > self.most:
                self.take((self.bits & -self.bits).bit_length() - 1)
        return bin_, self.capacity - free

    def take(self, free: int) -> int:
        """Removes a bin with that free space from the open ones."""
        bin_ = self.at[free].pop()
        if not self.at[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_


def pack(table_: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN, each: int = EACH) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    def run(batches):
        bins, first = Bins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.put(n) for n in batch.column("length").to_pylist()]
            at = np.array(placed, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at[:, 0] + first), pa.array(at[:, 1])], names=[*batch.schema.names, "sequence_id", "offset"])

    tasks = table_.count() // each + 1
    dealt = table_.repartition(tasks, F.xxhash64("row", "piece")).sortWithinPartitions(F.desc("length"), "row", "piece")
    shape = ", ".join(f"{c} {t}" for c, t in table_.dtypes)
    return dealt.mapInArrow(run, f"{shape}, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id and offset."""
    return pack(pieces(docs, vocabulary, id_col, text_col)).drop("row").withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per sequence: sequence_id, its ids, and spans of (offset, length, id, piece) in order. A group has at most ``capacity`` tokens."""
    at = F.struct("offset", "length", F.col("id").alias(id_col), "piece", "ids")
    rows = pack(pieces(docs, vocabulary, id_col, text_col, capacity, ids=True), capacity).groupBy("sequence_id").agg(F.sort_array(F.collect_list(at)).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("spans"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op11_best_fit_packing": op11_best_fit_packing}
ORACLES: dict[str, str] = {}
