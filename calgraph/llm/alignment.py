"""Alignment of two tokenizers' tokens over the same text, and counts of the id pairs that it links.

Tokenizer A, byte-level, codes a blank and the text; tokenizer B, of pieces, codes the text and adds the blank itself.
Byte offsets where a token of each ends cut both into groups; all pairs of an A and a B token of one group are links.

Whole texts are tokenised first. Neither tokenizer merges over a blank or a line break that follows another sign, so ids
of the parts that begin there are kept in a bounded memo and joined to the ids of the text; A's ids of a word of letters come from
its merges by rank, all others from the tokenizer; tests hold them against the tokenizers. The joined bytes of both are then compared with the text. Shared ends before a token that carries the blank
in both (verified, their offsets are equal) split a document into windows of token ids, and a window's alignment is kept
in a memo under its two id tuples. Windows meet only at shared ends, so no group spans two.

An id pair's count is the number of documents that hold it linked: each document sends each of its pairs once, summed
before the shuffle. The table of pairs is bounded by the product of the vocabularies, not by the corpus; it is broadcast
below the bound of ``small`` and else joined by shuffle.

Defined cases: texts that are null or empty, or whose joined bytes differ from the blank and the text (B may rewrite
letters), have no tokens, zeros and an empty digest; rows of one id are documents of their own; other columns are
ignored; an empty table gives an empty result. A very long run without blanks is one window, aligned without the memo; a
group's links are counted by distinct ids, so a long group costs its distinct pairs.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytesops as B
from .common import kept, sent, small, table, written

#: Parts and windows that a worker keeps; beyond it the memo starts anew.
PARTS, WINDOWS = 500_000, 300_000
#: Set in B's ids, so that an A and a B id tuple end to end are one key of the memo.
MARK = 1 << 31
#: A window of more tokens is not kept.
LONG = 64
#: A group of more links is counted by its distinct ids.
MANY = 1 << 14
#: White space besides the blank and the line break, signs that Python alone takes for it, and the mark of parts.
RARE = re.compile("[\0\t\x0b\x0c\r" + "".join(map(chr, (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
#: A part begins with a blank or a line break after any other sign.
PART = re.compile(r"[ \n](?:[^ \n]|(?<!\S)[ \n])*")
BLANK = "▁"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Aligner:
    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a.decode()), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        byte = {chr(c): k for k, c in B.byte_letters().items()}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        ranks = {t: k for k, t in enumerate(self.a_bytes) if t and k not in self.a.get_added_tokens_decoder()}
        #: A's merges on one word, whose ids are the merges' ranks.
        self.word = tiktoken.Encoding("word", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(BLANK, " ").encode() for k, p in enumerate(pieces)]
        #: Whether ids of parts make up ids of the text: no piece has a blank after another sign, or a line break.
        self.cuts = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        #: Signs that may be cut from the letters before them: no piece holds both.
        self.signs = "".join(set(SIGNS).difference(y for p in pieces for x, y in zip(p, p[1:], strict=False) if x.isalpha()))
        self.lone = self.b.piece_to_id(BLANK)
        self.a_size, self.b_size = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        self.a_blank, self.b_blank = (np.array([t[:1] == b" " for t in x]) for x in (self.a_bytes, self.b_bytes))
        self.memo, self.odd, self.windows = {}, set(), {}

    def parts(self, text: str) -> list[str]:
        """Of the blank and the text; joined they are it."""
        if not text:
            return []
        if self.cuts and not RARE.search(text):
            found = f" {text}".replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]
            if " " not in found and "\n" not in found:
                return found
        return PART.findall(f" {text}") if self.cuts else [f" {text}"]

    def cut(self, part: str) -> tuple[str, str]:
        """A part that is letters and then signs as two that are coded apart."""
        core = part.rstrip(SIGNS)
        if core != part and core[1:].isalpha() and part[len(core)] in self.signs:
            return core, part[len(core) :]
        return part, ""

    def learn(self, parts: set[str]) -> None:
        """Ids of both (in ``odd`` if their bytes are not the part's) for parts that begin with a blank, a line break or (after letters) a sign."""
        cuts = {p: self.cut(p) for p in parts}
        fresh = list({x for two in cuts.values() for x in two if x}.difference(self.memo))
        # B adds the blank itself. A line break merges with nothing, so what follows it is coded as after any other sign.
        said = self.b.encode([x[1:] if x[0] == " " else x if x[0] == "\n" else f"\n{x}" for x in fresh], num_threads=1) if fresh else []
        for x, b in zip(fresh, said, strict=True):
            data = x.encode()
            if x[0] == " ":
                b = b if len(x) > 1 else [self.lone]
            else:
                b = b[1 if x[0] == "\n" else 2 :]
            if x[0] == " " and x[1:].isalpha() and (x.isascii() or max(x) <= "\xff"):  # letters alone are one word of the model
                a = self.word.encode_ordinary(x)
            else:
                a = self.a.encode(x, add_special_tokens=False).ids
            if not b"".join([self.a_bytes[k] for k in a]) == data == b"".join([self.b_bytes[k] for k in b]):
                self.odd.add(x)
            self.memo[x] = array("I", a).tobytes(), array("I", [k | MARK for k in b]).tobytes()
        for p, (core, tail) in cuts.items():
            if tail:
                (x, y), (z, w) = self.memo[core], self.memo[tail]
                self.memo[p] = x + z, y + w
                if core in self.odd or tail in self.odd:
                    self.odd.add(p)

    def __call__(self, texts: list[str]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Per text: n_a, n_b, n_groups, n_links, digest, distinct pairs, their links."""
        if len(self.memo) > PARTS:
            self.memo, self.odd = {}, set()
        parts = [self.parts(t) for t in texts]
        codes = [list(map(self.memo.get, x)) for x in parts]
        holes = [[i for i, c in enumerate(y) if c is None] if None in y else () for y in codes]
        self.learn({x[i] for x, h in zip(parts, holes, strict=True) for i in h})
        whole = []
        for k, (t, x, y, h) in enumerate(zip(texts, parts, codes, holes, strict=True)):
            for i in h:
                y[i] = self.memo[x[i]]
            a, b = b"".join([c[0] for c in y]), b"".join([c[1] for c in y])
            if a and (not self.odd or self.odd.isdisjoint(x) or self.spelt(a, self.a_bytes) == f" {t}".encode() == self.spelt(b, self.b_bytes)):
                whole.append((k, a, b))
        out = [(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        if whole:
            at, a, b = zip(*whole, strict=True)
            for i, row in zip(at, self.aligned(a, b), strict=True):
                out[i] = row
        return out

    @staticmethod
    def spelt(ids: bytes, spelling: list[bytes]) -> bytes:
        return b"".join([spelling[k & ~MARK] for k in memoryview(ids).cast("I")])

    def aligned(self, a: tuple[bytes, ...], b: tuple[bytes, ...]):
        """Of texts whose ids are given, one row each. As both tokenizers spell each text, their ends meet at each text's end."""
        n_a, n_b = ([len(y) // 4 for y in x] for x in (a, b))
        a, b = b"".join(a), b"".join(b)
        ids, pieces = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4") & ~np.uint32(MARK)
        end, other = np.cumsum(self.a_size[ids]), np.cumsum(self.b_size[pieces])
        at = np.searchsorted(other, end)
        i = np.flatnonzero(other[at] == end)
        # Where each group begins in both, and at last where the tokens end.
        x, y = (np.concatenate([[0], z + 1]) for z in (i, at[i]))
        # A window begins at a text's start, or at a shared end before a token that carries the blank in both.
        texts = np.searchsorted(x, np.cumsum([0, *n_a]))
        opens = self.a_blank[ids[x[:-1]]] & self.b_blank[pieces[y[:-1]]]
        opens[texts[:-1]] = True
        edge = np.append(np.flatnonzero(opens), len(i))
        p, q = (4 * x[edge]).tolist(), (4 * y[edge]).tolist()
        keys = [a[r:s] + b[t:u] for r, s, t, u in zip(p[:-1], p[1:], q[:-1], q[1:], strict=True)]
        if len(self.windows) > WINDOWS:
            self.windows = {}
        values = list(map(self.windows.get, keys))
        holes = [w for w, v in enumerate(values) if v is None]
        if holes:
            new = {keys[w]: w for w in holes}
            w = np.fromiter(new.values(), np.int64, len(new))
            made = dict(zip(new, self.alignments(ids, pieces, x, y, edge[w], edge[w + 1]), strict=True))
            for h in holes:
                values[h] = made[keys[h]]
            self.windows.update((k, v) for k, v in made.items() if len(k) <= 4 * LONG)
        first = np.searchsorted(edge, texts).tolist()
        links = np.add.reduceat(np.diff(x) * np.diff(y), texts[:-1]).tolist()
        for k, (r, s) in enumerate(zip(first[:-1], first[1:], strict=True)):
            said, pairs, rest = zip(*values[r:s], strict=True)
            pairs, times = np.unique(np.frombuffer(b"".join(pairs), "<i8"), return_counts=True)
            if any(rest):
                more = sum(filter(None, rest), Counter())
                more.update(dict(zip(pairs.tolist(), times.tolist(), strict=True)))
                pairs = np.array(sorted(more), np.int64)
                times = np.array([more[c] for c in pairs.tolist()])
            yield n_a[k], n_b[k], int(texts[k + 1] - texts[k]), links[k], hashlib.sha256(";".join(said).encode()).hexdigest(), pairs, times

    def alignments(self, ids, pieces, x, y, begin, end):
        """Of windows, which are ranges of groups: text, pairs as often as linked, and counts of pairs of long groups."""

        def spread(begin, n):
            """begin[k], begin[k] + 1, ... for each k."""
            return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)

        groups = spread(begin, end - begin)
        window = np.repeat(np.arange(len(begin)), end - begin)
        na, nb = x[groups + 1] - x[groups], y[groups + 1] - y[groups]
        a, b = ids[spread(x[groups], na)].astype(np.int64), pieces[spread(y[groups], nb)].astype(np.int64)
        # Text: tokens in order of group and side, each with the sign after it.
        side = np.concatenate([2 * np.repeat(np.arange(len(na)), na), 2 * np.repeat(np.arange(len(nb)), nb) + 1])
        order = np.argsort(side, kind="stable")
        side, tokens = side[order], np.concatenate([a, b])[order].tolist()
        last = np.append(side[1:] != side[:-1], True)
        sign = np.where(last, 1 + side % 2, 0)
        closes = np.append(window[1:] != window[:-1], True)
        sign[last & (side % 2 == 1)] += closes
        text = [""] * (2 * len(tokens))
        text[::2] = map(str, tokens)
        text[1::2] = map(",|;\n".__getitem__, sign.tolist())
        said = "".join(text).split("\n")
        # Pairs: each A token with the group's B tokens; of long groups only distinct ids.
        short = na * nb <= MANY
        n = np.repeat(np.where(short, nb, 0), na)
        pairs = np.repeat(a, n) << 32 | b[spread(np.repeat(np.cumsum(nb) - nb, na), n)]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(window, np.where(short, na * nb, 0), len(begin)))]).astype(np.int64).tolist()
        rest = [None] * len(begin)
        for g in np.flatnonzero(~short).tolist():
            ca, cb = (Counter(z[int(m[:g].sum()) :][: int(m[g])].tolist()) for z, m in ((a, na), (b, nb)))
            rest[window[g]] = (rest[window[g]] or Counter()) + Counter({s << 32 | t: i * j for s, i in ca.items() for t, j in cb.items()})
        return [(said[k], pairs[cuts[k] : cuts[k + 1]].tobytes(), rest[k]) for k in range(len(begin))]


def alignments(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of row, id, n_a, n_b, n_groups, n_links, groups_sha256, and of each distinct pair (A id << 32 | B id) its links in the document."""
    held = [sent(docs.sparkSession, a), sent(docs.sparkSession, b)]
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        align = kept(held, Aligner)
        for part, _, _ in B.chunks(batches):
            # The memos hold no cycles; walking them takes a tenth of the time.
            gc.disable()
            try:
                rows = align(part.column("text").to_pylist())
            finally:
                gc.enable()
            *plain, pairs, times = zip(*rows, strict=True)
            edges = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x))) for x in (pairs, times)]
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), *(pa.array(x, k) for x, k in zip(plain, kinds, strict=True)), *lists], names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema["id"].dataType.simpleString()
    return written(docs.mapInArrow(run, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"))


def pair_counts(table_: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best: whether no pair of its A id has a higher count."""
    counts = table_.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    top = F.max("count").over(W.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("count") == top)


def vocabulary_map(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a_id, b_id, count and best of every linked id pair: what one vocabulary's tokens are in the other."""
    pair = F.col("pair")
    return pair_counts(alignments(docs, a, b, id_col, text_col)).select(F.shiftright(pair, 32).alias("a_id"), pair.bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "count", "best")


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = alignments(docs, a, b, id_col, text_col)
    counts = small(written(pair_counts(rows)))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_tokenizer_alignment": op13_tokenizer_alignment}
ORACLES: dict[str, str] = {}
