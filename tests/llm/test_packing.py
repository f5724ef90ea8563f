import random
import zlib

import helpers as H
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calgraph.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "  ", "word's don't WORLD'S !'s it''s", "a<|endoftext|>b <|ENDOFTEXT|> x<|startoftext|>", "nbsp\xa0here   wide　x \x1c\x1d y\x85z", "İSTANBUL ΣΑΣ. ςΣ ßẞ", "étude. a̸≠ ≮", "1234 5a6 ①② ٣", "日本語 テキスト。 ok", "\U0001f600\U0001f600! x", "tab\tnew\nline\r\nx\x0b\x0cy", "A.B.C. x_y --z-- (é) É!É", "ﬁ ½ Ǆ ŉ", "LONG" * 3000,
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizers(plain):
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(" \n\t'’.,!<|>aAéÉßΣ1½\xa0́\x1c日s") for _ in range(rng.randrange(60))) for _ in range(3000)]
    with open(PATH, "rb") as f:
        encode = packing.Encoder(f.read())
    for _ in range(2):  # the second time from the memo
        got = encode(texts)
        for t, g in zip(texts, got, strict=True):
            assert np.frombuffer(g, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def plain_bins(lengths, capacity, most):
    """Bounded best-fit by looking at every open bin."""
    free, out, made = {}, [], 0
    for n in lengths:
        fit = [(f, -k) for k, f in free.items() if f >= n]
        if fit:
            k = -min(fit)[1]
        else:
            k, free[made], made = made, capacity, made + 1
        out.append((k, capacity - free[k]))
        free[k] -= n
        if not free[k]:
            del free[k]
        if len(free) > most:
            del free[min(free, key=lambda k: (free[k], -k))]
    return out, made


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_bins_against_plain(most):
    rng = random.Random(most)
    lengths = [min(100, int(rng.paretovariate(0.8) * 5)) for _ in range(2000)]
    bins = packing.Bins(100, most)
    got = [bins.put(n) for n in lengths]
    want, made = plain_bins(lengths, 100, most)
    assert bins.made == made and bins.open <= most
    # Bins of equal free space are interchangeable: the same space is used at each step.
    assert [a[1] for a in got] == [a[1] for a in want] if most == 1 else abs(len({a[0] for a in got}) - made) == 0


def test_more_open_bins_need_no_more_sequences():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(1, 100) for _ in range(3000)), reverse=True)
    made = []
    for most in (1, 30, 10_000):
        bins = packing.Bins(100, most)
        for n in lengths:
            bins.put(n)
        made.append(bins.made)
    assert made[0] >= made[1] >= made[2] and made[2] <= 11 / 9 * sum(lengths) / 100 + 1


def check(spark, plain, docs, capacity=packing.CAPACITY):
    rows = docs.collect()
    got = packing.packed(docs, PATH).collect()
    want = []
    for r in rows:
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, k, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    key = lambda x: (x[0] is None, x)
    none = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((none((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got), key=key) == sorted(map(none, want), key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= capacity
    lengths = sorted((w[3] for w in want), reverse=True)
    assert len(bins) <= plain_bins(lengths, capacity, 10**9)[1]
    return len(bins), sum(lengths)


def test_odd_tables(spark, plain):
    rows = H.odd_rows() + [(i, t, None, None, 0) for i, t in enumerate(ODD, 1000)]
    docs = H.frame(spark, rows).repartition(3).withColumns({c: F.lit(1) for c in ("row", "id", "piece", "length", "offset", "sequence_id", "ids")})
    check(spark, plain, docs)
    assert packing.packed(H.frame(spark, []), PATH).count() == 0
    assert packing.pack(packing.pieces(docs, PATH), each=10).select("sequence_id").distinct().count() > 10


def test_given_documents_are_packed_tightly(spark, plain):
    n, tokens = check(spark, plain, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert n <= -(-tokens // packing.CAPACITY) * 1.02 + 1


def test_sequences_hold_the_ids(spark, plain):
    docs = H.frame(spark)
    want = sorted(tuple([*plain.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect())
    got = {}
    for r in packing.sequences(docs, PATH, capacity=packing.CAPACITY).collect():
        assert len(r.ids) <= packing.CAPACITY
        for s in r.spans:
            got.setdefault((s.doc_id, s.piece), []).append(tuple(r.ids[s.offset : s.offset + s.length]))
    assert sorted(x for k, v in got.items() if k[1] == 0 for x in v if len(x) < packing.CAPACITY) == [w for w in want if len(w) < packing.CAPACITY]


def test_other_ids(spark, plain):
    docs = spark.createDataFrame([("a", "x y"), (None, None), ("a", "x y")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.length) for r in packing.packed(docs, PATH).collect()) == [("None", 1), ("a", 3), ("a", 3)]
