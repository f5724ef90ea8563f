import hashlib
import random
from collections import Counter, defaultdict

import helpers as H
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calgraph.llm import alignment as M
from calgraph.llm import bytesops

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", " x", "x ", "a  b", "a\n b", "a \nb", "a\n\nb\n", "\na", "don't we're 'll", "a<|endoftext|>b", "<unk> <s> </s> <0x41> <0x0A>", "▁a ▁ b", "nbsp\xa0 wide　x \x1c y\x85 \x00 z", "tab\t x\r\n y\x0b", "日本語 テキスト。 ok",
    "\U0001f600\U0001f600 é́ ﬁ ½", "1234 5,678.90", "É!É \"q\" (x)", "ελληνικά русский عربى", "x" * 5000, "日本" * 1500, "\U0001f600" * 900, "word " * 3000,
]


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        self.byte = {chr(c): k for k, c in bytesops.byte_letters().items()}

    def ids(self, text):
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        sa = [bytes(self.byte[c] for c in self.a.id_to_token(k)) for k in a]
        sb = [bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode() for k in b]
        whole = (" " + text).encode()
        return (a, b, sa, sb) if text and b"".join(sa) == whole == b"".join(sb) else ([], [], [], [])

    def groups(self, text):
        a, b, sa, sb = self.ids(text)
        ends = lambda s: [sum(map(len, s[: i + 1])) for i in range(len(s))] if len(s) < 400 else list(__import__("itertools").accumulate(map(len, s)))
        ea, eb = ends(sa), ends(sb)
        shared = sorted(set(ea) & set(eb))
        ga, gb = defaultdict(list), defaultdict(list)
        at = {e: i for i, e in enumerate(shared)}

        def number(e):
            while e not in at:
                e += 1
            return at[e]

        for k, e in zip(a, ea, strict=True):
            ga[number(e)].append(k)
        for k, e in zip(b, eb, strict=True):
            gb[number(e)].append(k)
        return len(a), len(b), [(ga[i], gb[i]) for i in range(len(shared))]


@pytest.fixture(scope="module")
def plain():
    return Plain()


def expected(plain, rows):
    docs = [(i, *plain.groups(t or "")) for i, t in rows]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for _, _, _, g in docs]
    count = Counter(p for c in linked for p in c)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, na, nb, g), c in zip(docs, linked, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((i, na, nb, len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if na else ""))
    return out


def rows_of(df):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


def test_parts_give_the_tokenizers_ids(plain):
    rng = random.Random(4)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("  \n\naabé,.'!▁\xa0\tÉ1日<0x41>") for _ in range(rng.randrange(50))) for _ in range(3000)]
    align = M.Aligner(*(open(p, "rb").read() for p in PATHS))
    for _ in range(2):  # the second time from the memo
        for t, got in zip(texts, align(texts), strict=True):
            a, b, *_ = plain.ids(t)
            assert "".join(align.parts(t)) == (f" {t}" if t else "") and got[:2] == (len(a), len(b)), repr(t)
        learned = {p: align.memo[p] for t in texts for p in align.parts(t) if p in align.memo}
        assert len(learned) > 1000


def key(x):
    return tuple((v is None, v or 0) for v in x[:1]) + x[1:]


def test_against_plain(spark, plain):
    rows = [(r[0], r[1]) for r in H.odd_rows() if r[1] is None or len(r[1]) < 60_000] + list(enumerate(ODD, 1000))
    docs = H.frame(spark, [(i, t, None, None, 0) for i, t in rows]).repartition(3).withColumns({c: F.lit(1) for c in ("row", "id", "pair", "pairs", "n", "count", "best", "n_a")})
    assert sorted(rows_of(M.aligned(docs, *PATHS)), key=key) == sorted(expected(plain, rows), key=key)
    assert M.aligned(H.frame(spark, []), *PATHS).count() == 0


def test_long_groups_and_full_memos(plain, monkeypatch):
    """Groups counted by distinct ids, and memos that start anew, give the same rows."""
    texts = [t or "" for t in ODD[:-4]]
    want = [(*r[:5], r[5].tolist(), r[6].tolist()) for r in M.Aligner(*(open(p, "rb").read() for p in PATHS))(texts)]
    for name in ("MANY", "PARTS", "WINDOWS"):
        monkeypatch.setattr(M, name, 1)
    align = M.Aligner(*(open(p, "rb").read() for p in PATHS))
    for _ in range(2):
        assert [(*r[:5], r[5].tolist(), r[6].tolist()) for t in texts for r in align([t])] == want


def test_given_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(rows_of(M.aligned(docs, *PATHS))) == sorted(expected(plain, rows))
    pairs = {(r.a_id, r.b_id): r["count"] for r in M.vocabulary_map(docs, *PATHS).collect()}
    assert pairs == Counter(p for _, t in rows for p in {(x, y) for a, b in plain.groups(t or "")[2] for x in a for y in b})
