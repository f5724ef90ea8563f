"""Cases that small tables do not reach: many shards, very long texts, repeated ids, hot lines."""

import hashlib
import random
from collections import Counter

import helpers as H
import numpy as np

from calgraph.llm import mixing, quality_rules, suffix_dedup


def test_suffix_dedup_over_many_shards_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 6_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_TEXT", 4_000)
    monkeypatch.setattr(suffix_dedup, "RANGE_TEXT", 2_000)
    rng = random.Random(4)
    part = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [part(n) for n in (200, 260, 700, 1500)]
    texts = [part(rng.randrange(300)) + rng.choice(shared) + part(rng.randrange(300)) + rng.choice(shared)[:250] for _ in range(60)]
    rows = [(rng.choice((None, i % 20, i)), t, None, None, 0) for i, t in enumerate(texts)] + [(3, texts[5], None, None, 0), (None, texts[6], None, None, 0)]
    raw = [r[1].encode() for r in rows]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    want = Counter()
    for r, t in zip(rows, raw, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want[r[0], len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(H.frame(spark, rows)).collect())
    assert got == want


def test_rows_of_one_id_have_draws_of_their_own(spark):
    """Sources meet their targets although all rows share an id, and rows that agree in all do so too."""
    rng = random.Random(1)
    for ids in ([None], [7, None]):
        rows = [(rng.choice(ids), "w " * rng.randrange(1, 60), "en", rng.choice("abc"), 0) for _ in range(400)] + [(ids[0], "the same text", "en", "c", 0)] * 300
        out = mixing.mixed(H.frame(spark, rows).repartition(3)).collect()
        taken, target = Counter(), {}
        for r in out:
            taken[r.source] += r._size * r._copies
            target[r.source] = r._target
        assert all(abs(taken[s] - t) <= 60 for s, t in target.items()), (ids, taken, target)
        again = Counter((r.doc_id, r.text, r.source, r._copies) for r in mixing.mixed(H.frame(spark, rows).repartition(5)).collect())
        assert again == Counter((r.doc_id, r.text, r.source, r._copies) for r in out)


def test_pareto_draw_against_plain(spark):
    """Of each source the rows with the least odds are taken until its words are reached."""
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 40), "en", rng.choice("ab"), 0) for i in range(300)]
    got = {r.doc_id: r for r in mixing.mixed(H.frame(spark, rows)).collect()}
    for s in "ab":
        own = [r for r in got.values() if r.source == s]
        over = sum(r._size * r._copies for r in own) - own[0]._target
        assert over <= max(r._size for r in own)
        tiers = {}
        for r in own:
            tiers.setdefault(r._size.bit_length(), set()).add(r._copies)
        assert all(max(c) - min(c) <= 1 for c in tiers.values())


def test_quality_rules_on_very_long_texts_and_clashing_names(spark):
    long_ = " ".join(f"w{i % 65_000}x{i % 7}" for i in range(70_000)) + " " + " ".join(f"w{i}x{i % 7}" for i in range(100))
    text = "One sentence is here. All rights reserved!\n" + "AB!! CD!! EF!!\n" + "a | b | c\n" + "A fair line of prose that ends well.\n" * 2
    rows = [(1, long_, None, None, 0), (2, text, None, None, 0)]
    docs = H.frame(spark, rows).selectExpr("*", "1 as w", "2 as lines", "3 as n_words", "4 as row", "5 as good")
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    w = long_.split()
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    assert got[1].n_repeat_words == len(covered) and got[1].n_words == len(w)
    assert got[2].clean_text == "A fair line of prose that ends well.\nA fair line of prose that ends well." and got[2].n_dup_lines == 1
    assert (got[2].w, got[2].lines, got[2].row, got[2].good) == (1, 2, 4, 5)
