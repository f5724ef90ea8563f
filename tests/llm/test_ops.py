import hashlib
import re
import zlib
from collections import Counter, defaultdict

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from calgraph.llm import decontaminate, jaccard_join, license_scan, line_dedup, mixing, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts


@pytest.fixture(scope="module")
def docs(spark):
    return H.frame(spark).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return H.frame(spark, [])


def clash(df):
    """More columns, among them names that the operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("id", "size", "key", "h", "n", "shard", "score", "line", "set_id", "tid", "tier", "_size", "_target", "row", "copies", "label", "lines", "n_words", "__text__", "_row", "component_id")})


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1


def plain_dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def bigrams(text):
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return set(zip(w, w[1:]))


def test_licences_against_plain_dice(spark, empty):
    mit = license_scan.TEMPLATES[11][1]
    wrapped = "prose before it\n\n" + mit.replace("free of charge, ", "free of charge,\n").replace("associated ", "associated\n") + "\n\nmore"
    rows = [(i, t, None, None, 0) for i, t in enumerate([None, "", "x", wrapped, "Copyright 2020 X. All rights reserved. Nothing else. " + "word " * 40, "All rights reserved.", "Released under the MIT License.", "prose here\nreleased UNDER the mit license!!\nmore", "Licensed under the Apache License, Version 2.0", "All rights reserved. All rights reserved.", "nothing of it"])]
    got = {(r.doc_id, r.license): r.dice for r in license_scan.scan(clash(H.frame(spark, rows)), license_scan.template_table(spark)).collect()}
    want = {}
    for i, t, *_ in rows:
        t = t or ""
        for unit in [t, *re.split(r"\n[ \t\r]*\n", t), *t.split("\n"), *re.sub(r"([.!?]) +", "\\1\n", t.replace("\n", " ")).split("\n")]:
            for name, text in license_scan.TEMPLATES:
                d = plain_dice(bigrams(unit), bigrams(text))
                if d >= license_scan.THRESHOLD:
                    want[i, name] = max(want.get((i, name), 0), round(d, 6))
    assert got == pytest.approx(want) and (3, "MIT") in got and (4, "reserved") in got
    assert [r.n_units for r in license_scan.scan(H.frame(spark, rows[5:6]), license_scan.template_table(spark)).collect()] == [1]
    assert license_scan.scan(empty, license_scan.template_table(spark)).count() == 0
    assert license_scan.scan(H.frame(spark, rows), license_scan.template_table(spark).limit(0)).count() == 0


# 2


def test_mix_meets_targets(docs, empty):
    rows = mixing.mixed(docs).collect()
    total = sum(r._size for r in rows)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r._size == len(H.words(r.text)) and 0 <= r._copies <= 3
        size[r.source] += r._size
        taken[r.source] += r._size * r._copies
        target[r.source] = r._target
    names = sorted(size, key=lambda s: (s is None, s.encode() if s else b""))
    left, weight, want = float(total), dict(zip(names, [5, 2, 1] * 9)), {}
    while True:
        w = sum(weight[s] for s in names if s not in want)
        over = [s for s in names if s not in want and left * weight[s] / w > 3 * size[s]]
        if not over:
            want |= {s: left * weight[s] / w for s in names if s not in want}
            break
        for s in over:
            want[s] = 3 * size[s]
        left = total - sum(want.values())
    assert target == pytest.approx(want)
    longest = max(r._size for r in rows)
    assert all(abs(taken[s] - target[s]) <= longest for s in names)
    again = Counter((r.doc_id, r._copies) for r in mixing.mixed(docs.repartition(7)).collect())
    assert again == Counter((r.doc_id, r._copies) for r in rows)
    assert mixing.mixed(empty).count() == 0
    assert mixing.copies(docs).count() == sum(r._copies for r in rows)


def test_words_taken_are_near_even_with_short_sources(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(n)), "en", f"s{i % 6}", 0) for i, n in enumerate(rng.integers(1, 60, 600))]
    got = mixing.mixed(H.frame(spark, rows)).groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("t"), F.first("_target").alias("w")).collect()
    assert all(abs(r.t - r.w) <= 0.02 * r.w + 5 for r in got)


# 3


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return prev[-1]


def test_banded_distance(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(200):
        a = "".join(rng.choice(list("abé\U0001f600"), rng.integers(0, 60)))
        b = list(a)
        for _ in range(rng.integers(0, 8)):
            p = int(rng.integers(0, len(b) + 1))
            b[p : p + int(rng.integers(0, 2))] = rng.choice(list("abé"), rng.integers(0, 2)).tolist()
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "x string, y string")
    letters = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    ok = [line_dedup.within(F.col("x"), F.col("y"), F.lit(t)).alias(f"t{t}") for t in (0, 2, 5)]
    for r in df.select("x", "y", line_dedup.banded(letters("x"), letters("y")).alias("d"), *ok).collect():
        d = edits(r.x, r.y)
        assert (min(r.d, 6), r.t0, r.t2, r.t5) == (min(d, 6), d <= 0, d <= 2, d <= 5), r


def test_line_dedup_against_plain(spark, empty):
    rng = np.random.default_rng(6)
    line = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    base = [line(int(rng.integers(30, 70))).strip() or "x" for _ in range(20)]
    rows = []
    for i in range(30):
        ls = []
        for _ in range(4):
            x = list(base[rng.integers(0, len(base))])
            for _ in range(rng.integers(0, 3)):
                x[rng.integers(0, len(x))] = "z"
            ls.append("".join(x))
        rows.append((i, "\n".join([*ls, "", " \t"]), None, None, 0))
    rows += [(100, None, None, None, 0), (101, "", None, None, 0), rows[0]]
    got = by_id(line_dedup.dedup_lines(clash(H.frame(spark, rows))))
    where = defaultdict(list)
    for i, t, *_ in sorted({r[:2] for r in rows if r[1]}):
        for k, x in enumerate(t.split("\n")):
            if H.words(x):
                where[x].append((i, k))
    parent = {x: x for x in where}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = list(where)
    for p, a in enumerate(names):
        for b in names[:p]:
            t = H.line_budget(min(len(a), len(b)))
            if t and H.near(a, b, t):
                parent[root(a)] = root(b)
    first, size = {}, Counter(root(x) for x in where)
    for x, at in where.items():
        first[root(x)] = min([first.get(root(x), at[0]), *at])
    for i in {r[0] for r in rows}:
        own = [(x, k) for x, at in where.items() for j, k in at if j == i]
        gone = [(x, k) for x, k in own if (i, k) > first[root(x)]]
        assert (got[i].n_lines, got[i].n_removed, got[i].n_links) == (len(own), len(gone), sum(size[root(x)] - 1 for x, _ in own)), i
    assert line_dedup.dedup_lines(empty).count() == 0


# 4


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_classifier.op4_quality_classifier(spark, sf)
    both = out.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(both) > 80 and sum(r.predicted == r.quality for r in both) / len(both) > 0.95


def test_classifier_odd_cases(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (9999, 0)], "id long, label int")
    rows = quality_classifier.classify(clash(docs), labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(empty, labels).count() == 0
    kept = quality_classifier.accepted(clash(docs), labels)
    assert kept.columns == clash(docs).columns and {r.score for r in kept.collect()} <= {1}


def test_votes_against_plain():
    rng = np.random.default_rng(3)
    model = {"idf": np.ones(2 * quality_classifier.TERMS, np.float32), "axes": rng.standard_normal((2 * quality_classifier.TERMS, 8)).astype(np.float32), "labels": rng.integers(0, 2, 90).astype(float), "mean": 0.5}
    one = quality_classifier.unit(rng.standard_normal((30, 8)).astype(np.float32))
    model["vectors"] = np.concatenate([one, one, one])  # every similarity ties three times
    c = rng.integers(0, 3, (20, 2 * quality_classifier.TERMS)).astype(np.float32)
    y = quality_classifier.unit(quality_classifier.weighted(c, model["idf"]) @ model["axes"])
    for got, v in zip(quality_classifier.vote(model, c, 10), y, strict=True):
        sims = (v[None] @ model["vectors"].T)[0]
        near = sorted(range(90), key=lambda i: (-sims[i], i))[:10]
        w = [max(0.0, float(sims[i])) for i in near]
        want = sum(x * model["labels"][i] for x, i in zip(w, near, strict=True)) / sum(w) if sum(w) else 0.5
        assert abs(got - want) < 1e-5


# 5


def plain_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def test_suffix_dedup_against_plain(spark, empty):
    rng = np.random.default_rng(8)
    part = lambda n: "".join(rng.choice(list("abcd é"), n))
    shared = [part(260), part(199), part(420), "ab" * 300]
    texts = [part(int(rng.integers(0, 300))) + shared[rng.integers(0, 4)] + part(int(rng.integers(0, 300))) for _ in range(40)]
    texts += [None, "", "x", texts[0], shared[1], "a" * 500]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = by_id(suffix_dedup.deduplicate(clash(H.frame(spark, rows))))
    raw = [(t or "").encode() for t in texts]
    for i, (t, gone) in enumerate(zip(raw, plain_removed(raw, 200), strict=True)):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(25):
        parts = [rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 60)).astype(np.uint8) for _ in range(rng.integers(1, 12))]
        data, size = np.concatenate(parts), np.array([len(p) for p in parts])
        ends = np.repeat(np.cumsum(size), size)
        order, rank = suffix_dedup.suffix_array(data, ends)
        assert order.tolist() == sorted(range(len(data)), key=lambda p: ([int(x) + 1 for x in data[p : ends[p]]] + [0], ends[p])), trial
        lcp = suffix_dedup.kasai(data, ends, order, rank, 20)
        for k in range(1, len(order)):
            a, b, x = order[k], order[k - 1], 0
            while x < 20 and a + x < ends[a] and b + x < ends[b] and data[a + x] == data[b + x]:
                x += 1
            assert lcp[a] == x


# 6


def test_quality_rules_against_plain(docs, empty):
    for r in quality_rules.judged(clash(docs)).collect():
        t, w = r.text or "", H.words(r.text)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if H.words(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)
    assert quality_rules.judged(empty).count() == 0


def test_quality_rules_reject_what_is_marked_bad(spark):
    sf = "/root/testdata/sf0.001"
    both = quality_rules.op6_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r.kept == (r.quality == 1) for r in both)


# 7


def test_shards_are_even_and_gapless(docs, empty):
    rows = sharding.shard(clash(docs)).collect()
    assert len(rows) == docs.count()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty).count() == 0


def test_equal_texts_share_a_shard_and_a_hot_group_is_split(spark):
    rows = [(i, "hot text", None, None, 0) for i in range(400)] + [(1000 + i, f"single {i}", None, None, 0) for i in range(600)] + [(5000 + i, f"pair {i // 2}", None, None, 0) for i in range(200)]
    out = sharding.shard(H.frame(spark, rows)).collect()
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 0.02 * max(load.values())
    where = defaultdict(set)
    for r in out:
        where[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 3
    assert len(where[zlib.crc32(b"hot text")]) <= 4


# 8


def test_decontamination(spark, empty):
    item = "The quick brown fox jumps over the lazy dog, and then it sleeps in the warm sun all day."
    far = "".join("x" if i % 6 == 0 else c for i, c in enumerate(item))
    rows = [(0, item, None, None, 0), (1, "before " + item.upper() + " after", None, None, 0), (2, "pre\n" + item.replace("lazy", "lzay").replace(" ", "\n"), None, None, 0), (3, far, None, None, 0), (4, None, None, None, 0), (5, "", None, None, 0), (6, item[:40], None, None, 0), (7, item + item, None, None, 0), (0, item, None, None, 0)]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "  "), (4, "zzz")], "item_id long, text string")
    docs = clash(H.frame(spark, rows))
    got = Counter((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in decontaminate.contaminated(docs, bench).collect())
    n = len(item)
    assert got == Counter({(0, 1, 0, 0, n): 2, (1, 1, 0, 7, 7 + n): 1, (2, 1, 2, 4, 4 + n): 1, (7, 1, 0, 0, n): 1})
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    named = bench.selectExpr("concat('item-', item_id) as item_id", "text")
    assert {r.item_id for r in decontaminate.contaminated(docs, named).collect()} == {"item-1"}
    short = spark.createDataFrame([(1, "e"), (2, "fox jumps"), (3, "ox jumps")], "item_id long, text string")
    assert {r.item_id for r in decontaminate.contaminated(docs, short).collect()} == {2}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_search_equals_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(200):
        p, t = ("".join(rng.choice(list("abc"), n)) for n in (rng.integers(1, 9), rng.integers(0, 25)))
        best = min(edits(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert decontaminate.nearest(p, t)[0] == best
    item = "".join(rng.choice(list("abcdef "), 64)).strip()
    s = decontaminate.Searcher([(1, item)], 16)
    for _ in range(60):
        v = list(item)
        for _ in range(rng.integers(0, 8)):
            v[rng.integers(0, len(v))] = rng.choice(list("xyz"))
        text = "q" * 30 + "".join(v) + "q" * 30
        d = edits_of_best(item, text)
        assert bool(s.find(text)) == (d <= len(item) // 16)


def edits_of_best(p, t):
    prev = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        cur = [i]
        for j, y in enumerate(t, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


# 9


def test_token_counts_add_up_and_round_trip(docs, empty):
    from pathlib import Path

    coder, size = token_counts.encoder(Path(token_counts.VOCABULARY).read_bytes())
    for r in token_counts.token_counts(clash(docs)).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        t = r.text or ""
        tokens = coder.encode_ordinary(t)
        assert r.n_tokens == len(tokens) == sum(r.section_tokens)
        assert coder.decode_bytes(tokens) == t.encode() and sum(size[tokens]) == len(t.encode())
        assert r.n_sections == (len(t.removesuffix("\n").split("\n")) if t else 0)
    assert token_counts.token_counts(empty).count() == 0


def test_sections_against_plain_attribution(spark):
    from pathlib import Path

    texts = ["alpha beta\ngamma  \n\n delta\n", "one\ntwo\nthree", "\n\n\n", "caf\u00e9\n\u00e9t\u00e9 \U0001f600\n x"]
    coder, size = token_counts.encoder(Path(token_counts.VOCABULARY).read_bytes())
    got = by_id(token_counts.token_counts(H.frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])))
    for i, t in enumerate(texts):
        raw = t.encode()
        section = [raw[:p].count(b"\n") for p in range(len(raw))]
        counts, at = [0] * (section[-1] + 1), 0
        for token in coder.encode_ordinary(t):
            own = section[at : at + size[token]]
            counts[max(sorted(set(own)), key=own.count)] += 1
            at += size[token]
        assert got[i].section_tokens == counts


def test_crossing_tokens_go_where_most_of_them_is():
    counts, crossing = token_counts.attribute(np.array([0, 4, 9]), np.array([4, 9, 10]), np.array([0, 6, 9]))
    assert counts.tolist() == [1, 1, 1] and crossing == 1
    counts, _ = token_counts.attribute(np.array([0]), np.array([4]), np.array([0, 2]))
    assert counts.tolist() == [1, 0]


# 10


def plain_components(rows):
    sets = {i: H.shingles(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[:p]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_components_against_plain(spark, docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(clash(docs)).collect() if r.doc_id is not None}
    assert got == plain_components(H.odd_rows())
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_large_near_copy_group_loses_no_link(spark):
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(120):
        v = list(base)
        for k in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            v[k] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(v), None, None, 0))
    rows += [(500 + i, " ".join(base[:60] + [f"o{i}_{k}" for k in range(200)]), None, None, 0) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(H.frame(spark, rows)).collect()}
    assert got == plain_components(rows)


def test_symbols_bound_the_symmetric_difference():
    from calgraph.llm import bytesops as B

    rng = np.random.default_rng(9)
    for n in (3, 20, 300):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 4 // 5], rng.integers(0, 2**63, n // 5 + 1).astype(np.uint64)]))
        v, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        key, row = jaccard_join.pieces(v, first, np.array([0, 1]), False)
        if jaccard_join.band(np.array([len(a)]))[0] == jaccard_join.band(np.array([len(b)]))[0]:
            agree = len(set(key[row == 0].tolist()) & set(key[row == 1].tolist()))
            delta = len(set(a.tolist()) ^ set(b.tolist()))
            assert max((row == 0).sum(), (row == 1).sum()) - agree <= delta
    assert B.mix64(np.arange(3)).dtype == np.uint64
