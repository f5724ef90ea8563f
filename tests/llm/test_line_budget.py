import random
from pathlib import Path
from urllib.parse import urlparse

import helpers as H
import pytest
from pyspark.sql import functions as F

from calgraph.llm import line_dedup
from calgraph.llm.common import written


def classes_of(spark, lines):
    """The line classes of two lines or more, from the operator."""
    docs = H.frame(spark, [(i, x, None, None, 0) for i, x in enumerate(lines)]).select(F.col("doc_id").alias("id"), "text")
    h = {r.h: r.line for r in line_dedup.lines_of(docs).collect()}
    got = {}
    for r in line_dedup.links(docs)[1].collect():
        got.setdefault(r.label, set()).add(h[r.id])
    return {frozenset(x) for x in got.values()}


def plain_classes(lines):
    names, parent = sorted(set(lines)), {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            t = H.line_budget(min(len(a), len(b)))
            if t and H.near(a, b, t):
                parent[root(a)] = root(b)
    got = {}
    for x in names:
        got.setdefault(root(x), set()).add(x)
    return {frozenset(x) for x in got.values() if len(x) > 1}


def spread(x, k, rng):
    """k single edits, one in each k-th of the line, which leaves the shortest unchanged runs."""
    y = list(x)
    for j in reversed(range(k)):
        p = j * len(x) // k + rng.randrange(max(1, len(x) // k))
        y[p : p + rng.choice((0, 1, 1))] = rng.choice(("#", "\u00e9", ""))
    return "".join(y)


@pytest.mark.parametrize("seed", [3, 4])
def test_lines_with_spread_edits_against_plain(spark, seed):
    rng = random.Random(seed)
    lines = []
    for n in (24, 31, 32, 33, 47, 63, 64, 65, 80, 95, 96, 112, 127, 128, 131, 200, 333):
        x = "".join(rng.choice("abcdefghij \u00e9\U0001f600") for _ in range(n))
        lines.append(x)
        t = H.line_budget(n)
        for k in (1, t, t, t + 1, t + 2):
            lines.append(spread(x, k, rng) if k else x)
        lines += [x + "#" * t, "#" * t + x, x + "#" * (t + 1), x[: len(x) // 2] + "#" * t + x[len(x) // 2 :]]
    want = plain_classes(lines)
    assert classes_of(spark, lines) == want and sum(map(len, want)) > 60


def test_large_groups_lose_no_class(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    base = [" ".join(word() for _ in range(30)) for _ in range(2)]
    lines = [spread(b, rng.randrange(4), rng) for b in base for _ in range(40)]
    # Lines that share their start and nothing else, and a pair among them that is near only to each other.
    start = " ".join(word() for _ in range(12))
    far = [start + " " + " ".join(word() for _ in range(14)) for _ in range(40)]
    lines += [*far, spread(far[7], 2, rng), spread(far[9], 3, rng)]
    assert classes_of(spark, lines) == plain_classes(lines)


def test_a_replaced_word_is_near(spark):
    one = " ".join(f"word{i}" for i in range(40))
    two = one.replace("word7 ", "ward77 ")
    rows = [(0, one, None, None, 0), (1, two, None, None, 0), (2, two.replace("word30", "worn31"), None, None, 0)]
    assert {r.doc_id: r.n_near for r in line_dedup.dedup_lines(H.frame(spark, rows)).collect()} == {0: 0, 1: 1, 2: 1}


def test_hot_and_very_long_lines(spark):
    long_ = " ".join(f"w{i}" for i in range(20_000))
    rows = [(i, "the same line stands in every text of this table\nline number %d alone" % (i * 7919), None, None, 0) for i in range(300)] + [(900, long_, None, None, 0), (901, long_[:-3] + "xyz", None, None, 0)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_near) for r in line_dedup.dedup_lines(H.frame(spark, rows)).collect()}
    assert all(got[i][:2] == (2, 1) for i in range(1, 300) if got[i][2] == 0) and got[900] == (1, 0, 0) and got[901] == (1, 1, 1)


def test_letter_differences_against_plain(spark):
    rng = random.Random(8)
    rows = [["".join(rng.choice("etanorsx z") for _ in range(rng.randrange(400))) for _ in range(2)] for _ in range(60)] + [["e" * 300, "s" * 300], ["", "e" * 127]]
    df = spark.createDataFrame(rows, "x string, y string").select("x", "y", line_dedup._apart(line_dedup._letters(F.col("x"), line_dedup.LETTERS[0]), line_dedup._letters(F.col("y"), line_dedup.LETTERS[0])).alias("n"))
    for r in df.collect():
        assert r.n == sum(abs(min(127, r.x.count(c)) - min(127, r.y.count(c))) for c in line_dedup.LETTERS[0])


def test_large_groups_lose_no_pair(spark, monkeypatch):
    """All pairs within the budget, inside classes too, in groups of one block and of many; n_pairs counts them by document."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(2, 8)))
    base = [" ".join(word() for _ in range(n)) for n in (9, 16, 40)]
    lines = sorted({spread(b, rng.randrange(5), rng) for b in base for _ in range(40)})
    want = {(a, b) for i, b in enumerate(lines) for a in lines[:i] if (t := H.line_budget(min(len(a), len(b)))) and H.near(a, b, t)}
    rows = [(i, f"{x}\n{x}\nshort {i}", None, None, 0) for i, x in enumerate(lines)]
    docs = H.frame(spark, rows).select(F.col("doc_id").alias("id"), "text")
    h = {r.h: r.line for r in line_dedup.lines_of(docs).collect()}
    for block in (128, 16):
        monkeypatch.setattr(line_dedup, "BLOCK", block, raising=False)
        got = [tuple(sorted((h[r.a], h[r.b]))) for r in line_dedup.links(docs)[0].collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 250
    got = {r.doc_id: r.n_pairs for r in line_dedup.dedup_lines(H.frame(spark, rows)).collect()}
    assert got == {i: 2 * sum(x in p for p in want) for i, x in enumerate(lines)}


def test_letter_codes_never_exceed_the_edits(spark):
    """Bits of the halves' codes in which two lines differ are two an edit at most."""
    rng = random.Random(9)
    rows = []
    for _ in range(150):
        x = "".join(rng.choice(" etanorshildwucmé") for _ in range(rng.randrange(64, 400)))
        k = rng.randrange(6)
        rows.append((x, spread(x, k, rng) if k else x, k))
    df = spark.createDataFrame(rows, "x string, y string, k int").withColumn("c", F.floor(F.least(F.length("x"), F.length("y")) / 32).cast("int"))
    both = zip(*(line_dedup.halves(F.col(side), F.col("c")) for side in ("x", "y")), strict=True)
    for r in df.select("k", sum((F.bit_count(a.bitwiseXOR(b)) for a, b in both), F.lit(0)).alias("n")).collect():
        assert r.n <= 2 * r.k


def test_texts_are_not_moved_to_make_lines_distinct(spark, monkeypatch):
    """Lines that have no partner leave no text in the operator's tables, and lines of many copies count as before."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows = [(i, "\n".join(" ".join(word() for _ in range(120)) for _ in range(8)), None, None, 0) for i in range(400)]
    made = []
    monkeypatch.setattr(line_dedup, "written", lambda df: made.append(written(df)) or made[-1])
    got = line_dedup.dedup_lines(H.frame(spark, rows)).collect()
    assert len(got) == 400 and all(r.n_lines == 8 and r.n_removed == 0 for r in got)
    kept = sum(Path(urlparse(f).path).stat().st_size for df in made for f in df.inputFiles())
    assert kept < 0.25 * sum(len(r[1]) for r in rows)


@pytest.mark.parametrize(("copies", "share"), [(0, 500_000), (16, 500_000), (16, 1)])
def test_copies_are_keyed_once_or_one_by_one(spark, monkeypatch, copies, share):
    monkeypatch.setattr(line_dedup, "COPIES", copies)
    monkeypatch.setattr(line_dedup, "SHARE", share)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    base = [" ".join(word() for _ in range(20)) for _ in range(3)]
    lines = [x for b in base for x in (b, spread(b, 2, rng), spread(b, 4, rng))]
    times = [1, 40, 3, 2, 1, 17, 16, 1, 1]
    rows = [(i, x, None, None, 0) for i, x in enumerate(x for x, k in zip(lines, times, strict=True) for _ in range(k))]
    docs = H.frame(spark, rows + rows[:50]).select(F.col("doc_id").alias("id"), "text")
    want = {(a, b) for a in lines for b in lines if a < b and H.near(a, b, H.line_budget(min(len(a), len(b))))}
    groups = line_dedup.shared(line_dedup.texts_of(docs, line_dedup.occurrences(docs))).collect()
    assert len(groups) == len({(r.key, r.e) for r in groups}) and all(r.n == sum(s.key == r.key for s in groups) for r in groups)
    got = {r.doc_id: (r.n_lines, r.n_pairs) for r in line_dedup.dedup_lines(H.frame(spark, rows + rows[:50])).collect()}
    assert got == {r[0]: (1, sum(r[1] in p for p in want)) for r in rows} and len(want) >= 6
