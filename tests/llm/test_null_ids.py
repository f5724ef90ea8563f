"""Documents without an id, and ids on several rows, lose nothing."""

import random

import helpers as H

import corpus_pipeline
from calgraph.llm import jaccard_join, line_dedup, suffix_dedup


def text(seed, n=120):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def near(t):
    return t + " and a tail"


def test_pipeline_keeps_one_row_of_each_group(spark):
    a, b, c, d = map(text, range(4))
    rows = [(None, a), (None, near(a)), (None, b), (5, near(b)), (6, c), (6, c), (6, d), (3, near(d)), (None, None), (None, "alone"), (None, "alone")]
    docs = H.frame(spark, [(i, t, "en", "s", len(t or "")) for i, t in rows]).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()), key=repr)
    want = [(5, near(b)), (6, c), (3, near(d)), (None, None), (None, "alone")]
    assert sorted((x for x in got if x[1] not in (a, near(a))), key=repr) == sorted(want, key=repr)
    assert len(got) == len(want) + 1


def test_join_links_through_documents_without_an_id(spark):
    base = [f"b{i}" for i in range(100)]
    # 1 and 2 are near only to the row between them.
    far = lambda k: " ".join(base[k:] + [f"t{i}" for i in range(k)])
    texts = {k: far(k) for k in (0, 9, 18)}
    sets = {k: H.shingles(t) for k, t in texts.items()}
    alike = lambda x, y: 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])
    assert alike(0, 9) and alike(9, 18) and not alike(0, 18)
    rows = [(1, texts[0], None, None, 0), (None, texts[9], None, None, 0), (2, texts[18], None, None, 0)]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(H.frame(spark, rows)).collect()}
    assert got == {1: 1, None: 1, 2: 1}


def test_suffix_dedup_reads_documents_without_an_id(spark):
    shared = text(7, 60)
    rows = [(1, "x " + shared + " y", None, None, 0), (None, "other " + shared + " end", None, None, 0)]
    given = [(i + 1, *r[1:]) for i, r in enumerate(rows)]
    cut = lambda rows: sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(H.frame(spark, rows)).collect())
    got = cut(rows)
    assert got == cut(given) and sum(r[1] for r in got) > 0


def test_lines_of_documents_without_an_id_are_counted(spark):
    rows = [(None, "one line\nand two", None, None, 0), (4, "one line\nthree", None, None, 0)]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(H.frame(spark, rows)).collect()}
    assert got == {None: (2, 0), 4: (2, 1)}
