from collections import Counter

import helpers as H
from compare import assert_same, database
from pyspark.sql import functions as F

import corpus_pipeline
from calgraph.llm import common, license_scan, quality_classifier

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        n.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "n-gram Jaccard join":
            sets = [H.shingles(r.text) for r in docs.collect()]
            assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)
        if name == "benchmark decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(t in r.text for r in docs.collect() for t in items)
    assert n[0] > n[1] > n[2] > n[3] and n[4] == n[5] > 0


def test_stages_take_odd_and_empty_tables(spark):
    for rows in (H.odd_rows(), []):
        docs = H.frame(spark, rows).withColumns({c: F.lit(1) for c in ("row", "key", "score", "_size", "component_id", "label")})
        for name, stage in corpus_pipeline.STAGES:
            before = Counter(r.text for r in docs.collect())
            docs = corpus_pipeline.written(stage(spark, docs, SF))
            after = Counter(r.text for r in docs.collect()) if "text" in docs.columns else None
            if after is not None:
                assert all(after[t] <= before[t] * (3 if name.startswith("mixing") else 1) for t in after), name
            assert rows or docs.isEmpty()


def test_classifier_stage_equals_its_scores(spark):
    """The first stage keeps just the rows that the operator scores 0.5 or more, and of its labelled rows the good ones."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    scores = {r.doc_id: r.score for r in quality_classifier.op4_quality_classifier(spark, SF).collect()}
    assert kept == {i for i, x in scores.items() if x >= 0.5}
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert sum((i in kept) == (q == 1) for i, q in known.items()) >= 0.95 * len(known)


def test_run_leaves_one_table(spark):
    older = set(common.made())
    out = corpus_pipeline.run(spark, SF)
    assert len(set(common.made()) - older) == 1 and out.count() > 0


def test_licence_query_equals_its_sql(spark):
    assert_same(license_scan.op1_license_scan(spark, SF), license_scan.ORACLE, database(SF))
