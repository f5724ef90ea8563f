"""Cases in which rows were lost: many templates, scripts without blanks, documents without an id."""

import helpers as H

from calgraph.llm import decontaminate, license_scan, line_dedup


def test_more_templates_than_the_test_of_phrases_takes(spark):
    many = spark.createDataFrame([("one", f"the same notice number{i} of many") for i in range(450)] + [("MIT", "Released under the MIT License.")], "license string, text string").coalesce(1)
    docs = H.frame(spark, [(1, "Released under the MIT License.", None, None, 0), (2, "nothing here", None, None, 0)])
    assert [(r.doc_id, r.license, r.dice) for r in license_scan.scan(docs, many).collect()] == [(1, "MIT", 1.0)]
    same = spark.createDataFrame([("one", "the same notice of many")] * 450 + [("MIT", "Released under the MIT License.")], "license string, text string").coalesce(1)
    assert [(r.doc_id, r.license) for r in license_scan.scan(docs, same).collect()] == [(1, "MIT")]


def test_items_in_scripts_without_blanks(spark):
    item = "".join(map(chr, (0x4EBA, 0x5DE5, 0x667A, 0x80FD, 0x7684, 0x672A, 0x6765, 0x53D1, 0x5C55, 0x8D8B, 0x52BF, 0x5982, 0x4F55)))
    find = decontaminate.Searcher([(1, item), (2, "alphabet"), (3, "rose garden")], decontaminate.CHARS_PER_EDIT).find
    assert [x[0] for x in find(f"{item[3]}{item[5]}{item}{item[7]}")] == [1] and [x[0] for x in find(item)] == [1]
    assert not find("alphabets") and not find("prose garden") and [x[0] for x in find("an alphabet, a rose garden")] == [2, 3]


def test_documents_without_an_id_keep_their_lines(spark):
    line = "the very same line of some words in it"
    rows = [(None, f"{line}\n{t}", None, None, 0) for t in ("first tail", "second tail", "third tail")] + [(None, line, None, None, 0)] * 2 + [(7, line, None, None, 0), (7, f"other\n{line}", None, None, 0), (7, line, None, None, 0)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(H.frame(spark, rows)).collect()}
    assert (got[None].n_lines, got[None].n_removed) == (8, 4)
    assert (got[7].n_lines, got[7].n_removed) == (3, 2)
