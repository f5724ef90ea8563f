"""Licence scan by the Dice coefficient over word bigrams, in DataFrame functions only.

A text is normalised (lower case, everything but letters and digits a blank) and compared with licence
templates as sets of word bigrams: 2 * common / (sum of sizes). Units are the whole text, its paragraphs
(between blank lines), its lines and its sentences, in which line breaks are blanks; so a notice alone on a
line, one wrapped over several lines and one within a line of prose are all found.

With a threshold t a template of b bigrams can only match a unit of t / (2 - t) * b to (2 - t) / t * b of
them, so units and templates meet in an equi-join over size bands and the exact bounds, and nothing is
compared outside them. A match lacks at most the share 1 - t / (2 - t) of the template's bigrams, so of one
more than that some must stand in the text: texts without any are not split. Templates are a table whose rows
are checked to be few before it is broadcast.

Defined cases: null, blank and one-word units have no bigrams and match nothing; equal units of a text count
once; ties between templates are all returned; repeated rows are added up in their id's row; other columns
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, small, table

THRESHOLD = 0.8
#: Template bigrams that a text is tested for, at most; with more templates all texts are split.
PHRASES = 400

#: Notices by which licences are commonly stated.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved."),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]


def plain(text: Column) -> Column:
    """Normalised, with one blank between words."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def bigrams(unit: Column) -> Column:
    """Distinct hashed word bigrams of a text."""
    w = F.array_remove(F.split(plain(unit), " "), "")
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i)))
    return let(w, lambda w: F.when(F.size(w) > 1, F.array_distinct(pairs(w))).otherwise(F.array().cast("array<long>")))


def units(text: Column) -> Column:
    """The text, its paragraphs, lines and sentences, each once."""
    sentences = F.split(F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), r"([.!?]) +", "$1\n"), "\n")
    return F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, "\n"), sentences))


def phrases(templates: DataFrame, threshold: float, most: int = PHRASES) -> list[str] | None:
    """Bigrams of which every match has one: per template the longest of its bigrams, more than a match may lack. None if templates or bigrams are too many."""
    size = F.size(bigrams(F.col("text")))
    held = templates.select(plain(F.col("text")), size).where(size > 0).limit(most + 1).collect()
    if len(held) > most:
        return None
    found: set[str] = set()
    for text, n in held:
        w = text.split()
        every = sorted({f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)}, key=lambda x: (-len(x), x))
        found.update(every[: n - math.ceil(threshold / (2 - threshold) * n - 1e-9) + 1])
    return sorted(found) if len(found) <= most else None


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document and licence: best dice, n_units (different matching units) and first_line (the first line that matches by itself, from 1; 0 if none does).

    ``templates(license, text)``.
    """
    ratio = (2 - threshold) / threshold
    band = lambda size: F.floor(F.log(size) / math.log(ratio)).cast("int")
    t = templates.select("license", F.col("text").alias("_t")).withColumn("tb", bigrams(F.col("_t"))).withColumn("tn", F.size("tb")).where("tn > 0")
    t = t.withColumn("band", F.explode(F.sequence(band(F.col("tn")) - 1, band(F.col("tn")) + 1))).drop("_t")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    wanted = phrases(templates, threshold)
    if wanted is not None:
        some = lambda x: F.exists(F.array(*(F.lit(p) for p in wanted)), x.contains)
        rows = rows.where(let(plain(F.col("text")), some) if wanted else F.lit(False))
    rows = rows.select("id", F.split("text", "\n").alias("lines"), F.explode(units(F.col("text"))).alias("unit")).where("length(unit) > 2")
    rows = rows.select("id", F.array_position("lines", F.col("unit")).alias("line"), F.xxhash64("unit").alias("name"), bigrams(F.col("unit")).alias("ub")).withColumn("un", F.size("ub")).where("un > 0").withColumn("band", band(F.col("un")))
    fits = (F.col("un") * ratio >= F.col("tn") - 1e-9) & (F.col("un") <= F.col("tn") * ratio + 1e-9)
    pairs = rows.join(small(t), "band").where(fits)
    pairs = pairs.withColumn("dice", 2.0 * F.size(F.array_intersect("ub", "tb")) / (F.col("un") + F.col("tn"))).where(F.col("dice") >= threshold)
    first = F.coalesce(F.min(F.when(F.col("line") > 0, F.col("line"))), F.lit(0)).cast("long")
    return pairs.groupBy("id", "license").agg(F.round(F.max("dice"), 6).alias("dice"), F.count_distinct("name").alias("n_units"), first.alias("first_line")).withColumnRenamed("id", id_col)


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), template_table(spark))


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_ORACLE_TEMPLATES = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in TEMPLATES)
_SQL_WORDS = "list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
_SQL_PAIRS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
ORACLE = f"""
WITH t AS (SELECT license, {_SQL_PAIRS.format('w')} AS tb FROM (SELECT license, {_SQL_WORDS.format('text')} AS w FROM (VALUES {_ORACLE_TEMPLATES}) AS v(license, text))),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?]) +', '\\1' || chr(10), 'g'), chr(10)) AS sentences, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS paragraphs FROM documents WHERE text IS NOT NULL),
u AS (SELECT DISTINCT doc_id, lines, unnest([text] || lines || sentences || paragraphs) AS unit FROM d),
b AS (SELECT doc_id, coalesce(list_position(lines, unit), 0) AS line, unit, {_SQL_PAIRS.format('w')} AS ub FROM (SELECT *, {_SQL_WORDS.format('unit')} AS w FROM u) WHERE len(w) > 1),
p AS (SELECT doc_id, line, unit, license, 2.0 * len(list_intersect(ub, tb)) / (len(ub) + len(tb)) AS dice FROM b JOIN t ON len(ub) BETWEEN len(tb) / 1.5 AND len(tb) * 1.5)
SELECT doc_id, license, round(max(dice), 6) AS dice, count(DISTINCT unit) AS n_units, CAST(coalesce(min(CASE WHEN line > 0 THEN line END), 0) AS BIGINT) AS first_line FROM p WHERE dice >= 0.8 GROUP BY doc_id, license
"""

QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES = {"op1_license_scan": ORACLE}
