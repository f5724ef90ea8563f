"""Line-first quality rules, in DataFrame functions only.

Every line with a word is judged by itself. It fails if
- it does not end like a sentence (a closing mark or a quote or bracket after one) and has under ten words;
- it is navigation: a bar for every three words or more, or under three words and no sentence;
- it is boilerplate (rights, licence, cookie and similar notices);
- one character in ten or more of its words is a symbol;
- it shouts: three words in a row in capitals, each followed by two or more exclamation marks.
Lines that fail are removed; a document that loses more than ``MAX_LOSS`` % of its word characters is
rejected. Before that the base rules reject documents that are too short or repeat themselves.

Everything is computed within the row, and costly tests run only where a cheap one on the text or the line
lets them: most texts hold no notice, symbol or bar, and a text whose windows are all distinct has no
repeats. Repeated three-word windows are found by a sort of their hashes with their places; neighbours with
equal hashes are compared word by word.

Defined cases: a null or blank text has no words and fails the base rules; lines are split at \\n alone;
equal lines count from the second on; repeated rows are judged alike; other columns pass through, but one
that has the name of a result is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, table

#: Marks that count as symbols, marks that may end a sentence, white space, and what is in every notice that makes a line boilerplate.
SYMBOLS = "#*$%&|<>"
ENDS = ".!?\u2026:;\"'\u201d\u00bb)"
SPACE = " \t\n\x0b\x0c\r"
BOILERPLATE = r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookies?|subscribe|sign (in|up)|log ?in|click here|read more|javascript|licensed under|released under the)\b|©"
NOTICES = ("all rights reserved", "terms of ", "privacy policy", "cookie", "subscribe", "sign in", "sign up", "log in", "login", "click here", "read more", "javascript", "licensed under", "released under the", "\u00a9")
SHOUTING = r"(?:\p{Lu}{2,}\S*!![\x20]*){3}"

MIN_WORDS = 50
MAX_REPEATS = 50
MIN_LINE_WORDS = 3
SHORT_LINE_WORDS = 10
MAX_LOSS = 50
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept", "clean_text")


def repeat_words(words: Column) -> Column:
    """Words within three-word windows that stand twice or more in an array of words.

    The array is bound once: a filter that is pushed below would else compute it again for each window.
    """
    return let(words, _repeat_words).cast("long")


def _repeat_words(w: Column) -> Column:
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def same(x: Column, y: Column) -> Column:
        equal = x["h"] == y["h"]
        for k in range(3):
            equal = equal & (F.get(w, x["i"] + k) == F.get(w, y["i"] + k))
        return F.coalesce(equal, F.lit(False))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.transform(s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x["i"]))
        places = F.sort_array(F.filter(let(placed, twice), lambda x: x.isNotNull()))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("p")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["p"])).alias("n"), p.alias("p")), lambda s: s["n"])

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(some)


def line_fails(line: Column, notices: Column | None = None, symbols: Column | None = None) -> Column:
    """Whether a line fails; notices and symbols: whether its text has any, so that most lines skip these tests."""
    true = F.lit(True)
    n = F.regexp_count(line, F.lit(WORD))
    sentence = F.substring(F.rtrim(line, F.lit(SPACE)), -1, 1).isin(list(ENDS))
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    layout = ~sentence & (n < SHORT_LINE_WORDS) | line.contains("|") & (bars * 3 >= n) | ~sentence & (n < MIN_LINE_WORDS)
    marks = F.regexp_count(line, F.lit(f"[{SYMBOLS}]"))
    chars = F.length(line) - F.regexp_count(line, F.lit(r"[\x20\x09-\x0D]"))
    return layout | (true if notices is None else notices) & line.rlike(BOILERPLATE) | (true if symbols is None else symbols) & (marks * 10 > chars) | line.contains("!!") & line.rlike(SHOUTING)


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept, and the kept lines as clean_text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The input's columns go in a struct, so their names cannot clash with those used here.
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in RESULTS)).alias("row"), text.alias("t"))
    low, lines = F.lower("t"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    notices = F.lit(False)
    for x in NOTICES:
        notices = notices | low.contains(x)
    out = out.select("row", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("w"), lines.alias("lines"), notices.alias("notices"), F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"))
    flags = F.struct(F.col("notices").alias("notices"), (F.col("n_symbols") > 0).alias("symbols"))
    good = let(flags, lambda f: F.filter("lines", lambda x: ~line_fails(x, f["notices"], f["symbols"])))
    out = out.select("row", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols", "lines", repeat_words(F.col("w")).alias("n_repeat_words"), good.alias("good"))
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).withColumn("clean_text", F.array_join("good", "\n"))
    left = F.length("clean_text") - F.regexp_count("clean_text", F.lit(r"[\x20\x09-\x0D]"))
    out = out.withColumn("lost_chars", F.when(F.size("good") == F.size("lines"), 0).otherwise(F.col("word_chars") - left).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATS * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOSS * F.col("word_chars")))
    return out.select("row.*", *RESULTS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(c for c in RESULTS if c != "clean_text"))


_SPACE = r"[\x20\x09-\x0D]"
_BARE = "length(regexp_replace({0}, '" + _SPACE + "+', '', 'g'))"
_MARKS = f"(length({{0}}) - length(translate({{0}}, '{SYMBOLS}', '')))"
ORACLE = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, x, len(regexp_extract_all(x, '{WORD}')) AS n, len(x) - len(replace(x, '|', '')) AS bars, {_BARE.format('x')} AS chars, {_MARKS.format('x')} AS marks, regexp_matches(x, '[.!?…:;"''”»)]{_SPACE}*$') AS sentence FROM (SELECT doc_id, unnest(lines) AS x FROM w)),
k AS (SELECT doc_id, sum(chars) AS kept_chars FROM l WHERE NOT ((NOT sentence AND n < 10) OR bars * 3 >= n OR (n < {MIN_LINE_WORDS} AND NOT sentence) OR regexp_matches(x, '{BOILERPLATE}') OR marks * 10 > chars OR regexp_matches(x, '(?:\\p{{Lu}}{{2,}}\\S*!![\\x20]*){{3}}')) GROUP BY 1),
m AS (SELECT w.doc_id, len(w) AS n_words, CAST({_BARE.format('t')} AS BIGINT) AS word_chars, CAST({_MARKS.format('t')} AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST({_BARE.format('t')} - coalesce(kept_chars, 0) AS BIGINT) AS lost_chars FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATS} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {MAX_LOSS} * word_chars AS kept, lost_chars FROM f
"""

QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": ORACLE}
