"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Two lines are linked when they are equal, or when their edit distance is at most the shorter one's budget:
one edit per ``RATE`` code points, ``EDITS`` at most (lengths are taken in steps of ``STEP``). Linked lines
form classes (connected components); of each class the first line in order of (id, line number) stays and
the others go.

1. Lines are indexed by length class: a line enters the class of its own length, and the class below if a
   partner within the budget may be there. In a class of least length l and budget t every line is cut into
   t + 1 segments of l / (t + 1) code points; the first half are counted from the line's start, the others
   from its end. t edits leave some segment i unchanged that has i edits to its left and at most t - i to
   its right, so it moves by min(i, t - i) places at most.
2. Instead of probing every place of the other line, both lines give the segment at a few places whose
   differences make up all shifts (a difference cover), so t = 2 takes 4 keys a line and t = 5 takes 12.
   A key is the hash of the substring, its segment and the class.
3. Texts are not shuffled to make lines distinct: keys come straight from the documents and are made distinct where
   they are shared. Only lines of more than ``COPIES`` copies are made distinct before, so a repeated line costs one row a
   task. Keys are shuffled once; both the keys that two lines or more share and the lines that have them are read from
   that exchange.
4. All lines that share a key are paired, however many they are: they are dealt to blocks of some ``BLOCK`` lines and
   the pairs of blocks to tasks. Letter counts prune pairs inside the join, so few leave it: an edit changes the
   counts of a line's first and of its last half by two together, and in the halves' codes a count of one more
   differs in one bit, so that a comparison is a bit count; counts of whole lines follow.
5. In groups of more than ``FREE`` lines Spark's banded distance is the end of the join condition, so that only links
   leave the join. Other candidates are verified over what is left between the common prefix and suffix: up to
   ``BITS_UP_TO`` code points by a banded bit-parallel recurrence (2 * EDITS + 1 bits that slide along the diagonal),
   more by Spark's own banded distance. A column of the recurrence takes some 8 microseconds in lambda functions, so
   pairs that differ at both ends of a long line would take milliseconds.
Lines are known by a 64-bit hash; texts are fetched only for candidates.

Defined cases: null and blank texts have no lines; lines without a word are no lines; lines shorter than
``STEP`` have no budget and are compared exactly; lines are split at \\n alone; rows that repeat an id and a
text count as one, other documents of one id are told apart and add up in their id's row; documents without an
id come first, each row is one of its own, and they add up in one row; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, small, table, written
from .components import components

#: Edits at most, and code points that allow one.
EDITS = 5
RATE = 24
#: Width of a length class; at least EDITS. A wide one puts few lines in two classes.
STEP = 32
#: Places whose differences make up the shifts 0 to m.
COVERS = {0: (0,), 1: (0, 1), 2: (0, 1, 2), 3: (0, 1, 3), 4: (0, 1, 4, 6)}
#: Letters whose counts prune candidates, a byte each in two longs.
LETTERS = ("etanors", "hilducm")
#: What is left of a pair may have so many code points to be compared bit-parallel.
BITS_UP_TO = 32
#: Letters whose counts in each half prune candidates, a byte each in two longs.
CODED = (" etanors", "hildwucm")
#: Copies that a line may have to be keyed copy by copy, and as a share of all lines; few lines can have more than both.
COPIES = 16
SHARE = 500_000
#: Lines of a key whose pairs may leave the join before their distance is known.
FREE = 16
#: Lines of a key that make a block.
BLOCK = 128
#: What candidates know of a line.
KNOWN = ("h", "len", *(f"letters{i}" for i in range(len(LETTERS))), *(f"half{i}" for i in range(2 * len(CODED))))


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, no, line, h, len) of lines with a word, and the documents' other columns."""
    lines = docs.select(*(c for c in docs.columns if c != "text"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.withColumn("len", F.length("line")).withColumn("h", F.xxhash64("line", "len"))


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b).cast("int")


def _class_budget(c: Column) -> Column:
    return F.least(F.lit(EDITS), _div(c * STEP, RATE))


def budget(length: Column) -> Column:
    """Edits that a line of ``length`` code points may have to a longer one."""
    return _class_budget(_div(length, STEP))


def places(edits: int) -> list[int]:
    """Segments and places of a budget, packed: segment * 256 + place * 16 + the cover's last place."""
    return [i * 256 + a * 16 + COVERS[m][-1] for i in range(edits + 1) for m in [min(i, edits - i)] for a in COVERS[m]]


def entered(lines: DataFrame) -> DataFrame:
    """(e, h, len, line, c), a row for each class that a line enters; e is h, or its complement in the class below."""
    c = _div(F.col("len"), STEP)
    below = (c > 0) & (F.pmod(F.col("len"), F.lit(STEP)) < _class_budget(c - 1))
    rows = lines.select("h", "len", "line", F.explode(F.when(below, F.array(c, c - 1)).otherwise(F.array(c))).alias("c"))
    rows = rows.where(_class_budget(F.col("c")) > 0)
    return rows.withColumn("e", F.when(F.col("c") == _div(F.col("len"), STEP), F.col("h")).otherwise(F.bitwise_not("h")))


def keyed(lines: DataFrame) -> DataFrame:
    """(key, e), a row for each key of each line; a line of equal signs may give a key twice."""
    rows = entered(lines).withColumn("t", _class_budget(F.col("c"))).withColumn("size", _div(F.col("c") * STEP, F.col("t") + 1))
    every = F.array(*(F.array(*(F.lit(x) for x in places(t))) for t in range(EDITS + 1)))
    # Where each sign is a byte, a substring of the bytes is cut without counting code points.
    rows = rows.select("e", "c", "t", "len", "size", F.col("line").cast("binary").alias("raw"), (F.octet_length("line") == F.col("len")).alias("plain"), F.explode(F.get(every, F.col("t"))).alias("x"))
    i, place, last = F.shiftright("x", 8), F.shiftright("x", 4).bitwiseAND(F.lit(15)), F.col("x").bitwiseAND(F.lit(15))
    start = F.when(i * 2 <= F.col("t"), i * F.col("size")).otherwise(F.col("len") - (F.col("t") + 1 - i) * F.col("size"))
    rows = rows.select("e", "c", "raw", "plain", i.alias("i"), (start + place + 1).alias("from"), (F.col("size") - last).alias("n"))
    cut = lambda x: F.substring(x, F.col("from"), F.col("n"))
    piece = F.when(F.col("plain"), cut(F.col("raw"))).otherwise(cut(F.col("raw").cast("string")).cast("binary"))
    return rows.select(F.xxhash64(piece, "c", "i").alias("key"), "e")


def _letters(line: Column, letters: str) -> Column:
    """Counts of the letters, up to 127, a byte each."""
    count = lambda c: F.least(F.lit(127), F.length(line) - F.length(F.replace(line, c, F.lit("")))).cast("long")
    return F.aggregate(F.array(*(F.lit(c) for c in letters)), F.lit(0).cast("long"), lambda s, c: s * 256 + count(c))


def _apart(a: Column, b: Column) -> Column:
    """Sum of the differences of two lines' letter counts, all bytes at once: a join compares many pairs."""
    every = lambda byte: F.lit(int.from_bytes([byte] * 7, "big")).cast("long")
    more, less = (x.bitwiseOR(every(0x80)) - y for x, y in ((a, b), (b, a)))  # bytes 128 + a - b and 128 + b - a
    low = F.shiftright(more.bitwiseAND(every(0x80)), 7) * 127  # all value bits where a is not less
    gap = more.bitwiseAND(low).bitwiseOR(less.bitwiseAND(low.bitwiseXOR(every(0x7F))))
    twos = gap.bitwiseAND(F.lit(0x00FF00FF00FF00FF)) + F.shiftright(gap, 8).bitwiseAND(F.lit(0x00FF00FF00FF00FF))
    return twos % F.lit(0xFFFF)  # its four parts' sum, as 1 << 16 leaves 1


def _codes(part: Column, letters: str) -> Column:
    """Counts of eight letters, a byte each, coded so that a count and the next one differ in one bit: as many bits of two codes differ as the counts do, or fewer."""
    ring = F.array(*(F.lit((1 << k) - 1 if k <= 8 else 0xFF ^ ((1 << k - 8) - 1)).cast("long") for k in range(16)))
    count = lambda c: F.length(part) - F.length(F.replace(part, c, F.lit("")))
    return F.aggregate(F.array(*(F.lit(c) for c in letters)), F.lit(0).cast("long"), lambda s, c: F.shiftleft(s, 8).bitwiseOR(F.get(ring, count(c).bitwiseAND(F.lit(15)))))


def halves(line: Column, c: Column) -> list[Column]:
    """Letter codes of a line's first and of its last code points, as many as half of class c's least length."""
    n = c * (STEP // 2)
    return [_codes(part, letters) for part in (F.substring(line, F.lit(1), n), F.right(line, n)) for letters in CODED]


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, key, no, h, len, copies), a row for each line of each document; copies counts rows that repeat an id and a text."""
    # Tells documents of one id apart, and those without an id row by row.
    keyed = docs.withColumn("key", F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text")))
    return written(lines_of(keyed).groupBy("id", "key", "no", "h", "len").agg(F.count("*").alias("copies")))


def texts_of(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(h, len, line) of the lines that have a budget; lines of many copies once, the others copy by copy."""
    lines = lines_of(docs.select("text")).where(F.col("len") >= STEP).select("h", "len", "line")
    seen = seen.where(F.col("len") >= STEP)
    most = max(COPIES, (seen.agg(F.sum("copies")).first()[0] or 0) // SHARE)
    # SHARE rows at most, however many lines there are.
    often = F.broadcast(written(seen.groupBy("h").agg(F.sum("copies").alias("n")).where(F.col("n") > most).select("h")))
    return lines.join(often, "h", "left_anti").unionByName(written(lines.join(often, "h", "left_semi").distinct()))


def shared(lines: DataFrame) -> DataFrame:
    """(key, e, n): the n lines of every key that two lines or more have."""
    # Both sides are dealt by key and hold the same columns, so the keys are made and shuffled once.
    keys = keyed(lines).repartition("key")
    sizes = keys.groupBy("key").agg(F.min("e").alias("lo"), F.max("e").alias("hi")).where("lo < hi").select("key")
    rows = keys.join(sizes.hint("shuffle_hash"), "key").select("key", "e").distinct()
    return written(rows.withColumn("n", F.count("*").over(W.partitionBy("key"))))


def members(rows: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines (h, line) that share a key, and rows of (key, n, h, len) with what letters they have."""
    wanted = small(written(rows.select("e").distinct()))
    texts = entered(lines).join(wanted, "e").select("e", "h", "len", "line", "c").distinct()
    texts = texts.select("e", "h", "len", "line", *(_letters(F.col("line"), x).alias(f"letters{i}") for i, x in enumerate(LETTERS)), *(x.alias(f"half{i}") for i, x in enumerate(halves(F.col("line"), F.col("c")))))
    texts = written(texts)
    return texts.select("h", "line").distinct(), written(rows.join(small(texts.drop("line")), "e").drop("e"))


def _alike() -> Column:
    """What the lengths and letters of two lines within the budget allow."""
    most = budget(F.least("a_len", "b_len"))
    bits = sum((F.bit_count(F.col(f"a_half{i}").bitwiseXOR(F.col(f"b_half{i}"))) for i in range(2 * len(CODED))), F.lit(0))
    return (F.abs(F.col("a_len") - F.col("b_len")) <= most) & (bits <= 2 * most) & (sum((_apart(F.col(f"a_letters{i}"), F.col(f"b_letters{i}")) for i in range(len(LETTERS))), F.lit(0)) <= 2 * most)


def _paired(rows: DataFrame, known: tuple[str, ...], more: Column | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of all lines that share a key and meet ``more``. A key's lines are dealt to blocks, and its pairs of blocks to tasks."""
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("i", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    side = lambda name, low, high, *at: rows.withColumn("j", F.explode(F.sequence(low, high))).select("key", *(F.col(x).alias(y) for x, y in zip(at, ("low", "high"), strict=True)), *(F.col(x).alias(f"{name}_{x}") for x in known))
    a, b = side("a", F.col("i"), F.col("blocks") - 1, "i", "j"), side("b", F.lit(0), F.col("i"), "j", "i")
    near = ((F.col("low") < F.col("high")) | (F.col("a_h") < F.col("b_h"))) & (F.col("a_h") != F.col("b_h")) & _alike()
    pairs = a.join(b, ["key", "low", "high"]).where(near if more is None else near & more)
    return pairs.select(F.least("a_h", "b_h").alias("a"), F.greatest("a_h", "b_h").alias("b")).distinct()


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs of all lines that share a key of ``FREE`` lines at most; there are few for each line."""
    return _paired(rows.where(F.col("n") <= FREE), KNOWN)


def crowded(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of all lines that share a key of more lines. Spark's banded distance is the last part of the join condition, so that only links leave the join; a pair is compared under the least such key that both have."""
    rows = rows.where(F.col("n") > FREE)
    # A line has no more keys than it gives, so the arrays are short.
    keys = written(rows.groupBy("h").agg(F.collect_set("key").alias("keys")))
    rows = written(rows.join(keys, "h").join(texts, "h"))
    least = F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("key")
    near = F.call_function("levenshtein", F.col("a_line"), F.col("b_line"), budget(F.least("a_len", "b_len"))) >= 0
    return written(_paired(rows, (*KNOWN, "keys", "line"), least & near))


def common_prefix(a: Column, b: Column, top: int = 1 << 16) -> Column:
    """Length of the common prefix, by halving steps."""
    steps = []
    while top:
        steps.append(top)
        top //= 2
    longer = lambda p, s: (p + s <= F.least(F.length(a), F.length(b))) & (F.substring(a, p + 1, s) == F.substring(b, p + 1, s))
    one = F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda p, s: F.when(longer(p, s), p + s).otherwise(p))
    return one


def banded(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of two arrays of characters whose sizes differ by ``edits`` at most; right where it is at most ``edits``.

    Bit i of the band stands for the row j - edits + i of column j. The distance is read along the
    diagonal that ends in the last cell: it rises where the diagonal step is not free.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    skew = F.size(a) - F.size(b)

    def step(s: Column, j: Column) -> Column:
        c = F.get(b, j - 1)
        eq = F.lit(0)
        for i in range(width):
            row = j - edits + i - 1
            eq = eq + F.when((row >= 0) & (F.get(a, F.greatest(row, F.lit(0))) == c), 1 << i).otherwise(0)
        up, down = s["up"], s["down"]
        free = lambda eq: (((eq.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(eq).bitwiseOR(down)).bitwiseAND(F.lit(full))

        def rest(d0: Column) -> Column:
            plus = down.bitwiseOR(F.bitwise_not(d0.bitwiseOR(up))).bitwiseAND(F.lit(full))
            minus = d0.bitwiseAND(up)
            half = F.shiftright(d0, 1)
            bit = F.call_function("shiftright", d0, skew + edits).bitwiseAND(F.lit(1))
            cost = s["cost"] + F.when(j > -skew, 1 - bit).otherwise(0)
            return F.struct(minus.bitwiseOR(F.bitwise_not(half.bitwiseOR(plus))).bitwiseAND(F.lit(full)).alias("up"), half.bitwiseAND(plus).alias("down"), cost.alias("cost"))

        return let(eq, lambda eq: let(free(eq), rest))

    start = F.struct(F.lit(full ^ ((1 << edits) - 1)).alias("up"), F.lit(0).alias("down"), F.abs(skew).alias("cost"))
    run = F.aggregate(F.sequence(F.lit(1), F.size(b)), start, step, lambda s: s["cost"])
    return F.when(F.abs(skew) > edits, F.lit(edits + 1)).when(F.size(b) == 0, F.size(a)).otherwise(run)


def _between(a: Column, b: Column, body) -> Column:
    """body(x, y) of what is left of two lines between their common prefix and suffix."""
    cut = lambda x, p, q: F.substring(x, p + 1, F.length(x) - p - q)

    def middle(p: Column) -> Column:
        ra, rb = F.reverse(F.substring(a, p + 1, F.length(a))), F.reverse(F.substring(b, p + 1, F.length(b)))
        tail = let(F.struct(ra.alias("a"), rb.alias("b")), lambda r: common_prefix(r["a"], r["b"]))
        return let(tail, lambda q: body(cut(a, p, q), cut(b, p, q)))

    return let(common_prefix(a, b), middle)


def within(a: Column, b: Column, most: Column) -> Column:
    """Whether the edit distance of two lines is at most ``most``, itself at most EDITS."""
    letters = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    by_bits = lambda x, y: let(letters(x), lambda x: let(letters(y), lambda y: banded(x, y))) <= most
    by_cells = lambda x, y: F.call_function("levenshtein", x, y, most) >= 0
    return _between(a, b, lambda x, y: F.when(F.greatest(F.length(x), F.length(y)) <= BITS_UP_TO, by_bits(x, y)).otherwise(by_cells(x, y)))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of line hashes that are within the budget."""
    a, b = (texts.select(F.col("h").alias(at), F.col("line").alias(line), F.length("line").alias(f"{line}_len")) for at, line in (("a", "x"), ("b", "y")))
    x, y = F.col("x"), F.col("y")
    most = budget(F.least("x_len", "y_len"))
    return written(pairs.join(a, "a").join(b, "b").where(within(x, y, most)).select("a", "b"))


def links(docs: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All pairs (a, b) of hashes of lines within the budget, and the classes (id, label) that they make up."""
    lines = texts_of(docs, occurrences(docs) if seen is None else seen)
    texts, rows = members(shared(lines), lines)
    found = written(verified(candidates(rows), texts).unionByName(crowded(rows, texts)).distinct())
    return found, components(found)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_lines, n_removed, n_near (removed, and not equal to an earlier line), n_links (other texts in its lines' classes), n_pairs (other texts within the budget of its lines), chars, kept_chars, class_id (smallest id that a class of its lines starts in)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = occurrences(docs)
    found, known = links(docs, seen)
    sizes = small(written(known.groupBy("label").agg((F.count("*") - 1).alias("links"))))
    pairs = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("pairs"))
    near = small(written(known.join(sizes, "label").join(pairs, "id").select(F.col("id").alias("h"), "label", "links", "pairs")))
    lines = seen.join(near, "h", "left")
    lines = written(lines.select("id", "key", "no", "h", "len", F.coalesce("label", "h").alias("c"), *(F.coalesce(x, F.lit(0)).alias(x) for x in ("links", "pairs"))))
    at = F.struct("id", "key", "no")
    first = lines.groupBy("c").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("c").alias("_c"), "first")
    # Where a line has no links, its class holds its repeats only.
    equal = lines.where("links > 0").groupBy("h").agg(F.min(at).alias("same")).select(F.col("h").alias("_h"), "same")
    lines = lines.join(small(written(first)), F.col("c") == F.col("_c"), "left").join(small(written(equal)), F.col("h") == F.col("_h"), "left")
    gone, again = (F.coalesce(at > c, F.lit(False)) for c in (F.col("first"), F.coalesce("same", "first")))
    total = lines.groupBy("id").agg(
        F.count("*").alias("n_lines"), F.count_if(gone).alias("n_removed"), F.count_if(gone & ~again).alias("n_near"), F.sum("links").alias("n_links"), F.sum("pairs").alias("n_pairs"),
        F.sum("len").alias("chars"), F.sum(F.when(gone, 0).otherwise(F.col("len"))).alias("kept_chars"), F.min(F.coalesce("first.id", "id")).alias("class_id"),
    )
    counts = ["n_lines", "n_removed", "n_near", "n_links", "n_pairs", "chars", "kept_chars"]
    total = total.withColumnRenamed("id", "_id")
    out = docs.select("id").distinct().join(total, F.col("id").eqNullSafe(F.col("_id")), "left")
    return out.select(F.col("id").alias(id_col), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("class_id", "id").alias("class_id"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES: dict[str, str] = {}
