"""Names out of documents and listings."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

#: Words of the language that are not names.
KEYWORDS = [
    "if", "else", "return", "while", "for", "do", "switch", "case", "break", "continue", "goto", "sizeof", "void", "short", "int", "long", "char", "unsigned", "signed", "float", "double", "static", "const", "struct",
    "true", "false", "NULL", "bool", "byte", "uint", "ushort", "uchar", "undefined", "undefined1", "undefined2", "undefined4", "undefined8",
]
#: Types that a cast may name, and tokens of translated documents that are no names.
CAST_TYPES = "short|ushort|int|uint|char|uchar|byte|sbyte|undefined\\d?|long|ulong|float|double|bool"
STOP_WORDS = ["machine_translated", "module_description", "modul_beschreibung", "projekt_mss54", "seite_von", "page_of"]
MNEMONIC, SIGNAL = r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$", r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$"


def vocabulary(items: DataFrame, symbols: DataFrame, functions: DataFrame, **shape) -> DataFrame:
    """Names and base names that look like names. Each input has ``name``."""
    every = items.select("name").union(symbols.select("name")).union(functions.select("name"))
    both = every.union(every.select(S.base_name(F.col("name"))))
    return both.where(S.name_shape(F.col("name"), **shape).isNotNull()).distinct()


def learn_names(pages: DataFrame, stop: list[str] = STOP_WORDS, pattern: str = f"{MNEMONIC}|{SIGNAL}", least: int = 4) -> DataFrame:
    """Distinct tokens of pages(text) that match the pattern and are no stop words."""
    token = F.explode(F.split("text", "[^A-Za-z0-9_]+"))
    return pages.select(token.alias("name")).where((F.length("name") >= least) & F.col("name").rlike(pattern) & ~F.col("name").isin(stop)).distinct()


def drop_concatenations(learned: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """Learned names that are not two or more other names of ``least`` letters end to end.

    Each token's inner substrings are joined to the vocabulary, so no side is held whole anywhere; the rows of a token
    grow with the square of its own length only. A token's found pieces, in order of their start, are then folded into
    the places that can be reached from its begin.
    """
    names = learned.select("name").union(known.select("name")).distinct()
    token = learned.select(F.col("name").alias("token"), F.length("name").alias("n")).where(F.col("n") >= 2 * least).distinct()
    starts = token.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - least)).alias("i"))
    ends = starts.select("*", F.explode(F.sequence(F.col("i") + least, F.col("n"))).alias("j")).where((F.col("i") > 0) | (F.col("j") < F.col("n")))
    pieces = ends.withColumn("name", F.expr("substring(token, i + 1, j - i)")).join(names, "name", "left_semi")
    found = pieces.groupBy("token", "n").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("p"))
    step = lambda at, p: F.when(F.array_contains(at, p["i"]), F.array_union(at, F.array(p["j"]))).otherwise(at)
    glued = found.where(F.array_contains(F.aggregate("p", F.array(F.lit(0)), step), F.col("n"))).select(F.col("token").alias("name"))
    return learned.join(glued, "name", "left_anti")


def checked_names(names: DataFrame, most: int) -> list[str]:
    """The vocabulary for broadcast; more than ``most`` names are refused."""
    got = [r[0] for r in names.select("name").limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"more than {most} names: scan with parts of the vocabulary")
    return got


class Scanner:
    """Names in a text, left to right, the longest of those that start first, not overlapping.

    An Aho-Corasick automaton passes over the text once and tells every occurrence; of those with one start the last is
    the longest. Its cost grows with the text and the occurrences and not with the names.
    """

    def __init__(self, names: list[str]):
        self.found = ahocorasick.Automaton()
        for name in names:
            self.found.add_word(name, name)
        self.found.make_automaton()

    def __call__(self, text: str | None) -> list[str]:
        if not text or not len(self.found):
            return []
        at = {end - len(name): name for end, name in self.found.iter(text)}
        out, to = [], -1
        for start in sorted(at):
            if start >= to:
                out.append(at[start])
                to = start + len(at[start])
        return out


#: A worker's scanner, kept for its next tasks.
_SCANNERS: dict[str, Scanner] = {}


def scan_names(pages: DataFrame, names: DataFrame, text: str = "text", out: str = "names", most: int = 1_000_000) -> DataFrame:
    """Names in each page, left to right, the longest first, not overlapping, word boundaries not needed."""
    held, key = pages.sparkSession.sparkContext.broadcast(sorted(x for x in checked_names(names, most) if x)), uuid.uuid4().hex

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _SCANNERS:
            _SCANNERS.clear()
            _SCANNERS[key] = Scanner(held.value)
        for s in batches:
            yield s.map(_SCANNERS[key])

    return pages.withColumn(out, found(text))


def two_pass_names(pages: DataFrame, known: DataFrame, stop: list[str] = STOP_WORDS, pattern: str = f"{MNEMONIC}|{SIGNAL}", text: str = "text", most: int = 1_000_000) -> DataFrame:
    """Pages with the names found after a first pass has learned what stands alone: (all columns, names).

    Learned names glued from others are left out, then all names are scanned for, so that they are found in
    runs without blanks as well.
    """
    new = learn_names(pages.select(F.col(text).alias("text")), stop, pattern).join(known.select("name"), "name", "left_anti")
    return scan_names(pages, known.select("name").union(drop_concatenations(new, known)).distinct(), text, most=most)


def learning_stats(pages: DataFrame, known: DataFrame, doc: str, stop: list[str] = STOP_WORDS, mnemonic: str = MNEMONIC, signal: str = SIGNAL, most: int = 1_000_000) -> DataFrame:
    """One row of figures of both passes over pages(doc, text, lang).

    documents, german (with a page in 'de'), english_only (with 'en' and none in 'de'), pages (not blank), and by shape
    names known before, learned beside them, discarded as glued, and found on the pages.
    """
    shape = lambda c: F.when(F.col(c).rlike(mnemonic), "mnemonics").when(F.col(c).rlike(signal), "signals")
    new = learn_names(pages, stop, f"{mnemonic}|{signal}").join(known.select("name"), "name", "left_anti")
    kept = drop_concatenations(new, known)
    scanned = scan_names(pages.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != ""), known.select("name").union(kept).distinct(), most=most)
    names = scanned.select(F.explode("names").alias("name")).distinct()
    tagged = [d.select(shape("name").alias("shape"), F.lit(k).alias("k")) for k, d in (("known", known.select("name").distinct()), ("all", new), ("learned", kept), ("found", names))]
    by_shape = lambda k, s: F.count_if((F.col("k") == k) & (F.col("shape") == s))
    figures = [by_shape(k, s).alias(f"{k}_{s}") for k in ("known", "learned", "found") for s in ("mnemonics", "signals")]
    figures += [(by_shape("all", s) - by_shape("learned", s)).alias(f"discarded_{s}") for s in ("mnemonics", "signals")]
    union = tagged[0].union(tagged[1]).union(tagged[2]).union(tagged[3])
    langs = pages.groupBy(doc).agg(F.max((F.col("lang") == "de").cast("int")).alias("de"), F.max((F.col("lang") == "en").cast("int")).alias("en"))
    docs = langs.agg(F.count("*").alias("documents"), F.count_if(F.col("de") == 1).alias("german"), F.count_if((F.col("en") == 1) & (F.coalesce("de", F.lit(0)) == 0)).alias("english_only"))
    return docs.join(union.agg(*figures), how="cross").join(scanned.agg(F.count("*").alias("pages")), how="cross")


def page_records(scanned: DataFrame) -> DataFrame:
    """Sorted distinct names of a page by shape, its length and an excerpt."""
    unique = F.array_sort(F.array_distinct("names"))
    return scanned.withColumn("mnemonics", F.filter(unique, lambda x: x.rlike("^[A-Z]"))).withColumn("signals", F.filter(unique, lambda x: x.rlike("^[a-z]"))).withColumn("chars", F.length(F.trim("text"))).withColumn("excerpt", S.excerpt(F.col("text")))


def document_names(pages: DataFrame, doc: str) -> DataFrame:
    """Sorted distinct names of each document that has any; a page sends its distinct names as one row."""
    names = pages.select(doc, F.array_distinct("names").alias("names")).where(F.size("names") > 0)
    return names.groupBy(doc).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))


def extraction_stats(pages: DataFrame, doc: str) -> DataFrame:
    names = pages.select(doc, F.explode_outer("names").alias("name"))
    return names.agg(F.count_distinct(doc).alias("documents"), F.count_distinct("name").alias("names"))


#: A line that assigns, and one that declares (the name is a whole word, not its last letters).
ASSIGNMENT = r"^\s*([A-Za-z_][\w\.\[\]>-]*?)\s*=\s*(.+?);\s*$"
DECLARATION = r"^\s*[A-Za-z_]\w*(?:\s+[A-Za-z_]\w*)*\s*\**\s*\b([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*;\s*$"


def assignments(listings: DataFrame) -> DataFrame:
    """(func, line, lhs, rhs) of the lines of listings(func, code) that are an assignment to a name, a member or an element.

    Lines with a condition, a type or an operator before the sign are none.
    """
    lines = listings.select("func", F.posexplode(F.split("code", "\r?\n")).alias("line", "text"))
    part = lambda i: F.regexp_extract("text", ASSIGNMENT, i)
    return lines.select("func", "line", part(1).alias("lhs"), part(2).alias("rhs")).where("lhs != ''")


def locals_of(code: Column) -> Column:
    """Names declared in a listing's body, in order, before a condition, return, closing brace, comment or first other line with a '='.

    Other lines do not end the block. Without a brace the whole text is the body; null for null.
    """
    body = F.split(F.substring(code, F.instr(code, F.lit("{")) + F.lit(1), F.length(code)), "\r?\n")
    declared = lambda x: F.regexp_extract(x, DECLARATION, 1)
    stops = F.transform(body, lambda x: x.rlike(r"^\s*(?:if|return|\}|/\*|//)") | ((declared(x) == "") & F.contains(x, F.lit("="))))
    first = F.array_position(stops, True)
    block = F.when(first > 0, F.slice(body, 1, (first - 1).cast("int"))).otherwise(body)
    return F.array_distinct(F.filter(F.transform(block, declared), lambda x: x != ""))


def declared_locals(listings: DataFrame) -> DataFrame:
    """(func, name) of the names that listings(func, code) declare, each once."""
    return listings.select("func", F.explode(locals_of(F.col("code"))).alias("name")).distinct()


def listing_statements(listings: DataFrame) -> DataFrame:
    """(func, line, output, expr, calls, reads) of the assignments that outlive their function, in one pass over listings(func, code).

    Assignments to temporaries and declared locals are left out, and expr, the cleaned right side, reads neither.
    """
    # The locals are bound once a listing and travel with its lines; beside a generator they would be computed for each.
    lines = lambda own: F.transform(F.split("code", "\r?\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text"), own.alias("locals")))
    rows = listings.select("func", F.explode(F.flatten(F.transform(F.array(locals_of(F.col("code"))), lines))).alias("l")).select("func", "l.*")
    part = lambda i: F.regexp_extract("text", ASSIGNMENT, i)
    rows = rows.select("func", "line", "locals", part(1).alias("output"), clean_expression(part(2)).alias("expr"))
    kept = rows.where((F.col("output") != "") & ~S.is_temporary(F.col("output")) & ~F.array_contains("locals", F.col("output")))
    return kept.select("func", "line", "output", "expr", calls_of(F.col("expr")).alias("calls"), reads_of(F.col("expr"), F.col("locals")).alias("reads"))


def call_sites(listings: DataFrame) -> DataFrame:
    """(func, callee, args) of all calls, nested ones too; keywords with brackets are none."""
    calls = listings.select("func", F.explode(balanced_calls(F.col("code"))).alias("c"))
    return calls.select("func", "c.callee", "c.args").where(~F.col("callee").isin(KEYWORDS))


def _depths(text: str, opening: str, closing: str) -> list[int]:
    """Per character the open brackets after it."""
    depth, out = 0, []
    for c in text:
        depth += (c in opening) - (c in closing)
        out.append(depth)
    return out


def _calls_in(text: str) -> list[tuple[str, list[str]]]:
    """Each call with its arguments, which may hold calls themselves; a call that is not closed is left out."""
    depth, out = _depths(text, "(", ")"), []
    for m in re.finditer(r"\b([A-Za-z_]\w*)\s*\(", text):
        level, start = depth[m.end() - 1], m.end()
        end = next((i for i in range(start, len(text)) if depth[i] < level), None)
        if end is not None:
            cuts = [start - 1, *(i for i in range(start, end) if text[i] == "," and depth[i] == level), end]
            args = [text[a + 1 : b].strip() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            out.append((m.group(1), [a for a in args if a]))
    return out


CALLS = "array<struct<callee: string, args: array<string>>>"


def per_row(kind: str, f: Callable) -> Callable[[Column], Column]:
    """A small function of a text as a column, in Arrow batches; null for null."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


def balanced_calls(expr: Column) -> Column:
    """Calls of an expression, nested ones too, with their balanced arguments."""
    return per_row(CALLS, lambda x: [{"callee": c, "args": a} for c, a in _calls_in(x)])(expr)


def interpolations(calls: Column, declared: Column | None = None) -> Column:
    """Of balanced calls those of interpolation helpers and filters: helper, shape, tables (names in the first argument, without declared locals) and axes (the others)."""
    own = lambda y: F.lit(False) if declared is None else F.coalesce(F.array_contains(declared, y), F.lit(False))
    names = lambda x: F.filter(F.regexp_extract_all(x, F.lit(r"([A-Za-z_]\w*)"), F.lit(1)), lambda y: ~y.isin(KEYWORDS) & ~S.is_temporary(y) & ~own(y))
    known = F.filter(calls, lambda c: S.helper_class(c["callee"])["shape"].isNotNull() & (F.size(c["args"]) > 0))
    return F.transform(known, lambda c: F.struct(c["callee"].alias("helper"), S.helper_class(c["callee"])["shape"].alias("shape"), names(F.get(c["args"], F.lit(0))).alias("tables"), F.slice(c["args"], F.lit(2), F.size(c["args"])).alias("axes")))


def helper_usage(calls: DataFrame) -> DataFrame:
    c = S.helper_class(F.col("callee"))
    return calls.where(c["shape"].isNotNull()).groupBy("callee", c["shape"].alias("shape")).agg(F.count("*").alias("n"))


def logic_stats(functions: DataFrame, statements: DataFrame) -> DataFrame:
    """One row: functions, those with statements, statements, interpolations, and statements in which a temporary is left. statements(block, expr, interp)."""
    names = F.regexp_extract_all("expr", F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1))
    s = statements.agg(F.count_distinct("block").alias("functions_with_statements"), F.count("*").alias("statements"), F.coalesce(F.sum(F.size("interp")), F.lit(0)).cast("long").alias("interpolations"), F.count_if(F.exists(names, S.is_temporary)).alias("unfolded"))
    return functions.agg(F.count("*").alias("functions")).join(F.broadcast(s))


def clean_expression(expr: Column) -> Column:
    """Without casts, and without address-of and what it takes of a structure; blanks collapsed; a bitwise and stays."""
    e = F.regexp_replace(expr, r"\s+", " ")
    e = F.regexp_replace(e, r"\(\s*[A-Za-z_]\w*\s*\*\s*\)\s*", "")
    e = F.regexp_replace(e, rf"\((?:{CAST_TYPES})\s*\)\s*", "")
    # An operand to the left, before at most one blank, makes it an operator.
    e = F.regexp_replace(e, r"(?<![\w)\]&]\s?)&\s*([A-Za-z_]\w*)\s*(?:\.\w+|->\w+)?", "$1")
    return F.trim(F.regexp_replace(e, r"\s+", " "))


def calls_of(expr: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(expr, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))))


def reads_of(expr: Column, declared: Column | None = None) -> Column:
    """Names in order of appearance that are neither keywords, temporaries, declared locals nor calls."""
    names = F.array_distinct(F.regexp_extract_all(expr, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\b"), F.lit(1)))
    names = F.array_except(names, calls_of(expr))
    names = names if declared is None else F.array_except(names, declared)
    return F.filter(names, lambda x: ~x.isin(KEYWORDS) & ~S.is_temporary(x))


#: Comparisons and what holds when they do not; those of two characters are looked for first, and half a shift is none.
_FLIP = {"==": "!=", "!=": "==", "<=": ">", ">=": "<", "<": ">=", ">": "<="}
_FIND = {"<": r"(?<!<)<(?![<=])", ">": r"(?<!>)>(?![>=])"}


def _inverted(cond: str) -> str:
    text = cond.strip()
    # What stands in brackets is blanked, so only the top level is searched.
    depth = _depths(text, "([", ")]")
    top = "".join(c if d == 0 and c not in ")]" else "\0" for c, d in zip(text, depth, strict=True))
    if "&&" not in top and "||" not in top:
        for op, other in _FLIP.items():
            m = re.search(_FIND.get(op, re.escape(op)), top)
            if m:
                return f"{text[: m.start()].strip()} {other} {text[m.end() :].strip()}"
    return f"not ({text})"


def invert_guard(cond: Column) -> Column:
    """The comparison at the top level turned round; with && or || there, or without one, 'not (...)'."""
    return per_row("string", _inverted)(cond)


def shift_to_scale(expr: Column) -> Column:
    for n in range(31, 0, -1):
        expr = F.regexp_replace(expr, rf">>\s*(?:{n}|0x{n:x})\b", f"÷ {2**n}")
        expr = F.regexp_replace(expr, rf"<<\s*(?:{n}|0x{n:x})\b", f"× {2**n}")
    return expr


#: Words whose bits are states of the engine, and the states.
STATE_WORDS = ["ZUSTAND_MOTOR", "ZUSTAND_MOTOR2", "START_ST", "TPU_ST_M"]
STATE_BITS = {
    "LL": "idle (Leerlauf)", "VL": "full load (Vollast)", "TL": "part load (Teillast)", "S": "overrun (Schub)", "Start": "cranking (Start)",
    "Nachlauf": "after-run (Nachlauf)", "KI.15 aus": "ignition off (Klemme 15 aus)", "Kl15 aus": "ignition off (Klemme 15 aus)",
}


def guard_gloss(guard: Column, meanings: dict[str, str] = STATE_BITS, words: list[str] | None = None) -> Column:
    """'(WORD & (A|B)) != 0' in words, with or without its outer brackets; null unless every bit is known, and for words not in ``words`` if given."""
    part = lambda i: F.regexp_extract(guard, r"^\s*\(?\s*([A-Z][A-Z0-9_]*)\s*&\s*\(?([^()]+?)\)?\s*\)?\s*(==|!=)\s*0\s*$", i)
    bits = F.filter(F.transform(F.split(part(2), r"\|"), lambda b: F.trim(b)), lambda b: b != "")
    table = F.create_map(*(F.lit(x) for kv in meanings.items() for x in kv))
    text = F.array_join(F.transform(bits, lambda b: F.try_element_at(table, b)), " or ")
    known = (F.size(bits) > 0) & F.forall(bits, lambda b: F.array_contains(F.map_keys(table), b))
    if words is not None:
        known = known & part(1).isin(words)
    return F.when(known, F.concat(F.when(part(3) == "==", "not ").otherwise(""), text))


def resolve_data_names(rows: DataFrame, expr: str, ram: DataFrame) -> DataFrame:
    """DAT_, UNK_ and PTR_ names in ``expr`` as the RAM symbol ram(addr, name) there (the first wins), else RAM[0x...].

    Rows must have ``id``.
    """
    hit = F.explode(F.array_distinct(F.regexp_extract_all(expr, F.lit(r"\b((?:DAT|UNK|PTR)_[0-9a-fA-F]+)\b"), F.lit(1))))
    found = rows.select("id", hit.alias("hit")).withColumn("addr", F.conv(F.regexp_extract("hit", "_([0-9a-fA-F]+)$", 1), 16, 10).cast("long"))
    first = ram.groupBy("addr").agg(F.min_by("name", "ord").alias("name"))
    named = found.join(first, "addr", "left").select("id", "hit", F.coalesce("name", F.format_string("RAM[0x%x]", "addr")).alias("to"))
    swaps = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.length("hit")).alias("l"), "hit", "to"))).alias("swaps"))
    done = F.aggregate(F.coalesce("swaps", F.array().cast(swaps.schema["swaps"].dataType)), F.col(expr), lambda s, x: F.replace(s, x["hit"], x["to"]))
    return rows.join(swaps, "id", "left").withColumn(f"{expr}_named", done).drop("swaps")
