"""The relation graph: indices, resolved references, page edges, coverage, agreement.

Inputs carry ``ord`` wherever the first or the last record wins. ``nodes(id, t, name, bank)`` and
``edges(s, d, k, o)`` are the two tables of the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.io import settled

EDGE = ["s", "d", "k", "o"]


def first_wins(df: DataFrame, key: list[str], value: str, order: str = "ord") -> DataFrame:
    """One row per key: the value with the least order. The aggregate combines before the shuffle."""
    return df.groupBy(*key).agg(F.min_by(value, order).alias(value))


def last_wins(df: DataFrame, key: list[str], value: str, order: str = "ord") -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, order).alias(value))


def addr_index(items: DataFrame, axes: DataFrame, functions: DataFrame, ram: DataFrame) -> DataFrame:
    """(bank, addr) -> node. Items, then axes, each also two bytes earlier, then functions, then RAM."""
    def two(df: DataFrame, rank: int) -> DataFrame:
        places = F.explode(F.array(F.struct(F.col("addr").alias("addr"), F.lit(0).alias("sub")), F.struct((F.col("addr") - 2).alias("addr"), F.lit(1).alias("sub"))))
        return df.withColumn("p", places).select("bank", F.col("p.addr").alias("addr"), "node", F.struct(F.lit(rank).alias("rank"), "ord", F.col("p.sub").alias("sub")).alias("o"))

    def one(df: DataFrame, rank: int) -> DataFrame:
        return df.select("bank", "addr", "node", F.struct(F.lit(rank).alias("rank"), "ord", F.lit(0).alias("sub")).alias("o"))

    return first_wins(reduce(DataFrame.unionByName, [two(items, 0), two(axes, 1), one(functions, 2), one(ram, 3)]), ["bank", "addr"], "node", "o")


def resolve_references(refs: DataFrame, index: DataFrame) -> DataFrame:
    """refs(bank, s, d, k, o) with node ids; a null target is unresolved, an unknown source is dropped."""
    src = index.select("bank", F.col("addr").alias("s"), F.col("node").alias("source"))
    dst = index.select("bank", F.col("addr").alias("d"), F.col("node").alias("target"))
    return refs.join(src, ["bank", "s"]).join(dst, ["bank", "d"], "left").select("bank", F.col("d").alias("addr"), F.col("source").alias("s"), F.col("target").alias("d"), "k", "o")


def unresolved_targets(resolved: DataFrame) -> DataFrame:
    return resolved.where("d is null").agg(F.count_distinct("addr").alias("unresolved"))


def operand_scan(operands: DataFrame, addresses: DataFrame) -> DataFrame:
    """operands(func, value) that hit a known address(addr, node): inferred read edges."""
    hit = operands.join(addresses, operands.value == addresses.addr)
    return hit.select(F.col("func").alias("s"), F.col("node").alias("d"), F.lit("read").alias("k"), F.lit("scan").alias("o")).distinct()


def owner_of(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points(bank, addr) with every range(bank, start, size, func) that covers them, as an equi-join and the exact test.

    A range lies in one or two blocks of the least power of 16 that is not below its size, so its length costs no
    rows and a block holds few ranges of its level that do not overlap. Points look up the levels that occur, 16 at
    most. Ranges that overlap give a row each; null addresses, starts and sizes, and sizes under 1, give none.
    """
    bits = F.length(F.bin(F.col("size") - 1)) + F.when(F.col("size") == 1, -1).otherwise(0)
    r = ranges.where("size > 0 and start is not null").withColumns({"start": F.col("start").cast("long"), "end": F.col("start").cast("long") + F.col("size") - 1, "level": (F.ceil(bits / 4) * 4).cast("int")})
    levels = sorted(x[0] for x in r.select("level").distinct().collect())
    block = lambda c: F.call_function("shiftright", F.col(c).cast("long"), F.least("level", F.lit(63)))
    r = r.withColumn("blk", F.explode(F.array_distinct(F.array(block("start"), block("end")))))
    p = points.where("addr is not null").withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("blk", block("addr"))
    return p.join(r, ["bank", "level", "blk"]).where("addr >= start and addr <= end").drop("level", "blk", "end", "start", "size")


def name_index(params: DataFrame, functions: DataFrame, ram: DataFrame) -> DataFrame:
    """name -> node, ord: params by name and base name, then named functions, then RAM; the first wins over all banks. ord: the order in which names were first given."""
    def rows(df: DataFrame, rank: int, base: bool) -> DataFrame:
        names = [F.struct(F.col("name").alias("name"), F.lit(0).alias("sub"))] + ([F.struct(S.base_name(F.col("name")).alias("name"), F.lit(1).alias("sub"))] if base else [])
        return df.withColumn("n", F.explode(F.array(*names))).select(F.col("n.name").alias("name"), "node", F.struct(F.lit(rank).alias("rank"), "ord", F.col("n.sub").alias("sub")).alias("o"))

    every = rows(params, 0, True).unionByName(rows(functions, 1, False)).unionByName(rows(ram, 2, False))
    return every.where("name is not null and name != ''").groupBy("name").agg(F.min_by("node", "o").alias("node"), F.min("o").alias("ord"))


def resolve_name(names: DataFrame, index: DataFrame) -> DataFrame:
    """names(name, ...) with node: the exact name, else the first in the index's order (its ord, or the node without one) that differs in case only."""
    low = index.groupBy(F.lower("name").alias("_low")).agg(F.min_by("node", "ord" if "ord" in index.columns else "node").alias("_any"))
    exact = index.select(F.col("name").alias("_name"), F.col("node").alias("_exact"))
    out = names.join(exact, F.col("name") == F.col("_name"), "left").join(low, F.lower("name") == F.col("_low"), "left")
    return out.withColumn("node", F.coalesce("_exact", "_any")).drop("_name", "_exact", "_low", "_any")


def signal_ram_matches(documents: DataFrame, index: DataFrame, ram: DataFrame) -> DataFrame:
    """Per document of documents(doc, signals) how many of its distinct signals name a node of ram(id)."""
    named = resolve_name(documents.select("doc", F.explode(F.array_distinct("signals")).alias("name")), index)
    hit = named.join(ram.select(F.col("id").alias("node")).distinct().withColumn("hit", F.lit(1)), "node", "left")
    return hit.groupBy("doc").agg(F.count("hit").alias("matches"), F.count("*").alias("signals"))


def with_translations(items: DataFrame, translations: DataFrame) -> DataFrame:
    """items(name, ...) with ja of translations(key, value), null without one; of repeated keys the least value."""
    one = translations.groupBy(F.col("key").alias("_key")).agg(F.min("value").alias("ja"))
    return items.join(one, F.col("name") == F.col("_key"), "left").drop("_key")


def with_categories(items: DataFrame, categories: DataFrame) -> DataFrame:
    """items(id, category_ids): per item its categories(id, de, en), in order of their numbers; unknown numbers are dropped."""
    c = categories.select(F.col("id").alias("category"), "de", "en")
    rows = items.select("id", F.explode("category_ids").alias("category")).join(F.broadcast(c) if c.limit(10_001).count() <= 10_000 else c, "category")
    named = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("category", "de", "en"))).alias("categories"))
    return items.join(named, "id", "left")


def missing_names(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Names that were expected and not found: none if the check holds."""
    return expected.select("name").subtract(found.select("name"))


def page_edges(pages: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(page, names): edges both ways, and the unknown nodes that they need."""
    named = resolve_name(pages.select("page", F.explode("names").alias("name")), index)
    target = F.coalesce("node", S.node_id("unknown", F.col("name")))
    both = F.explode(F.array(F.struct(F.col("page").alias("s"), target.alias("d"), F.lit("documents").alias("k")), F.struct(target.alias("s"), F.col("page").alias("d"), F.lit("documented").alias("k"))))
    edges = named.select(both.alias("e")).select("e.*", F.lit("fr").alias("o")).distinct()
    unknown = named.where("node is null").select(S.node_id("unknown", F.col("name")).alias("id"), "name").distinct()
    return edges, unknown


def pair_editions(german: DataFrame, english: DataFrame) -> DataFrame:
    """By section number, never by title; the main text is the German one where there is one."""
    g = german.select("section", F.col("title").alias("title_de"), F.col("path").alias("path_de"))
    e = english.select("section", F.col("title").alias("title_en"), F.col("path").alias("path_en"))
    parts = F.transform(F.split("section", r"\."), lambda x: F.try_to_number(x, F.lit("999999")).cast("int"))
    return g.join(e, "section", "full").withColumn("text_source", F.coalesce("path_de", "path_en")).withColumn("section_order", parts)


def dedup_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge once, none to itself, none without both its nodes."""
    ids = nodes.select("id").distinct()
    e = edges.select(*EDGE).where("s != d").dropDuplicates(EDGE)
    return e.join(ids.withColumnRenamed("id", "s"), "s", "left_semi").join(ids.withColumnRenamed("id", "d"), "d", "left_semi").select(*EDGE)


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, key, value): nodes by kind, edges by origin and kind and in all, referenced params by bank and in all."""
    long_ = lambda df, metric, key, value: df.select(F.lit(metric).alias("metric"), F.coalesce(F.col(key).cast("string"), F.lit("all")).alias("key"), F.col(value).cast("double").alias("value"))
    kinds = long_(nodes.groupBy("t").count(), "nodes", "t", "count")
    edges = settled(edges)
    counted = edges.groupingSets([["o"], ["k"], []], "o", "k").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    per_edge = counted.select(F.when(F.col("g") == 1, "edges_by_origin").when(F.col("g") == 2, "edges_by_kind").otherwise("edges").alias("metric"), F.coalesce("o", "k", F.lit("all")).alias("key"), F.col("n").cast("double").alias("value"))
    touched = edges.where("o != 'fr'").select(F.explode(F.array("s", "d")).alias("id")).distinct().withColumn("hit", F.lit(1))
    params = nodes.where("t = 'param'").join(touched, "id", "left").rollup("bank").agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hit"))
    params = params.withColumn("pct", F.bround(F.col("hit") * 100.0 / F.col("n"), 1))
    return kinds.unionByName(per_edge).unionByName(long_(params, "params", "bank", "n")).unionByName(long_(params, "params_referenced", "bank", "hit")).unionByName(long_(params, "params_referenced_pct", "bank", "pct"))


def coverage_figures(nodes: DataFrame, edges: DataFrame, statements: DataFrame, resolved: DataFrame, matches: DataFrame) -> DataFrame:
    """(metric, value) of the whole graph: one pass over each table, then a row a figure.

    nodes(id, t, named, dense), edges(s, d, o), statements(block, interp), resolved(addr, d) with a null d where a
    target has no node, matches(matches) as ``signal_ram_matches`` gives them. Percentages have one place and are null
    without items; null flags count as false.
    """
    of = lambda t: F.col("t") == t
    counted = nodes.agg(
        F.count_if(of("func")).alias("functions"), F.count_if(of("func") & F.col("named")).alias("named_functions"), F.count_if(of("ram")).alias("ram_symbols"),
        F.count_if(of("frpage")).alias("pages"), F.count_if(of("frpage") & F.col("dense")).alias("dense_pages"), F.count_if(of("unknown")).alias("names_only_in_documents"),
    )
    # One bit tells that code refers to an item, the other that a document names it.
    flagged = edges.select(F.when(F.col("o") == "fr", F.struct(F.col("s").alias("id"), F.lit(2).alias("bit"))).when(F.col("o").isin("xref", "scan"), F.struct(F.col("d").alias("id"), F.lit(1).alias("bit"))).alias("f")).where("f is not null")
    bits = flagged.groupBy("f.id").agg(F.bit_or("f.bit").alias("bits"))
    share = lambda c: F.bround(F.try_divide(100.0 * F.col(c), F.col("params")), 1)
    params = nodes.where(of("param")).select("id").join(bits, "id", "left")
    params = params.agg(F.count("*").alias("params"), F.count_if(F.col("bits").bitwiseAND(F.lit(1)) != 0).alias("params_referenced"), F.count_if(F.col("bits").bitwiseAND(F.lit(2)) != 0).alias("params_documented"))
    params = params.withColumns({"params_referenced_pct": share("params_referenced"), "params_documented_pct": share("params_documented")})
    logic = statements.agg(F.count_distinct("block").alias("blocks_with_formulas"), F.coalesce(F.sum(F.greatest(F.size("interp"), F.lit(0))), F.lit(0)).alias("lookups_found"))
    signals = matches.agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("signals_matching_ram"))
    figures = [counted, params, logic, unresolved_targets(resolved), signals]
    rows = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns))).alias("f")).select("f.*")
    return reduce(DataFrame.unionByName, map(rows, figures))


ORIGINS = ("fr", "scan", "xref")


def agreement(edges: DataFrame) -> DataFrame:
    """Per node and neighbour the origins that join them; both kinds of evidence, or documents only.

    Origins are few and known, so a set is three bits: nothing is collected.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("s").alias("node"), F.col("d").alias("other")), F.struct(F.col("d").alias("node"), F.col("s").alias("other")))).alias("p"), F.coalesce(*(F.when(F.col("o") == x, 1 << i) for i, x in enumerate(ORIGINS)), F.lit(0)).alias("bit"))
    out = both.groupBy("p.node", "p.other").agg(F.bit_or("bit").alias("bits"))
    names = F.filter(F.array(*(F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)) for i, x in enumerate(ORIGINS))), lambda x: x.isNotNull())
    return out.select("node", "other", names.alias("origins"), (F.col("bits") > 1).alias("_more"), (F.col("bits") % 2 == 1).alias("_fr")).select("node", "other", "origins", (F.col("_fr") & F.col("_more")).alias("both"), (F.col("_fr") & ~F.col("_more")).alias("documents_only"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("d").pivot("k", ["call", "read", "write", "documents"]).count().na.fill(0)


def degree_by_origin(edges: DataFrame) -> DataFrame:
    """Edges into a node by origin and kind: (d, o, call, read, write, documents, documented)."""
    return edges.groupBy("d", "o").pivot("k", ["call", "read", "write", "documents", "documented"]).count().na.fill(0)


def page_links(edges: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, section, page, id, title, place): the pages that name a node, in order of section, page and id.

    pages(id, section, page), documents(section, title); a page without a document has no title, a target that is no
    page gives no row.
    """
    named = edges.where("o = 'fr'").select(F.col("s").alias("node"), F.col("d").alias("id")).distinct().join(pages.select("id", "section", "page"), "id")
    order = W.partitionBy("node").orderBy("section", "page", "id")
    titled = named.join(documents.groupBy("section").agg(F.min("title").alias("title")), "section", "left")
    return titled.withColumn("place", F.row_number().over(order)).select("node", "section", "page", "id", "title", "place")


def documents_only_items(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Items named on a page that no measured edge touches."""
    named = edges.where("o = 'fr'").select(F.col("d").alias("id")).distinct()
    measured = edges.where("o != 'fr'").select(F.explode(F.array("s", "d")).alias("id")).distinct()
    return items.join(named, "id", "left_semi").join(measured, "id", "left_anti")


def evidence_grade(items: DataFrame, code: DataFrame, edges: DataFrame, pages: DataFrame) -> DataFrame:
    """The best evidence for each item(id, name): in a statement, by a reference, in a document, or none."""
    has = lambda df, c, flag: df.select(F.col(c).alias(c)).distinct().withColumn(flag, F.lit(True))
    out = items.join(has(code, "name", "in_code"), "name", "left").join(has(edges, "id", "in_xref"), "id", "left").join(has(pages, "name", "in_page"), "name", "left")
    return out.withColumn("grade", F.when(F.col("in_code"), "code-confirmed").when(F.col("in_xref"), "xref-only").when(F.col("in_page"), "document-only").otherwise("inference")).drop("in_code", "in_xref", "in_page")


#: Members of a class that meet those of another in one cell.
CELL = 1024


def _parts(members: DataFrame, key: list[str], n: int, each: int) -> DataFrame:
    """Classes of members by ``key``, with the parts of some ``each`` members that they are cut in."""
    return members.groupBy(*key).agg(F.ceil(F.count("*") / each).alias(f"parts{n}"))


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Equi-join by pair and cell over all tasks: a number of partitions that is asked for is not joined again for being small in bytes."""
    key, n = ["pair", "c1", "c2"], int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(n, *key).join(b.repartition(n, *key).hint("shuffle_hash"), key)


def confusable_names(items: DataFrame, block: str, most: int = 2, each: int = CELL) -> DataFrame:
    """Pairs of different items(id, name, addr, block) of a block whose names nearly agree, and their distance in bytes.

    Equal names are one class, and classes are compared: names whose pieces agree after cutting them in ``most + 1`` meet in
    an equi-join. Members of two classes then meet in cells of some ``each`` by ``each``, dealt over tasks, so each pair is
    made once and none is shuffled. Only if an id names several items are its pairs brought together: the least edits and gap count.
    """
    plain = F.replace(F.upper("name"), F.lit("_"), F.lit(""))
    i = items.where("id is not null").select(F.col(block).alias("block"), "id", "addr", plain.alias("plain")).where("plain is not null and block is not null")
    size = lambda n: _parts(i, ["block", "plain"], n, each).withColumnRenamed("plain", f"plain{n}")
    classes = i.select("block", "plain").distinct()
    near = _near(classes, most).unionByName(classes.select("block", F.col("plain").alias("plain1"), F.col("plain").alias("plain2"), F.lit(0).alias("edits")))
    near = settled(near.join(size(1), ["block", "plain1"]).join(size(2), ["block", "plain2"]).withColumns({"pair": F.monotonically_increasing_id(), "own": F.col("plain1") == F.col("plain2")}))
    side = lambda n: i.select("block", F.col("plain").alias(f"plain{n}"), F.col("id").alias(f"i{n}"), F.col("addr").alias(f"addr{n}")).join(near, ["block", f"plain{n}"]).withColumn(f"c{n}", F.pmod(F.xxhash64(f"i{n}", f"addr{n}"), f"parts{n}"))
    own, none = F.col("own"), F.lit(0).cast("long")
    # Of a class with itself only cells on and above the diagonal.
    a = side(1).withColumn("c2", F.explode(F.sequence(F.when(own, F.col("c1")).otherwise(none), F.col("parts2") - 1)))
    b = side(2).withColumn("c1", F.explode(F.sequence(none, F.when(own, F.col("c2")).otherwise(F.col("parts1") - 1))))
    pairs = _met(a.select("pair", "c1", "c2", "i1", "addr1", "edits", "own"), b.select("pair", "c1", "c2", "i2", "addr2"))
    pairs = pairs.where(F.when(own & (F.col("c1") == F.col("c2")), F.col("i1") < F.col("i2")).otherwise(F.col("i1") != F.col("i2")))
    out = pairs.select(F.least("i1", "i2").alias("id1"), F.greatest("i1", "i2").alias("id2"), "edits", F.abs(F.col("addr1") - F.col("addr2")).alias("gap"))
    if i.groupBy("id").count().where("count > 1").isEmpty():
        return out
    return out.groupBy("id1", "id2").agg(F.min("edits").alias("edits"), F.min("gap").alias("gap"))


def _near(classes: DataFrame, most: int) -> DataFrame:
    """(block, plain1, plain2, edits): different names of classes(block, plain), each pair once, that are at most ``most`` edits apart."""
    c = classes.withColumn("len", F.length("plain"))
    cut = lambda n, k: F.floor(n * k / (most + 1)).cast("int")
    own = [F.struct(F.col("len").alias("l"), F.lit(k).alias("k"), F.substring("plain", cut(F.col("len"), k) + 1, cut(F.col("len"), k + 1) - cut(F.col("len"), k)).alias("p")) for k in range(most + 1)]
    probe = [F.struct((F.col("len") - d).alias("l"), F.lit(k).alias("k"), F.substring("plain", F.greatest(F.lit(1), cut(F.col("len") - d, k) + 1 + s), cut(F.col("len") - d, k + 1) - cut(F.col("len") - d, k)).alias("p")) for d in range(most + 1) for k in range(most + 1) for s in range(-most, most + 1)]
    a = c.select("block", F.col("plain").alias("a"), F.explode(F.array_distinct(F.array(*probe))).alias("e"))
    b = c.select("block", F.col("plain").alias("b"), F.explode(F.array(*own)).alias("e"))
    met = a.join(b, ["block", "e"]).where("a != b").withColumn("edits", F.levenshtein("a", "b")).where(F.col("edits") <= most)
    return met.select("block", F.least("a", "b").alias("plain1"), F.greatest("a", "b").alias("plain2"), "edits").distinct()


def address_collisions(items: DataFrame, each: int = CELL) -> DataFrame:
    """Items of different banks that share a mapped address.

    The items of two banks of an address meet in cells of some ``each`` by ``each``, so only pairs of different banks are
    made, and those of one address are dealt over tasks.
    """
    i = items.withColumn("mapped", S.program_address(F.col("addr"))).where("mapped is not null and bank is not null")
    size = lambda n: _parts(i, ["mapped", "bank"], n, each).withColumnRenamed("bank", f"bank{n}")
    banks = settled(size(1).join(size(2), "mapped").where("bank1 < bank2").withColumn("pair", F.monotonically_increasing_id()))
    side = lambda n: i.select("mapped", F.col("bank").alias(f"bank{n}"), F.col("id").alias(f"id{n}")).join(banks, ["mapped", f"bank{n}"]).withColumn(f"c{n}", F.pmod(F.xxhash64(f"id{n}"), f"parts{n}"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"parts{n}") - 1))
    pairs = _met(side(1).withColumn("c2", every(2)).select("pair", "c1", "c2", "mapped", "id1", "bank1", "bank2"), side(2).withColumn("c1", every(1)).select("pair", "c1", "c2", "id2"))
    return pairs.select("mapped", "id1", "bank1", "id2", "bank2")


def name_classes(items: DataFrame, block: str) -> DataFrame:
    """items(id, name, block) with ``class``: the least id of the items of their block whose plain names are equal."""
    plain = items.withColumn("plain", F.replace(F.upper("name"), F.lit("_"), F.lit("")))
    first = plain.groupBy(block, "plain").agg(F.min("id").alias("class"), F.count("*").alias("members"))
    return plain.join(first, [block, "plain"])


def confusable_classes(items: DataFrame, block: str, most: int = 2) -> DataFrame:
    """(class1, class2, edits, members1, members2): ``confusable_names`` between classes of equal names.

    Items of one name are one class, so their pairs are not written out: with ``name_classes`` they follow.
    """
    first = name_classes(items, block).groupBy(block, F.col("class").alias("id")).agg(F.min("plain").alias("name"), F.max("members").alias("members"))
    pairs = confusable_names(first.withColumn("addr", F.lit(None).cast("long")), block, most).select(F.col("id1").alias("class1"), F.col("id2").alias("class2"), "edits")
    size = lambda i: first.select(F.col("id").alias(f"class{i}"), F.col("members").alias(f"members{i}"))
    return pairs.join(size(1), "class1").join(size(2), "class2")


def collision_classes(items: DataFrame, image: str | None = None) -> DataFrame:
    """Per mapped address (of an image, if items name one) that several banks hold: (mapped, class, members, banks), class being the least id.

    Members are the items of that address; they are not paired with each other.
    """
    key = [*([image] if image else []), "mapped"]
    out = items.withColumn("mapped", S.program_address(F.col("addr"))).groupBy(*key).agg(F.min("id").alias("class"), F.count("*").alias("members"), F.array_sort(F.collect_set("bank")).alias("banks"))
    return out.where(F.size("banks") > 1)


def verify_rows(lines: DataFrame, decoded: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """lines '| name | address | value |' of a document against decoded(name, addr, value)."""
    cells = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    rows = lines.select(F.get(cells, F.lit(1)).alias("name"), S.hex_index(F.get(cells, F.lit(2))).alias("stated_addr"), F.get(cells, F.lit(3)).try_cast("double").alias("stated"))
    out = rows.join(decoded, "name", "left")
    return out.withColumn("addr_ok", F.col("stated_addr") == F.col("addr")).withColumn("value_ok", F.abs(F.col("stated") - F.col("value")) <= tolerance)
