"""Walks over the relation graph as level loops of joins, and queries on blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.io import settled


def adjacency(edges: DataFrame, direction: str, origins: list[str] | None = None, dense: DataFrame | None = None, rule: str = "coded") -> DataFrame:
    """(parent, next, o) steps. Page edges go out only, since both ways are stored.

    ``rule="coded"``: downstream leaves by anything but a write and returns along reads; upstream leaves by
    writes and returns along anything but a read. ``rule="dataflow"``: downstream follows the data, from a
    function to what it writes and from a value to its readers; upstream is the reverse.
    """
    e = edges if origins is None else edges.where(F.col("o").isin(origins))
    fr, code = e.where("o = 'fr'"), e.where("o != 'fr'")
    out = lambda df: df.select(F.col("s").alias("parent"), F.col("d").alias("next"), "o")
    back = lambda df: df.select(F.col("d").alias("parent"), F.col("s").alias("next"), "o")
    down = direction == "downstream"
    if rule == "coded":
        steps = out(code.where("k != 'write'")).unionByName(back(code.where("k = 'read'"))) if down else out(code.where("k = 'write'")).unionByName(back(code.where("k != 'read'")))
    else:
        steps = out(code.where("k != 'read'")).unionByName(back(code.where("k = 'read'"))) if down else back(code.where("k != 'read'")).unionByName(out(code.where("k = 'read'")))
    steps = steps.unionByName(out(fr))
    if dense is not None:
        steps = steps.join(dense.select(F.col("id").alias("next")), "next", "left_anti")
    return steps.select("parent", "next", "o").distinct()


def ranked_children(steps: DataFrame, most: int) -> DataFrame:
    """Per parent each target once, measured before inferred before documents, then by id, at most ``most``; truncated tells that there are more."""
    rank = F.when(F.col("o") == "xref", 0).when(F.col("o") == "scan", 1).otherwise(2)
    once = steps.groupBy("parent", "next").agg(F.min(rank).alias("rank"))
    w = W.partitionBy("parent")
    return once.withColumn("pos", F.row_number().over(w.orderBy("rank", "next"))).withColumn("n", F.count("*").over(w)).where(F.col("pos") <= most).withColumn("truncated", F.col("n") > most).drop("n")


def expand(steps: DataFrame, root: str, depth: int = 3, most: int = 40) -> DataFrame:
    """(level, parent, node, pos, repeated, truncated): a tree in which a node is opened once, at its first place."""
    return _grown(ranked_children(steps, most), root, depth)


def ranked_blocks(pairs: DataFrame, scores: DataFrame, most: int) -> DataFrame:
    """Per block its neighbours pairs(block, next) by falling score, then by id, at most ``most``; truncated tells that there are more."""
    w = W.partitionBy("parent")
    s = scores.select(F.col("block").alias("next"), "score")
    out = pairs.select(F.col("block").alias("parent"), "next").distinct().join(s, "next", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    out = out.withColumn("pos", F.row_number().over(w.orderBy(F.desc("score"), "next"))).withColumn("truncated", F.count("*").over(w) > most)
    return out.where(F.col("pos") <= most).select("parent", "next", "pos", "truncated")


def expand_blocks(pairs: DataFrame, scores: DataFrame, root: str, depth: int = 3, most: int = 24) -> DataFrame:
    """The tree of blocks, the best scored neighbours first: (level, parent, node, pos, repeated, truncated)."""
    return _grown(ranked_blocks(pairs, scores, most), root, depth)


def expand_linked(links: DataFrame, scores: DataFrame, depth: int = 3, most: int = 24) -> DataFrame:
    """``expand_blocks`` of the blocks that links join, from the least block that has a neighbour; no pairs are written."""
    children = settled(best_neighbours(links, scores, most).select(F.col("block").alias("parent"), "next", "pos", (F.col("n") > most).alias("truncated")))
    return _grown(children, children.agg(F.min("parent")).first()[0], depth)


def _grown(children: DataFrame, root, depth: int) -> DataFrame:
    children = settled(children)
    spark, kind = children.sparkSession, children.schema["next"].dataType
    tree = spark.range(1).select(F.lit(0).alias("level"), F.lit(None).cast(kind).alias("parent"), F.lit(root).cast(kind).alias("node"), F.lit(1).alias("pos"), F.lit(False).alias("repeated"), F.lit(False).alias("truncated"), F.lit("").alias("path"))
    seen = frontier = settled(tree)
    for level in range(1, depth + 1):
        new = frontier.where("not repeated").select(F.col("node").alias("parent"), "path").join(children, "parent").select(F.lit(level).alias("level"), "parent", F.col("next").alias("node"), "pos", "truncated", F.concat("path", F.format_string("/%05d", "pos")).alias("path"))
        first = F.row_number().over(W.partitionBy("node").orderBy("path")) > 1
        new = new.join(seen.select("node").distinct().withColumn("known", F.lit(True)), "node", "left").withColumn("repeated", F.coalesce("known", F.lit(False)) | first).select(*tree.columns)
        frontier = settled(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.drop("path")


def reachable(steps: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, distance) for many roots(id) at once: the fewest steps to each node within ``depth``.

    64 roots share a word, so a level's shuffle is bound by nodes times words, and state is one row per node and
    word. Repeated roots count once; a null root reaches nothing.
    """
    steps = settled(steps.select("parent", "next").distinct())
    # Ids run from 0 in each partition of the written table, so words are full but for the last of a partition.
    numbered = settled(roots.select(F.col("id").alias("root")).where("root is not null").distinct().withColumn("number", F.monotonically_increasing_id()))
    at = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % 64).cast("int"))
    level = settled(numbered.groupBy(F.col("root").alias("node"), F.floor(F.col("number") / 64).alias("word")).agg(F.bit_or(at).alias("new")).withColumn("seen", F.col("new")))
    found = level.where("new != 0").select("node", "word", "new", F.lit(0).alias("distance"))
    for d in range(1, depth + 1):
        step = level.where("new != 0").join(steps, F.col("node") == F.col("parent")).groupBy(F.col("next").alias("node"), "word").agg(F.bit_or("new").alias("come"))
        both = step.join(level.select("node", "word", "seen"), ["node", "word"], "full")
        come, seen = F.coalesce("come", F.lit(0).cast("long")), F.coalesce("seen", F.lit(0).cast("long"))
        level = settled(both.select("node", "word", come.bitwiseAND(F.bitwise_not(seen)).alias("new"), come.bitwiseOR(seen).alias("seen")))
        fresh = level.where("new != 0")
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh.select("node", "word", "new", F.lit(d).alias("distance")))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("new"), i) == 1)
    out = found.select("node", "distance", "word", F.explode(bits).alias("bit")).withColumn("number", F.col("word") * 64 + F.col("bit"))
    return out.join(numbered, "number").select("root", "node", "distance")


#: Pairs that a task makes of one signal.
PAIRS = 65_536


def signal_links(statements: DataFrame, functions: DataFrame, edges: DataFrame, nodes: DataFrame, index: DataFrame) -> DataFrame:
    """(block, signal, dir), each once: who writes and who reads a signal.

    Statements(block, out, reads) say it where a block has any: of what they assign and read, names that are signals. A
    function(id) without statements has it from its measured edges to RAM nodes: a write writes the node's name, every
    other kind reads it. nodes(id, t, name, kind), index(name, node).
    """
    out = statements.select("block", S.out_name(F.col("out")).alias("signal"), F.lit("write").alias("dir"))
    reads = statements.select("block", F.explode("reads").alias("signal"), F.lit("read").alias("dir")).where(~S.is_helper(F.col("signal")))
    said = out.unionByName(reads).where(~S.is_symbol_noise(F.col("signal"))).distinct()
    kinds = symbol_kinds(said.select(F.col("signal").alias("name")), index, nodes).where("kind = 'signal'").select(F.col("name").alias("signal"))
    return said.join(kinds, "signal", "left_semi").unionByName(ram_links(statements, functions, edges, nodes))


def ram_links(statements: DataFrame, functions: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(block, signal, dir) of functions without statements, by their measured edges to RAM nodes."""
    bare = functions.select(F.col("id").alias("s")).join(statements.select(F.col("block").alias("s")), "s", "left_anti")
    ram = nodes.where("t = 'ram'").select(F.col("id").alias("d"), F.col("name").alias("signal"))
    way = F.when(F.col("k") == "write", "write").otherwise("read").alias("dir")
    return edges.where("o != 'fr'").join(bare, "s", "left_semi").join(ram, "d").select(F.col("s").alias("block"), "signal", way).distinct()


def signal_classes(links: DataFrame) -> DataFrame:
    """(signal, writers, readers, pairs): a signal's chain without its pairs; pairs leave out a block with itself."""
    both = links.groupBy("signal", "block").agg(F.max((F.col("dir") == "write").cast("long")).alias("w"), F.max((F.col("dir") == "read").cast("long")).alias("r"))
    return both.groupBy("signal").agg(F.sum("w").alias("writers"), F.sum("r").alias("readers"), F.sum(F.col("w") * F.col("r")).alias("same")).select("signal", "writers", "readers", (F.col("writers") * F.col("readers") - F.col("same")).alias("pairs"))


def signal_chain(links: DataFrame, most: int | None = None, each: int = PAIRS) -> DataFrame:
    """(src, signal, dst): a block that writes a signal and another that reads it.

    The pairs of a signal are dealt over sub-keys, some ``each`` pairs to one: its writers are dealt by their hash, its
    readers are sent to every sub-key, so a hub is no single task. With ``most``, signals of more pairs give none; they
    stay in ``signal_classes``.
    """
    sizes = signal_classes(links).where("pairs > 0")
    sizes = sizes if most is None else sizes.where(F.col("pairs") <= most)
    keys = sizes.select("signal", F.least("writers", F.ceil(F.col("writers") * F.col("readers") / each)).cast("int").alias("keys"))
    dealt = links.join(keys, "signal")
    writes = dealt.where("dir = 'write'").select(F.col("block").alias("src"), "signal", F.pmod(F.xxhash64("block"), F.col("keys")).cast("int").alias("key"))
    reads = dealt.where("dir = 'read'").select(F.col("block").alias("dst"), "signal", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("key"))
    return writes.join(reads, ["signal", "key"]).where("src != dst").select("src", "signal", "dst")


def block_neighbours(chain: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(block, next, via): by the least shared signal, or by calls."""
    if kind == "call":
        return edges.where("k = 'call' and o != 'fr'").select(F.col("s").alias("block"), F.col("d").alias("next"), F.lit("call").alias("via")).distinct()
    return chain.groupBy(F.col("src").alias("block"), F.col("dst").alias("next")).agg(F.min("signal").alias("via"))


#: Readers of a signal that travel as one list, and pairs of a block that one task brings together.
LIST, BROUGHT = 1024, 1 << 22


def _read_lists(writers: DataFrame, readers: DataFrame, each: int, most: int) -> DataFrame:
    """(src, sub, own, signal, held): what readers(signal, at) of its signals are, by each of writers(src, own, signal), in tasks by src and sub.

    A signal's readers travel as lists of some ``each``, not as a row a pair. A block of more than ``most`` pairs is dealt over
    several ``sub``, each with the readers of some hashes, so an ``at`` of a block is in one task.
    """
    n = int(readers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = readers.repartition(n, "signal")
    sizes = read.groupBy("signal").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / each))
    lists = read.join(sizes, "signal").groupBy("signal", F.pmod(F.xxhash64("at"), "parts").alias("part")).agg(F.collect_list("at").alias("held"))
    w = writers.join(sizes, "signal")
    fans = w.groupBy("src").agg(F.ceil(F.sum("n") / most).alias("fan"))
    count = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    both = w.join(fans, "src").select("src", "own", "signal", "fan", count("parts").alias("part")).join(lists, ["signal", "part"]).withColumn("sub", count("fan"))
    some = F.filter("held", lambda x: F.pmod(F.xxhash64(x), F.col("fan")) == F.col("sub"))
    return both.select("src", "sub", "own", "signal", F.when(F.col("fan") == 1, F.col("held")).otherwise(some).alias("held")).repartition(n, "src", "sub")


def neighbours(links: DataFrame, each: int = LIST, most: int = BROUGHT) -> DataFrame:
    """``block_neighbours`` of the chain of links, without the chain: (block, next, via), by the least shared signal."""
    writers = links.where("dir = 'write'").select(F.col("block").alias("src"), F.col("block").alias("own"), "signal")
    lists = _read_lists(writers, links.where("dir = 'read'").select("signal", F.col("block").alias("at")), each, most)
    pairs = lists.select("src", "sub", "signal", F.explode("held").alias("next")).where("src != next")
    return pairs.groupBy("src", "sub", "next").agg(F.min("signal").alias("via")).select(F.col("src").alias("block"), "next", "via")


def best_neighbours(links: DataFrame, scores: DataFrame, cap: int, each: int = LIST, most: int = BROUGHT) -> DataFrame:
    """(block, next, score, pos, n): of the n neighbours of a block by shared signals the ``cap`` best scored, then by id.

    Blocks are numbered in the order of score and id, lists hold these numbers, and a block keeps its least ones.
    """
    read = links.where("dir = 'read'").select("block", "signal")
    rated = read.select("block").distinct().join(scores.select("block", "score"), "block", "left").withColumn("score", F.coalesce("score", F.lit(0).cast("long")))
    # Partitions of a sorted table follow each other, so the numbers rise with the order.
    places = settled(rated.orderBy(F.desc("score"), "block").withColumn("at", F.monotonically_increasing_id()))
    own = places.select("block", F.col("at").alias("own"))
    writers = links.where("dir = 'write'").select("block", "signal").join(own, "block", "left").select(F.col("block").alias("src"), F.coalesce("own", F.lit(-1).cast("long")).alias("own"), "signal")
    lists = _read_lists(writers, read.join(places, "block").select("signal", "at"), each, most)
    met = lists.groupBy("src", "sub").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.max("own").alias("own")).withColumn("held", F.array_remove("held", F.col("own")))
    some = met.select("src", F.size("held").cast("long").alias("n"), F.slice(F.sort_array("held"), 1, cap).alias("held"))
    best = some.groupBy("src").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("held"))), 1, cap).alias("held"))
    rows = best.select(F.col("src").alias("block"), "n", F.posexplode("held").alias("pos", "at"))
    return rows.join(places.withColumnRenamed("block", "next"), "at").select("block", "next", "score", (F.col("pos") + 1).alias("pos"), "n")


def block_score(statements: DataFrame, named_bonus: int = 3, per_interp: int = 10, per_name: int = 4, count_cap: int = 5) -> DataFrame:
    """(block, score): statements that interpolate or name a calibration item, a name of its own, and how many there are."""
    cal = F.col("expr").rlike(r"\bK[FL]?_")
    worth = F.when(F.size("interp") > 0, per_interp).when(cal, per_name).otherwise(0)
    total = F.sum(worth) + F.max(F.when(F.col("named"), named_bonus).otherwise(0)) + F.least(F.count("*"), F.lit(count_cap))
    return statements.groupBy("block").agg(total.cast("long").alias("score"))


def top_neighbours(pairs: DataFrame, scores: DataFrame, cap: int = 5) -> DataFrame:
    """Per block the best scored neighbours, and how many stay hidden."""
    w = W.partitionBy("block")
    s = scores.select(F.col("block").alias("next"), "score")
    out = pairs.join(s, "next", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    out = out.withColumn("pos", F.row_number().over(w.orderBy(F.desc("score"), "next"))).withColumn("hidden", F.greatest(F.count("*").over(w) - cap, F.lit(0)))
    return out.where(F.col("pos") <= cap)


def owning_block(edges: DataFrame, functions: DataFrame, scores: DataFrame) -> DataFrame:
    """(node, block): the best scored function that a measured edge joins to the node; the least id in a tie."""
    m = edges.where("o != 'fr'")
    both = m.select(F.col("s").alias("node"), F.col("d").alias("block")).union(m.select("d", "s"))
    near = both.join(functions.select(F.col("id").alias("block")), "block", "left_semi").join(scores, "block", "left")
    return near.groupBy("node").agg(F.min_by("block", F.struct(-F.coalesce("score", F.lit(0)), "block")).alias("block"))


def symbol_kinds(names: DataFrame, index: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """names(name) with kind and target: by the exact name in index(name, node), then by its lower-cased spelling as a key there, then by prefix.

    nodes(id, t, kind): kind is that of a calibration item, null for others.
    """
    names = names.select("name").distinct()
    if index is None or nodes is None:
        return names.select("name", S.kind_by_prefix(F.col("name")).alias("kind"), F.lit(None).cast("string").alias("target"))
    of = lambda c, n: index.select(F.col("name").alias(c), F.col("node").alias(n))
    found = names.join(of("_x", "_exact"), F.col("name") == F.col("_x"), "left").join(of("_l", "_lower"), F.lower("name") == F.col("_l"), "left")
    found = found.select("name", F.coalesce("_exact", "_lower").alias("target")).join(nodes.select(F.col("id").alias("target"), "t", F.col("kind").alias("item")), "target", "left")
    item = F.when(F.col("item").isin("map", "curve"), F.col("item")).otherwise("constant")
    kind = F.when(F.col("t") == "param", item).when(F.col("t") == "func", "block").when(F.col("t") == "ram", "signal").otherwise(S.kind_by_prefix(F.col("name")))
    return found.select("name", kind.alias("kind"), F.when(F.col("t").isin("param", "func", "ram"), F.col("target")).alias("target"))


PORT_KINDS = ["map", "curve", "constant", "signal", "block", "unknown"]


def block_ports(statements: DataFrame, functions: DataFrame, edges: DataFrame, nodes: DataFrame, index: DataFrame) -> DataFrame:
    """(block, port, dir, kind, alternative, target, rank): inputs and outputs, each once, in the order of kinds.

    Inputs are what statements(block, ord, out, expr, reads, calls) read, and of what they call the blocks; a read is an
    alternative if the first statement that reads it names it in braces, as in {A | B}. A function(id) without any such
    port has its measured edges' ends but pages: a write is an output, an edge of the scan an alternative. Of several
    edges to one name the greatest (o, d) counts.
    """
    braced = F.flatten(F.transform(F.regexp_extract_all("expr", F.lit(r"\{([^{}]+)\}"), F.lit(1)), lambda x: F.transform(F.split(x, r"\|"), lambda y: F.trim(y))))
    row = lambda port, dir_, called, alternative: statements.select("block", "ord", port.alias("port"), F.lit(dir_).alias("dir"), F.lit(called).alias("called"), alternative.alias("pieces"))
    none = F.array().cast("array<string>")
    reads, calls = (row(F.explode(c), "in", c == "calls", p).where(~S.is_helper(F.col("port"))) for c, p in (("reads", braced), ("calls", none)))
    outs = row(S.out_name(F.col("out")), "out", False, none)
    said = reads.unionByName(calls).unionByName(outs).where(~S.is_symbol_noise(F.col("port")))
    kinds = symbol_kinds(said.select(F.col("port").alias("name")), index, nodes).withColumnRenamed("name", "port")
    known = said.join(kinds, "port").where("not called or kind = 'block'")
    first = F.struct("ord", "called")
    found = known.groupBy("block", "port", "dir", "kind", "target").agg(F.min_by(F.coalesce(F.array_contains("pieces", F.col("port")), F.lit(False)), first).alias("alternative"))
    bare = functions.select(F.col("id").alias("s")).join(found.select(F.col("block").alias("s")), "s", "left_anti")
    ends = nodes.where("t != 'frpage'").select(F.col("id").alias("d"), F.col("name").alias("port"))
    seen = edges.where("o != 'fr'").join(bare, "s", "left_semi").join(ends, "d").withColumn("dir", F.when(F.col("k") == "write", "out").otherwise("in"))
    seen = seen.groupBy(F.col("s").alias("block"), "port", "dir").agg(F.max(F.struct("o", "d")).alias("e")).select("block", "port", "dir", (F.col("e.o") == "scan").alias("alternative"), F.col("e.d").alias("target"))
    drawn = seen.join(symbol_kinds(seen.select(F.col("port").alias("name")), index, nodes).select(F.col("name").alias("port"), "kind"), "port")
    rank = F.array_position(F.array(*map(F.lit, PORT_KINDS)), F.col("kind"))
    columns = ["block", "port", "dir", "kind", "alternative", "target"]
    return found.select(*columns).unionByName(drawn.select(*columns)).withColumn("rank", rank)


def consumers(edges: DataFrame, functions: DataFrame, statements: DataFrame) -> DataFrame:
    """(node, func, n): functions that a measured edge joins to a node, and their statements."""
    m = edges.where("o != 'fr'")
    both = m.select(F.col("s").alias("node"), F.col("d").alias("func")).union(m.select("d", "s")).distinct()
    n = statements.groupBy(F.col("block").alias("func")).agg(F.count("*").alias("n"))
    return both.join(functions.select(F.col("id").alias("func")), "func", "left_semi").join(n, "func", "left").na.fill({"n": 0})


def search(nodes: DataFrame, q: str, limit: int = 60) -> DataFrame:
    """Exact, prefix, inner and description hits by kind of node, then length of name; pages are left out. A blank query finds nothing."""
    q = q.strip().lower()
    name, text = F.lower("name"), F.lower(F.coalesce("description", F.lit("")))
    cls = F.when(name == q, 0).when(name.startswith(q), 1).when(name.contains(q), 2).when(text.contains(q), 3)
    kind = F.when(F.col("t") == "param", 0).when(F.col("t") == "func", 1).otherwise(2)
    return nodes.where(F.lit(q != "") & (F.col("t") != "frpage")).withColumn("class", cls).where("class is not null").withColumn("kind_rank", kind).orderBy("kind_rank", F.length("name"), "class", "id").limit(limit)


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of n letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n))))


def search_many(nodes: DataFrame, queries: DataFrame, limit: int = 60) -> DataFrame:
    """(query, id, t, name, class, pos): ``search`` for every row of queries(query), by an inverted index of trigrams.

    A query meets the nodes that hold its rarest trigram (the whole query, if it is shorter) and is compared with
    these only. Only trigrams that occur in a query are indexed. Repeated queries count once; blank and null ones
    find nothing. ``query`` is returned trimmed and in lower case.
    """
    q = queries.select(F.lower(F.regexp_replace("query", r"^\s+|\s+$", "")).alias("query")).where("query != ''").distinct()
    q = settled(q.withColumn("n", F.least(F.length("query"), F.lit(3))).withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("query") - F.col("n") + 1), lambda i: F.substr("query", i, F.col("n")))))))
    texts = nodes.where("t != 'frpage'").select("id", "t", "name", F.lower(F.coalesce("name", F.lit(""))).alias("low"), F.lower(F.coalesce("description", F.lit(""))).alias("text"))
    # Names and descriptions do not run together: their grams are taken apart.
    grams = lambda c: F.flatten(F.array(*(_grams(F.col(c), n) for n in (1, 2, 3))))
    index = texts.select("id", F.explode(F.array_distinct(F.concat(grams("low"), grams("text")))).alias("gram"))
    index = settled(index.join(q.select("gram").distinct(), "gram", "left_semi"))
    often = index.groupBy("gram").agg(F.count("*").alias("often"))
    rarest = q.join(often, "gram", "left").groupBy("query").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)), "gram")).alias("gram"))
    hits = rarest.join(index, "gram").select("query", "id").join(texts, "id")
    low, text, x = F.col("low"), F.col("text"), F.col("query")
    cls = F.when(low == x, 0).when(F.startswith(low, x), 1).when(F.contains(low, x), 2).when(F.contains(text, x), 3)
    kind = F.when(F.col("t") == "param", 0).when(F.col("t") == "func", 1).otherwise(2)
    ranked = hits.withColumn("class", cls).where("class is not null").withColumn("pos", F.row_number().over(W.partitionBy("query").orderBy(kind, F.length("name"), "class", "id")))
    return ranked.where(F.col("pos") <= limit).select("query", "id", "t", "name", "class", "pos")


def top_statements(statements: DataFrame, most: int = 12) -> DataFrame:
    """Per block the most telling statements in source order, and how many are hidden. statements(block, ord, expr, interp)."""
    bare = F.col("expr").rlike(r"^\s*-?(0x[0-9a-fA-F]+|\d+)\s*$")
    rank = F.when(F.size("interp") > 0, 0).when(F.col("expr").rlike(r"\bK[FL]?_"), 1).when(bare, 3).otherwise(2)
    w = W.partitionBy("block")
    out = statements.withColumn("rank", rank).withColumn("pos", F.row_number().over(w.orderBy("rank", "ord"))).withColumn("hidden", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return out.where(F.col("pos") <= most).withColumn("place", F.row_number().over(w.orderBy("ord")))


def relevant_statements(statements: DataFrame, signal: str, most: int = 2) -> DataFrame:
    """Statements that write or read the signal, else all; the first ``most`` of each block and how many remain."""
    w = W.partitionBy("block")
    hit = (S.out_name(F.col("out")) == signal) | F.array_contains("reads", signal)
    out = statements.withColumn("hit", hit).withColumn("some", F.max("hit").over(w)).where("hit or not some")
    out = out.withColumn("pos", F.row_number().over(w.orderBy("ord"))).withColumn("rest", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return out.where(F.col("pos") <= most).drop("some")


#: Unnamed addresses, parameters, temporaries, register parts, pointer walks and peripheral registers.
STATEMENT_NOISE = r"\b(?:DAT|UNK|PTR)_[0-9a-fA-F]{6,8}\b|\bparam_\d+\b|\b[a-z]{1,3}Var\d+\b|\b\w+_\d+_\d+_\b|\*\s*\(|\b(?:SIM_|TPU_|QSM_|SIM\b)"


def statement_noise(statements: DataFrame, known: DataFrame) -> DataFrame:
    """Adds noise: true for bookkeeping that says nothing about the function. known(name): names in the graph.

    A statement that interpolates or names a calibration item is none; a bare constant is one only if the
    graph does not know its target.
    """
    text = F.concat_ws(" = ", "out", "expr")
    keep = (F.size("interp") > 0) | text.rlike(r"\b(?:KF|KL|K)_[A-Z0-9_]+")
    bare = text.rlike(r"^\s*[\w.\[\]]+\s*=\s*(?:0x[0-9a-fA-F]+|-?\d+)\s*$")
    k = known.select(F.col("name").alias("_known")).distinct()
    out = statements.join(k, S.out_name(F.col("out")) == F.col("_known"), "left")
    return out.withColumn("noise", ~keep & (text.rlike(STATEMENT_NOISE) | (bare & F.col("_known").isNull()))).drop("_known")


def definition_as_of(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """uses(func, name, line) with the latest earlier definition defs(func, name, line, expr) of the same name."""
    every = defs.select("func", "name", "line", "expr", F.lit(1).alias("is_def")).unionByName(uses.select("func", "name", "line", F.lit(None).cast("string").alias("expr"), F.lit(0).alias("is_def")))
    w = W.partitionBy("func", "name").orderBy("line", "is_def").rowsBetween(W.unboundedPreceding, -1)
    return every.withColumn("seen", F.last(F.when(F.col("is_def") == 1, F.col("expr")), ignorenulls=True).over(w)).where("is_def = 0").select("func", "name", "line", F.col("seen").alias("expr"))


def cooccurrence(pages: DataFrame, dense: int = 25) -> DataFrame:
    """(a, b, pages): names on one page; pages of more than ``dense`` names are left out, which bounds a page's pairs."""
    p = pages.where(F.size("names") <= dense)
    p = p.select(F.array_sort(F.array_distinct("names")).alias("n"))
    pairs = F.flatten(F.transform("n", lambda a, i: F.transform(F.slice(F.col("n"), i + 2, F.size("n")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return p.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("pages"))
