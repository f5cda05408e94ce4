"""Line dedup by an exact set-similarity join of lines, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakforge.llm.store import drop, free_name, small, written

#: Lines match when 100 * intersection >= PERCENT * union of their word sets.
PERCENT = 80
#: Rarity is counted for so many classes of words, by hash: a bounded table, whatever the vocabulary.
CLASSES = 1 << 18
#: Lines in a bucket of so many may have many links: their pairs are looked at with a longer sketch, and made once.
CROWD = 8
#: Lines of more words have a sketch of 128 bits instead of 64.
LONG = 64
_SPACE = r"[\x20\x09-\x0D]+"
_LEAST = -(2**63)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by)


def _words(line: Column) -> Column:
    """The words of a line. The plain split is the fast one, and right where words are one 0x20 apart."""
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | (line == "")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.when(odd, F.array_remove(F.split(line, _SPACE), "")).otherwise(F.split(line, " "))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit identity of the row (r1, r2); rows that share doc_id and text share it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("r2"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    """Every line: its place, its 128-bit identity (h1, h2), and a 32-bit hash of each distinct word (one for each, equal or not)."""
    lines = _rows(docs).select("doc_id", "r1", "r2", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = F.transform(F.array_distinct(_words(F.col("line"))), lambda w: F.hash(w))
    return lines.select("doc_id", "r1", "r2", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), words.alias("words"))


def _place() -> Column:
    return F.struct(F.coalesce("doc_id", _long(_LEAST)).alias("doc_id"), "line_no", "r1", "r2")


def rarity(lines: DataFrame) -> DataFrame:
    """One row, ranks: for each of CLASSES classes of words (by hash) a number, greater for those that more lines hold (four steps an octave).

    It is a table and not a constant, which Spark would print into every description of a plan, on the driver.
    """
    k = F.col("w").bitwiseAND(F.lit(CLASSES - 1)).cast("long")
    held = lines.select(F.explode("words").alias("w")).groupBy(k.alias("k")).count()
    every = held.select("k", F.floor(4 * F.log2("count")).cast("short").alias("r")).unionByName(lines.sparkSession.range(CLASSES).select(F.col("id").alias("k"), F.lit(0).cast("short").alias("r")))
    ranks = every.groupBy("k").agg(F.max("r").alias("r")).agg(F.sort_array(F.collect_list(F.struct("k", "r"))).alias("x"))
    return written(ranks.select(F.col("x.r").alias("ranks")), "ranks")


def _ordered(words: Column, ranks: Column) -> Column:
    """Hashes of words as longs in one order for all lines: those of rare classes first."""
    rank = lambda w: F.shiftleft(F.get(ranks, w.bitwiseAND(F.lit(CLASSES - 1))).cast("long"), 32)
    own = lambda w: w.cast("long").bitwiseAND(_long((1 << 32) - 1))
    return F.sort_array(F.transform(words, lambda w: F.coalesce(rank(w).bitwiseOR(own(w)), _long(0))))  # never null, and Spark sorts such longs as they are


def _sketch(words: Column, bit: Callable[[Column], Column]) -> Column:
    """64 bits, each the parity of the words that fall on it: sets that differ in d words have sketches that differ in d bits at most."""
    return F.aggregate(words, _long(0), lambda bits, w: bits.bitwiseXOR(_shift(bit(w), w)))


def _halves() -> tuple[Column, Column]:
    upper = lambda w: F.shiftrightunsigned(w, 6).bitwiseAND(F.lit(1))
    long = F.col("n") > LONG
    low = F.when(long, _sketch(F.col("words"), lambda w: upper(w).cast("long"))).otherwise(_sketch(F.col("words"), lambda _: _long(1)))
    return low, F.when(long, _sketch(F.col("words"), lambda w: upper(w).bitwiseXOR(F.lit(1)).cast("long"))).otherwise(_long(0))


def _eighth(words: Column, k: int) -> Column:
    """An eighth of a sketch of 512 bits, of hashes of words."""
    return _sketch(F.filter(words, lambda w: F.shiftrightunsigned(w, 6).bitwiseAND(F.lit(7)) == k), lambda _: _long(1))


def _apart(x: str, y: str) -> Column:
    """At least so many words are in one of two lines alone; their columns n, b, c end in x and y."""
    b, c = (F.col(k + x).bitwiseXOR(F.col(k + y)) for k in "bc")
    return F.when(F.least("n" + x, "n" + y) > LONG, F.bit_count(b) + F.bit_count(c)).otherwise(F.bit_count(b.bitwiseXOR(c)))


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(h, h2, line) of places (h, h2, first): the lines themselves, each from the first document that holds it."""
    at = places.groupBy(F.col("first.r1").alias("r1"), F.col("first.r2").alias("r2")).agg(F.collect_list(F.struct("h", "h2", "first.line_no")).alias("at"))
    rows = _rows(docs).select("r1", "r2", "text").join(small(written(at, "places")), ["r1", "r2"])
    return rows.select(F.explode(F.expr("transform(at, a -> struct(a.h as h, a.h2 as h2, split(text, '\n')[a.line_no] as line))")).alias("x")).select("x.*").dropDuplicates(["h", "h2"])


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v) of lines by half of their identity, with the other half (u2, v2), their sizes (nu, nv) and what is in both (common), by sets (h, h2, s)."""
    x, y = (sets.select(F.col("h").alias(k), F.col("h2").alias(k + "2"), F.col("s").alias("s" + k)) for k in "uv")
    both = pairs.join(y, "v").join(x, "u").withColumns({"nu": F.size("su"), "nv": F.size("sv"), "common": F.size(F.array_intersect("su", "sv"))})
    return both.drop("su", "sv")


def _lengths(percent: int) -> Column:
    return 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")


def _similar(percent: int) -> Column:
    return 100 * F.col("common") >= percent * (F.col("nu") + F.col("nv") - F.col("common"))


def _slack(percent: int, own: str) -> Column:
    """(100 + percent) * d - (100 - percent) * n for a line of n words, d of them or of its hub's in one of the two alone."""
    return (100 + percent) * (F.col("nu") + F.col("nv") - 2 * F.col("common")) - (100 - percent) * F.col(own)


def _groups(nodes: DataFrame, lines: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(u, u2, v, v2, slack): lines u that are similar to a hub v, and how far, by the hashes of their words; and (h, h2, q) of all lines that have or may have a hub or many links, with their sketch of 512 bits.

    Lines that share two hashes at an end of the order of their rarer words' hashes are a bucket; its hub is the line
    with the most copies, then with the largest buckets: of a group of near copies, one with few words of its own. A line that is similar
    to the hub of its hub goes there. Any choice gives the same result; a good one leaves few pairs to the prefix join.
    """
    every = nodes.where("n > 0").select("h", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = every.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    member = member_keys = written(every.join(sizes, "key"), "members", hashes=True)
    shapes = nodes.select("h", F.col("copies").alias("weight"), *[F.col(c).alias(c + "x") for c in "nbc"])
    central = member.groupBy("h").agg(F.sum("m").alias("m"))
    member = member.select("h", "key").join(shapes.join(small(written(central, "central", hashes=True)), "h"), "h")
    hub = F.max(F.struct("weight", "m", F.col("h").alias("v"), *[F.col(c + "x").alias(c + "y") for c in "nbc"])).alias("hub")
    hubs = member.groupBy("key").agg(hub).select("key", F.struct("hub.weight", "hub.m").alias("hub_weight"), *["hub." + c for c in ("v", "ny", "by", "cy")])
    fits = _lengths(percent) & ((100 + percent) * _apart("x", "y") <= (100 - percent) * (F.col("nx") + F.col("ny")))
    near = member.join(hubs, "key").where((F.col("h") != F.col("v")) & fits)
    ends = ["v", *[c + "y" for c in "nbc"]]
    own = [c + "x" for c in "nbc"]
    best = F.max(F.struct("hub_weight", *ends)).alias("hub")
    chosen = written(near.groupBy(F.col("h").alias("u"), *own).agg(best).select("u", *own, "hub.*"), "chosen", hashes=True)
    for _ in range(2):
        above = chosen.select(F.col("u").alias("v"), F.struct("hub_weight", *ends).alias("above"))
        both = chosen.join(small(above), "v", "left").select("u", *own, F.struct("hub_weight", *ends).alias("hub"), "above")
        moved = both.where("above is not null").select("u", *own, "hub", "above.*").where((F.col("u") != F.col("v")) & fits).select("u", *own, F.struct("hub_weight", *ends).alias("hub"))
        later = both.drop("above").unionByName(moved).groupBy("u", *own).agg(F.max("hub").alias("hub")).select("u", *own, "hub.*")
        chosen, spent = written(later, "chosen", hashes=True), chosen
        drop(spent)
    chosen = chosen.select("u", "v")
    crowded = member_keys.where(F.col("m") >= CROWD).select("h")
    named = written(chosen.select(F.col("u").alias("h")).union(chosen.select("v")).union(crowded).distinct(), "named")
    sets = lines.select(F.col("h1").alias("h"), "h2", F.col("words").alias("s")).join(small(named), "h", "left_semi").dropDuplicates(["h", "h2"])
    sets = written(sets, "sets", hashes=True)
    found = _measured(chosen, sets).where(_similar(percent))
    groups = written(found.select("u", "u2", "v", "v2", _slack(percent, "nu").alias("slack"), "nv"), "groups")
    crowd = written(sets.select("h", "h2", F.array(*[_eighth(F.col("s"), k) for k in range(8)]).alias("q")), "crowd", hashes=True)
    for x in (sets, chosen, named, member_keys):
        drop(x)
    return groups, crowd


def _members(groups: DataFrame, percent: int) -> DataFrame:
    """(h, h2, hub, slack): each line of groups once; a hub belongs to itself."""
    own = groups.select(F.col("v").alias("h"), F.col("v2").alias("h2"), F.col("v").alias("hub"), (-(100 - percent) * F.col("nv")).alias("slack")).distinct()
    rest = groups.select(F.col("u").alias("h"), F.col("u2").alias("h2"), F.col("v").alias("hub"), "slack")
    return own.unionByName(rest.join(own.select("h", "h2"), ["h", "h2"], "left_anti"))


def _within(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(h, h2, near, links): for the lines of a hub, the first place and the number of the others whose slack and theirs add up to 0 or less.

    Such lines are similar, by the triangle inequality. They are counted from sums for each slack of a hub, so a group of m lines costs m rows and not its pairs.
    """
    rows = members.join(nodes.select("h", "h2", "first"), ["h", "h2"])
    sums = rows.groupBy("hub", "slack").agg(F.count("*").alias("m"), F.min("first").alias("first"))
    asked = sums.select("hub", (-F.col("slack")).alias("at"), F.lit(1).alias("kind"), F.col("slack"), F.lit(0).cast("long").alias("m"), F.lit(None).cast(sums.schema["first"].dataType).alias("first"))
    upto = Window.partitionBy("hub").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = sums.select("hub", F.col("slack").alias("at"), F.lit(0).alias("kind"), "slack", "m", "first").unionByName(asked)
    met = both.select("hub", "kind", "slack", F.sum("m").over(upto).alias("met"), F.min("first").over(upto).alias("near")).where("kind = 1").drop("kind")
    links = F.col("met") - F.when(F.col("slack") <= 0, 1).otherwise(0)
    return members.join(met, ["hub", "slack"]).select("h", "h2", "near", links.alias("links"))


def _candidates(nodes: DataFrame, members: DataFrame, crowd: DataFrame, percent: int) -> DataFrame:
    """(u, v), u < v: pairs that may be similar and that _within does not count, by prefix, positional and length filters and the sketches.

    Sets of n words that are similar share one of their first n - ceil(t n) + 1 words in a common order, rarest first
    (prefix filter); the shorter has at least t times the words of the longer (length filter), and from the first word
    that they share enough must remain in both (positional filter). Pairs whose sketches differ in more bits than
    similar sets can differ in words go as well. Two lines of the crowd are compared by their longer sketches, and are
    met at the first word that they share only, so that a large group makes few rows beyond its links.
    """
    d = nodes.where("n > 0").select("h", "h2", "n", "b", "c", "p")
    ids, place = small(written(crowd.select("h", "h2"), "ids", hashes=True)), F.shiftleft(F.col("i").cast("long"), 32)
    size = F.col("n") * 2 + F.when(F.col("in_crowd"), 1).otherwise(0)  # narrow rows: this is the largest shuffle
    known = d.join(ids.withColumn("in_crowd", F.lit(True)), ["h", "h2"], "left")
    first = known.select("h", "b", "c", size.alias("m"), F.posexplode("p").alias("i", "s"))  # by a hash of the word: more candidates at worst
    alone = lambda k: F.col("x" + k).bitwiseAND(_long(1)) == 0
    b, c = (F.col(k + "x").bitwiseXOR(F.col(k + "y")) for k in "bc")
    apart = F.when(F.least(*_size().values()) > LONG, F.bit_count(b) + F.bit_count(c)).otherwise(F.bit_count(b.bitwiseXOR(c)))
    across = _met(first.select("s", "h", "b", "c", place.bitwiseOR(F.col("m").cast("long")).alias("x")), percent, apart, alone("x") | alone("y"))

    inner = d.join(ids, ["h", "h2"]).join(crowd, ["h", "h2"]).join(small(members), ["h", "h2"], "left").select("h", "n", "hub", "slack", "p", *[F.col("q")[k].alias(f"q{k}") for k in range(8)], F.posexplode("p").alias("i", "s"))
    inner = inner.select("s", "h", place.bitwiseOR(F.col("n").cast("long") * 2).alias("x"), "hub", "slack", *[f"q{k}" for k in range(8)], F.expr("slice(p, 1, i)").alias("ahead"))
    apart = sum((F.bit_count(F.col(f"q{k}x").bitwiseXOR(F.col(f"q{k}y"))) for k in range(1, 8)), F.bit_count(F.col("q0x").bitwiseXOR(F.col("q0y"))))
    counted = F.coalesce((F.col("hubx") == F.col("huby")) & (F.col("slackx") + F.col("slacky") <= 0), F.lit(False))
    within = _met(inner, percent, apart, ~counted & ~F.arrays_overlap("aheadx", "aheady"))
    return across.unionByName(within).distinct()


def _size() -> dict[str, Column]:
    return {k: F.shiftright(F.col("x" + k), 1).bitwiseAND(_long((1 << 31) - 1)) for k in "xy"}


def _met(rows: DataFrame, percent: int, apart: Column, also: Column) -> DataFrame:
    """(u, v): rows (s, h, x, ...) that share s and pass the filters; x holds the place of s above 32 bits, and twice the number of words. apart: at least so many words are in one of two lines alone."""
    x, y = (rows.select("s", *[F.col(c).alias(c + k) for c in rows.columns[1:]]) for k in "xy")
    n = _size()
    left = {k: n[k] - F.shiftright(F.col("x" + k), 32) for k in "xy"}
    total = n["x"] + n["y"]
    fits = (100 * F.least(*n.values()) >= percent * F.greatest(*n.values())) & ((100 + percent) * F.least(*left.values()) >= percent * total)
    near = (100 + percent) * apart <= (100 - percent) * total
    return x.join(y, "s").where((F.col("hx") < F.col("hy")) & fits & near & also).select(F.col("hx").alias("u"), F.col("hy").alias("v"))


def _judged(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every line (doc_id, r1, r2, line_no, h1, h2), and for lines that match others (h1, h2, best, links): the place of the earliest match, and how many different lines match."""
    lines = written(_lines(docs), "lines", hashes=True)
    n = F.size("words")
    ranks = rarity(lines)
    some = lines.withColumn("ranks", ranks.scalar())  # as a column of its own, as a subquery can't be written in a lambda; the optimizer puts it there
    some = some.select(*lines.columns, n.alias("n"), _ordered(F.col("words"), F.col("ranks")).alias("s")).select("*", F.slice("s", 1, (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0) - 1e-9) + 1).cast("int")).alias("first"))
    bits = _halves()
    prefix = F.transform("first", lambda w: F.hash(w))
    rare = F.sort_array(F.transform(F.slice("s", 1, F.floor((F.col("n") + 1) / 2).cast("int")), lambda w: F.hash(w)))
    some = some.withColumn("rare", rare)
    low = [F.get("rare", F.lit(i)) for i in range(3)]
    top = [F.get("rare", F.size("rare") - i) for i in (1, 2, 3)]
    keys = F.array(F.xxhash64(*low[:2]), F.xxhash64(*low[1:]), F.xxhash64(*top[:2]), F.xxhash64(*top[1:]))
    parts = F.struct("n", bits[0].alias("b"), bits[1].alias("c"), keys.alias("keys"), prefix.alias("p"))
    nodes = some.select("h1", "h2", _place().alias("place"), parts.alias("x")).groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("copies"), F.first("x").alias("x"))
    nodes = written(nodes.select(F.col("h1").alias("h"), "h2", "first", (F.col("first") != F.col("last")).alias("again"), "copies", "x.*"), "nodes", hashes=True)

    groups, crowd = _groups(nodes, lines, percent)
    wide, lines = lines, written(lines.select("doc_id", "r1", "r2", "line_no", "h1", "h2"), "lines", hashes=True)
    drop(wide)  # the hashes of words, the larger part of it, have done
    while True:
        members = written(_members(groups, percent), "members")
        pairs = written(_candidates(nodes, members, crowd, percent), "pairs")
        ends = [groups.select("u"), groups.select("v"), pairs.select("u"), pairs.select("v")]
        named = ends[0].union(ends[1]).union(ends[2]).union(ends[3]).toDF("h").distinct()
        places = written(nodes.select("h", "h2", "first").join(small(written(named, "named")), "h", "left_semi"), "places")
        texts = _texts(docs, places)
        sets = written(texts.select("h", "h2", F.array_distinct(_words(F.col("line"))).alias("s")), "sets", "zstd")
        wrong = _measured(groups.drop("u2", "v2", "nv"), sets).where(~_similar(percent) | (_slack(percent, "nu") != F.col("slack"))).select("u")
        wrong = written(wrong, "wrong")
        if wrong.isEmpty():
            break
        groups = written(groups.join(wrong, "u", "left_anti"), "groups")  # two words with one hash: rare, and then these lines are no members
    links = _measured(pairs, sets).where(_similar(percent))
    links = written(links.select("u", "u2", "v", "v2"), "links")
    for x in (pairs, sets, groups, crowd):
        drop(x)

    both = links.unionByName(links.select(*[F.col(a).alias(b) for a, b in (("u", "v"), ("u2", "v2"), ("v", "u"), ("v2", "u2"))]))
    ends = both.join(places.select(F.col("h").alias("v"), F.col("h2").alias("v2"), "first"), ["v", "v2"])
    across = ends.groupBy(F.col("u").alias("h"), F.col("u2").alias("h2")).agg(F.min("first").alias("near"), F.count("*").alias("links"))
    own = places.unionByName(nodes.where("again").select("h", "h2", "first")).select("h", "h2", F.col("first").alias("near"), _long(0).alias("links"))
    best = across.unionByName(_within(places, members)).unionByName(own).groupBy(F.col("h").alias("h1"), "h2").agg(F.min("near").alias("best"), F.sum("links").alias("links"))
    best = written(best, "best")
    for x in (links, members, nodes):
        drop(x)
    return lines, best


def _removed(docs: DataFrame, percent: int) -> DataFrame:
    lines, best = _judged(docs, percent)
    matched = lines.join(best, ["h1", "h2"])
    line = F.struct("line_no", (F.col("best") < _place()).alias("removed"), "links", F.col("best.doc_id").alias("class_id"))
    by = ["doc_id", "r1", "r2"]
    found = matched.select(*by, line.alias("x")).groupBy(*by).agg(F.collect_set("x").alias("x"))  # a set: repeated rows give the same lines
    sizes = lines.groupBy(*by).agg((F.max("line_no") + 1).alias("n_lines"))
    rows = sizes.alias("a").join(found.alias("b"), (F.col("a.r1") == F.col("b.r1")) & (F.col("a.r2") == F.col("b.r2")), "left")
    x = F.coalesce("x", F.expr("cast(array() as array<struct<line_no: int, removed: boolean, links: bigint, class_id: bigint>>)"))
    rows = rows.select("a.doc_id", "a.r1", "a.r2", F.col("n_lines").cast("long").alias("n_lines"), x.alias("x"))
    gone = F.filter("x", lambda l: l["removed"])
    first = F.when(F.size("x") < F.col("n_lines"), F.coalesce("doc_id", _long(_LEAST)))  # lines that match no other are their own
    return rows.select(
        *by, "n_lines", F.size(gone).cast("long").alias("n_removed"), F.aggregate("x", _long(0), lambda n, l: n + l["links"]).alias("n_links"),
        F.nullif(F.least(F.array_min("x.class_id"), first), _long(_LEAST)).alias("class_id"), F.sort_array(F.transform(gone, lambda l: l["line_no"])).alias("removed"),
    )


def line_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document of docs (doc_id, text): doc_id, n_lines, n_removed, n_links, class_id, removed.

    Lines are split at newlines, and are sets of their words (runs of bytes other than 0x20 and 0x09-0x0D, unchanged).
    A line matches an equal line, and any whose word set has a Jaccard similarity of percent / 100 or more. It is
    removed if a line before it, by (doc_id, line), matches; a null doc_id comes first. Lines without words match
    equal lines only. n_links counts the different lines that the document's lines match, class_id is the smallest
    doc_id among their earliest matches (itself included; null stays null), removed lists the numbers of removed
    lines. Null texts are one empty line. Rows that share doc_id and text count as one document. An empty table gives
    an empty result; other columns, whatever their names, are not read.

    1. Every line becomes its words in a common order, rarest first, once; equal lines are one row from there on.
    2. Groups of near copies get a hub; links that follow from the distances to it are counted, not listed (_groups).
    3. All other pairs come from the prefix join (_candidates) and are verified on the words themselves.
    """
    return _removed(docs, percent).drop("r1", "r2")


def without_repeated_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, with the lines that line_dedup removes taken out of text."""
    own = free_name(docs)
    gone = _removed(docs, percent).where("n_removed > 0").select(F.struct("r1", "r2").alias(own), F.struct("removed").alias(own + "x"))
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    d = docs.withColumn(own, F.struct(F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(text, doc_id, F.lit(1)).alias("r2"))).join(gone, own, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col(own + "x.removed"), i)), "\n")
    return d.withColumn("text", F.when(F.col(own + "x").isNull(), F.col("text")).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
