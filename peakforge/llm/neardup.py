"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.llm import text as T
from peakforge.llm.components import components
from peakforge.llm.store import drop, free_name, narrow_batches, small, written

SHINGLE = 5
#: 16 bands of 4 ranks: a pair at a Jaccard similarity of 0.85 shares no band with a probability of 7e-6.
BANDS, ROWS = 16, 4
#: Members of a bucket up to which all its pairs between components are verified; larger ones go through the prefix join.
SMALL = 32
#: Bits of the parity sketch of a set: sets that differ in d shingles have sketches that differ in d bits at most.
BITS = 256
_U = np.uint64


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row as sorted 64-bit hashes, and the rows' bounds in them."""
    starts, ends, bounds = T.words(data, offs)
    h = T.word_hashes(data, starts, ends, lower=True)
    first, _ = T.window_starts(bounds, k)
    sizes = np.diff(bounds)
    few = np.flatnonzero((sizes > 0) & (sizes < k))
    begin = np.concatenate([first, bounds[few]])
    end = np.concatenate([first + k, bounds[few + 1]])
    s = T.spans(h, begin, end)
    row = np.searchsorted(bounds, begin, "right") - 1
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[new], row[new]
    return s, np.searchsorted(row, np.arange(len(offs)))


def superminhash(s: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (rows, m) of the sets s[bounds[i]:bounds[i+1]].

    Every element walks through a random permutation of the m slots and offers step + uniform to the slot it meets.
    Step j + 1 offers more than any value of step j, so a row stops as soon as all its slots hold less than that.
    """
    rows = len(bounds) - 1
    sig = np.full(rows * m, np.inf)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    perm = None
    for j in range(m):
        if not len(s):
            break
        r = T.mix(s + _U((2 * j + 1) * 0x9E6C63D0876A9A47 & (1 << 64) - 1))
        value = (r >> _U(11)).astype(np.float64) * 2.0**-53 + j
        k = (T.mix(r) % _U(m - j)).astype(np.int64) + j
        at = np.arange(len(s))
        if j == 0:
            slot = k
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(s), 1))
                perm[at, first], perm[:, 0] = 0, first
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(sig, row * m + slot, value)
        open_ = sig.reshape(rows, m).max(axis=1) >= j + 1
        stay = open_[row]
        s, row = s[stay], row[stay]
        if j == 0:
            first = k[stay]
        else:
            perm = perm[stay]
    return sig.reshape(rows, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    v = T.mix(sig.view(np.uint64)).reshape(len(sig), bands, rows)
    key = np.broadcast_to(T.mix(np.arange(bands, dtype=np.uint64)), (len(sig), bands)).copy()
    for i in range(rows):
        key = T.mix(key * _U(0xD6E8FEB86659FD93) + v[:, :, i])
    return key


_SKETCH = pa.schema([("doc_id", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("shingles", pa.list_(pa.int64())), *((f"b{i}", pa.int64()) for i in range(BITS // 64))])


_BITS = [f"b{i}" for i in range(BITS // 64)]


def _digests(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return T.spans(s, bounds[:-1], bounds[1:], 2), T.spans(s, bounds[:-1], bounds[1:], 3)


def parity(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(BITS / 64, rows) longs: each bit the parity of the shingles of a row that fall on it."""
    rows = len(bounds) - 1
    at = np.repeat(np.arange(rows) * BITS, np.diff(bounds)) + (s % _U(BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=rows * BITS) & 1).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(odd.reshape(rows, BITS), axis=1).view(np.int64).T)


def _fits(percent: int) -> Column:
    """Whether two sets, by their sizes nx and ny and their sketches, may be similar enough."""
    apart = sum((F.bit_count(F.col(f"b{i}x").bitwiseXOR(F.col(f"b{i}y"))) for i in range(BITS // 64)), F.lit(0))
    return (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & ((100 + percent) * apart <= (100 - percent) * (F.col("nx") + F.col("ny")))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offs in T.slices(b, "text"):
            s, bounds = shingles(data, offs)
            h1, h2 = _digests(s, bounds)
            full = np.flatnonzero(np.diff(bounds))
            keys = band_keys(superminhash(s, bounds, BANDS * ROWS)[full])
            at = np.zeros(hi - lo + 1, np.int32)
            at[full + 1] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(at, dtype=np.int32)), pa.array(T.signed(keys.reshape(-1))))
            yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(np.diff(bounds)), pa.array(T.signed(h1)), pa.array(T.signed(h2)), bands], schema=_SKETCH)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, data, offs in T.slices(b, "text"):
            s, bounds = shingles(data, offs)
            h1, h2 = _digests(s, bounds)
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(T.signed(s)))
            bits = parity(s, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(h1)), pa.array(T.signed(h2)), sets, *(pa.array(b) for b in bits)], schema=_SETS)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of pairs whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("s"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("t"))
    common = F.size(F.array_intersect("s", "t"))
    return pairs.join(b, "v").join(a, "u").where(100 * common >= percent * (F.size("s") + F.size("t") - common)).select("u", "v")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair of nodes (node, root) with different roots that can be similar enough: an exact prefix join.

    Sets are sorted by how many of these nodes hold a shingle, then by hash, an order that is the same for all. Two
    similar sets share one of their first n - ceil(t n) + 1 shingles, and at the first that they share enough must
    remain behind it in both; and their sketches differ in no more bits than similar sets can differ in shingles.
    A set with more shingles of its own than a similar one may lack has them in front, and so meets no other, however
    many share the rest with it.
    """
    n = F.size("shingles")
    need = F.ceil(n * percent / F.lit(100.0) - 1e-9)
    held = nodes.join(sets, "node").select("node", "root", n.alias("n"), (n - need + 1).cast("int").alias("k"), *_BITS, "shingles")
    each = held.select("node", F.explode("shingles").alias("s"))
    holders = each.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    shared = each.join(holders, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("shared"))
    own = F.col("n") - F.size("shared")  # shingles that no other set holds come first
    first = held.drop("shingles").join(shared, "node").select("node", "root", "n", *_BITS, own.alias("own"), F.posexplode(F.slice("shared", 1, F.greatest(F.col("k") - own, F.lit(0)))).alias("j", "x"))
    first = written(first.select("node", "root", "n", *_BITS, (F.col("own") + F.col("j")).alias("i"), "x.s"), "prefixes", hashes=True)
    x, y = (first.select(F.col("s"), *[F.col(c).alias(c + k) for c in ("node", "root", "n", "i", *_BITS)]) for k in "xy")
    left = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy"))
    return x.join(y, "s").where((F.col("nodex") < F.col("nodey")) & (F.col("rootx") != F.col("rooty")) & ((100 + percent) * left >= percent * (F.col("nx") + F.col("ny"))) & _fits(percent)).select(F.col("nodex").alias("u"), F.col("nodey").alias("v")).distinct()


def _placed(docs: DataFrame, percent: int) -> DataFrame:
    """One row per row of docs: doc_id, r1, r2 (128 bits of doc_id and text), n, root (its component), component (the smallest doc_id there); null without words."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), *_identity(), "text")
    with narrow_batches(docs.sparkSession):
        sketch = written(rows.mapInArrow(T.trimmed(_sketch), "doc_id long, r1 long, r2 long, n long, h1 long, h2 long, bands array<long>"), "sketch", hashes=True)
    classes = sketch.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.max("n").cast("int").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes", hashes=True)  # numbered once, when written
    member = classes.select("node", "n", F.explode("bands").alias("key"))
    sizes = member.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    central = member.join(sizes, "key").groupBy("node").agg(F.sum("m").alias("c"), F.first("n").alias("n"))
    member = written(member.select("node", "key").join(sizes.select("key"), "key").join(central, "node"), "members", hashes=True)
    hub = member.groupBy("key").agg(F.max(F.struct("c", "node", "n")).alias("hub"))
    fits = 100 * F.least("n", F.col("hub.n")) >= percent * F.greatest("n", F.col("hub.n"))
    pairs = member.join(hub, "key").where(fits & (F.col("node") != F.col("hub.node"))).select(F.col("hub.node").alias("u"), F.col("node").alias("v")).distinct()

    wanted = classes.select("node", "h1", "h2", "doc").join(member.select("node").distinct(), "node", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(written(wanted.select(F.col("doc").alias("doc_id")).distinct(), "wanted")), "doc_id", "left_semi")
    if not wanted.where("doc is null").isEmpty():
        texts = texts.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is null"))
    found = texts.select("text").mapInArrow(T.trimmed(_sets), "h1 long, h2 long, shingles array<long>, " + ", ".join(f"{b} long" for b in _BITS))
    sets = written(found.join(wanted, ["h1", "h2"]).select("node", "shingles", *_BITS).dropDuplicates(["node"]), "sets", hashes=True)
    links = written(_verified(pairs, sets, percent), "links")
    root = components(links)

    state = member.join(root, "node", "left").select("node", "n", "key", F.coalesce("root", "node").alias("root"))
    mixed = state.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m")
    rest = written(state.join(mixed, "key").join(sets.select("node", *_BITS), "node"), "rest", hashes=True)
    x, y = (rest.where(f"m <= {SMALL}").select("key", *[F.col(c).alias(c + k) for c in ("node", "root", "n", *_BITS)]) for k in "xy")
    pairs = x.join(y, "key").where((F.col("nodex") < F.col("nodey")) & (F.col("rootx") != F.col("rooty")) & _fits(percent)).select(F.col("nodex").alias("u"), F.col("nodey").alias("v"))
    large = rest.where(f"m > {SMALL}").select("node", "root").distinct()
    more = _verified(pairs.unionByName(_prefix_pairs(large, sets, percent)).distinct(), sets, percent)
    links = written(links.unionByName(more), "links")
    drop(sets)
    drop(rest)
    root = components(links)
    drop(member)

    placed = classes.join(root, "node", "left").select("h1", "h2", "doc", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc").alias("component"))
    placed = written(placed.join(least, "root").select("h1", "h2", "root", "component"), "placed", hashes=True)
    drop(classes)
    rows = sketch.select("doc_id", "r1", "r2", "n", "h1", "h2")
    empty = rows.where("n = 0").select("doc_id", "r1", "r2", "n", F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("component"))
    return rows.where("n > 0").join(placed, ["h1", "h2"]).drop("h1", "h2").unionByName(empty)


def _identity() -> list[Column]:
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    return [F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(text, doc_id, F.lit(1)).alias("r2")]


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts with A-Z lower-cased are sets of distinct 5-word shingles; a text of fewer words is one shingle, a text
    without words (or null) is empty and linked with nothing. Two documents are linked when
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable, kept is doc_id = component_id.

    1. Sketch: SuperMinHash bands and a 128-bit digest of the set. Equal sets form a class; only classes go on.
    2. In each bucket of a band the most central class (the one with the largest buckets) is verified against the
       others, so a group of m copies costs m checks. Links are joined by union-find.
    3. Of buckets that still hold several components, small ones have all pairs between components verified; the
       members of larger ones go through an exact prefix join of their full sets. No link between components is lost.

    Rows that share a doc_id but not the text are documents of their own, linked only by their texts. A null doc_id
    never is a component_id; such rows are kept unless linked with a row that has one. Columns other than doc_id and
    text are not read, whatever their names. An empty table gives an empty result.
    """
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return _placed(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def first_documents(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs, all columns unchanged, one of each component: of those with the smallest doc_id the one with the smallest hash.

    Rows without words stay. Rows equal in doc_id and text count once. Without any doc_id in a component one row of it stays.
    """
    rows = _placed(docs, percent).groupBy("doc_id", "r1", "r2", "n", "root").agg(F.count("*").alias("m"))
    rows = written(rows, "rows", hashes=True)
    linked = rows.where("n > 0")
    first = linked.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "r1", "r2")).alias("at")).select("root", "at.r1", "at.r2")
    own = free_name(docs)
    row = lambda some: small(written(some.select(F.struct("r1", "r2").alias(own)), "some", hashes=True))
    d = docs.withColumn(own, F.struct(*_identity()))
    kept = d.join(row(linked.join(first, ["root", "r1", "r2"], "left_anti")), own, "left_anti")
    again = rows.where("m > 1")
    if not again.isEmpty():
        again = row(again)
        kept = kept.join(again, own, "left_anti").unionByName(kept.join(again, own, "left_semi").dropDuplicates([own]))
    return kept.drop(own)
