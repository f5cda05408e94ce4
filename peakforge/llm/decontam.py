"""Benchmark decontamination: template windows of benchmark items found in documents, with consistent slots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakforge.llm import text as T
from peakforge.llm.store import narrow_batches, written

#: Words in a window, and the fewest of them that are no slots where the window counts without a neighbour; an item
#: with fewer than LEAST words is found as it is only.
WINDOW, LITERAL, LEAST = 8, 4, 4
#: A document holds an item if it holds this share of its windows, or this many of its words in a row, however long it is.
COVER, RUN = 0.5, 13
#: Bits of the filter that all executors get: 1 MB however large the benchmark is. Beyond that it lets more through
#: to the join, which decides.
FILTER_BITS = 23
# fixed values: words that count as units of measurement wherever they are; others do right after a number, as one of two readings
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms tonne tonnes pound pounds ounce ounces "
    "ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars cent cents euro euros volt volts watt watts joule joules newton newtons hertz meter meters metre metres"
).split()

_U = np.uint64
_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;\"")] = True
NUMBER, UNIT, NAME = _U(1), _U(2), _U(3)


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    s, e, _ = T.words(data, np.array([0, len(data)]))
    return np.sort(T.word_hashes(data, s, e))


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words that have a letter or digit: hash of the bare lower-case word, kind of slot (0 for none), whether it
    may be a name as well (capitalised, seen at the beginning of sentences only), whether it may be a unit as well
    (right after a number, with no sign between), whether it may go on a name that ends right before it; rows' bounds.

    A word with a digit is a number, a word of UNITS a unit, a capitalised word a name
    if it, or the same word elsewhere in the text, begins no sentence.
    """
    low = T.LOWER[data]
    if len(data) > 1:  # capitals of Latin-1 in UTF-8
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[wide] += 32
    capital = low != data
    keep = _WORDY[data]
    starts, ends, bounds = T.words(data, offs)
    count = np.concatenate([[0], np.cumsum(keep)])
    bare_start, bare_end = count[starts], count[ends]
    some = bare_end > bare_start
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = digits[ends] > digits[starts]
    opens, joins = np.ones(len(starts), bool), np.zeros(len(starts), bool)
    if len(starts) > 1:
        opens[1:] = _END[data[ends[:-1] - 1]]
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        opens[1:] |= lines[starts[1:]] > lines[starts[:-1]]
        joins[1:] = _WORDY[data[ends[:-1] - 1]]
    opens[bounds[:-1][bounds[:-1] < len(starts)]] = True
    caps = np.concatenate([[0], np.cumsum(capital)])
    letter = caps[np.minimum(starts + 2, ends)] > caps[starts]
    bounds = np.concatenate([[0], np.cumsum(some)])[bounds]
    bare = low[keep]
    h = T.word_hashes(bare, bare_start[some], bare_end[some])
    number, name, first = number[some], (letter & ~opens)[some], (letter & opens)[some]
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.uint64), np.diff(bounds))
    own = T.mix(h ^ T.mix(row))
    name |= first & np.isin(own, own[name])
    at = np.minimum(np.searchsorted(_UNIT_HASHES, h), len(_UNIT_HASHES) - 1)
    unit = _UNIT_HASHES[at] == h
    kind = np.select([number, unit, name], [NUMBER, UNIT, NAME], _U(0))
    joins = (joins & ~opens)[some]
    measure = joins & ((kind == 0) | (kind == NAME))
    measure[1:] &= kind[:-1] == NUMBER
    return h, kind, first & (kind == 0), measure, joins, bounds


_UNIT_HASHES = _unit_hashes()


def _windows(h: np.ndarray, first: np.ndarray, k: int, templated: bool) -> np.ndarray:
    return T.spans(h, first, first + k, 11 if templated else 12)


def _template(h: np.ndarray, kind: np.ndarray, joins: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all places, a run of adjacent names being one: template hash, hash of the slot's words (0 for no slot), first word; rows' bounds."""
    more = joins & (kind == NAME)
    more[1:] &= kind[:-1] == NAME
    start = np.flatnonzero(~more)
    end = np.append(start[1:], len(h)).astype(np.int64)
    value = h[start]
    long = end - start > 1
    value[long] = T.spans(h, start[long], end[long], 13)
    slot = kind[start] > 0
    return np.where(slot, kind[start], value), np.where(slot, value, _U(0)), start, np.searchsorted(start, bounds)


def _readings(kind: np.ndarray, maybe: np.ndarray, measure: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Kinds with the doubtful words taken as they are, all as names, and each alone as a name, with the words that alone have changed; then all of it with words after numbers as units."""
    at = np.flatnonzero(maybe)
    unit = np.flatnonzero(measure)
    for base in [kind, np.where(measure, UNIT, kind)] if len(unit) else [kind]:
        yield base, None if base is kind else unit
        if len(at):
            yield np.where(maybe, NAME, base), None if base is kind else unit
        for i in at if len(at) > 1 else []:
            one = base.copy()
            one[i] = NAME
            yield one, at[at == i]


def _item_templates(h: np.ndarray, kind: np.ndarray, maybe: np.ndarray, measure: np.ndarray, joins: np.ndarray) -> Iterator[tuple]:
    """Template windows of an item: key, place, first window of words it stands for, how many, size, grade, hashes of the slots' words.

    Grade 1: LITERAL words are no slots and no doubtful word is a name or unit. 2: others that count alone. 3: windows with
    more slots, which count beside another only. Windows of slots alone match any row of numbers; they are left out.
    """
    seen = set()
    for n, (reading, changed) in enumerate(_readings(kind, maybe, measure)):
        t, value, start, bounds = _template(h, reading, joins, np.array([0, len(h)]))
        m = len(t)
        k = min(m, WINDOW)
        first = np.arange(m - k + 1)
        ends = np.append(start, len(h))
        keys = _windows(t, first, k, True)
        if changed is not None:  # windows without these words are those of another reading
            place = np.searchsorted(start, changed, "right") - 1
            near = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=m) > 0)])
            first = first[near[first + k] > near[first]]
        for j in first:
            own = value[j : j + k]
            left = k - int((own > 0).sum())
            key, at = int(keys[j].astype(np.int64)), int(start[j])
            if left in (0, k) or (key, at) in seen:
                continue
            seen.add((key, at))
            enough = left >= min(LITERAL, k - 1)
            if not enough and m == k and k < WINDOW:
                continue
            alone = enough or (m == k and left > 1)
            windows = int(ends[j + k]) - at - min(len(h), WINDOW) + 1
            yield key, int(j), at, windows, k, (1 if n == 0 else 2) if enough else 2 if alone else 3, own.view(np.int64).tolist()


def _bench_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item's windows: key, place among the windows of its kind, window of words, how many of them it stands for, all of these, size, grade (0 for words as they are), slots."""
    names = ["key", "item_id", "pos", "at", "windows", "total", "k", "grade", "slots"]
    for b in batches:
        for lo, hi, data, offs in T.slices(b, "text"):
            h, kind, maybe, measure, joins, bounds = tokens(data, offs)
            ids = b.column(0).slice(lo, hi - lo).to_pylist()
            rows = []
            for i in range(hi - lo):
                own = slice(bounds[i], bounds[i + 1])
                n = int(bounds[i + 1] - bounds[i])
                if not n:
                    continue
                k = min(n, WINDOW)
                first = np.arange(n - k + 1)
                rows += [(int(key), ids[i], j, j, 1, len(first), k, 0, []) for j, key in enumerate(_windows(h[own], first, k, False).view(np.int64))]
                if n >= LEAST:
                    rows += [(key, ids[i], j, at, w, len(first), size, grade, slots) for key, j, at, w, size, grade, slots in _item_templates(h[own], kind[own], maybe[own], measure[own], joins[own])]
            types = [*[pa.int64()] * 8, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)


def _probe(bits, lengths: list[int]) -> Callable:
    names = ["doc_id", "row_key", "key", "pos", "templated", "slots"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits.value, bitorder="little").view(bool)
        shift = _U(64 - FILTER_BITS)
        for b in batches:
            for lo, hi, data, offs in T.slices(b, "text"):
                h, kind, maybe, measure, joins, bounds = tokens(data, offs)
                doubts = [np.concatenate([[0], np.cumsum(x)]) for x in (maybe, measure)]
                ways = [(False, (h, None, None, bounds), [])]
                for unit in (False, True) if measure.any() else (False,):
                    own = np.where(measure, UNIT, kind) if unit else kind
                    for name in (False, True):
                        changed = [d for d, x in zip(doubts, (name, unit), strict=True) if x]
                        ways.append((True, _template(h, np.where(maybe, NAME, own) if name else own, joins, bounds), changed))
                out = []
                for k in lengths:
                    for templated, (of, value, start, rows), changed in ways:
                        first, _ = T.window_starts(rows, k)
                        key = _windows(of, first, k, templated)
                        hit = table[key >> shift]
                        at, key = first[hit], key[hit]
                        slots = [[]] * len(at)
                        if templated:
                            own = value[at[:, None] + np.arange(k)]
                            ok = own.any(axis=1)
                            for doubt in changed:  # windows without doubtful words are those of another reading
                                ok &= doubt[np.append(start, len(h))[at + k]] > doubt[start[at]]
                            at, key = at[ok], key[ok]
                            slots = own[ok].view(np.int64).tolist()
                        row = np.searchsorted(rows, at, "right") - 1
                        out.append((row, key, at - rows[row], templated, slots))
                row = np.concatenate([x[0] for x in out])
                cols = [b.column(0).slice(lo, hi - lo).take(pa.array(row)), b.column(1).slice(lo, hi - lo).take(pa.array(row)), pa.array(np.concatenate([x[1] for x in out]).view(np.int64)), pa.array(np.concatenate([x[2] for x in out]))]
                cols += [pa.array(np.concatenate([np.full(len(x[0]), x[3]) for x in out])), pa.array([s for x in out for s in x[4]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return f


def _filter(index: DataFrame) -> np.ndarray:
    """One bit for each window key's first FILTER_BITS bits; the driver gets at most 2**(FILTER_BITS - 5) words."""
    place = index.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("p"))
    words = place.selectExpr("p div 32 w", "shiftleft(1L, cast(p % 32 as int)) b").groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toArrow()
    bits = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    bits[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint32)
    return bits.view(np.uint8)


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """Pairs (doc_id, item_id) where a document of docs (doc_id, text) holds an item of benchmark (item_id, text).

    Also: row_key (xxhash64 of the text, for joins back), n_windows of the item found, n_item_windows, and whether some
    were found as templates only. Words lose case and signs. Windows of WINDOW words are compared as they are, and as
    templates with numbers, units and names replaced by typed placeholders. Templates found at one shift of the item
    count only if each of its slot values stands for one value of the document throughout; where few words are no
    slots, also only beside another one. Adjacent names are one slot; a capitalised word that only begins sentences is
    tried as a word and as a name, a word right after a number as a word and as a unit, whatever it is. A pair is returned if at
    least `cover` of the item's windows are found, or RUN words of it in a row at one shift. Items of fewer than LEAST
    words are compared as they are. Items and texts that are null or have no words, empty tables and documents without
    items give no rows; rows that share doc_id and text count once; ties don't arise.

    Documents are read once and filtered against a bit table of fixed size; what passes is joined by window key.
    """
    index = written(benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(T.trimmed(_bench_rows), "key long, item_id long, pos long, at long, windows long, total long, k long, grade long, slots array<long>"), "benchmark")
    lengths = sorted(r["k"] for r in index.select("k").distinct().collect())
    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc_id long, row_key long, item_id long, n_windows long, n_item_windows long, templated boolean")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(index))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_key"), "text")
    found = rows.mapInArrow(T.trimmed(_probe(shared, lengths)), "doc_id long, row_key long, key long, pos long, templated boolean, slots array<long>")
    on = F.expr("d.key = b.key and d.templated = (b.grade > 0)")
    with narrow_batches(docs.sparkSession):
        hits = written(found.alias("d").join(index.alias("b"), on).select("doc_id", "row_key", "item_id", "b.pos", "at", "windows", (F.col("d.pos") - F.col("b.pos")).alias("shift"), "total", "grade", "templated", F.col("d.slots").alias("theirs"), F.col("b.slots").alias("ours")), "hits")
    place = ["doc_id", "row_key", "item_id", "shift"]
    slots = hits.where("templated").select(*place, "grade", F.explode(F.arrays_zip("ours", "theirs")).alias("s")).where("s.ours <> 0")
    # the surer windows of a shift don't fall with the others
    least = lambda x, grade: F.min(F.when(F.col("grade") <= grade, x))
    most = lambda x, grade: F.max(F.when(F.col("grade") <= grade, x))
    clash = lambda grade: least(F.col("s.theirs"), grade) != most(F.col("s.theirs"), grade)
    worst = F.coalesce(*[F.when(clash(g), F.lit(g)) for g in (1, 2, 3)])
    mixed = slots.groupBy(*place, F.col("s.ours")).agg(worst.alias("from")).groupBy(*place).agg(F.min("from").alias("from")).where("from is not null")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.expr("a.row_key = b.row_key and a.item_id <=> b.item_id and a.shift = b.shift and a.grade >= b.from") & F.col("a.templated")
    fine = hits.drop("ours", "theirs").alias("a").join(mixed.alias("b"), on, "left_anti")
    by = Window.partitionBy(*place, "templated").orderBy("pos")
    beside = F.count("*").over(by.rangeBetween(-1, 1)) > F.count("*").over(by.rangeBetween(0, 0))
    fine = fine.withColumn("beside", beside).where("grade < 3 or beside").withColumn("at", F.explode(F.sequence("at", F.col("at") + F.col("windows") - 1)))
    per = fine.groupBy("doc_id", "row_key", "item_id", "at", "total").agg(F.min("templated").alias("templated"))
    # windows of a run have one difference of place and rank
    spots = fine.where(F.col("total") > RUN - WINDOW).select(*place, "at").distinct()
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("at"))
    runs = spots.withColumn("run", F.col("at") - rank).groupBy(*place, "run").count().where(F.col("count") > RUN - WINDOW)
    held = runs.select("doc_id", "row_key", "item_id").distinct().withColumn("held", F.lit(True))
    out = per.groupBy("doc_id", "row_key", "item_id").agg(F.count("*").alias("n_windows"), F.max("total").alias("n_item_windows"), F.max("templated").alias("templated"))
    same = F.expr("o.doc_id <=> r.doc_id and o.row_key = r.row_key and o.item_id <=> r.item_id")
    return out.alias("o").join(held.alias("r"), same, "left").where((F.col("n_windows") >= F.col("n_item_windows") * cover) | F.col("held")).select("o.*")


def without_items(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """The rows of docs that hold no item of benchmark, all columns unchanged."""
    bad = written(contaminated(docs, benchmark, cover).select("doc_id", "row_key").distinct(), "contaminated").alias("b")
    d = docs.alias("d")
    return d.join(bad, F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.row_key")), "left_anti")
