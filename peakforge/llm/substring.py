"""Substring dedup: documents are factored against an index of all documents; what long factors cover is repeated.

Relative Lempel-Ziv over words, as a dataflow. The index holds anchors: in each window of WINDOW words the 8-word sequence
with the smallest hash, so equal windows have equal anchors, about one in 14 words. An anchor's run is the row of windows
that share it. The index lies in hash blocks; every document's anchors meet every block's references there:

- anchors that occur once end a factor;
- an anchor whose runs are equal everywhere, or a run that occurs again, extends a factor of its reference;
- other runs lie at factor boundaries: their windows are compared one by one.

Factors with the same reference and shift are then joined greedily in each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm import text as T
from peakforge.llm.store import drop, written

WINDOW, GRAM = 35, 8


def anchors(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: its anchor's place, hash, and its first and last window (indices into the words h)."""
    first, _ = T.window_starts(bounds, WINDOW)
    if not len(first):
        return first, np.zeros(0, np.uint64), first, first
    at = np.arange(len(h) - GRAM + 1)
    g = T.spans(h, at, at + GRAM, 21)

    def lesser(x: np.ndarray, shift: int) -> np.ndarray:
        a, b = x[:-shift], x[shift:]
        return np.where(g[a] <= g[b], a, b)

    least, size, span = at, 1, WINDOW - GRAM + 1
    while 2 * size <= span:
        least, size = lesser(least, size), 2 * size
    if span > size:
        least = lesser(least, span - size)
    place = least[first]
    new = np.ones(len(first), bool)
    new[1:] = (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(first)) - 1
    return place[begin], g[place[begin]], first[begin], first[last]


def _runs(data: np.ndarray, offs: np.ndarray):
    starts, ends, bounds = T.words(data, offs)
    h = T.word_hashes(data, starts, ends)
    return h, bounds, *anchors(h, bounds)


_INDEX = ["a", "c", "row_key", "lo", "size"]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = b.column(0).to_numpy()
        for lo, _, data, offs in T.slices(b, "text"):
            h, bounds, place, a, first, last = _runs(data, offs)
            c = T.mix(T.spans(h, first, last + WINDOW, 22) + (place - first).astype(np.uint64))
            row = np.searchsorted(bounds, first, "right") - 1
            cols = [T.signed(a), T.signed(c), keys[lo + row], (first - bounds[row]).astype(np.int32), (last - first + 1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=_INDEX)


_WINDOWS = ["a", "w", "row_key", "lo", "single"]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the runs at factor boundaries that a document holds, each window: anchor, hash, place."""
    for b in batches:
        keys = b.column(0).to_numpy()
        for lo, hi, data, offs in T.slices(b, "text"):
            starts, ends, bounds = T.words(data, offs)
            h = T.word_hashes(data, starts, ends)
            runs = [(bounds[i], r["a"], r["lo"], r["size"], r["single"], keys[lo + i]) for i, rs in enumerate(b.column(2).slice(lo, hi - lo).to_pylist()) for r in rs]
            if not runs:
                continue
            base, a, begin, size, single, key = (np.array(x) for x in zip(*runs, strict=True))
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            place = np.repeat(begin, size) + step
            at = np.repeat(base, size) + place
            cols = [np.repeat(a, size), T.signed(T.spans(h, at, at + WINDOW, 23)), np.repeat(key, size), place.astype(np.int32), np.repeat(single, size)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=_WINDOWS)


def factors(docs: DataFrame) -> DataFrame:
    """Rows (row_key, lo, size, ref_key, ref_lo): runs of `size` windows from word lo that also start elsewhere.

    docs has (row_key, text); the reference is the least (row_key, lo) that holds the same words. Every occurrence has
    rows, the reference too.
    """
    index = written(docs.mapInArrow(T.trimmed(_index), "a long, c long, row_key long, lo int, size int"), "anchors")
    here = F.struct("row_key", "lo")
    per = index.groupBy("a").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed"), F.min(here).alias("ref")).where("n > 1").drop("n")
    found = written(index.join(per, "a"), "found")
    drop(index)
    same = found.where("not mixed").select("row_key", "lo", "size", "ref")
    mixed = found.where("mixed")
    # each different run once, with how often it occurs
    runs = written(mixed.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "lo", "size")).alias("r")), "runs")
    again = mixed.join(runs.where("n > 1").select("a", "c", F.struct("r.row_key", "r.lo").alias("own")), ["a", "c"]).select("row_key", "lo", "size", F.col("own").alias("ref"))
    edge = runs.where("n = 1").select("a").distinct()
    check = runs.join(edge, "a", "left_semi").select(F.col("r.row_key").alias("row_key"), F.struct("a", "r.lo", "r.size", (F.col("n") == 1).alias("single")).alias("run"))
    check = check.groupBy("row_key").agg(F.collect_list("run").alias("runs"))
    windows = written(docs.join(check, "row_key").select("row_key", "text", "runs").mapInArrow(T.trimmed(_windows), "a long, w long, row_key long, lo int, single boolean"), "windows")
    twice = windows.groupBy("a", "w").agg(F.count("*").alias("n"), F.min(here).alias("ref")).where("n > 1").drop("n")
    edges = windows.where("single").join(twice, ["a", "w"]).select("row_key", "lo", F.lit(1).alias("size"), "ref")
    return same.unionByName(again).unionByName(edges).select("row_key", "lo", "size", F.col("ref.row_key").alias("ref_key"), F.col("ref.lo").alias("ref_lo"))


def greedy(runs: list[dict]) -> list[tuple[int, int, int, int]]:
    """Joined factors (first word, words, reference, its first word): a run extends the factor before it if the shift holds."""
    out: list[tuple[int, int, int, int]] = []
    for r in sorted(runs, key=lambda r: (r["lo"], -r["size"])):
        lo, end = r["lo"], r["lo"] + r["size"] - 1 + WINDOW
        if out:
            begin, size, key, ref = out[-1]
            if key == r["ref_key"] and ref - begin == r["ref_lo"] - lo and lo <= begin + size - WINDOW + 1:
                out[-1] = (begin, max(size, end - begin), key, ref)
                continue
        out.append((lo, end - lo, r["ref_key"], r["ref_lo"]))
    return out


_OUT = ["doc_id", "n_words", "n_removed", "text", "factors"]
_FACTOR = pa.struct([("start", pa.int64()), ("size", pa.int64()), ("ref_key", pa.int64()), ("ref_start", pa.int64())])


def _kept(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offs in T.slices(b, "text"):
            starts, ends, bounds = T.words(data, offs)
            cover = np.zeros(len(starts) + 1, np.int64)
            lists = []
            for i, runs in enumerate(b.column(2).slice(lo, hi - lo).to_pylist()):
                lists.append(greedy(runs or []))
                for f in lists[-1]:
                    cover[bounds[i] + f[0]] += 1
                    cover[bounds[i] + f[0] + f[1]] -= 1
            keep = np.cumsum(cover)[: len(starts)] == 0
            s, e = starts[keep], ends[keep]
            upto = np.concatenate([[0], np.cumsum(keep)])[bounds]
            mark = np.zeros(len(data) + 1, np.int8)
            np.add.at(mark, s, 1)
            np.add.at(mark, e, -1)
            inside = np.cumsum(mark[:-1]) > 0
            between = np.ones(len(s), bool)
            between[upto[1:][upto[1:] > upto[:-1]] - 1] = False
            out = data.copy()
            out[e[between]] = 32
            inside[e[between]] = True
            at = np.concatenate([[0], np.cumsum(inside)])[offs].tolist()
            text = memoryview(out[inside].tobytes())
            kept = [bytes(text[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
            n = np.diff(bounds)
            cols = [b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(n - np.diff(upto))]
            if digest:
                yield pa.RecordBatch.from_arrays([*cols, pa.array([hashlib.sha256(x).hexdigest() for x in kept])], names=[*_OUT[:3], "kept_sha256"])
            else:
                rows = [[dict(zip(("start", "size", "ref_key", "ref_start"), f, strict=True)) for f in fs] for fs in lists]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x.decode() for x in kept]), pa.array(rows, pa.list_(_FACTOR))], names=_OUT)


def _located(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    spans = factors(rows.select("row_key", "text")).groupBy("row_key").agg(F.collect_list(F.struct("lo", "size", "ref_key", "ref_lo")).alias("runs"))
    return rows.join(spans, "row_key", "left").select("doc_id", "text", "runs")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, text (what is kept), factors.

    A word is removed if a window of WINDOW consecutive words covers it whose words also start anywhere else, in the
    same document or another; all windows are judged on the input, so every copy goes. Words are runs of bytes other
    than 0x20 and 0x09-0x0D, compared unchanged by two 64-bit hashes; kept words are joined by one space. Null and
    empty texts have no words. Rows are told apart by a 64-bit hash of doc_id and text: repeated rows hold each
    other's windows, so of texts as long as a window nothing remains. factors lists (start, size, ref_key, ref_start).
    """
    schema = "doc_id long, n_words long, n_removed long, text string, factors array<struct<start:long, size:long, ref_key:long, ref_start:long>>"
    return _located(docs).mapInArrow(T.trimmed(lambda it: _kept(it, False)), schema)


def repeated_digests(docs: DataFrame) -> DataFrame:
    """As repeated_passages, with the SHA-256 of the kept words in place of text and factors."""
    return _located(docs).mapInArrow(T.trimmed(lambda it: _kept(it, True)), "doc_id long, n_words long, n_removed long, kept_sha256 string")
