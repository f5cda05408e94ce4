"""Quality classifier: histogram gradient-boosted trees over statistics of a text, flattened into arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm import text as T
from peakforge.llm.quality import statistics

#: At most so many labelled rows, those with the smallest hashes of their ids, are learnt from.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAF, RIDGE = 60, 4, 64, 0.15, 20, 1.0
FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits", "stops", "other_signs", "beyond_ascii",
    "distinct_words", "top_word", "distinct_shapes", "lines", "line_words", "longest_word",
)


def _classes() -> dict[str, np.ndarray]:
    out = {}
    for name, some in (("capitals", range(65, 91)), ("letters", [*range(65, 91), *range(97, 123)]), ("digits", range(48, 58)), ("stops", b".,;:!?'\"()-"), ("lead", range(0xC0, 256))):
        out[name] = np.zeros(256, bool)
        out[name][list(some)] = True
    out["other_signs"] = ~(out["letters"] | out["digits"] | out["stops"] | T.SPACE)
    out["other_signs"][128:] = False
    return out


_CLASSES = _classes()


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of each text; all 0 for an empty one. Labels, ids, languages and sources are not used."""
    s = statistics(data, offs)
    rows = len(offs) - 1
    starts, ends, bounds = T.words(data, offs)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    n, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    h = T.word_hashes(data, starts, ends, lower=True)
    order = np.lexsort((h, row))
    r, k = row[order], h[order]
    new = np.ones(len(k), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(k)))
    top = np.zeros(rows)
    np.maximum.at(top, r[at], times)
    length = ends - starts
    shape = np.unique(row * 64 + np.minimum(length, 63))
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    lines = count(data == 10) + 1
    cols = [
        np.log1p(s["n_words"]), s["word_chars"] / n, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / n,
        count(_CLASSES["capitals"][data]) / np.maximum(count(_CLASSES["letters"][data]), 1), *(count(_CLASSES[c][data]) / chars for c in ("digits", "stops", "other_signs", "lead")),
        np.bincount(r[at], minlength=rows) / n, top / n, np.bincount(shape // 64, minlength=rows) / np.sqrt(n), lines / n, s["n_words"] / lines, longest / 20,
    ]
    return np.where((s["n_words"] > 0)[:, None], np.stack(cols, axis=1), 0.0)


class Trees:
    """All trees in flat arrays: a node goes to left if its feature is at most its threshold, else to left + 1; a leaf to itself."""

    def __init__(self, base: float):
        self.base = base
        self.roots: list[int] = []
        self.feature, self.threshold, self.left, self.value = (np.zeros(0, t) for t in (np.int64, float, np.int64, float))

    def add(self, feature: list, threshold: list, left: list, value: list) -> None:
        at = len(self.feature)
        self.roots.append(at)
        self.feature = np.append(self.feature, np.array(feature, np.int64))
        self.threshold = np.append(self.threshold, threshold)
        self.left = np.append(self.left, np.array(left, np.int64) + at)
        self.value = np.append(self.value, value)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of x: every tree and row steps down at once."""
        if not self.roots:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.tile(np.array(self.roots), (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            leaf = self.feature[node] < 0
            right = x[row, np.maximum(self.feature[node], 0)] > self.threshold[node]
            node = np.where(leaf, node, self.left[node] + right)
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss. Splits are sought among BINS quantiles of each feature by histograms."""
    if not len(y) or y.min() == y.max():
        return Trees(0.0 if not len(y) else float(np.clip(2 * y[0] - 1, -1, 1)) * 5.0)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(prior / (1 - prior))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    width = x.shape[1] * BINS
    cell = bins + np.arange(x.shape[1]) * BINS
    margin = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold, left, value = [-1], [0.0], [0], [0.0]
        node = np.zeros(len(y), np.int64)
        level = [0]
        for depth in range(DEPTH + 1):
            local = np.full(len(feature), -1)
            local[level] = np.arange(len(level))
            of = local[node]
            inside = of >= 0
            key = (of[inside, None] * width + cell[inside]).reshape(-1)
            hist = [np.bincount(key, np.repeat(w[inside], x.shape[1]), minlength=len(level) * width).reshape(len(level), x.shape[1], BINS) for w in (grad, hess, np.ones(len(y)))]
            g, h, c = (np.cumsum(v, axis=2) for v in hist)
            total = [v[:, :1, -1:] for v in (g, h, c)]
            for i, k in enumerate(level):
                value[k] = -RATE * float(total[0][i, 0, 0] / (total[1][i, 0, 0] + RIDGE))
            if depth == DEPTH:
                break
            gain = g**2 / (h + RIDGE) + (total[0] - g) ** 2 / (total[1] - h + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
            gain[(c < LEAF) | (total[2] - c < LEAF)] = 0
            best = gain.reshape(len(level), -1).argmax(axis=1)
            below = []
            for i, k in enumerate(level):
                f, b = divmod(int(best[i]), BINS)
                if gain[i, f, b] <= 1e-6 or b >= len(edges[f]):
                    continue
                feature[k], threshold[k], left[k] = f, float(edges[f][b]), len(feature)
                feature += [-1, -1]
                threshold += [0.0, 0.0]
                left += [len(feature) - 2, len(feature) - 1]
                value += [0.0, 0.0]
                mine = node == k
                node[mine] = left[k] + (bins[mine, f] > b)
                below += [left[k], left[k] + 1]
            level = below
            if not level:
                break
        v = np.array(value)
        margin += v[node]
        model.add(feature, threshold, left, [0.0 if f >= 0 else x for f, x in zip(feature, value, strict=True)])
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offs in T.slices(b, "text"):
            x = features(data, offs)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), flat], names=["y", "key", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learn labels (doc_id, quality) of rows that are not held out, from at most `sample` documents and texts.

    A row that repeats another's id and text counts once; of an id with several texts each counts, within the sample.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so its broadcast has a bound
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("y", F.xxhash64("doc_id", "text").alias("key"), "text")
    each = rows.mapInArrow(_features, "y int, key long, x array<double>").groupBy("key").agg(F.first("y").alias("y"), F.first("x").alias("x"))
    got = each.orderBy("key").limit(sample).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got.column("y").to_pylist(), float)
    order = np.lexsort((*x.T, y))
    return train(x[order], y[order])


def _score(shared) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in T.slices(b, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(shared.value.score(features(data, offs)))], names=["doc_id", "held_out", "score"])

    return f


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    held_out: crc32 of the doc_id as text leaves 1 when divided by 3 (a null id is not); such labels are never read.
    score is the probability of label 1 given statistics of the whole text alone; predicted is 1 from 0.5 on. Null and
    empty texts have the score of all statistics at 0. Several labels of a document count as their smallest. Without
    labels every score is 0.5. Repeated rows give repeated rows; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(_score(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
