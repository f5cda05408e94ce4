"""Quality rules: surface statistics of a text, and perplexity bands under two modified Kneser-Ney models.

One is over characters, in classes: with 32 classes and order 4 it has at most 2**20 n-grams for a language
however large the corpus is, so it may be sent to all executors, while its counts are taken over every document.
Each value of lang that occurs, null too, has a model of its own. It tells what is not spelled like the language.
The other is over words and all their pairs (wordmodel.py). It tells what is not put together like other texts.
Each value of lang has a band of its own under both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from peakforge.llm import text as T
from peakforge.llm import wordmodel
from peakforge.llm.store import drop, narrow_batches, small, written

ORDER, BITS = 4, 5
SIZE = 1 << ORDER * BITS
#: Languages whose tables are in memory at a time: 8 MB each to count, 4 MB to score.
HELD = 8
#: Of fewer documents a language's own spread says little: it is at least that of all languages about their medians.
FEW = 30
#: A band reaches so many robust standard deviations of the log-perplexity below and above its language's median.
#: Text in two languages is hard to predict and clean, so the upper limit only catches what is not prose at all.
BELOW, ABOVE = 8.0, 45.0
#: The same of the log-perplexity per word, above only (texts with copies are easy to predict, and clean), but a text
#: stays that is at most WIDE above the median, as the spread of texts much alike says little.
WORDS_ABOVE, WIDE = 3.0, 1.0
#: Log-perplexities are counted in bins of these widths for the medians: per character, and per word.
BIN, WORD_BIN = 0.002, 0.01
SYMBOLS = b"#*$%&|<>"

_U = np.uint64
# 0 space, 1-26 letters (of scripts other than Latin by hash), 27 digit, 28 Latin letters and signs outside ASCII, 29 punctuation of prose, 30 other signs, 31 control
_CLASS = np.full(256, 30, np.uint8)
_CLASS[:32], _CLASS[127] = 31, 31
_CLASS[T.SPACE] = 0
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[48:58] = 27
_CLASS[128:] = 28
_CLASS[list(b".,;:!?'\"()-")] = 29
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of the n-gram that ends at each character (runs of space count as one), and the row of each."""
    keep = (data & 0xC0) != 0x80
    cls = _CLASS[data]
    gap = np.zeros(len(data), bool)
    gap[1:] = (cls[1:] == 0) & (cls[:-1] == 0)
    if len(data):
        gap[offs[offs < len(data)]] = False
    at = np.flatnonzero(keep & ~gap)
    row = np.searchsorted(offs, at, "right") - 1
    pad = np.zeros(len(at) + (ORDER - 1) * len(offs), np.int32)
    place = np.arange(len(at)) + (ORDER - 1) * (row + 1)
    pad[place] = _other_scripts(data, at, cls[at])
    code = np.zeros(len(at), np.int32)
    for i in range(ORDER):
        code |= pad[place - i] << BITS * i
    return code, row


def _other_scripts(data: np.ndarray, at: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """cls, with a letter's class by hash for characters of scripts other than Latin that begin at these bytes."""
    lead = data[at]
    second = data[np.minimum(at + 1, len(data) - 1)] if len(data) else lead
    latin = (lead < 0xCA) | ((lead == 0xE1) & (second >= 0xB8) & (second <= 0xBB))
    signs = ((lead == 0xE2) & (second < 0xB0)) | ((lead == 0xE3) & (second == 0x80)) | ((lead == 0xEF) & (second == 0xBC))
    other = np.flatnonzero(~latin & ~signs)
    if not len(other):
        return cls
    size = 2 + (lead[other] >= 0xE0).astype(np.int64) + (lead[other] >= 0xF0)
    char = np.zeros(len(other), np.uint64)
    for i in range(4):
        inside = (i < size) & (at[other] + i < len(data))
        char[inside] = (char[inside] << _U(8)) | data[at[other][inside] + i]
    cls[other] = 1 + T.mix(char) % _U(26)
    return cls


def languages(docs: DataFrame) -> list[str | None]:
    """The values of lang, null last."""
    return sorted((r["lang"] for r in docs.select("lang").distinct().collect()), key=lambda x: (x is None, x or ""))


def _indexer(known: list[str | None]) -> Callable:
    """f(column): index of each language; len(known) for one that is not known."""
    index = {x: k for k, x in enumerate(known)}
    return lambda col: np.array([index.get(x, len(known)) for x in col.to_pylist()], np.int64)


def _count(known: list[str | None]) -> Callable:
    def rows(total: dict) -> Iterator[pa.RecordBatch]:
        for k, n in total.items():
            at = np.flatnonzero(n)
            for i in range(0, len(at), 100_000):
                part = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(part.astype(np.int32)), pa.array(n[part])], names=["lang", "code", "n"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = _indexer(known), {}
        for b in batches:
            lang = index(b.column(b.schema.get_field_index("lang")))
            for lo, hi, data, offs in T.slices(b, "text"):
                code, row = codes(data, offs)
                of = lang[lo:hi][row]
                for k in np.unique(of):
                    if k not in total and len(total) == HELD:
                        yield from rows(total)
                        total = {}
                    if k not in total:
                        total[k] = np.zeros(SIZE, np.int64)
                    total[k] += np.bincount(code[of == k], minlength=SIZE)
        yield from rows(total)

    return f


def ngram_counts(docs: DataFrame, known: list[str | None]) -> DataFrame:
    """(lang, code, n) over every character of every document; lang is the place in known; at most SIZE rows for each language."""
    return docs.select("text", "lang").mapInArrow(T.trimmed(_count(known)), "lang int, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Model:
    """Interpolated modified Kneser-Ney probabilities: for each order the sorted hashes of its n-grams and their values."""

    def __init__(self, known: list[str | None], lang: np.ndarray, code: np.ndarray, n: np.ndarray):
        self.known, self.keys, self.p, self.back, self.characters = known, [], [], [], int(n.sum())
        raw = (lang.astype(np.int64) << ORDER * BITS) | code
        order = np.argsort(raw)
        raw, n = raw[order], n[order].astype(np.float64)
        levels = [(raw, n)]
        for o in range(ORDER - 1, 0, -1):  # an n-gram of a lower order counts the characters seen before it
            width = o * BITS
            up = levels[-1][0]
            low = (up >> width + BITS << width) | (up & (1 << width) - 1)
            levels.append(tuple(x.astype(t) for x, t in zip(np.unique(low, return_counts=True), (np.int64, float), strict=True)))
        lower_p = lower_keys = None
        for o, (gram, c) in enumerate(reversed(levels), 1):
            width = o * BITS
            language = gram >> width
            seen = [np.bincount(language[c == i], minlength=len(known) + 1).astype(float) for i in (1, 2, 3, 4)]
            y = seen[0] / np.maximum(seen[0] + 2 * seen[1], 1)
            d = np.zeros((4, len(known) + 1))
            for i in (1, 2, 3):
                d[i] = np.clip(i - (i + 1) * y * seen[i] / np.maximum(seen[i - 1], 1), 0.05 * i, 0.95 * i)
            off = d[np.minimum(c, 3).astype(int), language]
            context, inverse = np.unique(gram >> BITS, return_inverse=True)
            total, freed = np.bincount(inverse, c), np.bincount(inverse, off)
            back = freed / total
            if lower_p is None:
                under = np.full(len(gram), 1 / (1 << BITS))
            else:
                low = (gram >> width << width - BITS) | (gram & (1 << width - BITS) - 1)
                under = lower_p[np.searchsorted(lower_keys, low)]
            p = (c - off) / total[inverse] + back[inverse] * under
            self._add(o, gram, p, context, back)
            lower_p, lower_keys = p, gram

    def _add(self, o: int, gram: np.ndarray, p: np.ndarray, context: np.ndarray, back: np.ndarray) -> None:
        for store, at, v in ((self.p, gram, p), (self.back, context, back)):
            h = self.hash(o, at)
            order = np.argsort(h)
            store.append((h[order], v[order]))

    @staticmethod
    def hash(o: int, gram: np.ndarray) -> np.ndarray:
        return T.mix(gram.astype(np.uint64) | _U(o << 48))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.full(len(h), other), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        return np.where(hit, values[at], other), hit

    def logp(self, lang: int, code: np.ndarray) -> np.ndarray:
        """Natural log-probability of the last character of each n-gram after the others, backing off where it wasn't seen."""
        weight, out = np.ones(len(code)), np.zeros(len(code))
        left = np.arange(len(code))
        for o in range(ORDER, 0, -1):
            gram = (lang << o * BITS) | (code[left].astype(np.int64) & (1 << o * BITS) - 1)
            p, hit = self._find(self.p[o - 1], self.hash(o, gram), 0.0)
            out[left[hit]] = weight[left[hit]] * p[hit]
            left = left[~hit]
            b, _ = self._find(self.back[o - 1], self.hash(o, gram[~hit] >> BITS), 1.0)
            weight[left] *= b
        out[left] = weight[left] / (1 << BITS)
        return np.log(out)


def fit(docs: DataFrame) -> Model:
    """The model of docs (text, lang), from counts over all of them."""
    known = languages(docs)
    rows = ngram_counts(docs, known).toArrow()
    return Model(known, *(rows.column(c).to_numpy() for c in ("lang", "code", "n")))


def repeated(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which entries have a key that another entry of the same row has too."""
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    hit = np.zeros(len(key) + 1, bool)
    hit[1:-1] |= same
    both = hit[1:].copy()
    both[:-1] |= same
    out = np.zeros(len(key), bool)
    out[order] = hit[:-1] | both
    return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(offs) - 1
    starts, ends, bounds = T.words(data, offs)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    h = T.word_hashes(data, starts, ends)
    first, _ = T.window_starts(bounds, 3)
    row = np.searchsorted(bounds, first, "right") - 1
    hit = first[repeated(row, T.spans(h, first, first + 3))]
    cover = np.zeros(len(h) + 4, np.int32)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 3, -1)
    covered = np.cumsum(cover)[: len(h)] > 0

    cuts = np.flatnonzero(data == 10)
    begin = np.concatenate([offs[:-1], cuts + 1])
    of = np.concatenate([np.arange(rows), np.searchsorted(offs, cuts, "right") - 1])
    order = np.lexsort((begin, of))
    begin, of = begin[order], of[order]
    end = np.empty(len(begin), np.int64)
    end[:-1] = begin[1:] - (of[1:] == of[:-1])
    end[-1:] = len(data)
    end = np.minimum(end, offs[of + 1])
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    line = T.word_hashes(data, begin[worded], end[worded])
    of = of[worded]
    by = np.lexsort((line, of))
    again = (line[by][1:] == line[by][:-1]) & (of[by][1:] == of[by][:-1])
    return {
        "n_words": np.diff(bounds),
        "word_chars": count(((data & 0xC0) != 0x80) & ~T.SPACE[data]),
        "n_symbols": count(_SYMBOL[data]),
        "n_dup_lines": np.bincount(of[by][1:][again], minlength=rows),
        "n_repeat_words": np.diff(np.concatenate([[0], np.cumsum(covered)])[bounds]),
        "text_key": wordmodel.text_keys(h, bounds),
    }


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def scorer(model: Model) -> Callable:
    """f(lang of each row, bytes, offsets): mean log-perplexity per character of each row (0 for an empty text)."""
    known: dict[int, np.ndarray] = {}

    def score(lang: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        code, row = codes(data, offs)
        of = lang[row]
        value = np.empty(len(code), np.float32)
        for k in np.unique(of):
            if k not in known and len(known) == HELD:
                known.pop(next(iter(known)))
            table = known[k] if k in known else known.setdefault(k, np.full(SIZE, np.nan, np.float32))
            mine = np.flatnonzero(of == k)
            own = code[mine]
            if (new := np.isnan(table[own])).any():
                at = np.unique(own[new])
                table[at] = model.logp(int(k), at)
            value[mine] = table[own]
        n = np.bincount(row, minlength=len(offs) - 1)
        return -np.bincount(row, value.astype(np.float64), minlength=len(offs) - 1) / np.maximum(n, 1)

    return score


def _scored(model) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, index = scorer(model.value), _indexer(model.value.known)
        for b in batches:
            lang = index(b.column(b.schema.get_field_index("lang")))
            for lo, hi, data, offs in T.slices(b, "text"):
                s = statistics(data, offs)
                cols = [b.column(0).slice(lo, hi - lo), pa.array(lang[lo:hi]), *(pa.array(s[c].astype(np.int64)) for c in BASE), pa.array(base_failed(s)), pa.array(score(lang[lo:hi], data, offs)), pa.array(s["text_key"])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "band", *BASE, "base_failed", "log_perplexity", "text_key"])

    return f


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, band (index of its language), the base statistics, base_failed, log_perplexity and text_key of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, band long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, log_perplexity double, text_key long"
    return docs.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(T.trimmed(_scored(shared)), schema)


def bands(scored: DataFrame, n_languages: int, below: float = BELOW, above: float = ABOVE, column: str = "log_perplexity", width: float = BIN, wide: float = 0.0) -> np.ndarray:
    """(lower, upper) log-perplexity of each language: its median less below, and plus above, robust standard deviations of what passes the base rules.

    The upper limit is wide above the median at least. The medians come from a histogram, so reruns agree and the driver
    gets a bounded number of rows of each language.
    """
    rows = scored.where("not base_failed").groupBy("band", F.floor(F.col(column) / width).alias("bin")).count().collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["band"], r["bin"])):
        by.setdefault(r["band"], []).append((r["bin"], r["count"]))
    mid = lambda v, w: v[np.searchsorted(np.cumsum(w), w.sum() / 2)]
    nearest = lambda far, n: mid(far[at := np.argsort(far, kind="stable")], n[at])
    own = {}
    for k, pairs in by.items():
        x, n = np.array(pairs, float).T
        centre = mid(x, n)
        own[k] = centre, np.abs(x - centre), n
    out = np.tile([-np.inf, np.inf], (n_languages + 1, 1))
    every = nearest(*(np.concatenate([v[i] for v in own.values()]) for i in (1, 2))) if own else 0
    for k, (centre, far, n) in own.items():
        spread = 1.4826 * max(nearest(far, n), 1, every if n.sum() < FEW else 0)
        out[k] = (centre + 0.5 - below * spread) * width, (centre + 0.5) * width + max(above * spread * width, wide)
    return out


def _within(limits: np.ndarray, column: str) -> F.Column:
    lo, hi = (F.element_at(F.array(*[F.lit(float(x)) for x in side]), (F.col("band") + 1).cast("int")) for side in limits.T)
    return F.col(column).between(lo, hi)


def _both(docs: DataFrame, model: Model) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores of docs with word_log_perplexity (0 without words), and the limits of both kinds of perplexity."""
    with narrow_batches(docs.sparkSession):
        plain = written(scores(docs, model), "scores")
    words = wordmodel.word_scores(docs.select("text"), model.characters)
    both = plain.join(words, "text_key", "left").withColumn("word_log_perplexity", F.coalesce("word_log_perplexity", F.lit(0.0)))
    scored = written(both.select(*plain.columns, "word_log_perplexity"), "scores")
    drop(plain)
    n = len(model.known)
    return scored, bands(scored, n), bands(scored, n, np.inf, WORDS_ABOVE, "word_log_perplexity", WORD_BIN, WIDE)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): the base statistics, base_failed, kept, band and both log-perplexities.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; a null text has none. word_chars counts the code points in
    words, n_symbols those of SYMBOLS, n_dup_lines the lines (split at newlines, with a word) equal to an earlier one,
    n_repeat_words the words in 3-word windows that the text has twice or more. base_failed: fewer than 50 words, or
    over half of them repeated. kept: not base_failed, and the perplexities per character and per word lie within the
    bands of the document's language. Empty texts fail. Repeated rows give repeated rows. An empty table gives an empty result.
    """
    scored, limits, words = _both(docs, fit(docs))
    kept = ~F.col("base_failed") & _within(limits, "log_perplexity") & _within(words, "word_log_perplexity")
    return scored.drop("text_key").withColumn("kept", kept)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, all columns unchanged, whatever the others are called.

    The last pass scores characters again, and looks up the texts that the word model rejects, so no text is shuffled
    while these are few enough for a broadcast.
    """
    model = fit(docs)
    scored, limits, words = _both(docs, model)
    odd = small(written(scored.where(~F.col("base_failed") & ~_within(words, "word_log_perplexity")).select("band", "text_key").distinct(), "odd"))
    drop(scored)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    langs, texts = (docs.columns.index(c) for c in ("lang", "text"))
    plain = [f"c{i}" for i in range(len(docs.columns))]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, index = scorer(shared.value), _indexer(shared.value.known)
        for b in batches:
            lang = index(b.column(langs))
            kept, keys = [], []
            for lo, hi, data, offs in T.slices(b, plain[texts]):
                s = statistics(data, offs)
                x, band = score(lang[lo:hi], data, offs), limits[lang[lo:hi]]
                kept.append(~base_failed(s) & (x >= band[:, 0]) & (x <= band[:, 1]))
                keys.append(s["text_key"])
            if kept:
                own = [pa.array(lang), pa.array(np.concatenate(keys))]
                yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*plain, "band", "text_key"]).filter(pa.array(np.concatenate(kept)))

    named = docs.toDF(*plain)  # a name with a dot in it can't be handed to mapInArrow
    good = named.mapInArrow(T.trimmed(f), StructType([*named.schema, StructField("band", LongType()), StructField("text_key", LongType())]))
    return good.join(odd, ["band", "text_key"], "left_anti").select(*plain).toDF(*docs.columns)
