"""Perplexity of texts under a modified Kneser-Ney model of word pairs that holds every word and every pair of the corpus.

The model is never in one place. Pairs (word before, word) are dealt to a grid of blocks by both words, so the pairs
of one frequent word lie in a whole row or column of blocks. What a block needs of the words in it (how often they
come first, how many words go before them) is summed over all blocks by Spark and sent to its row and column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm import text as T
from peakforge.llm.store import collect, drop, written

#: Pairs that a task counts before it sends them.
CHUNK = 1 << 20
#: Characters of the corpus for each block of the grid in each part.
BLOCK = 1 << 24
#: Parts in which pairs are sent, one after another: each holds only so much of the shuffle folder.
PARTS = 4
#: Logarithms are summed in whole steps of 2**-24, so that sums don't depend on their order.
STEP = 1 << 24

_U = np.uint64
_COLUMNS = ("total", "n1", "n2", "n3", "n4", "kinds", "left")


def text_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each row's sequence of words, whose hashes are h."""
    return T.signed(T.spans(h, bounds[:-1], bounds[1:]))


def _codes(h: np.ndarray) -> np.ndarray:
    """32 bits of a word's hash; 0 is the beginning of a text."""
    return np.maximum(h >> _U(32), _U(1))


def _halves(pair: np.ndarray) -> bytes:
    """Pairs in order, as bytes: how many first words, how many pairs each has, the first words, and the second words of all pairs; half of eight bytes a pair."""
    first = pair >> _U(32)
    at = np.flatnonzero(np.diff(first, prepend=first[:1] + _U(1)))
    cells = [np.array([len(at)]), np.diff(np.append(at, len(pair))), first[at], pair & _U(0xFFFFFFFF)]
    return np.concatenate(cells, dtype=np.uint32, casting="unsafe").tobytes()


def _whole(data: bytes) -> np.ndarray:
    """The pairs that _halves has packed."""
    x = np.frombuffer(data, np.uint32)
    n = int(x[0])
    return np.repeat(x[1 + n : 1 + 2 * n].astype(np.uint64) << _U(32), x[1 : 1 + n]) | x[1 + 2 * n :]


def _small(x: np.ndarray) -> bytes:
    """Counts or places as bytes, one or two each if they fit; the first byte tells."""
    most = x.max(initial=0)
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _large(data: bytes) -> np.ndarray:
    """What _small has packed."""
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.uint32)


def _rows(pair: np.ndarray, doc: np.ndarray, names: np.ndarray, side: int, whose: bool) -> Iterator[pa.RecordBatch]:
    """Rows (block, pairs, spread, docs, times, names, chunk): each pair once, in so many texts, in each so many times.

    chunk says which rows have texts in common, the first of which brings their names. It comes from the names, so
    that a task that runs again sends the same; chunks of equal texts become one, with twice the sums and counts.
    """
    chunk = int.from_bytes(hashlib.blake2b(names.tobytes(), digest_size=7).digest(), "big")
    order = np.argsort(pair, kind="stable")
    pair, doc = pair[order], doc[order]
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    if whose:
        new[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(pair)))
    pair, doc = pair[at], doc[at]
    block = ((pair >> _U(32)) % _U(side) * _U(side) + (pair & _U(0xFFFFFFFF)) % _U(side)).astype(np.int32)
    order = np.argsort(block, kind="stable")
    pair, doc, times, block = pair[order], doc[order], times[order], block[order]
    cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        first = np.append(np.flatnonzero(np.diff(pair[lo:hi], prepend=pair[lo] + _U(1))), hi - lo)
        cells = [_halves(pair[lo:hi][first[:-1]]), _small(np.diff(first)), _small(doc[lo:hi]) if whose else b"", _small(times[lo:hi]), names.tobytes() if lo == 0 else b""]
        yield pa.RecordBatch.from_arrays([pa.array([block[lo]]), pa.array([0], pa.int32()), *(pa.array([c], pa.binary()) for c in cells), pa.array([chunk])], names=_NAMES)


_SENT = "block int, kind int, a binary, b binary, c binary, d binary, e binary, chunk long"
_NAMES = ["block", "kind", "a", "b", "c", "d", "e", "chunk"]


def _pairs(side: int, part: int, parts: int, whose: bool) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def sent():
            pair, doc, names = (np.concatenate(x) for x in zip(*held, strict=True))
            return _rows(pair, doc, names, side, whose)

        for b in batches:
            for _, _, data, offs in T.slices(b, "text"):
                starts, ends, bounds = T.words(data, offs)
                h = T.word_hashes(data, starts, ends)
                word = _codes(h)
                before = np.zeros(len(word), np.uint64)
                before[1:] = word[:-1]
                before[bounds[:-1][np.diff(bounds) > 0]] = 0
                doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds)) + np.int32(texts)
                mine = np.flatnonzero(before // _U(side) % _U(parts) == part)
                names = text_keys(h, bounds) if whose else np.zeros(0, np.int64)
                held.append(((before << _U(32) | word)[mine], doc[mine], names))
                size, texts = size + len(mine), texts + len(bounds) - 1
                if size >= CHUNK:
                    yield from sent()
                    held, size, texts = [], 0, 0
        if size:
            yield from sent()

    return f


def _sent(docs: DataFrame, side: int, part: int, parts: int, whose: bool) -> DataFrame:
    return docs.select("text").mapInArrow(T.trimmed(_pairs(side, part, parts, whose)), _SENT)


def _cells(table: pa.Table, name: str, dtype: type) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table.column(name).to_pylist()]


def _counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a block in order, and how often each occurs; for each (pair, text) sent, the place of its pair and how often it has it."""
    sent, spread, times = (np.concatenate([f(x) for x in table.column(c).to_pylist()]) for c, f in (("a", _whole), ("b", _large), ("d", _large)))
    pair, place = np.unique(sent, return_inverse=True)
    place = np.repeat(place.astype(np.int32), spread)
    return pair, np.bincount(place, times, len(pair)).astype(np.int64), place, times


def _totals(table: pa.Table) -> pa.Table:
    """For the words of a block: times that they come first, how many words follow once to four times and in all; how many words go before them."""
    pair, n, _, _ = _counted(table)
    at = np.flatnonzero(np.diff(pair >> _U(32), prepend=_U(1 << 40)))
    of = lambda x: np.add.reduceat(x.astype(np.int64), at)
    first = [of(n), *(of(n == i) for i in (1, 2, 3, 4)), of(np.ones(len(n)))]
    word, left = np.unique(pair & _U(0xFFFFFFFF), return_counts=True)
    none = np.zeros(len(word), np.int64)
    cells = [np.concatenate([pair[at] >> _U(32), word]), *(np.concatenate([x, none]) for x in first), np.concatenate([np.zeros(len(at), np.int64), left])]
    return pa.table([pa.array(x.astype(np.int64)) for x in cells], names=["word", *_COLUMNS])


def _words(docs: DataFrame, side: int, parts: int) -> DataFrame:
    """Every word of docs with its totals."""
    schema = "word long, " + ", ".join(f"{c} long" for c in _COLUMNS)
    summed = lambda d: d.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COLUMNS])
    found = []
    for k in range(parts):
        found.append(written(summed(_sent(docs, side, k, parts, False).groupBy("block").applyInArrow(_totals, schema)), "words", hashes=True))
        collect(docs.sparkSession)  # once more, as Spark lets go of a plan only a moment after it ends
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    if len(found) == 1:
        return every
    out = written(summed(every), "words", hashes=True)
    for x in found:
        drop(x)
    return out


def discounts(seen: list[int]) -> np.ndarray:
    """Of counts 0, 1, 2, and 3 or more; seen: how many have a count of 1, 2, 3, 4."""
    y = seen[0] / max(seen[0] + 2 * seen[1], 1)
    return np.array([0.0] + [min(max(i - (i + 1) * y * seen[i] / max(seen[i - 1], 1), 0.05 * i), 0.95 * i) for i in (1, 2, 3)])


def _packed(words: DataFrame, side: int, part: int, parts: int) -> DataFrame:
    """Words with their totals for the blocks of their row (kind 1), and for those of their column (kind 2)."""

    def f(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        get = {c: table.column(c).to_numpy() for c in ("word", *_COLUMNS)}
        g = int(get["word"][0] % side)
        out = []
        ahead = np.flatnonzero((get["total"] > 0) & (get["word"] // side % parts == part))
        if len(ahead):
            cells = [get[c][ahead].astype(t).tobytes() for c, t in (("word", np.uint32), ("total", np.int64), ("n1", np.uint32), ("n2", np.uint32), ("kinds", np.uint32))]
            out += [[g * side + k, 1, *cells] for k in range(side)]
        after = np.flatnonzero(get["left"] > 0)
        if len(after):
            cells = [get["word"][after].astype(np.uint32).tobytes(), get["left"][after].astype(np.uint32).tobytes(), b"", b"", b""]
            out += [[k * side + g, 2, *cells] for k in range(side)]
        out = [[*r, 0] for r in out]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int64()]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=_NAMES)

    return words.groupBy(F.col("word") % side).applyInArrow(f, _SENT)


def probability(c, total, n1, n2, kinds, left, m, top: np.ndarray, low: np.ndarray, all_left: int, spare: float) -> np.ndarray:
    """Of a word after another, by the model without the m times that the text itself has the pair.

    c: times of the pair; total, n1, n2, kinds: of the first word; left: words that go before the second. top, low:
    discounts of pairs and of words; spare: what the discounts leave to a word that nothing else goes before.
    """
    rest = c - m
    left = left - (rest == 0)
    under = (left - low[np.minimum(left, 3)]) / all_left + spare
    n3 = kinds - n1 - n2
    freed = top[1] * (n1 - (c == 1) + (rest == 1)) + top[2] * (n2 - (c == 2) + (rest == 2)) + top[3] * (n3 - (c > 2) + (rest > 2))
    others = total - m
    return np.where(others > 0, (rest - top[np.minimum(rest, 3)] + freed * under) / np.maximum(others, 1), under)


def _judged(top: np.ndarray, low: np.ndarray, all_left: int, spare: float) -> Callable:
    def f(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        asked, ahead, after = (table.filter(pa.array(kind == k)) for k in range(3))
        if not len(asked):
            return pa.table([pa.array([], pa.int64()), *[pa.array([], pa.binary())] * 4], names=["chunk", "names", "docs", "s", "n"])
        pair, count, place, times = _counted(asked)
        first = np.searchsorted(_cells(ahead, "a", np.uint32)[0], (pair >> _U(32)).astype(np.uint32))
        own = [_cells(ahead, c, t)[0][first].astype(np.int64) for c, t in (("b", np.int64), ("c", np.uint32), ("d", np.uint32), ("e", np.uint32))]
        second = np.searchsorted(_cells(after, "a", np.uint32)[0], (pair & _U(0xFFFFFFFF)).astype(np.uint32))
        own = [count, *own, _cells(after, "b", np.uint32)[0][second].astype(np.int64)]
        log = lambda at, m: np.rint(np.log(probability(*[x[at] for x in own], m, top, low, all_left, spare)) * STEP)
        s = log(slice(None), 1)[place]  # most texts have a pair once
        more = np.flatnonzero(times > 1)
        often = times[more].astype(np.int64)
        s[more] = log(place[more], often) * often
        lo, out = 0, []
        for d in map(_large, asked.column("c").to_pylist()):
            hi = lo + len(d)
            n = np.bincount(d, times[lo:hi]).astype(np.int64)
            at = np.flatnonzero(n)
            out.append([_small(at), np.bincount(d, s[lo:hi])[at].astype(np.int64).tobytes(), _small(n[at])])
            lo = hi
        return pa.table([asked.column("chunk"), asked.column("e"), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], names=["chunk", "names", "docs", "s", "n"])

    return f


def _summed(table: pa.Table) -> pa.Table:
    """The sums of the texts of a chunk over its blocks."""
    names = next(x for x in _cells(table, "names", np.int64) if len(x))
    docs, n = (np.concatenate([_large(x) for x in table.column(c).to_pylist()]) for c in ("docs", "n"))
    s, n = (np.bincount(docs, x, len(names)).astype(np.int64) for x in (np.concatenate(_cells(table, "s", np.int64)), n))
    at = np.flatnonzero(n)
    return pa.table([pa.array(x[at]) for x in (names, s, n)], names=["text_key", "s", "n"])


def word_scores(docs: DataFrame, characters: int) -> DataFrame:
    """(text_key, word_log_perplexity) of every text of docs that has a word; characters: about so many are in all texts.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged, told apart by 32 bits of a hash. The model is one
    for all languages, as texts in two of them are as good as others. A text does not vouch for itself: each of its
    pairs is scored by the counts without those that the text adds to that pair (of equal texts, one counts).
    """
    parts = max(1, min(PARTS, -(-characters // BLOCK)))
    side = max(1, int(np.ceil((characters / BLOCK / parts) ** 0.5)))
    words = _words(docs, side, parts)
    every = words.agg(*[F.sum(c).alias(c) for c in _COLUMNS[1:5]], F.sum("left").alias("left"), F.count_if(F.col("left") > 0).alias("kinds"), *[F.count_if(F.col("left") == i).alias(f"l{i}") for i in (1, 2, 3, 4)]).first()
    if not every["kinds"]:
        return words.select(F.col("word").alias("text_key"), F.lit(0.0).alias("word_log_perplexity"))
    top, low = discounts([every[f"n{i}"] for i in (1, 2, 3, 4)]), discounts([every[f"l{i}"] for i in (1, 2, 3, 4)])
    seen = [every["l1"], every["l2"], every["kinds"] - every["l1"] - every["l2"]]
    spare = float(np.dot(low[1:], seen)) / every["left"] / every["kinds"]
    found = []
    for k in range(parts):
        rows = _sent(docs, side, k, parts, True).unionByName(_packed(words, side, k, parts))
        part = rows.groupBy("block").applyInArrow(_judged(top, low, every["left"], spare), "chunk long, names binary, docs binary, s binary, n binary")
        part = part.groupBy("chunk").applyInArrow(_summed, "text_key long, s long, n long")
        found.append(written(part.groupBy("text_key").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "word_sums", hashes=True))
        del rows, part
        collect(docs.sparkSession)
    drop(words)
    sums = found[0]
    for x in found[1:]:
        sums = sums.unionByName(x)
    return sums.groupBy("text_key").agg((-F.sum("s") / F.sum("n") / STEP).alias("word_log_perplexity"))
