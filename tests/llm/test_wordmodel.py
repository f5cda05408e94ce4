"""The word model against plain Python, and texts that only it can tell from prose."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakforge.llm import quality, wordmodel

START = object()


def discount(counts, c):
    of = Counter(counts)
    y = of[1] / max(of[1] + 2 * of[2], 1)
    i = min(c, 3)
    return min(max(i - (i + 1) * y * of[i + 1] / max(of[i], 1), 0.05 * i), 0.95 * i) if i else 0


def pairs_of(text):
    w = text.split()
    return Counter(zip([START, *w], w))


def log_perplexities(texts):
    """Of each text, from sets and dictionaries over all pairs, less what the text itself adds to a pair."""
    count = Counter()
    for t in texts:
        count.update(pairs_of(t))
    after, before = defaultdict(dict), defaultdict(set)
    for (a, b), c in count.items():
        after[a][b] = c
        before[b].add(a)
    top = [discount(count.values(), c) for c in range(4)]
    lefts = [len(x) for x in before.values()]
    low = [discount(lefts, c) for c in range(4)]
    spare = sum(low[min(x, 3)] for x in lefts) / sum(lefts) / len(lefts)
    out = []
    for t in texts:
        own, total = pairs_of(t), 0.0
        for (a, b), m in own.items():
            follows = {**after[a], b: after[a][b] - m}
            left = len(before[b]) - (follows[b] == 0)
            p = (left - low[min(left, 3)]) / sum(lefts) + spare
            if n := sum(follows.values()):
                freed = sum(top[min(c, 3)] for c in follows.values())
                p = (follows[b] - top[min(follows[b], 3)] + freed * p) / n
            total -= m * math.log(p)
        out.append(total / sum(own.values()) if own else None)
    return out


def test_word_perplexity_by_plain_python(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    pick = lambda: vocab[min(int(rng.paretovariate(0.7)), 299)]
    texts = ["\n".join(" ".join(pick() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    texts += ["", " \t", "alone", texts[0].replace(" ", "  "), "the the the the the", "the same words once more", "ünïcode 漢字 words\x0band\tothers"]
    want = log_perplexities(texts)
    rows = [(t,) for t in texts] + [(None,)]
    docs = spark.createDataFrame(rows, "text string").repartition(5)
    for side in (1, 4):  # one block, and a grid of 4 sent in four parts
        got = sorted(r.word_log_perplexity for r in wordmodel.word_scores(docs, side * side * wordmodel.BLOCK).collect())
        each = sorted({t: w for t, w in zip([" ".join(t.split()) for t in texts], want, strict=True) if w is not None}.values())
        assert got == pytest.approx(each, abs=1e-6)
    assert wordmodel.word_scores(docs.where(F.length("text") < 1), 0).count() == 0


def test_pairs_are_sent_in_few_bytes():
    """So many bytes a pair, however many blocks there are, and what is sent holds every pair and text."""
    rng = random.Random(4)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.5)), 20000)}" for _ in range(120)) for _ in range(2000)] + ["", "alone"]
    for side in (4, 24):
        rows = [r for b in wordmodel._pairs(side, 0, 1, True)([pa.RecordBatch.from_pydict({"text": texts})]) for r in b.to_pylist()]
        sent = sum(len(r[c]) for r in rows for c in "abcde")
        pairs = sum(len(pairs_of(t)) for t in texts)
        assert sent < 11 * pairs
        assert sum(len(wordmodel._large(r["d"])) for r in rows) == pairs
        assert len({int(p) for r in rows for p in wordmodel._whole(r["a"])}) == len(set().union(*map(pairs_of, texts)))
        assert len({r["chunk"] for r in rows}) == 1 and sum(len(r["e"]) for r in rows) == 8 * len(texts)


def test_words_in_any_order_are_rejected(spark):
    """A model of a few characters of context keeps them: they are spelled like the rest."""
    rng = random.Random(6)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    follows = {w: rng.sample(vocab, 3) for w in vocab}

    def prose(n):
        out = [rng.choice(vocab)]
        while len(out) < n:
            out.append(rng.choice(follows[out[-1]]))
        return out

    clean = [prose(rng.randint(80, 200)) for _ in range(300)]
    salad = [rng.sample(w, len(w)) for w in clean[:40]]
    docs = spark.createDataFrame([(i, " ".join(w), "en") for i, w in enumerate(clean + salad)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    whole = [i for i in got if not got[i].base_failed]
    assert all(got[i].kept == (i < len(clean)) for i in whole) and len([i for i in whole if i >= len(clean)]) > 30
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, r in got.items() if r.kept}
