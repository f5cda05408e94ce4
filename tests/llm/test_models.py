"""The perplexity model and its bands against plain Python, and the classifier's trees against walks of single rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from peakforge.llm import classifier, quality

MASK = (1 << 64) - 1


def char_class(ch):
    b = ch.encode()
    if len(b) == 1:
        if ch in " \t\n\x0b\x0c\r":
            return 0
        if ch.isalpha():
            return ord(ch.lower()) - 96
        if ch.isdigit():
            return 27
        if ord(ch) < 32 or ord(ch) == 127:
            return 31
        return 29 if ch in ".,;:!?'\"()-" else 30
    point = ord(ch)
    if point < 0x280 or 0x1E00 <= point < 0x1F00 or 0x2000 <= point < 0x2C00 or 0x3000 <= point < 0x3040 or 0xFF00 <= point < 0xFF40:
        return 28
    x = (int.from_bytes(b, "big") + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return 1 + (x ^ (x >> 31)) % 26


def sequence(text):
    out = []
    for ch in text or "":
        c = char_class(ch)
        if c or not out or out[-1]:
            out.append(c)
    return out


def grams(text, order=4):
    s = [0] * (order - 1) + sequence(text)
    return [tuple(s[i : i + order]) for i in range(len(s) - order + 1)]


def kneser_ney(counts, order=4):
    """Probability of every 4-gram of one language by the recursion, from its counts."""
    levels = [counts]
    for _ in range(order - 1):
        before = defaultdict(set)
        for g in levels[0]:
            before[g[1:]].add(g[0])
        levels.insert(0, {g: len(x) for g, x in before.items()})
    lower = None
    for level in levels:
        of = Counter(level.values())
        y = of[1] / max(of[1] + 2 * of[2], 1)
        discount = [0.0] + [min(max(i - (i + 1) * y * of[i + 1] / max(of[i], 1), 0.05 * i), 0.95 * i) for i in (1, 2, 3)]
        total, freed = Counter(), defaultdict(float)
        for g, c in level.items():
            total[g[:-1]] += c
            freed[g[:-1]] += discount[min(c, 3)]
        here = {}
        for g, c in level.items():
            under = lower[g[1:]] if lower else 1 / 32
            here[g] = (c - discount[min(c, 3)]) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * under
        lower = here
    return lower


def base_fails(text):
    w = (text or "").split()
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w) < 50 or 100 * len(cover) > 50 * len(w)


def middle(xs):
    return sorted(xs)[math.ceil(len(xs) / 2) - 1]


def verdicts(rows):
    """{doc_id: (log-perplexity, kept)} of rows (doc_id, text, lang)."""
    models = {}
    for lang in {r[2] for r in rows}:
        models[lang] = kneser_ney(Counter(g for r in rows if r[2] == lang for g in grams(r[1])))
    score = {}
    for d, text, lang in rows:
        g = grams(text)
        score[d] = -sum(math.log(models[lang][x]) for x in g) / max(len(g), 1)
    far, centre = {}, {}
    for lang in models:
        xs = [math.floor(score[d] / quality.BIN) for d, t, x in rows if x == lang and not base_fails(t)]
        if xs:
            centre[lang] = middle(xs)
            far[lang] = [abs(x - centre[lang]) for x in xs]
    every = middle([x for xs in far.values() for x in xs])
    out = {}
    for d, text, lang in rows:
        kept = not base_fails(text)
        if kept:
            spread = 1.4826 * max(middle(far[lang]), 1, every if len(far[lang]) < quality.FEW else 0)
            x = (score[d] / quality.BIN) - centre[lang] - 0.5
            kept = -quality.BELOW * spread <= x <= quality.ABOVE * spread
        out[d] = score[d], kept
    return out


def test_perplexity_and_bands_by_plain_python(spark):
    rng = random.Random(8)
    letters = {"en": "etaoinshrdlucm", "de": "enirstadhulgöüß", "ru": "оеаинтсрвлк", None: "qxzkvjwyfg"}

    def prose(lang, n):
        own = random.Random(f"words of {lang}")
        vocab = ["".join(own.choice(letters[lang]) for _ in range(own.randint(1, 8))) for _ in range(200)]
        return "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", ", ", ".\n", "  "]) for _ in range(n))

    texts = [(prose(lang, size), lang) for lang, n, size in (("en", 160, 700), ("de", 40, 150), ("ru", 12, 300), (None, 33, 90)) for _ in range(n)]
    junk = len(texts)
    texts += [(" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)), "en") for _ in range(2)]
    texts += [(None, "en"), ("", None), (" \t\n ", "de"), ("too short", "ru"), ("the same " * 80, "en"), ("alone " + prose("en", 90), "xx"), ("\x00\x7f “quoted” ー・！ḃ € 漢字 " + prose("de", 80), "de")]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(texts)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    want = verdicts(rows)
    assert len(got) == len(rows)
    for d, (score, kept) in want.items():
        assert got[d].log_perplexity == pytest.approx(score, abs=2e-6), (d, rows[d])
        assert got[d].kept == kept, (d, rows[d])
    rejected = [d for d, (_, kept) in want.items() if not kept and not got[d].base_failed]
    assert {junk, junk + 1} <= set(rejected)  # the two of random letters


def walk(trees, x):
    """Probability of one row, tree by tree and node by node."""
    total = trees.base
    for root in trees.roots:
        k = root
        while trees.feature[k] >= 0:
            k = trees.left[k] + (1 if x[trees.feature[k]] > trees.threshold[k] else 0)
        total += trees.value[k]
    return 1 / (1 + math.exp(-total))


def first_split(x, y):
    """Gain of the best split of all rows at the prior, by trying every threshold between bins."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    g, h = p - y, np.full(len(y), p * (1 - p))
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + classifier.RIDGE)
    every = np.ones(len(y), bool)
    best = {}
    for f in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, classifier.BINS + 1)[1:-1])):
            low = x[:, f] <= t
            if min(low.sum(), (~low).sum()) >= classifier.LEAF:
                best[f, t] = part(low) + part(~low) - part(every)
    return best


def test_trees_by_plain_python():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=900), rng.integers(0, 5, 900), np.zeros(900), rng.normal(size=900)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 3) ^ (rng.random(900) < 0.05)).astype(float)
    trees = classifier.train(x, y)
    new = np.vstack([x[:200], rng.normal(size=(200, 4)) * 3, [[np.inf, -np.inf, 0, 0]]])
    assert np.allclose(trees.score(new), [walk(trees, r) for r in new], atol=1e-12)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.93
    gains = first_split(x, y)
    root = trees.roots[0]
    assert gains[trees.feature[root], trees.threshold[root]] == pytest.approx(max(gains.values()))


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    good = labels == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_classifier_of_noisy_documents(spark):
    """Held-out documents of two overlapping kinds; names that clash, repeated rows, several labels, a bound on the sample."""
    rng = random.Random(9)

    def text(good):
        noise = rng.betavariate(2, 5) if good else rng.betavariate(4, 3)
        return " ".join(rng.choice(["#$%", "|||", "X9X9", "<<"]) if rng.random() < noise else rng.choice(["words", "of", "plain", "prose", "goes", "on."]) for _ in range(60))

    rows = [(i, text(i % 2), "y", 3, "k") for i in range(1500)]
    names = "doc_id long, text string, y string, x int, key string"
    labels = spark.createDataFrame([(i, i % 2) for i in range(1500)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows + rows[:40], names)
    got = classifier.classify(docs, labels).collect()
    assert len(got) == 1540
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert auc(np.array([r.score for r in held]), np.array([r.doc_id % 2 for r in held])) > 0.8
    once = {(r.doc_id, r.score) for r in classifier.classify(spark.createDataFrame(rows, names), labels).collect()}
    assert once == {(r.doc_id, r.score) for r in got}  # repeated rows add nothing to the fit
    both = labels.unionByName(labels.selectExpr("doc_id", "1 as quality"))  # the smallest of several labels counts
    assert {(r.doc_id, r.score) for r in classifier.classify(docs, both).collect()} == once
    other = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    assert {(r.doc_id, r.score) for r in classifier.classify(docs, other).collect()} == once  # held-out labels aren't read
    assert len({r.score for r in classifier.classify(docs, labels, sample=20).collect()}) <= 1 << classifier.DEPTH * 2
