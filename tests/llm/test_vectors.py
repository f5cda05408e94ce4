"""Whitening and exact search over vectors, against numpy and plain Python."""

from __future__ import annotations

from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from peakforge.llm import mtree, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, i int, key long"


def vectors(seed: int, n: int, d: int, offset: float = 0.0) -> list[tuple]:
    """Copies, repeated rows, null ids, broken vectors and one of another length."""
    r = np.random.default_rng(seed)
    v = (r.normal(size=(n, d)) * np.arange(1, d + 1) + offset).astype(np.float32).tolist()
    rows = [(i, x, 0, "clash", 1, 2) for i, x in enumerate(v)]
    rows += [(n + i, v[0], 0, None, None, None) for i in range(20)] + rows[3:5] + [(None, v[1], 0, None, None, None)]
    broken = [None, [], [1.0] * (d - 1), [None] + v[0][1:], [nan] + v[0][1:], [inf] + v[0][1:], [-inf] + v[0][1:]]
    return rows + [(900 + i, x, 0, None, None, None) for i, x in enumerate(broken)]


def sound(rows: list[tuple], d: int, scale: int) -> list[tuple]:
    ok = lambda v: v is not None and len(v) == d and all(c is not None and isfinite(c) for c in v)
    return [(i, [floor(scale * c) for c in v]) for i, v, *_ in rows if ok(v)]


@pytest.mark.parametrize("offset", [0.0, 100_000.0])
def test_whitening(spark, offset):
    d = 7
    rows = vectors(1, 150, d, offset)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    own = sound(rows, d, 256)
    fit = np.array(sorted({tuple(x) for _, x in own}))
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = np.array([[(n * int(c) - s) / n for c, s in zip(x, total, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want, found = {}, {}
    for i, x in own:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, total, strict=True))
        y = np.array([(n * c - s) / n for c, s in zip(x, total, strict=True)]) @ axes[:, :4] / np.sqrt(values[:4])
        want.setdefault(i, []).append((deviation, y))
    for r in got:
        found.setdefault(r.vec_id, []).append(r)
    assert found.keys() == want.keys() and len(got) == 4 * len(own)
    sign = {}
    for i, each in want.items():
        assert sorted(r.deviation for r in found[i]) == sorted(dev for dev, _ in each for _ in range(4))
        if len(each) == 1:
            for r in found[i]:
                y = each[0][1][r.component - 1]
                sign.setdefault(r.component, np.sign(y * r.whitened))
                assert abs(r.whitened * sign[r.component] - y) < 1e-6
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 for r in got)


def test_whitening_of_few_and_of_none(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, None, None, None)], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, None, None, None)] * 2, SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)] * 2
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0], 0, None, None, None) for i in range(4)], SCHEMA)).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)} and line[0].identity_error < 1e-12
    huge = whitening.whiten(spark.createDataFrame([(1, [1e10], 0, None, None, None), (2, [-1e10], 0, None, None, None), (3, [3e38], 0, None, None, None)], SCHEMA)).collect()
    assert [(r.vec_id, r.deviation, round(abs(r.whitened), 9)) for r in huge] == [(1, None, 1.0), (2, None, 1.0)]


@pytest.mark.parametrize(("n", "d", "spread"), [(700, 5, 1.0), (300, 3, 5e4)])
def test_top_products(spark, monkeypatch, n, d, spread):
    """Small trees of several groups; scores beyond exact doubles with a large spread; ties among copies, and more copies than k."""
    for name, size in (("TREE", 128), ("PAGE", 8), ("GROUP", 4), ("PIVOTS", 16), ("BLOCK_BYTES", 200)):
        monkeypatch.setattr(mtree, name, size)
    rows = [(i, v and [c and float(np.float32(c * spread)) for c in v], *rest) for i, v, *rest in vectors(2, n, d)]
    got = mtree.top_products(spark.createDataFrame(rows, SCHEMA), "vec_id % 25 = 0", 6).collect()
    own = sound(rows, d, 1024)
    want = []
    for a, (i, x) in enumerate(own):
        if i is not None and i % 25 == 0:
            scores = sorted(((-sum(p * q for p, q in zip(x, y, strict=True)), j is None, j or 0, j) for b, (j, y) in enumerate(own) if a != b), key=lambda s: s[:3])
            want += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(scores[:6], 1)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bounds_leave_out_most_of_clustered_vectors():
    """Clusters on a sphere: most distances are never computed, and the best are right."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 6))
    x = np.floor(1024 * (centres[np.sort(r.integers(0, 40, 4000))] / np.linalg.norm(centres, axis=1).mean() + 0.01 * r.normal(size=(4000, 6)))).astype(np.int64)
    ids, top = np.arange(4000), int(np.square(x).sum(axis=1).max())
    s = mtree._Search(ids[::100], x[::100], 5, top, (ids[:0], x[:0]))
    for lo in range(0, 4000, 1000):
        s.add(mtree._tree(ids[lo : lo + 1000], ids[lo : lo + 1000], x[lo : lo + 1000], top))
    for q in range(40):
        scores = x @ x[100 * q]
        order = [i for i in np.lexsort((ids, -scores)) if i != 100 * q][:5]
        assert s.best[2][s.best[0] == q].tolist() == order
    assert s.computed < 0.5 * 40 * 4000


def test_search_in_few_and_none(spark):
    few = lambda rows: [tuple(x) for x in mtree.top_products(spark.createDataFrame(rows, SCHEMA), "vec_id = 1").collect()]
    rest = (0, None, None, None)
    assert few([]) == [] and few([(1, None, *rest)]) == [] and few([(1, [1.0], *rest)]) == []
    assert few([(1, [1.0], *rest), (None, [2.0], *rest)]) == [(1, 1, None, 1024 * 2048)]
    assert few([(1, [0.0], *rest)] * 2) == [(1, 1, 1, 0)] * 2
