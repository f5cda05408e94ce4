"""Ordered sums, batches, alignment, draws and beam rounds on tables with nulls, ties and hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.functions import constants as K
from peakforge.functions import peptide
from peakforge.operators import alignment, batches, decoding, metrics, ordered, rounds, spectra


def test_running_sums_over_many_ranges(spark):
    r = random.Random(1)
    data = [(r.choice(["hot", "hot", "hot", "cold", None]), r.choice([0.5, 0.5, r.random()]), i, r.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(data, "k string, score double, id long, n long")
    for ranges in (1, 7, 60):
        got = {x.id: (x.upto, x.upto_total) for x in ordered.running(df, ["k"], [F.col("score").desc(), F.col("id")], ranges, upto="n").collect()}
        sums, total = {}, {}
        for k, _, i, n in sorted(data, key=lambda x: (-x[1], x[2])):
            sums[k] = sums.get(k, 0) + (n or 0)
            total[i] = sums[k]
        assert got == {i: (total[i], sums[k]) for k, _, i, _ in data}
    numbers = [x.row for x in ordered.numbered(df.repartition(5), [F.col("id")], ranges=9).orderBy("id").collect()]
    assert numbers == list(range(500))
    assert ordered.numbered(df.limit(0), ["id"]).count() == 0


def test_curve_of_a_hot_key_with_ties(spark):
    r = random.Random(2)
    data = [("hot" if i % 9 else "cold", r.choice([0.1, 0.9, r.random()]), i, r.random() < 0.4) for i in range(400)]
    df = spark.createDataFrame(data, "lang string, score double, spectrum_id long, whole boolean")
    want = {}
    for k in ("hot", "cold"):
        rows = sorted((x for x in data if x[0] == k), key=lambda x: (-x[1], x[2]))
        hits = np.cumsum([x[3] for x in rows])
        p, c = hits / np.arange(1, len(rows) + 1), hits / len(rows)
        want[k] = float(((c[1:] - c[:-1]) * (p[1:] + p[:-1]) / 2).sum())
    for ranges in (1, 12):
        got = {x.lang: x.pr_auc for x in metrics.pr_auc(df, "lang", ranges).collect()}
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_batches_do_not_depend_on_partitions(spark):
    df = spark.range(101).select(F.when(F.col("id") != 7, F.col("id")).alias("id"))
    a, b, other = (sorted(map(tuple, batches.shuffled_batches(x, ["id"], 10, seed).select("row", "batch", "id").collect())) for x, seed in ((df, 1), (df.repartition(7), 1), (df, 2)))
    assert a == b != other and [x[0] for x in a] == list(range(101))
    assert [sum(x[1] == k for x in a) for k in range(11)] == [10] * 10 + [1] and [x[2] for x in a] != sorted(x[2] for x in a if x[2])


def test_padding(spark):
    df = spark.createDataFrame([(0, 1, [5, 0, 6]), (0, 2, [7]), (0, 3, None), (1, 4, [])], "batch long, id int, v array<int>")
    got = {r.id: (r.v, r.mask, r.width) for r in batches.padded(df, "v").collect()}
    assert got == {1: ([5, 0, 6], [True, False, True], 3), 2: ([7, 0, 0], [True, False, False], 3), 3: ([0] * 3, [False] * 3, 3), 4: ([], [], 0)}


def test_alignment_keeps_every_side(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("y", None)], "k string, v int")
    b = spark.createDataFrame([("x", 3), ("z", 4)], "k string, v int")
    c = spark.createDataFrame([(None, 5)], "k string, `w.x` int")
    got = {r.k: tuple(r)[1:] for r in alignment.align({"a": a, "b": b, "c": c}, "k").collect()}
    assert got == {"x": (1, True, 3, True, None, False), None: (2, True, None, False, 5, True), "y": (None, True, None, False, None, False), "z": (None, False, 4, True, None, False)}
    items = spark.createDataFrame([("f", "i"), ("f", "i"), ("g", "i"), ("f", "j"), (None, "j"), ("g", None)], "folder string, item string")
    assert [tuple(r) for r in alignment.common_items(items, "folder", "item").collect()] == [("i",)]
    assert sorted(r.item for r in alignment.common_items(items, "folder", "item", ["f"]).collect()) == ["i", "j"]
    truth = spark.createDataFrame([(1, "A"), (2, "B"), (None, "C")], "id int, t string")
    given = spark.createDataFrame([(2, "b"), (2, "c"), (3, "d"), (None, "e")], "id int, p string")
    status = sorted((r.status, r.t or "", r.p or "") for r in alignment.with_truth(truth, given, "id").collect())
    assert status == [("both", "B", "b"), ("both", "B", "c"), ("no prediction", "A", ""), ("no prediction", "C", ""), ("no truth", "", "d"), ("no truth", "", "e")]
    ranks = spark.createDataFrame([("GREEDY",), ("beam_3",), ("beam_x",), ("plain",), ("greedy_5",), (None,)], "s string").select("s", alignment.strategy_rank(F.col("s")).alias("r"))
    assert {r.s: r.r for r in ranks.collect()} == {"GREEDY": -1, "beam_3": 3, "beam_x": 9999, "plain": 9999, "greedy_5": -1, None: 9999}


def test_draws_are_even_and_independent(spark):
    draw = lambda n, *k: spectra.uniform(5, n, *k)
    id, pos = F.col("id"), F.col("id") % 100
    rows = spark.range(20000).select(draw("remove", id, pos).alias("a"), draw("shift", id, pos).alias("b"), draw("gate", id).alias("c"), spectra.uniform(6, "gate", id).alias("d")).toPandas()
    assert abs(rows.mean() - 0.5).max() < 0.01 and rows.min().min() >= 0 and rows.max().max() < 1
    assert abs(rows.corr().to_numpy() - np.eye(4)).max() < 0.03
    assert abs((rows.c < 0.3).mean() - 0.3) < 0.01


def test_augmentation_gate(spark):
    df = spark.range(40000).select((F.col("id") / 20).cast("long").alias("spectrum_id"), (F.col("id") % 20).alias("pos"), F.col("id").cast("double").alias("mz"), ((F.col("id") % 20 + 1) / 20).alias("intensity"))
    got = spectra.augment(df, probability=0.25, seed=3).groupBy("spectrum_id", "augmented").agg(F.count("*").alias("n"), F.max("intensity").alias("top")).collect()
    share = sum(r.augmented for r in got) / len(got)
    assert len(got) == 2000 and abs(share - 0.25) < 0.03
    assert {(r.augmented, r.n) for r in got} == {(True, 19), (False, 20)} and {r.top for r in got} == {1.0}  # 5 of 20 are weak, one of them goes
    assert spectra.augment(df, seed=3, dummy=True).drop("augmented").exceptAll(df).count() == 0


def test_rounds_equal_the_beam_in_memory(spark):
    """Random scores in which terminal residues, padding and early ends are likely, all charges, and misses of the mass."""
    r = np.random.default_rng(9)
    steps, targets = [], []
    size = len(K.RESIDUES) + 2
    for i in range(24):
        targets.append((i, float(300 + 40 * i), i % 4))
        for d in ("fwd", "rev"):
            for t in range(1, 8):
                x = r.normal(size=size) * 3
                x[[0, 1, 22, 23, 24, 25]] += r.choice([0, 3], 6)
                x = np.round(x, 1) if i % 2 else x  # ties
                steps += [(i, d, t, k, float(v)) for k, v in enumerate(x - np.log(np.exp(x).sum()) if i % 2 == 0 else x - 9)]
    steps = spark.createDataFrame(steps, "spectrum_id int, direction string, step int, token int, logp double")
    targets = spark.createDataFrame(targets, "spectrum_id int, precursor_mz double, charge int")
    for beams in (1, 5):
        key = lambda df: sorted((x.spectrum_id, x.direction, list(x.tokens), round(x.score, 9)) for x in df.collect())
        assert key(rounds.beam_rounds(steps, targets, beams, 2)) == key(decoding.beam_search(steps, targets, beams, 2))


def test_counters_merge(spark):
    r = random.Random(6)
    data = [[(r.choice("ab") if r.random() < 0.8 else None, r.choice(["x", "y", None]), r.choice([1, 2, 7, None])) for _ in range(40)] for _ in range(3)]
    tables = [spark.createDataFrame([(n, a, b, "more") for a, b, n in rows], "n int, a string, b string, `c.d` string") for rows in data]
    want = {}
    for rows in data:
        for a, b, n in rows:
            want[a, b] = want.get((a, b), 0) + (n or 0)
    assert {(x.a, x.b): x.n for x in alignment.merge_counters(tables, ["a", "b"]).collect()} == want
    assert alignment.merge_counters([t.limit(0) for t in tables], ["a", "b"]).count() == 0


def test_batches_merge_or_fail(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, x array<double>")
    two = spark.createDataFrame([([], 3)], "x array<double>, id long")
    assert sorted((r.id, r.x) for r in batches.merge_batches([one, two, one.limit(0)]).collect() if r.x is not None) == [(1, [1.0, 2.0]), (3, [])]
    for odd in (two.drop("x"), two.selectExpr("id", "cast(x as array<float>) as x"), two.selectExpr("*", "1 as y")):
        with pytest.raises(TypeError, match="batch 1 differs in [xy]"):
            batches.merge_batches([one, odd])
    with pytest.raises(ValueError, match="no batches"):
        batches.merge_batches([])


def test_predicates_of_tokens(spark):
    rows = {r.token: r for r in peptide.token_predicates(peptide.vocabulary(spark)).collect()}
    assert len(rows) == len(K.RESIDUES) + 2
    assert {t for t, r in rows.items() if r.special} == {"PAD", "SOS"}
    assert {t for t, r in rows.items() if r.n_term} == {"+42.011", "+43.006", "-17.027", "+43.006-17.027"}
    assert {t for t, r in rows.items() if r.negative} == {"-17.027"}
