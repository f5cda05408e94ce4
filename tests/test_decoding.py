import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.functions import activations as A
from peakforge.functions import constants as K
from peakforge.functions import sizing
from peakforge.operators import decoding

MASS = [0.0, 0.0, *K.RESIDUES.values()]
SOME = (K.SOS, 2, 3, 11)


def exhaustive(logp, mz, charge, min_len):
    """Every sequence of tokens of SOME, without terminal modifications, against the rules of the beam."""
    best = ([], -2.0)

    def errors(tokens, more=0.0):
        m = sum(MASS[t] for t in tokens) + K.H2O + more
        return [(m / charge + K.PROTON - (mz - k * K.ISOTOPE / charge)) / mz * 1e6 for k in (0, 1)]

    def over(tokens):
        return len(tokens) >= 2 and all(e > 50 for e in errors(tokens, min(MASS)))

    for n in range(1, len(logp) + 1):
        for tokens in itertools.product(SOME, repeat=n):
            if K.SOS in tokens[:-1] or any(over(tokens[:k]) for k in range(2, n)):
                continue
            done = tokens[-1] == K.SOS
            if (done and 1 < n <= min_len) or not (done or over(tokens)):
                continue
            fits = done and n >= 2 and any(abs(e) < 50 for e in errors(tokens))
            value = math.exp(sum(logp[i][t] for i, t in enumerate(tokens)) / n) - (not fits)
            if value > best[1]:
                best = ([t for t in tokens if t != K.SOS], value)
    return best


def test_wide_beam_is_exhaustive():
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(40):
        logp = np.full((5, len(MASS)), -1e9)
        raw = rng.normal(size=(5, len(SOME)))
        logp[:, SOME] = raw - np.log(np.exp(raw).sum(axis=1, keepdims=True))
        charge = int(rng.integers(1, 4))
        mass = sum(MASS[t] for t in rng.choice(SOME[1:], 3)) + K.H2O
        mz = mass / charge + K.PROTON
        tokens, score = decoding.beam(logp, mz, charge, bool(rng.integers(2)), 4000, 2)
        want = exhaustive(logp.tolist(), mz, charge, 2)
        assert tokens == want[0] and abs(score - want[1]) < 1e-9
        found += score > 0
    assert found


def test_end_at_the_first_step_and_no_charge():
    logp = np.full((5, len(MASS)), -30.0)
    logp[:, K.SOS] = np.log(0.99)
    tokens, score = decoding.beam(logp, 400.0, 2, False, 5, 2)
    assert tokens == [] and abs(score - (0.99 - 1)) < 1e-9
    assert decoding.beam(logp, 400.0, 0, False, 5, 2) == (tokens, score)


def test_activations(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (1.5,), (None,)], "x double")
    got = [r.g for r in df.select(A.activation("gelu", F.col("x")).alias("g")).collect()]
    assert [round(g, 6) for g in got[:3]] == [-0.0455, 0.0, 1.399789] and got[3] is None
    with pytest.raises(ValueError, match="no such activation"):
        A.activation("tanh", F.col("x"))


def test_batch_size(spark):
    n = spark.range(1).select(sizing.batch_size(F.lit(1.0), F.lit(0)), sizing.batch_size(F.lit(24.0 * 2**30), F.lit(0)), sizing.batch_size(F.lit(24.0 * 2**30), F.lit(10))).first()
    assert n[0] == 1 and n[1] % 8 == 0 and n[1] > n[2] > 8
