"""Greedy and mass-constrained beam decoding over tables of step scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakforge.functions import constants as K

_MASS = np.array([0.0, 0.0, *K.RESIDUES.values()])
_TERM = np.array([False, False, *(t[0] in "+-" for t in K.RESIDUES)])


def greedy(steps: DataFrame) -> DataFrame:
    """(spectrum_id, direction, tokens, score) from rows (spectrum_id, direction, step, token, logp).

    The best token of each step (smallest id on ties) up to the first SOS; score = exp(mean log-probability), SOS included.
    """
    best = steps.groupBy("spectrum_id", "direction", "step").agg(F.max(F.struct("logp", (-F.col("token")).alias("t"))).alias("b"))
    w = Window.partitionBy("spectrum_id", "direction").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    best = best.select("spectrum_id", "direction", "step", F.col("b.logp").alias("logp"), (-F.col("b.t")).alias("token"))
    live = best.withColumn("over", F.coalesce(F.max((F.col("token") == K.SOS).cast("int")).over(w), F.lit(0))).where("over = 0")
    out = live.groupBy("spectrum_id", "direction").agg(F.sort_array(F.collect_list(F.struct("step", "token"))).alias("t"), F.exp(F.avg("logp")).alias("score"))
    return out.select("spectrum_id", "direction", F.filter(F.col("t.token"), lambda x: x != K.SOS).alias("tokens"), "score")


def beam(logp: np.ndarray, mz: float, charge: int, reverse: bool, beams: int, min_len: int, ppm: float = 50.0, isotopes: int = 1) -> tuple[list[int], float]:
    """Best (tokens, score) of one spectrum and direction; logp is (steps, vocabulary). Score -2 without a candidate.

    reverse: tokens run from the C-terminal end. A finished candidate whose mass fits scores exp(mean logp), any other
    that less 1. Ties go to the better parent, then to the smaller token. An end at the first step is the empty
    peptide, whatever min_len is. Without a charge no mass fits, and none is too large.
    """
    shifts = mz - np.arange(isotopes + 1) * K.ISOTOPE / (charge or np.nan)
    error = lambda m: ((m / charge + K.PROTON if charge > 0 else m) - shifts) / mz * 1e6
    lightest = _MASS.min()
    live: list[tuple[float, list[int], float]] = [(0.0, [], 0.0)]
    best: tuple[list[int], float] = ([], -2.0)
    for t, row in enumerate(logp, 1):
        flat = np.concatenate([s + row for s, _, _ in live])
        order = np.argsort(-flat, kind="stable")[:beams]
        later = []
        for k in order:
            _, tokens, mass = live[k // len(row)]
            token, score = int(k % len(row)), float(flat[k])
            done = token == K.SOS
            bad = token == K.PAD
            seq = [*tokens, token]
            if t > 2 and not bad:
                body = seq[:-1] if done else seq
                terms = [i for i, x in enumerate(body) if _TERM[x]]
                if reverse:
                    bad = any(i < len(body) - 1 for i in terms)
                else:
                    bad = any(i > 0 for i in terms)
            m = mass + _MASS[token]
            fits = over = False
            if t >= 2:
                fits = bool((np.abs(error(m + K.H2O)) < ppm).any())
                over = not done and bool((error(m + K.H2O + lightest) > ppm).all())
            short = done and 1 < t <= min_len
            if bad or short:
                continue
            if done or over:
                value = np.exp(score / t) - (0.0 if done and fits else 1.0)
                if value > best[1]:
                    best = (tokens if done else seq, float(value))
            else:
                later.append((score, seq, m))
        live = later
        if not live:
            break
    return best


def beam_search(steps: DataFrame, precursors: DataFrame, beams: int = 3, min_len: int = 4, reversed_direction: str = "fwd") -> DataFrame:
    """(spectrum_id, direction, tokens, score) of rows as in greedy, with precursors (spectrum_id, precursor_mz, charge)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="step", columns="token", values="logp").sort_index().to_numpy()
        first = pdf.iloc[0]
        tokens, score = beam(grid, first.precursor_mz, int(first.charge), first.direction == reversed_direction, beams, min_len)
        return pd.DataFrame({"spectrum_id": [first.spectrum_id], "direction": [first.direction], "tokens": [tokens], "score": [score]})

    joined = steps.join(precursors, "spectrum_id")
    return joined.groupBy("spectrum_id", "direction").applyInPandas(one, "spectrum_id int, direction string, tokens array<int>, score double")


def resolve(pairs: DataFrame) -> DataFrame:
    """pred_peptide, pred_score, direction from (fwd_peptide, fwd_score, rev_peptide, rev_score): forward wins ties, score -2 is empty."""
    empty = lambda d: F.when(F.col(f"{d}_score") == -2, "").otherwise(F.col(f"{d}_peptide"))
    p = pairs.withColumn("fwd_peptide", empty("fwd")).withColumn("rev_peptide", empty("rev"))
    fwd = F.when((F.col("fwd_peptide") == "") & (F.col("rev_peptide") != ""), False).when((F.col("fwd_peptide") != "") & (F.col("rev_peptide") == ""), True).otherwise(F.col("fwd_score") >= F.col("rev_score"))
    pick = lambda c: F.when(fwd, F.col(f"fwd_{c}")).otherwise(F.col(f"rev_{c}"))
    return p.select(*pairs.columns, pick("peptide").alias("pred_peptide"), pick("score").alias("pred_score"), F.when(fwd, "fwd").otherwise("rev").alias("direction"))


def best_tokens(steps: DataFrame) -> DataFrame:
    """The likeliest token of each step, the smaller id at a tie."""
    return steps.groupBy("spectrum_id", "direction", "step").agg(F.max_by("token", F.struct("logp", -F.col("token"))).alias("token"))


def smoothed_loss(steps: DataFrame, smoothing: float, *by: str) -> DataFrame:
    """Mean cross-entropy with label smoothing of rows (spectrum_id, direction, step, token, logp, label); padding labels don't count."""
    each = steps.where(F.col("label") != K.PAD).groupBy("spectrum_id", "direction", "step").agg(F.max(F.when(F.col("token") == F.col("label"), F.col("logp"))).alias("hit"), F.avg("logp").alias("mean"))
    return each.groupBy(*by).agg(F.avg(-(1 - smoothing) * F.col("hit") - smoothing * F.col("mean")).alias("loss"))


def whole_accuracy(steps: DataFrame, *by: str) -> DataFrame:
    """Share of peptides all of whose places with keep have the right token: rows (spectrum_id, direction, token, label, keep)."""
    whole = steps.groupBy("spectrum_id", "direction").agg(F.every((F.col("token") == F.col("label")) | ~F.col("keep")).alias("whole"))
    return whole.groupBy(*by).agg(F.avg(F.col("whole").cast("int")).alias("accuracy"))
