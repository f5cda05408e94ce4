"""Precision, recall and their curve over rows with a number of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.operators.ordered import running

EPS = 1e-8


def three(pairs: DataFrame, *by: str) -> DataFrame:
    """aa_precision, aa_recall, peptide_recall of rows (n_match, n_true, n_pred, whole)."""
    return pairs.groupBy(*by).agg(
        (F.sum("n_match") / (F.sum("n_pred") + EPS)).alias("aa_precision"), (F.sum("n_match") / (F.sum("n_true") + EPS)).alias("aa_recall"), (F.sum(F.col("whole").cast("int")) / (F.count("*") + EPS)).alias("peptide_recall"),
    )


def seven(pairs: DataFrame, by: str) -> DataFrame:
    """three(), peptide_precision, precision and recall of modified residues, and the area under the curve; a row without a prediction (not given) matches nothing and predicts nothing."""
    none = {c: F.when(F.col("given"), F.col(c)).otherwise(0) for c in ("n_match", "n_pred", "ptm_pred", "ptm_true_match", "ptm_pred_match")}
    rows = pairs.withColumns(none | {"whole": F.col("whole") & F.col("given")})
    sums = ("n_match", "n_pred", "n_true", "ptm_pred_match", "ptm_pred", "ptm_true_match", "ptm_true")
    totals = [F.sum(c).alias(c) for c in sums] + [F.sum(F.col("whole").cast("int")).alias("whole"), F.count("*").alias("n"), F.sum("area").alias("pr_auc")]
    ratio = {"aa_precision": ("n_match", "n_pred"), "aa_recall": ("n_match", "n_true"), "peptide_recall": ("whole", "n"), "peptide_precision": ("whole", "n"), "ptm_precision": ("ptm_pred_match", "ptm_pred"), "ptm_recall": ("ptm_true_match", "ptm_true")}
    return curve(rows, by).groupBy(by).agg(*totals).select(by, *[(F.col(a) / (F.col(b) + EPS)).alias(c) for c, (a, b) in ratio.items()], "pr_auc")


def curve(pairs: DataFrame, by: str, ranges: int | None = None) -> DataFrame:
    """Precision and recall after each row by falling score (then spectrum_id) of rows (score, spectrum_id, whole), and the area below since the row before.

    A data set is summed in ranges of scores, so it may be of any length.
    """
    hit = F.col("whole").cast("long")
    c = running(pairs, [by], [F.col("score").desc(), F.col("spectrum_id")], ranges, hits=hit, rank=F.lit(1).cast("long"))
    own = F.coalesce(hit, F.lit(0))
    precision, recall = F.col("hits") / F.col("rank"), F.col("hits") / F.col("rank_total")
    before = F.when(F.col("rank") > 1, (F.col("hits") - own) / (F.col("rank") - 1))
    area = own / F.col("rank_total") * (precision + before) / 2
    return c.withColumns({"precision": precision, "recall": recall, "area": area}).drop("hits", "hits_total", "rank_total")


def pr_auc(pairs: DataFrame, by: str, ranges: int | None = None) -> DataFrame:
    """Area under the curve by trapezoids from its first point on."""
    return curve(pairs, by, ranges).groupBy(by).agg(F.sum("area").alias("pr_auc"))


def with_mean(rows: DataFrame, name: str, values: list[str]) -> DataFrame:
    """rows and a row "mean" with the unweighted mean of each value."""
    return rows.unionByName(rows.agg(F.lit("mean").alias(name), *[F.avg(v).alias(v) for v in values]))


def thresholded(residues: DataFrame, t: float) -> DataFrame:
    """Precision and recall of rows (score, ok) with a score above t; null where nothing is counted."""
    above = F.col("score") > t
    hit = F.count_if(above & F.col("ok"))
    return residues.agg(F.try_divide(hit, F.count_if(above)).alias("precision"), F.try_divide(hit, F.count("*")).alias("recall"))
