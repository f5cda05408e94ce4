"""Queries over the rounds of beam search, with SQL that unrolls them."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakforge.functions import constants as K
from peakforge.operators import decoding, rounds
from peakforge.plans.catalog import _LOGP, ORACLE, _logp, query

_BEAMS, _MIN = 3, 4
_META = "(VALUES " + ", ".join(f"({i}, CAST({m!r} AS DOUBLE))" for i, m in enumerate(rounds.MASSES)) + ") AS meta(token, mass)"


def _error(mass: str, i: int) -> str:
    return f"(({mass}) / charge + {K.PROTON!r}::DOUBLE - (precursor_mz - {i * K.ISOTOPE!r}::DOUBLE / charge)) / precursor_mz * 1000000"


def _unrolled(upto: int) -> str:
    """CTEs of all rounds: c<t> the candidates by place, j<t> with their flags, l<t> what lives on."""
    terminal = ", ".join(map(str, rounds.TERMINAL))
    sql = f"""WITH lp AS ({_LOGP}), meta AS (SELECT * FROM {_META}),
l0 AS (SELECT spectrum_id, direction, 500.0::DOUBLE + spectrum_id * 3.7::DOUBLE AS precursor_mz, spectrum_id % 3 + 1 AS charge, 0 AS rank, 0::DOUBLE AS score, CAST([] AS INT[]) AS tokens, 0::DOUBLE AS mass
  FROM (SELECT DISTINCT spectrum_id, direction FROM lp) s)"""
    whole, heavier = f"mass + {K.H2O!r}::DOUBLE", f"mass + {K.H2O!r}::DOUBLE + {min(rounds.MASSES)!r}::DOUBLE"
    for t in range(1, upto + 1):
        misplaced = f"len(list_filter(body, lambda x, i: x IN ({terminal}) AND CASE WHEN direction = 'fwd' THEN i < len(body) ELSE i > 1 END)) > 0" if t > 2 else "false"
        fits = f"(abs({_error(whole, 0)}) < 50 OR abs({_error(whole, 1)}) < 50)" if t >= 2 else "false"
        over = f"(token <> 1 AND {_error(heavier, 0)} > 50 AND {_error(heavier, 1)} > 50)" if t >= 2 else "false"
        sql += f""", c{t} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id, direction ORDER BY score DESC, rank, token) AS place
  FROM (SELECT l.spectrum_id, l.direction, precursor_mz, charge, rank, p.token, score + logp AS score, list_append(tokens, p.token) AS tokens, l.mass + m.mass AS mass
    FROM l{t - 1} l JOIN lp p ON p.spectrum_id = l.spectrum_id AND p.direction = l.direction AND p.step = {t} JOIN meta m ON m.token = p.token) x) y WHERE place <= {_BEAMS}),
j{t} AS (SELECT *, token = 1 AS done, token = 0 OR {misplaced} OR (token = 1 AND {str(1 < t <= _MIN).lower()}) AS bad, {fits} AS fits, {over} AS over
  FROM (SELECT *, CASE WHEN token = 1 THEN tokens[:-2] ELSE tokens END AS body FROM c{t}) z),
l{t} AS (SELECT spectrum_id, direction, precursor_mz, charge, row_number() OVER (PARTITION BY spectrum_id, direction ORDER BY place) - 1 AS rank, score, tokens, mass FROM j{t} WHERE NOT bad AND NOT done AND NOT over)"""
    return sql


_HISTORY = " UNION ALL ".join(f"SELECT spectrum_id, direction, {t} AS t, place, body, exp(score / {t}) - CASE WHEN done AND fits THEN 0 ELSE 1 END AS value FROM j{t} WHERE NOT bad AND (done OR over)" for t in range(1, 9))
_DECODED = _unrolled(8) + f""", h AS ({_HISTORY}), b AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id, direction ORDER BY value DESC, t, place) AS k FROM h),
decoded AS (SELECT l0.spectrum_id, l0.direction, coalesce(array_to_string(body, ','), '') AS tokens, coalesce(value, -2) AS score FROM l0 LEFT JOIN b ON b.spectrum_id = l0.spectrum_id AND b.direction = l0.direction AND k = 1)"""
ORACLE["beam_decode"] = _DECODED + " SELECT spectrum_id, direction, tokens, round(score, 6) AS score FROM decoded"


def _targets(steps):
    ids = steps.select("spectrum_id").distinct()
    return ids.select("spectrum_id", (F.lit(500.0) + F.col("spectrum_id") * 3.7).alias("precursor_mz"), (F.col("spectrum_id") % 3 + 1).alias("charge"))


def _judged(spark, d, upto: int):
    """Candidates of one round with their flags."""
    steps = _logp(spark, d)
    grid = rounds.score_grid(steps)
    live = rounds.start(grid.select(*rounds.KEYS).distinct().join(_targets(steps), "spectrum_id"))
    for t in range(1, upto + 1):
        judged = rounds.with_quality(rounds.step_candidates(live, grid.where(F.col("step") == t), _BEAMS), t, _MIN, F.col("direction") == "fwd")
        live = rounds.survivors(judged)
    return judged


@query(_unrolled(2) + " SELECT spectrum_id, direction, CAST(place AS INT) AS place, array_to_string(tokens, ',') AS tokens, round(score, 6) AS score, round(mass, 4) AS mass FROM j2")
def beam_step_topk(spark, d):
    """The best continuations of the second step, over all parents."""
    text = F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens")
    return _judged(spark, d, 2).select("spectrum_id", "direction", "place", text, F.round("score", 6).alias("score"), F.round("mass", 4).alias("mass"))


@query(_unrolled(6) + " SELECT spectrum_id, direction, CAST(place AS INT) AS place, array_to_string(tokens, ',') AS tokens, done, bad, fits, over FROM j6")
def beam_qc(spark, d):
    """What the rules say of the candidates of the sixth step."""
    text = F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens")
    return _judged(spark, d, 6).select("spectrum_id", "direction", "place", text, "done", "bad", "fits", "over")


@query(_DECODED + " SELECT spectrum_id, direction, tokens, round(score, 6) AS score FROM decoded")
def beam_rounds(spark, d):
    """The whole search as rounds over tables."""
    steps = _logp(spark, d)
    found = rounds.beam_rounds(steps, _targets(steps), _BEAMS, _MIN)
    return found.select("spectrum_id", "direction", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"), F.round("score", 6).alias("score"))


_RESOLVED = _DECODED + """, r AS (SELECT spectrum_id, max(tokens) FILTER (direction = 'fwd') AS fwd_peptide, max(score) FILTER (direction = 'fwd') AS fwd_score, max(tokens) FILTER (direction = 'rev') AS rev_peptide, max(score) FILTER (direction = 'rev') AS rev_score
  FROM decoded GROUP BY spectrum_id HAVING count(*) = 2), e AS (SELECT *, CASE WHEN fwd_score = -2 THEN '' ELSE fwd_peptide END AS f, CASE WHEN rev_score = -2 THEN '' ELSE rev_peptide END AS v FROM r),
w AS (SELECT *, CASE WHEN f = '' AND v <> '' THEN false WHEN f <> '' AND v = '' THEN true ELSE fwd_score >= rev_score END AS ahead FROM e)"""
_PICKED = "CASE WHEN ahead THEN f ELSE v END AS pred_peptide, round(CASE WHEN ahead THEN fwd_score ELSE rev_score END, 6) AS pred_score, CASE WHEN ahead THEN 'fwd' ELSE 'rev' END AS direction FROM w"
ORACLE["resolve_directions"] = _RESOLVED + f" SELECT spectrum_id, fwd_peptide, round(fwd_score, 6) AS fwd_score, rev_peptide, round(rev_score, 6) AS rev_score, {_PICKED}"


@query(_RESOLVED + f" SELECT spectrum_id, {_PICKED}")
def resolved_rounds(spark, d):
    """Both directions of one search side by side by a conditional aggregate, and the better one."""
    steps = _logp(spark, d)
    found = rounds.beam_rounds(steps, _targets(steps), _BEAMS, _MIN)
    pick = lambda c, x: F.max(F.when(F.col("direction") == x, F.col(c)))
    text = F.array_join(F.col("tokens").cast("array<string>"), ",")
    rows = found.withColumn("peptide", text).groupBy("spectrum_id").agg(*[pick(c, x).alias(f"{x}_{c}") for x in ("fwd", "rev") for c in ("peptide", "score")], F.count("*").alias("n")).where("n = 2")
    return decoding.resolve(rows).select("spectrum_id", "pred_peptide", F.round("pred_score", 6).alias("pred_score"), "direction")
