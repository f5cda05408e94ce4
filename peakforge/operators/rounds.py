"""Beam search as rounds over tables: live beams meet the scores of the next step, the best survive, finished ones go to a history.

The state is a table (spectrum_id, direction, rank, score, tokens, mass), kept on shared storage between rounds; there are as
many rounds as steps. decoding.beam is the same search for one spectrum in memory, and says what the rules are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakforge.functions import constants as K
from peakforge.sources.scratch import written

KEYS = ("spectrum_id", "direction")
MASSES = (0.0, 0.0, *K.RESIDUES.values())
TERMINAL = tuple(i for i, t in enumerate(K.RESIDUES, 2) if t[0] in "+-")


def score_grid(steps: DataFrame) -> DataFrame:
    """(spectrum_id, direction, step, logp array by token) from rows (spectrum_id, direction, step, token, logp)."""
    rows = F.array_sort(F.collect_list(F.struct("token", "logp")))
    return steps.groupBy(*KEYS, "step").agg(rows.alias("rows")).select(*KEYS, "step", F.col("rows.logp").alias("logp"))


def start(precursors: DataFrame) -> DataFrame:
    """One empty beam for each row of precursors (spectrum_id, direction, precursor_mz, charge)."""
    return precursors.select(*KEYS, "precursor_mz", "charge", F.lit(0).alias("rank"), F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("tokens"), F.lit(0.0).alias("mass"))


def step_candidates(live: DataFrame, grid: DataFrame, beams: int) -> DataFrame:
    """The best `beams` continuations of each search by score, then parent, then token, numbered by place.

    A beam can't have more than `beams` among them, so each gives its own best before they are compared across beams.
    """
    each = F.transform("logp", lambda x, i: F.struct((-(F.col("score") + x)).alias("loss"), i.cast("int").alias("token")))
    joined = live.join(grid, list(KEYS)).withColumn("c", F.explode(F.slice(F.array_sort(each), 1, beams)))
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("c.loss", "rank", "c.token"))
    top = joined.withColumn("place", place).where(F.col("place") <= beams)
    mass = F.col("mass") + F.get(F.array(*[F.lit(m) for m in MASSES]), F.col("c.token"))
    return top.select(*KEYS, "precursor_mz", "charge", "rank", "place", F.col("c.token").alias("token"), (-F.col("c.loss")).alias("score"), F.concat("tokens", F.array("c.token")).alias("tokens"), mass.alias("mass"))


def with_quality(candidates: DataFrame, t: int, min_len: int, reverse: Column, ppm: float = 50.0, isotopes: int = 1) -> DataFrame:
    """Candidates of step t with done, bad (padding, a misplaced terminal token, too short an end), fits and over (too heavy for anything to follow)."""
    done = F.col("token") == K.SOS
    body = F.when(done, F.slice("tokens", 1, t - 1)).otherwise(F.col("tokens"))
    terminal = lambda x: x.isin(*TERMINAL)
    misplaced = F.when(reverse, F.exists(F.slice(body, F.lit(1), F.greatest(F.size(body) - 1, F.lit(0))), terminal)).otherwise(F.exists(F.slice(body, 2, t), terminal))
    charge, mz = F.col("charge"), F.col("precursor_mz")
    at = lambda m: F.when(charge > 0, m / charge + F.lit(K.PROTON)).otherwise(m)
    shifts = [mz if not i else mz - F.lit(i * K.ISOTOPE) / F.when(charge != 0, charge) for i in range(isotopes + 1)]
    error = lambda m: [(at(m) - s) / mz * 1e6 for s in shifts]
    every = lambda tests: F.coalesce(F.forall(F.array(*tests), lambda x: x), F.lit(False))
    some = lambda tests: F.coalesce(F.exists(F.array(*tests), lambda x: x), F.lit(False))
    whole = F.col("mass") + F.lit(K.H2O)
    fits = (charge != 0) & some([F.abs(e) < ppm for e in error(whole)]) if t >= 2 else F.lit(False)
    over = (charge != 0) & ~done & every([e > ppm for e in error(whole + F.lit(min(MASSES)))]) if t >= 2 else F.lit(False)
    bad = (F.col("token") == K.PAD) | (misplaced if t > 2 else F.lit(False)) | (done & F.lit(1 < t <= min_len))
    return candidates.withColumns({"done": done, "bad": bad, "fits": fits, "over": over})


def survivors(judged: DataFrame) -> DataFrame:
    """The beams that go on, ranked anew by place without gaps."""
    going = judged.where("not bad and not done and not over")
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("place")) - 1
    return going.select(*KEYS, "precursor_mz", "charge", rank.alias("rank"), "score", "tokens", "mass")


def finished(judged: DataFrame, t: int) -> DataFrame:
    """Ended beams of step t: exp(mean log-probability), less 1 unless it is an end whose mass fits."""
    value = F.exp(F.col("score") / t) - F.when(F.col("done") & F.col("fits"), 0.0).otherwise(1.0)
    tokens = F.when(F.col("done"), F.slice("tokens", 1, t - 1)).otherwise(F.col("tokens"))
    return judged.where("not bad and (done or over)").select(*KEYS, F.lit(t).alias("t"), "place", tokens.alias("tokens"), value.alias("value"))


def beam_rounds(steps: DataFrame, precursors: DataFrame, beams: int = 3, min_len: int = 4, reversed_direction: str = "fwd", ppm: float = 50.0, isotopes: int = 1) -> DataFrame:
    """(spectrum_id, direction, tokens, score), as decoding.beam_search: of each search the best of its history, the earlier at a tie; score -2 without any."""
    grid = written(score_grid(steps), "grid")
    searches = grid.select(*KEYS).distinct().join(precursors, "spectrum_id")
    live = first = written(start(searches), "live")
    history = None
    for t in range(1, (grid.agg(F.max("step")).first()[0] or 0) + 1):
        judged = with_quality(step_candidates(live, grid.where(F.col("step") == t), beams), t, min_len, F.col("direction") == reversed_direction, ppm, isotopes)
        judged = written(judged, f"round-{t}")
        ended = finished(judged, t)
        history = ended if history is None else history.unionByName(ended)
        live = survivors(judged)
    none = first.select(*KEYS, F.lit(0).alias("t"), F.lit(0).alias("place"), F.array().cast("array<int>").alias("tokens"), F.lit(-2.0).alias("value"))
    history = none if history is None else none.unionByName(history)
    best = history.groupBy(*KEYS).agg(F.max_by(F.struct("tokens", "value"), F.struct("value", -F.col("t"), -F.col("place"))).alias("b"))
    return best.select(*KEYS, "b.tokens", F.col("b.value").alias("score"))
