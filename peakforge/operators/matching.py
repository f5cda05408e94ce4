"""Mass-tolerant matching of predicted and true residues, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakforge.functions.binding import let
from peakforge.functions.peptide import masses

CUMULATIVE, SINGLE = 0.5, 0.1


_MEETS = "array<struct<at:int, i:int, j:int, ok:boolean>>"


def _meets(p: Column, q: Column) -> Column:
    """Walk two mass arrays from their beginnings; an entry for each place where their sums meet: at (the larger index), i, j, ok (the residues match)."""

    def step(s: Column, _: Column) -> Column:
        return let(F.struct(F.get(p, s["i"]).alias("x"), F.get(q, s["j"]).alias("y")), lambda v: F.when(v["x"].isNull() | v["y"].isNull(), s).otherwise(move(s, v["x"], v["y"])))

    def move(s: Column, x: Column, y: Column) -> Column:
        a, b = s["a"] + x, s["b"] + y
        kind = F.when(F.abs(a - b) < CUMULATIVE, 0).when(b > a, 1).otherwise(2)
        return let(kind, lambda k: turn(s, x, y, a, b, k))

    def turn(s: Column, x: Column, y: Column, a: Column, b: Column, k: Column) -> Column:
        here = F.struct(F.greatest(s["i"], s["j"]).alias("at"), s["i"].alias("i"), s["j"].alias("j"), (F.abs(x - y) < SINGLE).alias("ok"))
        return F.struct(
            (s["i"] + F.when(k != 2, 1).otherwise(0)).alias("i"), (s["j"] + F.when(k != 1, 1).otherwise(0)).alias("j"),
            F.when(k != 2, a).otherwise(s["a"]).alias("a"), F.when(k != 1, b).otherwise(s["b"]).alias("b"),
            F.when(k == 0, F.concat(s["met"], F.array(here))).otherwise(s["met"]).cast(_MEETS).alias("met"),
        )

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.array().cast(_MEETS).alias("met"))
    return F.aggregate(F.sequence(F.lit(1), F.size(p) + F.size(q)), start, step)["met"]


def _masses(true: Column, predicted: Column, body) -> Column:
    return let(masses(true), lambda p: let(masses(predicted), lambda q: body(p, q)))


def _flags(met: Column, n: Column) -> Column:
    return let(F.transform(F.filter(met, lambda m: m["ok"]), lambda m: m["at"]), lambda hit: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_contains(hit, k)))


def _longer(true: Column, predicted: Column) -> Column:
    return F.greatest(F.size(true), F.size(predicted))


def match(true: Column, predicted: Column, mode: str = "forward") -> Column:
    """Flag for each place of the longer peptide (token arrays). Modes: forward; backward, the same from the ends; best, as best_match."""
    walk = lambda t, q: _masses(t, q, lambda x, y: _flags(_meets(x, y), _longer(x, y)))
    if mode == "forward":
        return walk(true, predicted)
    if mode == "backward":
        return F.reverse(walk(F.reverse(true), F.reverse(predicted)))
    if mode == "best":
        return best_match(true, predicted)
    raise ValueError(f"no such mode: {mode}")


def best_pairs(true: Column, predicted: Column, assign: bool = True) -> Column:
    """Matched residues (at, i, j, ok): from the beginnings, then from the ends for as long as both sides lie at or behind the first unmatched place.

    Where the second walk meets (assign), or where it matches, it replaces what the first found at that place.
    """

    def back(p: Column, q: Column, stop: Column) -> Column:
        rest = lambda a: F.reverse(F.slice(a, stop + 1, F.size(a)))
        i, j = (lambda m: F.size(p) - 1 - m["i"]), (lambda m: F.size(q) - 1 - m["j"])
        met = let(rest(p), lambda x: let(rest(q), lambda y: _meets(x, y)))
        return F.transform(met, lambda m: F.struct(F.greatest(i(m), j(m)).alias("at"), i(m).alias("i"), j(m).alias("j"), m["ok"].alias("ok"))).cast(_MEETS)

    def join(ahead: Column, behind: Column) -> Column:
        over = F.transform(behind if assign else F.filter(behind, lambda m: m["ok"]), lambda m: m["at"])
        return let(over, lambda o: F.concat(F.filter(ahead, lambda m: m["ok"] & ~F.array_contains(o, m["at"])), F.filter(behind, lambda m: m["ok"])))

    def both(p: Column, q: Column) -> Column:
        first = lambda ahead: let(F.array_position(_flags(ahead, _longer(p, q)), False).cast("int"), lambda k: F.when(k == 0, _longer(p, q)).otherwise(k - 1))
        return let(_meets(p, q), lambda ahead: let(first(ahead), lambda stop: let(back(p, q, stop), lambda behind: join(ahead, behind))))

    return _masses(true, predicted, both)


def best_match(true: Column, predicted: Column, assign: bool = True) -> Column:
    """The flags of best_pairs, one for each place of the longer peptide."""
    return _flags(best_pairs(true, predicted, assign), _longer(true, predicted))


def count_among(pairs: Column, tokens: Column, side: str, names: tuple[str, ...]) -> Column:
    """How many matched residues of one side (i: true, j: predicted) are among names, as modified ones."""
    return F.size(F.filter(pairs, lambda m: F.get(tokens, m[side]).isin(*names)))


def count_true(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x))
