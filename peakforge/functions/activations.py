"""Activation functions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of selu.
SELU_SCALE, SELU_ALPHA = 1.0507009873554805, 1.6732632423543772


#: Odd divisors of the series below, the last first; enough for values up to 6 in size, beyond which it is 1 to double precision.
_DIVISORS = tuple(range(301, 1, -2))


def error_function(x: Column) -> Column:
    """The Gauss error function by its series 2 x exp(-x^2) / sqrt(pi) (1 + t/3 (1 + t/5 (1 + ...))) with t = 2 x^2, all of whose terms are positive."""
    t = 2 * x * x
    series = F.aggregate(F.array(*[F.lit(float(d)) for d in _DIVISORS]), F.lit(1.0), lambda a, d: 1 + a * t / d)
    return F.when(F.isnan(x), x).when(F.abs(x) > 6, F.signum(x)).otherwise(2 / math.sqrt(math.pi) * x * F.exp(-x * x) * series)


def gelu(x: Column) -> Column:
    """x times the normal distribution function at x."""
    return x * 0.5 * (1 + error_function(x / math.sqrt(2)))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def selu(x: Column) -> Column:
    return SELU_SCALE * F.when(x > 0, x).otherwise(SELU_ALPHA * (F.exp(x) - 1))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def gated(x: Column, gate: Column) -> Column:
    """silu of one projection times the other."""
    return silu(x) * gate


_BY_NAME = {"relu": relu, "selu": selu, "gelu": gelu, "silu": silu, "swilu": gated}


def activation(name: str, *x: Column) -> Column:
    """The activation of that name; swilu takes two columns, its projections."""
    if name not in _BY_NAME:
        raise ValueError(f"no such activation: {name}")
    return _BY_NAME[name](*x)
