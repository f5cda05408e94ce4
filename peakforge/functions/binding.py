"""Names for values inside expressions: a lambda's body is evaluated for each element, whatever it refers to outside too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))
