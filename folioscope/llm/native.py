"""Column helpers of the operators that run on built-in expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for each row and use it several times: a lambda's variable is never computed anew."""
    return F.transform(F.array(value), body)[0]


def positions(n: Column) -> Column:
    """0 .. n-1, an empty array for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null text gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
