"""Rounding and number helpers that agree with Python's arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def formatted(x: Column, digits: int) -> Column:
    """A number as text with so many decimals, rounded as Python's format does."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits))


def python_round(x: Column, digits: int = 2) -> Column:
    """``round(x, digits)`` as Python has it: of the exact binary value, ties to even."""
    return formatted(x, digits).cast("double")


def python_int(x: Column) -> Column:
    """``int(round(x))``: halves to even."""
    return F.rint(x).cast("int")


def percentage(value: Column, total: Column, digits: int = 2) -> Column:
    """``value`` in percent of ``total``, rounded; 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(python_round(F.try_divide(value * F.lit(100.0), total), digits))


def ratio(value: Column, total: Column) -> Column:
    """A quotient that is 0 where the divisor is."""
    return F.coalesce(F.try_divide(value.cast("double"), total.cast("double")), F.lit(0.0))


def threshold_grid(start: float = 0.05, step: float = 0.010000000000000002, n: int = 91) -> Column:
    """The grid of thresholds: ``start + i * step``, a float at a time."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(start) + i.cast("double") * F.lit(step))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def softmax_second(z0: Column, z1: Column) -> Column:
    """The second of two logits' probabilities, shifted so that nothing overflows."""
    top = F.greatest(z0, z1)
    return F.exp(z1 - top) / (F.exp(z0 - top) + F.exp(z1 - top))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
