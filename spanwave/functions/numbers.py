"""Numeric helpers and aggregate expressions with the statistics conventions of the features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def to_number(value: Column) -> Column:
    """Numeric value, or NULL for text that is none and for NaN."""
    return nan_to_null(value.try_cast("double"))


def to_int(value: Column, field: str = "value") -> Column:
    """Integer part of a numeric value; NULL or NaN is an error that names ``field``."""
    number = nan_to_null(value.cast("double"))
    return F.when(number.isNotNull(), number.cast("bigint")).otherwise(
        F.raise_error(F.lit(f"no whole number in {field}")).cast("bigint")
    )


def round_half_even(value: Column, digits: int = 6) -> Column:
    return F.when(~F.isnan(value), F.bround(value, digits))


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; NULL below three values, 0 for a constant."""
    n = F.count(value).cast("double")
    population = F.when(F.var_pop(value) > 0, F.skewness(value)).otherwise(F.lit(0.0))
    return F.when(n > 2, population * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values, 0 for a constant."""
    n = F.count(value).cast("double")
    corrected = F.try_divide(((n + 1) * F.kurtosis(value) + 6) * (n - 1), (n - 2) * (n - 3))
    return F.when(n > 3, F.when(F.var_pop(value) > 0, corrected).otherwise(F.lit(0.0)))


def rms(value: Column) -> Column:
    return F.sqrt(F.avg(value * value))


def crest_factor(value: Column) -> Column:
    return F.when(rms(value) > 0, F.max(F.abs(value)) / rms(value))


def magnitude(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def angle(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def rotate(re: Column, im: Column, by: Column) -> tuple[Column, Column]:
    """Multiply ``re + i*im`` by ``exp(-i*by)``."""
    return re * F.cos(by) + im * F.sin(by), im * F.cos(by) - re * F.sin(by)


def times_conjugate(re_a: Column, im_a: Column, re_b: Column, im_b: Column) -> tuple[Column, Column]:
    return re_a * re_b + im_a * im_b, im_a * re_b - re_a * im_b
