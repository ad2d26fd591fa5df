"""Arithmetic with IEEE results: Spark's own operators raise or give null on division by zero, and order NaN as largest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def ieee_div(a: Column, b: Column) -> Column:
    """a / b of doubles; x/0 is an infinity with the signs of both sides, 0/0 is NaN."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b != 0, b))


def int_div(a: Column, b: Column) -> Column:
    """Integer division, cut towards zero; division by zero is an error."""
    return F.call_function("div", a, b)


def real(v: Column) -> Column:
    """Null for NaN, so that aggregates pass it over."""
    return F.when(~F.isnan(v), v)


def max_real(v: Column) -> Column:
    return F.coalesce(F.max(real(v)), F.lit(-INF))


def min_real(v: Column) -> Column:
    return F.coalesce(F.min(real(v)), F.lit(INF))


def sample_variance(v: Column) -> Column:
    """NaN for a single value."""
    return F.coalesce(F.var_samp(v), F.lit(NAN))


def sample_deviation(v: Column) -> Column:
    variance = F.var_samp(v)
    return F.when(variance.isNull(), F.lit(NAN)).when(variance <= 0, F.lit(0.0)).otherwise(F.sqrt(variance))


def sigmoid(v: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))
