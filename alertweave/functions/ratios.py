"""The three conventions for undefined ratios, and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def finite_or_null(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def f1_or_zero(precision: Column, recall: Column) -> Column:
    """Harmonic mean; 0 when either side is undefined or both are 0."""
    return F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def binary_entropy(rate: Column) -> Column:
    inside = (rate > 0) & (rate < 1)
    return F.when(inside, -(rate * F.log2(rate) + (1 - rate) * F.log2(1 - rate))).otherwise(0.0)


def effective_class_weight(positive: Column, negative: Column, beta: float) -> Column:
    """Positive share of the inverse effective-number class weights; null without both classes."""
    if not 0 <= beta < 1:
        raise ValueError("beta must be in [0, 1)")
    def weight(n: Column) -> Column:
        return F.lit(1.0 - beta) / (F.lit(1.0) - F.pow(F.lit(float(beta)), n))
    share = weight(positive) / (weight(positive) + weight(negative))
    return F.when((positive > 0) & (negative > 0), share)
