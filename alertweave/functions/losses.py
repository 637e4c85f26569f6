"""Per-row loss terms for evaluation tables; average them with `avg`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertweave.functions.ratios import sigmoid


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def binary_cross_entropy(logit: Column, target: Column) -> Column:
    return softplus(logit) - target * logit


def weighted_cross_entropy(logit: Column, target: Column, positive_weight: float, negative_weight: float) -> Column:
    weight = F.when(target > 0, F.lit(float(positive_weight))).otherwise(F.lit(float(negative_weight)))
    return weight * binary_cross_entropy(logit, target)


def focal_loss(logit: Column, target: Column, gamma: float, alpha: Column | float | None = None) -> Column:
    p = sigmoid(logit)
    hit = p * target + (1 - p) * (1 - target)
    loss = F.pow(1 - hit, F.lit(float(gamma))) * binary_cross_entropy(logit, target)
    if alpha is None:
        return loss
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return (a * target + (1 - a) * (1 - target)) * loss


def pairwise_logistic(margin: Column) -> Column:
    return softplus(-margin)
