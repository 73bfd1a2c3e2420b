"""Scalar score and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairmatch import fixed_values as fixed


def ninths(count: int) -> Column:
    """``count / 9`` as a double; a decimal quotient would round the cut-off."""
    return F.lit(float(count)) / F.lit(9.0)


def majority_positive(target: Column) -> Column:
    return target >= ninths(fixed.MAJORITY_NINTHS)


def unanimous(target: Column) -> Column:
    return target.isin(0.0, 1.0)


def target_stratum(target: Column) -> Column:
    """0 for at most 2/9, 1 for at least 7/9, 2 between."""
    return (
        F.when(target <= ninths(fixed.LOW_NINTHS), F.lit(0))
        .when(target >= ninths(fixed.HIGH_NINTHS), F.lit(1))
        .otherwise(F.lit(2))
    )


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null and NaN stay what they are (``greatest`` skips nulls)."""
    inside = F.greatest(F.least(value, F.lit(high)), F.lit(low))
    return F.when(value.isNull() | F.isnan(value), value).otherwise(inside)


def logistic(logit: Column, slope: Column | float = 1.0, intercept: Column | float = 0.0) -> Column:
    """``1 / (1 + exp(-x))`` of the affine logit, clipped to +-40."""
    slope = slope if isinstance(slope, Column) else F.lit(slope)
    intercept = intercept if isinstance(intercept, Column) else F.lit(intercept)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(slope * logit + intercept, -40.0, 40.0)))


def corrected_target(organizer: Column, teacher: Column, teacher_weight: float) -> Column:
    if not 0.0 <= teacher_weight <= 1.0:
        raise ValueError("teacher_weight must be in [0, 1]")
    return F.lit(teacher_weight) * teacher + F.lit(1.0 - teacher_weight) * organizer


def soft_cross_entropy(logit: Column, target: Column) -> Column:
    """Binary cross-entropy with logits in its overflow-free form."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def finite(value: Column) -> Column:
    """True for a usable number: not null, not NaN, not infinite."""
    number = value.cast("double")
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
