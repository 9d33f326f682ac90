"""Score arithmetic shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Similarity floor used in weights and in the weight-sum denominator, logit clip.
WEIGHT_FLOOR = 1e-8
LOGIT_LIMIT = 30.0


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def rounded(value: Column, places: int) -> Column:
    """``F.round`` of a double, which makes a decimal of every value: here only of those near a tie, and of large ones."""
    scaled = value * F.lit(10.0**places)
    clear = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-4)
    return F.when(clear, F.floor(scaled + 0.5).cast("double") / F.lit(10.0**places)).otherwise(F.round(value, places))


def similarity(cosine: Column) -> Column:
    return clip(cosine, 0.0, 1.0)


def neighbor_weight(sim: Column, power: Column | float) -> Column:
    return F.pow(sim + F.lit(WEIGHT_FLOOR), power if isinstance(power, Column) else F.lit(float(power)))


def blend(weight: Column, left: Column, right: Column) -> Column:
    return weight * left + (F.lit(1.0) - weight) * right


def shrink(local: Column, prior: Column, support: Column, strength: float) -> Column:
    """Pull a per-label value towards a prior; the pull weakens as support grows."""
    share = support / (support + F.lit(float(strength)))
    return share * local + (F.lit(1.0) - share) * prior


def f1(tp: Column, support: Column, predicted: Column) -> Column:
    total = support + predicted
    return F.when(total == 0, F.lit(0.0)).otherwise(F.lit(2.0) * tp / total)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def clipped_sigmoid(z: Column) -> Column:
    return sigmoid(clip(z, -LOGIT_LIMIT, LOGIT_LIMIT))


def positive_weight(positives: Column, rows: Column, ceiling: float = 20.0) -> Column:
    """Loss weight of the positive class: negatives per positive, kept within [1, ceiling]."""
    return clip((rows - positives) / F.greatest(positives, F.lit(1)), 1.0, ceiling)


def balanced_weight(y: Column, positives: Column, rows: Column) -> Column:
    """n / (2 * n_class), the usual balanced class weight."""
    return rows / (F.lit(2.0) * F.when(y == 1, positives).otherwise(rows - positives))


def scaled_threshold(threshold: Column, scale: Column) -> Column:
    return clip(threshold * scale, 0.001, 0.999)
