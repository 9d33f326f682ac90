"""Threshold search: the exact per-label F1 scan, the global grid, shrinkage and cross-fitting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions import scoring
from labelweave.operators import metrics
from labelweave.operators.folds import calibration_rows
from labelweave.operators.ordered import running_totals
from labelweave.session import materialize

_BINS = 512


@dataclass(frozen=True)
class ThresholdConfig:
    """The default search grid, per-label bounds and shrinkage."""

    grid_min: float = 0.10
    grid_max: float = 0.90
    grid_step: float = 0.01
    min_threshold: float = 0.05
    max_threshold: float = 0.95
    shrink_k: float = 200.0
    min_support: int = 5
    n_splits: int = 2


def best_prefix(scores: DataFrame, low: float, high: float, by: Sequence[str] = ("label",)) -> DataFrame:
    """Per group, the score at which cutting the ranking gives the best F1.

    Rows are ranked by ``prob`` descending, then ``row_idx``; every prefix that ends on a score in
    ``[low, high]`` is a candidate, also inside a block of equal scores; the first best one wins.
    Returns ``by, support, threshold, f1`` with null threshold where nothing qualifies.

    One aggregation folds the scores into equal-width bins. The bin totals bound the F1 of every
    prefix ending in a bin from above, and give the exact F1 of the prefix ending at its last row.
    Only bins whose bound reaches the best of those exact values can hold the winner, and only
    their rows are ordered.
    """
    by = list(by)
    binned = scores.select(
        *by,
        "row_idx",
        F.col("prob").alias("prob"),
        F.col("y").cast("bigint").alias("y"),
        F.least(F.lit(_BINS - 1), F.greatest(F.lit(0), F.floor(F.col("prob") * _BINS))).cast("int").alias("bin"),
    )
    bins = materialize(
        binned.groupBy(*by, "bin").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("y").alias("pos"),
            F.min("prob").alias("lowest"),
            F.max("prob").alias("highest"),
        )
    )
    group = Window.partitionBy(*by)
    above = group.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bounded = (
        bins.withColumn("support", F.sum("pos").over(group))
        .withColumn("rows_above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        .withColumn("tp_above", F.coalesce(F.sum("pos").over(above), F.lit(0)))
    )
    tp_end = F.lit(2.0) * (F.col("tp_above") + F.col("pos"))
    reach = tp_end / (F.col("support") + F.col("rows_above") + F.greatest(F.col("pos"), F.lit(1)))
    at_end = tp_end / (F.col("support") + F.col("rows_above") + F.col("n"))
    inside = (F.col("lowest") >= low) & (F.col("highest") <= high)
    promising = (
        bounded.withColumn("reach", reach)
        .withColumn("floor", F.max(F.when(inside, at_end)).over(group))
        .where((F.col("support") > 0) & (F.col("highest") >= low) & (F.col("lowest") <= high))
        .where(F.col("floor").isNull() | (F.col("reach") >= F.col("floor")))
        .select(*by, "bin", "support", "rows_above", "tp_above")
    )
    ranked = running_totals(
        binned.join(promising, [*by, "bin"]),
        [F.col("prob").desc(), F.col("row_idx").asc()],
        {"rows": F.lit(1).cast("bigint"), "tp": F.col("y")},
        [*by, "bin"],
    )
    rows = F.col("rows_above") + F.col("rows")
    score = F.lit(2.0) * (F.col("tp_above") + F.col("tp")) / (F.col("support") + rows)
    best = (
        ranked.where(F.col("prob").between(low, high))
        .groupBy(*by)
        .agg(F.max(F.struct(score.alias("f1"), (-rows).alias("first"), F.col("prob").alias("t"))).alias("top"))
        .select(*by, F.col("top.t").alias("threshold"), F.col("top.f1").alias("f1"))
    )
    support = bins.groupBy(*by).agg(F.sum("pos").alias("support"))
    return support.join(best, by, "left")


def grid_f1(
    scores: DataFrame, low: float, high: float, step: float, by: Sequence[str] = ()
) -> DataFrame:
    """Macro-F1 at every grid threshold, from one aggregation of the scores.

    Each score is replaced by the number of grid values it reaches; counts per (label, reached) are
    then all that is needed, at most grid size + 1 rows per label.
    """
    size = int((high - low) / step + 0.5) + 1

    def grid_value(i):
        return F.round(F.lit(low) + i * F.lit(step), 6)

    nearest = F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((F.col("prob") - low) / step + 0.5)))
    reached = F.when(F.col("prob") >= grid_value(nearest), nearest + 1).otherwise(nearest)
    counts = (
        scores.select(*by, "label", F.col("y").cast("bigint").alias("y"), reached.cast("int").alias("reached"))
        .groupBy(*by, "label", "reached")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    )
    hit = F.col("reached") > F.col("i")
    per_label = (
        counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        .groupBy(*by, "label", "i")
        .agg(
            F.sum("n").alias("n"),
            F.sum("pos").alias("support"),
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("predicted"),
            F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        )
        .withColumn("f1", scoring.f1(F.col("tp"), F.col("support"), F.col("predicted")))
    )
    return metrics.macro(per_label, [*by, "i"]).withColumn("threshold", grid_value(F.col("i")))


def best_global(scores: DataFrame, cfg: ThresholdConfig, by: Sequence[str] = ()) -> DataFrame:
    """The lowest grid threshold that reaches the best macro-F1, with the F1 it gives."""
    grid = grid_f1(scores, cfg.grid_min, cfg.grid_max, cfg.grid_step, by)
    top = F.max(
        F.struct(
            F.round("macro_f1", 12).alias("key"),
            (-F.col("i")).alias("first"),
            F.col("threshold").alias("t"),
            F.col("macro_f1").alias("f1"),
            F.col("predicted_labels_per_sample").alias("labels"),
        )
    )
    return grid.groupBy(*by).agg(top.alias("top")).select(
        *by,
        F.col("top.t").alias("global_threshold"),
        F.col("top.f1").alias("macro_f1"),
        F.col("top.labels").alias("predicted_labels_per_sample"),
    )


def fit_thresholds(
    scores: DataFrame, global_thresholds: DataFrame, cfg: ThresholdConfig, by: Sequence[str] = ()
) -> DataFrame:
    """Per-label thresholds: raw optimum and the one shrunk towards the global threshold.

    ``global_thresholds`` is ``(by, global_threshold)``: one row per fold, or one row in all.
    """
    found = best_prefix(scores, cfg.min_threshold, cfg.max_threshold, [*by, "label"])
    prior = global_thresholds.select(*by, "global_threshold")
    if by:
        joined = found.join(F.broadcast(prior), list(by))  # one row per fold
    else:
        joined = found.withColumn("global_threshold", prior.scalar())
    fallback = F.col("global_threshold")
    local = F.when(F.col("support") >= cfg.min_support, F.coalesce("threshold", fallback)).otherwise(fallback)
    weighted = scoring.shrink(F.col("raw"), fallback, F.col("support"), cfg.shrink_k)
    return joined.withColumn("raw", local).select(
        *by,
        "label",
        "support",
        F.col("raw").alias("raw_threshold"),
        F.when(F.col("support") >= cfg.min_support, weighted).otherwise(fallback).alias("shrunk_threshold"),
    )


def fit_simple(scores: DataFrame, low: float, high: float, fallback: float, shrink_k: float, by: Sequence[str] = ()) -> DataFrame:
    """Per-label thresholds shrunk towards a constant; labels without positives keep the constant."""
    found = best_prefix(scores, low, high, [*by, "label"])
    local = F.coalesce("threshold", F.lit(fallback))
    return found.select(
        *by,
        "label",
        "support",
        F.when(F.col("support") > 0, scoring.shrink(local, F.lit(fallback), F.col("support"), shrink_k))
        .otherwise(F.lit(fallback))
        .alias("threshold"),
    )


def apply_thresholds(scores: DataFrame, thresholds: DataFrame, column: str, on: Sequence[str] = ("label",)) -> DataFrame:
    """Predict with per-label thresholds (a table of one row per label and fold: broadcast)."""
    found = metrics.with_params(scores, thresholds.select(*on, column), on)
    return metrics.predict(found, F.col("params")[column]).drop("params")


def crossfit(scores: DataFrame, cfg: ThresholdConfig) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions for ``scores`` with a ``fold`` column, and the thresholds per fold.

    Every fold's global and per-label thresholds are fitted on the other folds' rows, all folds in
    one pass.
    """
    calibration = calibration_rows(scores, cfg.n_splits)
    global_t = best_global(calibration, cfg, ["cal_fold"])
    fitted = fit_thresholds(calibration, global_t, cfg, ["cal_fold"]).withColumnRenamed("cal_fold", "fold")
    predictions = apply_thresholds(scores, fitted, "shrunk_threshold", ["fold", "label"])
    return predictions, fitted


def scale_variants(thresholds: DataFrame, scales: Sequence[float]) -> DataFrame:
    """Each threshold multiplied by each scale, kept within [0.001, 0.999]."""
    factors = F.explode(F.array(*[F.lit(float(s)) for s in scales]))
    return thresholds.withColumn("scale", factors).withColumn(
        "threshold", scoring.scaled_threshold(F.col("threshold"), F.col("scale"))
    )
