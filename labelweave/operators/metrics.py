"""Multi-label metrics over long ``(row_idx, label, y, prob | pred)`` tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions import scoring
from labelweave.operators.ordered import running_totals


def predict(scores: DataFrame, threshold: Column | float = 0.5) -> DataFrame:
    """Add ``pred`` = 1 where ``prob >= threshold``."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return scores.withColumn("pred", (F.col("prob") >= limit.cast(scores.schema["prob"].dataType)).cast("tinyint"))


def label_support(truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return truth.groupBy(*by, "label").agg(F.sum("y").cast("bigint").alias("support"))


def labels_per_sample(truth: DataFrame) -> DataFrame:
    return truth.groupBy("row_idx").agg(F.sum("y").cast("bigint").alias("n_labels"))


def label_counts(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per label: rows, support, predicted positives, true positives and F1, in one aggregation."""
    hit = F.col("y").cast("bigint") * F.col("pred").cast("bigint")
    counts = predictions.groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").cast("bigint").alias("support"),
        F.sum("pred").cast("bigint").alias("predicted"),
        F.sum(hit).cast("bigint").alias("tp"),
    )
    return counts.withColumn("f1", scoring.f1(F.col("tp"), F.col("support"), F.col("predicted")))


def macro(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fold ``label_counts`` rows: macro-F1 over labels that have positives, plus rates."""
    has_positives = F.col("support") > 0
    rows = F.max("n")
    return counts.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(has_positives, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
        (F.sum("support") / F.sum("n")).alias("true_positive_rate"),
        (F.sum("predicted") / F.sum("n")).alias("predicted_positive_rate"),
        (F.sum("support") / rows).alias("true_labels_per_sample"),
        (F.sum("predicted") / rows).alias("predicted_labels_per_sample"),
    )


def macro_f1(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return macro(label_counts(predictions, by), by).select(*by, "macro_f1")


def threshold_metrics(scores: DataFrame, threshold: Column | float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    return macro(label_counts(predict(scores, threshold), by), by)


def per_label_report(predictions: DataFrame) -> DataFrame:
    """The per-label table; F1 is null where a label has no positives."""
    counts = label_counts(predictions)
    return counts.select(
        "label",
        "support",
        F.when(F.col("support") > 0, F.col("f1")).alias("f1"),
        (F.col("predicted") / F.col("n")).alias("predicted_positive_rate"),
        (F.col("support") / F.col("n")).alias("true_positive_rate"),
    )


def label_auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC per label from mid-ranks; labels with one class only are absent.

    Equal scores are folded to one row before anything is ordered. Each block of equal scores
    counts the negatives below it in full and its own negatives by half.
    """
    keys = [*by, "label"]
    blocks = scores.groupBy(*keys, "prob").agg(
        F.sum("y").cast("bigint").alias("pos"),
        F.sum(F.lit(1) - F.col("y")).cast("bigint").alias("neg"),
    )
    ranked = running_totals(blocks, [F.col("prob").asc()], {"neg_upto": F.col("neg")}, keys)
    below = F.col("neg_upto") - F.col("neg") / 2
    return (
        ranked.groupBy(*keys)
        .agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.col("pos") * below).alias("wins"))
        .where("positives > 0 and negatives > 0")
        .select(*keys, (F.col("wins") / (F.col("positives").cast("double") * F.col("negatives"))).alias("auc"))
    )


def macro_auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return label_auc(scores, by).groupBy(*by).agg(F.coalesce(F.avg("auc"), F.lit(0.0)).alias("macro_auc"))


def prevalence_drift(truth: DataFrame, membership: DataFrame) -> DataFrame:
    """Mean absolute difference between a split part's label prevalence and the overall one.

    ``membership`` is ``(row_idx, part)``; every row belongs to one part, so overall counts are
    sums of the part counts and one aggregation serves both.
    """
    per_part = (
        truth.join(membership, "row_idx")
        .groupBy("part", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    )
    overall = per_part.groupBy("label").agg((F.sum("pos") / F.sum("n")).alias("overall"))
    return (
        per_part.join(F.broadcast(overall), "label")  # one row per label
        .groupBy("part")
        .agg(F.avg(F.abs(F.col("pos") / F.col("n") - F.col("overall"))).alias("drift"))
    )


def with_params(cells: DataFrame, params: DataFrame, on: Sequence[str] = ("label",)) -> DataFrame:
    """Every cell with the parameters of its label; a label that has none raises when its cells are read.

    Parameters are one row per label and fold, so they are broadcast. Their columns come as one
    struct ``params``, checked where it is used.
    """
    rest = F.struct(*[c for c in params.columns if c not in on]).alias("_found")
    joined = cells.join(F.broadcast(params.select(*on, rest)), list(on), "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no parameters for"), *[F.col(c).cast("string") for c in on]))
    return joined.withColumn("params", F.when(F.col("_found").isNull(), missing).otherwise(F.col("_found"))).drop("_found")


def misaligned_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells present in only one score table, or present in both with different truth."""
    a = left.select("row_idx", "label", F.col("y").alias("y_left"))
    b = right.select("row_idx", "label", F.col("y").alias("y_right"))
    return a.join(b, ["row_idx", "label"], "full_outer").where(~F.col("y_left").eqNullSafe(F.col("y_right")))


def require_aligned(left: DataFrame, right: DataFrame) -> None:
    if not misaligned_cells(left, right).isEmpty():
        raise ValueError("score tables differ in rows, labels or truth")


def running_loss(scores: DataFrame, batch: Column, by: Sequence[str] = (), least: float = 1e-6) -> DataFrame:
    """``by, batch, rows, loss, running_loss``: each batch's mean log-loss, and the mean over all rows up to it.

    Probabilities are kept ``least`` away from 0 and 1. Cells are folded to one row per batch before they
    are put in order, run by run.
    """
    p = F.greatest(F.lit(least), F.least(F.lit(1.0 - least), F.col("prob").cast("double")))
    cell = -F.log(F.when(F.col("y") == 1, p).otherwise(F.lit(1.0) - p))
    folded = scores.groupBy(*by, batch.alias("batch")).agg(F.count_distinct("row_idx").alias("rows"), F.avg(cell).alias("loss"))
    upto = Window.partitionBy(*by).orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return folded.withColumn("running_loss", F.sum(F.col("rows") * F.col("loss")).over(upto) / F.sum("rows").over(upto))
