"""Blending of score tables: weight grids and per-label parameter fits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions import grids, scoring
from labelweave.operators import metrics
from labelweave.operators.thresholds import best_prefix

# Fixed value: distance to the threshold beyond which rounding of a weighted mean cannot matter.
_SETTLED = 1e-9


def align(*packs: DataFrame) -> DataFrame:
    """One row per cell with the packs' scores as ``p0, p1, ...``; a cell that one pack lacks raises."""
    out = packs[0].select("row_idx", "label", "y", F.col("prob").alias("p0"), F.lit(True).alias("_all"))
    for i, pack in enumerate(packs[1:], 1):
        other = pack.select("row_idx", "label", F.col("prob").alias(f"p{i}"), F.lit(True).alias("_own"))
        out = out.join(other, ["row_idx", "label"], "full_outer").withColumn("_all", F.col("_all") & F.col("_own")).drop("_own")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no score in one table for"), F.col("row_idx").cast("string"), F.col("label")))
    # the label itself depends on the check, so that no plan drops it
    checked = F.when(F.coalesce("_all", F.lit(False)), F.col("label")).otherwise(missing)
    return out.withColumn("label", checked).drop("_all")


def _grid(rows: Sequence[tuple], names: Sequence[str]) -> Column:
    """An array literal of grid points, each with its position."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("grid_id"), *[F.lit(v).alias(n) for n, v in zip(names, row)])
            for i, row in enumerate(rows)
        ]
    )


def _sweep(
    cells: DataFrame,
    grid: Sequence[tuple],
    names: Sequence[str],
    scores: Sequence[str],
    combine: Callable[[Sequence[Column]], Column],
    threshold: float,
    by: Sequence[str] = (),
) -> DataFrame:
    """Macro metrics at every grid point of a convex combination of ``scores``.

    A cell whose scores all lie on one side of the threshold is predicted alike at every point: it
    is counted once per label and its counts are added to all points afterwards. Only the other
    cells are expanded over the grid, and the map-side aggregation folds them to one row per
    (point, label) and task before anything is shuffled.
    """
    every_point = F.sequence(F.lit(0), F.lit(len(grid) - 1))
    highest, lowest = (f(*[F.col(c) for c in scores]) for f in (F.greatest, F.least))
    above = lowest >= threshold + _SETTLED
    settled = above | (highest < threshold - _SETTLED)
    values = [F.array(*[F.lit(row[i]) for row in grid]) for i in range(len(names))]
    prob = combine([F.get(v, F.col("point")) for v in values])
    points = cells.withColumn("point", F.explode(F.when(settled, F.array(F.lit(-1))).otherwise(every_point))).select(
        *by, "point", "label", "y",
        F.when(F.col("point") < 0, above).otherwise(prob >= threshold).cast("int").alias("pred"),
    )
    counts = metrics.label_counts(points, [*by, "point"])
    spread = F.explode(F.when(F.col("point") < 0, every_point).otherwise(F.array("point")))
    totals = counts.withColumn("grid_id", spread).groupBy(*by, "grid_id", "label").agg(
        *[F.sum(c).alias(c) for c in ("n", "support", "predicted", "tp")]
    )
    scored = totals.withColumn("f1", scoring.f1(F.col("tp"), F.col("support"), F.col("predicted")))
    named = [F.get(v, F.col("grid_id")).alias(name) for v, name in zip(values, names)]
    return metrics.macro(scored, [*by, "grid_id"]).select(*named, "*")


def two_way_grid(cells: DataFrame, step: float = 0.05, threshold: float = 0.5) -> DataFrame:
    """Macro-F1 of ``w*p0 + (1-w)*p1`` for every weight."""
    weights = [(w,) for w in grids.steps(0.0, 1.0, step)]
    mix = lambda w: scoring.blend(w[0], F.col("p0"), F.col("p1"))
    return _sweep(cells, weights, ["weight_a"], ["p0", "p1"], mix, threshold)


def three_way_grid(cells: DataFrame, step: float = 0.05, threshold: float = 0.5) -> DataFrame:
    """Macro-F1 of every weight triple that sums to one."""
    mix = lambda w: w[0] * F.col("p0") + w[1] * F.col("p1") + w[2] * F.col("p2")
    names = ["weight_a", "weight_b", "weight_c"]
    return _sweep(cells, grids.simplex(step), names, ["p0", "p1", "p2"], mix, threshold)


def best_point(grid: DataFrame, by: Sequence[str] = (), score: str = "macro_f1") -> DataFrame:
    """The first grid point with the best score (compared to twelve places)."""
    rest = [c for c in grid.columns if c not in by]
    top = F.max(F.struct(F.round(score, 12).alias("key"), (-F.col("grid_id")).alias("first"), F.struct(*rest).alias("row")))
    return grid.groupBy(*by).agg(top.alias("top")).select(*by, "top.row.*")


def ranked_points(grid: DataFrame, n: int = 10) -> DataFrame:
    """The n best grid points, ties in grid order."""
    return grid.orderBy(F.round("macro_f1", 12).desc(), "grid_id").limit(n)


def tune_knn_blend(candidates: DataFrame, step: float = 0.05, threshold: float = 0.5) -> DataFrame:
    """For every (k, power): macro-F1 of kNN alone and the best weight of the other model."""
    weights = [(w,) for w in grids.steps(0.0, 1.0, step)]
    mix = lambda w: scoring.blend(w[0], F.col("base"), F.col("prob"))
    grid = _sweep(candidates, weights, ["base_weight"], ["base", "prob"], mix, threshold, ["k", "power"])
    # Weight 0 is the first grid point: kNN alone.
    alone = grid.where("grid_id = 0").select("k", "power", F.col("macro_f1").alias("knn_macro_f1"))
    best = best_point(grid, ["k", "power"])
    return best.join(F.broadcast(alone), ["k", "power"]).select(  # one row per setting
        "k", "power", "knn_macro_f1", "base_weight", F.col("macro_f1").alias("blend_macro_f1"),
        "predicted_labels_per_sample",
    )


def fit_adaptive(
    cells: DataFrame,
    weights: Sequence[float],
    global_weight: float = 0.40,
    global_threshold: float = 0.48,
    shrink_k: float = 300.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Per-label blend weight and threshold, judged by the best prefix F1 and shrunk to defaults.

    A label whose scores never fall in range scores 0 at every weight and takes the first weight.
    """
    points = cells.withColumn("g", F.explode(_grid([(float(w),) for w in weights], ["w"])))
    points = points.select(
        *by, "label", "row_idx", "y", F.col("g.grid_id").alias("grid_id"), F.col("g.w").alias("w"),
        scoring.blend(F.col("g.w"), F.col("p0"), F.col("p1")).alias("prob"),
    )
    found = best_prefix(points, 0.05, 0.95, [*by, "label", "grid_id", "w"]).select(
        *by, "label", "support", "grid_id", "w",
        F.coalesce("threshold", F.lit(global_threshold)).alias("t"),
        F.coalesce("f1", F.lit(0.0)).alias("f1"),
    )
    best = best_point(found, [*by, "label"], "f1")
    shrunk = lambda c, prior: F.when(
        F.col("support") > 0, scoring.shrink(F.col(c), F.lit(prior), F.col("support"), shrink_k)
    ).otherwise(F.lit(prior))
    return best.select(
        *by, "label", "support", shrunk("w", global_weight).alias("weight"), shrunk("t", global_threshold).alias("threshold")
    )


def apply_adaptive(cells: DataFrame, params: DataFrame, on: Sequence[str] = ("label",)) -> DataFrame:
    found = metrics.with_params(cells, params.select(*on, "weight", "threshold"), on).select("*", "params.*").drop("params")
    joined = found.withColumn("prob", scoring.blend(F.col("weight"), F.col("p0"), F.col("p1")))
    return joined.withColumn("pred", (F.col("prob") >= F.col("threshold")).cast("tinyint"))


def _score_at(points: DataFrame, found: DataFrame, keys: Sequence[str], fallback: float) -> DataFrame:
    """Re-score each candidate by the F1 of ``prob >= threshold`` itself, ties included."""
    limits = found.select(*keys, F.coalesce("threshold", F.lit(fallback)).alias("t"))
    predicted = points.join(limits, list(keys)).withColumn("pred", (F.col("prob") >= F.col("t")).cast("tinyint"))
    hit = F.col("y").cast("bigint") * F.col("pred").cast("bigint")
    counts = predicted.groupBy(*keys).agg(
        F.sum("y").cast("bigint").alias("support"),
        F.sum("pred").cast("bigint").alias("predicted"),
        F.sum(hit).alias("tp"),
        F.first("t").alias("t"),
    )
    return counts.withColumn("f1", scoring.f1(F.col("tp"), F.col("support"), F.col("predicted")))


def fit_label_specific(
    candidates: DataFrame,
    weights: Sequence[float] = (0.2, 0.3, 0.4, 0.5, 0.6),
    fallback: tuple[int, float, float, float] = (40, 4.0, 0.40, 0.48),
    shrink_k: float = 500.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Per-label k, power, blend weight and threshold over the full candidate grid.

    Candidates are tried k outermost, then power, then weight; the first best F1 wins. Weight and
    threshold are shrunk towards the fallback, k and power are not.
    """
    k0, power0, w0, t0 = fallback
    grid = _grid([(float(w),) for w in weights], ["w"])
    points = candidates.withColumn("g", F.explode(grid)).select(
        *by, "label", "row_idx", "y", "k", "power", F.col("g.w").alias("w"),
        scoring.blend(F.col("g.w"), F.col("base"), F.col("prob")).alias("prob"),
    )
    keys = [*by, "label", "k", "power", "w"]
    scored = _score_at(points, best_prefix(points, 0.05, 0.95, keys), keys, t0)
    order = F.struct(F.col("f1").alias("f1"), (-F.col("k")).alias("k"), (-F.col("power")).alias("p"), (-F.col("w")).alias("w"), F.col("t").alias("t"))
    best = scored.groupBy(*by, "label").agg(F.max(order).alias("b"), F.max("support").alias("support"))
    seen = F.col("support") > 0
    shrunk = lambda value, prior: F.when(seen, scoring.shrink(value, F.lit(prior), F.col("support"), shrink_k)).otherwise(F.lit(prior))
    return best.select(
        *by, "label", "support",
        F.when(seen, -F.col("b.k")).otherwise(k0).alias("k"),
        F.when(seen, -F.col("b.p")).otherwise(F.lit(power0)).alias("power"),
        shrunk(-F.col("b.w"), w0).alias("weight"),
        shrunk(F.col("b.t"), t0).alias("threshold"),
    )


def apply_label_specific(candidates: DataFrame, params: DataFrame, on: Sequence[str] = ("label",)) -> DataFrame:
    """Keep each label's chosen (k, power) scores, blend and predict."""
    found = metrics.with_params(candidates, params.select(*on, "k", "power", "weight", "threshold"), on)
    chosen = found.where("k = params.k and power = params.power").select("*", "params.weight", "params.threshold").drop("params")
    prob = scoring.blend(F.col("weight"), F.col("base"), F.col("prob"))
    return chosen.withColumn("prob", prob).withColumn("pred", (F.col("prob") >= F.col("threshold")).cast("tinyint"))


def stack_models(*packs: DataFrame) -> DataFrame:
    """Score tables on top of each other with the position of each as ``model``."""
    out = packs[0].withColumn("model", F.lit(0))
    for i, pack in enumerate(packs[1:], 1):
        out = out.unionByName(pack.withColumn("model", F.lit(i)))
    return out


def selector_scores(models: DataFrame, fallback: float = 0.48, by: Sequence[str] = ()) -> DataFrame:
    """``by, label, model, support, threshold, f1``: every model's best threshold for a label and the F1 it gives."""
    keys = [*by, "label", "model"]
    scored = _score_at(models, best_prefix(models, 0.02, 0.98, keys), keys, fallback)
    return scored.select(*keys, "support", F.col("t").alias("threshold"), "f1")


def fit_selector(
    models: DataFrame, fallback: float = 0.48, margin: float = 0.01, by: Sequence[str] = ()
) -> DataFrame:
    """Per label: the model to use and its threshold; model 0 stays unless beaten by ``margin``."""
    return choose_models(selector_scores(models, fallback, by), fallback, margin, by)


def choose_models(scored: DataFrame, fallback: float = 0.48, margin: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """The choice of ``fit_selector`` from ``selector_scores``."""
    scored = scored.withColumnRenamed("threshold", "t")
    best = scored.groupBy(*by, "label").agg(
        F.max("support").alias("support"),
        F.max(F.struct(F.col("f1").alias("f1"), (-F.col("model")).alias("m"), F.col("t").alias("t"))).alias("top"),
        F.max(F.when(F.col("model") == 0, F.struct(F.col("f1").alias("f1"), F.col("t").alias("t")))).alias("home"),
    )
    seen = F.col("support") > 0
    switch = (F.col("top.m") != 0) & (F.col("top.f1") >= F.col("home.f1") + F.lit(margin))
    return best.select(
        *by, "label", "support",
        F.when(seen & switch, -F.col("top.m")).otherwise(0).alias("model"),
        F.when(~seen, F.lit(fallback)).when(switch, F.col("top.t")).otherwise(F.col("home.t")).alias("threshold"),
        F.when(seen, F.col("top.f1")).otherwise(0.0).alias("best_f1"),
        F.when(seen, F.col("home.f1")).otherwise(0.0).alias("home_f1"),
    )


def apply_selector(models: DataFrame, params: DataFrame, on: Sequence[str] = ("label",)) -> DataFrame:
    found = metrics.with_params(models, params.select(*on, "model", "threshold"), on)
    chosen = found.where("model = params.model").select("*", "params.threshold").drop("params")
    return chosen.withColumn("pred", (F.col("prob") >= F.col("threshold")).cast("tinyint"))


def histogram(params: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """How many labels chose each value; ``values`` adds those that no label chose, with 0."""
    chosen = params.groupBy(column).agg(F.count(F.lit(1)).alias("n_labels"))
    if values is None:
        return chosen
    every = params.sparkSession.createDataFrame([(v,) for v in values], params.select(column).schema)
    return every.join(chosen, column, "left").fillna(0, ["n_labels"])


def weight_summary(params: DataFrame) -> DataFrame:
    return params.agg(F.avg("weight").alias("mean_weight"), F.percentile("weight", F.lit(0.5)).alias("median_weight"))
