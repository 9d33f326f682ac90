import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelweave.operators import blend, knn, linear, metrics, thresholds

SCHEMA = "label string, row_idx bigint, y int, prob double"


def brute_prefix(frame, low, high):
    out = {}
    for label, g in frame.groupby("label"):
        g = g.sort_values(["prob", "row_idx"], ascending=[False, True])
        pos, tp, best = g["y"].sum(), 0, None
        for k, (p, y) in enumerate(zip(g["prob"], g["y"]), 1):
            tp += y
            if pos and low <= p <= high:
                f1 = 2.0 * tp / (pos + k)
                if best is None or f1 > best[1]:
                    best = (p, f1)
        out[label] = best
    return out


@pytest.mark.parametrize("places", [1, 2, 6])
def test_prefix_scan_equals_brute_force(spark, places):
    rng = np.random.default_rng(places)
    rows = []
    for j in range(12):
        n, rate = int(rng.integers(1, 400)), rng.choice([0.0, 0.02, 0.3, 1.0])
        y = (rng.random(n) < rate).astype(int)
        p = np.round(np.clip(rng.random(n) * rng.choice([0.04, 0.5, 1.0]) + 0.2 * y * rng.random(), 0, 1), places)
        rows += [(f"label_{j}", i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    frame = pd.DataFrame(rows, columns=["label", "row_idx", "y", "prob"])
    found = thresholds.best_prefix(spark.createDataFrame(frame), 0.05, 0.95).toPandas().set_index("label")
    for label, best in brute_prefix(frame, 0.05, 0.95).items():
        row = found.loc[label]
        if best is None:
            assert np.isnan(row["threshold"])
        else:
            assert (row["threshold"], row["f1"]) == best


def test_fallbacks(spark):
    rows = [("none", i, 0, 0.5) for i in range(5)] + [("outside", i, 1, 0.99) for i in range(6)]
    scores = spark.createDataFrame(rows, SCHEMA)
    prior = spark.createDataFrame([(0.33,)], "global_threshold double")
    got = thresholds.fit_thresholds(scores, prior, thresholds.ThresholdConfig()).toPandas().set_index("label")
    assert got.loc["none", "shrunk_threshold"] == 0.33
    assert got.loc["outside", "raw_threshold"] == 0.33


def test_global_grid_takes_the_lowest_of_equal_thresholds(spark):
    scores = spark.createDataFrame([("a", 0, 1, 0.8), ("a", 1, 0, 0.2)], SCHEMA)
    row = thresholds.best_global(scores, thresholds.ThresholdConfig()).first()
    assert (row["global_threshold"], row["macro_f1"]) == (0.21, 1.0)


def test_macro_f1_skips_labels_without_positives(spark):
    rows = [("a", 0, 1, 1), ("a", 1, 0, 1), ("b", 0, 0, 1), ("b", 1, 0, 0)]
    predicted = spark.createDataFrame(rows, "label string, row_idx bigint, y int, pred int")
    assert metrics.macro_f1(predicted).first()["macro_f1"] == pytest.approx(2 / 3)
    assert metrics.macro_f1(predicted.where("label = 'b'")).first()["macro_f1"] == 0.0


def test_auc_counts_ties_by_half_and_skips_constant_labels(spark):
    rows = [("a", 0, 1, 0.5), ("a", 1, 0, 0.5), ("a", 2, 0, 0.1), ("b", 0, 1, 0.3)]
    got = metrics.label_auc(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["label"], r["auc"]) for r in got] == [("a", 0.75)]


def test_misaligned_scores_raise(spark):
    a = spark.createDataFrame([("a", 0, 1, 0.5)], SCHEMA)
    metrics.require_aligned(a, a)
    with pytest.raises(ValueError):
        metrics.require_aligned(a, a.withColumn("y", F.lit(0)))
    with pytest.raises(ValueError):
        metrics.require_aligned(a, a.withColumn("label", F.lit("b")))


def test_selector_needs_the_margin(spark):
    # Model 0 reaches F1 2/3 on both labels, model 1 reaches 0.8 on "a" only.
    rows = []
    for label, alt in (("a", [0.9, 0.8, 0.7, 0.1]), ("b", [0.9, 0.1, 0.8, 0.2])):
        for i, (y, p0, p1) in enumerate(zip([1, 1, 0, 0], [0.9, 0.2, 0.8, 0.7], alt)):
            rows += [(label, i, y, p0, 0), (label, i, y, p1, 1)]
    models = spark.createDataFrame(rows, SCHEMA + ", model int")
    chosen = {r["label"]: r["model"] for r in blend.fit_selector(models).collect()}
    assert chosen == {"a": 1, "b": 0}
    kept = {r["label"]: r["model"] for r in blend.fit_selector(models, margin=0.5).collect()}
    assert kept == {"a": 0, "b": 0}


def test_adaptive_blend_without_valid_scores_takes_the_first_weight(spark):
    cells = spark.createDataFrame([("a", 0, 1, 0.99, 0.99), ("z", 0, 0, 0.5, 0.5)], "label string, row_idx bigint, y int, p0 double, p1 double")
    got = {r["label"]: r for r in blend.fit_adaptive(cells, [0.0, 0.5, 1.0]).collect()}
    assert got["a"]["weight"] == pytest.approx(0.4 * 300 / 301)
    assert got["z"]["weight"] == 0.4


def test_stack_reaches_the_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 2))
    y = (x[:, 0] + 0.3 * rng.standard_normal(400) > 0.7).astype(int)
    rows = [("a", i, int(b), float(u), float(v)) for i, (b, (u, v)) in enumerate(zip(y, x))]
    rows += [("const", i, 0, 0.5, 0.5) for i in range(10)]
    cells = spark.createDataFrame(rows, "label string, row_idx bigint, y int, p0 double, p1 double")
    params = {r["label"]: r for r in linear.fit_stack(cells, ["p0", "p1"]).collect()}
    assert params["const"]["constant"] and params["const"]["coef"] == [0.0, 0.0]
    w = np.array([*params["a"]["coef"], params["a"]["intercept"]])
    full = np.column_stack([x, np.ones(400)])
    p = 1 / (1 + np.exp(-full @ w))
    cw = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    assert np.abs(full.T @ (cw * (p - y)) + w).max() < 1e-6
    table = linear.fit_stack(cells, ["p0", "p1"])
    fixed = linear.apply_stack(cells, table, ["p0", "p1"]).where("label = 'const'").first()["prob"]
    raw = linear.apply_stack(cells, table, ["p0", "p1"], keep_constant=True).where("label = 'const'").first()["prob"]
    assert (fixed, raw) == (0.0, 0.5)


def test_label_without_parameters_raises(spark):
    cells = spark.createDataFrame([(0, 0, "a", 1, 0.9, 0.9, 0.2), (1, 0, "b", 0, 0.1, 0.1, 0.3)], "row_idx int, model int, label string, y int, prob double, p0 double, p1 double")
    every = spark.createDataFrame([("a", 0.5, 0.5, 0), ("b", 0.5, 0.5, 0)], "label string, threshold double, weight double, model int")
    runs = [
        lambda p: thresholds.apply_thresholds(cells, p, "threshold"),
        lambda p: blend.apply_adaptive(cells, p),
        lambda p: blend.apply_selector(cells, p),
    ]
    for run in runs:
        assert [r["pred"] for r in run(every).orderBy("row_idx").collect()] == [1, 0]
        with pytest.raises(Exception, match="no parameters for b"):
            run(every.where("label = 'a'")).collect()
    candidates = cells.withColumns({"k": F.lit(5), "power": F.lit(2.0), "base": F.col("p0")})
    params = every.withColumns({"k": F.lit(5), "power": F.lit(2.0)})
    assert blend.apply_label_specific(candidates, params).count() == 2
    with pytest.raises(Exception, match="no parameters for b"):
        blend.apply_label_specific(candidates, params.where("label = 'a'")).collect()
    with pytest.raises(Exception, match="no base score for row 1"):
        knn.with_base(cells.where("row_idx = 0"), candidates.drop("base"))


def test_histogram_keeps_values_nobody_chose(spark):
    params = spark.createDataFrame([("a", 2), ("b", 2), ("c", 0)], "label string, model int")
    rows = blend.histogram(params, "model", [0, 1, 2]).collect()
    assert {r["model"]: r["n_labels"] for r in rows} == {0: 1, 1: 0, 2: 2}


def test_stack_that_still_moves_raises(spark):
    cells = spark.createDataFrame([("a", i % 2, 0.1 * i) for i in range(20)] + [("b", int(i > 9), 0.1 * i) for i in range(20)], "label string, y int, p0 double")
    with pytest.raises(RuntimeError, match="still move"):
        linear.fit_stack(cells, ["p0"], max_iter=1)
    assert linear.fit_stack(cells, ["p0"]).count() == 2
