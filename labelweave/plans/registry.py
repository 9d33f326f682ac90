"""Every query by name: ``(spark, sf_dir) -> DataFrame`` over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions import grids, scoring, sequences
from labelweave.operators import (
    audit,
    blend,
    folds,
    joint,
    knn,
    labelgraph,
    linear,
    metrics,
    mlp,
    neighbors,
    pooling,
    splits,
    tfidf,
    thresholds,
)
from labelweave.session import materialize
from labelweave.sources import fixtures as fx
from labelweave.sources import packs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DEFAULT = thresholds.ThresholdConfig()
KNN_K, KNN_POWER = 20, 2.0
K_GRID = [5, 10, 20, 40, 80]
TUNE_POWERS, LABEL_POWERS = [1.0, 2.0, 4.0], [2.0, 4.0, 6.0]
BETAS = [0.0, 0.025, 0.05, 0.075, 0.10, 0.15, 0.20, 0.25, 0.30]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so results compare across engines."""
    return df.select(
        [F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# ---------------------------------------------------------------- audit


@query
def numeric_ids(spark, sf):
    return fx.proteins(spark, sf).select("row_idx", "protein_id", sequences.numeric_id(F.col("protein_id")).alias("num_id"))


@query
def audit_summary(spark, sf):
    train, test = fx.train_test(spark, sf)
    a = audit.table_summary(train).withColumn("side", F.lit("train"))
    return rounded(a.unionByName(audit.table_summary(test).withColumn("side", F.lit("test"))))


@query
def audit_length_stats(spark, sf):
    return rounded(audit.length_stats(fx.proteins(spark, sf)))


@query
def audit_nonstandard(spark, sf):
    return audit.nonstandard_residues(fx.proteins(spark, sf))


@query
def audit_labels(spark, sf):
    return rounded(audit.label_summary(fx.truth(spark, sf)))


@query
def audit_overlap(spark, sf):
    return audit.overlap(*fx.train_test(spark, sf))


@query
def audit_id_ranges(spark, sf):
    return audit.id_ranges(fx.proteins(spark, sf))


@query
def audit_tail(spark, sf):
    train, test = fx.train_test(spark, sf)
    return rounded(audit.tail_summary(train, fx.truth(spark, sf), splits.tail(train, test)))


@query
def dup_groups(spark, sf):
    return audit.duplicate_sequences(fx.proteins(spark, sf))


# ---------------------------------------------------------------- splits and folds


@query
def split_random_group(spark, sf):
    return splits.random_group(fx.train_test(spark, sf)[0])


@query
def split_tail(spark, sf):
    return splits.tail(*fx.train_test(spark, sf))


@query
def split_tail_overlap(spark, sf):
    train, test = fx.train_test(spark, sf)
    return splits.tail_overlap(train, splits.tail(train, test)).select("row_idx")


@query
def split_tail_clean(spark, sf):
    return splits.tail_clean(*fx.train_test(spark, sf))


@query
def split_chronological(spark, sf):
    return splits.chronological(*fx.train_test(spark, sf))


@query
def split_drift(spark, sf):
    train, _ = fx.train_test(spark, sf)
    return rounded(metrics.prevalence_drift(fx.truth(spark, sf), splits.random_group(train)))


@query
def split_leakage(spark, sf):
    train, test = fx.train_test(spark, sf)
    named = {
        "random": splits.random_group(train),
        "tail": splits.tail(train, test),
        "tail_clean": splits.tail_clean(train, test),
        "chronological": splits.chronological(train, test),
    }
    counts = [
        splits.leaked_groups(train, s).agg(F.count(F.lit(1)).alias("leaked")).withColumn("split", F.lit(name))
        for name, s in named.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query
def split_metadata(spark, sf):
    train, test = fx.train_test(spark, sf)
    made = {"random": splits.random_group(train), "tail": splits.tail(train, test), "tail_clean": splits.tail_clean(train, test), "chronological": splits.chronological(train, test)}
    made = {name: materialize(split) for name, split in made.items()}
    return rounded(splits.metadata(train, test, fx.truth(spark, sf), made))


@query
def group_kfold(spark, sf):
    return folds.group_folds(fx.proteins(spark, sf), DEFAULT.n_splits)


# ---------------------------------------------------------------- sequence features


@query
def composition_features(spark, sf):
    p = fx.proteins(spark, sf)
    return rounded(p.select("row_idx", *[c.alias(n) for n, c in sequences.composition(F.col("sequence")).items()]))


@query
def clean_sequence(spark, sf):
    return fx.proteins(spark, sf).select("row_idx", sequences.clean_sequence(F.col("sequence")).alias("cleaned"))


@query
def chunks(spark, sf):
    cleaned = sequences.clean_sequence(F.col("sequence"))
    return fx.proteins(spark, sf).select("row_idx", F.posexplode(sequences.chunks(cleaned, 1022, 512)).alias("chunk_no", "chunk"))


@query
def encode_ids(spark, sf):
    ids = sequences.token_ids(F.col("sequence"), 1536)
    return fx.proteins(spark, sf).select("row_idx", F.array_join(ids.cast("array<string>"), " ").alias("ids"))


@query
def char_ngrams(spark, sf):
    return tfidf.term_counts(fx.proteins(spark, sf), tfidf.TfidfConfig())


def _document_split(spark, sf):
    """(fit, eval) documents of the chronological split."""
    train, test = fx.train_test(spark, sf)
    tagged = train.join(splits.chronological(train, test), "row_idx")
    tagged = materialize(tagged)
    return tagged.where("part = 'train'").drop("part"), tagged.where("part = 'val'").drop("part")


@query
def vocab_topn(spark, sf):
    cfg = tfidf.TfidfConfig()
    fit, _ = _document_split(spark, sf)
    vocab = tfidf.vocabulary(fit, cfg)
    return rounded(vocab.select("term", F.col("term_idx").cast("bigint").alias("term_idx"), "df", "cf", "idf"))


def _tfidf_rows(vocab, vectors):
    terms = vocab.select("term_idx", "term")
    cells = tfidf.long_form(vectors).join(F.broadcast(terms), "term_idx")
    return cells.select("row_idx", "term", scoring.rounded(F.col("x"), 6).alias("x"))


@query
def tfidf_fit(spark, sf):
    fit, _ = _document_split(spark, sf)
    vocab, vectors, _ = tfidf.fit_transform(fit, None, tfidf.TfidfConfig(), stored=False)
    return _tfidf_rows(vocab, vectors)


@query
def tfidf_transform(spark, sf):
    fit, held_out = _document_split(spark, sf)
    vocab, _, vectors = tfidf.fit_transform(fit, held_out, tfidf.TfidfConfig(), stored=False)
    return _tfidf_rows(vocab, vectors)


@query
def masked_mean_pool(spark, sf):
    return rounded(pooling.masked_mean(fx.token_vectors(spark, sf)))


@query
def chunk_mean(spark, sf):
    return rounded(pooling.chunk_mean(fx.token_vectors(spark, sf)))


# ---------------------------------------------------------------- neighbours


def _embedding_neighbors(spark, sf, k, pivots=None):
    fit, held_out = fx.embedding_split(spark, sf)
    vectors = [materialize(neighbors.dense_vectors(part, "embedding")) for part in (held_out, fit)]
    return neighbors.top_k(*vectors, k, pivots)


def _document_neighbors(spark, sf, k):
    fit, held_out = _document_split(spark, sf)
    _, fit_v, eval_v = tfidf.fit_transform(fit, held_out, tfidf.TfidfConfig())
    return neighbors.top_k(eval_v, fit_v, k)


def _document_knn_scores(spark, sf):
    fit, held_out = _document_split(spark, sf)
    _, fit_v, eval_v = tfidf.fit_transform(fit, held_out, tfidf.TfidfConfig())
    found = materialize(neighbors.top_k(eval_v, fit_v, KNN_K))
    truth = fx.truth(spark, sf)
    fit_truth = truth.join(fit.select("row_idx"), "row_idx", "left_semi")
    eval_truth = truth.join(held_out.select("row_idx"), "row_idx", "left_semi")
    return knn.label_probs(found, fit_truth, eval_truth, [(KNN_K, KNN_POWER)])


@query
def knn_tfidf(spark, sf):
    found = _document_neighbors(spark, sf, KNN_K)
    return rounded(found.select("q", "n", F.col("rank").cast("bigint").alias("rank"), "sim"))


@query
def knn_embedding(spark, sf):
    found = _embedding_neighbors(spark, sf, KNN_K)
    return rounded(found.select("q", "n", F.col("rank").cast("bigint").alias("rank"), "sim"))


@query
def knn_embedding_rings(spark, sf):
    """The same neighbours by twelve cells: both passes run, and the second takes the k-th best along."""
    found = _embedding_neighbors(spark, sf, KNN_K, 12)
    return rounded(found.select("q", "n", F.col("rank").cast("bigint").alias("rank"), "sim"))


@query
def knn_similarity_stats(spark, sf):
    return rounded(neighbors.similarity_stats(_embedding_neighbors(spark, sf, KNN_K)))


def _embedding_candidates(spark, sf, settings):
    found = materialize(_embedding_neighbors(spark, sf, max(k for k, _ in settings)))
    fit, held_out = fx.embedding_split(spark, sf)
    truth = fx.embedding_truth(spark, sf)
    probs = knn.label_probs(
        found,
        truth.join(fit.select("row_idx"), "row_idx", "left_semi"),
        truth.join(held_out.select("row_idx"), "row_idx", "left_semi"),
        settings,
    )
    return probs.withColumn("prob", F.round("prob", 9))


@query
def knn_label_probs(spark, sf):
    return rounded(_embedding_candidates(spark, sf, [(KNN_K, KNN_POWER)]).select("row_idx", "label", "y", "prob"))


@query
def knn_document_probs(spark, sf):
    return rounded(_document_knn_scores(spark, sf).select("row_idx", "label", "y", "prob"))


@query
def knn_document_f1(spark, sf):
    """Flagship: chronological split, TF-IDF neighbours, label scores, per-label F1 at 0.5."""
    scored = _document_knn_scores(spark, sf).withColumn("prob", F.round("prob", 9))
    return rounded(metrics.label_counts(metrics.predict(scored)))


# ---------------------------------------------------------------- metrics


@query
def label_support(spark, sf):
    return metrics.label_support(fx.truth(spark, sf))


@query
def labels_per_sample(spark, sf):
    return metrics.labels_per_sample(fx.truth(spark, sf))


@query
def labels_per_sample_stats(spark, sf):
    return rounded(audit.describe(metrics.labels_per_sample(fx.truth(spark, sf)), "n_labels"))


@query
def apply_thresholds(spark, sf):
    return metrics.predict(fx.scores(spark, sf, 1)).select("row_idx", "label", F.col("pred").cast("int").alias("pred"))


@query
def per_label_f1(spark, sf):
    return rounded(metrics.label_counts(metrics.predict(fx.scores(spark, sf, 1))))


@query
def per_label_report(spark, sf):
    return rounded(metrics.per_label_report(metrics.predict(fx.scores(spark, sf, 1))))


@query
def macro_f1(spark, sf):
    return rounded(metrics.macro_f1(metrics.predict(fx.scores(spark, sf, 1))))


@query
def macro_auc(spark, sf):
    return rounded(metrics.macro_auc(fx.scores(spark, sf, 1)))


@query
def label_auc(spark, sf):
    return rounded(metrics.label_auc(fx.scores(spark, sf, 0)))


@query
def threshold_metrics(spark, sf):
    return rounded(metrics.threshold_metrics(fx.scores(spark, sf, 1), 0.48))


@query
def score_alignment_check(spark, sf):
    a, b = fx.scores(spark, sf, 0), fx.scores(spark, sf, 1).where("not (label = 'label_25' and y = 1)")
    return metrics.misaligned_cells(a, b).groupBy("label").agg(F.count(F.lit(1)).alias("misaligned"))


@query
def pos_weight(spark, sf):
    counts = fx.truth(spark, sf).groupBy("label").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    weight = scoring.positive_weight(F.col("pos"), F.col("n"))
    balanced = [scoring.balanced_weight(F.lit(v), F.col("pos"), F.col("n")).alias(f"balanced_{v}") for v in (0, 1)]
    return rounded(counts.select("label", weight.alias("pos_weight"), *balanced))


@query
def sigmoid_link(spark, sf):
    """Logistic link over every embedding component, plain and with the logit clip."""
    z = fx.embeddings(spark, sf).select("row_idx", F.posexplode("embedding").alias("dim", "x"))
    z = z.withColumn("z", F.col("x").cast("double") * 40)
    return rounded(z.select("row_idx", "dim", scoring.sigmoid(F.col("z")).alias("plain"), scoring.clipped_sigmoid(F.col("z")).alias("clipped")))


# ---------------------------------------------------------------- thresholds


def _folded(spark, sf, model):
    return materialize(fx.scores(spark, sf, model).join(folds.group_folds(fx.proteins(spark, sf)), "row_idx"))


@query
def best_threshold_per_label(spark, sf):
    return rounded(thresholds.best_prefix(fx.scores(spark, sf, 1), 0.05, 0.95))


@query
def global_threshold_grid(spark, sf):
    return rounded(thresholds.grid_f1(fx.scores(spark, sf, 1), 0.10, 0.90, 0.01).select("threshold", "macro_f1", "predicted_labels_per_sample"))


@query
def global_threshold(spark, sf):
    return rounded(thresholds.best_global(fx.scores(spark, sf, 1), DEFAULT))


@query
def fit_thresholds_shrunk(spark, sf):
    scores = fx.scores(spark, sf, 1)
    return rounded(thresholds.fit_thresholds(scores, thresholds.best_global(scores, DEFAULT), DEFAULT))


@query
def crossfit_thresholds(spark, sf):
    _, fitted = thresholds.crossfit(_folded(spark, sf, 1), DEFAULT)
    return rounded(fitted)


@query
def crossfit_metrics(spark, sf):
    """Macro-F1 of the out-of-fold predictions: per fold, and pooled as fold -1."""
    predictions = materialize(thresholds.crossfit(_folded(spark, sf, 1), DEFAULT)[0])
    per_fold = metrics.macro(metrics.label_counts(predictions, ["fold"]), ["fold"])
    pooled = metrics.macro(metrics.label_counts(predictions)).withColumn("fold", F.lit(-1))
    return rounded(per_fold.unionByName(pooled))


@query
def threshold_variants(spark, sf):
    fitted = thresholds.fit_simple(fx.scores(spark, sf, 1), 0.05, 0.95, 0.5, 200.0)
    return rounded(thresholds.scale_variants(fitted, [1.00, 1.03, 1.06]).select("label", "scale", "threshold"))


@query
def variant_summary(spark, sf):
    """Mean labels per row and positive rate of each threshold scale over the test table."""
    _, test = fx.train_test(spark, sf)
    fitted = thresholds.fit_simple(fx.scores(spark, sf, 1), 0.05, 0.95, 0.5, 200.0)
    variants = thresholds.scale_variants(fitted, [1.00, 1.03, 1.06]).withColumn("threshold", F.round("threshold", 9))
    rows = fx.scores(spark, sf, 2).join(test.select("row_idx"), "row_idx", "left_semi")
    limits = F.broadcast(variants.select("label", "scale", F.col("threshold").alias("t")))
    predicted = metrics.predict(rows.join(limits, "label"), F.col("t"))
    summary = metrics.macro(metrics.label_counts(predicted, ["scale"]), ["scale"])
    return rounded(summary.select("scale", "predicted_labels_per_sample", "predicted_positive_rate"))


@query
def thresholds_optimistic(spark, sf):
    """Metrics of per-label thresholds over the rows they were fitted on: the optimistic side of the cross-fit."""
    scores = fx.scores(spark, sf, 1)
    fitted = thresholds.fit_thresholds(scores, thresholds.best_global(scores, DEFAULT), DEFAULT)
    small = fitted.select("label", F.round("shrunk_threshold", 9).alias("threshold"))
    return rounded(metrics.macro(metrics.label_counts(thresholds.apply_thresholds(scores, small, "threshold", ["label"]))))


@query
def early_stop_epoch(spark, sf):
    """Where training would stop if the thresholds of the grid were epochs: best and last point of each model."""
    grid = thresholds.grid_f1(_three_models(spark, sf), 0.10, 0.90, 0.01, ["model"])
    history = grid.select("model", F.round(F.col("threshold") * 100 - 10, 0).cast("int").alias("epoch"), F.round("macro_f1", 9).alias("value"))
    return rounded(mlp.early_stop(history, 5, ["model"]))


@query
def running_loss(spark, sf):
    """Mean log-loss of every batch of 64 rows and of all rows up to it, for each model."""
    return rounded(metrics.running_loss(_three_models(spark, sf), F.floor(F.col("row_idx") / 64), ["model"]))


# ---------------------------------------------------------------- blending


def _cells(spark, sf, *models):
    return blend.align(*[fx.scores(spark, sf, m) for m in models])


@query
def blend_two_way_grid(spark, sf):
    return rounded(blend.two_way_grid(_cells(spark, sf, 0, 1)).drop("grid_id"))


@query
def blend_two_way_best(spark, sf):
    return rounded(blend.best_point(blend.two_way_grid(_cells(spark, sf, 0, 1), step=0.025)).drop("grid_id"))


@query
def blend_three_way_top10(spark, sf):
    return rounded(blend.ranked_points(blend.three_way_grid(_cells(spark, sf, 0, 1, 2))).drop("grid_id"))


def _grid_candidates(spark, sf, powers):
    settings = [(k, p) for k in K_GRID for p in powers]
    base = fx.embedding_scores(spark, sf, 0)
    return knn.with_base(base, _embedding_candidates(spark, sf, settings))


@query
def tune_knn_blend(spark, sf):
    return rounded(blend.tune_knn_blend(_grid_candidates(spark, sf, TUNE_POWERS)))


@query
def adaptive_blend(spark, sf):
    return rounded(blend.fit_adaptive(_cells(spark, sf, 0, 1), grids.steps(0.0, 1.0, 0.1)))


@query
def adaptive_blend_f1(spark, sf):
    cells = materialize(_cells(spark, sf, 0, 1))
    params = blend.fit_adaptive(cells, grids.steps(0.0, 1.0, 0.1))
    small = params.withColumns({c: F.round(c, 9) for c in ("weight", "threshold")})
    return rounded(metrics.label_counts(blend.apply_adaptive(cells, small)))


@query
def adaptive_crossfit(spark, sf):
    """Per-fold macro-F1 of label-adaptive blending fitted on the other folds."""
    assigned = folds.group_folds(fx.proteins(spark, sf))
    cells = materialize(_cells(spark, sf, 0, 1).join(assigned, "row_idx"))
    calibration = folds.calibration_rows(cells, 2)
    params = blend.fit_adaptive(calibration, grids.steps(0.0, 1.0, 0.1), by=["cal_fold"]).withColumnRenamed("cal_fold", "fold")
    params = params.withColumns({c: F.round(c, 9) for c in ("weight", "threshold")})
    predicted = blend.apply_adaptive(cells, params, ["fold", "label"])
    return rounded(metrics.macro(metrics.label_counts(predicted, ["fold"]), ["fold"]))


@query
def label_specific_knn(spark, sf):
    return rounded(blend.fit_label_specific(_grid_candidates(spark, sf, LABEL_POWERS)))


@query
def label_specific_f1(spark, sf):
    candidates = _grid_candidates(spark, sf, LABEL_POWERS)
    params = blend.fit_label_specific(candidates)
    params = params.withColumns({c: F.round(c, 9) for c in ("weight", "threshold")})
    return rounded(metrics.label_counts(blend.apply_label_specific(candidates, params)))


@query
def label_specific_crossfit(spark, sf):
    """Per-fold macro-F1 of label-specific k, power, weight and threshold, each fitted on the other fold."""
    cells = materialize(_grid_candidates(spark, sf, LABEL_POWERS).withColumn("fold", (F.col("row_idx") % 2).cast("int")))
    params = blend.fit_label_specific(folds.calibration_rows(cells, 2), by=["cal_fold"]).withColumnRenamed("cal_fold", "fold")
    params = params.withColumns({c: F.round(c, 9) for c in ("weight", "threshold")})
    predicted = blend.apply_label_specific(cells, params, ["fold", "label"])
    return rounded(metrics.macro(metrics.label_counts(predicted, ["fold"]), ["fold"]))


@query
def param_histogram(spark, sf):
    params = materialize(blend.fit_label_specific(_grid_candidates(spark, sf, LABEL_POWERS)))
    chosen = [
        blend.histogram(params, c).select(F.lit(c).alias("parameter"), F.col(c).cast("double").alias("value"), "n_labels")
        for c in ("k", "power")
    ]
    return rounded(chosen[0].unionByName(chosen[1]))


@query
def weight_summary(spark, sf):
    return rounded(blend.weight_summary(blend.fit_adaptive(_cells(spark, sf, 0, 1), grids.steps(0.0, 1.0, 0.1))))


def _three_models(spark, sf):
    keep = ["row_idx", "label", "y", "prob"]
    return blend.stack_models(*[fx.scores(spark, sf, m).select(*keep) for m in range(3)])


@query
def select_model(spark, sf):
    return rounded(blend.fit_selector(_three_models(spark, sf)))


@query
def select_model_f1(spark, sf):
    models = _three_models(spark, sf)
    return rounded(metrics.label_counts(blend.apply_selector(models, blend.fit_selector(models))))


@query
def selector_scores(spark, sf):
    """Every model's best threshold and F1 for every label: what the choice is made from."""
    return rounded(blend.selector_scores(_three_models(spark, sf)))


@query
def select_crossfit(spark, sf):
    """Per-fold macro-F1 of per-label model selection, chosen on the other fold."""
    rows = materialize(_three_models(spark, sf).join(folds.group_folds(fx.proteins(spark, sf)), "row_idx"))
    params = blend.fit_selector(folds.calibration_rows(rows, 2), by=["cal_fold"]).withColumnRenamed("cal_fold", "fold")
    predicted = blend.apply_selector(rows, params, ["fold", "label"])
    return rounded(metrics.macro(metrics.label_counts(predicted, ["fold"]), ["fold"]))


# ---------------------------------------------------------------- label graph


@query
def cooccurrence(spark, sf):
    return labelgraph.cooccurrence(fx.truth(spark, sf))


@query
def label_graph(spark, sf):
    return rounded(labelgraph.label_graph(fx.truth(spark, sf)))


@query
def propagate(spark, sf):
    graph = labelgraph.label_graph(fx.truth(spark, sf))
    return rounded(labelgraph.propagate(fx.scores(spark, sf, 1), graph).select("row_idx", "label", "propagated"))


@query
def propagate_beta_grid(spark, sf):
    graph = labelgraph.label_graph(fx.truth(spark, sf))
    spread = materialize(labelgraph.propagate(fx.scores(spark, sf, 1), graph))
    return rounded(labelgraph.beta_grid(spread, BETAS, DEFAULT).drop("grid_id"))


# ---------------------------------------------------------------- ranking and sinks


@query
def candidate_ranking(spark, sf):
    """Stand-in models ranked by macro-AUC, then macro-F1 at 0.5."""
    models = materialize(_three_models(spark, sf))
    auc = metrics.macro_auc(models, ["model"])
    f1 = metrics.macro(metrics.label_counts(metrics.predict(models), ["model"]), ["model"])
    joined = auc.join(f1.select("model", "macro_f1", "predicted_labels_per_sample"), "model")
    return rounded(joined.orderBy(F.desc("macro_auc"), F.desc("macro_f1")))


@query
def submission_wide(spark, sf):
    _, test = fx.train_test(spark, sf)
    predicted = metrics.predict(fx.scores(spark, sf, 1)).join(test.select("row_idx", "protein_id"), "row_idx")
    wide = packs.wide(predicted, [f"label_{i}" for i in range(fx.N_LABELS)])
    return wide.select("protein_id", *[F.col(c).cast("int").alias(c) for c in wide.columns[1:]])


@query
def feature_cache_key(spark, sf):
    """Cache key of the default features: configuration, mode and a digest of the data itself."""
    return packs.cache_key(fx.proteins(spark, sf), tfidf.TfidfConfig(), "submit")


# ---------------------------------------------------------------- estimators


def _embedding_task(spark, sf):
    fit, held_out = fx.embedding_split(spark, sf)
    truth = fx.embedding_truth(spark, sf).select("row_idx", "label", "y")
    labels = [f"label_{i}" for i in range(fx.N_CLASSES)]
    return fit, held_out, truth.join(fit.select("row_idx"), "row_idx", "left_semi"), truth, labels


def _document_task(spark, sf):
    """Packed fit rows, held-out vectors, their truth and all labels: TF-IDF of whole documents."""
    fit, held_out = _document_split(spark, sf)
    vocab, fit_counts, eval_v = tfidf.fit_counts(fit, held_out, tfidf.TfidfConfig())
    truth, labels = fx.truth(spark, sf).select("row_idx", "label", "y"), [f"label_{i}" for i in range(fx.N_LABELS)]
    blocks = joint.pack(fit_counts, truth.join(fit.select("row_idx"), "row_idx", "left_semi"), labels, vocab.count())
    return blocks, eval_v, truth.join(held_out.select("row_idx"), "row_idx", "left_semi"), labels


@query
def sgd_ovr(spark, sf):
    """Penalised logistic regression of all labels on the documents' TF-IDF, every label in the same passes."""
    blocks, eval_v, _, labels = _document_task(spark, sf)
    model = joint.fit_joint(blocks, joint.columns_of(labels, linear.LinearConfig()))
    return rounded(joint.predict(eval_v, model).drop("name"))


@query
def sgd_convergence(spark, sf):
    """How each label's fit ended: passes over the rows, and whether its loss had settled."""
    blocks, _, _, labels = _document_task(spark, sf)
    return joint.fit_joint(blocks, joint.columns_of(labels, linear.LinearConfig())).report(spark).drop("name")


@query
def sgd_ovr_embedding(spark, sf):
    """Penalised logistic regression per class on the embeddings."""
    fit, held_out, fit_truth, _, labels = _embedding_task(spark, sf)
    features = [linear.dense_features(part, "embedding") for part in (fit, held_out)]
    return rounded(linear.logistic_scores(features[0], fit_truth, features[1], labels))


@query
def sgd_sweep(spark, sf):
    """The five candidates by stochastic steps on the documents' TF-IDF, ranked by macro-AUC and macro-F1 on held-out rows."""
    blocks, eval_v, truth, labels = _document_task(spark, sf)
    columns = [c for name, cfg in linear.SWEEP.items() for c in joint.columns_of(labels, cfg, name)]
    scored = joint.predict(eval_v, joint.fit_stochastic(blocks, columns)).withColumnRenamed("name", "model")
    models = materialize(scored.join(truth, ["row_idx", "label"]))
    f1 = metrics.macro(metrics.label_counts(metrics.predict(models), ["model"]), ["model"])
    ranked = metrics.macro_auc(models, ["model"]).join(f1.select("model", "macro_f1"), "model")
    return rounded(ranked.orderBy(F.desc("macro_auc"), F.desc("macro_f1")))


@query
def linear_predict(spark, sf):
    """Scores of all labels over held-out TF-IDF under coefficients that are computed from each term."""
    fit, held_out = _document_split(spark, sf)
    vocab, _, eval_v = tfidf.fit_transform(fit, held_out, tfidf.TfidfConfig(), stored=False)
    digest = F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("int")
    base, slope = (digest % 13 - 6) / 4.0, (digest % 7 - 3) / 40.0
    terms = vocab.select("term_idx", base.alias("base"), slope.alias("slope")).orderBy("term_idx").toPandas()  # the vocabulary has a fixed size
    number = np.arange(fx.N_LABELS)
    coef = np.vstack([terms["base"].to_numpy()[:, None] + terms["slope"].to_numpy()[:, None] * number, 0.25 - 0.125 * number])
    labels = [joint.Column(f"label_{i}") for i in number]
    model = joint.Model(tuple(labels), coef, (0,) * len(labels), (True,) * len(labels))
    return rounded(joint.predict(eval_v, model).drop("name"))


@query
def rf_baseline(spark, sf):
    """Random forests on the composition features of whole documents, hard predictions."""
    train, _ = fx.train_test(spark, sf)
    tagged = linear.composition_features(train).join(splits.random_group(train), "row_idx")
    tagged = materialize(tagged)
    fit, held_out = (tagged.where(F.col("part") == p).drop("part") for p in ("train", "val"))
    truth = fx.truth(spark, sf)
    labels = [f"label_{i}" for i in range(fx.N_LABELS)]
    scored = linear.forest_scores(fit, truth.join(fit.select("row_idx"), "row_idx", "left_semi"), held_out, labels)
    return metrics.predict(scored).select("row_idx", "label", "pred")


@query
def rf_skipped_labels(spark, sf):
    """Labels with fewer than ten positive fit rows: the forests never predict them."""
    train, _ = fx.train_test(spark, sf)
    fit = splits.random_group(train).where("part = 'train'")
    return linear.skipped_labels(fx.truth(spark, sf).join(fit, "row_idx", "left_semi"))


def _stack_cells(spark, sf):
    return blend.align(*[fx.scores(spark, sf, m) for m in range(4)])


STACK_FEATURES = ["p0", "p1", "p2", "p3"]


@query
def stack_fit(spark, sf):
    """Per-label logistic stack over four models: coefficients and intercept."""
    params = linear.fit_stack(materialize(_stack_cells(spark, sf)), STACK_FEATURES)
    return rounded(params.select("label", *[F.col("coef")[i].alias(f"coef_{i}") for i in range(4)], "intercept"))


@query
def stack_crossfit(spark, sf):
    """Per-fold macro-F1 of the stack, models and thresholds fitted on the other folds."""
    cells = materialize(_stack_cells(spark, sf).join(folds.group_folds(fx.proteins(spark, sf)), "row_idx"))
    calibration = materialize(folds.calibration_rows(cells, 2))
    params = linear.fit_stack(calibration, STACK_FEATURES, by=["cal_fold"])
    fitted = linear.apply_stack(calibration, params, STACK_FEATURES, ["cal_fold", "label"])
    limits = thresholds.fit_simple(fitted, 0.02, 0.98, 0.5, 200.0, ["cal_fold"]).withColumnRenamed("cal_fold", "fold")
    scored = linear.apply_stack(cells, params.withColumnRenamed("cal_fold", "fold"), STACK_FEATURES, ["fold", "label"])
    predicted = thresholds.apply_thresholds(scored, limits, "threshold", ["fold", "label"])
    return rounded(metrics.macro(metrics.label_counts(predicted, ["fold"]), ["fold"]))


@query
def stack_predict(spark, sf):
    """The stack's clipped logistic link under fixed per-label coefficients."""
    ord_ = F.col("ord").cast("double")
    params = fx.truth(spark, sf).select("label", "ord").distinct().select(
        "label",
        F.array(*[F.lit(float(i + 1)) + ord_ * (0.5 - i / 4) for i in range(4)]).alias("coef"),
        (F.lit(-2.0) - ord_ / 10).alias("intercept"),
        F.lit(False).alias("constant"),
    )
    return rounded(linear.apply_stack(_stack_cells(spark, sf), params, STACK_FEATURES).select("row_idx", "label", "prob"))


@query
def mlp_forward(spark, sf):
    """Held-out class scores of the network after a full training run on the embeddings."""
    fit, held_out, fit_truth, truth, labels = _embedding_task(spark, sf)
    as_x = lambda df: df.select("row_idx", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    network, _ = mlp.train(as_x(fit), fit_truth, as_x(held_out), truth, labels, mlp.MlpConfig())
    return rounded(network.scores(as_x(held_out)))
