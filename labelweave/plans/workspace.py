"""The stages of a study over one train and one test table, handing tables to each other on disk.

Folders under ``root``: ``splits/<mode>``, ``scores/model=<name>``, ``test_scores/model=<name>``,
``thresholds/<tag>``, ``params/<tag>``, ``models/<key>``, ``reports/<name>``, ``submissions/<name>``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions import grids
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
    splits,
    tfidf,
    thresholds,
)
from labelweave.session import materialize
from labelweave.sources import packs
from labelweave.sources.models import ModelStore, model_key

# The submission operating point and the search grids.
SUBMIT_K, SUBMIT_POWER, SUBMIT_WEIGHT = 40, 4.0, 0.40
K_GRID, WEIGHT_GRID = [5, 10, 20, 40, 80], [0.2, 0.3, 0.4, 0.5, 0.6]
TUNE_POWERS, LABEL_POWERS = [1.0, 2.0, 4.0], [2.0, 4.0, 6.0]
BETAS = [0.0, 0.025, 0.05, 0.075, 0.10, 0.15, 0.20, 0.25, 0.30]
MODES = ["random", "tail", "tail_clean", "chronological"]
FEATURES = {"v1": tfidf.TfidfConfig(), "v16": tfidf.SHORT_NGRAMS, "v19": tfidf.LONG_NGRAMS}


def _settings(ks: Sequence[float], powers: Sequence[float]) -> list[tuple[int, float]]:
    return [(int(k), float(p)) for k in ks for p in powers]


class Workspace:
    """One study. ``train`` and ``test`` are CSV paths with a header row.

    ``max_labels`` keeps the first labels by number and ``max_rows`` the first numbered rows of either
    table: both are for smoke runs.
    """

    def __init__(
        self, spark: SparkSession, train: str, test: str, root: str, mode: str = "chronological", max_labels: int | None = None, max_rows: int | None = None
    ):
        self.spark, self.root, self.mode = spark, root.rstrip("/"), mode
        self._train_path, self._test_path = train, test
        self.max_labels, self.max_rows = max_labels, max_rows

    # ---- inputs

    def _table(self, path: str, side: str) -> DataFrame:
        """Numbered rows of a CSV table; its malformed rows go to a report of their own."""
        raw = materialize(packs.read_csv(self.spark, path))
        bad = packs.malformed(raw)
        if not bad.isEmpty():
            self._report(bad, f"malformed_{side}")
        numbered = packs.with_row_idx(packs.well_formed(raw))
        return materialize(numbered if self.max_rows is None else numbered.where(F.col("row_idx") < self.max_rows))

    @cached_property
    def train(self) -> DataFrame:
        return self._table(self._train_path, "train")

    @cached_property
    def test(self) -> DataFrame:
        return self._table(self._test_path, "test")

    @cached_property
    def models(self) -> ModelStore:
        return ModelStore(self.spark, f"{self.root}/models")

    @cached_property
    def labels(self) -> list[str]:
        return packs.first_labels(packs.label_columns(self.train), self.max_labels)

    @cached_property
    def truth(self) -> DataFrame:
        every = packs.label_columns(self.train)
        return materialize(packs.long_truth(self.train.drop(*[c for c in every if c not in self.labels])))

    def _read(self, *parts: str) -> DataFrame:
        return self.spark.read.parquet("/".join([self.root, *parts]))

    def _write(self, df: DataFrame, *parts: str) -> DataFrame:
        packs.write_table(df, "/".join([self.root, *parts]))
        return self._read(*parts)

    def _report(self, df: DataFrame, name: str) -> DataFrame:
        packs.write_summary(df, f"{self.root}/reports/{name}")
        return df

    def scores(self, model: str) -> DataFrame:
        return packs.read_scores(self.spark, f"{self.root}/scores", model)

    def _save_scores(self, scores: DataFrame, model: str) -> DataFrame:
        packs.write_scores(scores, f"{self.root}/scores", model)
        return self.scores(model)

    def _aligned(self, *models: str) -> DataFrame:
        packed = [self.scores(m) for m in models]
        for other in packed[1:]:
            metrics.require_aligned(packed[0], other)
        return materialize(blend.align(*packed))

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        """(fit, eval) rows of the mode; ``submit`` fits on all training rows and scores the test table."""
        if self.mode == "submit":
            return self.train, self.test
        tagged = self.train.join(self._read("splits", self.mode), "row_idx")
        return tagged.where("part = 'train'").drop("part"), tagged.where("part = 'val'").drop("part")

    def _truth_of(self, rows: DataFrame) -> DataFrame:
        return self.truth.join(rows.select("row_idx"), "row_idx", "left_semi")

    # ---- audit and splits

    def audit(self) -> None:
        for side, table in (("train", self.train), ("test", self.test)):
            self._report(audit.table_summary(table), f"audit_{side}")
            self._report(audit.nonstandard_residues(table), f"residues_{side}")
            self._report(audit.id_ranges(table), f"ids_{side}")
        self._report(audit.label_summary(self.truth), "audit_labels")
        self._report(audit.describe(metrics.labels_per_sample(self.truth), "n_labels"), "audit_labels_per_sample")
        self._report(audit.overlap(self.train, self.test), "audit_overlap")
        tail = splits.tail(self.train, self.test)
        self._report(audit.tail_summary(self.train, self.truth, tail), "audit_tail")

    def split(self, val_size: float = 0.2, seed: int = 42) -> None:
        made = {
            "random": splits.random_group(self.train, val_size, seed),
            "tail": splits.tail(self.train, self.test),
            "tail_clean": splits.tail_clean(self.train, self.test),
            "chronological": splits.chronological(self.train, self.test, val_size),
        }
        saved = {mode: self._write(split, "splits", mode) for mode, split in made.items()}
        for mode, split in saved.items():
            if mode in ("random", "chronological"):
                splits.require_no_leak(self.train, split)
            self._report(metrics.prevalence_drift(self.truth, split), f"drift_{mode}")
        self._report(splits.metadata(self.train, self.test, self.truth, saved, val_size, seed), "split_metadata")

    # ---- base models

    def _data_key(self, cfg) -> str:
        """Key of settings, mode, split and data."""
        fit, held_out = self._sides()
        tagged = fit.select("row_idx", "sequence").unionByName(held_out.select("row_idx", F.concat(F.lit("~"), "sequence").alias("sequence")))
        return packs.cache_key(tagged, cfg, self.mode).first()["cache_key"]

    def _features(self, features: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(vocab, fit vectors, eval vectors), kept under a key of settings, mode, split and data."""
        cfg = FEATURES[features]
        fit, held_out = self._sides()
        key = self._data_key(cfg)
        where = ("features", f"{self.mode}_{key}")
        try:
            return self._read(*where, "vocab"), self._read(*where, "fit"), self._read(*where, "eval")
        except Exception as missing:  # nothing stored under this key yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        made = tfidf.fit_transform(fit, held_out, cfg)
        names = ("fit", "eval", "vocab")  # the vocabulary is written last
        stored = {n: self._write(df, *where, n) for n, df in zip(names, (made[1], made[2], made[0]))}
        return stored["vocab"], stored["fit"], stored["eval"]

    def train_linear(self, features: str = "v1", cfg: linear.LinearConfig = linear.LinearConfig(), name: str | None = None) -> DataFrame:
        """Penalised logistic regression per label on n-gram TF-IDF."""
        name = name or f"{features}_sgd"
        key = model_key("linear", f"{features}_{self._data_key(FEATURES[features])}", cfg, self.labels)
        model = self.models.load_linear(key)
        if model is None:
            blocks, eval_v = self._packed(features)
            model = joint.fit_joint(blocks, joint.columns_of(self.labels, cfg), cfg.max_iter, cfg.tol)
            self.models.save_linear(key, model)
        else:
            eval_v = self._features(features)[2]
        self._report(model.report(self.spark).drop("name"), f"{name}_convergence")
        return self._finish(joint.predict(eval_v, model), self._sides()[1], name)

    def _packed(self, features: str) -> tuple[joint.Blocks, DataFrame]:
        vocab, fit_v, eval_v = self._features(features)
        return joint.pack(fit_v, self._truth_of(self._sides()[0]), self.labels, vocab.count()), eval_v

    def sweep(self, features: str = "v1") -> DataFrame:
        """All regularisation candidates, fitted side by side and ranked."""
        blocks, eval_v = self._packed(features)
        columns = [c for name, cfg in linear.SWEEP.items() for c in joint.columns_of(self.labels, cfg, name)]
        scored = materialize(joint.predict(eval_v, joint.fit_stochastic(blocks, columns)))
        ranked = []
        for name in linear.SWEEP:
            one = self._finish(scored.where(F.col("name") == name), self._sides()[1], f"v10_{name}")
            ranked.append((name, metrics.macro_auc(one).first()[0], metrics.macro_f1(metrics.predict(one)).first()[0]))
        table = self.spark.createDataFrame(ranked, "candidate string, macro_auc double, macro_f1 double")
        return self._report(table.orderBy(F.desc("macro_auc"), F.desc("macro_f1")), "v10_ranking")

    def forest(self) -> DataFrame:
        fit, held_out = self._sides()
        x = [materialize(linear.composition_features(part)) for part in (fit, held_out)]
        scored = linear.forest_scores(x[0], self._truth_of(fit), x[1], self.labels)
        return self._finish(scored, held_out, "v0_forest")

    def embedding_mlp(self, embeddings: str, cfg: mlp.MlpConfig = mlp.MlpConfig()) -> DataFrame:
        """Network head on a Parquet table of ``(protein_id, embedding)``."""
        x = self.spark.read.parquet(embeddings).select("protein_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
        fit, held_out = self._sides()
        rows = [part.select("row_idx", "protein_id").join(x, "protein_id").select("row_idx", "x") for part in (fit, held_out)]
        truths = [self._truth_of(part) for part in (fit, held_out)]
        digest = packs.cache_key(rows[0].select("row_idx", F.col("x").cast("string").alias("sequence")), cfg, self.mode).first()["cache_key"]
        key = model_key("network", f"{self._data_key(cfg)}_{digest}", cfg, self.labels)
        stored = self.models.load_network(key)
        network, history = stored or mlp.train(rows[0], truths[0], rows[1], truths[1], self.labels, cfg)
        if stored is None:
            self.models.save_network(key, network, history)
        self._report(self.spark.createDataFrame(history), "v3_history")
        return self._finish(network.scores(rows[1]), held_out, "v3_mlp")

    def embedding_knn(self, embeddings: str, k: int = 20, power: float = 2.0) -> DataFrame:
        x = self.spark.read.parquet(embeddings).select("protein_id", "embedding")
        fit, held_out = self._sides()
        vectors = [
            materialize(neighbors.dense_vectors(part.select("row_idx", "protein_id").join(x, "protein_id"), "embedding"))
            for part in (fit, held_out)
        ]
        found = materialize(neighbors.top_k(vectors[1], vectors[0], k))
        self._report(neighbors.similarity_stats(found), "v4_similarity")
        scored = knn.label_probs(found, self._truth_of(fit), self._truth_of(held_out), [(k, power)])
        return self._finish(scored, held_out, "v4_knn")

    def _candidates(self, settings: Sequence[tuple[int, float]], features: str = "v1") -> DataFrame:
        _, fit_v, eval_v = self._features(features)
        fit, held_out = self._sides()
        found = materialize(neighbors.top_k(eval_v, fit_v, max(k for k, _ in settings)))
        self._report(neighbors.similarity_stats(found), f"knn_similarity_{self.mode}")
        cells = self._truth_of(held_out) if self.mode != "submit" else self._blank_cells(held_out)
        return knn.label_probs(found, self._truth_of(fit), cells, settings)

    def _blank_cells(self, rows: DataFrame) -> DataFrame:
        names = F.explode(F.array(*[F.lit(label) for label in self.labels])).alias("label")
        return rows.select("row_idx", names).withColumn("y", F.lit(None).cast("tinyint"))

    def kmer_knn(self, k: int = 20, power: float = 2.0, name: str = "v5_knn") -> DataFrame:
        return self._finish(self._candidates([(k, power)]), self._sides()[1], name)

    def _finish(self, scored: DataFrame, held_out: DataFrame, name: str) -> DataFrame:
        """Save scores with their truth and report metrics; in submit mode save test scores."""
        scored = scored.select("row_idx", "label", "prob")
        if self.mode == "submit":
            table = scored.join(held_out.select("row_idx", "protein_id"), "row_idx")
            return self._write(table, "test_scores", f"model={name}")
        saved = self._save_scores(self._truth_of(held_out).join(scored, ["row_idx", "label"]), name)
        self._report(metrics.threshold_metrics(saved), f"{name}_metrics")
        packs.write_report(metrics.per_label_report(metrics.predict(saved)), f"{self.root}/reports/{name}_per_label")
        return saved

    # ---- blends and searches over saved scores

    def blend_two(self, a: str, b: str, name: str, step: float = 0.05) -> DataFrame:
        cells = self._aligned(a, b)
        grid = materialize(blend.two_way_grid(cells, step))
        self._report(blend.ranked_points(grid), f"{name}_top10")
        weight = blend.best_point(grid).first()["weight_a"]
        return self._save_scores(cells.withColumn("prob", F.lit(weight) * F.col("p0") + F.lit(1.0 - weight) * F.col("p1")), name)

    def blend_three(self, a: str, b: str, c: str, name: str = "v11_blend", step: float = 0.05) -> DataFrame:
        cells = self._aligned(a, b, c)
        grid = materialize(blend.three_way_grid(cells, step))
        self._report(blend.ranked_points(grid), f"{name}_top10")
        best = blend.best_point(grid).first()
        prob = sum((F.lit(best[f"weight_{w}"]) * F.col(p) for w, p in zip("abc", ("p0", "p1", "p2"))), F.lit(0.0))
        return self._save_scores(cells.withColumn("prob", prob), name)

    def tune(
        self, base: str = "v1_sgd", name: str = "v7_tuned", ks: Sequence[float] | None = None, powers: Sequence[float] | None = None, step: float = 0.05
    ) -> DataFrame:
        """Best k, power and blend weight over the whole grid; neighbours are searched once."""
        settings = _settings(ks or K_GRID, powers or TUNE_POWERS)
        candidates = knn.with_base(self.scores(base), self._candidates(settings))
        table = materialize(blend.tune_knn_blend(candidates, step))
        self._report(table, f"{name}_grid")
        best = table.orderBy(F.round("blend_macro_f1", 12).desc(), "k", "power").first()
        kept = candidates.where((F.col("k") == best["k"]) & (F.col("power") == best["power"]))
        prob = F.lit(best["base_weight"]) * F.col("base") + F.lit(1.0 - best["base_weight"]) * F.col("prob")
        return self._save_scores(kept.withColumn("prob", prob), name)

    def _folded(self, cells: DataFrame, n_splits: int = 2) -> DataFrame:
        rows = cells.select("row_idx").distinct().join(self.train.select("row_idx", "sequence"), "row_idx")
        return materialize(cells.join(folds.group_folds(rows, n_splits), "row_idx"))

    def fit_thresholds(self, model: str, cfg: thresholds.ThresholdConfig = thresholds.ThresholdConfig()) -> DataFrame:
        """Cross-fitted estimate and final per-label thresholds of a score table."""
        scores = self._folded(self.scores(model), cfg.n_splits)
        out_of_fold, _ = thresholds.crossfit(scores, cfg)
        self._report(metrics.macro(metrics.label_counts(out_of_fold)), f"{model}_crossfit")
        best = materialize(thresholds.best_global(scores, cfg))
        self._report(best, f"{model}_global")
        fitted = self._write(thresholds.fit_thresholds(scores, best, cfg), "thresholds", model)
        packs.write_report(fitted, f"{self.root}/reports/{model}_thresholds")
        own = thresholds.apply_thresholds(scores, fitted, "shrunk_threshold", ["label"])
        self._report(metrics.macro(metrics.label_counts(own)), f"{model}_fit_all_optimistic")
        return fitted

    def adaptive(self, base: str = "v1_sgd", other: str = "v5_knn") -> DataFrame:
        cells = self._folded(self._aligned(base, other))
        weights = grids.steps(0.0, 1.0, 0.1)
        by_fold = blend.fit_adaptive(folds.calibration_rows(cells, 2), weights, by=["cal_fold"]).withColumnRenamed("cal_fold", "fold")
        predicted = blend.apply_adaptive(cells, by_fold, ["fold", "label"])
        self._report(metrics.macro(metrics.label_counts(predicted)), "v8_crossfit")
        params = self._write(blend.fit_adaptive(cells, weights), "params", "v8")
        self._report(blend.weight_summary(params), "v8_weights")
        return params

    def label_specific(
        self, base: str = "v1_sgd", ks: Sequence[float] | None = None, powers: Sequence[float] | None = None, weights: Sequence[float] | None = None
    ) -> DataFrame:
        settings, weights = _settings(ks or K_GRID, powers or LABEL_POWERS), weights or WEIGHT_GRID
        candidates = self._folded(knn.with_base(self.scores(base), self._candidates(settings)))
        by_fold = blend.fit_label_specific(folds.calibration_rows(candidates, 2), weights, by=["cal_fold"]).withColumnRenamed("cal_fold", "fold")
        predicted = blend.apply_label_specific(candidates, by_fold, ["fold", "label"])
        self._report(metrics.macro(metrics.label_counts(predicted)), "v9_crossfit")
        params = self._write(blend.fit_label_specific(candidates, weights), "params", "v9")
        for column in ("k", "power"):
            self._report(blend.histogram(params, column), f"v9_{column}")
        return params

    def propagate(self, model: str = "v7_tuned", topk: int = 20, min_cooc: int = 30, betas: Sequence[float] | None = None) -> DataFrame:
        graph = self._write(labelgraph.label_graph(self._truth_of(self._sides()[0]), topk, min_cooc), "params", "v13_graph")
        spread = materialize(labelgraph.propagate(self.scores(model), graph))
        grid = materialize(labelgraph.beta_grid(spread, betas or BETAS, thresholds.ThresholdConfig()))
        self._report(grid, "v13_betas")
        beta = labelgraph.best_beta(grid).first()["beta"]
        prob = F.lit(1.0 - beta) * F.col("prob") + F.lit(beta) * F.col("propagated")
        return self._save_scores(spread.withColumn("prob", prob), "v13_propagated")

    def stack(self, models: Sequence[str]) -> DataFrame:
        names = [f"p{i}" for i in range(len(models))]
        cells = self._folded(self._aligned(*models))
        calibration = materialize(folds.calibration_rows(cells, 2))
        params = linear.fit_stack(calibration, names, by=["cal_fold"])
        fitted = linear.apply_stack(calibration, params, names, ["cal_fold", "label"])
        limits = thresholds.fit_simple(fitted, 0.02, 0.98, 0.5, 200.0, ["cal_fold"]).withColumnRenamed("cal_fold", "fold")
        scored = materialize(linear.apply_stack(cells, params.withColumnRenamed("cal_fold", "fold"), names, ["fold", "label"]))
        predicted = thresholds.apply_thresholds(scored, limits, "threshold", ["fold", "label"])
        self._report(metrics.macro(metrics.label_counts(predicted)), "v14_crossfit")
        final = linear.fit_stack(cells, names)
        final_limits = thresholds.fit_simple(linear.apply_stack(cells, final, names), 0.02, 0.98, 0.5, 200.0)
        self._write(final.join(final_limits, "label"), "params", "v14")
        return self._save_scores(scored, "v14_stack")

    def select(self, models: Sequence[str]) -> DataFrame:
        """``models[0]`` is the incumbent."""
        for other in models[1:]:
            metrics.require_aligned(self.scores(models[0]), self.scores(other))
        rows = self._folded(blend.stack_models(*[self.scores(m) for m in models]))
        by_fold = blend.fit_selector(folds.calibration_rows(rows, 2), by=["cal_fold"]).withColumnRenamed("cal_fold", "fold")
        predicted = blend.apply_selector(rows, by_fold, ["fold", "label"])
        self._report(metrics.macro(metrics.label_counts(predicted)), "v18_crossfit")
        scored = materialize(blend.selector_scores(rows))
        self._report(scored, "v18_scores")
        params = self._write(blend.choose_models(scored), "params", "v18")
        self._report(blend.histogram(params, "model", range(len(models))), "v18_choices")
        return params

    # ---- test predictions (mode ``submit``)

    def _export(self, predictions: DataFrame, name: str) -> None:
        packs.write_submission(predictions, self.labels, f"{self.root}/submissions/{name}")

    def submit(self, limits_of: str = "v7_tuned") -> DataFrame:
        """Fit on all training rows, blend at the fixed operating point, threshold, export."""
        base = self.train_linear(name="v7_base")
        candidates = knn.with_base(base, self._candidates([(SUBMIT_K, SUBMIT_POWER)]))
        prob = F.lit(SUBMIT_WEIGHT) * F.col("base") + F.lit(1.0 - SUBMIT_WEIGHT) * F.col("prob")
        both = candidates.withColumn("knn_prob", F.col("prob")).withColumn("prob", prob)
        table = both.join(self.test.select("row_idx", "protein_id"), "row_idx").select(
            "protein_id", "row_idx", "label", "prob", F.col("base").alias("base_prob"), "knn_prob"
        )
        saved = self._write(table, "test_scores", "model=v7")
        self.variants(limits_of, [1.0], "v7")
        return saved

    def variants(self, limits_of: str = "v7_tuned", scales: Sequence[float] = (1.00, 1.03, 1.06), name: str = "v7_scale") -> None:
        """One export per threshold scale, from the saved test scores."""
        saved = self._read("test_scores", "model=v7")
        limits = self._read("thresholds", limits_of).withColumnRenamed("shrunk_threshold", "threshold")
        for scale in scales:
            scaled = thresholds.scale_variants(limits, [scale])
            self._export(thresholds.apply_thresholds(saved, scaled, "threshold"), f"{name}_{grids.file_safe(scale)}")

    def submit_adaptive(self) -> None:
        saved = self._read("test_scores", "model=v7")
        cells = saved.withColumnsRenamed({"base_prob": "p0", "knn_prob": "p1"})
        self._export(blend.apply_adaptive(cells, self._read("params", "v8")), "v8")

    def submit_label_specific(self) -> None:
        """Only the distinct (k, power) pairs in use are scored, from one neighbour search."""
        params = self._read("params", "v9")
        pairs = [(r["k"], r["power"]) for r in params.select("k", "power").distinct().orderBy("k", "power").collect()]
        base = self._read("test_scores", "model=v7").select("row_idx", "label", F.col("base_prob").alias("prob"))
        predicted = blend.apply_label_specific(knn.with_base(base, self._candidates(pairs)), params)
        self._export(predicted.join(self.test.select("row_idx", "protein_id"), "row_idx"), "v9")
