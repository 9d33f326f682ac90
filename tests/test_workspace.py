"""The whole study on a small CSV pair, stage by stage through the command line."""

import random

import pytest

from labelweave.__main__ import main, options_of
from labelweave.operators import tfidf
from labelweave.plans import workspace
from labelweave.sources import models


def write_tables(spark, folder):
    rng = random.Random(11)
    motifs = {"label_0": "ACDEFG", "label_1": "KLMNPQ", "label_2": "WYWYWY"}
    rows = []
    for i in range(160):
        on = {label: int(rng.random() < 0.4) for label in motifs}
        body = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(30))
        seq = body + "".join(m for label, m in motifs.items() if on[label]) * 2
        rows.append((f"P{i:04d}", rows[i - 5][1] if i and i % 9 == 0 else seq, *on.values()))
    spark.createDataFrame(rows[:120], "protein_id string, sequence string, label_0 int, label_1 int, label_2 int").write.option(
        "header", True
    ).csv(f"{folder}/train")
    tests = [(f"P{i + 60:04d}", r[1]) for i, r in enumerate(rows[120:])]
    spark.createDataFrame(tests, "protein_id string, sequence string").write.option("header", True).csv(f"{folder}/test")


def test_study(spark, tmp_path, monkeypatch):
    small = tfidf.TfidfConfig(2, 3, 2, 400)
    monkeypatch.setattr(workspace, "FEATURES", {"v1": small, "v16": small, "v19": small})
    monkeypatch.setattr(workspace, "K_GRID", [3, 5])
    monkeypatch.setattr(workspace, "TUNE_POWERS", [2.0])
    monkeypatch.setattr(workspace, "LABEL_POWERS", [2.0])
    monkeypatch.setattr(workspace, "SUBMIT_K", 5)
    write_tables(spark, str(tmp_path))
    root = str(tmp_path / "out")

    def run(stage, *options):
        main([stage, "--train", f"{tmp_path}/train", "--test", f"{tmp_path}/test", "--root", root, *options])

    run("audit")
    run("split")
    run("train-linear")
    run("kmer-knn", "--k", "5")
    run("blend-two", "--a", "v1_sgd", "--b", "v5_knn", "--name", "v6_blend")
    run("blend-three", "--a", "v1_sgd", "--b", "v5_knn", "--c", "v6_blend")
    (tmp_path / "config.json").write_text('{"tune": {"ks": [3, 5], "step": 0.1}, "propagate": {"betas": [0.0, 0.2]}}')
    run("tune", "--config", f"{tmp_path}/config.json", "--powers", "2")
    assert {(r["k"], r["power"]) for r in spark.read.json(f"{root}/reports/v7_tuned_grid").collect()} == {(3, 2.0), (5, 2.0)}
    run("fit-thresholds", "--model", "v7_tuned")
    run("adaptive")
    run("label-specific")
    run("propagate", "--min-cooc", "1", "--config", f"{tmp_path}/config.json")
    assert spark.read.json(f"{root}/reports/v13_betas").count() == 2
    run("stack", "--models", "v1_sgd", "v5_knn")
    run("select", "--models", "v7_tuned", "v1_sgd", "v5_knn")
    run("submit")
    run("variants")
    run("submit-adaptive")
    run("submit-label-specific")

    f1 = spark.read.json(f"{root}/reports/v1_sgd_metrics").first()["macro_f1"]
    assert f1 > 0.6
    before = spark.read.parquet(f"{root}/scores/model=v1_sgd").orderBy("row_idx", "label").collect()
    assert models.ModelStore(spark, f"{root}/models").keys().count() == 2  # the mode's own and the one of submit

    def no_fit(*_):
        raise AssertionError("a stored model was fitted again")

    monkeypatch.setattr(workspace.joint, "fit_joint", no_fit)
    run("train-linear")
    assert spark.read.parquet(f"{root}/scores/model=v1_sgd").orderBy("row_idx", "label").collect() == before
    assert spark.read.json(f"{root}/reports/split_metadata").first()["random_val_rows"] > 0
    assert spark.read.json(f"{root}/reports/v18_scores").select("model").distinct().count() == 3
    for name in ("v7_1p0", "v7_scale_1p03", "v8", "v9"):
        wide = spark.read.option("header", True).csv(f"{root}/submissions/{name}")
        assert wide.columns == ["protein_id", "label_0", "label_1", "label_2"]
        assert wide.count() == 40


def test_config_file_and_options(tmp_path):
    (tmp_path / "c.json").write_text('{"tune": {"ks": [3], "step": 0.1, "max_labels": 4}, "audit": {"nonsense": 1}}')
    got = options_of(["tune", "--config", str(tmp_path / "c.json"), "--step", "0.2"])
    assert (got["ks"], got["step"], got["max_labels"], got["powers"]) == ([3], 0.2, 4, None)
    with pytest.raises(SystemExit):
        options_of(["audit", "--config", str(tmp_path / "c.json")])


def test_smoke_limits(spark, tmp_path):
    write_tables(spark, str(tmp_path))
    space = workspace.Workspace(spark, f"{tmp_path}/train", f"{tmp_path}/test", str(tmp_path / "out"), max_labels=2, max_rows=30)
    assert space.labels == ["label_0", "label_1"] and space.train.count() == space.test.count() == 30
    assert space.truth.count() == 60
