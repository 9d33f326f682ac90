import argparse
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.__main__ import number_list
from labelweave.functions import grids
from labelweave.operators import labelgraph, mlp, splits, tfidf
from labelweave.session import materialize
from labelweave.sources import packs

PROTEINS = "row_idx bigint, protein_id string, sequence string"


def brute_chronological(rows, val_size):
    groups = {}
    for _, pid, seq in rows:
        first, n = groups.get(seq, (10**9, 0))
        groups[seq] = (min(first, int(pid[1:])), n + 1)
    target, taken, val = max(1, round(len(rows) * val_size)), 0, set()
    for seq, (_, n) in sorted(groups.items(), key=lambda g: (-g[1][0], g[0])):
        if taken >= target:
            break
        val.add(seq)
        taken += n
    return {r[0] for r in rows if r[2] in val}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_chronological_with_repeated_ids(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"P{rng.randint(0, 12):03d}", rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 2)) for i in range(60)]
    df = spark.createDataFrame(rows, PROTEINS)
    split = splits.chronological(df, spark.createDataFrame([(0, "P1", "a")], PROTEINS))
    got = {r["row_idx"] for r in split.where("part = 'val'").collect()}
    assert got == brute_chronological(rows, 0.2)
    splits.require_no_leak(df, split)


def test_tail_needs_every_id_to_parse(spark):
    train = spark.createDataFrame([(0, "P1", "a"), (1, "P9", "b")], PROTEINS)
    test = spark.createDataFrame([(0, "P5", "c")], PROTEINS)
    assert {(r["row_idx"], r["part"]) for r in splits.tail(train, test).collect()} == {(0, "train"), (1, "val")}
    broken = spark.createDataFrame([(0, "5", "c")], PROTEINS)
    assert splits.tail(train, broken).count() == 0
    assert splits.chronological(train, broken).count() == 0
    assert splits.chronological(train.union(broken), test).count() == 0
    assert splits.chronological(train, test.limit(0)).count() == 0
    assert splits.chronological(train, test).count() == 2


def test_label_columns_are_numbered(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "label_10 int, label_foo int, label_2 int, xlabel_1 int, label_3_old int")
    assert packs.label_columns(df) == ["label_2", "label_10"]


def test_cache_key_uses_whole_digests(spark):
    cfg = tfidf.TfidfConfig()
    key = lambda rows: packs.cache_key(spark.createDataFrame(rows, PROTEINS), cfg, "m").first()["cache_key"]
    one = key([(0, "P1", "a"), (1, "P2", "b")])
    assert one == key([(1, "P2", "b"), (0, "P1", "a")]) and one != key([(0, "P1", "b"), (1, "P2", "a")])
    assert key([]) != key([(0, "P1", "")])


def test_leak_raises(spark):
    df = spark.createDataFrame([(0, "P1", "a"), (1, "P2", "a")], PROTEINS)
    parts = spark.createDataFrame([(0, "train"), (1, "val")], "row_idx bigint, part string")
    with pytest.raises(RuntimeError):
        splits.require_no_leak(df, parts)


def test_grids():
    assert len(grids.steps(0.1, 0.9, 0.01)) == 81 and grids.steps(0.0, 1.0, 0.025)[-1] == 1.0
    assert len(grids.simplex(0.05)) == 231
    assert number_list("5, 10,,20") == [5.0, 10.0, 20.0]
    for wrong in ("", " , ", "1,x"):
        with pytest.raises(argparse.ArgumentTypeError):
            number_list(wrong)
    assert grids.file_safe(1.03) == "1p03"


def test_weak_pairs_and_lonely_targets(spark):
    rows = [(i, label, int(i < n)) for label, n in (("a", 40), ("b", 40), ("c", 5)) for i in range(200)]
    truth = spark.createDataFrame(rows, "row_idx bigint, label string, y int")
    edges = {(r["src"], r["dst"]): r["weight"] for r in labelgraph.label_graph(truth).collect()}
    assert edges == {("a", "b"): 1.0, ("b", "a"): 1.0}
    scores = truth.withColumn("prob", F.lit(0.5))
    spread = labelgraph.propagate(scores, labelgraph.label_graph(truth))
    assert spread.count() == 600
    assert {r["label"]: r["v"] for r in spread.groupBy("label").agg(F.max("propagated").alias("v")).collect()} == {"a": 0.5, "b": 0.5, "c": 0.0}


def test_csv_to_long_and_back(spark, tmp_path):
    source = spark.createDataFrame([("P2", "AC", 1, 0), ("P1", "GG", 0, 1)], "protein_id string, sequence string, label_10 int, label_2 int")
    source.write.option("header", True).csv(str(tmp_path / "in"))
    raw = packs.read_csv(spark, str(tmp_path / "in"))
    assert [f.dataType.typeName() for f in raw.schema][:4] == ["string", "string", "integer", "integer"]
    table = packs.with_row_idx(packs.well_formed(materialize(raw)))
    assert packs.label_columns(table) == ["label_2", "label_10"]
    truth = packs.long_truth(table)
    assert packs.first_labels(packs.label_columns(table), 1) == ["label_2"] and len(packs.first_labels(["a", "b"], None)) == 2
    predicted = truth.join(table.select("row_idx", "protein_id"), "row_idx").withColumn("pred", F.col("y"))
    packs.write_submission(predicted, ["label_2", "label_10"], str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("protein_id").collect()
    assert [tuple(r) for r in back] == [("P1", "1", "0"), ("P2", "0", "1")]
    twins = predicted.withColumn("protein_id", F.lit("P1"))
    assert sorted(tuple(r) for r in packs.wide(twins, ["label_2", "label_10"]).collect()) == [("P1", 0, 1), ("P1", 1, 0)]


def test_broken_csv_rows_are_set_aside(spark, tmp_path):
    (tmp_path / "t.csv").write_text('protein_id,sequence,label_1\nP1,"A,C",1\nP2,GG,yes\nP3,TT\nP4,CC,0,9\nP5,AA,0\n')
    raw = materialize(packs.read_csv(spark, str(tmp_path / "t.csv")))
    assert sorted(tuple(r) for r in packs.well_formed(raw).collect()) == [("P1", "A,C", 1), ("P5", "AA", 0)]
    assert sorted(r["line"] for r in packs.malformed(raw).collect()) == ["P2,GG,yes", "P3,TT", "P4,CC,0,9"]
    plan = packs.read_csv(spark, str(tmp_path / "t.csv"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_score_table_is_read_per_model(spark, tmp_path):
    scores = spark.createDataFrame([(0, "a", 0.25, 1)], "row_idx bigint, label string, prob double, y int")
    packs.write_scores(scores, str(tmp_path), "m1")
    packs.write_scores(scores.withColumn("prob", F.lit(0.75)), str(tmp_path), "m2")
    assert packs.read_scores(spark, str(tmp_path), "m2").first()["prob"] == 0.75


def test_network_gradients():
    rng = np.random.default_rng(0)
    dims = (5, 4, 3)
    flat = mlp.initial_weights(*dims, 1)
    x, y, pw = rng.standard_normal((6, 5)), (rng.random((6, 3)) < 0.4).astype(float), np.array([1.0, 3.0, 2.0])

    def loss(w):
        p = 1 / (1 + np.exp(-mlp.forward(mlp._unpack(w, *dims), x)[0]))
        return -(pw * y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    got, value = mlp.gradients(mlp._unpack(flat, *dims), x, y, pw)
    assert value == pytest.approx(loss(flat))
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-4
        assert got[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-4, abs=2e-5)


def test_network_learns_a_separable_label(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 6))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    features = spark.createDataFrame(rows, "row_idx bigint, x array<double>")
    truth = spark.createDataFrame([(i, "a", int(r[0] > 0)) for i, r in enumerate(x)], "row_idx bigint, label string, y int")
    cfg = mlp.MlpConfig(hidden=16, epochs=8, batch_size=16, learning_rate=0.02, dropout=0.1)
    network, history = mlp.train(features, truth, features, truth, ["a"], cfg)
    scored = network.scores(features)
    assert history[-1]["loss"] < history[0]["loss"]
    assert history[-1]["macro_f1"] > 0.85
    assert scored.where("prob < 0 or prob > 1").count() == 0
