"""Label co-occurrence graph and score propagation along it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.operators import thresholds
from labelweave.operators.blend import best_point
from labelweave.session import shuffle_width

# Smoothing of the lift and of the pair reliability.
LIFT_EPS = 1e-8
RELIABILITY = 100.0


def cooccurrence(truth: DataFrame) -> DataFrame:
    """``(src, dst, n)``: rows that carry both labels, in both directions, without the diagonal.

    Labels are gathered per row (at most one per label column) and paired inside the row, once per
    unordered pair; the map-side aggregation leaves at most labels^2 rows per task to shuffle.
    """
    per_row = truth.where("y = 1").groupBy("row_idx").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    later = F.slice("labels", F.col("pos") + 2, F.size("labels"))
    pairs = (
        per_row.where(F.size("labels") > 1)
        .select("labels", F.posexplode("labels").alias("pos", "a"))
        .select("a", F.explode(later).alias("b"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
            F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
        )
    )
    return pairs.select(both.alias("e"), "n").select("e.src", "e.dst", "n")


def label_graph(truth: DataFrame, topk: int = 20, min_cooc: int = 30) -> DataFrame:
    """``(src, dst, weight)``: per target label, its strongest sources with weights summing to one.

    Strength is the positive log lift of the pair, damped for rare pairs. Every table here has at
    most labels^2 rows.
    """
    support = truth.groupBy("label").agg(F.sum("y").cast("double").alias("s"), F.count(F.lit(1)).alias("n_rows"))
    pairs = (
        cooccurrence(truth)
        .where(F.col("n") >= min_cooc)
        .join(F.broadcast(support.select(F.col("label").alias("src"), F.col("s").alias("s_src"), "n_rows")), "src")
        .join(F.broadcast(support.select(F.col("label").alias("dst"), F.col("s").alias("s_dst"))), "dst")
    )
    expected = F.col("s_src") * F.col("s_dst") / F.greatest(F.col("n_rows"), F.lit(1))
    lift = (F.col("n") + F.lit(LIFT_EPS)) / (expected + F.lit(LIFT_EPS))
    strength = F.greatest(F.log(lift), F.lit(0.0)) * (F.col("n") / (F.col("n") + F.lit(RELIABILITY)))
    order = Window.partitionBy("dst").orderBy(F.round("strength", 12).desc(), "src")
    kept = (
        pairs.withColumn("strength", strength)
        .where("strength > 0")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= topk)
    )
    return kept.select("src", "dst", (F.col("strength") / F.sum("strength").over(Window.partitionBy("dst"))).alias("weight"))


def propagate(scores: DataFrame, graph: DataFrame) -> DataFrame:
    """``(row_idx, label, y, prob, propagated)``: the weighted mean of the row's scores for the label's source labels.

    A target without sources gets 0, a missing score counts as 0. The graph is a matrix of labels by
    labels (at most labels * topk cells are set), which every task has. Score rows meet by ``row_idx``, once; a run of whole rows is one
    matrix, and its product with the graph is every share at once, so nothing is multiplied before the
    shuffle or joined back after it.
    """
    edges = graph.collect()
    names = sorted({r[end] for r in edges for end in ("src", "dst")})
    place = {label: i for i, label in enumerate(names)}
    weights = np.zeros((len(names) + 1, len(names) + 1))  # the last place is for labels that the graph does not know
    for r in edges:
        weights[place[r["src"]], place[r["dst"]]] = r["weight"]
    known = pa.array(names, pa.string())

    def shares(table: pa.Table) -> pa.RecordBatch:
        rows, cell = np.unique(table.column("row_idx").to_numpy(), return_inverse=True)
        label = pc.fill_null(pc.index_in(table.column("label").combine_chunks(), value_set=known), len(names)).to_numpy()
        prob = np.zeros((len(rows), len(weights)))
        prob[cell, label] = np.nan_to_num(table.column("prob").to_numpy())
        spread = pa.array((prob @ weights)[cell, label])
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.columns), spread], [*table.schema.names, "propagated"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            ids = table.column("row_idx").to_numpy()
            whole = int(np.searchsorted(ids, ids[-1]))  # the last row may go on in the next batch
            if whole:
                yield shares(table.slice(0, whole))
            held = table.slice(whole)
        if held is not None:
            yield shares(held)

    cells = scores.select(F.col("row_idx").cast("bigint").alias("row_idx"), "label", F.col("y").cast("int").alias("y"), F.col("prob").cast("double").alias("prob"))
    met = cells.repartition(shuffle_width(scores.sparkSession), "row_idx").sortWithinPartitions("row_idx")
    return met.mapInArrow(work, "row_idx bigint, label string, y int, prob double, propagated double")


def beta_grid(propagated: DataFrame, betas: Sequence[float], cfg: thresholds.ThresholdConfig) -> DataFrame:
    """For each share of propagated score: the best global threshold and the macro-F1 it gives."""
    grid = F.array(*[F.struct(F.lit(i).alias("grid_id"), F.lit(float(b)).alias("beta")) for i, b in enumerate(betas)])
    points = propagated.withColumn("g", F.explode(grid))
    prob = (F.lit(1.0) - F.col("g.beta")) * F.col("prob") + F.col("g.beta") * F.col("propagated")
    points = points.select("g.grid_id", "g.beta", "label", "row_idx", "y", F.round(prob, 9).alias("prob"))
    return thresholds.best_global(points, cfg, ["grid_id", "beta"])


def best_beta(grid: DataFrame) -> DataFrame:
    return best_point(grid)
