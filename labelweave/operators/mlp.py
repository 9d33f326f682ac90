"""One-hidden-layer multi-label network, trained data-parallel.

LayerNorm, linear, GELU, dropout, linear; class-weighted log-loss; AdamW. Every epoch is one Spark
job: each partition takes minibatch steps from the shared weights over its own rows, in a new random
order, and the partitions' weights and optimizer moments are averaged by row count. Only that state
travels, never the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions import scoring
from labelweave.operators import metrics
from labelweave.operators.sums import gathered, in_chunks
from labelweave.session import materialize, shuffle_width


@dataclass(frozen=True)
class MlpConfig:
    """The default classifier head."""

    hidden: int = 512
    dropout: float = 0.30
    batch_size: int = 1024
    epochs: int = 30
    learning_rate: float = 1e-3
    weight_decay: float = 1e-4
    max_pos_weight: float = 20.0
    patience: int = 5
    seed: int = 42


def _shapes(dim: int, hidden: int, labels: int) -> list[tuple[int, ...]]:
    return [(dim,), (dim,), (dim, hidden), (hidden,), (hidden, labels), (labels,)]


def _unpack(flat: np.ndarray, dim: int, hidden: int, labels: int) -> list[np.ndarray]:
    shapes = _shapes(dim, hidden, labels)
    cuts = np.cumsum([math.prod(s) for s in shapes])[:-1]
    return [part.reshape(s) for part, s in zip(np.split(flat, cuts), shapes)]


def initial_weights(dim: int, hidden: int, labels: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    near, far = 1 / math.sqrt(dim), 1 / math.sqrt(hidden)
    return np.concatenate(
        [np.ones(dim), np.zeros(dim), rng.uniform(-near, near, dim * hidden), rng.uniform(-near, near, hidden),
         rng.uniform(-far, far, hidden * labels), rng.uniform(-far, far, labels)]
    )


def _erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def forward(weights: Sequence[np.ndarray], x: np.ndarray, mask: np.ndarray | float = 1.0):
    """Logits, and what the backward pass needs."""
    scale, shift, w1, b1, w2, b2 = weights
    centred = x - x.mean(axis=1, keepdims=True)
    spread = 1 / np.sqrt((centred**2).mean(axis=1, keepdims=True) + 1e-5)
    normed = centred * spread
    a = (normed * scale + shift) @ w1 + b1
    cdf = 0.5 * (1 + _erf(a / math.sqrt(2)))
    h = a * cdf * mask
    return h @ w2 + b2, (normed, a, cdf, h)


def gradients(weights: Sequence[np.ndarray], x: np.ndarray, y: np.ndarray, pos_weight: np.ndarray, mask=1.0) -> tuple[np.ndarray, float]:
    """Gradient of the mean class-weighted log-loss, flattened like the weights, and that loss."""
    scale, shift, w1, b1, w2, b2 = weights
    logits, (normed, a, cdf, h) = forward(weights, x, mask)
    z = np.clip(logits, -60, 60)
    p = 1 / (1 + np.exp(-z))
    loss = ((1 - y) * np.logaddexp(0, z) + pos_weight * y * np.logaddexp(0, -z)).mean()
    d_logits = ((1 - y) * p - pos_weight * y * (1 - p)) / y.size
    density = np.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    d_a = (d_logits @ w2.T) * mask * (cdf + a * density)
    d_in = d_a @ w1.T
    parts = [(d_in * normed).sum(0), d_in.sum(0), (normed * scale + shift).T @ d_a, d_a.sum(0), h.T @ d_logits, d_logits.sum(0)]
    return np.concatenate([p.ravel() for p in parts]), float(loss)


@dataclass(frozen=True)
class State:
    """Weights, both moments of their gradients, and the steps taken."""

    flat: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    step: float = 0.0

    @staticmethod
    def fresh(flat: np.ndarray) -> State:
        return State(flat, np.zeros_like(flat), np.zeros_like(flat))

    def stepped(self, g: np.ndarray, cfg: MlpConfig) -> State:
        """One AdamW step."""
        step, mean, square = self.step + 1, 0.9 * self.mean + 0.1 * g, 0.999 * self.square + 0.001 * g * g
        update = (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        return State(self.flat * (1 - cfg.learning_rate * cfg.weight_decay) - cfg.learning_rate * update, mean, square, step)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def local_epoch(batches, state: State, dims: tuple[int, int, int], pos_weight: np.ndarray, cfg: MlpConfig, rng: np.random.Generator) -> tuple[State, int, float]:
    """Minibatch steps over ``(x, y)`` batches in their order: the state after them, rows, and the sum of their losses."""
    seen, total = 0, 0.0
    for x, y in batches:
        mask = (rng.random((len(x), dims[1])) >= cfg.dropout) / (1 - cfg.dropout)
        g, loss = gradients(_unpack(state.flat, *dims), x, y, pos_weight, mask)
        state = state.stepped(g, cfg)
        seen, total = seen + len(x), total + loss * len(x)
    return state, seen, total


def _minibatches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``size`` rows at a time, across Arrow batches; the last one of a partition may be smaller."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((_matrix(batch.column(0)), _matrix(batch.column(1))) if batch.num_rows else (np.zeros((0, 1)), np.zeros((0, 1))))
        held = [h for h in held if len(h[0])]
        while sum(len(x) for x, _ in held) >= size:
            x, y = (np.concatenate(part) for part in zip(*held))
            yield x[:size], y[:size]
            held = [(x[size:], y[size:])] if len(x) > size else []
    if held:
        yield tuple(np.concatenate(part) for part in zip(*held))


def epoch_rows(rows: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Rows of each partition in the epoch's random order; the sort may spill, so a partition need not fit in memory."""
    return rows.sortWithinPartitions(F.xxhash64("row_idx", F.lit(seed), F.lit(epoch))).select("x", "ys")


def _epoch(rows: DataFrame, start: State, dims: tuple[int, int, int], pos_weight: np.ndarray, cfg: MlpConfig, epoch: int) -> tuple[State, float]:
    """State after one epoch and the epoch's mean loss by row."""
    shared = rows.sparkSession.sparkContext.broadcast(start)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([cfg.seed, epoch])
        state, seen, loss = local_epoch(_minibatches(batches, cfg.batch_size), shared.value, dims, pos_weight, cfg, rng)
        if seen:
            yield from in_chunks(np.stack([state.flat, state.mean, state.square], axis=1) * seen, np.array([seen, state.step * seen, loss]))

    parts = epoch_rows(rows, cfg.seed, epoch).mapInArrow(learn, "chunk int, sums binary")
    total, extra = gathered(parts, (len(start.flat), 3))
    shared.destroy()
    total /= extra[0]
    return State(total[:, 0].copy(), total[:, 1].copy(), total[:, 2].copy(), extra[1] / extra[0]), float(extra[2] / extra[0])


def predict(features: DataFrame, weights: np.ndarray, dims: tuple[int, int, int], labels: Sequence[str]) -> DataFrame:
    """``(row_idx, label, prob)`` from ``(row_idx, x)``."""
    shared = features.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _unpack(shared.value, *dims)
        for batch in batches:
            logits = forward(parts, _matrix(batch.column(1)))[0] if batch.num_rows else np.zeros((0, dims[2]))
            rows = pa.array(list(logits), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["row_idx", "z"])

    names = F.array(*[F.lit(label) for label in labels])
    cells = features.select("row_idx", "x").mapInArrow(score, "row_idx bigint, z array<double>").select(
        "row_idx", F.explode(F.arrays_zip(names.alias("label"), F.col("z").alias("z"))).alias("c")
    )
    return cells.select("row_idx", F.col("c.label").alias("label"), scoring.sigmoid(F.col("c.z")).alias("prob"))


@dataclass(frozen=True)
class Network:
    """Trained weights with what is needed to score by them."""

    weights: np.ndarray
    dims: tuple[int, int, int]
    labels: tuple[str, ...]

    def scores(self, features: DataFrame) -> DataFrame:
        return predict(features, self.weights, self.dims, self.labels)


def stopping_point(values: Sequence[float], patience: int, least: float = 1e-6) -> tuple[int, int]:
    """Places of the best value and of the last one that training reaches: it ends after ``patience`` values in a row
    that do not pass the best one by more than ``least``."""
    best, misses, at = 0, 0, 0
    for at, value in enumerate(values):
        if at == 0 or value > values[best] + least:
            best, misses = at, 0
        else:
            misses += 1
            if misses >= patience:
                break
    return best, at


def early_stop(history: DataFrame, patience: int, by: Sequence[str] = (), least: float = 1e-6) -> DataFrame:
    """``by, best_epoch, best_value, stop_epoch`` from an epoch table ``(by, epoch, value)``.

    A run's epochs are one short list (epochs are bounded by the settings), folded in their order; runs
    spread over tasks.
    """
    start = F.struct(
        F.lit(None).cast("int").alias("best"), F.lit(None).cast("double").alias("value"), F.lit(0).alias("misses"), F.lit(None).cast("int").alias("stop")
    )

    def step(acc, e):
        better = acc["value"].isNull() | (e["value"] > acc["value"] + least)
        misses = F.when(better, F.lit(0)).otherwise(acc["misses"] + 1)
        moved = F.struct(
            F.when(better, e["epoch"]).otherwise(acc["best"]).alias("best"), F.when(better, e["value"]).otherwise(acc["value"]).alias("value"),
            misses.alias("misses"), F.when(misses >= patience, e["epoch"]).alias("stop"),
        )
        return F.when(acc["stop"].isNotNull(), acc).otherwise(moved)

    epochs = F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), F.col("value").cast("double").alias("value"))))
    runs = history.groupBy(*by).agg(epochs.alias("e")).withColumn("end", F.aggregate("e", start, step))
    last = F.coalesce(F.col("end.stop"), F.element_at("e", -1)["epoch"])
    return runs.select(*by, F.col("end.best").alias("best_epoch"), F.col("end.value").alias("best_value"), last.alias("stop_epoch"))


def train(
    features: DataFrame, truth: DataFrame, val_features: DataFrame, val_truth: DataFrame, labels: Sequence[str], cfg: MlpConfig
) -> tuple[Network, list[dict]]:
    """The network of the best epoch, and the history: loss by row, macro-F1 and labels per row of each epoch.

    ``features`` is ``(row_idx, x array<double>)``. Training stops after ``patience`` epochs without a gain.
    """
    positives = truth.where("y = 1").groupBy("row_idx").agg(F.collect_list("label").alias("has"))
    ys = F.array(*[F.array_contains(F.coalesce("has", F.array().cast("array<string>")), label).cast("double") for label in labels])
    spread = features.repartition(shuffle_width(features.sparkSession), "row_idx")
    rows = materialize(spread.join(positives, "row_idx", "left").select("row_idx", "x", ys.alias("ys")))
    first = rows.agg(F.first(F.size("x")), F.count(F.lit(1)), *[F.sum(F.col("ys")[i]) for i in range(len(labels))]).first()
    dim, n, pos = first[0], first[1], np.array(first[2:], dtype=float)
    pos_weight = np.clip((n - pos) / np.maximum(pos, 1), 1, cfg.max_pos_weight)
    dims = (dim, cfg.hidden, len(labels))
    state, history, kept = State.fresh(initial_weights(*dims, cfg.seed)), [], None
    for epoch in range(1, cfg.epochs + 1):
        state, loss = _epoch(rows, state, dims, pos_weight, cfg, epoch)
        scored = predict(val_features, state.flat, dims, labels).join(val_truth.select("row_idx", "label", "y"), ["row_idx", "label"])
        result = metrics.threshold_metrics(scored, 0.5).first()
        history.append({"epoch": epoch, "loss": loss, "macro_f1": result["macro_f1"], "labels_per_sample": result["predicted_labels_per_sample"]})
        values = [h["macro_f1"] for h in history]
        best, _ = stopping_point(values, cfg.patience)
        kept = state.flat if best == epoch - 1 else kept
        if epoch - 1 - best >= cfg.patience:
            break
    return Network(kept if kept is not None else state.flat, dims, tuple(labels)), history
