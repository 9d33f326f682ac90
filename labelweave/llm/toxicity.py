"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm import common


@dataclass(frozen=True)
class ToxicityConfig:
    """Settings of the classifier; ``max_rows_per_class`` bounds the labelled sample it is fitted on."""

    buckets: int = 1 << 17
    width: int = 8
    min_gram: int = 3
    max_gram: int = 5
    epochs: int = 20
    batch: int = 64
    rate: float = 0.01
    min_docs: int = 3
    min_deviations: float = 5.0
    max_rows_per_class: int = 4000
    seed: int = 5


class Grams(dict):
    """Word to the buckets of its character n-grams and of itself; emptied at 200,000 words."""

    def __init__(self, cfg: ToxicityConfig):
        super().__init__()
        self.cfg = cfg

    def __missing__(self, word: bytes) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        cfg, text = self.cfg, b"<" + word + b">"
        crc, n = zlib.crc32, len(text)
        found = [crc(text[i : i + k]) for k in range(cfg.min_gram, cfg.max_gram + 1) for i in range(n - k + 1)]
        found.append(crc(text, 1))
        value = self[word] = np.array(found, np.int64) % cfg.buckets
        return value


def bag(text: bytes | None, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights: the mean over words of the mean over a word's n-grams."""
    counts: dict[bytes, int] = {}
    for w in common.words(text):
        counts[w] = counts.get(w, 0) + 1
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    parts = [grams[w] for w in counts]
    sizes = np.array([len(p) for p in parts])
    weight = np.array(list(counts.values())) / sizes / sum(counts.values())
    cells, place = np.unique(np.concatenate(parts), return_inverse=True)
    return cells, np.bincount(place, np.repeat(weight, sizes)).astype(np.float32)


def telling(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cfg: ToxicityConfig) -> np.ndarray:
    """Which buckets get an embedding: those that documents of label 1 hold more often than chance by
    ``min_deviations`` standard deviations, in at least ``min_docs`` documents. Without this choice a
    bag of rare syllables learns single documents by heart."""
    held, toxic = np.zeros(cfg.buckets), np.zeros(cfg.buckets)
    for (cells, _), y in zip(bags, labels):
        held[cells] += 1
        toxic[cells] += y
    share = labels.mean() if len(labels) else 0.0
    spread = np.sqrt(np.maximum(held * share * (1 - share), 1e-9))
    return (held >= cfg.min_docs) & (toxic - held * share >= cfg.min_deviations * spread)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, cfg: ToxicityConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and biases by Adam on the weighted log-loss."""
    rng = np.random.default_rng(cfg.seed)
    emb = rng.normal(0, 0.1, (cfg.buckets, cfg.width)).astype(np.float32)
    soft = rng.normal(0, 0.5, (cfg.width, 2)).astype(np.float32)
    prior = np.clip(np.average(labels, weights=weights), 1e-4, 1 - 1e-4)
    bias = np.log(np.array([1 - prior, prior], np.float32))
    scale = np.float32(30)
    params = [emb, soft, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(cfg.epochs):
        order = rng.permutation(len(bags))
        for start in range(0, len(order), cfg.batch):
            rows = order[start : start + cfg.batch]
            owner = np.repeat(np.arange(len(rows)), [len(bags[i][0]) for i in rows])
            if not len(owner):
                continue
            cells = np.concatenate([bags[i][0] for i in rows])
            share = np.concatenate([bags[i][1] for i in rows]) * scale
            hidden = np.stack([np.bincount(owner, emb[cells, d] * share, len(rows)) for d in range(cfg.width)], 1).astype(np.float32)
            logits = hidden @ soft + bias
            logits -= logits.max(1, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(rows)), labels[rows]] -= 1
            prob *= (weights[rows] / len(rows))[:, None]
            back = prob @ soft.T
            grad = np.stack([np.bincount(cells, back[owner, d] * share, cfg.buckets) for d in range(cfg.width)], 1).astype(np.float32)
            step += 1
            for p, g, m, v in zip(params, (grad, hidden.T @ prob, prob.sum(0)), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= cfg.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return emb * scale, soft, bias


def labelled_sample(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig) -> DataFrame:
    """``(text, toxic, weight)``: at most max_rows_per_class training rows of each class.

    Rows are taken in the order of a hash of their id; weights restore the share of each class. Ids
    on a held-out remainder, null ids and labels other than 0 and 1 are left out; of repeated labels
    the larger counts.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id")))
    totals = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    chosen = None
    for y, n in totals.items():
        part = marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.max_rows_per_class)
        part = part.withColumn("weight", F.lit(max(1.0, n / cfg.max_rows_per_class)))
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        chosen = marks.withColumn("weight", F.lit(1.0))
    texts = docs.select(F.col("doc_id"), common.as_bytes("text").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", "weight")


def held_out(doc_id):
    """Documents that are never learned from: crc32 of the id's digits is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> tuple[np.ndarray, float]:
    """Per-bucket logit and bias of label 1 against label 0.

    The labelled sample is bounded by the configuration, so one task trains on it; the driver gets
    one number per bucket. With a single class the bias alone says the share of 1; without labels
    nothing is known to be toxic and every score is 0.0001.
    """

    def learn(batches):
        grams, bags, marks, weights, ids = Grams(cfg), [], [], [], []
        for batch in batches:
            for doc, text, toxic, weight in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic", "weight"))):
                bags.append(bag(text, grams))
                marks.append(toxic)
                weights.append(weight)
                ids.append(doc)
        if not ids:
            return
        order = np.argsort(np.array(ids), kind="stable")
        bags = [bags[i] for i in order]
        labels_in, weights_in = np.array(marks, int)[order], np.array(weights, np.float32)[order]
        keep = telling(bags, labels_in, cfg)
        bags = [(cells[keep[cells]], share[keep[cells]]) for cells, share in bags]
        emb, soft, bias = train(bags, labels_in, weights_in, cfg)
        logit = np.where(keep, emb @ (soft[:, 1] - soft[:, 0]), 0)
        values = np.r_[logit, bias[1] - bias[0]].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["cell", "value"])

    learned = labelled_sample(docs, labels, cfg).repartition(1).mapInArrow(learn, "cell int, value double").toPandas()
    values = learned.sort_values("cell")["value"].to_numpy()
    if not len(values):  # no labelled row reached the training task
        return np.zeros(cfg.buckets), float(np.log(1e-4 / (1 - 1e-4)))
    return values[:-1], float(values[-1])


class WordLogit(dict):
    """Word to its part of the logit; emptied when it holds a million words."""

    def __init__(self, logit: np.ndarray, cfg: ToxicityConfig):
        super().__init__()
        self.logit, self.cfg = logit.tolist(), cfg

    def __missing__(self, word: bytes) -> float:
        if len(self) > 1_000_000:
            self.clear()
        cfg, text, logit = self.cfg, b"<" + word + b">", self.logit
        crc, n, size = zlib.crc32, len(text), cfg.buckets
        total, many = logit[crc(text, 1) % size], 1
        for k in range(cfg.min_gram, cfg.max_gram + 1):
            for i in range(n - k + 1):
                total += logit[crc(text[i : i + k]) % size]
                many += 1
        value = self[word] = total / many
        return value


def score(docs: DataFrame, model: tuple[np.ndarray, float], cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``docs(text, ...)`` with ``score`` (probability of label 1) and ``predicted`` (score >= 0.5).

    The softmax is linear, so a text's logit is the mean of its words' logits plus the bias; each
    task works out a word once. Null, empty and wordless texts get the bias's score. Whole texts are
    read; repeated rows are scored each; columns named like the added ones are replaced.
    """
    logit, bias = model

    def mean_logit(texts: pd.Series, memo: WordLogit) -> list[float]:
        out = []
        for text in texts:
            own = common.words(text)
            out.append(bias + (sum(map(memo.__getitem__, own)) / len(own) if own else 0.0))
        return out

    @F.pandas_udf("double")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = WordLogit(logit, cfg)
        for texts in batches:
            yield pd.Series(mean_logit(texts, memo))

    return docs.drop("score", "predicted", "_z").withColumn("_z", logits(common.as_bytes("text"))).select(
        "*", (1 / (1 + F.exp(-F.col("_z")))).alias("score"), (F.col("_z") >= 0).cast("int").alias("predicted")
    ).drop("_z")
