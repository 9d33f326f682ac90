"""Embedding near-dedup: binary codes of rotated vectors bound every cosine; few are recomputed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm import common
from labelweave.session import materialize

SIGMAS = 6.0


def rotation(width: int, code: int, seed: int) -> np.ndarray:
    """``width`` orthonormal directions of a random rotation in ``code`` dimensions."""
    square = np.random.default_rng(seed).normal(size=(code, code))
    q, r = np.linalg.qr(square)
    return (q * np.sign(np.diag(r)))[:width]


def code_width(width: int) -> int:
    """Bits per vector: at least 128, so that the bounds are narrow; vectors are padded with zeros."""
    return max(128, -(-width // 64) * 64)


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated unit vectors, and each one's inner product with its own code."""
    turned = units @ turn
    bits = turned >= 0
    own = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
    return np.packbits(bits, axis=1), own


def bounds(bits: np.ndarray, own: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosines of coded vectors with rotated queries, and half-widths.

    <code, query> / <code, vector> estimates <vector, query>; its error is at most
    sqrt((1 - own^2) / own^2) / sqrt(bits - 1) times a number that exceeds SIGMAS with negligible
    probability, whatever the data.
    """
    code = bits.shape[1] * 8
    signs = (np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(code))
    estimate = (signs @ queries.T.astype(np.float32)) / own[:, None].astype(np.float32)
    half = SIGMAS * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(code - 1)
    return estimate, half


def coded(vectors: DataFrame, seed: int) -> DataFrame:
    """``(vec_id, label, unit, code, own)`` for every usable distinct row of ``vectors``."""
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & sound & F.exists("embedding", lambda x: x != 0))
    usable = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).distinct()

    def code(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            columns = [[], [], [], [], []]
            for vec, label, values in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))):
                row = np.array(values)
                row = row / np.abs(row).max()
                unit = (row / np.sqrt(row @ row))[None, :]
                width = len(values)
                if width not in turns:
                    turns[width] = rotation(width, code_width(width), seed)
                bits, own = encode(unit, turns[width])
                for c, v in zip(columns, (vec, f"{width}:{label}", unit.tobytes(), bits.tobytes(), float(own[0]))):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["vec_id", "label", "unit", "code", "own"])

    return usable.mapInArrow(code, "vec_id long, label string, unit binary, code binary, own double")


def _compare(table: pa.Table, threshold: float, seed: int) -> pa.Table:
    """One block pair of one label: links per vector, ties, and how many pairs the bounds left open."""
    side = table.column("side").to_numpy()
    ids = table.column("vec_id").to_numpy()
    crossed = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    units = np.stack([np.frombuffer(u, np.float64) for u in table.column("unit").to_pylist()])
    codes = np.stack([np.frombuffer(c, np.uint8) for c in table.column("code").to_pylist()])
    own = table.column("own").to_numpy()
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if crossed else left
    counts, tie = np.zeros(len(ids), np.int64), np.arange(len(ids))
    opened = 0
    if len(left) and len(right):
        turn = rotation(units.shape[1], codes.shape[1] * 8, seed)
        estimate, half = bounds(codes[left], own[left], units[right] @ turn)
        open_a, open_b = np.nonzero(estimate + half[:, None].astype(np.float32) + 1e-5 >= threshold)
        if not crossed:
            # either direction's bound may leave a pair open; the pair is decided once
            both = np.unique(np.minimum(open_a, open_b) * len(left) + np.maximum(open_a, open_b))
            open_a, open_b = both // len(left), both % len(left)
            keep = open_a != open_b
            open_a, open_b = open_a[keep], open_b[keep]
        opened = len(open_a)
        for start in range(0, opened, 100_000):
            a, b = left[open_a[start : start + 100_000]], right[open_b[start : start + 100_000]]
            linked = (np.einsum("ij,ij->i", units[a], units[b]) >= threshold) & (ids[a] != ids[b])
            a, b = a[linked], b[linked]
            np.add.at(counts, a, 1)
            np.add.at(counts, b, 1)
            while True:  # smallest row reachable
                low = np.minimum(tie[a], tie[b])
                if (tie[a] == low).all() and (tie[b] == low).all():
                    break
                np.minimum.at(tie, a, low)
                np.minimum.at(tie, b, low)
    hit = np.flatnonzero(counts)
    n = len(hit)
    return pa.table({
        "vec_id": pa.array(np.r_[ids[hit], [-1]]), "links": pa.array(np.r_[counts[hit], [0]]),
        "tie": pa.array(np.r_[ids[tie[hit]], [-1]]), "opened": pa.array(np.r_[np.zeros(n, np.int64), [opened]]),
    })


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block_rows: int = 1024, seed: int = 9) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vec_id of ``vectors(vec_id, embedding, label)``.

    Two vectors are linked when their labels are equal and their cosine, in double precision, is at
    least ``threshold``. ``component_id`` is the smallest vec_id reachable by links.

    Each vector is turned by one random rotation and kept as sign bits with its inner product with
    its own code. In a block pair the codes give unbiased estimates of all cosines with bounds at six
    standard errors; only pairs whose upper bound reaches the threshold are recomputed exactly.
    A label is cut into blocks of about ``block_rows`` vectors by a hash, and each pair of blocks is a
    group of its own, so a label with most of the rows spreads over many tasks; tasks return a count
    and one tie per linked vector, never pairs. Work inside a label stays quadratic, as the labels
    alone say which vectors may be left apart.

    Null, zero and non-finite vectors, and rows without label, link with nothing. Identical rows count
    once; different vectors under one vec_id each take part and never link with each other. Vectors of
    different length are never compared. Rows without vec_id are left out. Extra columns are ignored;
    an empty table gives an empty table.
    """
    rows = materialize(coded(vectors.select("vec_id", "embedding", "label"), seed))
    blocks = rows.groupBy("label").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    placed = rows.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("vec_id", "code"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = placed.select("*", other).select(
        "label", "vec_id", "unit", "code", "own", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    schema = "vec_id long, links long, tie long, opened long"
    found = materialize(spread.groupBy("label", "i", "j").applyInArrow(lambda t: _compare(t, threshold, seed), schema))
    linked = found.where("links > 0")
    classes = common.components(linked.select(F.col("vec_id").alias("a"), F.col("tie").alias("b")))
    links = linked.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    every = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    out = every.join(links, "vec_id", "left").join(classes.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept")
    )
