"""Pooling of token and chunk vectors into one vector per sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mean_by_position(rows: DataFrame, key: str, vector: str, keep: Column) -> DataFrame:
    """``(key, dim, value)``: element-wise mean of the kept vectors, 0 when none is kept.

    Sums are partial per task, so a sequence with very many vectors costs one row per dimension.
    """
    parts = rows.select(key, keep.alias("_keep"), F.posexplode(vector).alias("dim", "_x"))
    total = F.sum(F.when(F.col("_keep"), F.col("_x").cast("double")).otherwise(0.0))
    return parts.groupBy(key, "dim").agg(
        (total / F.greatest(F.count(F.when(F.col("_keep"), 1)), F.lit(1))).alias("value")
    )


def masked_mean(tokens: DataFrame) -> DataFrame:
    """Mean token vector per ``seq_id`` without the first and the last attended token.

    ``tokens`` is ``(seq_id, pos, vector, attended)`` with attended positions first.
    """
    lengths = tokens.groupBy("seq_id").agg(F.count(F.when(F.col("attended"), 1)).alias("length"))
    inner = F.col("attended") & (F.col("pos") > 0) & (F.col("pos") < F.col("length") - 1)
    return _mean_by_position(tokens.join(lengths, "seq_id"), "seq_id", "vector", inner)


def chunk_mean(chunk_vectors: DataFrame) -> DataFrame:
    """Unweighted mean of a sequence's chunk vectors."""
    return _mean_by_position(chunk_vectors, "seq_id", "vector", F.lit(True))
