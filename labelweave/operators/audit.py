"""Data-quality report over the train and test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.sequences import (
    STANDARD_RESIDUES,
    numeric_id,
    sequence_key,
    sequence_text,
)


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max of a small-domain number."""
    quartiles = F.percentile(column, [0.25, 0.5, 0.75])
    return df.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).cast("double").alias("min"),
        quartiles[0].alias("p25"),
        quartiles[1].alias("p50"),
        quartiles[2].alias("p75"),
        F.max(column).cast("double").alias("max"),
    )


def length_stats(proteins: DataFrame) -> DataFrame:
    return describe(proteins.select(F.length(sequence_text(F.col("sequence"))).alias("length")), "length")


def nonstandard_residues(proteins: DataFrame) -> DataFrame:
    """Occurrences of every character outside the twenty standard residues.

    Standard residues are removed before the text is cut up, so only the exceptions are exploded.
    """
    rest = F.translate(sequence_text(F.col("sequence")), STANDARD_RESIDUES, "")
    return (
        proteins.select(F.explode(F.split(rest, "")).alias("residue"))
        .where("residue <> ''")
        .groupBy("residue")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def duplicate_sequences(proteins: DataFrame) -> DataFrame:
    """One row: rows that share their sequence with another row, and how many such groups."""
    groups = proteins.groupBy(sequence_key(sequence_text(F.col("sequence"))).alias("k")).agg(
        F.count(F.lit(1)).alias("n")
    )
    repeated = F.col("n") > 1
    return groups.agg(
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("duplicate_sequence_rows"),
        F.count(F.when(repeated, 1)).alias("duplicate_sequence_groups"),
    )


def duplicate_ids(proteins: DataFrame) -> DataFrame:
    """One row: how many rows repeat an id already seen."""
    per_id = proteins.groupBy("protein_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_protein_id"))


def missing_cells(df: DataFrame) -> DataFrame:
    nulls = [F.count(F.when(F.col(c).isNull(), 1)) for c in df.columns]
    return df.agg(sum(nulls[1:], nulls[0]).alias("missing_cells"))


def table_summary(proteins: DataFrame) -> DataFrame:
    """Row count, duplicate ids and sequences, missing cells, length statistics as metric rows."""
    lengths = length_stats(proteins)
    parts = [
        proteins.agg(F.count(F.lit(1)).alias("n_rows")),
        duplicate_ids(proteins),
        duplicate_sequences(proteins),
        missing_cells(proteins.select("protein_id", "sequence")),
        lengths.select([F.col(c).alias(f"length_{c}") for c in lengths.columns]),
    ]
    rows = [
        part.select([F.col(c).cast("double").alias(c) for c in part.columns]).unpivot(
            [], part.columns, "metric", "value"
        )
        for part in parts
    ]
    return reduce(DataFrame.unionAll, rows)


def label_summary(truth: DataFrame) -> DataFrame:
    """Label count, density and the spread of positive counts: two-level aggregation."""
    per_label = truth.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("pos"))
    return per_label.agg(
        F.count(F.lit(1)).alias("label_count"),
        (F.sum("pos") / F.sum("n")).alias("density"),
        F.min("pos").alias("positive_count_min"),
        F.percentile("pos", F.lit(0.5)).alias("positive_count_median"),
        F.avg("pos").alias("positive_count_mean"),
        F.max("pos").alias("positive_count_max"),
    )


def _shared(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    return left.select(key.alias("k")).intersect(right.select(key.alias("k"))).agg(F.count(F.lit(1)).alias("shared"))


def overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct ids and distinct sequences the two tables have in common."""
    ids = _shared(train, test, F.col("protein_id")).select(F.lit("protein_id").alias("key"), "shared")
    seqs = _shared(train, test, sequence_key(sequence_text(F.col("sequence"))))
    return ids.unionAll(seqs.select(F.lit("exact_sequence"), "shared"))


def id_ranges(proteins: DataFrame) -> DataFrame:
    nid = numeric_id(F.col("protein_id"))
    return proteins.agg(
        F.min(F.when(nid >= 0, nid)).alias("numeric_min"), F.max(F.when(nid >= 0, nid)).alias("numeric_max")
    )


def tail_summary(train: DataFrame, truth: DataFrame, tail_split: DataFrame) -> DataFrame:
    """Size, length and label statistics of the tail; no row when there is no tail."""
    per_row = truth.groupBy("row_idx").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    rows = (
        train.select("row_idx", F.length(sequence_text(F.col("sequence"))).alias("length"))
        .join(tail_split, "row_idx")
        .join(per_row, "row_idx")
    )
    is_tail = F.col("part") == "val"
    in_tail = lambda c: F.when(is_tail, F.col(c))
    return rows.agg(
        F.count(F.when(is_tail, 1)).alias("tail_samples"),
        F.count(F.when(~is_tail, 1)).alias("head_samples"),
        F.avg(in_tail("length")).alias("length_mean"),
        F.percentile(in_tail("length"), F.lit(0.5)).alias("length_median"),
        F.avg(in_tail("pos")).alias("labels_per_sample_mean"),
        (F.sum(in_tail("pos")) / F.sum(in_tail("n"))).alias("label_density"),
    ).where("tail_samples > 0")
