"""Leakage-free splits. Each returns ``(row_idx, part)`` rows with ``part`` in train / val."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.sequences import numeric_id, sequence_key, sequence_text
from labelweave.operators import metrics
from labelweave.operators.ordered import running_totals
from labelweave.session import materialize


def keyed(proteins: DataFrame) -> DataFrame:
    """The columns splits need; whole sequences are replaced by their digest."""
    return proteins.select(
        "row_idx",
        numeric_id(F.col("protein_id")).alias("num_id"),
        sequence_key(sequence_text(F.col("sequence"))).alias("seq_key"),
    )


def random_group(proteins: DataFrame, val_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Hold out ``ceil(val_size * groups)`` of the distinct sequences, chosen by seeded hash order.

    A row's side depends only on whether its group's hash is at or below one cut value, so rows are
    never joined back to groups. The cut is found by counting groups per hash prefix (at most 65,536
    prefixes) and ordering only the groups under the one prefix that holds it.
    """
    seeded = F.md5(F.concat(sequence_text(F.col("sequence")), F.lit(f"~{seed}")))
    rows = proteins.select("row_idx", seeded.alias("h"))
    groups = rows.select("h").distinct().withColumn("prefix", F.substring("h", 1, 4))
    by_prefix = groups.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.ceil(F.sum("n").over(everything) * F.lit(val_size))
    at_cut = (
        by_prefix.select("prefix", F.sum("n").over(upto).alias("upto"), "n", wanted.alias("wanted"))
        .where("upto >= wanted and upto - n < wanted")
        .select("prefix", (F.col("wanted") - F.col("upto") + F.col("n")).alias("nth"))
    )
    cut = (
        groups.where(F.col("prefix") == at_cut.select("prefix").scalar())
        .withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy("h")))
        .where(F.col("rank") == at_cut.select("nth").scalar())
        .select("h")
    )
    return rows.select("row_idx", F.when(F.col("h") <= cut.scalar(), "val").otherwise("train").alias("part"))


def tail_start(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: the lowest test id when every id of both tables parses, otherwise null."""
    ids = train.select(numeric_id(F.col("protein_id")).alias("id"), F.lit(False).alias("is_test")).unionAll(
        test.select(numeric_id(F.col("protein_id")), F.lit(True))
    )
    return ids.agg(F.when(F.min("id") >= 0, F.min(F.when(F.col("is_test"), F.col("id")))).alias("test_min"))


def tail(train: DataFrame, test: DataFrame) -> DataFrame:
    """``val`` = training rows numbered at or above the lowest test id; empty if any id fails to parse."""
    in_tail = numeric_id(F.col("protein_id")) >= tail_start(train, test).scalar()
    return train.select("row_idx", F.when(in_tail, "val").when(~in_tail, "train").alias("part")).where(
        "part is not null"
    )


def tail_overlap(train: DataFrame, tail_split: DataFrame) -> DataFrame:
    """Tail rows whose exact sequence also occurs in the head."""
    rows = keyed(train).join(tail_split, "row_idx")
    head_keys = rows.where("part = 'train'").select("seq_key").distinct()
    return rows.where("part = 'val'").join(head_keys, "seq_key", "left_semi").select("row_idx", "seq_key")


def tail_clean(train: DataFrame, test: DataFrame) -> DataFrame:
    """The tail split without the tail rows whose sequence the head already has."""
    rows = keyed(train).join(tail(train, test), "row_idx")
    head = rows.where("part = 'train'")
    fresh = rows.where("part = 'val'").join(head.select("seq_key").distinct(), "seq_key", "left_anti")
    return head.select("row_idx", "part").unionByName(fresh.select("row_idx", "part"))


def chronological(train: DataFrame, test: DataFrame, val_size: float = 0.2) -> DataFrame:
    """Hold out whole sequence groups, latest first occurrence first, until the target row count.

    Empty, like the tail split, if any id of either table fails to parse or there is no test row.

    Groups are ordered by first id descending; groups are added while the rows taken so far stay
    below ``max(1, round(n * val_size))``. Group rows are folded per first id before the running
    sum. Only groups that share the first id at the cut need their sequences compared.
    """
    rows = keyed(train).where(tail_start(train, test).scalar().isNotNull())
    groups = materialize(
        rows.groupBy("seq_key").agg(F.min("num_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    )
    per_id = groups.groupBy("first_id").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("groups"))
    ordered = running_totals(per_id, [F.col("first_id").desc()], {"upto": F.col("rows")})
    n_rows = groups.agg(F.sum("rows") * F.lit(val_size)).scalar()
    target = F.greatest(F.lit(1), F.bround(n_rows, 0).cast("bigint"))
    before = F.col("upto") - F.col("rows")
    at_target = ordered.where((F.col("upto") >= target) & (before < target))
    cut = at_target.select("first_id", "groups", (target - before).alias("still_needed")).first()
    if cut is None:
        return rows.select("row_idx", F.lit("train").alias("part"))
    tied = groups.where(F.col("first_id") == cut["first_id"])
    if cut["groups"] > 1:
        # Groups that share the id at the cut are taken in sequence order; only their texts are read.
        texts = (
            train.where(numeric_id(F.col("protein_id")) == cut["first_id"])
            .select(sequence_text(F.col("sequence")).alias("text"))
            .distinct()
            .withColumn("seq_key", sequence_key(F.col("text")))
        )
        tied = running_totals(tied.join(texts, "seq_key"), [F.col("text").asc()], {"upto": F.col("rows")})
        tied = tied.where(before < cut["still_needed"])
    later = groups.where(F.col("first_id") > cut["first_id"]).select("seq_key")
    taken_at_cut = tied.select("seq_key")
    held_out = later.unionAll(taken_at_cut).withColumn("part", F.lit("val"))
    return rows.join(held_out, "seq_key", "left").select(
        "row_idx", F.coalesce(F.col("part"), F.lit("train")).alias("part")
    )


def metadata(train: DataFrame, test: DataFrame, truth: DataFrame, made: dict[str, DataFrame], val_size: float = 0.2, seed: int = 42) -> DataFrame:
    """One row that describes the four splits of ``made``: settings, rows of every side, label drift of the random
    split, the tail's first id, what the clean tail left out, and the first id at which the chronological hold-out starts.
    """
    rows = keyed(train)
    lost = tail_overlap(train, made["tail"])

    def sides(mode: str, part: str) -> DataFrame:
        return made[mode].where(F.col("part") == part).agg(F.count(F.lit(1)))

    cutoff = rows.join(made["chronological"], "row_idx").groupBy("seq_key").agg(F.min("num_id").alias("first_id"), F.max("part").alias("part"))
    cutoff = cutoff.where("part = 'val'").agg(F.min("first_id"))
    drift = metrics.prevalence_drift(truth, made["random"])
    counts = {f"{mode}_{part}_rows": sides(mode, part).scalar() for mode in ("random", "tail", "tail_clean", "chronological") for part in ("train", "val")}
    parts = {f"drift_{part}": drift.where(F.col("part") == part).agg(F.max("drift")).scalar() for part in ("train", "val")}
    one = train.sparkSession.range(1)
    return one.select(
        F.lit(seed).alias("seed"), F.lit(val_size).alias("val_size"), *[c.alias(n) for n, c in {**counts, **parts}.items()],
        tail_start(train, test).scalar().alias("test_min"), lost.agg(F.count(F.lit(1))).scalar().alias("tail_overlap_rows"),
        lost.agg(F.count_distinct("seq_key")).scalar().alias("tail_overlap_groups"), cutoff.scalar().alias("chronological_cutoff"),
    )


def leaked_groups(proteins: DataFrame, split: DataFrame) -> DataFrame:
    """Sequence groups found on both sides of a split (should be none)."""
    return (
        keyed(proteins)
        .join(split, "row_idx")
        .groupBy("seq_key")
        .agg(F.min("part").alias("first"), F.max("part").alias("last"))
        .where("first <> last")
    )


def require_no_leak(proteins: DataFrame, split: DataFrame) -> None:
    if not leaked_groups(proteins, split).isEmpty():
        raise RuntimeError("the same sequence occurs on both sides of the split")
