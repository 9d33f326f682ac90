"""Greedy group folds: biggest group first, each to the fold with the fewest rows so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.sequences import sequence_key, sequence_text
from labelweave.session import materialize


def greedy_phases(loads: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """How ``count`` equal groups of ``size`` rows spread over folds, in closed form.

    The lightest fold catches up first, then shares with the next one, and so on. Returns
    ``(first rank, fold cycle)`` phases and updates ``loads``; a group's fold follows from its rank.
    """
    phases, done = [], 0
    order = sorted(range(len(loads)), key=lambda f: (loads[f], f))
    for active in range(1, len(order) + 1):
        if done == count:
            break
        room = count - done
        if active < len(order):
            rival = order[active]
            takes = [
                max(0, -(-(loads[rival] - loads[f] + (f < rival)) // size)) for f in order[:active]
            ]
            room = min(room, sum(takes))
        if room:
            cycle = sorted(order[:active], key=lambda f: (loads[f], f))
            phases.append((done, cycle))
            for place, f in enumerate(cycle):
                loads[f] += size * ((room - place + active - 1) // active)
            done += room
    return phases


def group_folds(rows: DataFrame, n_splits: int = 2) -> DataFrame:
    """``(row_idx, fold)`` for ``rows`` of ``(row_idx, sequence)``; a sequence never spans folds.

    The greedy pass is sequential, but groups of one size are interchangeable, so only the table of
    distinct sizes is walked on the driver: n rows have at most sqrt(2n) distinct group sizes. A
    group's rank among groups of its size comes from hash buckets, so no size class is ever sorted
    in one task.
    """
    spark = rows.sparkSession
    keyed = rows.select("row_idx", sequence_key(sequence_text(F.col("sequence"))).alias("seq_key"))
    bucket = F.conv(F.substring(F.hex("seq_key"), 1, 3), 16, 10).cast("int")
    groups = materialize(
        keyed.groupBy("seq_key").agg(F.count(F.lit(1)).alias("size")).withColumn("bucket", bucket)
    )
    per_bucket = groups.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_bucket.groupBy("size").agg(F.sum("n").alias("n")).collect()

    loads = [0] * n_splits
    plan = [
        (row["size"], greedy_phases(loads, row["size"], row["n"]))
        for row in sorted(sizes, key=lambda r: -r["size"])
    ]
    plan_df = spark.createDataFrame(plan, "size bigint, phases array<struct<first: bigint, cycle: array<int>>>")

    earlier = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("size", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("seq_key"))
    ranked = groups.withColumn("inside", inside).join(starts, ["size", "bucket"])
    rank = F.col("start") + F.col("inside") - 1
    phase = F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("rank")), -1)
    place = (F.col("rank") - F.col("phase.first")) % F.size("phase.cycle")
    assigned = (
        ranked.withColumn("rank", rank)
        .join(F.broadcast(plan_df), "size")
        .withColumn("phase", phase)
        .select("seq_key", F.element_at("phase.cycle", (place + 1).cast("int")).alias("fold"))
    )
    return keyed.join(assigned, "seq_key").select("row_idx", "fold")


def calibration_rows(scores: DataFrame, n_splits: int) -> DataFrame:
    """Repeat each row for every fold it calibrates: all folds except its own (``cal_fold``)."""
    others = F.filter(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda f: f != F.col("fold"))
    return scores.withColumn("cal_fold", F.explode(others))
