"""Sharding by longest processing time: equal texts stay together, shards get near-equal bytes."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.session import materialize

SLICES = 4096
EXACT = 16


def _classes(size):
    """Size class of a group: the size itself up to 2**16 bytes, above that 4,096 steps per doubling.

    At most 2**16 + 48 * 4096 classes exist, whatever the data.
    """
    power = F.floor(F.log2(size.cast("double")))
    step = F.pow(F.lit(2.0), F.greatest(power - 12, F.lit(0)))
    return F.when(size < 2**EXACT, size).otherwise((F.floor(size / step) * step).cast("long"))


def longest_first(mean: np.ndarray, count: np.ndarray, n_shards: int) -> np.ndarray:
    """How many of each class's groups every shard gets; classes come largest first.

    A heap holds the loads; each group goes to the least-loaded shard, the lower number in a tie. A
    class of many groups is first filled up to a common level (which the heap would reach as well),
    the remainder goes through the heap one by one.
    """
    loads = np.zeros(n_shards)
    dealt = np.zeros((len(mean), n_shards), np.int64)
    for c, (size, left) in enumerate(zip(mean, count)):
        if left > 4 * n_shards:
            by_load = np.sort(loads)
            room = left * size
            level = next(
                lv for k in range(n_shards, 0, -1) if (lv := (by_load[:k].sum() + room) / k) >= by_load[k - 1]
            )
            whole = np.maximum(np.floor((level - loads) / size).astype(np.int64) - 1, 0)
            dealt[c] += whole
            loads += whole * size
            left -= int(whole.sum())
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(left):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            dealt[c, s] += 1
            loads[s] += size
    return dealt


def shard_groups(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, group_key, group_rows)`` for every row of ``docs(doc_id, text, ...)``.

    ``size`` is the UTF-8 length of the text plus 1 (null: 1); ``text_crc32`` is of the text's bytes
    (null: of none, 0). Rows with equal texts form a group (all null texts form one, apart from the
    empty ones) and share a shard; groups go, largest total first, to the least-loaded shard through
    a heap. Groups of one size are interchangeable, so the schedule is made from the table of sizes
    (exact up to 64 KiB, above that within 1/4096) with the number of groups of each: bounded, however
    many groups there are. Groups are numbered inside their size class by counting in hash slices, so
    no task sorts a whole class or shard. ``slot`` numbers a shard's rows from 0 without gaps, also
    by counting in slices; repeated rows get slots of their own.

    An empty table gives an empty table; extra columns are ignored.
    """
    text = F.col("text").cast("string")
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    rows = materialize(docs.select(
        F.col("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(text.isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(raw, 256))).alias("group_key"),
    ))
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("group_rows"))
    groups = materialize(groups.withColumn("cls", _classes(F.col("bytes"))).withColumn("slice", F.pmod(F.xxhash64("group_key"), F.lit(SLICES))))
    counted = materialize(groups.groupBy("cls", "slice").agg(F.count("*").alias("n"), F.sum(F.col("bytes").cast("double")).alias("b")))
    sizes = counted.groupBy("cls").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).orderBy(F.desc("cls")).toPandas()
    dealt = longest_first((sizes["b"] / sizes["n"]).to_numpy(), sizes["n"].to_numpy(), n_shards)
    ends = dealt.cumsum(axis=1)
    plan = docs.sparkSession.createDataFrame(
        [(int(c), [int(x) for x in e]) for c, e in zip(sizes["cls"], ends)], "cls long, ends array<long>"
    )
    before = Window.partitionBy("cls").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("cls", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(F.broadcast(plan), "cls")
    inside = Window.partitionBy("cls", "slice").orderBy("group_key")
    ranked = groups.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["cls", "slice"])
    shard = F.size(F.filter("ends", lambda e: e <= F.col("base") + F.col("rank"))).cast("int")
    placed = materialize(ranked.select("group_key", "group_rows", shard.alias("shard")))

    where = materialize(
        rows.join(placed, "group_key").withColumn("slice", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(SLICES)))
    )
    filled = where.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("shard", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "slice").orderBy("doc_id", "group_key")
    slotted = where.withColumn("rank", F.row_number().over(own) - 1).join(F.broadcast(starts), ["shard", "slice"])
    return slotted.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), "group_key", "group_rows")
