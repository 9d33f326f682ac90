"""Running sums along a total order that never hold a whole group in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.session import materialize, shuffle_width


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums of ``sums`` (whole numbers) within each ``by`` group along ``order``.

    Rows are range-partitioned and sorted on the full ``(by, order)`` key, so a group that holds most of
    the table spreads over many slices. The task that has a slice adds it up as its rows go by. What is
    left is one total per (group, slice), at most groups plus slices rows, which shift the sums of later
    slices: the rows themselves are shuffled once. The slices are materialized: both uses must see the
    same ones, also after an executor is lost.
    """
    by, names = list(by), list(sums)
    marked = df.withColumns({f"_{n}": F.coalesce(c.cast("bigint"), F.lit(0)) for n, c in sums.items()})
    marked = marked.withColumn("_group", F.xxhash64(*by) if by else F.lit(0).cast("bigint"))
    keys = [*[F.col(b).asc() for b in by], *order]
    ranged = marked.repartitionByRange(shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("_slice", F.spark_partition_id())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carried = None, np.zeros(len(names), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column("_group").to_numpy()
            starts = np.flatnonzero(np.r_[groups[0] != group, np.diff(groups) != 0])
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i, n in enumerate(names):
                values = columns[f"_{n}"].to_numpy()
                upto = np.cumsum(values)
                lead = starts[0] if len(starts) else len(values)
                upto[lead:] -= np.repeat(upto[starts] - values[starts], np.diff(np.r_[starts, len(values)]))
                upto[:lead] += carried[i]
                carried[i] = upto[-1]
                columns[n] = pa.array(upto)
            group = groups[-1]
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    shape = ranged.select(*[c for c in ranged.columns if c not in names], *[F.lit(0).cast("bigint").alias(n) for n in names])
    summed = materialize(ranged.drop(*names).mapInArrow(add, shape.schema))
    totals = summed.groupBy(*by, "_slice").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names])
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*by, "_slice", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names])
    out = summed.drop(*[f"_{n}" for n in names], "_group").join(shifts, [*by, "_slice"])
    return out.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in names}).drop("_slice", *[f"_before_{n}" for n in names])
