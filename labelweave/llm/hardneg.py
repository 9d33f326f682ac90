"""Hard negatives by a vertical scan: dimensions are read one after another while bounds rule candidates out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.session import materialize

STEP = 8


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, units array<double>)``: one row per vec_id, of rows whose label and components are all there.

    Components are floor(256 * x) in double precision, whole numbers. Of several rows under one vec_id
    the one with the smallest label, then vector, takes part.
    """
    values = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), values.alias("v"))
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", F.col("r.label").alias("label"), F.transform("r.v", lambda x: F.floor(x * 256).cast("double")).alias("units"))


PACKED = "side int, width int, block int, others int, ids binary, labels binary, units binary, targets binary, scores binary"
_NAMES = [c.split()[0] for c in PACKED.split(", ")]
_SCHEMA = pa.schema([(n, pa.int32() if i < 4 else pa.binary()) for i, n in enumerate(_NAMES)])


def pack(rows: DataFrame, side: int) -> DataFrame:
    """One row for every block of ``rows(vec_id, label, units, targets, scores, width, block, others)``.

    The block's dimensions follow one another, its vectors are sorted by label.
    """

    def one(key, table):
        table = table.sort_by([("label", "ascending"), ("vec_id", "ascending")])
        units = table.column("units").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        out = [side, *(k.as_py() for k in key)]
        out += [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label")] + [np.ascontiguousarray(units.T).tobytes()]
        out += [table.column(c).combine_chunks().flatten().to_numpy().astype("<i8").tobytes() for c in ("targets", "scores")]
        return pa.Table.from_pylist([dict(zip(_NAMES, out))], _SCHEMA)

    return rows.groupBy("width", "block", "others").applyInArrow(one, PACKED)


class Block:
    """A block of vectors by dimension, with the least and the most of every dimension."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.units = np.frombuffer(row["units"], "<f8").reshape(row["width"], len(self.ids))
        self.targets, self.scores = (np.frombuffer(row[c], "<i8").reshape(len(self.ids), -1) for c in ("targets", "scores"))
        self.least, self.most = self.units.min(1), self.units.max(1)

    def same(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def scan(anchor: np.ndarray, block: Block, alive: np.ndarray, low: float = -np.inf, high: float = np.inf, keep: int | None = None):
    """Rows of the candidate bitmap ``alive`` whose inner product with ``anchor`` may count, and that product.

    Dimensions are read by falling size of the anchor's component. After every ``STEP`` of them a row's
    product lies between its partial sum plus the least and the most that the unread dimensions can
    still add. Rows whose range misses [low, high] leave the bitmap, and with ``keep`` those whose most
    is below the keep-th best least. Components are whole; products that could pass 2**53 are summed
    as Python integers, so every sum is exact.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    weights, units, least, most = anchor[order], block.units, block.least[order], block.most[order]
    if np.abs(weights) @ np.maximum(np.abs(least), np.abs(most)) >= 2.0**53:
        weights, units, least, most = (np.vectorize(int, otypes=[object])(x) for x in (weights, units, least, most))
    ends = np.stack([weights * least, weights * most])
    rest_low, rest_high = (np.append(x[::-1].cumsum()[::-1], 0) for x in (ends.min(0), ends.max(0)))
    rows, sums = np.flatnonzero(alive), 0
    for start in range(0, len(order), STEP):
        if not len(rows):
            break
        dims = order[start : start + STEP]
        read = units[dims] if len(rows) == units.shape[1] else units[np.ix_(dims, rows)]
        sums = sums + weights[start : start + STEP] @ read
        end, floor = start + len(dims), low
        if keep is not None and len(rows) > keep:
            floor = max(floor, np.partition(sums, -keep)[-keep] + rest_low[end])
        stay = ((sums + rest_high[end] >= floor) & (sums + rest_low[end] <= high)).astype(bool)
        if not stay.all():
            rows, sums = rows[stay], sums[stay]
    return rows, sums if len(order) else np.zeros(len(rows))


def _first(ids: np.ndarray, sums: np.ndarray, many: int) -> np.ndarray:
    """Places of the ``many`` largest sums, ties by smaller id."""
    if len(sums) > many:
        near = np.flatnonzero(sums >= np.partition(sums, -many)[-many])
        return near[np.lexsort((ids[near], -sums[near]))[:many]]
    return np.lexsort((ids, -sums))


def _pair(table: pa.Table) -> tuple[Block, Block] | None:
    rows = {r["side"]: Block(r) for r in table.to_pylist()}
    return (rows[0], rows[1]) if len(rows) == 2 else None


def mine_hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), block_rows: int = 4096, anchor_rows: int = 1024
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``vectors(vec_id, embedding, label)``.

    A row's score is its inner product with the anchor over floor(256 * component). Anchors are the
    rows whose vec_id is divisible by ``every``; an anchor's positives are its first ``positives`` other
    rows of its label; negatives are the first ``negatives`` rows of other labels whose score is between
    ``share`` hundredths of the positive's. Order is by falling score, then vec_id.

    Vectors are packed into blocks by a hash of vec_id, each block stored dimension by dimension. Every
    anchor block meets every vector block in a group of its own (two packed rows, a few MiB), so no
    label, however frequent, is one task's work. In a group each anchor scans the block vertically
    (``scan``): first its own label for the positives, then, once those are merged, the other labels
    for all of its windows at once. Tasks return at most ``positives`` or ``positives * negatives`` rows
    for an anchor and block. Anchors are a fixed share of the rows, so the number of groups grows with
    the square of the input, with a factor of 1 / (every * block_rows * anchor_rows).

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Repeated
    rows count once; of different rows under one vec_id the one with the smallest label, then vector,
    counts. Vectors of other lengths than the anchor's are never compared; empty vectors score 0. A
    negative positive_score has no window. Scores beyond 64 bits raise. Extra columns are ignored; an
    empty table gives an empty table.
    """
    rows = materialize(usable(vectors).withColumn("width", F.size("units")))
    is_anchor = F.col("vec_id") % every == 0
    sizes = rows.groupBy("width").agg(
        F.ceil(F.count("*") / block_rows).cast("int").alias("row_blocks"), F.ceil(F.count_if(is_anchor) / anchor_rows).cast("int").alias("anchor_blocks")
    )
    placed = rows.join(sizes.where("anchor_blocks > 0"), "width")
    none = F.array().cast("array<long>")

    def block_of(count: str):
        return F.pmod(F.xxhash64("vec_id"), F.col(count)).cast("int").alias("block")

    def spread(packed: DataFrame, own: str, other: str) -> DataFrame:
        return packed.select("*", F.col("block").alias(own), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias(other)).select(*_NAMES, "i", "j")

    blocks = materialize(pack(placed.select("vec_id", "label", "units", none.alias("targets"), none.alias("scores"), "width", block_of("row_blocks"), F.col("anchor_blocks").alias("others")), 1))
    anchors = placed.where(is_anchor)

    def met(chosen: DataFrame, work, schema: str) -> DataFrame:
        packed = pack(chosen.select("vec_id", "label", "units", "targets", "scores", "width", block_of("anchor_blocks"), F.col("row_blocks").alias("others")), 0)
        return spread(packed, "j", "i").unionByName(spread(blocks, "i", "j")).groupBy("width", "i", "j").applyInArrow(work, schema)

    def nearest(table):
        pair, out = _pair(table), []
        for anchor in range(len(pair[0].ids) if pair else 0):
            own, block = pair
            alive = np.zeros(len(block.ids), bool)
            alive[block.same(own.labels[anchor])] = True
            alive &= block.ids != own.ids[anchor]
            found, sums = scan(own.units[:, anchor], block, alive, keep=positives)
            out += [(own.ids[anchor], block.ids[found[f]], int(sums[f])) for f in _first(block.ids[found], sums, positives)]
        return _long_table(out, ("anchor_id", "positive_id", "positive_score"))

    def inside(table):
        pair, out = _pair(table), []
        for anchor in range(len(pair[0].ids) if pair else 0):
            own, block = pair
            targets = [(t, s) for t, s in zip(own.targets[anchor].tolist(), own.scores[anchor].tolist()) if s >= 0]
            if not targets:
                continue
            alive = np.ones(len(block.ids), bool)
            alive[block.same(own.labels[anchor])] = False
            low, high = min(s for _, s in targets) * share[0] // 100, -(-max(s for _, s in targets) * share[1] // 100)
            found, sums = scan(own.units[:, anchor], block, alive, low, high)
            for target, score in targets:
                fit = np.flatnonzero(((sums * 100 >= share[0] * score) & (sums * 100 <= share[1] * score)).astype(bool)) if len(found) else []
                out += [(own.ids[anchor], target, score, block.ids[found[fit[f]]], int(sums[fit[f]])) for f in _first(block.ids[found[fit]], sums[fit], negatives)] if len(fit) else []
        return _long_table(out, ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))

    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = met(anchors.withColumn("targets", none).withColumn("scores", none), nearest, "anchor_id long, positive_id long, positive_score long")
    chosen = materialize(near.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives))
    lists = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))

    def filled(field: str):
        return F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(F.col("p"), i)[field], F.lit(-1).cast("long")))

    aimed = anchors.join(lists, "vec_id").select("*", filled("positive_id").alias("targets"), filled("positive_score").alias("scores"))
    hard = met(aimed, inside, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _long_table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({name: pa.array([int(r[i]) for r in rows], pa.int64()) for i, name in enumerate(names)})
