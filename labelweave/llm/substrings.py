"""Substring dedup: a count-min sketch lets only windows that may repeat reach the exact grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm import common
from labelweave.session import materialize

#: Odd multipliers of the rolling hashes, and one seed per row of the sketch.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
BLOCK = 1 << 16
HELD = 1 << 20
PIECE_BYTES = 1 << 20


def rolling(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of every run of k values: the difference of two prefix sums, so its cost does not depend on k."""
    n = len(values) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        falling = np.full(len(values), pow(base, -1, 1 << 64), np.uint64)
        falling[0] = 1
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * np.cumprod(falling), out=sums[1:])
        rising = np.full(n, base, np.uint64)
        rising[0] = 1
        return (sums[k:] - sums[:n]) * np.cumprod(rising)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


BLANK = np.isin(np.arange(256), np.frombuffer(common.BLANKS, np.uint8))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of some texts, one after another, and how many each text has.

    No word becomes an object.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = ~BLANK[data]
    edge = np.diff(np.r_[False, inside].view(np.int8), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return common.span_hashes(data, starts, ends), np.diff(np.searchsorted(starts, bounds), prepend=0)


class Windows:
    """The windows of some texts, all in flat arrays: where they start, whose they are, their hashes."""

    def __init__(self, texts: list[bytes], k: int):
        self.values, self.counts = word_hashes(texts)
        left = np.repeat(np.cumsum(self.counts), self.counts) - np.arange(len(self.values))
        self.k, self.at = k, np.flatnonzero(left >= k)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)[self.at]

    def first(self) -> np.ndarray:
        """64 bits of every window's hash."""
        return common.mix(rolling(self.values, self.k, BASES[0])[self.at])

    def second(self) -> np.ndarray:
        """32 more bits, by another multiplier over other word hashes."""
        return (common.mix(rolling(common.mix(self.values), self.k, BASES[1])[self.at]) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def marks(self) -> np.ndarray:
        """Smallest hash of the half-length runs inside each window: equal for equal windows, and shared by neighbours."""
        half = max(1, self.k // 2)
        runs = common.mix(rolling(self.values, half, BASES[2]))
        return sliding_min(runs, self.k - half + 1)[self.at] if len(self.at) else np.zeros(0, np.uint64)


def pieces(batches):
    """``(batch, texts)`` for pieces of about a MiB, or of one text, so that arrays over all bytes stay small."""
    for batch in batches:
        sizes = np.cumsum([len(t or b"") for t in batch.column("_raw").to_pylist()]) // PIECE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            part = batch.slice(start, end - start)
            yield part, [t or b"" for t in part.column("_raw").to_pylist()]


def distinct(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Index of one row for every different (doc, keys)."""
    order = np.lexsort((*keys[::-1], doc))
    same = np.ones(max(len(order) - 1, 0), bool)
    for column in (doc, *keys):
        same &= np.diff(column[order].view(np.int64) if column.dtype.itemsize == 8 else column[order]) == 0
    return order[np.r_[True, ~same]] if len(order) else order


def cells(marks: np.ndarray, row: int, log2_cells: int) -> np.ndarray:
    return common.mix(marks ^ np.uint64(SEEDS[row])) >> np.uint64(64 - log2_cells)


def _sketch_rows(marks: np.ndarray, log2_cells: int) -> pa.RecordBatch:
    """One partition's counts: per block of cells, those met once and those met more often."""
    blocks, once, more = [], [], []
    for row in range(len(SEEDS)):
        cell, count = np.unique(cells(marks, row, log2_cells), return_counts=True)
        block, starts = np.unique(cell >> np.uint64(16), return_index=True)
        low = (cell & np.uint64(BLOCK - 1)).astype("<u2")
        for b, start, end in zip(block.tolist(), starts, [*starts[1:], len(cell)]):
            few = count[start:end] == 1
            blocks.append((row << (log2_cells - 16)) + b)
            once.append(low[start:end][few].tobytes())
            more.append(low[start:end][~few].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["block", "once", "more"])


def merge_sketches(parts: DataFrame) -> DataFrame:
    """``(block, bits)``: the partition sketches added up, one bit per cell that was met at least twice.

    Rows meet by block and are added one after another, so a task holds one block however many
    partitions there are.
    """

    def merge(batches):
        now, seen = None, np.zeros(BLOCK, np.uint8)
        for batch in batches:
            done = []
            for block, once, more in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "more"))):
                if block != now:
                    if now is not None:
                        done.append((now, np.packbits(seen >= 2).tobytes()))
                    now, seen = block, np.zeros(BLOCK, np.uint8)
                cell = np.frombuffer(once, "<u2")
                seen[cell] = np.minimum(seen[cell] + 1, 2)
                seen[np.frombuffer(more, "<u2")] = 2
            yield _bits_batch(done)
        if now is not None:
            yield _bits_batch([(now, np.packbits(seen >= 2).tobytes())])

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary")


def _bits_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["block", "bits"])


class Sketch:
    """The merged count-min sketch, down to what is asked of it: whether a count may be two or more."""

    def __init__(self, log2_cells: int, merged: DataFrame):
        self.log2_cells = log2_cells
        self.bits = np.zeros((len(SEEDS) << (log2_cells - 16), BLOCK // 8), np.uint8)
        rows = merged.toArrow()
        for block, bits in zip(rows.column("block").to_pylist(), rows.column("bits").to_pylist()):
            self.bits[block] = np.frombuffer(bits, np.uint8)

    def repeated(self, marks: np.ndarray) -> np.ndarray:
        """Whether each mark is estimated to be met at least twice; never false for one that is."""
        out, flat = np.ones(len(marks), bool), self.bits.reshape(len(SEEDS), -1)
        for row in range(len(SEEDS)):
            cell = cells(marks, row, self.log2_cells)
            out &= flat[row][cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def build_sketch(slim: DataFrame, k: int, log2_cells: int) -> Sketch:
    def count(batches):
        held, size = [], 0
        for _, texts in pieces(batches):
            windows = Windows(texts, k)
            marks = windows.marks()
            held.append(marks[distinct(windows.doc, marks)])
            size += len(held[-1])
            if size >= HELD:
                yield _sketch_rows(np.concatenate(held), log2_cells)
                held, size = [], 0
        if size:
            yield _sketch_rows(np.concatenate(held), log2_cells)

    return Sketch(log2_cells, merge_sketches(slim.select("_raw").mapInArrow(count, "block long, once binary, more binary")))


def sketch_size(docs: DataFrame, largest: int) -> int:
    """log2 of the cells per row of the sketch: four cells for every mark to be expected, within 2**16 to 2**largest."""
    size = docs.agg(F.sum(F.octet_length("_raw"))).head()[0] or 0
    return int(min(max(np.ceil(np.log2(max(size / 80 * 4, 1))), 16), largest))


def later_holders(rows: DataFrame) -> DataFrame:
    """``(doc, h1)`` of every row of ``rows(h1, h2, doc)`` whose window a smaller doc holds too.

    Rows are range-partitioned by window and document and sorted, so the first row of a window names
    its keeper, and a window that a third of all documents hold spreads over many tasks. What a task
    cannot know is the keeper of a window that began in an earlier task: every task reports the first
    document of its first and of its last window, and those few rows are compared once more.
    """

    def scan(batches):
        key, keeper, head = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc"))
            new = np.r_[key != (h1[0], h2[0]), (np.diff(h1) != 0) | (np.diff(h2) != 0)]
            starts = np.flatnonzero(new)
            first = np.empty(len(doc), np.int64)
            lead = starts[0] if len(starts) else len(doc)
            first[:lead] = keeper if keeper is not None else 0
            first[lead:] = np.repeat(doc[starts], np.diff(np.r_[starts, len(doc)]))
            lost = doc > first
            edge = [] if head is not None else [(h1[0], h2[0], doc[0])]
            head = head or edge[0][:2]
            key, keeper = (h1[-1], h2[-1]), int(first[-1])
            yield _holders(h1[lost], h2[lost], doc[lost], edge)
        if key is not None and key != head:
            none = np.zeros(0, np.int64)
            yield _holders(none, none.astype(np.int32), none, [(*key, keeper)])

    order = ["h1", "h2", "doc"]
    found = materialize(rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, "doc long, h1 long, h2 int"))
    edges = found.where("h2 is not null")
    keepers = edges.groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.min("doc").alias("keeper"))
    late = edges.join(keepers, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("doc") > F.col("keeper")))
    return found.where("h2 is null").select("doc", "h1").union(late.select("doc", "h1"))


def _holders(h1, h2, doc, edge) -> pa.RecordBatch:
    """Rows whose window is known to be held before, without h2; then the rows at a task's edges, with it."""
    return pa.RecordBatch.from_arrays([
        pa.array(np.r_[doc, np.array([e[2] for e in edge], np.int64)], pa.int64()), pa.array(np.r_[h1, np.array([e[0] for e in edge], np.int64)], pa.int64()),
        pa.array([None] * len(doc) + [int(e[1]) for e in edge], pa.int32()),
    ], ["doc", "h1", "h2"])


def dedup_substrings(docs: DataFrame, window: int = 50, largest: int = 28) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: its columns, with ``text`` the kept words joined
    by single spaces, plus ``n_words`` and ``n_removed``.

    Words are runs without ASCII blanks. A word goes if a window of ``window`` consecutive words that
    covers it also starts in a document with a smaller doc_id. Windows are judged on the input.

    1. Every partition counts its windows in a count-min sketch, once per document. All windows that
       hold the same smallest half-length run are counted in that run's cells, so a cell's count is
       at least the number of documents of each of them, at about one entry for thirteen words.
       Partition sketches travel as lists of their cells and are added block by block.
    2. A second pass sends only windows whose estimate is two or more to the exact grouping, under
       96-bit hashes; a window that does repeat always goes.
    3. Sorted windows name their keeper; documents get back the hashes of the windows they lose.

    The sketch has two rows of four cells per expected entry, at most 2**``largest`` (two bit maps of
    32 MiB for 28, full at about 20 GB of text); beyond that more windows pass, and only time is lost.
    Tasks work on about a MiB of text at a time, one text at least.

    Null and empty texts have no words and give the empty text. Texts shorter than a window keep all
    words. Rows that share a doc_id are one document: they do not lose windows to each other. A row
    without doc_id neither loses nor removes anything. doc_id has to be an integer. Columns named like
    the added ones are replaced. An empty table gives an empty table.
    """
    docs = common.small_batches(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc"), common.as_bytes("text").alias("_raw")).where("doc is not null")
    sketch = build_sketch(slim, window, sketch_size(slim, largest))

    def candidates(batches):
        for part, texts in pieces(batches):
            windows = Windows(texts, window)
            open_ = np.flatnonzero(sketch.repeated(windows.marks()))
            h1, h2 = windows.first()[open_].view(np.int64), windows.second()[open_]
            one = distinct(windows.doc[open_], h1, h2)
            doc = part.column("doc").to_numpy()[windows.doc[open_][one]]
            yield pa.RecordBatch.from_arrays([pa.array(h1[one], pa.int64()), pa.array(h2[one], pa.int32()), pa.array(doc, pa.int64())], ["h1", "h2", "doc"])

    lost = later_holders(slim.mapInArrow(candidates, "h1 long, h2 int, doc long"))
    gone = lost.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("h1").alias("_gone"))

    plain = docs.drop("n_words", "n_removed", "_doc", "_gone", "_cut", "_raw")
    cut = "struct<text:string,n_words:bigint,n_removed:bigint>"
    schema = plain.select(*[c for c in plain.columns if c != "text"], F.expr(f"cast(null as {cut})").alias("_cut")).schema

    def reassemble(batches):
        for part, texts in pieces(batches):
            kept, counts, removed = [], [], []
            for text, drop in zip(texts, part.column("_gone")):
                words = text.split()
                counts.append(len(words))
                if drop.is_valid:
                    windows = Windows([text], window)
                    hit = windows.at[np.isin(windows.first().view(np.int64), drop.values.to_numpy())]
                    edge = np.bincount(hit, minlength=len(words) + 1) - np.bincount(hit + window, minlength=len(words) + 1)
                    words = [w for w, covered in zip(words, np.cumsum(edge).tolist()) if not covered]
                kept.append(b" ".join(words))
                removed.append(counts[-1] - len(words))
            made = pa.StructArray.from_arrays(
                [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                ["text", "n_words", "n_removed"],
            )
            keep = [n for n in part.schema.names if n not in ("_raw", "_gone")]
            yield pa.RecordBatch.from_arrays([part.column(n) for n in keep] + [made], [*keep, "_cut"])

    carried = [c for c in plain.columns if c != "text"]
    keyed = plain.select(*carried, common.as_bytes("text").alias("_raw"), F.col("doc_id").cast("long").alias("_doc"))
    ready = keyed.join(gone.hint("shuffle_hash"), "_doc", "left").select(*carried, "_raw", "_gone")
    made = ready.mapInArrow(reassemble, schema)
    return made.select(*[F.col("_cut.text").alias("text") if c == "text" else F.col(c) for c in plain.columns], "_cut.n_words", "_cut.n_removed")
