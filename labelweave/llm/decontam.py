"""Benchmark decontamination by winnowed fingerprints, extended to exact shared word windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm import common
from labelweave.session import materialize

def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions of the minimum of every ``span`` consecutive hashes, the rightmost one in a tie."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    low = view[:, ::-1].argmin(axis=1)
    return np.unique(np.arange(len(view)) + span - 1 - low)


def _window_digests(tokens: list[bytes], starts: np.ndarray, length: int) -> list[bytes]:
    return [hashlib.md5(b" ".join(tokens[s : s + length]), usedforsecurity=False).digest() for s in starts]


def bench_windows(bench: DataFrame, window: int, k: int) -> DataFrame:
    """``(item_id, len, win, fps)``: an item's windows with the fingerprints found inside each.

    A text of fewer than ``window`` words is one window of its own length whose fingerprint is the
    hash of all its words.
    """

    def cut(batches):
        memo = common.WordHash()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = common.words(text)
                if not tokens:
                    continue
                length = min(window, len(tokens))
                values = memo.of(tokens)
                if length < window:
                    rows.append((item, length, _window_digests(tokens, [0], length)[0], common.gram_hashes(values, length).tolist()))
                    continue
                grams = common.gram_hashes(values, k)
                marks = winnow(grams, window - k + 1)
                starts = np.arange(len(tokens) - window + 1)
                low, high = np.searchsorted(marks, starts), np.searchsorted(marks, starts + window - k, "right")
                for s, digest in enumerate(_window_digests(tokens, starts, window)):
                    rows.append((item, length, digest, grams[marks[low[s] : high[s]]].tolist()))
            cols = list(zip(*rows)) if rows else [[]] * 4
            fps = pa.array([np.array(f, np.uint64).view(np.int64).tolist() for f in cols[3]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), fps], ["item_id", "len", "win", "fps"]
            )

    slim = bench.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string"), common.as_bytes("text").alias("text"))
    return slim.mapInArrow(cut, "item_id string, len int, win binary, fps array<long>")


def _scan(docs: DataFrame, bits: common.Bits, short: list[int], window: int, k: int) -> DataFrame:
    """Every row of docs with its word count and the windows around fingerprints the bit map knows."""
    cand = pa.list_(pa.struct([("len", pa.int32()), ("win", pa.binary()), ("fp", pa.int64()), ("starts", pa.list_(pa.int32()))]))

    def near(tokens, values):
        found = []
        if len(values) >= window:
            grams = common.gram_hashes(values, k)
            marks = np.flatnonzero(bits.has(grams))
            if len(marks):
                marks = np.intersect1d(marks, winnow(grams, window - k + 1))
            for fp in np.unique(grams[marks]) if len(marks) else ():
                at = marks[grams[marks] == fp]
                starts = np.unique((at[:, None] - np.arange(window - k + 1)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(values) - window)]
                found.append((fp, window, starts))
        for n in short:
            grams = common.gram_hashes(values, n)
            at = np.flatnonzero(bits.has(grams)) if len(grams) else grams
            for fp in np.unique(grams[at]) if len(at) else ():
                found.append((fp, n, at[grams[at] == fp]))
        for fp, n, starts in found:
            by = {}
            for s, digest in zip(starts.tolist(), _window_digests(tokens, starts, n)):
                by.setdefault(digest, []).append(s)
            for digest, places in by.items():
                yield {"len": n, "win": digest, "fp": int(np.uint64(fp).astype(np.int64)), "starts": places}

    def scan(batches):
        memo = common.WordHash()
        for batch in batches:
            sizes, cands = [], []
            for text in batch.column("_raw").to_pylist():
                tokens = common.words(text)
                values = memo.of(tokens)
                sizes.append(len(tokens))
                cands.append(list(near(tokens, values)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(cands, cand)], ["row", "doc_id", "n_words", "cands"]
            )

    slim = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", common.as_bytes("text").alias("_raw"))
    kind = dict(docs.dtypes)["doc_id"]
    return slim.mapInArrow(scan, f"row long, doc_id {kind}, n_words long, cands array<struct<len:int,win:binary,fp:long,starts:array<int>>>")


def _covered(spans: Column) -> Column:
    """Number of positions inside at least one of ``array<struct<start, end>>`` (end exclusive)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["upto"]), F.lit(0))).alias("n"),
        F.greatest(acc["upto"], x["end"]).alias("upto"),
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"].cast("long"))


def contamination(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, contaminated)`` for every row of ``docs(doc_id, text, ...)``.

    ``n_hit`` counts the document's words inside any occurrence of a window of ``bench(item_id,
    text)``: ``window`` consecutive words of an item, or all words of a shorter item. ``items`` are
    the ids (as sorted strings) of the items with an occurring window. Words: ``common.words``.

    Winnowing keeps the smallest of every ``window - k + 1`` consecutive k-gram hashes, so equal
    windows on the two sides always share a kept one. A document's kept hashes are tried against a
    bit map of fixed size, those left are joined with the benchmark's, and each hit is extended: the
    windows around it are compared by 128-bit digests with the item's windows around the same
    fingerprint. Joining distinct windows first, and items afterwards once per document and window,
    keeps repeated passages on either side from multiplying.

    Null and empty texts have no words; items without words or id have no window. Repeated rows are
    scored each; repeated item ids act as one item. Empty tables give no hits, or no rows. Extra
    columns are ignored.
    """
    spark = docs.sparkSession
    windows = materialize(bench_windows(bench, window, k))
    marks = materialize(windows.select("len", "win", F.explode("fps").alias("fp")).distinct())
    short = sorted(r["len"] for r in marks.where(F.col("len") < window).select("len").distinct().collect())
    bits = common.Bits.of(marks.select("fp"), "fp")
    scanned = materialize(_scan(docs, bits, short, window, k))
    around = scanned.select("row", F.explode("cands").alias("c")).select("row", "c.len", "c.win", "c.fp", "c.starts")
    hits = materialize(around.join(marks, ["fp", "len", "win"]).select("row", "len", "win", "starts"))
    spans = F.transform("starts", lambda s: F.struct(s.alias("start"), (s + F.col("len")).alias("end")))
    per_row = hits.groupBy("row").agg(F.flatten(F.collect_list(spans)).alias("spans")).select("row", _covered(F.col("spans")).alias("n_hit"))
    pairs = hits.select("row", "len", "win").distinct().join(windows.select("item_id", "len", "win").distinct(), ["len", "win"])
    items = pairs.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = per_row.join(items, "row")
    out = scanned.select("row", "doc_id", "n_words").join(found, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
