"""Helpers that several training-data operators share."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.session import materialize

# White space that ends words and lines, and the ASCII bytes that belong to a word.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
ROOT = np.uint64(0x9E3779B97F4A7C15)
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: str):
    """A text column as its UTF-8 bytes; null stays null."""
    return F.col(column).cast("string").cast("binary")


def _fold_table() -> bytes:
    """Translation of every byte: A-Z to a-z, other ASCII outside words to a blank, the rest as it is."""
    out = bytearray(range(256))
    for b in range(128):
        low = b + 32 if 65 <= b <= 90 else b
        out[b] = low if low in WORD_BYTES else 32
    return bytes(out)


FOLD = _fold_table()


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters; none for null."""
    return text.translate(FOLD).split() if text else []


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The same rows in a session of their own, whose Arrow batches hold at most ``rows`` rows.

    Rows of long texts go between Spark and Python in batches of 10,000 otherwise, several copies of
    which are in memory at a time. The batch size is a session's setting: the caller's stays as it is,
    and the new session takes over all other settings.
    """
    spark = df.sparkSession
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    name = f"labelweave_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        return own.table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


class WordHash(dict):
    """Word to 64-bit hash, remembered; emptied when it holds a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


SPAN_BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: a polynomial of a random number for each byte, from prefix sums over all of ``data``."""
    with np.errstate(over="ignore"):
        falling = np.full(len(data), pow(SPAN_BASE, -1, 1 << 64), np.uint64)
        falling[:1] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[data] * np.cumprod(falling))])
        rising = np.full(len(data) + 1, SPAN_BASE, np.uint64)
        rising[0] = 1
        return mix((sums[ends] - sums[starts]) * np.cumprod(rising)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k word hashes."""
    n = len(values) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * ROOT + values[i : i + n]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def most_frequent(counted: DataFrame, limit: int) -> tuple[list, np.ndarray]:
    """The words of ``frequent_rows`` as a list, and their n."""
    rows = frequent_rows(counted, limit)
    return rows.column("word").to_pylist(), rows.column("n").to_numpy()


def frequent_rows(counted: DataFrame, limit: int) -> pa.Table:
    """The rows of ``frequent``, by falling n, then word."""
    return frequent(counted, limit).toArrow().sort_by([("n", "descending"), ("word", "ascending")])


def frequent(counted: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` words of ``counted(word, n)`` with the largest n.

    Counts are cut where a histogram of their logarithm (at most 505 bins) says so, so that no more
    rows than asked for are on the way to the driver; words of one bin come all or not at all.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    bins = sorted(((r["level"], r["count"]) for r in counted.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, lowest = 0, None
    for b, many in bins:
        total += many
        if total > limit:
            break
        lowest = b
    return counted.where(level >= lowest if lowest is not None else F.lit(False)).select("word", "n")


class Bits:
    """A bit map of fixed size over 64-bit keys: tells which keys are certainly absent.

    It is built by an aggregation and never grows with the data, so it may go with every task; a
    full map only lets more rows through to the join that decides.
    """

    def __init__(self, log2_bits: int, filled: np.ndarray):
        self.shift = np.uint64(64 - log2_bits)
        self.bits = filled

    @staticmethod
    def of(keys: DataFrame, column: str, log2_bits: int = 23) -> Bits:
        """From a table of signed 64-bit keys; at most 2**log2_bits / 64 rows reach the driver."""
        slots = keys.select(F.shiftrightunsigned(F.col(column), 64 - log2_bits).alias("slot"))
        rows = slots.selectExpr("shiftright(slot, 6) AS cell", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bit")
        cells = rows.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
        filled = np.zeros(1 << (log2_bits - 6), np.int64)
        filled[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64)
        return Bits(log2_bits, filled.view(np.uint64))

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.astype(np.uint64, copy=False) >> self.shift
        return (self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node reachable.

    Rounds of contraction: every node points to its smallest neighbour if that is smaller, pointers
    are doubled once, edges are rewritten to the pointed-to nodes. Edges and nodes stay tables; only
    whether edges remain comes to the driver. Loops and repeated edges are ignored; an edge with a
    null end is dropped.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    left = materialize(edges.where("a <> b").select(low.alias("a"), high.alias("b")).distinct())
    ends = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node")))
    labels = ends.distinct().withColumn("root", F.col("node"))
    while not left.isEmpty():
        both = left.select(F.col("a").alias("v"), F.col("b").alias("u")).union(left.select(F.col("b").alias("v"), F.col("a").alias("u")))
        near = both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("p"))
        near = materialize(near)
        jump = near.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        near = materialize(near.join(jump, "p").select("v", F.col("pp").alias("p")))
        moved = near.select(F.col("v").alias("root"), F.col("p").alias("to"))
        labels = materialize(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        pa, pb = near.select(F.col("v").alias("a"), F.col("p").alias("pa")), near.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        kept = left.join(pa, "a").join(pb, "b").where("pa <> pb")
        left = materialize(kept.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return labels
