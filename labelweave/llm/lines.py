"""Line dedup: lines that many documents share stay only in the document with the smallest id."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm import common
from labelweave.session import materialize


HOT = 2000


def _key(line: bytes, min_points: int) -> bytes | None:
    """128-bit digest of a line without outer blanks and with A-Z lowered; None for a short line."""
    line = line.strip(common.BLANKS).lower()
    if len(line) < min_points or (len(line) < 4 * min_points and len(line.decode("utf-8", "replace")) < min_points):
        return None
    return hashlib.md5(line, usedforsecurity=False).digest()


def dedup_lines(docs: DataFrame, min_points: int = 10, max_docs: int = 1) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: its columns, with ``text`` reassembled, plus
    ``n_lines`` (before dropping) and ``n_dropped``.

    A text is cut at line feeds. A line's key is the line without outer ASCII blanks, A-Z lowered.
    Keys of at least ``min_points`` code points that more than ``max_docs`` documents hold lose all
    their lines except in the smallest doc_id holding them. The other lines stay in place.

    Keys are 16-byte digests, made once per document inside the scan. Counting documents needs only a
    partial aggregation (smallest and largest id, and the exact count where ``max_docs`` asks for
    it), so a line that a third of all documents share costs one row per task. The holders of a line
    with more than a 2,000th of all (document, line) rows find its keeper in a broadcast table, of at
    most 2,000 rows by that rule, where they are; only the other lines' holders are shuffled by line.
    Only digests of shared lines meet the texts again, grouped by document.

    Null and empty texts are one empty line and come back as the empty text. Rows that share a doc_id
    are one document and lose the same lines. A row without doc_id counts for nothing and is left as
    it is. Columns named like the added ones are replaced. An empty table gives an empty table.
    """

    def keys_of(batches):
        for batch in batches:
            ids, out_id, out_key = batch.column("doc_id").to_pylist(), [], []
            for doc, text in zip(ids, batch.column("text").to_pylist()):
                if text and doc is not None:
                    own = {_key(x, min_points) for x in text.split(b"\n")} - {None}
                    out_id += [doc] * len(own)
                    out_key += own
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_key, pa.binary())], ["doc_id", "key"])

    slim = docs.select(F.col("doc_id").cast("long"), common.as_bytes("text").alias("text"))
    held = materialize(slim.mapInArrow(keys_of, "doc_id long, key binary"))
    first = held.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other"), F.count("*").alias("holders")).where("keeper <> other")
    if max_docs > 1:
        many = held.join(first.select("key"), "key", "left_semi").distinct().groupBy("key").agg(F.count("*").alias("n"))
        first = first.join(many.where(F.col("n") > max_docs).select("key"), "key", "left_semi")
    first = materialize(first.select("key", "keeper", "holders"))
    frequent = F.col("holders") > held.count() / HOT
    hot = F.broadcast(first.where(frequent).select("key", "keeper"))  # fewer than HOT rows: each stands for more than a HOT-th of all
    rest = held.join(hot.select("key"), "key", "left_anti").join(first.where(~frequent).select("key", "keeper"), "key")
    shared = held.join(hot, "key").unionByName(rest).where("doc_id <> keeper")
    lost = materialize(shared.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("key").alias("_lost")))

    plain = docs.drop("n_lines", "n_dropped", "_doc", "_lost", "_cut")
    cut = "struct<text:string,n_lines:bigint,n_dropped:bigint>"
    schema = plain.select("*", F.expr(f"cast(null as {cut})").alias("_cut")).schema

    def reassemble(batches):
        for batch in batches:
            texts, counts, drops = [], [], []
            for text, gone in zip(batch.column("_raw").to_pylist(), batch.column("_lost").to_pylist()):
                lines = (text or b"").split(b"\n")
                gone = set(gone or ())
                stay = [x for x in lines if _key(x, min_points) not in gone] if gone else lines
                texts.append(b"\n".join(stay))
                counts.append(len(lines))
                drops.append(len(lines) - len(stay))
            made = pa.StructArray.from_arrays(
                [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(drops, pa.int64())],
                ["text", "n_lines", "n_dropped"],
            )
            keep = [n for n in batch.schema.names if n not in ("_raw", "_lost")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [made], [*keep, "_cut"])

    whole = plain.withColumn("_doc", F.col("doc_id").cast("long")).join(lost.hint("shuffle_hash"), "_doc", "left")
    carried = [c for c in plain.columns if c != "text"]
    ready = whole.select(*carried, F.lit(None).cast("string").alias("text"), common.as_bytes("text").alias("_raw"), "_lost")
    order = [*carried, "text", "_cut"]
    made = ready.mapInArrow(reassemble, schema.__class__([schema[c] for c in order]))
    return made.select(*[F.col("_cut.text").alias("text") if c == "text" else F.col(c) for c in plain.columns], "_cut.n_lines", "_cut.n_dropped")
