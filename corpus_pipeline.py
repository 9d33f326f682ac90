"""Five stages from raw documents to token ids; each is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import bpe, decontam, lines, setjoin, toxicity
from labelweave.llm.common import table
from labelweave.session import materialize

# SQL cannot train the first stage's model or run the last one's merges.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the one with the smallest id; n_chars follows."""
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates stays, once.

    Rows without doc_id cannot be named in a group and stay.
    """
    classes = setjoin.jaccard_classes(docs)
    kept = classes.where("doc_id = class_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null")).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with the benchmark go.

    Rows without doc_id cannot be told apart: they all go if one of them shares a window.
    """
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_hit")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), their number, and the digest of their decoding."""
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("jaccard_join", keep_one_of_group),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; hand-over tables lie in the session's shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
