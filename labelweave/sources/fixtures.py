"""Binding of the generic test tables to protein-style inputs. Views only; nothing is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Label numbering over the document columns.
LANGUAGES = ["de", "en", "es", "fr"]
N_SOURCES = 20
N_LABELS = len(LANGUAGES) + N_SOURCES + 2
N_CLASSES = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_proteins(docs: DataFrame) -> DataFrame:
    digits = F.col("doc_id").cast("string")
    padded = F.lpad(digits, F.greatest(F.lit(7), F.length(digits)), F.lit("0"))
    return docs.select(
        F.col("doc_id").alias("row_idx"), F.concat(F.lit("P"), padded).alias("protein_id"), F.col("text").alias("sequence")
    )


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_idx, protein_id, sequence)`` from whole documents."""
    return _as_proteins(_table(spark, sf_dir, "documents"))


def train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents in two tables: the later half's French ones are the unlabeled test table."""
    docs = _table(spark, sf_dir, "documents")
    half = docs.agg(F.max("doc_id") / 2).scalar()
    is_test = (F.col("lang") == "fr") & (F.col("doc_id") >= half)
    return _as_proteins(docs.where(~is_test)), _as_proteins(docs.where(is_test))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ``(row_idx, ord, label, y)``: language and source one-hots, quality, toxic."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    marks = _table(spark, sf_dir, "labels")
    flags = [F.col("lang") == lang for lang in LANGUAGES]
    flags += [F.col("source") == f"src{i}" for i in range(N_SOURCES)]
    flags += [F.coalesce(F.col(c), F.lit(0)) == 1 for c in ("quality", "toxic")]
    cells = F.posexplode(F.array(*[f.cast("int") for f in flags])).alias("ord", "y")
    return docs.join(marks, "doc_id", "left").select(F.col("doc_id").alias("row_idx"), cells).select(
        "row_idx", "ord", F.concat(F.lit("label_"), F.col("ord")).alias("label"), "y"
    )


def _pseudo(model: int):
    """A deterministic score that leans towards the truth; six decimals, exact in any engine."""
    mixed = F.col("row_idx") * 7919 + F.col("ord").cast("bigint") * 104729 + model * 1299709
    return F.round((mixed % 1009) / F.lit(1009.0) * F.lit(0.7) + F.lit(0.3) * F.col("y"), 6)


def scores(spark: SparkSession, sf_dir: str, model: int) -> DataFrame:
    """Score table ``(row_idx, ord, label, prob, y)`` of one stand-in model over every document."""
    return truth(spark, sf_dir).withColumn("prob", _pseudo(model))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_idx")


def embedding_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense class one-hots of the embedding table."""
    classes = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(N_CLASSES - 1)), lambda c: (c == F.col("label")).cast("int")))
    return embeddings(spark, sf_dir).select("row_idx", classes.alias("ord", "y")).select(
        "row_idx", "ord", F.concat(F.lit("label_"), F.col("ord")).alias("label"), "y"
    )


def embedding_scores(spark: SparkSession, sf_dir: str, model: int) -> DataFrame:
    return embedding_truth(spark, sf_dir).withColumn("prob", _pseudo(model))


def embedding_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fit, eval) embeddings: the last fifth of the ids is held out."""
    table = embeddings(spark, sf_dir)
    held_out = F.col("row_idx") >= table.agg(F.count(F.lit(1)) * 0.8).scalar()
    return table.where(~held_out), table.where(held_out)


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq_id, pos, vector, attended)``: embeddings read as token states of 8-token sequences."""
    return _table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("seq_id"),
        (F.col("vec_id") - F.floor(F.col("vec_id") / 8) * 8).alias("pos"),
        F.col("embedding").alias("vector"),
    ).withColumn("attended", F.col("pos") <= F.floor(F.col("seq_id") / 7) - F.floor(F.floor(F.col("seq_id") / 7) / 8) * 8)
