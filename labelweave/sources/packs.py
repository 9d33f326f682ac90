"""Tables that stages hand to each other, and the final wide export."""

from __future__ import annotations

import csv
import dataclasses
import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from labelweave.functions.sequences import sequence_text
from labelweave.operators.ordered import running_totals

_LABEL = re.compile("label_([0-9]+)")


def label_columns(df: DataFrame) -> list[str]:
    """Columns named ``label_<digits>``, by number (then name); other names are not labels."""
    numbered = [(int(m[1]), m[0]) for m in map(_LABEL.fullmatch, df.columns) if m]
    return [name for _, name in sorted(numbered)]


_BROKEN = "_malformed"


def csv_schema(spark: SparkSession, path: str) -> StructType:
    """Types by column name, from the header line alone: ``label_<digits>`` are numbers, all else is text."""
    header = spark.read.text(path).first()
    names = next(csv.reader([header["value"]])) if header else []
    return StructType([StructField(n, IntegerType() if _LABEL.fullmatch(n) else StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A table with a header row, read once: nothing is inferred from its rows.

    A row that does not fit (too many or too few fields, a label that is no number) keeps what could be
    read and its line in ``_malformed``; see ``well_formed`` and ``malformed``, to be asked of a stored copy.
    """
    wanted = StructType([*(schema or csv_schema(spark, path)), StructField(_BROKEN, StringType())])
    return spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).schema(wanted).csv(path)


def well_formed(table: DataFrame) -> DataFrame:
    return table.where(F.col(_BROKEN).isNull()).drop(_BROKEN)


def malformed(table: DataFrame) -> DataFrame:
    """``(line)`` of every row that did not fit."""
    return table.where(F.col(_BROKEN).isNotNull()).select(F.col(_BROKEN).alias("line"))


def with_row_idx(df: DataFrame) -> DataFrame:
    """Number rows from 0 in ``protein_id`` (then sequence) order: files have no stable position."""
    order = [F.col("protein_id").asc(), F.col("sequence").asc()]
    ordered = running_totals(df, order, {"_n": F.lit(1).cast("bigint")})
    return ordered.withColumn("row_idx", F.col("_n") - 1).drop("_n")


def long_truth(train: DataFrame) -> DataFrame:
    """``(row_idx, label, y)`` from the wide label columns."""
    labels = label_columns(train)
    ints = train.select("row_idx", *[F.col(c).cast("tinyint").alias(c) for c in labels])
    return ints.unpivot("row_idx", labels, "label", "y")


def first_labels(labels: Sequence[str], count: int | None) -> list[str]:
    """The first ``count`` labels in their order, all without a count: a smoke-run option."""
    return list(labels)[:count]


def wide(predictions: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per test row: ``protein_id`` and one 0/1 column per label in the given order.

    Rows are told apart by ``row_idx``, so two test rows with one id stay two rows.
    """
    return predictions.groupBy("row_idx", "protein_id").pivot("label", list(labels)).agg(F.max("pred").cast("tinyint")).drop("row_idx")


def write_submission(predictions: DataFrame, labels: Sequence[str], path: str) -> None:
    """Wide CSV parts with a header, ordered by id."""
    wide(predictions, labels).orderBy("protein_id").write.mode("overwrite").option("header", True).csv(path)


def write_scores(scores: DataFrame, path: str, model: str) -> None:
    """Add or replace one model in a score table partitioned by model."""
    out = scores.select("row_idx", "label", F.col("prob").cast("float").alias("prob"), F.col("y").cast("tinyint").alias("y"))
    out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/model={model}")


def read_scores(spark: SparkSession, path: str, model: str) -> DataFrame:
    """One model's scores; only its folder is listed and read."""
    return spark.read.parquet(path).where(F.col("model") == model).drop("model")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Summary rows as JSON documents."""
    df.write.mode("overwrite").json(path)


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as handle:
        return json.load(handle)


def cache_key(proteins: DataFrame, cfg, mode: str) -> DataFrame:
    """Twelve hex digits that change with the configuration, the mode or any row of the data.

    Both halves of every row's digest are summed as decimals, so neither part is dropped and no row count overflows.
    """
    settings = json.dumps({"config": dataclasses.asdict(cfg), "mode": mode}, sort_keys=True)
    row = F.md5(F.concat_ws("|", F.col("row_idx").cast("string"), sequence_text(F.col("sequence"))))
    halves = [F.sum(F.conv(F.substring(row, at, 16), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 17)]
    tail = F.concat_ws("|", F.lit(settings), F.count(F.lit(1)).cast("string"), *halves)
    return proteins.agg(F.substring(F.sha2(tail, 256), 1, 12).alias("cache_key"))
