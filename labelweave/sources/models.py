"""A store of fitted models: coefficients and weights as tables, under a key of data, settings and kind."""

from __future__ import annotations

import dataclasses
import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.operators import joint, mlp

#: Raised when the layout of a stored model changes, so that no stage reads an older one.
VERSION = 1
ROWS = 1024


def model_key(kind: str, data_key: str, settings, labels: list[str]) -> str:
    """Sixteen hex digits that change with the kind of model, its data, any setting or label, and the store's version."""
    said = json.dumps([VERSION, kind, data_key, dataclasses.asdict(settings), labels], sort_keys=True)
    return f"{kind}_{hashlib.sha256(said.encode()).hexdigest()[:16]}"


def _write_matrix(spark: SparkSession, matrix: np.ndarray, path: str) -> None:
    """Rows of a matrix, ``ROWS`` to a table row: ``(at, width, cells)``."""
    cuts = range(0, len(matrix), ROWS)
    rows = [(i, matrix.shape[1], bytearray(np.ascontiguousarray(matrix[i : i + ROWS], "<f8").tobytes())) for i in cuts]
    spark.createDataFrame(rows, "at long, width int, cells binary").write.mode("overwrite").parquet(path)


def _read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(path).orderBy("at").collect()
    return np.concatenate([np.frombuffer(r["cells"], "<f8").reshape(-1, r["width"]) for r in rows])


class ModelStore:
    """Models under ``root/<key>``. The description is written last: a key without it holds no model."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _described(self, key: str) -> dict | None:
        try:
            return json.loads(self.spark.read.text(f"{self.root}/{key}/about").first()["value"])
        except Exception as missing:  # nothing stored under this key yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def _describe(self, key: str, about: dict) -> None:
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{key}/about")

    def keys(self) -> DataFrame:
        """``(key, kind)`` of every stored model."""
        about = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(self.root)
        where = about.select(F.input_file_name().alias("file"), F.get_json_object("value", "$.kind").alias("kind"))
        return where.select(F.regexp_extract("file", "/([^/]+)/about/[^/]*$", 1).alias("key"), "kind")

    def save_linear(self, key: str, model: joint.Model) -> None:
        _write_matrix(self.spark, model.coef, f"{self.root}/{key}/coef")
        columns = [dataclasses.asdict(c) for c in model.columns]
        ends = {"passes": [int(p) for p in model.passes], "converged": [bool(c) for c in model.converged]}
        self._describe(key, {"kind": "linear", "columns": columns, **ends})

    def load_linear(self, key: str) -> joint.Model | None:
        if (about := self._described(key)) is None:
            return None
        columns = tuple(joint.Column(**c) for c in about["columns"])
        return joint.Model(columns, _read_matrix(self.spark, f"{self.root}/{key}/coef"), tuple(about["passes"]), tuple(about["converged"]))

    def save_network(self, key: str, network: mlp.Network, history: list[dict]) -> None:
        _write_matrix(self.spark, network.weights.reshape(-1, 1), f"{self.root}/{key}/weights")
        self._describe(key, {"kind": "network", "dims": list(network.dims), "labels": list(network.labels), "history": history})

    def load_network(self, key: str) -> tuple[mlp.Network, list[dict]] | None:
        if (about := self._described(key)) is None:
            return None
        weights = _read_matrix(self.spark, f"{self.root}/{key}/weights").ravel()
        return mlp.Network(weights, tuple(about["dims"]), tuple(about["labels"])), about["history"]
