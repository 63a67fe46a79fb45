"""Index folders: a row of JSON that names the kind and its settings, arrays, and tables."""

from __future__ import annotations

import base64
import io
import json

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .status import Status, require

MAGIC = "vexel-index"


def write(rows: DataFrame, path: str, kind: str, meta: dict, arrays: dict[str, np.ndarray], by: str | None = None) -> None:
    """Tables first, the JSON last: a folder without it is no index."""
    (rows.write.partitionBy(by) if by else rows.write).parquet(f"{path}/rows")
    packed = {}
    for name, x in arrays.items():
        out = io.BytesIO()
        np.save(out, x, allow_pickle=False)
        packed[name] = base64.b64encode(out.getvalue()).decode()
    text = json.dumps({"magic": MAGIC, "kind": kind, "meta": meta, "arrays": packed})
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/meta")


def read(spark: SparkSession, path: str, kind: str) -> tuple[dict, dict[str, np.ndarray], DataFrame]:
    try:
        found = spark.read.text(f"{path}/meta", wholetext=True).collect()
    except AnalysisException as e:
        require("PATH_NOT_FOUND" not in str(e), f"{path} is no index", Status.INTERNAL)
        raise
    try:
        spec = json.loads(found[0].value) if len(found) == 1 else {}
    except json.JSONDecodeError:
        spec = {}
    require(isinstance(spec, dict) and spec.get("magic") == MAGIC and spec.get("kind") == kind, f"{path} is no index of kind {kind}", Status.INTERNAL)
    arrays = {name: np.load(io.BytesIO(base64.b64decode(x)), allow_pickle=False) for name, x in spec["arrays"].items()}
    rows = spark.read.parquet(f"{path}/rows") if spec["meta"].get("n", 1) else spark.createDataFrame([], "id bigint, vec array<double>, cell int, code binary")
    return spec["meta"], arrays, rows
