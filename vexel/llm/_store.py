"""Tables and files in the folder that driver and executors share (`spark.checkpoint.dir`)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import store
from ..store import dropped, shared_folder

__all__ = ["dropped", "new_path", "saved", "shared_folder"]

#: Rows in an Arrow batch while a table is written: whole texts and sets of shingles pass in small parts.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/vexel-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """`store.saved` in small Arrow batches."""
    spark = df.sparkSession
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        return store.saved(df, name)
    finally:
        spark.conf.set(BATCH, before)
