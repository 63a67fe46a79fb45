"""Tables in the folder that driver and executors share (`spark.checkpoint.dir`)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one of ours only where none is set and all runs in one process, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='vexel-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts the lineage, outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/vexel-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, name: str, key: str, folders: bool) -> DataFrame:
    """The same, laid out by a key, so that a filter on it reads only the files (`folders`) or row groups it needs.
    A hot key is cut into several files."""
    path = f"{shared_folder(df.sparkSession)}/vexel-{name}-{uuid.uuid4().hex}"
    if folders:
        df.hint("rebalance", F.col(key)).write.partitionBy(key).parquet(path)
    else:
        df.repartitionByRange(key, F.xxhash64(*df.columns)).sortWithinPartitions(key).write.parquet(path)
    fields = [f for f in df.schema.fields if f.name != key] + [df.schema[key]]
    return df.sparkSession.read.schema(StructType(fields)).parquet(path).select(*df.columns)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that `saved` made and nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/vexel-" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
