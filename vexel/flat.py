"""Exact search over vectors (id, vec)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, search
from .metric import Metric, normalized, score
from .status import MAX_K, check_build, log

def clamped(k: int, told: set | None = None) -> int:
    """k within 1..MAX_K, with one warning an index."""
    if not 1 <= k <= MAX_K and (told is None or not told):
        log.warning("k=%d is clamped to 1..%d", k, MAX_K)
        if told is not None:
            told.add(k)
    return min(max(k, 1), MAX_K)


class FlatIndex:
    def __init__(self, vectors: DataFrame, metric: Metric = Metric.L2):
        check_build(vectors)
        self.told: set[int] = set()
        self.metric, self.schema = metric, vectors.select(F.col("id").cast("long"), F.col("vec").cast("array<double>")).schema
        self.vectors = self._ready(vectors)

    def _ready(self, v: DataFrame) -> DataFrame:
        vec = normalized("vec") if self.metric == Metric.COSINE else F.col("vec")
        return v.where("vec is not null").select(F.col("id").cast("long").alias("id"), vec.alias("vec"))

    def add(self, more: DataFrame) -> FlatIndex:
        out = FlatIndex.__new__(FlatIndex)
        out.told = self.told
        out.metric, out.schema, out.vectors = self.metric, self.schema, self.vectors.unionByName(self._ready(more))
        return out

    def reset(self) -> FlatIndex:
        return FlatIndex(self.vectors.sparkSession.createDataFrame([], self.schema), self.metric)

    def size(self) -> int:
        return self.vectors.count()

    def dim(self) -> int:
        """Components of the vectors (0 if there are none)."""
        row = self.vectors.select(F.size("vec").alias("d")).first()
        return row.d if row else 0

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, rank, id, distance of the k nearest rows of each query (query_id, vec)."""
        return search.scan(self.vectors, queries, self.metric, clamped(k, self.told))

    def search_sql(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The same in column functions alone; for few queries."""
        q = queries.select("query_id", (normalized("vec") if self.metric == Metric.COSINE else F.col("vec")).alias("q"))
        pairs = self.vectors.crossJoin(q).select("query_id", "id", score(self.metric, "q", "vec").alias("score"))
        return search.ranked(pairs, self.metric, clamped(k, self.told))

    def save(self, path: str) -> None:
        files.write(self.vectors, path, "flat", {"metric": int(self.metric)}, {})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FlatIndex:
        meta, _, rows = files.read(spark, path, "flat")
        out = cls.__new__(cls)
        out.metric, out.vectors, out.told = Metric(meta["metric"]), rows, set()
        out.schema = rows.select("id", F.col("vec").cast("array<double>")).schema
        return out
