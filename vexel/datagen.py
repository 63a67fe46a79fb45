"""Clustered vectors for benches: centres uniform in (-1, 1), points normal around one of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def clustered(spark: SparkSession, n: int, dim: int, clusters: int | None = None, spread: float = 0.1, seed: int = 42, part: int = 0) -> DataFrame:
    """(id, vec); every row depends on its id and the seed alone. Another `part` gives other points of the same centres."""
    clusters = clusters or max(16, int(n**0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.random.default_rng(seed).uniform(-1, 1, (clusters, dim))
        for b in batches:
            out = []
            for i in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, part, i])
                out.append(centres[rng.integers(clusters)] + rng.normal(0, spread, dim))
            flat = pa.array(np.concatenate(out).astype(np.float32)) if out else pa.array([], pa.float32())
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "vec": pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim), flat)})

    return spark.range(n).mapInArrow(run, "id bigint, vec array<float>")
