"""The shape shared by every search: queries x candidates, score, ranked top k.

Queries come to the workers in runs of at most `QUERIES`, so a broadcast never grows with the data; each batch of
candidates is scored by matrix products and leaves at most k rows a query; one ranked window merges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metric import Metric, scores, unit_rows, value
from .status import require

QUERIES = 4096
#: Bytes of scores made at a time, and the fewest candidates in a tile.
TILE_BYTES, TILE_ROWS = 128 << 20, 256
RESULT = "query_id bigint, rank int, id bigint, distance double"


def ranked(pairs: DataFrame, metric: Metric, k: int) -> DataFrame:
    """(query_id, id, score) to the k nearest; NaN and -inf never enter, ties go to the smaller id."""
    good = pairs.where(~F.isnan("score") & (F.col("score") > float("-inf")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return good.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", value(metric, "score").alias("distance"))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column of equal lengths (`dim`, if given), in double; null components are NaN."""
    at = np.asarray(column.offsets, np.int64)
    lens = np.diff(at)
    if len(lens):
        wrong = lens[lens != (lens[0] if dim is None else dim)]
        require(not len(wrong), f"a vector of {wrong[0] if len(wrong) else 0} components among those of {lens[0] if dim is None else dim}")
    flat = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def query_runs(queries: DataFrame, metric: Metric) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    queries = queries.where("vec is not null and query_id is not null")
    n = queries.count()
    parts = -(-n // (QUERIES // 2))
    for p in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).collect()
        if rows:
            dims = {len(r.vec) for r in rows}
            require(len(dims) == 1, f"queries of different lengths: {sorted(dims)}")
            q = np.array([r.vec for r in rows], np.float64)
            yield np.array([r.query_id for r in rows], np.int64), unit_rows(q) if metric == Metric.COSINE else q


def best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row of s, ties of the k-th all kept."""
    s = np.where(np.isnan(s), -np.inf, s)
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None] if s.shape[1] > k else -np.inf
    return np.nonzero((s >= least) & (s > -np.inf))


def nearest(metric: Metric, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the k best rows of x (of these ids) for each query."""
    s = scores(metric, q, x)
    i, j = best(s, k)
    return i, j, s[i, j]


def scan(rows: DataFrame, queries: DataFrame, metric: Metric, k: int, unpack: Callable[[pa.RecordBatch, int], np.ndarray] | None = None, probes: Callable[[np.ndarray], np.ndarray] | None = None, code_metric: Metric | None = None, pick: Callable = nearest) -> DataFrame:
    """The k best rows of each query. With `probes` (query matrix to its cells) a row counts only in a probed `cell`, and
    cells that no query of a run probes aren't read. `pick` finds the k best rows of a tile."""
    spark, out = rows.sparkSession, None
    unpack = unpack or (lambda b, dim: matrix(b.column(b.schema.get_field_index("vec")), dim))
    used = code_metric if code_metric is not None else metric
    for ids, q in query_runs(queries, metric):
        cells: dict[int, np.ndarray] | None = None
        if probes is not None:
            got = probes(q)
            order = np.argsort(got.ravel(), kind="stable")
            keys, first = np.unique(got.ravel()[order], return_index=True)
            cells = {int(c): x for c, x in zip(keys, np.split(order // got.shape[1], first[1:]), strict=True)}
        shared = spark.sparkContext.broadcast((ids, q, cells))
        read = rows if cells is None else rows.where(F.col("cell").isin([int(c) for c in keys]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, cells = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                row = b.column(b.schema.get_field_index("id")).to_numpy()
                x = unpack(b, q.shape[1])
                groups = [(np.arange(len(ids)), np.arange(len(row)))]
                if cells is not None:
                    cell = b.column(b.schema.get_field_index("cell")).to_numpy()
                    groups = [(cells[c], np.flatnonzero(cell == c)) for c in np.unique(cell).tolist() if c in cells]
                for of, group in groups:
                    step = max(TILE_ROWS, TILE_BYTES // 8 // len(of))
                    for at in (group[a : a + step] for a in range(0, len(group), step)):
                        i, j, s = pick(used, q[of], x[at], row[at], k)
                        yield pa.RecordBatch.from_pydict({"query_id": ids[of[i]], "id": row[at[j]], "score": s})

        got = read.mapInArrow(run, "query_id bigint, id bigint, score double")
        out = got if out is None else out.unionByName(got)
    return ranked(out if out is not None else spark.createDataFrame([], "query_id bigint, id bigint, score double"), used, k)


def padded(result: DataFrame, queries: DataFrame, metric: Metric, k: int) -> DataFrame:
    """One row a query: ids and distances, filled up to k with -1 and the metric's worst value."""
    worst = float("inf") if metric == Metric.L2 else float("-inf")
    got = result.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "distance"))).alias("r"))
    rows = queries.select("query_id").join(got, "query_id", "left").withColumn("r", F.coalesce("r", F.expr("array()").cast("array<struct<rank:int,id:bigint,distance:double>>")))
    fill = lambda name, x: F.concat(F.col(f"r.{name}"), F.array_repeat(x, F.lit(k) - F.size("r")))
    return rows.select("query_id", fill("id", F.lit(-1).cast("long")).alias("ids"), fill("distance", F.lit(worst)).alias("distances"))


def recall(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of the true k nearest that the result holds; missing places are misses."""
    both = truth.select("query_id", "id").join(result.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    m = truth.select("query_id").distinct().agg(F.count("*").alias("m"))
    return both.agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits")).crossJoin(m).select((F.col("hits") / (F.col("m") * k)).alias("recall"))
