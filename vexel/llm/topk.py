"""Operator 5: exact top-k by inner product over impact-ordered postings.

Components become floor(1024 x). A task indexes its rows in blocks: for each dimension the rows by quantised
value, so that (dimension, level) is a posting segment of one impact for a query. Segments are processed by
falling impact above the dimension's least one; after each run of segments the rows that can still reach the k-th
lower bound of distinct ids other than the query's are counted, and the scan stops only when the others are proven out by the impacts left and the quantisation
error. Possible members are rescored exactly. Queries are taken in runs of at most `QUERIES`, so what is
broadcast is bounded; each task returns k rows a query, and a ranked window merges them.

Defined results: vectors that are null or hold null or non-finite components, or rows with null id, take no part; ties go to the
smaller id; rows with the query's id are its own and no candidates; repeated rows with one id count once
(the least score's row order has no part: the largest score of the id stands); a vector whose length differs from
the query's is no candidate; other columns are not read; an empty table gives no rows; very long vectors are taken whole. Scores are exact
while they fit 64 bits (with 64 components, while all are below 2^18 in magnitude).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, K, QUERIES, ROWS, LEVELS, RUNS = 1024, 10, 8192, 8192, 64, 6


class Block:
    """The postings of up to `ROWS` integer vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n, d = rows.shape
        self.by_id = np.argsort(ids, kind="stable")
        self.distinct, self.first = np.unique(ids[self.by_id], return_index=True)
        low = rows.min(axis=0)
        self.step = np.maximum(1, -(-(rows.max(axis=0) - low + 1) // LEVELS))
        level = (rows - low) // self.step
        key = (np.arange(d) * LEVELS + level).T.ravel()  # dimension-major
        order = np.argsort(key, kind="stable")
        self.posting = order % n
        self.bounds = np.searchsorted(key[order], np.arange(d * LEVELS + 1))
        self.value = (low[:, None] + np.arange(LEVELS) * self.step[:, None]).ravel()
        self.used = np.flatnonzero(np.diff(self.bounds))
        self.dim = self.used // LEVELS

    def search(self, q: np.ndarray, own: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of all rows that may be among the k best with score >= `least`."""
        n, d = self.rows.shape
        # An impact is the segment's smallest possible product; a row's true product is at most `slack` more.
        slack = np.abs(q) * (self.step - 1)
        at = self.value[self.used] * q[self.dim] - np.where(q < 0, slack, 0)[self.dim]
        floor = np.full(d, np.iinfo(np.int64).max)
        np.minimum.at(floor, self.dim, at)
        gain = at - floor[self.dim]
        order = np.argsort(-gain, kind="stable")
        lens = (self.bounds[self.used + 1] - self.bounds[self.used])[order]
        ends = np.cumsum(lens)
        acc = np.full(n, float(floor.sum()))
        spread, a = float(slack.sum()), 0
        others = self.distinct != own
        alive = np.arange(n)
        for r in range(RUNS):
            b = len(order) if r == RUNS - 1 else int(np.searchsorted(ends, ends[-1] * (r + 1) / (2 * RUNS))) + 1
            part = order[a:b]
            if len(part):
                starts = self.bounds[self.used[part]]
                sizes = lens[a:b]
                first = np.cumsum(sizes) - sizes
                where = np.arange(sizes.sum()) + np.repeat(starts - first, sizes)
                acc += np.bincount(self.posting[where], np.repeat(gain[part], sizes).astype(float), n)
            a = b
            rest = np.zeros(d, np.int64)
            np.maximum.at(rest, self.dim[order[a:]], gain[order[a:]])
            # Repeated rows of an id and the query's own rows fill no place of the k.
            bound = np.maximum.reduceat(acc[self.by_id], self.first)[others]
            low = np.partition(bound, len(bound) - k)[len(bound) - k] if len(bound) >= k else -np.inf
            alive = np.flatnonzero(acc + rest.sum() + spread >= max(low, least))
            if len(alive) <= 4 * k:
                break
        alive = alive[self.ids[alive] != own]
        return self.ids[alive], self.rows[alive] @ q


def prepared(vectors: DataFrame, vec_id: str, vec: str) -> DataFrame:
    good = F.col(vec).isNotNull() & F.col(vec_id).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vec, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return vectors.where(good).select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"))


def search(vectors: DataFrame, is_query, k: int = K, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows that `is_query` (a column) marks, against all rows."""
    spark = vectors.sparkSession
    asked = prepared(vectors.where(is_query), vec_id, vec).distinct()
    n = asked.count()
    runs = -(-n // (QUERIES // 2)) or 1
    found = None
    for r in range(runs):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(runs)) == r).orderBy("id", "v").collect()
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(x.v) for x in part}:
            same = [x for x in part if len(x.v) == size]
            by_size[size] = np.array([x.id for x in same], np.int64), np.array([x.v for x in same], np.int64).reshape(len(same), size)
        shared = spark.sparkContext.broadcast(by_size)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

            def add(size: int) -> None:
                ids = np.concatenate([x for x, _ in held[size]])
                block = Block(ids, np.concatenate([y for _, y in held.pop(size)]))
                for i, (own, q) in enumerate(zip(*shared.value[size], strict=True)):
                    old = best.get((size, i), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    least = int(old[1][-1]) if len(old[0]) == k else np.iinfo(np.int64).min
                    got, score = block.search(q, int(own), k, least)
                    got, score = np.concatenate([old[0], got]), np.concatenate([old[1], score])
                    order = np.lexsort((-score, got))
                    order = order[np.concatenate([[True], np.diff(got[order]) != 0])] if len(order) else order
                    order = order[np.lexsort((got[order], -score[order]))][:k]
                    best[size, i] = got[order], score[order]

            for b in batches:
                lists = b.column(1)
                offsets = np.asarray(lists.offsets, np.int64)
                flat, lens = np.asarray(lists.values, np.int64), np.diff(offsets)
                ids = b.column(0).to_numpy()
                for size in np.unique(lens):
                    if int(size) not in shared.value or not size:
                        continue
                    mine = np.flatnonzero(lens == size)
                    rows = flat[offsets[mine][:, None] + np.arange(size)]
                    for at in range(0, len(mine), ROWS):
                        held.setdefault(int(size), []).append((ids[mine[at : at + ROWS]], rows[at : at + ROWS]))
                        if sum(len(x) for x, _ in held[int(size)]) >= ROWS:
                            add(int(size))
            for size in list(held):
                add(size)
            for (size, i), (ids, score) in best.items():
                yield pa.RecordBatch.from_pydict({"query_id": np.full(len(ids), shared.value[size][0][i]), "vec_id": ids, "score": score})

        got = prepared(vectors, vec_id, vec).mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
        found = got if found is None else found.unionByName(got)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
