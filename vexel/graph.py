"""A pruned proximity graph and its traversal."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files, search, store
from .ivf import all_knn
from .metric import Metric, normalized, scores, squared_l2, unit_rows
from .status import VexelError, check_build, log, require

CANDIDATES, MAX_DEGREE = 64, 63
#: Vectors and edges sent to the workers at most.
SENT_BYTES = 32 << 20


def _times(x: Column, by: int) -> Column:
    """The product of unsigned 32-bit numbers, modulo 2^32, without overflow of a long."""
    high = (F.shiftrightunsigned(x, 16) * F.lit(by)).bitwiseAND(0xFFFF)
    return (x.bitwiseAND(0xFFFF) * F.lit(by) + F.shiftleft(high, 16)).bitwiseAND(0xFFFFFFFF)


def seeds(query_id: int, n: int, nodes: int) -> np.ndarray:
    """The numbers of n - 1 hashed entry nodes: the same rule as in `_starts`."""
    x = (np.uint64(query_id & 0xFFFFFFFF) * np.uint64(2654435761) + np.arange(1, n, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
    for multiplier, shift in ((0x85EBCA6B, 13), (0xC2B2AE35, 16)):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(multiplier)) & np.uint64(0xFFFFFFFF)
        x ^= x >> np.uint64(shift)
    return (x % np.uint64(nodes)).astype(np.int64)


class GraphIndex:
    def __init__(self, vectors: DataFrame, metric: Metric = Metric.L2, degree: int = 32, reverse: bool = True, nprobe: int = 64, knn_cache: str | None = None):
        check_build(vectors, degree=degree)
        self.metric, self.degree, self.n = metric, min(degree, MAX_DEGREE), vectors.where("vec is not null").count()
        vec = normalized("vec") if metric == Metric.COSINE else F.col("vec").cast("array<double>")
        self.vectors = vectors.where("vec is not null").select(F.col("id").cast("long").alias("id"), vec.alias("vec"))
        self.reverse, self.nprobe, self.cache, self.seeds = reverse, nprobe, knn_cache, None

    @cached_property
    def forward(self) -> DataFrame:
        """Pruned edges (src, slot, dst, kind), made at first use and written: the neighbours of all rows are the dear
        part, and degrees, reverse edges and searches read them."""
        near = self._near(self.cache, self.nprobe)
        other = self.vectors.select("id", F.col("vec").alias("v"))
        rows = near.join(other, "id").join(self.vectors.select(F.col("id").alias("query_id"), F.col("vec").alias("q")), "query_id")
        r, m = self.degree, self.metric

        def prune(part: pd.DataFrame) -> pd.DataFrame:
            """A candidate goes when one kept before is nearer to it than the node is."""
            part = part.sort_values("rank")
            x = np.stack(part["v"].to_numpy())
            own = scores(m, np.stack(part["q"].to_numpy()[:1]), x)[0]
            between, kept = scores(m, x, x), []
            for i in range(len(x)):
                if len(kept) < r and all(between[c, i] <= own[i] for c in kept):
                    kept.append(i)
            return pd.DataFrame({"src": part["query_id"].to_numpy()[kept], "slot": np.arange(len(kept), dtype=np.int32), "dst": part["id"].to_numpy()[kept], "kind": "forward"})

        return store.saved(rows.groupBy("query_id").applyInPandas(prune, "src bigint, slot int, dst bigint, kind string"), "forward")

    @cached_property
    def edges(self) -> DataFrame:
        """All edges, forward ones first in a node's slots; written at first use."""
        return store.saved(self.forward.unionByName(self._reverse()), "edges") if self.reverse else self.forward

    def _near(self, cache: str | None, nprobe: int) -> DataFrame:
        """The nearest others of all rows; from the cache folder if it was made of as many rows and neighbours, else written there."""
        spark = self.vectors.sparkSession
        make = lambda: all_knn(self.vectors, CANDIDATES, self.metric, max(64, int(self.n**0.5)), nprobe)
        if cache is None:
            return make()
        key = {"n": self.n, "k": CANDIDATES, "metric": int(self.metric)}
        try:
            meta, _, rows = files.read(spark, cache, "knn")
            if meta == key:
                return rows
            log.warning("the neighbours in %s are of another table and are made again", cache)
            return make()
        except VexelError:
            files.write(make(), cache, "knn", key, {})
            return files.read(spark, cache, "knn")[2]

    def save(self, path: str) -> None:
        meta = {"metric": int(self.metric), "n": self.n, "degree": self.degree}
        self.edges.write.parquet(f"{path}/edges")
        files.write(self.vectors, path, "graph", meta, {})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphIndex:
        meta, _, rows = files.read(spark, path, "graph")
        out = cls.__new__(cls)
        out.metric, out.n, out.degree, out.vectors, out.seeds = Metric(meta["metric"]), meta["n"], meta["degree"], rows, None
        out.edges = spark.read.parquet(f"{path}/edges")
        out.forward = out.edges.where("kind = 'forward'")
        return out

    def _reverse(self) -> DataFrame:
        """Reverse edges in the free slots of a node, lowest source first; also of edges that run both ways."""
        full = self.forward.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
        back = self.forward.select(F.col("dst").alias("node"), F.col("src").alias("from"))
        back = back.join(full, "node", "left").na.fill({"n": 0})
        slot = F.col("n") + F.row_number().over(Window.partitionBy("node").orderBy("from")) - 1
        return back.withColumn("slot", slot.cast("int")).where(F.col("slot") < self.degree).select(F.col("node").alias("src"), "slot", F.col("from").alias("dst"), F.lit("reverse").alias("kind"))

    def degrees(self) -> DataFrame:
        n = self.forward.groupBy("src").agg(F.count("*").alias("n"))
        return n.agg(F.avg("n").alias("mean_degree"), F.min("n").alias("min_degree"), F.max("n").alias("max_degree"))

    def medoid(self) -> DataFrame:
        """The row nearest to the mean by L2, ties to the lowest id."""
        mean = self.vectors.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
        mean = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
        return self.vectors.crossJoin(F.broadcast(mean)).select("id", squared_l2("vec", "mean").alias("d")).orderBy("d", "id").limit(1).select("id")

    def _starts(self, queries: DataFrame, n: int) -> DataFrame:
        """Entry nodes of each query: the medoid, and n - 1 others chosen by a hash of the query's number."""
        spark = queries.sparkSession
        if self.seeds is None:  # node numbers 0.. in order of id, without a task for all of them
            rows = self.vectors.select("id").repartitionByRange("id").sortWithinPartitions("id")
            rows = store.saved(rows.select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "numbers")
            sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
            first, base = 0, []
            for p in sorted(sizes):
                base.append((p, first))
                first += sizes[p]
            base = spark.createDataFrame(base, "part int, base bigint")
            self.seeds = rows.join(F.broadcast(base), "part").select("id", (F.col("base") + F.col("at")).alias("number"))
        medoid = self.medoid().withColumnRenamed("id", "medoid")
        hashed = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(max(n - 1, 1)))).alias("i"))
        # Fixed values of the seeding rule: the multiplier, and the two of the mixer.
        x = (_times(F.col("query_id").bitwiseAND(0xFFFFFFFF), 2654435761) + F.col("i")).bitwiseAND(0xFFFFFFFF)
        for multiplier, shift in ((0x85EBCA6B, 13), (0xC2B2AE35, 16)):
            x = _times(x.bitwiseXOR(F.shiftrightunsigned(x, 16)), multiplier)
            x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
        hashed = hashed.select("query_id", (x % self.n).alias("number"))
        some = hashed.join(self.seeds, "number").select("query_id", "id") if n > 1 else queries.limit(0).select("query_id", F.lit(0).cast("bigint").alias("id"))
        return some.unionByName(queries.select("query_id").crossJoin(F.broadcast(medoid)).select("query_id", F.col("medoid").alias("id"))).distinct()

    def search(self, queries: DataFrame, k: int = 10, width: int = 64, starts: int = 32, expand: int = 8, rounds: int = -1, mode: str | None = None) -> DataFrame:
        """The k nearest nodes found by a traversal that holds max(width, k) nodes a query.

        Mode `best_first` sends the graph to the workers, `beam` walks it by joins; unless named, the
        first serves graphs of at most `SENT_BYTES`, the second all others."""
        require(mode in (None, "best_first", "beam"), "mode is best_first or beam")
        k = max(k, 1)
        width = max(width, k)
        starts = max(1, min(starts, width))
        if not self.n:
            return search.ranked(queries.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double"), self.metric, k)
        if mode is None:
            dim = self.vectors.select(F.size("vec").alias("d")).first().d
            mode = "best_first" if self.n * (8 * dim + 4 * self.degree) <= SENT_BYTES else "beam"
        found = self._best_first(queries, width, starts) if mode == "best_first" else self._beam(queries, width, starts, max(1, expand), rounds)
        return search.ranked(found, self.metric, k)

    def _best_first(self, queries: DataFrame, width: int, starts: int) -> DataFrame:
        """From the frontier the best node is expanded, until it is worse than the worst of a full result."""
        rows = self.vectors.orderBy("id").toArrow().combine_chunks()
        ids, x = rows.column(0).to_numpy(), search.matrix(rows.column(1).chunk(0))
        edges = self.edges.select("src", "slot", "dst").toArrow()
        src, slot, dst = (edges.column(i).to_numpy() for i in range(3))
        order = np.lexsort((slot, src))
        links = np.searchsorted(ids, dst[order]).astype(np.int32)
        first = np.searchsorted(src[order], ids), np.searchsorted(src[order], ids, "right")
        shared = queries.sparkSession.sparkContext.broadcast((ids, x, links, first, int(np.searchsorted(ids, self.medoid().first().id))))
        metric = self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x, links, (begin, end), entry = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                q = search.matrix(b.column(1))
                q = unit_rows(q) if metric == Metric.COSINE else q
                for query_id, v in zip(b.column(0).to_pylist(), q, strict=True):
                    seen = np.zeros(len(ids), bool)
                    todo: list[tuple[float, int]] = []
                    held: list[tuple[float, int]] = []
                    fresh = np.unique(np.append(seeds(query_id, starts, len(ids)), entry))
                    while True:
                        seen[fresh] = True
                        for s, i in zip(scores(metric, v[None], x[fresh])[0].tolist(), fresh.tolist(), strict=True):
                            heapq.heappush(todo, (-s, i))
                            heapq.heappush(held, (s, -i))
                            if len(held) > width:
                                heapq.heappop(held)
                        fresh = fresh[:0]
                        while todo and not len(fresh):
                            s, i = heapq.heappop(todo)
                            if len(held) == width and -s < held[0][0]:
                                todo = []
                                break
                            fresh = np.unique(links[begin[i] : end[i]])
                            fresh = fresh[~seen[fresh]]
                        if not len(fresh):
                            break
                    yield pa.RecordBatch.from_pydict({"query_id": np.full(len(held), query_id), "id": ids[[-i for _, i in held]], "score": np.array([s for s, _ in held])})

        return queries.where("vec is not null").select("query_id", "vec").mapInArrow(run, "query_id bigint, id bigint, score double")

    def _beam(self, queries: DataFrame, width: int, starts: int, expand: int, rounds: int) -> DataFrame:
        """A beam of `width` nodes a query: each round the `expand` best nodes not yet expanded give their
        neighbours, which are scored if never seen; it ends when no beam holds an unexpanded node, or after `rounds`.

        Every round is a few joins on the stored edges and vectors, and its result is written: neither the graph nor
        the vectors meet on the driver or in one task."""
        rounds = rounds if rounds > 0 else -(-(2 * width + 100) // expand)
        m = self.metric
        vec = normalized("vec") if m == Metric.COSINE else F.col("vec").cast("array<double>")
        asked = store.saved(queries.where("vec is not null").select(F.col("query_id").cast("long").alias("query_id"), vec.alias("q")), "asked")

        def scored(nodes: DataFrame) -> DataFrame:
            """(query_id, id) with scores; only the vectors asked for are moved where they are few."""
            pairs = nodes.join(self.vectors, "id").join(asked, "query_id")

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        x, q = search.matrix(b.column(2)), search.matrix(b.column(3))
                        s = -((x - q) ** 2).sum(axis=1) if m == Metric.L2 else (x * q).sum(axis=1)
                        yield pa.RecordBatch.from_pydict({"query_id": b.column(0), "id": b.column(1), "score": s})

            return pairs.select("query_id", "id", "vec", "q").mapInArrow(run, "query_id bigint, id bigint, score double")

        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        seen = store.saved(scored(self._starts(asked, starts)).withColumn("round", F.lit(0)), "seen")
        beam = store.saved(seen.withColumn("open", F.lit(True)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= width).drop("rank"), "beam")
        for step in range(1, rounds + 1):
            open_rank = Window.partitionBy("query_id", "open").orderBy(F.desc("score"), "id")
            marked = beam.withColumn("turn", F.col("open") & (F.row_number().over(open_rank) <= expand))
            near = marked.where("turn").join(self.edges.select(F.col("src").alias("id"), "dst"), "id").select("query_id", F.col("dst").alias("id")).distinct()
            fresh = store.saved(scored(near.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti")).withColumn("round", F.lit(step)), "seen")
            pool = marked.select("query_id", "id", "score", "round", (F.col("open") & ~F.col("turn")).alias("open")).unionByName(fresh.withColumn("open", F.lit(True)))
            after = store.saved(pool.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= width).drop("rank"), "beam")
            store.dropped(beam)
            beam, seen = after, seen.unionByName(fresh)
            if not beam.where("open").limit(1).count():
                break
        return beam.select("query_id", "id", "score")
