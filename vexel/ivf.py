"""Inverted-file search over k-means cells, with full vectors or product-quantized residuals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files, search, store
from .flat import clamped
from .metric import Metric, normalized, score, scores
from .status import check_build, require

SEED, PER_CENTROID, SUB, OPQ_SAMPLE = 12345, 256, 256, 65_536
#: Training rows that may meet on the driver, and cells that have a folder each.
DRIVER_ROWS, FOLDERS = 65_536, 4096
#: Scores made at a time by an assignment or a rerank: 1 MB, which stays in a CPU's cache, and as much for each step of a formula.
TILE = 1 << 17
#: Pairs scored exactly at a time.
PAIRS = 1 << 14


def sampled(vectors: DataFrame, n: int, of: int) -> DataFrame:
    """About n of the `of` rows, those with the least hashes of seed and id; exactly n where they fit on the driver."""
    key = F.md5(F.concat_ws(":", F.lit(SEED), "id"))
    if n >= of:
        return vectors
    if n <= DRIVER_ROWS:
        return vectors.orderBy(key, "id").limit(n)
    return vectors.where(F.conv(F.substring(key, 1, 12), 16, 10).cast("double") < n / of * 16.0**12)


def sample(vectors: DataFrame, n: int) -> np.ndarray:
    """At most n rows on the driver, in an order that depends on the seed and id alone; without those that aren't finite,
    which would spoil every mean (a row of zeros if all are such)."""
    rows = vectors.orderBy(F.md5(F.concat_ws(":", F.lit(SEED), "id")), "id").limit(n).select("vec").toArrow()
    x = search.matrix(rows.column(0).combine_chunks().cast(pa.list_(rows.schema.field(0).type.value_type)))
    good = np.isfinite(x).all(axis=1)
    return x if good.all() else x[good] if good.any() else np.zeros((1, x.shape[1]))


def assign(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest centroid, ties to the lowest."""
    step = max(1, TILE // max(len(centroids), 1))
    parts = [scores(Metric.L2, x[a : a + step], centroids).argmax(axis=1) for a in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, iters: int = 12) -> np.ndarray:
    """Lloyd rounds over the training rows; the first k are the seeds (again from the start if fewer)."""
    c = x[np.arange(k) % len(x)].copy()
    rng = np.random.default_rng(SEED)
    for _ in range(iters):
        cell = assign(x, c)
        n = np.bincount(cell, minlength=k)
        total = np.stack([np.bincount(cell, part, k) for part in x.T], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
        c = c.astype(np.float32).astype(np.float64)
    return c


def kmeans_table(rows: DataFrame, k: int, iters: int = 12) -> np.ndarray:
    """The same rounds over a table (id, vec): each task adds up its rows by cell, and only sums of cells meet. Empty
    cells take rows chosen by hash."""
    spark = rows.sparkSession
    start = sample(rows, k)
    c = start[np.arange(k) % len(start)].copy()
    dim = c.shape[1]
    for _ in range(iters):
        shared = spark.sparkContext.broadcast(c)  # k rows: bounded by the number of cells

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            n, total = np.zeros(len(c), np.int64), np.zeros_like(c)
            for b in batches:
                if b.num_rows:
                    x = search.matrix(b.column(0), c.shape[1])
                    x = x[np.isfinite(x).all(axis=1)]
                    cell = assign(x, c)
                    n += np.bincount(cell, minlength=len(c))
                    np.add.at(total, cell, x)
            some = np.flatnonzero(n)
            flat = pa.array(total[some].ravel())
            yield pa.RecordBatch.from_pydict({"cell": some, "n": n[some], "total": pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * c.shape[1]), flat)})

        sums = rows.select("vec").mapInArrow(add, "cell bigint, n bigint, total array<double>").groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total")).toArrow()
        cell, n = sums.column("cell").to_numpy(), sums.column("n").to_numpy()
        c = start[np.random.default_rng(SEED).integers(0, len(start), k)].copy()
        c[cell] = np.array(sums.column("total").to_pylist(), np.float64).reshape(len(cell), dim) / n[:, None]
        c = c.astype(np.float32).astype(np.float64)
        shared.unpersist()
    return c


def trained(vectors: DataFrame, n: int, nlist: int, iters: int, subsample: bool) -> np.ndarray:
    """Centroids from PER_CENTROID rows a cell, or from all rows; on the driver while these rows are few."""
    most = min(n, PER_CENTROID * nlist) if subsample else n
    if most <= DRIVER_ROWS:
        return kmeans(sample(vectors, most), nlist, iters)
    rows = store.saved(sampled(vectors, most, n), "training")
    c = kmeans_table(rows, nlist, iters)
    store.dropped(rows)
    return c


class IvfIndex:
    """Cells are always by L2; the fine score is by the metric. Rows are assigned to cells once, and written by cell, so
    that a search reads the cells it probes and no others."""

    def __init__(self, vectors: DataFrame, metric: Metric = Metric.L2, nlist: int = 64, iters: int = 12, subsample: bool = True):
        check_build(vectors, nlist=nlist)
        vec = normalized("vec") if metric == Metric.COSINE else F.col("vec")
        self.vectors = vectors.where("vec is not null").select(F.col("id").cast("long").alias("id"), vec.alias("vec"))
        self.metric, self.n, self.asked = metric, self.vectors.count(), nlist
        self.nlist = max(1, min(nlist, self.n))
        self.centroids = trained(self.vectors, self.n, self.nlist, iters, subsample) if self.n else np.zeros((0, 0))
        self.postings = store.saved_by(self.assigned(), "postings", "cell", self.nlist <= FOLDERS)

    def dim(self) -> int:
        return self.centroids.shape[1]

    def assigned(self) -> DataFrame:
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = assign(search.matrix(b.column(1), centroids.shape[1]), centroids) if b.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "cell"])

        kind = self.vectors.schema["vec"].dataType.simpleString()
        return self.vectors.mapInArrow(run, f"id bigint, vec {kind}, cell int")

    def cell_sizes(self) -> DataFrame:
        return self.postings.groupBy("cell").agg(F.count("*").alias("n"))

    def probes(self, nprobe: int):
        centroids, n = self.centroids, min(max(nprobe, 1), self.nlist)
        return lambda q: np.argsort(-scores(Metric.L2, q, centroids), axis=1, kind="stable")[:, :n]

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 8) -> DataFrame:
        if not self.n:
            return search.ranked(queries.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double"), self.metric, 1)
        return search.scan(self.postings, queries, self.metric, max(k, 1), probes=self.probes(nprobe))

    def save(self, path: str) -> None:
        files.write(self.postings, path, "ivf", {"metric": int(self.metric), "n": self.n, "nlist": self.nlist, "asked": self.asked}, {"centroids": self.centroids}, by="cell")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        meta, arrays, rows = files.read(spark, path, "ivf")
        out = cls.__new__(cls)
        out.metric, out.n, out.nlist, out.asked = Metric(meta["metric"]), meta["n"], meta["nlist"], meta["asked"]
        out.centroids, out.postings = arrays["centroids"], rows.select("id", "vec", "cell")
        out.vectors = out.postings.select("id", "vec")
        return out


def all_knn(vectors: DataFrame, k: int, metric: Metric = Metric.L2, nlist: int = 64, nprobe: int = 64) -> DataFrame:
    """The k nearest others of every row."""
    index = IvfIndex(vectors, metric, nlist)
    if not index.n:
        return vectors.sparkSession.createDataFrame([], search.RESULT)
    got = index.search(vectors.select(F.col("id").alias("query_id"), "vec"), k + 1, nprobe).where("id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k)


def rotation(x: np.ndarray, m: int, iters: int = 20, rounds: int = 4) -> tuple[np.ndarray, list[float]]:
    """A rotation that lowers the quantization error, by alternating codebooks and Procrustes steps; and the errors."""
    d = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))[0]
    errors: list[float] = []
    for _ in range(iters):
        y = x @ r.T
        book = train_codes(y, m, rounds)
        near = decode(encode(y, book), book)
        errors.append(float(((y - near) ** 2).sum(axis=1).mean()))
        if len(errors) > 1 and errors[-2] - errors[-1] < 1e-4 * errors[-2]:
            break
        u, s, vt = np.linalg.svd(near.T @ x)
        if s[-1] < 1e-9 * s[0]:
            break
        r = u @ vt
    return r, errors


def train_codes(x: np.ndarray, m: int, iters: int = 12) -> np.ndarray:
    sub = x.shape[1] // m
    return np.stack([kmeans(x[:, i * sub : (i + 1) * sub], SUB, iters) for i in range(m)])


def encode(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    m, _, sub = book.shape
    return np.stack([assign(x[:, i * sub : (i + 1) * sub], book[i]) for i in range(m)], axis=1).astype(np.uint8)


def decode(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.concatenate([book[i][codes[:, i]] for i in range(len(book))], axis=1)


def possible(s: np.ndarray, slack: np.ndarray, k: int) -> np.ndarray:
    """Which entries may be among the k best of their row, each known to within its slack (NaN: not known at all)."""
    if s.shape[1] <= k:
        return np.ones(s.shape, bool)
    low = s - slack
    low[np.isnan(low)] = -np.inf
    return ~(s + slack < np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k][:, None])


def exact(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of pairs of rows, added up component by component as `metric.score` does."""
    s = np.zeros(len(q))
    for a, b in zip(q.T, x.T, strict=True):
        s += (a - b) * (a - b) if metric == Metric.L2 else a * b
    return -s if metric == Metric.L2 else s


def reranked(metric: Metric, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A `search.scan` pick over rows of decoded code and vector side by side: the k best by the exact score of the vectors, ties to
    the smaller id. The scores of codes with their known errors, then those of a matrix product, tell which rows can't be among these."""
    dim = q.shape[1]
    good = np.flatnonzero(np.isfinite(x[:, dim:]).all(axis=1))  # others have no score that ranks
    code, vec, ids = x[good, :dim], x[good, dim:], ids[good]
    error, size = np.sqrt(((vec - code) ** 2).sum(axis=1)), np.sqrt((vec * vec).sum(axis=1))
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, TILE // max(len(good), 1))
    for at in range(0, len(q) if len(good) else 0, step):
        some = q[at : at + step]
        norm = np.sqrt((some * some).sum(axis=1))[:, None]
        rounding = 1e-14 * dim * (norm + size + error) ** 2
        s = scores(metric, some, code)
        off = error * (2 * np.sqrt(-s) + 2 * np.sqrt(rounding) + error) if metric == Metric.L2 else norm * error
        near = possible(s, off + rounding, k) & np.isfinite(some).all(axis=1)[:, None]
        i, j = np.nonzero(near & possible(np.where(near, scores(metric, some, vec), -np.inf), rounding, k))
        s = np.concatenate([np.zeros(0), *(exact(metric, some[i[a : a + PAIRS]], vec[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS))])
        order = np.lexsort((ids[j], -s, i))
        order = order[s[order] > -np.inf]
        first = np.searchsorted(i[order], i[order])
        order = order[np.arange(len(order)) - first < k]
        out.append((at + i[order], good[j[order]], s[order]))
    i, j, s = map(np.concatenate, zip(*out, strict=True))
    return i, j, s


class IvfPqIndex:
    """Rows as codes of m bytes and, unless told otherwise, their vectors, written by cell. The distance without rerank is an
    approximate squared L2, also under COSINE. A rerank of all rows is done where the codes are read; a shorter list is joined with the vectors."""

    def __init__(self, vectors: DataFrame, metric: Metric = Metric.L2, nlist: int = 64, m: int = 8, residual: bool = True, opq: bool = False, keep_vectors: bool = True):
        check_build(vectors, nlist=nlist, m=m)
        require(metric != Metric.INNER_PRODUCT, "the inner product isn't supported with codes")
        self.metric, self.m, self.residual, self.told = metric, m, residual, set()
        vec = normalized("vec") if metric == Metric.COSINE else F.col("vec")
        self.full = vectors.where("vec is not null").select(F.col("id").cast("long").alias("id"), vec.alias("vec"))
        self.n, self.kept, self.asked = self.full.count(), keep_vectors, nlist
        rows = sample(self.full, OPQ_SAMPLE)
        require(not len(rows) or rows.shape[1] % m == 0, "m must divide the dimension")
        self.r, self.errors = rotation(rows, m) if opq and len(rows) else (np.eye(rows.shape[1]), [])
        rows = rows @ self.r.T
        self.nlist = max(1, min(nlist, self.n))
        if not self.n:
            self.centroids, self.book = np.zeros((0, 0)), np.zeros((m, SUB, 0))
            self.rows = self.codes = vectors.sparkSession.createDataFrame([], "id bigint, cell int, code binary")
            return
        # Cells from as many rows as an IvfIndex takes, in the rotated space; codebooks from the sample.
        self.centroids = trained(self.full, self.n, self.nlist, 12, True) @ self.r.T if PER_CENTROID * self.nlist > len(rows) else kmeans(rows[: PER_CENTROID * self.nlist], self.nlist)
        cell = assign(rows, self.centroids)
        self.book = train_codes(rows - self.centroids[cell] if residual else rows, m)
        self.rows = store.saved_by(self._coded(), "codes", "cell", self.nlist <= FOLDERS)
        self.codes = self.rows.select("id", "cell", "code")

    def _coded(self) -> DataFrame:
        r, centroids, book, residual, kept = self.r, self.centroids, self.book, self.residual, self.kept
        kind = self.full.schema["vec"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = search.matrix(b.column(1), len(r)) @ r.T if b.num_rows else np.zeros((0, len(r)))
                cell = assign(x, centroids)
                code = encode(x - centroids[cell] if residual else x, book)
                coded = {"id": b.column(0), "cell": cell.astype(np.int32), "code": pa.array([c.tobytes() for c in code], pa.binary())}
                yield pa.RecordBatch.from_pydict(coded | ({"vec": b.column(1)} if kept else {}))

        return self.full.mapInArrow(run, "id bigint, cell int, code binary" + f", vec {kind}" * kept)

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 8, rerank: int = 0) -> DataFrame:
        r, centroids, book, residual = self.r, self.centroids, self.book, self.residual
        k = clamped(k, self.told)
        again = self.kept and rerank > k
        if not self.n:
            return search.ranked(queries.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double"), self.metric, 1)

        def unpack(b: pa.RecordBatch, dim: int) -> np.ndarray:
            code = np.frombuffer(b"".join(b.column(b.schema.get_field_index("code")).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            x = decode(code, book)
            return (x + centroids[b.column(b.schema.get_field_index("cell")).to_numpy()] if residual else x) @ r

        n = min(max(nprobe, 1), self.nlist)
        near = lambda q: np.argsort(-scores(Metric.L2, q @ r.T, centroids), axis=1, kind="stable")[:, :n]
        if again and rerank >= self.n:  # every row of the probed cells is on the list: none need meet to be cut

            def both(b: pa.RecordBatch, dim: int) -> np.ndarray:
                return np.concatenate([unpack(b, dim), search.matrix(b.column(b.schema.get_field_index("vec")), dim)], axis=1)

            unit = queries.withColumn("vec", normalized("vec")) if self.metric == Metric.COSINE else queries
            # L2 leaves the queries as they are.
            return search.scan(self.rows, unit, Metric.L2, k, both, near, self.metric, reranked)
        short = search.scan(self.codes, queries, self.metric, min(rerank, self.n) if again else k, unpack, near, Metric.L2)
        if not again:
            return short
        q = queries.select("query_id", (normalized("vec") if self.metric == Metric.COSINE else F.col("vec")).alias("q"))
        pairs = short.select("query_id", "id").join(self.full, "id").join(q, "query_id")
        return search.ranked(pairs.select("query_id", "id", score(self.metric, "q", "vec").alias("score")), self.metric, k)

    def save(self, path: str) -> None:
        meta = {"metric": int(self.metric), "n": self.n, "nlist": self.nlist, "asked": self.asked, "m": self.m, "residual": self.residual, "kept": self.kept}
        files.write(self.rows, path, "ivfpq", meta, {"centroids": self.centroids, "book": self.book, "r": self.r}, by="cell")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfPqIndex:
        meta, arrays, rows = files.read(spark, path, "ivfpq")
        out = cls.__new__(cls)
        for name in ("n", "nlist", "asked", "m", "residual", "kept"):
            setattr(out, name, meta[name])
        out.metric, out.errors, out.told = Metric(meta["metric"]), [], set()
        out.centroids, out.book, out.r = arrays["centroids"], arrays["book"], arrays["r"]
        if out.kept and "vec" not in rows.columns:  # a folder of an earlier version
            rows = rows.join(spark.read.parquet(f"{path}/full"), "id")
        out.rows, out.codes = rows, rows.select("id", "cell", "code")
        out.full = rows.select("id", "vec") if out.kept else None
        return out


def adc_entry(part: np.ndarray, code: np.ndarray) -> np.ndarray:
    """|code|^2 - 2 part.code of each code row: what a sub-vector adds to a squared distance, less |part|^2."""
    return (code * code).sum(axis=-1) - 2 * code @ part


def adc_table(q: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(m, 256): the entries of a query's parts with all codes."""
    sub = book.shape[2]
    return np.stack([adc_entry(q[i * sub : (i + 1) * sub], book[i]) for i in range(len(book))])


def cell_table(centroids: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(cells, m, 256): 2 centroid.code, which residual codes add in their cell."""
    m, _, sub = book.shape
    return 2 * np.einsum("cis,iks->cik", centroids.reshape(len(centroids), m, sub), book)


def adc_distances(q: np.ndarray, codes: np.ndarray, book: np.ndarray, cells: np.ndarray | None = None, centroids: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of a query (rotated) to coded rows by table look-ups; with cells, the codes are residuals."""
    lut, of = adc_table(q, book), np.arange(len(book))
    d = lut[of, codes].sum(axis=1)
    if cells is None:
        return d + q @ q
    near = ((q - centroids) ** 2).sum(axis=1)
    return d + near[cells] + cell_table(centroids, book)[cells[:, None], of, codes].sum(axis=1)
