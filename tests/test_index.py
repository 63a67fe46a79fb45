import logging
import pickle

import numpy as np
import pytest

from vexel import datagen, ivf, search, status
from vexel.flat import FlatIndex
from vexel.graph import GraphIndex
from vexel.ivf import IvfIndex, IvfPqIndex
from vexel.metric import Metric
from vexel.status import Status, VexelError

RNG = np.random.default_rng(21)
X = RNG.normal(size=(600, 16)).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(X)] + [(9999, None)], "id long, vec array<float>")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(X[:7])], "query_id long, vec array<float>")


def rows(df):
    return sorted((r.query_id, r.rank, r.id, round(r.distance, 5)) for r in df.collect())


def brute_cells(centroids, nprobe):
    """Exact search over the rows of probed cells, from whole distances."""
    x = X.astype(float)
    cell = ((x[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    out = []
    for i, q in enumerate(x[:7]):
        probed = np.argsort(((centroids - q) ** 2).sum(axis=1), kind="stable")[:nprobe]
        ids = np.flatnonzero(np.isin(cell, probed))
        d = ((x[ids] - q) ** 2).sum(axis=1)
        out += [(i, r + 1, int(ids[j]), round(float(d[j]), 5)) for r, j in enumerate(np.lexsort((ids, d))[:10])]
    return sorted(out)


@pytest.mark.parametrize("nprobe", [1, 4, 12])
def test_partial_search_equals_brute_force_over_its_cells(table, asked, nprobe):
    index = IvfIndex(table, nlist=12)
    assert index.n == 600 and index.dim() == 16
    got, want = np.array(rows(index.search(asked, 10, nprobe))), np.array(brute_cells(index.centroids, nprobe))
    assert got.shape == want.shape and np.allclose(got, want, atol=2e-5)


def test_search_reads_only_probed_cells(table, asked):
    index = IvfIndex(table, nlist=12)
    plan = index.search(asked.limit(1), 10, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_distributed_kmeans_equals_the_driver(table, monkeypatch):
    full = table.where("vec is not null")
    here = ivf.kmeans(ivf.sample(full, 600), 12)
    assert np.allclose(ivf.kmeans_table(full, 12), here, atol=1e-4)
    monkeypatch.setattr(ivf, "DRIVER_ROWS", 100)
    assert np.allclose(IvfIndex(table, nlist=12, subsample=False).centroids, here, atol=1e-4)
    assert 150 < ivf.sampled(full, 300, 600).count() < 450


def test_tables_give_the_distances_of_decoded_rows(table):
    for residual in (False, True):
        index = IvfPqIndex(table, nlist=5, m=4, residual=residual)
        got = index.codes.orderBy("id").collect()
        codes = np.array([list(r.code) for r in got], np.uint8)
        cells = np.array([r.cell for r in got])
        x = ivf.decode(codes, index.book) + (index.centroids[cells] if residual else 0)
        q = X[3].astype(float)
        d = ivf.adc_distances(q, codes, index.book, cells if residual else None, index.centroids)
        assert np.allclose(d, ((x - q) ** 2).sum(axis=1))
        assert ivf.adc_table(q, index.book).shape == (4, 256)


def test_saved_indexes_answer_alike(spark, table, asked, tmp_path):
    made = {
        "flat": (FlatIndex(table, Metric.COSINE), FlatIndex, {}),
        "ivf": (IvfIndex(table, nlist=9), IvfIndex, {"nprobe": 3}),
        "pq": (IvfPqIndex(table, nlist=9, m=4, opq=False), IvfPqIndex, {"nprobe": 3, "rerank": 50}),
        "graph": (GraphIndex(table, knn_cache=f"file://{tmp_path}/knn"), GraphIndex, {}),
    }
    for name, (index, kind, more) in made.items():
        path = f"file://{tmp_path}/{name}"
        index.save(path)
        assert rows(kind.load(spark, path).search(asked, 5, **more)) == rows(index.search(asked, 5, **more))
        with pytest.raises(VexelError) as e:
            (IvfIndex if kind is not IvfIndex else FlatIndex).load(spark, path)
        assert e.value.code == Status.INTERNAL
    with pytest.raises(VexelError):
        FlatIndex.load(spark, f"file://{tmp_path}/none")
    again = GraphIndex(table, knn_cache=f"file://{tmp_path}/knn")
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, made["graph"][0].edges.collect()))


def test_arguments(spark, table, asked):
    cases = [lambda: FlatIndex(None), lambda: IvfIndex(table, nlist=0), lambda: IvfPqIndex(table, m=5), lambda: IvfPqIndex(table, Metric.INNER_PRODUCT), lambda: status.check_search(asked, 0), lambda: status.check_search(asked, 1, 0), lambda: status.check_search(asked, 1, 1, -1), lambda: status.check_search(None, 1)]
    codes = [1, 2, 2, 2, 2, 2, 2, 1]
    for case, code in zip(cases, codes):
        with pytest.raises(VexelError) as e:
            case()
        assert e.value.code == code and status.status_text(code) in str(e.value)
    assert pickle.loads(pickle.dumps(VexelError(Status.NOT_READY, "x"))).code == 4
    mixed = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [0.0] * 5)], "id long, vec array<double>")
    q = spark.createDataFrame([(1, [0.0] * 4)], "query_id long, vec array<double>")
    with pytest.raises(Exception, match="components"):
        FlatIndex(mixed).search(q).collect()
    empty = table.where("false")
    assert IvfIndex(empty).search(asked).count() == IvfPqIndex(empty).search(asked).count() == 0
    assert status.VERSION and status.MAX_K == 64 and status.status_text(99) == "unknown status"


def test_log_handler_and_one_warning_an_index(table, asked):
    got = []
    status.set_log_handler(lambda level, text: got.append((level, text)))
    try:
        index = FlatIndex(table)
        index.search(asked, 100)
        index.search(asked, 200)
        assert got == [(logging.WARNING, "k=100 is clamped to 1..64")]
        status.set_log_level(logging.ERROR)
        FlatIndex(table).search(asked, 100)
        assert len(got) == 1
    finally:
        status.set_log_handler(None)
        status.set_log_level(logging.WARNING)


def test_small_tiles_change_nothing(table, asked, monkeypatch):
    want = rows(FlatIndex(table).search(asked))
    monkeypatch.setattr(search, "TILE_BYTES", 8)
    monkeypatch.setattr(search, "TILE_ROWS", 7)
    assert rows(FlatIndex(table).search(asked)) == want


def test_clustered_vectors(spark):
    a = datagen.clustered(spark, 500, 6, 8).orderBy("id").collect()
    assert a == datagen.clustered(spark, 500, 6, 8).repartition(7).orderBy("id").collect()
    x = np.array([r.vec for r in a])
    near = np.sort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, 1]
    assert np.median(near) < 0.2 and a != datagen.clustered(spark, 500, 6, 8, part=1).orderBy("id").collect()
