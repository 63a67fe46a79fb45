"""A rerank of all rows: by brute force, in little memory and without a table of all pairs."""

import tracemalloc

import numpy as np
import pytest

import __spark_entry__ as entry
from vexel import ivf
from vexel.ivf import IvfPqIndex
from vexel.metric import Metric

RNG = np.random.default_rng(8)
X = np.concatenate([RNG.normal(size=(500, 8)), np.repeat(RNG.normal(size=(1, 8)), 100, axis=0), np.zeros((1, 8)), 1e6 * RNG.normal(size=(3, 8))]).astype(np.float32)
IDS = np.random.default_rng(9).permutation(len(X))
ODD = [(9001, None), (9002, [float("nan")] * 8), (9003, [float("inf")] + [0.0] * 7), (9004, [None] + [1.0] * 7)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(int(i), [float(a) for a in x]) for i, x in zip(IDS, X)] + ODD, "id long, vec array<float>").repartition(3)


def brute(metric, ask):
    x, out = X.astype(float), []
    if metric == Metric.COSINE:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=x.copy(), where=n > 0)
    for q in np.flatnonzero(np.isin(IDS, ask)):
        d = ((x - x[q]) ** 2).sum(axis=1) if metric == Metric.L2 else (x * x[q]).sum(axis=1)
        order = np.lexsort((IDS, np.round(d, 9) if metric == Metric.L2 else -np.round(d, 9)))[:10]
        out += [(int(IDS[q]), r + 1, int(IDS[j])) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("metric", [Metric.L2, Metric.COSINE])
def test_equals_brute_force_and_leaves_few_rows(table, metric, monkeypatch):
    ask = [*IDS[:20].tolist(), *IDS[500:520].tolist(), *IDS[-4:].tolist()]  # with copies, the zero vector and long ones
    q = table.where(table.id.isin([*ask, 9002, 9003])).withColumnRenamed("id", "query_id")
    made = []
    monkeypatch.setattr(ivf.search, "ranked", lambda pairs, *a, f=ivf.search.ranked: made.append(pairs) or f(pairs, *a))
    index = IvfPqIndex(table, metric, nlist=4, m=4, opq=metric == Metric.COSINE)
    got = index.search(q, 10, nprobe=4, rerank=1 << 20)
    assert sorted((r.query_id, r.rank, r.id) for r in got.collect()) == brute(metric, ask)
    # Each batch leaves ten rows a query and cell at most; all pairs are 44 * 607.
    assert len(made) == 1 and made[0].count() <= 44 * 10 * 4 * len(index.rows.inputFiles())


def test_copies_of_an_id_are_not_multiplied(spark):
    rows = [(1, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [4.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vec array<float>")
    q = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, vec array<float>")
    got = IvfPqIndex(v, nlist=2, m=2).search(q, 3, nprobe=2, rerank=100).orderBy("rank").collect()
    assert [(r.id, r.distance) for r in got] == [(1, 0.0), (1, 1.0), (2, 9.0)]


def test_training_takes_little_memory():
    x = np.random.default_rng(1).normal(size=(65_536, 8))
    tracemalloc.start()
    ivf.kmeans(x, 256, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20


def test_bounds_lose_no_row():
    for metric in (Metric.L2, Metric.COSINE):
        q, vec, ids = RNG.normal(size=(30, 6)), RNG.normal(size=(4000, 6)), RNG.permutation(4000)
        for noise in (0.0, 0.01, 1.0):
            i, j, s = ivf.reranked(metric, q, np.concatenate([vec + noise * RNG.normal(size=vec.shape), vec], axis=1), ids, 10)
            want = -((q[:, None] - vec) ** 2).sum(axis=2) if metric == Metric.L2 else q @ vec.T
            assert len(i) == 300 and np.allclose(s, want[i, j])
            assert [set(j[i == a]) for a in range(30)] == [set(np.argsort(-w)[:10]) for w in want]


@pytest.mark.parametrize("name", ["ivfpq_rerank_full_due", "opq_rerank_full_due"])
def test_queries_rank_a_few_rows_of_each_tile(spark, tmp_path, monkeypatch, name):
    rows = [(i, [float(a) for a in RNG.normal(size=8)]) for i in range(2500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    made = []
    monkeypatch.setattr(ivf.search, "ranked", lambda pairs, *a, f=ivf.search.ranked: made.append(pairs) or f(pairs, *a))
    assert entry.queries()[name](spark, str(tmp_path)).count() == 250
    # 25 queries, 8 cells, 10 rows; all pairs are 62,500, once for the list and once for the rerank.
    assert len(made) == 1 and made[0].count() <= 25 * 8 * 10 * 4
