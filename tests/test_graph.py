import numpy as np
import pytest

from vexel import graph
from vexel.graph import GraphIndex
from vexel.metric import Metric

X = np.random.default_rng(11).normal(size=(400, 8))


@pytest.fixture(scope="module")
def index(spark):
    v = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(X)] + [(5000, None)], "id long, vec array<double>")
    return GraphIndex(v)


@pytest.mark.parametrize("mode", ["best_first", "beam"])
def test_both_traversals_find_nearly_all(spark, index, mode):
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X[:12] + 0.01)] + [(99, None)], "query_id long, vec array<double>")
    got = {(r.query_id, r.id) for r in index.search(q, 10, mode=mode).collect()}
    want = {(i, int(j) * 3) for i, x in enumerate(X[:12] + 0.01) for j in np.argsort(((X - x) ** 2).sum(axis=1), kind="stable")[:10]}
    assert len(got) == 120 and len(got & want) >= 114


def test_seeds_agree(spark, index):
    q = spark.createDataFrame([(i,) for i in (0, 7, 10**12, -5)], "query_id long")
    got = {(r.query_id, r.id) for r in index._starts(q, 8).collect()}
    entry = index.medoid().first().id
    want = {(i, int(s) * 3) for i in (0, 7, 10**12, -5) for s in graph.seeds(i, 8, 400)} | {(i, entry) for i in (0, 7, 10**12, -5)}
    assert got == want


def test_empty_graph_and_modes(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    q = spark.createDataFrame([(1, [0.0])], "query_id long, vec array<double>")
    assert GraphIndex(none, Metric.INNER_PRODUCT).search(q).count() == 0
    with pytest.raises(ValueError):
        GraphIndex(none).search(q, mode="deep")
