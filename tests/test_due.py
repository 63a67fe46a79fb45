"""The whole query batch, `id % 100 = 0`, against brute force on a table without ids below twenty."""

import numpy as np
import pytest

import __spark_entry__ as entry

IDS = [40 + 10 * i for i in range(300)]
X = np.random.default_rng(4).normal(size=(300, 8)).astype(np.float32)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("due")
    rows = [(i, [float(a) for a in x]) for i, x in zip(IDS, X)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def brute(metric):
    ids, x = np.array(IDS), X.astype(float)
    if metric != "l2":
        x = x * (1 + ids % 5)[:, None]
    if metric == "cosine":
        x = x / np.linalg.norm(x, axis=1)[:, None]
    out = set()
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q]) ** 2).sum(axis=1) if metric == "l2" else -(x @ x[q])
        out |= {(int(ids[q]), r + 1, int(ids[j])) for r, j in enumerate(np.lexsort((ids, d))[:10])}
    return out


METRICS = {"flat_l2_due": "l2", "flat_ip_due": "ip", "flat_cosine_due": "cosine", "flat_l2_sql_due": "l2", "flat_after_add_due": "l2", "ivf_full_probe_due": "l2", "ivfpq_rerank_full_due": "l2", "opq_rerank_full_due": "cosine"}


@pytest.mark.parametrize("name", METRICS)
def test_whole_batch(spark, folder, name):
    got = {(r.query_id, r.rank, r.id) for r in entry.queries()[name](spark, folder).collect()}
    assert got == brute(METRICS[name])


@pytest.mark.parametrize("name", ["ivf_partial", "ivfpq_residual", "graph_search_due"])
def test_every_query_is_asked(spark, folder, name):
    got = entry.queries()[name](spark, folder).collect()
    assert {r.query_id for r in got} == {i for i in IDS if i % 100 == 0}
