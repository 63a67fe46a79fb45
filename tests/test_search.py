import duckdb
import pytest

import __spark_entry__ as entry
from vexel.flat import FlatIndex
from vexel.metric import Metric
from vexel.search import padded

SF = "/root/testdata/sf0.01"
ORACLES = {k: v for k, v in entry.search_queries.ORACLES.items()}


@pytest.mark.parametrize("name", ORACLES)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = entry.search_queries.QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a = sorted(tuple(r[c] for c in columns) for r in got.collect())
    b = sorted(tuple(dict(zip(want.columns, r))[c] for c in columns) for r in want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=1.1e-5)


def test_recall_is_whole(spark):
    assert entry.search_queries.QUERIES["recall_at_k"](spark, SF).first().recall == 1.0


def test_graph_finds_nearly_all(spark):
    q = entry.search_queries.QUERIES
    a = {(r.query_id, r.id) for r in q["graph_search"](spark, SF).collect()}
    b = {(r.query_id, r.id) for r in q["flat_l2"](spark, SF).collect()}
    assert len(a & b) >= 0.95 * len(b)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [nan, 0.0]), (5, [inf, 0.0])]
    db = spark.createDataFrame(rows, "id long, vec array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vec array<double>")
    got = [(r.rank, r.id, r.distance) for r in FlatIndex(db).search(q, 5).orderBy("rank").collect()]
    assert got == [(1, 2, 0.0), (2, 3, 0.0), (3, 1, 1.0)]
    assert padded(FlatIndex(db).search(q, 5), q, Metric.L2, 5).first().ids == [2, 3, 1, -1, -1]
    zero = FlatIndex(db.where("id < 3"), Metric.COSINE).search(q, 2).orderBy("rank").collect()
    assert [(r.id, r.distance) for r in zero] == [(2, 1.0), (1, 0.0)]
    assert FlatIndex(db).reset().search(q).count() == 0
