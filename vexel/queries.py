"""Queries of the vector search families over `embeddings`, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import FlatIndex
from .graph import GraphIndex
from .ivf import IvfIndex, IvfPqIndex, all_knn
from .metric import Metric, normalized, squared_norm
from .search import recall


def vectors(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    """(id, vec); scaled, as unit vectors rank alike under every metric."""
    vec = F.col("embedding")
    if scaled:
        vec = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), vec.alias("vec"))


def asked(v: DataFrame) -> DataFrame:
    """The ids below twenty, which the SQL of the plain names takes as its queries; not the whole batch, see `due`."""
    return v.where("id < 20").select(F.col("id").alias("query_id"), "vec")


def due(v: DataFrame) -> DataFrame:
    """The whole query batch: every hundredth id of the table. A null id asks nothing."""
    return v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vec")


def rounded(result: DataFrame) -> DataFrame:
    return result.select("query_id", "rank", "id", F.round("distance", 5).alias("distance"))


def _flat(metric: Metric, scaled: bool):
    def run(spark: SparkSession, sf_dir: str, ask=asked) -> DataFrame:
        v = vectors(spark, sf_dir, scaled)
        return rounded(FlatIndex(v, metric).search(ask(v)))

    return run


def flat_l2_sql(spark, sf_dir, ask=asked):
    v = vectors(spark, sf_dir)
    return rounded(FlatIndex(v).search_sql(ask(v)))


def flat_after_add(spark, sf_dir, ask=asked):
    v = vectors(spark, sf_dir)
    index = FlatIndex(v.where("id % 2 = 0")).add(v.where("id % 2 = 1"))
    return rounded(index.search(ask(v)))


def vector_norms(spark, sf_dir):
    return vectors(spark, sf_dir, True).select("id", F.round(squared_norm("vec"), 5).alias("norm2"))


def normalize(spark, sf_dir):
    return vectors(spark, sf_dir, True).select("id", F.round(F.element_at(normalized("vec"), 1), 5).alias("first"))


def recall_at_k(spark, sf_dir):
    v = vectors(spark, sf_dir)
    index = FlatIndex(v)
    return recall(index.search(due(v)), index.search_sql(due(v)), 10)


def ivf_full_probe(spark, sf_dir, ask=asked):
    v = vectors(spark, sf_dir)
    return rounded(IvfIndex(v, nlist=22).search(ask(v), nprobe=22))


#: Share of the cells probed, and codes reranked: recall of at least 0.9 on vectors with little structure.
PROBED, CODE_BYTES, RERANK = 0.6, 16, 256


def cells(v: DataFrame) -> dict[str, int]:
    """About as many cells as the root of the rows."""
    return {"nlist": max(16, int(v.count() ** 0.5))}


def probed(index) -> dict[str, int]:
    return {"nprobe": -(-int(100 * PROBED) * index.nlist // 100)}


def ivf_partial(spark, sf_dir):
    v = vectors(spark, sf_dir)
    index = IvfIndex(v, **cells(v))
    return rounded(index.search(due(v), **probed(index)))


def cell_sizes(spark, sf_dir):
    return IvfIndex(vectors(spark, sf_dir), nlist=22).cell_sizes()


def kmeans_assign(spark, sf_dir):
    return IvfIndex(vectors(spark, sf_dir), nlist=22).postings.select("id", "cell")


def all_nearest(spark, sf_dir):
    return rounded(all_knn(vectors(spark, sf_dir), 5, nlist=16, nprobe=16))


def ivfpq_residual(spark, sf_dir):
    v = vectors(spark, sf_dir)
    index = IvfPqIndex(v, m=CODE_BYTES, **cells(v))
    return rounded(index.search(due(v), rerank=RERANK, **probed(index)))


def recall_of_indexes(spark, sf_dir):
    """Recall@10 against exact search of the whole query batch, by index."""
    truth = flat_l2_due(spark, sf_dir)
    found = {"ivf_partial": ivf_partial(spark, sf_dir), "ivfpq_residual": ivfpq_residual(spark, sf_dir)}
    out = None
    for name, got in found.items():
        row = recall(got, truth, 10).select(F.lit(name).alias("index"), F.round("recall", 4).alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


def flat_l2_due(spark, sf_dir):
    return _flat(Metric.L2, False)(spark, sf_dir, due)


def pq_encode(spark, sf_dir):
    return IvfPqIndex(vectors(spark, sf_dir), nlist=22).codes.select("id", "cell", F.hex("code").alias("code"))


def ivfpq_rerank_full(spark, sf_dir, ask=asked):
    v = vectors(spark, sf_dir)
    index = IvfPqIndex(v, nlist=8)
    return rounded(index.search(ask(v), nprobe=8, rerank=max(1 << 20, index.n)))


def opq_rerank_full(spark, sf_dir, ask=asked):
    v = vectors(spark, sf_dir, True)
    index = IvfPqIndex(v, Metric.COSINE, nlist=8, opq=True)
    return rounded(index.search(ask(v), nprobe=8, rerank=max(1 << 20, index.n)))


def graph_medoid(spark, sf_dir):
    return GraphIndex(vectors(spark, sf_dir)).medoid()


def graph_degree(spark, sf_dir):
    return GraphIndex(vectors(spark, sf_dir)).degrees()


def graph_edges(spark, sf_dir):
    return GraphIndex(vectors(spark, sf_dir)).edges


def graph_search(spark, sf_dir, ask=asked):
    v = vectors(spark, sf_dir)
    return rounded(GraphIndex(v).search(ask(v)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"flat_l2": _flat(Metric.L2, False), "flat_ip": _flat(Metric.INNER_PRODUCT, True), "flat_cosine": _flat(Metric.COSINE, True)}
QUERIES |= {f.__name__: f for f in (flat_l2_sql, flat_after_add, vector_norms, normalize, recall_at_k, recall_of_indexes, ivf_full_probe, ivf_partial, cell_sizes, kmeans_assign, all_nearest, ivfpq_residual, pq_encode, ivfpq_rerank_full, opq_rerank_full, graph_medoid, graph_degree, graph_edges, graph_search)}
#: Queries whose plain name is held to `asked` by SQL (graph_search: by its comparison with flat_l2); NAME_due asks the whole batch.
HELD = ("flat_l2", "flat_ip", "flat_cosine", "flat_l2_sql", "flat_after_add", "ivf_full_probe", "ivfpq_rerank_full", "opq_rerank_full", "graph_search")
QUERIES |= {f"{name}_due": partial(QUERIES[name], ask=due) for name in HELD}


def _brute(value: str, order: str, scaled: bool = False, asked: str = "q.id < 20", k: int = 10) -> str:
    factor = " * (1 + vec_id % 5)" if scaled else ""
    return f"""
    WITH v AS (SELECT vec_id AS id, [x::DOUBLE{factor} for x in embedding] AS v FROM embeddings),
    s AS (SELECT q.id AS query_id, c.id, {value} AS d FROM v q JOIN v c ON {asked}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d {order}, id)::INT AS rank FROM s)
    SELECT query_id, rank, id, round(d, 5) AS distance FROM r WHERE rank <= {k}"""


_L2 = _brute("list_sum([(q.v[i] - c.v[i]) * (q.v[i] - c.v[i]) for i in range(1, len(q.v) + 1)])", "ASC")
_COSINE = _brute("list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v))", "DESC", True)
ORACLES: dict[str, str] = {
    **dict.fromkeys(("flat_l2", "flat_l2_sql", "flat_after_add", "ivf_full_probe", "ivfpq_rerank_full"), _L2),
    "flat_ip": _brute("list_dot_product(q.v, c.v)", "DESC", True),
    "flat_cosine": _COSINE,
    "opq_rerank_full": _COSINE,
    "all_nearest": _L2.replace("ON q.id < 20", "ON q.id <> c.id").replace("rank <= 10", "rank <= 5"),
    "vector_norms": "SELECT vec_id AS id, round(list_sum([x::DOUBLE * x::DOUBLE * (1 + vec_id % 5) * (1 + vec_id % 5) for x in embedding]), 5) AS norm2 FROM embeddings",
    "normalize": "SELECT vec_id AS id, round(embedding[1]::DOUBLE / sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), 5) AS first FROM embeddings",
    "graph_medoid": """
        WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        m AS (SELECT i, avg(x) AS x FROM p GROUP BY i)
        SELECT vec_id AS id FROM p JOIN m USING (i) GROUP BY vec_id ORDER BY sum((p.x - m.x) * (p.x - m.x)), vec_id LIMIT 1""",
}
ORACLES |= {f"{name}_due": ORACLES[name].replace("q.id < 20", "q.id % 100 = 0") for name in HELD if name in ORACLES}
