"""A pipeline over `documents`: toxic rows go, repeated line runs go, one of each near-duplicate group stays, sources
are mixed to target weights, and the mix is encoded. Each stage's rows are written and read by the next.

Defined results: rows with null or empty text pass the first three stages (a null doc_id too) and take no part in the mix; very long texts are
taken whole by every stage; repeated rows are copies, of which one stays; ties go to the smaller doc_id; empty tables give
no rows; other columns, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import _store, _text, bpe, jaccard, line_dedup, mixing, queries, toxicity

THRESHOLD = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    names = tuple(_text.free(n, docs.columns) for n in ("__score", "__near_ids", "__near_sims"))
    return toxicity.score(docs, index, tuple(docs.columns), names).where(F.col(names[0]) < THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.edited(docs, n_deleted=_text.free("__n_deleted", docs.columns)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.kept(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, queries.tokenizer_path("word_bpe_49k.json"))
    return bpe.digests(encoded)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_duplicates", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _store.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
