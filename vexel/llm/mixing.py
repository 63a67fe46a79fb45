"""Operator 8: mixing sources to target weights.

The words of a source, in order of doc_id, are packed into blocks of fixed length. The places of the output are dealt to the
slots of all sources by a seeded pseudorandom permutation, so that the source counts of a shard are a multinomial draw conditioned on
each source's total, at every size, and any task can draw its own shard. Slot j of a source takes block P(j mod n) of pass j div n, where P
is a Feistel permutation of that source and pass. Blocks and slots are joined by (source, block).

The last slot of a source is cut so that its words equal the rounded target. Defined results: null and empty
texts have size 0 and take nothing; a null source comes last; documents with equal doc_id are ordered by a
hash of their text; repeated rows are each a document (in `mixed`, rows equal in doc_id, text and source share the other columns of one);
very long texts run over as many blocks as they need; reruns agree whatever the partitions; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store, _text

BLOCK = 128
SHARD_SLOTS = 8192
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 42


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words of each source, in source order: shares by weight, capped, the excess dealt again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, free, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        unit = left / sum(w[i] for i in free)
        over = {i for i in free if unit * w[i] > most * sizes[i]}
        for i in over or free:
            out[i] = most * sizes[i] if over else unit * w[i]
        left -= sum(out[i] for i in over)
        free = free - over if over else set()
    return out


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n): a four-round Feistel network with cycle walking."""
    return _walked(x, n, key, False)


def unpermuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    return _walked(x, n, key, True)


def _walked(x: np.ndarray, n: int, key: int, back: bool) -> np.ndarray:
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(3, -1, -1) if back else range(4):
            k = np.uint64((key * 4 + r) % (1 << 63))
            if back:
                left, right = right ^ (_text.mix(left + k) & mask), left
            else:
                left, right = right, left ^ (_text.mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def slots_needed(size: int, target: int, block: int, key: int) -> tuple[int, int]:
    """How many slots give `target` words, and the words of the last one."""
    n, short = -(-size // block), size - (-(-size // block) - 1) * block
    passes, left = divmod(target, size)
    if not left:
        return passes * n, 0 if not passes else int(short if permuted(np.array([n - 1]), n, key + passes - 1)[0] == n - 1 else block)
    # One block alone is short: its slot in this pass is found by the inverse.
    odd = int(unpermuted(np.array([n - 1]), n, key + passes)[0])
    words = lambda q: q * block - (block - short) * (odd < q)
    q = -(-left // block)
    q += words(q) < left
    return passes * n + q, left - words(q - 1)


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and the words of the source before the document, without a task for a whole source."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(_text.WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(F.col("source").asc_nulls_last(), "doc_id", "h").withColumn("part", F.spark_partition_id())
    rows = _store.saved(rows, "sizes")
    # A row for each partition and source in it: about as many as partitions and sources together.
    sums = rows.groupBy("part", "source").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("part").alias("p"), F.col("source").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part", "source").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(sums, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return rows.select("doc_id", "source", "size", "h", (F.col("base") + F.col("inner")).alias("start"))


def plan(sources: list[tuple[str | None, int]], block: int = BLOCK, seed: int = SEED) -> list[dict]:
    """For each source its target, slots and last slot. `sources` has one row for each source, in order."""
    out = []
    for (name, size), t in zip(sources, targets([n for _, n in sources]), strict=True):
        key = zlib.crc32(repr((seed, name)).encode()) << 8
        slots, last = slots_needed(size, min(round(t), int(MOST * size)), block, key) if size and round(t) else (0, 0)
        out.append({"source": name, "size": size, "target": t, "blocks": -(-size // block), "slots": slots, "last": last, "key": key})
    return out


def slots(spark, planned: list[dict], block: int = BLOCK, per: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """All output slots: shard, source number, pass, block, and the words taken from the block's start."""
    ends = np.cumsum([0, *(x["slots"] for x in planned)]).astype(np.int64)
    total = int(ends[-1])
    shards = max(1, -(-total // per))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                slot = permuted(np.arange(shard * per, min((shard + 1) * per, total)), total, seed)
                of = np.searchsorted(ends, slot, "right") - 1
                for s in np.unique(of):
                    x, j = planned[s], slot[of == s] - ends[s]
                    turn, at = j // x["blocks"], j % x["blocks"]
                    got = np.zeros(len(j), np.int64)
                    for t in np.unique(turn):
                        got[turn == t] = permuted(at[turn == t], x["blocks"], x["key"] + int(t))
                    words = np.where(j == x["slots"] - 1, x["last"], block)
                    yield pa.RecordBatch.from_pydict({"shard": np.full(len(j), shard), "s": np.full(len(j), s), "turn": turn, "block": got, "words": words})

    return spark.range(0, shards, 1, max(min(shards, 64), shards // 16)).mapInArrow(run, "shard bigint, s bigint, turn bigint, block bigint, words bigint")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents with size, source_size and target; and the runs taken: doc_id, h, turn, shard, first, n (words)."""
    spark = docs.sparkSession
    at = _store.saved(placed(docs), "placed")
    sizes = [(r.source, r.n) for r in at.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    planned = plan(sorted(sizes, key=lambda x: (x[0] is None, x[0] or "")), block, seed)
    names = spark.createDataFrame([(x["source"], i, x["size"], x["target"]) for i, x in enumerate(planned)], "name string, s bigint, source_size bigint, target double")
    at = at.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    pieces = at.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    # The slots grow with the corpus, though Spark sees only the few shard numbers they come from: no broadcast.
    runs = pieces.join(slots(spark, planned, block, seed=seed).hint("merge"), ["s", "block"])
    low = F.greatest("start", F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    runs = runs.select("doc_id", "h", "start", "turn", "shard", (low - F.col("start")).alias("first"), (high - low).alias("n")).where("n > 0")
    return at, runs


def taken(docs: DataFrame) -> DataFrame:
    at, runs = mix(docs)
    got = runs.groupBy("doc_id", "h", "start").agg(F.sum("n").alias("taken"))
    same = F.col("a.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("a.h") == F.col("g.h")) & (F.col("a.start") == F.col("g.start"))
    return at.alias("a").join(got.alias("g"), same, "left").select("a.doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix: for each document and pass a row with the words that the pass takes."""
    at, runs = mix(docs)
    names = docs.columns
    d, h, r, w, c = (_text.free(x, names) for x in ("__d", "__h", "__runs", "__words", "__s"))
    runs = runs.groupBy("doc_id", "h", "start", "turn").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("runs"))
    own = at.select("doc_id", "h", "start", "source").alias("a")
    same = F.col("a.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("a.h") == F.col("r.h")) & (F.col("a.start") == F.col("r.start"))
    cut = runs.alias("r").join(own, same).select(F.col("r.doc_id").alias(d), F.col("r.h").alias(h), F.col("a.source").alias(c), F.col("r.runs").alias(r))
    found = F.col("x.doc_id").eqNullSafe(F.col(f"t.{d}")) & (F.col(f"x.{h}") == F.col(f"t.{h}")) & F.col("x.source").eqNullSafe(F.col(f"t.{c}"))
    rows = docs.withColumn(h, F.xxhash64("text"))
    twice = at.groupBy("doc_id", "h", "source").agg(F.count("*").alias("n")).where("n > 1")
    twice = _store.saved(twice.select(F.col("doc_id").alias(d), F.col("h").alias(h), F.col("source").alias(c)), "twice").alias("t")
    if twice.limit(1).count():
        # Rows equal in id, text and source are taken one by one by the mix: each of its rows finds one of them here.
        again = rows.alias("x").join(twice, found, "left_semi").dropDuplicates(["doc_id", h, "source"])
        rows = rows.alias("x").join(twice, found, "left_anti").unionByName(again)
    rows = rows.alias("x").join(cut.alias("t"), found).select("x.*", F.col(f"t.{r}"))
    rows = rows.withColumn(w, F.regexp_extract_all("text", F.lit(f"({_text.WORD})"), F.lit(1)))
    text = F.array_join(F.flatten(F.transform(r, lambda x: F.slice(w, (x["first"] + 1).cast("int"), x["n"].cast("int")))), " ")
    rows = rows.withColumn("text", text)
    return (rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else rows).select(*names)
