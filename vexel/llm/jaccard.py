"""Operator 3: similarity join of texts by the Jaccard coefficient of their word five-grams.

Texts with equal shingle sets form one representative. Candidates share a band of a MinHash signature (`BANDS` x `ROWS`: a
pair at 0.8 is missed with probability below 2e-7). Signature values of a candidate pair are compared `STEP` at a time;
after each step the pair is dropped when the posterior probability (uniform prior, binomial likelihood) that its
similarity reaches the threshold falls below `TOLERANCE`. The rest are verified exactly on whole shingle sets.

No pair ever becomes a row. A representative is labelled by the head (least id) that it shares most bands with, so that a
group of near copies has one label. Bands whose members have several labels are compared in blocks, and give only the
pairs of labels that some surviving pair joins; labels so joined are one cluster, which holds both sides of every candidate pair.
Clusters are cut into blocks, each pair of blocks is a group of bounded size for some task, and there the pairs are pruned and
verified as matrices: out come, for each representative, the number of its links and a root of its part. The work inside
a cluster still grows with the square of its different texts, as counting all links exactly must; rows, memory
of a task and what is shuffled don't (a block meets others in copies, one for every `BLOCK_ROWS` texts of its cluster).

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a text of one to four words has one shingle, of all its words; a null,
empty or wordless text is a class of its own without links, as is each row with null doc_id; repeated rows fall in one
class; rows of one doc_id with different texts have a row, a class and links each; class ids and representatives are least doc_ids;
very long texts count whole; shingles are 64-bit hashes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

WIDTH, THRESHOLD, BANDS, ROWS, STEP, TOLERANCE = 5, 0.8, 40, 5, 40, 1e-6
HASHES = BANDS * ROWS
#: Values hashed at a time, texts and bytes of a block, and texts of a tile compared as one matrix.
CHUNK, BLOCK_ROWS, BLOCK_BYTES, TILE = 1 << 15, 2048, 16 << 20, 256
#: Ids sent to all tasks instead of being joined by a shuffle: at most these.
SENT = 500_000


@lru_cache(8)
def _keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, bounds = _text.flat_bytes(column)
    starts, lens, before = _text.words(data, bounds)
    h = _text.span_hashes(data, starts, lens)

    def rolled(w: np.ndarray, n: int) -> np.ndarray:
        s = np.full(max(len(w) - n + 1, 0), n, np.uint64)
        for k in range(n):
            s = _text.mix(s * np.uint64(0x9E3779B97F4A7C15) + w[k : len(s) + k])
        return s

    full = rolled(h, width)  # windows over a text's end are never taken
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        s = full[a : b - width + 1] if b - a >= width else rolled(h[a:b], b - a) if b > a else h[:0]
        s = np.sort(s)
        out.append(s[np.flatnonzero(np.diff(s, prepend=~s[:1]))])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The low halves of `HASHES` least values of each set (not empty) under odd multipliers modulo 2^32."""
    a, b = _keys(HASHES)
    out = np.empty((len(sets), HASHES), np.uint16)
    ends, at = np.cumsum([len(s) for s in sets]), 0
    while at < len(sets):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        x = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        first = np.concatenate([[0], ends[at : to - 1] - done])
        value = np.empty_like(x)
        for i in range(HASHES):
            np.multiply(x, a[i], out=value)
            np.add(value, b[i], out=value)
            out[at:to, i] = np.minimum.reduceat(value, first)
        at = to
    return out


@lru_cache(8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each step the fewest equal values with posterior P(similarity >= threshold) >= tolerance."""
    grid = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            like = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(like - like.max())
            if p[grid >= threshold].sum() / p.sum() >= tolerance:
                break
        out.append(m)
    return tuple(out)


def survivors(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (x[i], y[j]) of signatures keep a posterior above the tolerance at every step."""
    alive, same = np.arange(len(i)), np.zeros(len(i), np.int64)
    for step, least in enumerate(least_matches(threshold)):
        at = slice(step * STEP, (step + 1) * STEP)
        p, q = x[:, at], y[:, at]
        got = [(p[i[alive[a : a + (1 << 17)]]] == q[j[alive[a : a + (1 << 17)]]]).sum(axis=1) for a in range(0, len(alive), 1 << 17)]
        same[alive] += np.concatenate(got) if got else 0
        alive = alive[same[alive] >= least]
    return alive


def common(p: list[np.ndarray], q: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles the pairs (p[i], q[j]) of sets share, exactly."""
    if len(i) < 4 * (len(p) + len(q)):
        return np.array([len(np.intersect1d(p[a], q[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    of = np.repeat(np.arange(len(p) + len(q)), [len(s) for s in (*p, *q)])
    _, column, n = np.unique(np.concatenate([*p, *q]), return_inverse=True, return_counts=True)
    of, column = of[n[column] > 1], (np.cumsum(n > 1) - 1)[column[n[column] > 1]]
    out, wide = np.zeros((len(p), len(q)), np.int64), int((n > 1).sum())
    by = np.argsort(column, kind="stable")
    of, column = of[by], column[by]
    for a in range(0, wide, 4096):
        part = slice(*np.searchsorted(column, [a, a + 4096]))
        m = np.zeros((len(p) + len(q), min(4096, wide - a)), np.float32)
        m[of[part], column[part] - a] = 1
        out += (m[: len(p)] @ m[len(p) :].T).astype(np.int64)
    return out[i, j]


def key(s: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """Two hashes of a set."""
    if not len(s):
        return None, None
    with np.errstate(over="ignore"):
        return int(s.sum().view(np.int64)), int(np.bitwise_xor.reduce(_text.mix(s + np.uint64(3))).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, two hashes of the shingle set (null without words), and the signature."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text", 2 << 20):
            sets = shingle_sets(part.column(2))
            some = [s for s in sets if len(s)]
            sigs = iter(signatures(some) if some else [])
            keys = [key(s) for s in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "h": part.column(1), "k1": pa.array([k for k, _ in keys], pa.int64()), "k2": pa.array([k for _, k in keys], pa.int64()), "sig": pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary())})
        _text.trim()

    return rows.mapInArrow(run, "doc_id bigint, h bigint, k1 bigint, k2 bigint, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _bands(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            sig = _matrix(part.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2])
            for r in range(ROWS):
                h = _text.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            yield pa.RecordBatch.from_pydict({"id": part.column(0).take(pa.array(np.repeat(np.arange(len(sig)), BANDS))), "band": pa.array(h.ravel().view(np.int64))})

    return reps.select("id", "sig").mapInArrow(run, "id bigint, band bigint")


def _blocked(rows: DataFrame, name: str, bytes_) -> DataFrame:
    """Rows (with id and a key `name`) dealt to groups (big, g, i, j) of bounded size: several small keys together, or two blocks i <= j of a big one."""
    sizes = rows.groupBy(name).agg(F.count("*").alias("n"), F.sum(bytes_).alias("m"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("m") / BLOCK_BYTES)).cast("int")).where("n > 1")
    sizes = _store.saved(sizes, "sizes")
    total = sizes.where("blocks = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    bins = max(1, -(-int(total.n) // BLOCK_ROWS), -(-int(total.m) // (BLOCK_BYTES // 2)))
    dealt = rows.join(sizes.select(name, "blocks"), name)
    small = dealt.where("blocks = 1").select(*rows.columns, F.lit(False).alias("big"), F.pmod(F.xxhash64(name), F.lit(bins)).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"))
    if not sizes.where("blocks > 1").limit(1).count():
        return small
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    big = dealt.where("blocks > 1").withColumn("block", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return small.unionByName(big.select(*rows.columns, F.lit(True).alias("big"), F.col(name).alias("g"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block"))


def _sides(table: pa.Table, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """For each key of a group its rows on the left and on the right, and whether both are the same."""
    keys, block = table[name].to_numpy(), table["block"].to_numpy()
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    if i != j:
        yield int(keys[0]), np.flatnonzero(block == i), np.flatnonzero(block == j), False
        return
    by = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.diff(keys[by], prepend=~keys[by[:1]]))
    for at in np.split(by, cut[1:]):
        yield int(keys[at[0]]), at, at, True


def _tiles(left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    for a in range(0, len(left), TILE):
        for b in range(a if same else 0, len(right), TILE):
            yield left[a : a + TILE], right[b : b + TILE], same and a == b


def _pairs(p: np.ndarray, q: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    if same:
        return np.triu_indices(len(p), 1)
    return np.repeat(np.arange(len(p)), len(q)), np.tile(np.arange(len(q)), len(p))


def _joined_labels(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of labels (a < b) that some surviving pair of rows (band, id, label, sig) joins."""

    def run(table: pa.Table) -> pa.Table:
        sig, label = _matrix(table["sig"]), table["label"].to_numpy()
        out = []
        for _, left, right, same in _sides(table, "band"):
            for p, q, own in _tiles(left, right, same):
                i, j = _pairs(p, q, own)
                other = label[p[i]] != label[q[j]]
                i, j = p[i[other]], q[j[other]]
                alive = survivors(sig, sig, i, j, threshold)
                if len(alive):
                    both = np.sort(np.stack([label[i[alive]], label[j[alive]]], axis=1), axis=1)
                    out.append(np.unique(both, axis=0))
        got = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": got[:, 0], "b": got[:, 1]})

    dealt = _blocked(rows, "band", F.lit(2 * HASHES))
    return dealt.groupBy("big", "g", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """For rows (c, id, sig, set): id, its links found in a group, and the least id of its part there."""

    def run(table: pa.Table) -> pa.Table:
        sig, ids = _matrix(table["sig"]), table["id"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table["set"].to_pylist()]
        size = np.array([len(s) for s in sets])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _, left, right, same in _sides(table, "c"):
            for p, q, own in _tiles(left, right, same):
                i, j = _pairs(p, q, own)
                alive = survivors(sig[p], sig[q], i, j, threshold)
                i, j = i[alive], j[alive]
                if not len(i):
                    continue
                both = common([sets[x] for x in p], [sets[x] for x in q], i, j)
                good = both / (size[p[i]] + size[q[j]] - both) >= threshold
                if good.any():
                    out.append(_part(ids[p], ids[q], i[good], j[good]))
        if not out:
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        a, n, root = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"id": a, "n": n, "root": root})

    dealt = _blocked(rows, "c", F.octet_length("set") + 2 * HASHES)
    return dealt.groupBy("big", "g", "i", "j").applyInArrow(run, "id bigint, n bigint, root bigint")


def _part(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of linked pairs (p[i], q[j]): the ids that have a link, their links, and the least id of each one's part."""
    ids, at = np.unique(np.concatenate([p[i], q[j]]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    root = np.arange(len(ids))
    while True:
        low, now = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == root).all():
            return ids, np.bincount(at, minlength=len(ids)), ids[root]
        root = now


def _chosen(docs: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
    """The rows of `docs` whose `names` are in `wanted`: sent to all tasks while they are at most `SENT`, else joined by a shuffle."""
    few = wanted.limit(SENT + 1).count() <= SENT
    return docs.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), names, "left_semi")


def links(docs: DataFrame, sk: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Representatives (id, k1, k2, low: least doc_id), and for those with links: id, n_links, least id of the component."""
    full = sk.where("sig is not null and doc_id is not null")
    reps = full.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "h")).alias("low"), F.first("sig").alias("sig"))
    reps = _store.saved(reps.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", F.col("low.doc_id").alias("low"), F.col("low.h").alias("h"), "sig"), "reps")
    bands = _bands(reps)
    # Bands of one member can give no pair and are left out before anything else.
    heads = bands.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head")
    busy = _store.saved(bands.join(heads, "band"), "busy")
    labels = busy.groupBy("id", "head").agg(F.count("*").alias("n")).groupBy("id").agg(F.max(F.struct("n", (-F.col("head")).alias("m"))).alias("best"))
    labels = _store.saved(labels.select("id", (-F.col("best.m")).alias("label")), "labels")
    marked = _store.saved(busy.select("band", "id").join(labels, "id"), "marked")
    _store.dropped(busy)
    mixed = marked.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("band")
    signed = reps.select("id", "sig")
    joined = _store.saved(_joined_labels(_store.saved(marked.join(mixed, "band").join(signed, "id"), "mixed"), threshold), "joined")
    group = components(joined).select(F.col("id").alias("label"), F.col("least").alias("c"))
    clusters = labels.join(group, "label", "left").select("id", F.coalesce("c", "label").alias("c"))
    several = clusters.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    clusters = _store.saved(clusters.join(several, "c"), "clusters")

    asked = reps.join(clusters, "id").select(F.col("low").alias("doc_id"), "h").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    texts = _chosen(texts, _store.saved(asked, "asked"), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("text").alias("text")).select("text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text", 2 << 20):
            sets = shingle_sets(part.column(0))
            keys = [key(s) for s in sets]
            yield pa.RecordBatch.from_pydict({"k1": pa.array([k for k, _ in keys], pa.int64()), "k2": pa.array([k for _, k in keys], pa.int64()), "set": pa.array([s.tobytes() for s in sets], pa.binary())})

    sets = texts.mapInArrow(to_sets, "k1 bigint, k2 bigint, set binary")
    rows = sets.join(reps.join(clusters, "id").select("id", "k1", "k2", "sig", "c"), ["k1", "k2"]).select("c", "id", "sig", "set")
    rows = _store.saved(rows, "sets")
    found = _store.saved(_verified(rows, threshold), "links")
    _store.dropped(rows)
    least = components(found.where("id != root").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct())
    degree = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    return reps.drop("sig", "h"), degree.join(least, "id")


def components(edges: DataFrame) -> DataFrame:
    """id and the least id of its component, by alternating large-star and small-star rounds."""
    e = edges.select("a", "b")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        large = _store.saved(large, "large")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("m"), F.explode(F.array("a", "b")).alias("b")).where("m != b").select(F.col("m").alias("a"), "b").distinct()
        e = _store.saved(small, "small")
        now = e.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            ends = e.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("least"))
            return e.select(F.col("b").alias("id"), F.col("a").alias("least")).unionByName(ends)
        seen = now


def _classed(docs: DataFrame) -> DataFrame:
    """doc_id, h, class_id, rep and n_links of each row; saved."""
    sk = _store.saved(sketches(docs), "sketches")
    reps, near = links(docs, sk)
    near = _store.saved(near, "near")
    low = near.join(reps.select("id", "low"), "id").groupBy("least").agg(F.min("low").alias("class_low"))
    named = reps.join(near.join(low, "least"), "id", "left").select("k1", "k2", "low", F.coalesce("class_low", "low").alias("class_low"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("least", "id").alias("class"))
    own = sk.where("doc_id is not null").select("doc_id", "h", "k1", "k2").join(named, ["k1", "k2"], "left")
    own = own.select("doc_id", "h", F.coalesce("class_low", "doc_id").alias("class_id"), F.coalesce("low", "doc_id").alias("rep"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "class")
    none = F.lit(None).cast("bigint")
    return own.unionByName(sk.where("doc_id is null").select("doc_id", "h", none.alias("class_id"), none.alias("rep"), F.lit(0).cast("bigint").alias("n_links"), none.alias("class")))


def classes(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, class_id (least doc_id of its group), rep, and n_links of its text."""
    return _classed(docs).select("doc_id", "class_id", "rep", "n_links")


def kept(docs: DataFrame) -> DataFrame:
    """One document of each group: the least by doc_id, then by a hash of its text. Rows with null doc_id or without words all stay."""
    rows = _store.saved(_classed(docs).select("doc_id", "h", "class"), "classed")
    first = rows.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    first = first.select("first.*").unionByName(rows.where("class is null and doc_id is not null").select("doc_id", "h")).distinct()
    names = docs.columns
    h, d = _text.free("__h", names), _text.free("__d", names)
    first = first.select(F.col("doc_id").alias(d), F.col("h").alias(h))
    held = docs.where("doc_id is not null").withColumn(d, F.col("doc_id").cast("long")).withColumn(h, F.xxhash64("text"))
    out = held.join(first, [d, h], "left_semi")
    # Only rows that are equal in both are told apart by nothing: one of them stays.
    twice = rows.where("class is not null").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(d), F.col("h").alias(h))
    twice = _store.saved(twice, "twice")
    if twice.limit(1).count():
        again = out.join(twice, [d, h], "left_semi").dropDuplicates([d, h])
        out = out.join(twice, [d, h], "left_anti").unionByName(again)
    return out.select(*names).unionByName(docs.where("doc_id is null"))
