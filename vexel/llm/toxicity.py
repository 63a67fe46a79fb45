"""Operator 2: toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are lower-cased runs of letters (all characters beyond ASCII count as letters) and their first `PREFIXES` bytes (beginnings stand for
the forms of one stem), told apart by 64-bit hashes. A
bounded sample of labelled rows (`EXAMPLES`, half of each label where there are as many, by hash of doc_id and text) is the
index, each example with its whole vocabulary. Votes weigh an example by how many labelled rows of its label it stands for. A term weighs (1 + log tf) x idf x relevance: the idf counts all
documents; the relevance, between `LEAST` and 1, is a supervised term weight, the likelihood ratio of term and label in
the sample, so that words without bearing on the label count little beside those with one.

Postings lie in blocks of `BLOCK` examples, each term's entry of a block with its largest weight. A text's bound for a block is
the sum of its weights times these maxima; blocks are read by falling bound, until none can reach the k-th similarity: the
neighbours are exact. Similarities weigh the votes; a logistic curve fitted on leave-one-out votes of `CALIBRATE`
examples (a hash sample) calibrates them.

Defined results: null and empty texts, and texts without a known term, get the share of toxic
rows among the labelled ones; ties of similarity (to six places) go to the smaller doc_id, then the earlier hash of the text; without labels of both kinds all scores are the
share of toxic labels (0 if none); conflicting labels of one doc_id count by the largest; repeated rows are one example;
rows with null doc_id are scored but never examples; very long texts count whole; an empty table gives no rows;
other columns are not read, and kept columns that clash with the results' names are told apart by `names`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

EXAMPLES, CALIBRATE, BLOCK, NEAREST = 2048, 2048, 64, 15
PREFIXES = (4,)
#: Relevance of a term: LEAST + the likelihood ratio beyond CHANCE, in units of SURE, at most 1.
LEAST, CHANCE, SURE = 0.02, 10.0, 40.0
#: Blocks read before the first look at the bound; each round reads twice as many.
FIRST = 4
#: Terms of at least this share of the examples have a dense row instead of postings.
OFTEN = 0.015
#: Texts whose products with the dense rows are made together.
TOGETHER = 64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all terms of the texts, and the row of each."""
    data, bounds = _text.flat_bytes(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    starts, ends = _text.runs(_LETTER[data], bounds)
    lens, row = ends - starts, np.searchsorted(bounds, starts, "right") - 1
    out, rows = [_text.span_hashes(data, starts, lens)], [row]
    for n in PREFIXES:
        some = lens >= n
        begun = _text.span_hashes(data, starts[some], np.full(int(some.sum()), n))
        out.append(_text.mix(begun + np.uint64(n)))
        rows.append(row[some])
    return np.concatenate(out), np.concatenate(rows)


class Vocabulary:
    """Known terms, by the order of their hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """row x size + number of each known term of each text, ascending, and how often it occurs there."""
        h, row = terms(column)
        if not len(self.keys) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[at] == h
        return np.unique(row[known] * len(self.keys) + at[known], return_counts=True)

    def counts(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """The known terms of each text, ascending, and how often they occur."""
        key, n = self.numbers(column)
        cut = np.searchsorted(key, np.arange(len(column) + 1) * len(self.keys))
        return [(key[a:b] - i * len(self.keys), n[a:b]) for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))]


class Index:
    def __init__(self, keys: np.ndarray, idf: np.ndarray, relevance: np.ndarray, ids: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float):
        self.vocabulary, self.weight, self.prior, n = Vocabulary(keys), idf * relevance, prior, len(rows)
        share = float(labels.mean()) if n else 0.0
        #: Labelled rows that an example of each label stands for, relative to the mean.
        self.stands = np.array([(1 - prior) / (1 - share), prior / share]) if 0 < share < 1 else np.ones(2)
        vectors = [self.vector(*r) for r in rows]
        # Examples with the same weightiest term stand together, which tightens the bounds.
        top = np.array([int(t[w.argmax()]) if len(t) else -1 for t, w in vectors], np.int64)
        order = np.lexsort((np.arange(n), top))
        self.ids, self.labels = np.asarray(ids, np.int64)[order], np.asarray(labels, np.float64)[order]
        self.place = np.empty(n, np.int64)  # of the examples as given
        self.place[order] = np.arange(n)
        self.blocks = -(-max(n, 1) // BLOCK)
        term = np.concatenate([np.zeros(0, np.int64), *(vectors[i][0] for i in order)])
        weight = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        at = np.repeat(np.arange(n), [len(vectors[i][0]) for i in order])
        by = np.argsort(term, kind="stable")
        # Terms of many examples have a dense row, the others postings.
        often = np.bincount(term, minlength=len(keys)) >= max(n * OFTEN, 1)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), self.blocks * BLOCK), np.float32)
        mine = often[term]
        self.dense[self.row[term[mine]], at[mine]] = weight[mine]
        by = by[~often[term[by]]]
        self.at, self.w = at[by].astype(np.int32), weight[by].astype(np.float32)
        block = term[by] * self.blocks + at[by] // BLOCK
        entry, self.start = np.unique(block, return_index=True)
        self.size = np.diff(np.append(self.start, len(block)))
        self.block = (entry % self.blocks).astype(np.int16 if self.blocks < 1 << 15 else np.int64)
        self.most = np.maximum.reduceat(self.w, self.start) if len(block) else np.zeros(0)
        self.first = np.searchsorted(entry // self.blocks, np.arange(len(keys) + 1))
        self.a, self.b = 1.0, 0.0

    def vector(self, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.weight[t]
        return t, w / np.sqrt((w * w).sum()) if len(t) else w

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEAREST, without: int = -1, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and places of the k most similar examples, exact; `without` is left out."""
        row = self.row[t]
        if common is None:
            common = self.products([(t, w)])[0]
        t, w = t[row < 0], w[row < 0]
        entry, ends = _text.ragged(self.first[t], self.first[t + 1] - self.first[t])
        mine = np.repeat(w, np.diff(ends))
        block = self.block[entry]
        bound = np.bincount(block, mine * self.most[entry], minlength=self.blocks) + common.reshape(-1, BLOCK).max(axis=1)
        order = np.argsort(-bound, kind="stable")
        rank = np.empty(self.blocks, np.int16 if self.blocks < 1 << 15 else np.int64)
        rank[order] = np.arange(self.blocks)
        by = np.argsort(rank[block], kind="stable")
        entry, mine = entry[by], mine[by]
        cut = np.searchsorted(rank[block[by]], np.arange(self.blocks + 1))
        sims, places, at, step, least = np.zeros(0), np.zeros(0, np.int64), 0, FIRST, 0.0
        while at < self.blocks and bound[order[at]] > 0 and bound[order[at]] + 1e-6 >= least:
            part = slice(cut[at], cut[min(at + step, self.blocks)])
            size = self.size[entry[part]]
            post, _ = _text.ragged(self.start[entry[part]], size)
            s = common + np.bincount(self.at[post], np.repeat(mine[part], size) * self.w[post], minlength=len(common))
            new = (order[at : at + step, None] * BLOCK + np.arange(BLOCK)).ravel()
            s = np.round(s[new], 6)
            good = (s > 0) & (s >= least) & (new != without)
            sims, places = np.concatenate([sims, s[good]]), np.concatenate([places, new[good]])
            if len(sims) >= k:
                least = np.partition(sims, len(sims) - k)[len(sims) - k]
                good = sims >= least
                sims, places = sims[good], places[good]
            at, step = at + step, step * 2
        best = np.lexsort((places, self.ids[places], -sims))[:k]
        return sims[best], places[best]

    def products(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the terms with dense rows add to the similarities of each vector with all examples."""
        q = np.zeros((len(vectors), len(self.dense)), np.float32)
        for i, (t, w) in enumerate(vectors):
            row = self.row[t]
            q[i, row[row >= 0]] = w[row >= 0]
        return q @ self.dense

    def vote(self, sims: np.ndarray, places: np.ndarray) -> float:
        w = self.stands[self.labels[places].astype(int)] / (1.05 - sims)
        return float((w * self.labels[places]).sum() + self.prior) / float(w.sum() + 1)

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Fit the curve on votes of the first examples given, each without itself."""
        x, y, c = [], [], []
        for j, r in enumerate(rows):
            if len(r[0]):
                found = self.nearest(*self.vector(*r), without=self.place[j])
                if len(found[0]):
                    x.append(self._logit(self.vote(*found)))
                    y.append(self.labels[self.place[j]])
                    c.append(self.stands[int(y[-1])])
        x, y, c = np.array(x), np.array(y), np.array(c)
        if len(set(y.tolist())) < 2:
            return
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps with a small pull to (1, 0)
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([(c * (p - y) * x).sum() + (a - 1), (c * (p - y)).sum() + b])
            v = c * p * (1 - p)
            h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
        if np.isfinite([a, b]).all() and a > 0:
            self.a, self.b = float(a), float(b)

    @staticmethod
    def _logit(p: float) -> float:
        p = min(max(p, 1e-4), 1 - 1e-4)
        return float(np.log(p / (1 - p)))

    def score(self, column: pa.Array) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text the score, and the neighbours' similarities and places."""
        out = []
        for a in range(0, len(column), TOGETHER):
            vectors = [self.vector(*c) for c in self.vocabulary.counts(column.slice(a, TOGETHER))]
            for (t, w), common in zip(vectors, self.products(vectors), strict=True):
                sims, places = self.nearest(t, w, common=common) if len(t) else (np.zeros(0), np.zeros(0, np.int64))
                p = self.prior
                if len(sims):
                    p = 1 / (1 + float(np.exp(-(self.a * self._logit(self.vote(sims, places)) + self.b))))
                out.append((p, sims, places))
        return out


def relevance(n: np.ndarray, x: np.ndarray, rows: int, toxic: int) -> np.ndarray:
    """Of terms in n rows, x of them toxic."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-9) / expected)

    share = toxic / rows
    ratio = part(x, n * share) + part(n - x, n * (1 - share))
    rest, bad = rows - n, toxic - x
    some = rest > 0
    ratio[some] += (part(bad, np.maximum(rest * share, 1e-9)) + part(rest - bad, np.maximum(rest * (1 - share), 1e-9)))[some]
    return LEAST + (1 - LEAST) * np.clip((2 * ratio - CHANCE) / SURE, 0, 1)


def fitted(ids: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, frequency, documents: int, calibrate: int = CALIBRATE) -> Index:
    """An index of examples in hash order, given as terms and counts. `frequency` gives the documents that hold each of a list of terms."""
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in texts)]))
    rows = []
    for h, n in texts:
        t = np.searchsorted(keys, h)
        by = np.argsort(t)
        rows.append((t[by], n[by]))
    held = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in rows)])
    bad = np.repeat(labels, [len(t) for t, _ in rows])
    n, x = np.bincount(held, minlength=len(keys)), np.bincount(held, bad, minlength=len(keys))
    idf = np.log((1 + documents) / (1 + frequency(keys))) + 1
    index = Index(keys, idf, relevance(n.astype(float), x, len(ids), int(labels.sum())), ids, rows, labels, prior)
    index.calibrate(rows[:calibrate])
    return index


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """Learn from the rows of `docs` with a label whose crc32 of doc_id mod 3 is not 1."""
    spark = docs.sparkSession
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # The sample is chosen by ids and hashes alone, so that no whole text travels for it.
    marked = rows.select("doc_id", "h").join(marks, "doc_id").distinct()
    sizes = {int(bool(r.toxic)): r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, bad = sizes.get(0, 0), sizes.get(1, 0)
    prior = bad / max(clean + bad, 1)
    if not clean or not bad:
        return Index(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), [], np.zeros(0), prior)
    most = max(examples // 2, examples - bad), max(examples // 2, examples - clean)
    order = F.xxhash64("doc_id", "h"), "doc_id", "h"
    parts = [marked.where(F.col("toxic") == y).orderBy(*order).limit(most[y]) for y in (0, 1)]
    got = parts[0].unionByName(parts[1]).orderBy(*order).collect()
    y = np.array([r.toxic for r in got], np.float64)
    chosen = spark.createDataFrame([(r.doc_id, r.h) for r in got], "doc_id bigint, h bigint")
    texts = rows.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text", 1 << 20):
            h, row = terms(part.column(2))
            by = np.lexsort((h, row))
            first = np.flatnonzero((np.diff(row[by], prepend=-1) != 0) | (np.diff(h[by], prepend=h[by[:1]]) != 0))
            cut = np.searchsorted(row[by][first], np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "h": part.column(1), "terms": _text.list_array(h[by][first].view(np.int64), cut, pa.int64()), "n": _text.list_array(np.diff(first, append=len(by)).astype(np.int32), cut, pa.int32())})

    made = texts.mapInArrow(count, "doc_id bigint, h bigint, terms array<bigint>, n array<int>").toArrow()
    counted = {(d.as_py(), h.as_py()): (t.values.to_numpy().view(np.uint64), n.values.to_numpy()) for d, h, t, n in zip(*made.columns, strict=True)}

    def frequency(keys: np.ndarray) -> np.ndarray:
        """Over all documents: each task adds up its own, and sends one row a term at most."""
        shared = spark.sparkContext.broadcast(keys)  # of the sample alone: bounded

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Vocabulary(shared.value)
            sums = np.zeros(len(known.keys), np.int64)
            for part in _text.slices(batches, "text", 1 << 20):
                sums += np.bincount(known.numbers(part.column(0))[0] % max(len(sums), 1), minlength=len(sums))
            some = np.flatnonzero(sums)
            for a in range(0, len(some), 50_000):
                yield pa.RecordBatch.from_pydict({"t": some[a : a + 50_000], "n": sums[some[a : a + 50_000]]})
            _text.trim()

        sums = rows.select("text").mapInArrow(add, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(len(keys))
        out[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
        return out

    return fitted(np.array([r.doc_id for r in got]), [counted[r.doc_id, r.h] for r in got], y, prior, frequency, docs.count())


def score(docs: DataFrame, index: Index, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("score", "near_ids", "near_sims")) -> DataFrame:
    """`keep` columns with score, and the neighbours' doc_ids and similarities as evidence."""
    read = "text" if "text" in keep else _text.free("__text", keep)  # a text passes once
    source = docs.select(*keep) if read == "text" else docs.select(*keep, F.col("text").alias(read))
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for part in _text.slices(batches, read, 2 << 20):
            got = ix.score(part.column(part.schema.get_field_index(read)))
            columns = {k: part.column(part.schema.get_field_index(k)) for k in keep}
            columns[names[0]] = pa.array([s for s, _, _ in got], pa.float64())
            columns[names[1]] = pa.array([ix.ids[p] for _, _, p in got], pa.list_(pa.int64()))
            columns[names[2]] = pa.array([s for _, s, _ in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(columns)
        _text.trim()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in keep) + f", `{names[0]}` double, `{names[1]}` array<bigint>, `{names[2]}` array<double>"
    return source.mapInArrow(run, schema)
