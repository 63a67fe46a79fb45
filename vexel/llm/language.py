"""Operator 6: language identification by error-correcting output codes.

Each language has a binary codeword (exhaustive codes up to five languages, beyond them that of `DRAWS` seeded random codes whose words are furthest apart). For each bit a
classifier of byte three-grams (of lower-cased letter runs, hashed to `BUCKETS`) gives the mean log-odds of the
bit, from counts over all training rows. Decoding picks the language whose codeword has the least logistic loss; the
score is its share under a softmax of the losses, and a text whose two best are close is flagged.

Defined results: a text that is null or has no letter is `und` with score 0; without training rows all are `und`; ties go to
the smaller language name; a null doc_id is never learned from by the query; repeated rows count each; very long texts count whole; an
empty table gives no rows; other columns are not read. The counts of every language stay on the driver, `BUCKETS` numbers each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

BUCKETS, CLOSE, SEED, DRAWS = 1 << 15, 0.2, 7, 16
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the three bytes around each letter byte, and row bounds; what isn't a letter is a space."""
    data, bounds = _text.flat_bytes(pc.utf8_lower(column.fill_null("")))
    padded = np.full(len(data) + 2, 32, np.uint32)
    padded[1:-1] = np.where(_LETTER[data], data, 32)
    before, here, after = padded[:-2].copy(), padded[1:-1], padded[2:].copy()
    full = bounds[:-1][bounds[1:] > bounds[:-1]]
    before[full] = 32
    after[full[1:] - 1] = 32
    h = (before << np.uint32(16)) | (here << np.uint32(8)) | after
    h = ((h * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)
    inside = here != 32
    return h[inside], np.concatenate([[0], np.cumsum(inside)])[bounds]


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """n x bits of 0 and 1; columns are splits of the languages in two non-empty parts."""
    if n < 2:
        return np.zeros((n, 0), np.int64)
    if n <= 5:
        return np.array([[(c >> i) & 1 for c in range(1, 1 << (n - 1))] for i in range(n)], np.int64)
    best, most = None, -1
    for draw in range(DRAWS):
        rng, columns = np.random.default_rng([seed, draw]), []
        while len(columns) < 15 * int(np.ceil(np.log2(n))):
            c = rng.integers(0, 2, n)
            if 0 < c.sum() < n:
                columns.append(c)
        code = np.array(columns).T
        apart = least_distance(code)
        if apart > most:
            best, most = code, apart
    return best


def least_distance(code: np.ndarray) -> int:
    """The fewest bits in which two codewords differ: less than half of it, rounded down, is what decoding can mend."""
    sign = 2 * code - 1
    same = sign @ sign.T
    np.fill_diagonal(same, -code.shape[1])
    return int((code.shape[1] - same.max()) // 2)


def gram_counts(docs: DataFrame) -> list:
    """(lang, bucket, n) over all rows with text and lang: at most BUCKETS rows a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in _text.slices(batches, "text"):
            h, bounds = grams(_text.string_column(part, "text"))
            for lang, a, b in zip(part.column(1).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                t = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                if b - a > BUCKETS:
                    t += np.bincount(h[a:b], minlength=BUCKETS)
                else:
                    np.add.at(t, h[a:b], 1)
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": at, "n": t[at]})

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    return rows.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()


def train(docs: DataFrame) -> dict:
    rows = gram_counts(docs)
    names = sorted({r.lang for r in rows})
    counts = np.zeros((len(names), BUCKETS))
    for r in rows:
        counts[names.index(r.lang), r.bucket] = r.n
    share = (counts + 0.02) / (counts + 0.02).sum(axis=1, keepdims=True)
    code = codewords(len(names))
    weights = [np.log(share[code[:, b] == 1].mean(axis=0) / share[code[:, b] == 0].mean(axis=0)) for b in range(code.shape[1])]
    return {"names": names, "code": code, "weights": np.array(weights, np.float32).reshape(-1, BUCKETS)}


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with lang_pred, score, and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = _text.free("__text", keep)
    source = docs.select(*keep, F.col("text").alias(read))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, code, weights = shared.value["names"], shared.value["code"], shared.value["weights"]
        sign = 2.0 * code - 1
        for part in _text.slices(batches, read, 4 << 20):
            column = _text.string_column(part, read).fill_null("")
            h, bounds = grams(column)
            n = np.diff(bounds)
            seen = np.array(pc.match_substring_regex(column, r"\p{L}").to_pylist(), bool) & bool(names)
            margin = np.zeros((len(n), code.shape[1]))
            full = np.flatnonzero(n)
            for b in range(code.shape[1]):
                if len(full):
                    margin[full, b] = np.add.reduceat(weights[b][h], bounds[:-1][full]) / np.sqrt(n[full])
            if names:
                loss = np.logaddexp(0, -margin[:, None, :] * sign[None]).sum(axis=2)
                p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
                p /= p.sum(axis=1, keepdims=True)
                best = loss.argmin(axis=1)
                score = np.where(seen, p[np.arange(len(p)), best], 0.0)
                second = np.sort(p, axis=1)[:, -2] if len(names) > 1 else np.zeros(len(p))
                close = seen & (score - second < CLOSE)
                pred = [names[i] if s else "und" for i, s in zip(best, seen, strict=True)]
            else:
                score, close, pred = np.zeros(len(n)), np.zeros(len(n), bool), ["und"] * len(n)
            columns = {k: part.column(part.schema.get_field_index(k)) for k in keep}
            yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(pred, pa.string()), "score": score, "ambiguous": close})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in keep)
    return source.mapInArrow(run, fields + ", lang_pred string, score double, ambiguous boolean")
