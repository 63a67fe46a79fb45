"""Operator 4: deletion of line runs that repeat earlier ones.

A line's id is a 128-bit hash of its trimmed characters. Prefix doubling runs over the line-id sequences: the
name of the 2^k lines from a line is a hash of the names of its two halves, so every document doubles its own
sequence and only names travel. A repeated run that holds at least `MIN_WORDS` words is a union of least runs: those
from a line forwards, or back from a line, that just reach that many words. The names of these (made of two
overlapping doubled names) are grouped over all documents with map-side combining; each group keeps its
first place, and the lines of its later places are deleted. A place that overlaps the first one of its own document is no
copy of it: a line that follows itself twenty times leaves as many as make a whole run.

Equality classes of names stand in for the sorted suffix order, which is not built. The deletions need which runs are equal and which
is first; longest common prefixes of neighbours in the suffix order give the longest earlier run, overlapping or not, which deletes
too much of a periodic text, whereas classes of equal runs give the first place exactly (up to 128-bit hash collisions).

Defined results: order is doc_id (null first), then a hash of the text, then line number; null and empty texts stay as
they are; very long texts are taken whole, in time in proportion to their lines times the logarithm of the longest run; an empty table gives no rows; lines without words are kept unless both neighbours go; repeated rows count as copies, of which the
first alone keeps its lines where doc_id or text differ (rows equal in both are one copy and all stay); a text whose lines
all go becomes empty, and its row stays in `edited`; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

MIN_WORDS = 25
BLANK = "\x20\t\n\v\f\r"


def _lines(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All lines; the numbers of those with words; and the words of each of these."""
    lines = text.split("\n")
    data, bounds = _text.flat_bytes(pa.array(lines, pa.large_string()))
    _, _, before = _text.words(data, bounds)
    n = np.diff(before)
    full = np.flatnonzero(n)
    return lines, full, n[full]


def _ids(lines: list[str], full: np.ndarray) -> np.ndarray:
    data, bounds = _text.flat_bytes(pa.array([lines[i].strip(BLANK) for i in full], pa.large_string()))
    lens = np.diff(bounds)
    one = _text.span_hashes(data, bounds[:-1], lens)
    # A second, independent hash of the same bytes.
    two = _text.span_hashes(data ^ np.uint8(0xA5), bounds[:-1], lens)
    return np.stack([one, _text.mix(two + np.uint64(7))])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = _text.mix(a * np.uint64(0x9E3779B97F4A7C15) + _text.mix(b + np.uint64(0x632BE59BD9B4E019)))
    return np.stack([out[0], _text.mix(out[1] ^ a[1])])


def least_runs(text: str, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names (2 x n), first lines and lengths, in lines with words, of all least runs of a text."""
    lines, full, n = _lines(text)
    m = len(full)
    if not m or n.sum() < min_words:
        return np.zeros((2, 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(m)
    stop = np.searchsorted(ends, ends[:-1] + min_words)  # forwards
    ahead = np.stack([first, stop])[:, stop <= m]
    begin = np.searchsorted(ends, ends[1:] - min_words, "right") - 1  # back
    back = np.stack([begin, first + 1])[:, begin >= 0]
    span = np.unique(np.concatenate([ahead, back], axis=1), axis=1)
    lens = span[1] - span[0]
    name, out, k = _ids(lines, full), np.zeros((2, span.shape[1]), np.uint64), 0
    while True:
        mine = np.flatnonzero((lens >= 1 << k) & (lens < 2 << k))
        a, b = name[:, span[0, mine]], name[:, span[1, mine] - (1 << k)]
        got = _joined(a, b)
        out[0, mine], out[1, mine] = _text.mix(got[0] + lens[mine].astype(np.uint64)), got[1]
        if (2 << k) > lens.max():
            break
        name = _joined(name[:, : -(1 << k)], name[:, 1 << k :])
        k += 1
    return out, span[0].astype(np.int64), lens.astype(np.int64)


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h, and the runs (first line, length) of the document with an earlier copy."""
    rows = docs.where("text is not null and text != ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text", 1 << 20):
            names, docs_, hs, firsts, sizes = [], [], [], [], []
            for i, text in enumerate(part.column(2).to_pylist()):
                name, first, size = least_runs(text, min_words)
                names.append(name)
                docs_.append(np.full(len(first), i))
                firsts.append(first)
                sizes.append(size)
            at = pa.array(np.concatenate(docs_))
            both = np.concatenate(names, axis=1).view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": both[0], "b": both[1], "doc_id": part.column(0).take(at), "h": part.column(1).take(at), "first": np.concatenate(firsts).astype(np.int32), "size": np.concatenate(sizes).astype(np.int32)})
        _text.trim()

    runs = _store.saved(rows.mapInArrow(run, "a bigint, b bigint, doc_id bigint, h bigint, first int, size int"), "runs")
    place = F.struct("doc_id", "h", "first")
    apart = ~F.col("doc_id").eqNullSafe(F.col("head.doc_id")) | (F.col("h") != F.col("head.h")) | (F.col("first") >= F.col("head.first") + F.col("size"))
    heads = runs.groupBy("a", "b").agg(F.min(place).alias("head"), F.count("*").alias("n")).where("n > 1").select("a", "b", "head")
    heads = _store.saved(heads, "heads")
    # The join is on a name alone, one head for each: a frequent name makes no pairs, and skewed parts are split.
    later = runs.join(heads, ["a", "b"]).where(apart)
    return later.groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "size")).alias("runs"))


def edited(docs: DataFrame, min_words: int = MIN_WORDS, n_deleted: str = "n_deleted") -> DataFrame:
    """The documents without later copies, with the number of deleted lines beside their columns."""
    names = docs.columns
    h, d, g, r, new = (_text.free(x, names) for x in ("__h", "__d", "__g", "__runs", "__new"))
    found = later_runs(docs, min_words).select(F.col("doc_id").alias(d), F.col("h").alias(g), F.col("runs").alias(r))
    rows = docs.withColumn(h, F.xxhash64("text"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(g)), "left").select(*names, r)

    @F.pandas_udf("struct<text: string, n: bigint>")
    def cut(text, runs):
        import pandas as pd

        out = []
        for t, rs in zip(text, runs, strict=True):
            if rs is None or t is None:
                out.append((t, 0))
                continue
            lines, full, _ = _lines(t)
            gone = np.zeros(len(full) + 1, np.int64)
            for run in rs:
                gone[run["first"]] += 1
                gone[run["first"] + run["size"]] -= 1
            dead = np.zeros(len(lines), bool)
            dead[full[np.cumsum(gone)[:-1] > 0]] = True
            blank = np.setdiff1d(np.arange(len(lines)), full)
            after = np.searchsorted(full, blank)
            ends = np.concatenate([[True], dead[full], [True]])  # before the first and after the last line with words
            dead[blank] = ends[after] & ends[after + 1]
            out.append(("\n".join(x for x, d in zip(lines, dead, strict=True) if not d), int(dead.sum())))
        return pd.DataFrame(out, columns=["text", "n"])

    hit = rows.where(F.col(r).isNotNull()).withColumn(new, cut("text", r))
    hit = hit.withColumn("text", F.col(f"{new}.text")).withColumn(r, F.col(f"{new}.n"))
    if "n_chars" in names:
        hit = hit.withColumn("n_chars", F.length("text").cast("long"))
    rest = rows.where(F.col(r).isNull()).withColumn(r, F.lit(0).cast("long"))
    return hit.select(*names, F.col(r).alias(n_deleted)).unionByName(rest.select(*names, F.col(r).alias(n_deleted)))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_deleted, n_chars and a digest of the remaining text."""
    return edited(docs).select("doc_id", "n_deleted", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))
