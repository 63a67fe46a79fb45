"""Operator 10: token ids as Arrow files with fixed-size-list batches.

All ids stand in one stream in ascending doc_id order, each document closed by an end id. A file
holds a run of that stream cut into sequences of equal length: `ids fixed_size_list<uint16 or
uint32>[L]` and `mask fixed_size_list<bool>[L]` (false on the padding of a file's last sequence), in the
Arrow IPC file format, so that any batch and any sequence can be mapped without a copy. Beside each lies a
small index file: doc_id, the document's first position in the file, and its number of ids.

A task writes under a name of its own and the manifest names the files of the tasks that counted, so
lost executors and repeated attempts leave no wrong rows.

Defined results: null text counts as empty (one end id); a null doc_id comes first; rows with equal
doc_id are ordered by a hash of their text, repeated rows all stay; a very long text goes on over as many sequences
and batches as it needs; other columns of the input are not read; an
empty table gives no files and no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from .bpe import RECENT, WordTable, byte_alphabet

SEQUENCE = 2048
SEQUENCES_A_BATCH = 64
#: How byte-level vocabularies of this family part a text before merging; and the same for texts of `PLAIN` characters alone.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"[\t-\r -~À-ÖØ-öø-ÿ]*"
PLAIN_PARTS = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


class ByteBpe:
    """The library's encoder, asked once for each distinct part of a text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pattern, self.plain, self.plain_parts = regex.compile(PARTS), re.compile(PLAIN), re.compile(PLAIN_PARTS)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.letters = dict(enumerate(byte_alphabet()))
        self.table = WordTable(self._encode_parts)

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each part by the library's model, which is what it makes of it after the split."""
        model, letters = self.tokenizer.model, self.letters
        got = [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(letters))] for p in parts]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(lens.sum())), lens

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        whole: dict[int, list[int]] = {}
        for i, text in enumerate(texts):
            if not text:
                continue
            plain = self.plain.fullmatch(text) is not None
            if (not plain and RECENT.search(text)) or any(s in text for s in self.special):
                whole[i] = self.tokenizer.encode(text, add_special_tokens=False).ids
                continue
            got = (self.plain_parts if plain else self.pattern).findall(text)
            counts[i] = len(got)
            parts += got
        ids, lens = self.table.ids(parts)
        bounds = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
        if not whole:
            return ids, bounds
        rows = [np.array(whole[i], np.int32) if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


@lru_cache(2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


class Writer:
    """One token file and its index, written batch by batch."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int):
        self.fs, self.folder = filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.dtype, self.length = name, dtype, length
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(f"{self.folder}/{name}.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.index_sink = self.fs.open_output_stream(f"{self.folder}/{name}.docs.arrow")
        self.index = pa.ipc.new_file(self.index_sink, pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())]))
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_docs = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        first = pa.array(self.n_ids + bounds[:-1])
        self.index.write_batch(pa.record_batch([doc_ids, first, pa.array(np.diff(bounds))], schema=pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])))
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.n_docs += len(bounds) - 1
        block = self.length * SEQUENCES_A_BATCH
        if self.n_held >= block:
            flat = np.concatenate(self.held)
            full = len(flat) // block * block
            for at in range(0, full, block):
                self._write(flat[at : at + block], block)
            self.held, self.n_held = [flat[full:]], len(flat) - full

    def _write(self, flat: np.ndarray, valid: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:valid] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        for x in (self.out, self.sink, self.index, self.index_sink):
            x.close()


class TokenFile:
    """Random access to a token file; local files are mapped, not read."""

    def __init__(self, path: str):
        fs, name = filesystem(path)
        self.source = pa.memory_map(name) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)

    def batch(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of batch i, a row for each sequence."""
        b = self.file.get_batch(i)
        ids, mask = b.column(0), b.column(1)
        n = ids.type.list_size
        return ids.flatten().to_numpy().reshape(-1, n), mask.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(i // SEQUENCES_A_BATCH)
        return ids[i % SEQUENCES_A_BATCH], mask[i % SEQUENCES_A_BATCH]

    def stream(self) -> Iterator[np.ndarray]:
        """The ids without padding, a batch at a time."""
        for i in range(self.file.num_record_batches):
            ids, mask = self.batch(i)
            yield ids.ravel()[: int(mask.sum())]


def ranges(ids: DataFrame, each: int = 200) -> np.ndarray:
    """Bounds that cut the doc_ids into about equal parts, as many as the session's shuffles have, from a sample chosen
    by hash (`each` rows a part). An id of many rows is several bounds."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = ids.count()
    some = ids.where("doc_id is not null").withColumn("luck", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 30)))
    got = some.where(F.col("luck") < min(1.0, 2 * each * parts / max(n, 1)) * (1 << 30)).select("doc_id").limit(4 * each * parts).toArrow()
    got = np.sort(got.column(0).to_numpy())
    parts = min(parts, max(1, len(got)))
    return got[(np.arange(1, parts) * len(got)) // parts] if len(got) else np.zeros(0, np.int64)


def part_of(doc_ids: pa.Array, hashes: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The part of each row, rising with (doc_id, hash), null ids first; rows of an id that is several bounds are parted by their hash."""
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    x = doc_ids.fill_null(0).to_numpy()
    low, high = np.searchsorted(bounds, x, "left"), np.searchsorted(bounds, x, "right")
    share = (hashes.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
    part = low + ((share * (high - low + 1).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    return pa.array(np.where(known, np.where(high > low, part, low), 0).astype(np.int32))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, length: int = SEQUENCE, text: str = "text", doc_id: str = "doc_id") -> list[dict]:
    """Write all documents; returns the manifest in stream order: file, start, n_ids, n_docs."""
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("text"))

    bounds_ = ranges(docs.select(F.col(doc_id).cast("bigint").alias("doc_id")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for b in _text.slices(batches, "text", 2 << 20):
            ids, bounds = bpe.encode(b.column(2).to_pylist())
            ids = np.insert(ids, bounds[1:], end_id).astype(bpe.dtype)
            data, at = ids.view(np.uint8), (bounds + np.arange(len(bounds))) * bpe.dtype.itemsize
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "h": b.column(1), "ids": pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary()), "part": part_of(b.column(0), b.column(1), bounds_)})
        _text.trim()

    # The ranges are known beforehand, so that no text is encoded twice to sample them, and only ids are moved.
    rows = source.mapInArrow(encode, "doc_id bigint, h bigint, ids binary, part int")
    rows = rows.repartitionById(len(bounds_) + 1, "part").sortWithinPartitions("doc_id", "h", "ids").select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        dtype, out = codec(tokenizer).dtype, None
        part = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            data, bounds = _text.flat_bytes(b.column(1).cast(pa.large_binary()))
            if out is None:
                out = Writer(folder, f"tokens-{part:06d}-{uuid.uuid4().hex[:12]}", dtype, length)
            out.add(b.column(0), np.ascontiguousarray(data).view(dtype), bounds // dtype.itemsize)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/{out.name}.arrow"], "n_ids": [out.n_ids], "n_docs": [out.n_docs]})

    # A row for each file: their number follows the partitions, not the documents.
    made = rows.mapInArrow(run, "part bigint, file string, n_ids bigint, n_docs bigint").collect()
    manifest, start = [], 0
    for r in sorted(made, key=lambda r: r["part"]):
        manifest.append({"file": r["file"], "start": start, "n_ids": r["n_ids"], "n_docs": r["n_docs"]})
        start += r["n_ids"]
    _swept(folder, manifest)
    return manifest


def _swept(folder: str, manifest: list[dict]) -> None:
    """Delete the files of attempts that didn't count."""
    fs, path = filesystem(folder)
    keep = {m["file"].rsplit("/", 1)[1].removesuffix(".arrow") for m in manifest}
    for f in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):
        if f.base_name.startswith("tokens-") and f.base_name.split(".")[0] not in keep:
            fs.delete_file(f.path)


def documents_of(file: str) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
    """The documents of a file in order: doc_ids, first positions, and each one's ids."""
    stream, held, at = TokenFile(file).stream(), np.zeros(0, np.uint16), 0
    fs, name = filesystem(file.removesuffix(".arrow") + ".docs.arrow")
    with fs.open_input_file(name) as f:
        index = pa.ipc.open_file(f)
        for i in range(index.num_record_batches):
            b = index.get_batch(i)
            first, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            need = int(first[-1] + n[-1]) if len(n) else at
            parts, end = [held], at + len(held)
            while end < need:
                parts.append(next(stream))
                end += len(parts[-1])
            flat = np.concatenate(parts) if len(parts) > 1 else held
            yield b.column(0), first, [flat[a - at : a - at + k] for a, k in zip(first, n, strict=True)]
            held, at = flat[need - at :], need


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, base bigint").repartition(len(manifest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for doc_ids, first, ids in documents_of(file):
                    crc = [zlib.crc32(x.astype("<u4")) for x in ids]
                    yield pa.RecordBatch.from_pydict({"doc_id": doc_ids, "start": pa.array(first + base), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return files.mapInArrow(run, schema)


