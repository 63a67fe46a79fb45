"""Operator 1: byte-pair encoding and decoding.

Words of many rows are gathered into one flat symbol array and merged in batched numpy rounds: each
round finds every adjacent pair's rank by binary search over the sorted pair keys, takes each word's
lowest rank, and merges its occurrences from the left; after the first round only the pairs beside a merge are looked up again. Words
already seen by the worker are looked up.

Defined results: null text counts as empty and has no ids; an empty table gives no rows; very long texts and words are
taken whole (a batch holds one such text, a round reads a word once); strings of special tokens in a text
are those tokens; ties between equal pairs go to the left; repeated rows get equal results; columns of
the input other than the text and the kept ones are dropped, so clashing names do no harm.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

#: Blocks with letters added in recent Unicode versions, where libraries may class characters differently.
RECENT = regex.compile(r"[\u0530-\u058f\u0870-\u089f\u0c00-\u0cff\u1c80-\u1c8f\u2080-\u209f\ua7c0-\ua7ff\uab60-\uab6f\U00010000-\U0001efff\U00020000-\U0010ffff]")
#: Words kept in a worker's table before it starts afresh. Bounds memory only.
CACHE_WORDS = 400_000


@lru_cache(4)
def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merger:
    """A merge table with batched encoding of words given as symbol ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        width = np.int64(max(vocab.values(), default=0) + 1)
        keys, made = [], []
        for a, b in merges:
            if a in vocab and b in vocab and a + b in vocab:
                keys.append(vocab[a] * int(width) + vocab[b])
                made.append(vocab[a + b])
        keys = np.array(keys, np.int64)
        order = np.argsort(keys, kind="stable")
        self.width, self.keys, self.ranks = width, keys[order], order.astype(np.int64)
        self.made = np.array(made, np.int64)
        self.none = np.int64(len(keys))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), self.none)
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merge(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of all words on end, and their number in each word."""
        done_symbols: list[np.ndarray] = []
        done_words: list[np.ndarray] = []
        done_lens: list[np.ndarray] = []
        word = np.arange(len(lens))
        symbols, lens = symbols.astype(np.int64), lens.astype(np.int64)
        of = np.repeat(np.arange(len(lens)), lens)
        rank = np.full(len(symbols), self.none)  # of each symbol with the next one of its word
        if len(symbols) > 1:
            same = of[1:] == of[:-1]
            rank[:-1][same] = self.pair_ranks(symbols[:-1][same], symbols[1:][same])
        while len(word):
            begins = np.cumsum(lens) - lens
            lowest = np.full(len(lens), self.none)
            full = lens > 0
            if full.any():
                lowest[full] = np.minimum.reduceat(rank, begins[full])
            stop = lowest >= self.none
            if stop.any():
                keep = ~stop[of]
                done_symbols.append(symbols[~keep])
                done_words.append(word[stop])
                done_lens.append(lens[stop])
                symbols, rank, word, lens, lowest = symbols[keep], rank[keep], word[~stop], lens[~stop], lowest[~stop]
                if not len(word):
                    break
                of = np.repeat(np.arange(len(lens)), lens)
            at = np.flatnonzero(rank == lowest[of])
            # In a run of overlapping hits every second one counts, from the left.
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])
            run = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            at = at[(at - run) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            lens = lens - np.bincount(of[at], minlength=len(lens))
            symbols, rank, of = symbols[kept], rank[kept], of[kept]
            # Only the pairs on either side of a merge have new ranks.
            at = at - np.arange(len(at))
            near = np.concatenate([at, at[at > 0] - 1])
            after = np.minimum(near + 1, len(symbols) - 1)
            same = (near < after) & (of[near] == of[after])
            rank[near[~same]] = self.none
            rank[near[same]] = self.pair_ranks(symbols[near[same]], symbols[after[same]])
        words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        out_lens = np.concatenate(done_lens) if done_lens else np.zeros(0, np.int64)
        flat = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        at, _ = _text.ragged((np.cumsum(out_lens) - out_lens)[order], out_lens[order])
        return flat[at], out_lens[order]


class _Numbers(dict):
    """Numbers of words in order of first sight; `new` holds those seen since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = len(self)
        return len(self) - 1


class WordTable:
    """Ids of words seen so far, in one flat pool."""

    def __init__(self, encode_new):
        self.encode_new = encode_new
        self.clear()

    def clear(self) -> None:
        self.index = _Numbers()
        self.pool, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end, and their number in each word."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            flat, lens = self.encode_new(self.index.new)
            self.index.new = []
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.pool = np.concatenate([self.pool, flat.astype(np.int32)])
        at, _ = _text.ragged(self.starts[which], self.lens[which])
        return self.pool[at], self.lens[which]


class WordBpe:
    """The codec of a tokenizer file of the kind "BPE with word ends": NFC, lower case, a split pattern, byte symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pair = lambda m: tuple(m) if not isinstance(m, str) else tuple(m.split(" "))
        self.merger = Merger(self.vocab, [pair(m) for m in model["merges"]])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.stops = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        alphabet = byte_alphabet()
        self.symbol = np.array([self.vocab.get(c, -1) for c in alphabet], np.int64)
        self.last = np.array([self.vocab.get(c + self.end, -1) for c in alphabet], np.int64)
        token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        raw = [(" " + token.get(i, "")).encode() for i in range(max(token) + 1)]
        self.token_lens = np.array([len(b) for b in raw], np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.path, self.library = path, None
        self.table = WordTable(self._encode_words)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [w.encode() for w in words]
        lens = np.array([len(b) for b in data], np.int64)
        flat = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.symbol[flat]
        ends = np.cumsum(lens) - 1
        symbols[ends] = self.last[flat[ends]]
        known = symbols >= 0  # bytes without a symbol are dropped
        if not known.all():
            lens = np.add.reduceat(known.astype(np.int64), ends - lens + 1)
            symbols = symbols[known]
        return self.merger.merge(symbols, lens)

    def _library_pieces(self, text: str) -> list[str]:
        """The words as the tokenizers library's own Unicode tables part them."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.byte = {c: b for b, c in enumerate(byte_alphabet())}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte[c] for c in w).decode() for w, _ in pieces]

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii() and RECENT.search(text):
            return self._library_pieces(text)
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        # Lower case goes character by character: no final form of sigma.
        return self.pattern.findall((text.replace("Σ", "σ") if "Σ" in text else text).lower())

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token is kept as its id behind a zero character."""
        if self.stops is None or "<|" not in text:
            return self._pieces(text)
        out, at = [], 0
        for m in self.stops.finditer(text):
            out += [*self._pieces(text[at : m.start()]), f"\0{self.special[m.group()]}"]
            at = m.end()
        return out + self._pieces(text[at:])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and the row bounds within them."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                got = self.words(text)
                counts[i] = len(got)
                words += got
        special = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == "\0" and w[1:].isdigit()]
        kept = [int(words[i][1:]) for i in special]
        for i in special:
            words[i] = "a"
        ids, lens = self.table.ids(words)
        if special:
            first = np.cumsum(lens) - lens
            drop = np.ones(len(ids), bool)
            for i, k in zip(special, kept, strict=True):
                drop[first[i] : first[i] + lens[i]] = False
                drop[first[i]] = True
                ids[first[i]] = k
                lens[i] = 1
            ids = ids[drop]
        ends = np.concatenate([[0], np.cumsum(lens)])
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the tokens of each row joined by one space, and the row bounds within them."""
        at, ends = _text.ragged(self.token_starts[ids], self.token_lens[ids])
        data, ends = self.token_bytes[at], ends[bounds]
        full = ends[1:] > ends[:-1]  # the space before a row's first token goes
        keep = np.ones(len(data), bool)
        keep[ends[:-1][full]] = False
        return data[keep], ends - np.concatenate([[0], np.cumsum(full)])


@lru_cache(2)
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """`keep` columns with n_tokens, ids and, if asked, the text decoded from the ids."""
    read = _text.free("__text", keep)
    source = docs.select(*keep, F.col(text).alias(read))
    fields = [*(f for f in source.schema.fields if f.name in keep)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint, ids array<int>" + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for part in _text.slices(batches, read, 2 << 20):
            ids, bounds = bpe.encode(part.column(part.schema.get_field_index(read)).to_pylist())
            columns = {k: part.column(part.schema.get_field_index(k)) for k in keep}
            columns |= {"n_tokens": pa.array(np.diff(bounds)), "ids": _text.list_array(ids, bounds, pa.int32())}
            if decoded:
                columns["decoded"] = _text.string_array(*bpe.decode(ids, bounds)).cast(pa.string())
            yield pa.RecordBatch.from_pydict(columns)
        _text.trim()

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with the text decoded from an array of ids (null: empty)."""
    source = rows.select(*keep, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in keep) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for part in batches:
            lists = part.column(part.schema.get_field_index("__ids"))
            bounds = np.asarray(lists.offsets, np.int64)
            flat = np.asarray(lists.values, np.int64)[bounds[0] : bounds[-1]]
            text = _text.string_array(*bpe.decode(flat, bounds - bounds[0]))
            yield pa.RecordBatch.from_pydict({k: part.column(part.schema.get_field_index(k)) for k in keep} | {"decoded": text.cast(pa.string())})

    return source.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return encoded.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
