import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vexel.llm import queries, token_files

PATH = queries.tokenizer_path("byte_bpe_50k.json")


def texts(rng):
    kinds = ["abcdefgh ", "aeiouäöüßéèñ  ,.;:!?'s", "'t 're\n\n\t 12 34 _-#$%&", "漢字かな 👍🏽   x", "\x00\x1c\x85 a'll 'd'm", "×÷ÀÿŸ ſ"]
    return ["".join(rng.choice(kind) for _ in range(rng.randrange(0, 120))) for kind in kinds for _ in range(120)] + ["<|endoftext|> a <|endoftext|>", "don't I'LL we've", "a" * 5000]


def test_parts_equal_the_library():
    lib, own = Tokenizer.from_file(PATH), token_files.ByteBpe(PATH)
    rows = texts(random.Random(3))
    ids, bounds = own.encode(rows)
    for i, t in enumerate(rows):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_query_equals_the_library(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i * 7 - 300, t) for i, t in enumerate(texts(rng))] + [(70, f"one of many {j} {'x ' * rng.randrange(40)}") for j in range(400)]
    rows += [(70, None), (None, "null id"), (None, None), (10**15, "long " * 60_000)]
    rng.shuffle(rows)
    d = spark.createDataFrame([(i, t, "e", 1, "p") for i, t in rows], "doc_id long, text string, ids string, part int, h string").repartition(5)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op10_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    lib, start = Tokenizer.from_file(PATH), 0
    want = {}
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), []).append(1)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    for r in got:
        assert r.start == start and want[(r.doc_id, r.n_tokens, r.ids_crc32)].pop()
        start += r.n_tokens
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert token_files.read(spark, token_files.write(whole.where("false"), f"file://{tmp_path}/none", PATH)).count() == 0


@pytest.mark.parametrize("bounds", [[], [5], [3, 3, 3, 9], [-4, 0, 0, 8]])
def test_parts_rise_with_id_and_hash(bounds):
    rng = np.random.default_rng(1)
    ids, h = rng.integers(-10, 12, 3000), rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    part = token_files.part_of(pa.array(ids), pa.array(h), np.array(bounds, np.int64)).to_numpy()
    order = np.lexsort((h, ids))
    assert (np.diff(part[order]) >= 0).all() and part.max() <= len(bounds) and (not bounds or len(set(part)) == len(bounds) + 1)


def test_random_access(spark, tmp_path):
    d = spark.createDataFrame([(i, "some words " * (i % 50)) for i in range(300)], "doc_id long, text string").coalesce(1)
    manifest = token_files.write(d, f"file://{tmp_path}/t", PATH, length=64)
    for m in manifest:
        f = token_files.TokenFile(m["file"])
        flat = np.concatenate(list(f.stream()))
        assert len(flat) == m["n_ids"]
        for i in (0, (m["n_ids"] - 1) // 64):
            ids, mask = f.sequence(i)
            assert ids.base is not None and (ids[mask] == flat[i * 64 : (i + 1) * 64]).all()
