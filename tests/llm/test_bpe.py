import random
import time

import pytest
from tokenizers import Tokenizer

from vexel.llm import bpe, queries

PATH = queries.tokenizer_path("word_bpe_49k.json")


def test_merging_equals_library_on_random_words():
    rng = random.Random(8)
    lib, own = Tokenizer.from_file(PATH), bpe.WordBpe(PATH)
    texts = ["".join(rng.choice("aabbcdeeinorst") for _ in range(rng.randrange(1, 60))) for _ in range(800)]
    texts += ["a" * n for n in range(1, 60)] + ["ab" * n for n in range(1, 40)] + ["aab" * 500, "x" * 5000, "é" * 700, "naïve" * 90]
    ids, bounds = own.encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_long_words_are_not_read_again_and_again():
    rng = random.Random(9)
    own = bpe.WordBpe(PATH)
    t = time.time()
    own.encode(["".join(rng.choice("aeinorstdl") for _ in range(80_000))])
    assert time.time() - t < 15


@pytest.mark.parametrize("keep", [("doc_id",), ("doc_id", "text", "ids_")])
def test_empty_table_and_clashing_names(spark, keep):
    d = spark.createDataFrame([(1, "a b", "x", 3), (None, None, "x", 3), (1, "a b", "x", 3)], "doc_id long, text string, ids_ string, decoded int")
    got = bpe.encode(d, PATH, keep=keep)
    assert got.count() == 3 and bpe.encode(d.where("false"), PATH, keep=keep).count() == 0
    back = bpe.decode(got, PATH)
    assert sorted(r.decoded for r in back.collect()) == sorted(r.decoded for r in got.collect())
