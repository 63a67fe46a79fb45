import hashlib
import random
import re
from collections import Counter

import corpus_pipeline as pipeline
from tokenizers import Tokenizer
from vexel.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return " ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(10**5)}" for _ in range(n))


def corpus():
    """Documents by kind: clean, toxic, exact and near copies, and a passage in the first of many."""
    rng = random.Random(6)
    passage = words(rng, 60)
    rows = [(i, words(rng, 80)) for i in range(120)]
    rows += [(200 + i, f"{words(rng, 40)} idiot scum {words(rng, 30)}") for i in range(60)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]
    near = [rows[30 + i][1].split() for i in range(20)]
    for i, w in enumerate(near):
        w[3] = "changed"
        rows.append((400 + i, " ".join(w)))
    rows += [(500 + i, f"{words(rng, 40)}\n{passage}\n{words(rng, 40)}") for i in range(20)]
    return rows + [(600, None), (601, ""), (None, words(rng, 50)), (602, words(rng, 20_000))], passage


def test_stages_on_planted_cases(spark, tmp_path):
    rows, passage = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, n_deleted int, h string, __runs int"
    docs = spark.createDataFrame([(i, t, "en", "ab"[(i or 0) % 2], len(t or ""), 0.5, 1, "h", 2) for i, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 300)) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = queries.table(spark, str(tmp_path), "documents")
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    clean = pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and ids(clean) == {i for i, _ in rows if i is None or not 200 <= i < 300}
    cut = pipeline.drop_lines(spark, clean, str(tmp_path))
    text = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and passage in text[500] and not any(passage in text[500 + i] for i in range(1, 20))
    assert text[600] is None and text[601] == "" and all(text[i] == t for i, t in rows if i is not None and i < 120)
    one = pipeline.drop_near_copies(spark, cut, str(tmp_path))
    # Whole copies lost all their lines before: they are empty texts now, which stay.
    assert one.columns == docs.columns and ids(one) == {i for i in text if i is None or not 400 <= i < 500}
    mix = pipeline.mix_sources(spark, one, str(tmp_path))
    assert mix.columns == docs.columns
    taken = sum(r.taken for r in mixing.taken(one).collect())
    lib, n = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), 0
    got = pipeline.encode(spark, mix, str(tmp_path)).collect()
    want = Counter()
    for r in mix.collect():
        n += len(WORD.findall(r.text))
        e = lib.encode(r.text, add_special_tokens=False).ids
        want[(r.doc_id, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest())] += 1
    assert n == taken and Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == want
    whole = pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in whole.collect()) == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
