from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_of_the_query(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    got = {r.doc_id: r for r in queries.op6_language(spark, SF).collect()}
    true = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in got.items() if r.held_out and r.lang_pred != "und" and true[i]]
    assert len(got) == len(true) and len(held) > 200
    assert np.mean([got[i].lang_pred == true[i] for i in held]) >= 0.98
    # Languages of the fold held out have no part in it.
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx").otherwise(F.col("lang")))
    wrong.write.parquet(f"{tmp_path}/documents.parquet")
    again = {r.doc_id: (r.lang_pred, r.score) for r in queries.op6_language(spark, str(tmp_path)).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in got.items()}


def grams(text):
    raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    raw = b" " + raw + b" "
    return [((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 17 for a, b, c in zip(raw, raw[1:], raw[2:]) if b != 32]


def test_prediction_equals_plain_decoding(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("el gato y el perro", "es"), ("o gato e o cão", "pt"), ("katten og hunden", "da"), ("der große hund", "de")])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(d)
    names = sorted({x for _, _, x in rows})
    code, counts = language.codewords(len(names)), {x: Counter() for x in names}
    for _, t, x in rows:
        counts[x].update(grams(t))
    share = {x: (np.bincount(list(c.elements()), minlength=language.BUCKETS) + 0.02) / (sum(c.values()) + 0.02 * language.BUCKETS) for x, c in counts.items()}
    for r in language.predict(d, model, ("doc_id", "text")).collect():
        g, loss = grams(r.text), np.zeros(len(names))
        for bit in range(code.shape[1]):
            ones, zeros = (np.mean([share[x] for x, k in zip(names, code[:, bit]) if k == v], axis=0) for v in (1, 0))
            margin = np.log(ones / zeros)[g].sum() / np.sqrt(len(g))
            loss += np.log1p(np.exp(-margin * (2 * code[:, bit] - 1)))
        p = np.exp(loss.min() - loss)
        assert r.lang_pred == names[int(loss.argmin())] == rows[r.doc_id][2]
        assert r.score == pytest.approx(float(p.max() / p.sum()), abs=1e-4)


@pytest.mark.parametrize("n", [2, 3, 5, 6, 12, 40])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    assert len({tuple(c) for c in code.tolist()}) == n
    assert all(0 < c.sum() < n for c in code.T)
    plain = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
    assert plain == language.least_distance(code) >= (1 if n < 4 else 3)


def test_ties_and_defined_cases(spark):
    rows = [(1, "same words", "b"), (2, "same words", "a"), (3, None, "a"), (4, "", "b"), (5, "12 %", "a"), (6, "same words", None), (6, "same words", None), (7, "same " * 60_000, None)]
    d = spark.createDataFrame([(*r, "x", 0.1, "y") for r in rows], "doc_id long, text string, lang string, lang_pred string, score double, __text string")
    model = language.train(d)
    got = sorted((r.doc_id, r.lang_pred) for r in language.predict(d, model).collect())
    assert got == [(1, "a"), (2, "a"), (3, "und"), (4, "und"), (5, "und"), (6, "a"), (6, "a"), (7, "a")]
    assert all(r.score == 0 for r in language.predict(d, model).where("lang_pred = 'und'").collect())
    none = language.train(d.where("false"))
    assert {r.lang_pred for r in language.predict(d, none).collect()} == {"und"}
    assert language.predict(d.where("false"), model, ("doc_id", "__text")).count() == 0
