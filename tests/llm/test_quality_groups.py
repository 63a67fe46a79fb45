import numpy as np

from vexel.llm import quality


def texts(rng, n, size, at):
    """n texts of 60 words of about `size` letters, all words distinct."""
    out = []
    for i in range(n):
        lens = np.maximum(2, rng.normal(size, size / 8, 60).round().astype(int))
        out.append(" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, k)) for k in lens))
    return [(at + i, t) for i, t in enumerate(out)]


def table(spark, odd):
    """300 English rows, 40 German ones with words twice as long, and one row (9999) among the German ones with words of `odd` letters."""
    rng = np.random.default_rng(2)
    rows = [(i, t, "en", "a") for i, t in texts(rng, 300, 5, 0)] + [(i, t, "de", "a") for i, t in texts(rng, 40, 10, 1000)]
    rows += [(9999, t, "de", "a") for _, t in texts(rng, 1, odd, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def rejected(spark, odd, **more):
    return {r.doc_id for r in quality.verdicts(table(spark, odd), **more).where("not kept and not base_failed").collect()}


def test_small_group_has_its_own_estimate(spark):
    assert rejected(spark, 3) == {9999}


def test_small_groups_fall_back_to_their_language(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t, "en", "a") for i, t in texts(rng, 300, 5, 0)] + [(i, t, "de", f"s{i % 8}") for i, t in texts(rng, 80, 10, 1000)]
    rows += [(9999, texts(rng, 1, 3, 0)[0][1], "de", "s0")]
    got = quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in got.where("not kept and not base_failed").collect()} == {9999}
