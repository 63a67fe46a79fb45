import numpy as np
import pytest

from vexel.llm import topk


@pytest.mark.parametrize("kind", ["one id eleven times", "all rows doubled", "the query's id often"])
def test_repeated_rows_fill_no_place(spark, kind):
    rng = np.random.default_rng(7)
    x = {i: rng.normal(size=16).astype(np.float32) for i in range(400)}
    rows = list(x.items())
    if kind == "one id eleven times":
        x[399] = 3 * x[0]
        rows = list(x.items()) + [(399, x[399])] * 10
    elif kind == "all rows doubled":
        rows = rows * 2
    else:
        rows = rows + [(0, 2 * x[0])] * 30
    v = spark.createDataFrame([(i, [float(a) for a in e]) for i, e in rows], "vec_id long, embedding array<float>").coalesce(1)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(v, v.vec_id == 0, 10).orderBy("rank").collect()]
    whole = [(i, np.floor(1024 * e.astype(float)).astype(int)) for i, e in rows]
    best: dict[int, int] = {}
    for q in (e for i, e in whole if i == 0):
        for i, e in whole:
            if i:
                best[i] = max(best.get(i, -(1 << 62)), int(q @ e))
    want = sorted((-s, i) for i, s in best.items())[:10]
    assert got == [(0, r + 1, i, -s) for r, (s, i) in enumerate(want)]
