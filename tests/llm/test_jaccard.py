import random
import re
from collections import Counter

import pytest

from vexel.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text or "")
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def brute(rows):
    """(doc_id, class_id, rep, n_links) of each row, the number of links, and the group of each set, by comparing all pairs."""
    low = {}
    for d, t in rows:
        if d is not None and grams(t):
            low[grams(t)] = min(d, low.get(grams(t), d))
    sets = list(low)
    root, links = {s: s for s in sets}, Counter()

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if len(a & b) / len(a | b) >= 0.8:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for s in sets:
        least[find(s)] = min(low[s], least.get(find(s), low[s]))
    out = Counter()
    for d, t in rows:
        s = grams(t)
        out[(d, least[find(s)], low[s], links[s]) if d is not None and s else (d, d, d, 0)] += 1
    return out, sum(links.values()) // 2, find


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "c", "h", 0, "l") for d, t in rows], "doc_id long, text string, id long, band long, c string, h string, n_links long, label string").repartition(5)


def words(rng, n, of=400):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def near(rng, seed, edits):
    w = list(seed)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def mixture(rng):
    hot, other = words(rng, 150), words(rng, 60)
    rows = [(i, near(rng, hot, rng.randrange(0, 6))) for i in range(130)]
    rows += [(200 + i, " ".join(hot)) for i in range(40)]
    rows += [(300 + i, near(rng, other, rng.randrange(0, 4))) for i in range(40)]
    rows += [(400 + i, " ".join(words(rng, rng.randrange(1, 80)))) for i in range(60)]
    passage = words(rng, 60)
    rows += [(500 + i, " ".join([*passage, *words(rng, 30)])) for i in range(60)]
    chain = words(rng, 100)
    for i in range(30):  # each near the next, the ends apart
        chain = [*chain[3:], *words(rng, 3)]
        rows.append((600 + i, " ".join(chain)))
    rows += [(5, " ".join(other)), (5, "two texts of one id"), (5, "two texts of one id"), (700, "a b"), (701, " a\tb "), (702, None), (703, ""), (704, " \n"), (None, " ".join(hot)), (None, None)]
    rows += [(705, " ".join(words(rng, 30_000, 30_000)))] * 2
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed, monkeypatch):
    rows = mixture(random.Random(seed))
    want, n, _ = brute(rows)
    assert n > 500
    if seed == 2:  # the same through many blocks and tiles, and without sending ids
        for name, value in (("BLOCK_ROWS", 16), ("TILE", 5), ("SENT", 0)):
            monkeypatch.setattr(jaccard, name, value)
    got = Counter((r.doc_id, r.class_id, r.rep, r.n_links) for r in jaccard.classes(table(spark, rows)).collect())
    assert got == want


def test_one_of_each_group_stays(spark):
    rows = mixture(random.Random(3))
    d = table(spark, rows)
    _, _, find = brute(rows)
    got = jaccard.kept(d)
    assert got.columns == d.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    ours = lambda r: r[0] is not None and bool(grams(r[1]))
    assert Counter(find(grams(t)) for _, t in filter(ours, left)) == Counter({find(grams(t)) for _, t in filter(ours, rows)})
    assert Counter(r for r in left if not ours(r)) == Counter(r for r in rows if not ours(r))
    least = {}
    for d, t in filter(ours, rows):
        least[find(grams(t))] = min(d, least.get(find(grams(t)), d))
    assert all(d == least[find(grams(t))] for d, t in filter(ours, left))


def test_small_and_empty_tables(spark):
    d = table(spark, [(1, "a b c d e f"), (2, None)])
    assert jaccard.classes(d.where("false")).count() == jaccard.kept(d.where("false")).count() == 0
    assert sorted(map(tuple, jaccard.classes(d).collect())) == [(1, 1, 1, 0), (2, 2, 2, 0)]
    assert jaccard.kept(d).count() == 2
