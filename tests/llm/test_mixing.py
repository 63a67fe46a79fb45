import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vexel.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """By repeated passes over all sources: {source: size} to {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        unit = (left - sum(fixed.values())) / max(sum(w[s] for s in free), 1)
        over = [s for s in free if unit * w[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: unit * w[s] for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), "h", 1, 2) for i, t, s in rows], "doc_id long, text string, source string, n_chars long, h string, start int, name int").repartition(4)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(rng.choice([0, 1, 5, 130, 700]))), rng.choice(["a", "a", "a", "a", "b", "c", None, ""])) for i in range(300)]
    rows += [(1000, " ".join(f"long{j}" for j in range(50_000)), "b"), (1001, None, "a"), (1002, " \n", "c"), (None, "no id here", "a")]
    return rows + [(2000, " ".join(f"twice{j}" for j in range(300)), "c")] * 3 + [(2000, "twice", "c"), (2000, " ".join(f"twice{j}" for j in range(300)), "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_sizes(spark, seed):
    rows = corpus(seed)
    n = Counter()
    for _, t, s in rows:
        n[s] += len(WORD.findall(t or ""))
    want = targets(n)
    got = mixing.taken(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size
        taken[(r.source_size, round(r.target, 6))] += r.taken
    assert Counter(taken) == Counter({(n[s], round(want[s], 6)): round(want[s]) for s in n})


def test_mixed_text_is_what_is_taken(spark):
    rows = corpus(3)
    d = table(spark, rows)
    taken = Counter()
    for r in mixing.taken(d).collect():
        taken[(r.doc_id, r.source_size)] += r.taken
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    got, by = mixing.mixed(d), Counter()
    assert got.columns == d.columns
    text = {(i, s): set(WORD.findall(t or "")) for i, t, s in rows if i != 2000}
    for r in got.collect():
        words = WORD.findall(r.text)
        by[(r.doc_id, size[r.source])] += len(words)
        assert r.n_chars == len(r.text) and (r.doc_id == 2000 or set(words) <= text[(r.doc_id, r.source)])
    assert +by == +taken


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation_and_inverse(n):
    x = np.arange(n)
    p = mixing.permuted(x, n, 12345)
    assert sorted(p) == list(x) and (mixing.unpermuted(p, n, 12345) == x).all()


def test_slots_give_the_target():
    rng = random.Random(4)
    for _ in range(300):
        size, block, key = rng.randrange(1, 2000), 16, rng.randrange(1 << 30)
        target = rng.randrange(1, 2 * size + 1)
        q, last = mixing.slots_needed(size, target, block, key)
        n = -(-size // block)
        lens = [(size - (n - 1) * block if mixing.permuted(np.array([j % n]), n, key + j // n)[0] == n - 1 else block) for j in range(q)]
        assert sum(lens[:-1]) + last == target and 0 < last <= lens[-1]
    q, last = mixing.slots_needed(10**15 + 7, 2 * 10**15 - 1, 128, 5)  # no array as long as the slots
    assert 0 < last <= 128 and q == -(-(2 * 10**15 - 1) // 128) or q


def test_reruns_agree_on_the_whole_table(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    a = Counter(map(tuple, mixing.taken(docs).collect()))
    assert a == Counter(map(tuple, mixing.taken(docs.repartition(7)).collect()))
    assert mixing.taken(docs.where("false")).count() == mixing.mixed(docs.where("false")).count() == 0
