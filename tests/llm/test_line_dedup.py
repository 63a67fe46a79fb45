import random
import re
from collections import Counter

import pytest

from vexel.llm import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least):
    """The texts left, by looking at all runs of all documents. Ids are distinct."""
    docs = []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (t or "").split("\n")
        docs.append((i, t, lines, [n for n, x in enumerate(lines) if WORD.search(x)]))
    seen: dict[tuple, tuple[int, int]] = {}
    out = {}
    dead = []
    for k, (i, t, lines, full) in enumerate(docs):
        keys = [lines[n].strip("\x20\t\n\v\f\r") for n in full]
        words = [len(WORD.findall(x)) for x in keys]
        gone = set()
        for a in range(len(keys)):
            for b in range(a + 1, len(keys) + 1):
                if sum(words[a:b]) >= least:
                    first = seen.setdefault(tuple(keys[a:b]), (k, a))
                    if first[0] != k or first[1] + b - a <= a:
                        gone.update(range(a, b))
        dead.append(gone)
        if not gone:
            out[i] = t
            continue
        off = {full[x] for x in gone}
        kept = []
        for n, x in enumerate(lines):
            before, after = [f for f in full if f < n], [f for f in full if f > n]
            drop = n in off if n in full else (not before or before[-1] in off) and (not after or after[0] in off)
            if not drop:
                kept.append(x)
        out[i] = "\n".join(kept)
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), 7, "r", "h") for i, t in rows], "doc_id long, text string, n_chars long, n_deleted int, __runs string, h string").repartition(3)


def left(spark, rows, least):
    got = line_dedup.edited(table(spark, rows), least, "n_gone")
    assert got.columns == ["doc_id", "text", "n_chars", "n_deleted", "__runs", "h", "n_gone"]
    return {r.doc_id: r.text for r in got.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_edited_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["a b c d e", "f", "g h i", "", "  ", "j k l m n o p", "q r", "a  b", "\tg h i "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 22)))) for i in range(25)]
    rows += [(100 + i, "\n".join(["a b c d e"] * n)) for i, n in enumerate((1, 2, 5, 20))]
    rows += [(200, "\n".join(["j k l", "m n"] * 10)), (201, None), (202, ""), (None, "\n".join(rng.choice(lines) for _ in range(15)))]
    assert left(spark, rows, 8) == brute(rows, 8)


def test_periodic_texts_keep_a_whole_run(spark):
    rows = [(1, "\n".join(["one two three four five"] * 20)), (2, "\n".join(["a b c d e", "f g h i j"] * 10)), (3, "\n".join(f"line {i} of a text without copies" for i in range(30)))]
    got = left(spark, rows, line_dedup.MIN_WORDS)
    assert got[1].split("\n") == ["one two three four five"] * 5
    assert got[2].split("\n") == ["a b c d e", "f g h i j"] * 3
    assert got[3] == rows[2][1] and got == brute(rows, line_dedup.MIN_WORDS)


def test_long_texts_and_hot_lines(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own line of document {i}\n{passage}\nlast line of {i}") for i in range(300)]
    rows += [(1000, "\n".join([*("" for _ in range(40_000)), *(f"x{i} y z" for i in range(40_000))])), (1001, "\n".join(f"x{i} y z" for i in range(40_000)))]
    got = left(spark, rows, line_dedup.MIN_WORDS)
    assert got[0] == rows[0][1] and got[1000] == rows[300][1] and got[1001] == ""
    assert Counter(got[i] for i in range(1, 300)) == Counter(f"own line of document {i}\nlast line of {i}" for i in range(1, 300))
    assert line_dedup.edited(table(spark, rows).where("false"), n_deleted="n_gone").count() == 0
