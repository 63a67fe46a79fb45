import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from vexel.llm import bpe, html_text, jaccard, language, line_dedup, mixing, quality, queries, token_files, topk, toxicity

LONG = " ".join(f"wort{i % 977}x{i % 31}" for i in range(20000))
LINE = "one two three four five six seven eight nine ten " * 3
TEXTS = [None, "", "   \n\t", "a", "Hello, WORLD! it's 3 cats — naïve Σς 漢字 <|endoftext|> x", LONG, LONG, LONG + " tail", f"{LINE}\nfirst own line here", f"second own line\n{LINE}", "$$ ## ** " * 40]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, id long, band long, v string, words string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][i % 2], ["a", "b", None][i % 3], len(t or ""), "s", 5, 6, "v", "w") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "null id " * 30, "en", "a", 1, None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(8)], "doc_id long, quality int, toxic int")


def test_bpe_equals_library(docs):
    path = queries.tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for r in bpe.encode(docs, path, keep=("doc_id", "text")).collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)


def test_token_files(docs, spark, tmp_path):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    manifest = token_files.write(docs, f"file://{tmp_path}/t", path)
    start, got = 0, token_files.read(spark, manifest).orderBy("start").collect()
    want = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        ids = [*lib.encode(w.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens) == (w.doc_id, start, len(ids))
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_quality_base(docs):
    import re

    rows = docs.select("doc_id", "text").collect()
    got = Counter(tuple(r[c] for c in ("doc_id", *quality.BASE, "base_failed")) for r in quality.verdicts(docs).collect())
    want = Counter()
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n, hit = Counter(win), set()
        for i, x in enumerate(win):
            if n[x] > 1:
                hit.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want[(r.doc_id, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed)] += 1
    assert got == want


def test_mixing(docs):
    a = sorted(mixing.taken(docs).collect(), key=str)
    assert a == sorted(mixing.taken(docs.repartition(5)).collect(), key=str)
    assert len(a) == docs.count() and all(r.taken <= 2 * r.size for r in a)
    words = sum(r.taken for r in a)
    assert abs(words - sum({(r.source_size, r.target) for r in a} and {r.source_size: r.target for r in a}.values())) <= 3
    assert mixing.mixed(docs).columns == docs.columns


def test_jaccard_brute_force(docs):
    rows = [r for r in docs.collect() if r.doc_id is not None]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(docs).collect()}
    assert got[5] == got[6] == got[7] == (5, 1)  # two texts, one link
    assert all(got[r.doc_id][0] == r.doc_id for r in rows if r.doc_id not in (6, 7))
    assert got[1] == (1, 0) and got[None] == (None, 0)
    assert jaccard.kept(docs).columns == docs.columns


def test_line_dedup(docs):
    got = {}
    for r in line_dedup.edited(docs).collect():
        got.setdefault(r.doc_id, r)
    assert got[8].text == TEXTS[8] and got[9].text == "second own line"
    assert got[6].text == "" and got[5].text == LONG and got[7].text == TEXTS[7]
    assert got[0].text is None and got[2].text == TEXTS[2]


def test_runs_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        text = "\n".join(" ".join(["w"] * int(n)) + str(n) if n else "" for n in rng.integers(0, 5, 40))
        lines = [x for x in text.split("\n") if x]
        n = [len(x.split()) for x in lines]
        names, first, size = line_dedup.least_runs(text, 8)
        keys = {}
        for k, a, b in zip(map(tuple, names.T.tolist()), first, size):
            assert sum(n[a : a + b]) >= 8 > min(sum(n[a + 1 : a + b]), sum(n[a : a + b - 1]))
            assert keys.setdefault(k, lines[a : a + b]) == lines[a : a + b]
        assert len({tuple(v) for v in keys.values()}) == len(keys)


def test_toxicity(spark, docs, labels):
    index = toxicity.train(docs, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, index).collect())
    rows = [(i, ("fool " if i % 4 == 0 else "") + f"plain text number {chr(97 + i % 26)} of many", i) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score long")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.score(d.select("doc_id", "text"), toxicity.train(d, marks)).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in got)


def test_language(docs):
    got = language.predict(docs, language.train(docs)).collect()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {0, 1, 2, 10} <= und and 5 not in und and len(got) == docs.count()


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(400, None), (401, [float("nan")] * 6), (402, rows[0][1]), (None, rows[0][1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(v, v.vec_id % 100 == 0, 10).collect()
    x = {i: np.floor(1024 * np.array(e, np.float32).astype(float)).astype(int) for i, e in rows if e and i is not None and e[0] == e[0]}
    want = set()
    for q in (0, 100, 200, 300):
        best = sorted((-int(x[q] @ y), i) for i, y in x.items() if i != q)[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want


def test_html(spark):
    page = "<head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two<p>three<script>x='</p>'</script></article><div class='comments'><p>c</p></div><footer>f</footer>"
    rows = [(1, "http://a.b/x", page), (2, None, None), (3, "u", ""), (4, "http://a.b/y", "plain < text &eacute;"), (4, "http://a.b/y", "plain < text &eacute;")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(d).collect())
    assert got == [(1, "A & B\none two\nthree", 19), (2, "", 0), (3, "", 0), (4, "plain < text é", 14), (4, "plain < text é", 14)]


def test_empty_tables(spark, docs, labels):
    none = docs.where("false")
    assert jaccard.classes(none).count() == line_dedup.edited(none).count() == mixing.taken(none).count() == 0
    assert quality.verdicts(none).count() == toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert language.predict(none, language.train(none)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == bpe.digests(bpe.encode(docs.where("doc_id = 0"), queries.tokenizer_path("word_bpe_49k.json"))).first().ids_sha256
