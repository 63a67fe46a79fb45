import time
from collections import Counter, defaultdict

import pytest

from vexel.llm import html_text as h
from vexel.llm import queries


def table(spark, rows):
    return spark.createDataFrame([(i, u, t, "x", 1, "y") for i, u, t in rows], "page_id long, url string, html string, host string, tokens int, texts string").repartition(3)


def texts(spark, rows):
    return Counter((r.page_id, r.url, r.text, r.n_chars) for r in h.extract(table(spark, rows)).collect())


def brute(rows, hosts):
    """The same by whole occurrence vectors, page by page."""
    pages = [[((p, t), t, f) for p, t, f in h.tokens(x or "")] for _, _, x in rows]
    out = []
    held = defaultdict(list)
    for host, page in zip(hosts, pages):
        held[host].append([k for k, _, _ in page])
    template = {}
    for host, all_ in held.items():
        distinct = list(dict.fromkeys(map(tuple, all_)))
        if len(distinct) < h.PAGES:
            continue
        vectors = defaultdict(dict)
        for i, page in enumerate(distinct):
            for k, n in Counter(page).items():
                vectors[k][i] = n
        classes = defaultdict(set)
        for k, v in vectors.items():
            if len(v) >= max(h.PAGES, h.SUPPORT * len(distinct)):
                classes[tuple(sorted(v.items()))].add(k)
        large = [(v, own) for v, own in classes.items() if len(own) >= h.LARGE]
        orders, bad = defaultdict(Counter), Counter()
        for page in all_:
            met = [(v, [i for i, k in enumerate(page) if k in own]) for v, own in large]
            before = []
            for v, at in sorted((m for m in met if m[1]), key=lambda m: -len(m[0])):
                orders[v][tuple(page[i] for i in at)] += 1
                gaps = lambda a, b: len({sum(x < y for x in a) for y in b})
                if any(gaps(b, at) > 1 and gaps(at, b) > 1 for n, b in before if n > len(v)):
                    bad[v] += 1
                before.append((len(v), at))
        good = [own for v, own in large if sum(orders[v].values()) - max(orders[v].values()) <= h.FAILS * sum(orders[v].values()) and bad[v] <= h.FAILS * sum(orders[v].values())]
        template[host] = set().union(*good)
    for (i, u, _), host, page in zip(rows, hosts, pages):
        blocks = [b for b in page if b[1] and not b[2] & 1]
        if any(b[2] & 2 for b in page if b[1]):
            blocks = [b for b in blocks if b[2] & 2]
        else:
            blocks = [b for b in blocks if b[0] not in template.get(host, ())]
        text = "\n".join(b[1] for b in blocks)
        out.append((i, u, text, len(text)))
    return Counter(out)


def layouts(n=30):
    """Two templates of one host, neither on nine tenths of its pages, and no article element."""
    rows = []
    for i in range(n):
        body = "".join(f"<p>words {i} {j} of page {i}</p>" for j in range(i % 4 + 1))
        if i % 5 < 3:
            page = f"<body><div id=top><b>The Daily</b></div><div>Edition of today</div><div><h1>title {i}</h1>{body}</div><div>All rights kept</div></body>"
        else:
            page = f"<body><div>Second layout</div><section><h1>title {i}</h1>{body}</section><p>Made with care</p><div>Call us</div></body>"
        rows.append((i, f"https://x.example/{i}", page))
    return rows


def test_two_templates_of_a_host(spark, monkeypatch):
    rows = layouts()
    want = Counter()
    for i, u, _ in rows:
        text = "\n".join([f"title {i}", *(f"words {i} {j} of page {i}" for j in range(i % 4 + 1))])
        want[(i, u, text, len(text))] += 1
    assert texts(spark, rows) == want == brute(rows, ["x"] * len(rows))
    monkeypatch.setattr(h, "SUPPORT", 2.0)  # without a template its blocks stay
    assert all("All rights kept" in k[2] or "Call us" in k[2] for k in texts(spark, rows))


def test_classes_out_of_order_are_no_template(spark):
    a, b = "<div>first note</div>", "<div>second note</div>"
    rows = [(i, "http://y/1", f"<body><p>own {i}</p>{a + b if i % 2 else b + a}</body>") for i in range(10)]
    assert texts(spark, rows) == brute(rows, ["y"] * 10)
    assert all("note" in k[2] for k in texts(spark, rows))


@pytest.mark.parametrize("strip", [True, False])
def test_query_equals_brute_force(spark, strip, tmp_path):
    rows = [(r.page_id, r.url, r.html) for r in queries.table(spark, "/root/testdata/sf0.01", "pages").collect()]
    if strip:
        rows = [(i, u, (t or "").replace("<article", "<div").replace("</article", "</div").replace('class="ad"', "").replace("<footer", "<div").replace("</footer", "</div")) for i, u, t in rows]
    import re

    host = lambda u: (re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", u or "") or ["", u or ""])[1].lower()
    want = brute(rows, [host(u) for _, u, _ in rows])
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in queries.op7_html_text(spark, str(tmp_path)).collect())
    assert got == want


def test_attributes_and_unclosed_parts(spark):
    cases = {
        "<article><p title=it's>Hello</p><p>don't stop</p><p>end</p></article>": "Hello\ndon't stop\nend",
        "<p>a<!-- q --> tail<p>x": "a tail\nx",
        "a<!-- x > y": "a",
        "<p>a</p><script>x</p> > b": "a",
        "1 < 2 > 3 <p": "1 < 2 > 3 <p",
        "<p title='a>b'>q</p>": "q",
        "plain &lt; text &eacute;": "plain < text é",
        "<main>m<nav>n</nav>o</main><p>p": "m\no",
    }
    rows = [(i, None, c) for i, c in enumerate(cases)]
    assert {(k[0], k[2]) for k in texts(spark, rows)} == set(enumerate(cases.values()))


def test_deep_and_long_pages_are_linear(spark):
    for unit in ("<b>", "<b><p>", '<a b="', "<div><i>"):
        t = time.time()
        assert sum(1 for _ in h.tokens(unit * 100_000 + "end")) >= 1
        assert time.time() - t < 10
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(100_000)) + "</article>"
    got = h.extract(table(spark, [(1, "http://z/", long)] * 2)).collect()
    assert [r.n_chars for r in got] == [sum(len(f"word {i}") for i in range(100_000)) + 99_999] * 2


def test_empty_cases(spark):
    rows = [(1, None, None), (2, "", ""), (None, "u", "<p>x"), (3, "http://h/", "<article>a</article>"), (3, "http://h/", "<article>a</article>")]
    assert texts(spark, rows) == Counter({(1, None, "", 0): 1, (2, "", "", 0): 1, (None, "u", "x", 1): 1, (3, "http://h/", "a", 1): 2})
    assert h.extract(table(spark, rows).where("false")).count() == 0
