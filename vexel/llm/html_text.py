"""Operator 7: main text of web pages by equivalence classes of same-host tokens.

A page is a sequence of tokens: its start tags by their path of elements (with the first class, id or role) and its text blocks by theirs.
Pages are parsed once and the tokens kept. Tokens of one host with the same occurrence vector over its pages form an equivalence
class; vectors are compared by the number of pages and two sums of mixed page hashes times counts, so no host's
pages meet in one task. A class is a candidate when it has at least `LARGE` tokens and `SUPPORT` of the host's pages (several
templates a host are several classes). It is valid when its tokens stand in one order on every page that holds them, and
nested when on each page it lies within one gap of every class of more pages that it meets, or holds that class in one gap of its own;
classes that fail on more than `FAILS` of their pages go. The valid classes, nested in each other, are the template; what
stands between their tokens is a slot, and a text block outside them is slot content.

A documented prior, the names and roles of the elements around a slot, decides which slots are the article: never those in menus, headers,
footers, asides, forms, scripts, adverts, notices or comments; with an article or main element on the page, all blocks in it, also
those that a class holds (copies of a page share their whole article, which must not be lost); without, every
slot's content, and no block of the template.

Defined results: null and empty html give an empty text; a url without a host is a host of its own; a host with fewer than `PAGES`
different pages has no template and the prior alone decides; pages of a host with the same tokens count once for it;
unclosed elements end with their parents; quotes inside an unquoted value or a name are part of it; deep nesting and very long pages take time in proportion
to their length; repeated rows each give a row; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

PAGES, LARGE, SUPPORT, FAILS = 3, 2, 0.3, 0.05
_VALUES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg)\b{_VALUES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_VALUES})>|<[!?][^>]*>", re.S | re.I)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
# Fixed values of HTML: elements without content, those that part blocks, and which open elements a start tag ends.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# The prior: elements and roles that are never the article.
_DROP = frozenset("head nav header footer aside form button select menu dialog object audio video canvas".split())
_ROLES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices overlay popup promo promoted related share sharing sidebar social sponsor sponsored subscribe widget alert contentinfo complementary search".split())
_MASK = (1 << 64) - 1


def _is_boilerplate(name: str, attrs: str) -> bool:
    if name in _DROP:
        return True
    if name in ("body", "html", "article", "main") or not attrs:
        return False
    for m in _ATTR.finditer(attrs):
        if not _ROLES.isdisjoint(re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower())):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[int, str, int]]:
    """Start tags as (path, '', 0) and text blocks as (path, text, flags), in page order. The path is a running hash of
    the open elements; flag 1: inside boilerplate, 2: inside an article."""
    names: list[str] = []
    paths, flags = [0], [0]  # of the open elements, one more than names
    opened: dict[str, int] = {}
    held: list[str] = []
    at = 0

    def cut(to: int) -> None:
        for n in names[to:]:
            opened[n] -= 1
        del names[to:], paths[to + 1 :], flags[to + 1 :]

    def flush() -> Iterator[tuple[int, str, int]]:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            yield paths[-1], text, flags[-1]

    last = page.rfind(">") + 1  # no tag ends later; a search beyond would be made again and again
    for m in _TOKEN.finditer(page, 0, last):
        held.append(page[at : m.start()])
        at = m.end()
        if at == last and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[1] and not _ends(m[0], m[1])):
            at = len(page)  # an unclosed comment or raw element takes the rest
        name = (m[3] or "").lower()
        if not name:
            continue
        block = name in _BLOCK
        if block:
            yield from flush()
        if m[2]:
            if not opened.get(name):
                continue
            i = len(names) - 1
            # An inline end tag doesn't close the blocks around it.
            while names[i] != name and (block or names[i] not in _BLOCK):
                i -= 1
            if names[i] == name:
                if flags[-1] != flags[i]:
                    yield from flush()
                cut(i)
            continue
        if name in _VOID or m[4].endswith("/"):
            continue
        closes = _CLOSES.get(name, ("p",) if block else ())
        if closes and any(opened.get(n) for n in closes):
            for i in range(len(names) - 1, -1, -1):
                if names[i] in closes:
                    cut(i)
                    break
                if names[i] in _BLOCK and names[i] != "p":
                    break
        bad = _is_boilerplate(name, m[4])
        if bad and not flags[-1] & 1:
            yield from flush()
        role = _ATTR.search(m[4])
        label = name + ("." + (role[1] or role[2] or role[3] or "") if role else "")
        path = (paths[-1] * 0x9E3779B97F4A7C15 + _label(label)) & _MASK
        path ^= path >> 29
        names.append(name)
        opened[name] = opened.get(name, 0) + 1
        paths.append(path)
        flags.append(flags[-1] | bad | 2 * (name in ("article", "main")))
        yield path, "", 0
    held.append(page[at:])
    yield from flush()


def _ends(match: str, name: str) -> bool:
    return re.search(rf"</{name}\s*>\Z", match, re.I) is not None


_LABELS: dict[str, int] = {}


def _label(label: str) -> int:
    if label not in _LABELS:
        if len(_LABELS) > 100_000:
            _LABELS.clear()
        raw = np.frombuffer(label.encode("utf-8", "replace"), np.uint8)
        _LABELS[label] = int(_text.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
    return _LABELS[label]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, all tokens in order, and of the text blocks their places among these, texts and flags."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "html", 4 << 20):
            got = [list(tokens(p)) for p in part.column(3).to_pylist()]
            flat = [t for page in got for t in page]
            path = np.array([t[0] for t in flat], np.uint64)
            data, bounds = _text.flat_bytes(pa.array([t[1] for t in flat], pa.large_string()))
            some = np.flatnonzero(np.diff(bounds))
            own = np.zeros(len(flat), np.uint64)
            own[some] = _text.span_hashes(data, bounds[some], np.diff(bounds)[some])
            token = _text.mix(path * np.uint64(3) + own).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(page) for page in got])]).astype(np.int64)
            texts = [[t[1] for t in page if t[1]] for page in got]
            places = [[i for i, t in enumerate(page) if t[1]] for page in got]
            flags = [[t[2] for t in page if t[1]] for page in got]
            yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "host": part.column(2), "tokens": _text.list_array(token, ends, pa.int64()), "at": pa.array(places, pa.list_(pa.int32())), "texts": pa.array(texts, pa.list_(pa.string())), "flags": pa.array(flags, pa.list_(pa.int32()))})

    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, tokens array<bigint>, at array<int>, texts array<string>, flags array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column on end, and the row bounds."""
    at = np.asarray(column.offsets, np.int64)
    return np.asarray(column.values)[at[0] : at[-1]], at - at[0]


def candidates(pages: DataFrame) -> DataFrame:
    """host, class, n (its pages) and the tokens of each class that is large and frequent."""
    rows = pages.select("host", F.xxhash64("tokens").alias("p"), "tokens").dropDuplicates(["host", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            host, p = part.column(0).to_pylist(), part.column(1).to_numpy().view(np.uint64)
            flat, bounds = _lists(part.column(2))
            name = {h: i for i, h in enumerate(dict.fromkeys(host))}
            row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            # Once for each page and token, with its count there; then once for each host and token.
            by = np.lexsort((flat, row))
            first = np.flatnonzero((np.diff(row[by], prepend=-1) != 0) | (np.diff(flat[by], prepend=0) != 0) | (np.arange(len(by)) == 0))
            n, token, row = np.diff(first, append=len(by)), flat[by][first], row[by][first]
            of = np.array([name[h] for h in host])[row]
            page = _text.mix(p[row] + np.uint64(1)) * n.astype(np.uint64)
            by = np.lexsort((token, of))
            of, token, page = of[by], token[by], _text.mix(page[by])
            first = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(token, prepend=0) != 0) | (np.arange(len(by)) == 0))
            if not len(first):
                continue
            sums = [np.add.reduceat((page >> np.uint64(s) & np.uint64(0xFFFFFFFF)).astype(np.int64), first) for s in (0, 32)]
            hosts = list(name)
            yield pa.RecordBatch.from_pydict({"host": pa.array([hosts[i] for i in of[first]], pa.string()), "token": token[first], "n": np.diff(first, append=len(by)), "v1": sums[0], "v2": sums[1]})

    seen = rows.mapInArrow(run, "host string, token bigint, n bigint, v1 bigint, v2 bigint")
    vectors = seen.groupBy("host", "token").agg(F.sum("n").alias("n"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"))
    counts = rows.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= PAGES)
    often = vectors.join(counts, "host").where((F.col("n") >= PAGES) & (F.col("n") >= SUPPORT * F.col("pages")))
    # As many tokens as pages can hold, divided by the support.
    return often.groupBy("host", "n", "v1", "v2").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= LARGE).select("host", F.xxhash64("n", "v1", "v2").alias("class"), "n", "tokens")


def crossing(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether neither of two ascending runs of places lies in one gap of the other."""
    p, q = np.searchsorted(a, b), np.searchsorted(b, a)
    return bool((p != p[0]).any() and (q != q[0]).any())


def judged(page: np.ndarray, classes: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, bool]]:
    """For each class (id, pages, tokens) met on a page: id, a hash of its order there, and whether it crosses a class of more pages."""
    before: list[np.ndarray] = []
    for c, _, own in sorted(classes, key=lambda x: (-x[1], x[0])):
        at = np.flatnonzero(np.isin(page, own))
        if not len(at):
            continue
        bad = any(crossing(b, at) for b in before)
        if not bad:
            before.append(at)
        with np.errstate(over="ignore"):
            order = (_text.mix(page[at].view(np.uint64)) * _text.mix(np.arange(1, len(at) + 1, dtype=np.uint64))).sum()
        yield c, int(order.view(np.int64)), bad


def templates(pages: DataFrame) -> DataFrame:
    """host and the tokens of its valid, nested classes."""
    classes = _store.saved(candidates(pages), "classes")
    by_host = classes.groupBy("host").agg(F.collect_list(F.struct("class", "n", "tokens")).alias("classes"))
    rows = pages.select("host", "tokens").join(by_host, "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sums: dict[tuple, list[int]] = {}
            known: dict[str, list] = {}
            for host, page, held in zip(*part.columns, strict=True):
                host = host.as_py()
                if host not in known:
                    known[host] = [(c["class"], c["n"], np.array(c["tokens"], np.int64)) for c in held.as_py()]
                for c, order, bad in judged(np.asarray(page.values), known[host]):
                    got = sums.setdefault((host, c, order), [0, 0])
                    got[0] += 1
                    got[1] += bad
            keys = list(sums)
            yield pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in keys], pa.string()), "class": pa.array([k[1] for k in keys], pa.int64()), "order": pa.array([k[2] for k in keys], pa.int64()), "n": pa.array([sums[k][0] for k in keys], pa.int64()), "bad": pa.array([sums[k][1] for k in keys], pa.int64())})

    seen = rows.mapInArrow(run, "host string, class bigint, order bigint, n bigint, bad bigint")
    orders = seen.groupBy("host", "class", "order").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    valid = orders.groupBy("host", "class").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("bad").alias("bad"))
    valid = valid.where((F.col("all") - F.col("most") <= FAILS * F.col("all")) & (F.col("bad") <= FAILS * F.col("all"))).select("host", "class")
    return classes.join(valid, ["host", "class"]).groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template"))


def main_text(texts: list[str], flags: np.ndarray, own: np.ndarray, template: np.ndarray | None) -> str:
    """The article's blocks: `own` are the tokens of the text blocks."""
    good = flags & 1 == 0
    if (flags & 2).any():
        good &= flags & 2 != 0
    elif template is not None:
        good &= ~np.isin(own, template)
    return "\n".join(t for t, g in zip(texts, good.tolist(), strict=True) if g)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    host = F.when(host == "", F.coalesce("url", F.lit(""))).otherwise(host)
    rows = _store.saved(parsed(pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))), "parsed")
    known = _store.saved(templates(rows), "templates")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows.join(known, "host", "left").select("page_id", "url", "tokens", "at", "texts", "flags", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            token, bounds = _lists(part.column(2))
            at, cut = _lists(part.column(3))
            flags, _ = _lists(part.column(5))
            out = []
            for i, (texts, template) in enumerate(zip(part.column(4).to_pylist(), part.column(6), strict=True)):
                own = token[bounds[i] + at[cut[i] : cut[i + 1]]]
                out.append(main_text(texts, flags[cut[i] : cut[i + 1]], own, np.asarray(template.values) if template.is_valid else None))
            yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())})

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
