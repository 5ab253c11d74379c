"""Main text of pages, snapshot differences and lexical search, against plain versions and on odd rows."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import html_text, lexical, snapshot

# ---- 11: main text ------------------------------------------------------------------------------------------------

PAGE = "<!DOCTYPE html><html><head><title>T {n}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>menu {n}</a></li></ul></nav><div class=\"ad\">buy {n} now, really</div><article><h1>Title {n} &amp; more</h1><p>First  <b>words</b> of\n page {n}.<br>Same block.<p>Second caf&eacute; block.</p></article><footer>&copy; host {n}</footer></body></html>"


def page_rows():
    rows = [(n, f"http://h/{n}", PAGE.format(n=n)) for n in range(20)]
    long = "<article>" + "".join(f"<p>long paragraph number {n} with words</p>" for n in range(20_000)) + "</article>"
    return [*rows, (20, None, None), (21, "u", ""), (22, "u", "  "), (23, "u", long), (None, "u", PAGE.format(n=3)), (3, "http://h/3", PAGE.format(n=3)), (24, "u", "<p>open <div"), (25, "u", "a < b & c > d &lt;p&gt;")]


@pytest.fixture(scope="module")
def weight():
    return html_text.weights(html_text.counted(p for _, _, p in page_rows()))


def test_main_texts(spark):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumn("n_chars", F.lit("clash")).withColumn("kind", F.lit(1)).repartition(3)
    got = defaultdict(list)
    for r in html_text.extract(df).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append((r.url, r.text))
    want = "Title {n} & more\n\nFirst words of page {n}. Same block.\n\nSecond café block."
    for n in range(20):
        assert got[n] == [(f"http://h/{n}", want.format(n=n))] * (1 + (n == 3))
    assert got[None] == [("u", want.format(n=3))]
    assert [got[n][0][1] for n in (20, 21, 22, 24, 25)] == ["", "", "", "open", "a < b & c > d <p>"]
    assert got[23][0][1].split("\n\n") == [f"long paragraph number {n} with words" for n in range(20_000)]
    assert sum(map(len, got.values())) == len(page_rows())
    empty = html_text.extract(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='site-header'><h1>Site</h1></div><div id=content><div class=post-header><h1>A title</h1></div><p>Some words of an article.</p><div class=ad>buy this thing now</div><p>More words of it.</p></div><div id=comments><p>I like it</p></div>", "A title\n\nSome words of an article.\n\nMore words of it."),
        ("<main><article><h1>Head line</h1><p>Body of it</p></article><section class=comment-list><article class=comment><p>Reader says so</p></article></section></main>", "Head line\n\nBody of it"),
        ("<article><header><h1>Head</h1></header><p>Body</p><form><p>Your mail</p></form><aside>Side</aside></article>", "Head\n\nBody"),
        ("<body><p class='cookie-notice'>We use cookies</p><p>Words <span class=ad>AD</span>stay</p><p hidden>no</p><p style='display:none'>no</p></body>", "Words stay"),
        ("<article><p>never closed <div class=ad>advert<p>still text</article>", "never closed\n\nstill text"),
        ("<article><p>x<script>'<p>no</p>'</script>y<!-- <p>no --> z<table><tr><td>1<td>2</table></article>", "xy z\n\n1\n\n2"),
        ('<article><p title="a > b">q&nbsp;&nbsp;r &#8212; &#x41; &copy 1</p></article>', "q r — A © 1"),
        ("<!-- never closed <p>words</p>", ""),
    ],
)
def test_layouts(weight, page, text):
    assert html_text.main_text(page, weight) == text


def test_deep_and_broken_pages_are_read_once(weight):
    """What is nested or left open a hundred thousand times takes no longer than its length asks for."""
    began = time.monotonic()
    assert html_text.main_text("<div>" * 100_000 + "x" + "</span>" * 100_000, {"w:": 1.0, "w:/a": -0.5, "t:": -1.0}) == "x"
    assert html_text.main_text("<article>" * 60_000 + "<h1>" * 60_000 + "y", weight) == "y"
    assert html_text.main_text("<p>word here" + '<a href="x' * 50_000, weight) == "word here"
    assert html_text.main_text("<script>" * 50_000 + "<!--" * 50_000, weight) == ""
    assert time.monotonic() - began < 60


def test_best_run_is_the_best_of_all():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = rng.integers(-4, 5, rng.integers(0, 12)).astype(float)
        sums = {(i, j): x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        i, j = html_text.best_run(x)
        assert (x[i:j].sum() if j else 0) == max([0, *sums.values()])
        assert j or all(s <= 0 for s in sums.values())


def test_weights_follow_the_labelled_pages(weight):
    assert weight["w:p"] > 1 and weight["w:h1"] > 1
    assert all(w < 0 for k, w in weight.items() if k.startswith("t:"))
    assert weight["t:p"] > weight["t:body"] == -1.0


# ---- 12: snapshots --------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string"


def plain_later(rows):
    out = []
    for i, t, g, s in rows:
        kind = zlib.crc32(str(i).encode()) % 10 if i is not None else 9
        if kind == 1:
            out.append((i, (t or "") + "+", g, s))
        elif kind == 2:
            out.append((i, t, s, g))
        elif kind in (3, 4):
            out.append((-1 - i, t, g, s if kind == 3 else None))
        elif kind:
            out += [(i, t, g, s)] + ([(-1 - i, t, g, s)] if kind == 5 else [])
    return out


def content_order(row):
    return hashlib.md5("".join("~" if v is None else hashlib.md5(v.encode()).hexdigest().upper() for v in row[1:]).encode()).hexdigest()


def plain_difference(old, new):
    sides, out = [defaultdict(list), defaultdict(list)], []
    for side, rows in zip(sides, (old, new), strict=True):
        for r in sorted(rows, key=content_order):
            side[r[0]].append(r)
    sha = lambda r: hashlib.sha256("\n".join("~" if v is None else v for v in r[1:]).encode()).hexdigest()
    rest = [defaultdict(list), defaultdict(list)]
    for key in {*sides[0], *sides[1]}:
        a, b = sides[0][key], sides[1][key]
        for x, y in zip(a, b, strict=False):
            changed = ",".join(n for n, p, q in zip(("text", "lang", "source"), x[1:], y[1:], strict=True) if p != q)
            out.append((key, key, "update" if changed else "same", changed, sha(y)))
        for k, rows in enumerate((a[len(b) :], b[len(a) :])):
            for r in rows:
                rest[k][r[1:]].append(r)
    smallest = lambda r: (r[0] is not None, r[0] or 0)
    for content in {*rest[0], *rest[1]}:
        a, b = (sorted(x[content], key=smallest) for x in rest)
        out += [(y[0], x[0], "rekey", "", sha(y)) for x, y in zip(a, b, strict=False)]
        out += [(x[0], x[0], "delete", "", None) for x in a[len(b) :]] + [(y[0], None, "insert", "", sha(y)) for y in b[len(a) :]]
    return out


def compared(spark, old, new, parts=3):
    frames = [spark.createDataFrame(x, DOCS).withColumn("place", F.lit("clash")).withColumn("content", F.lit(1)).repartition(parts) for x in (old, new)]
    return sorted(map(str, (tuple(r) for r in snapshot.difference(*frames, "doc_id", ["text", "lang", "source"]).collect())))


def test_difference_of_documents(spark):
    rows = [(k, f"text {k % 17}", ["en", "fr", None][k % 3], ["a", None, "b", "en"][k % 4]) for k in range(400)]
    rows += [(k, "copy of many", "en", "hot") for k in range(400, 900)] + [(900, None, None, None), (901, "", "~", None), (902, "~", None, ""), (None, "x", None, None), (903, "w " * 100_000, "en", None)]
    later = plain_later(rows)
    assert Counter(map(tuple, snapshot.later_documents(spark.createDataFrame(rows, DOCS)).collect())) == Counter(later)
    want = plain_difference(rows, later)
    assert {x[2] for x in want} == {"same", "update", "rekey", "insert", "delete"}
    assert compared(spark, rows, later) == sorted(map(str, want))


def test_difference_of_odd_rows(spark):
    old = [(1, "a", None, None), (1, "a", None, None), (1, "b", None, None), (None, "n", None, None), (None, "m", "x", None), (2, None, None, None), (3, None, None, None), (8, "same", "p", "q"), (9, "same", "p", "q")]
    new = [(1, "a", None, None), (None, "n", None, None), (5, None, None, None), (6, None, None, None), (7, None, None, ""), (-9, "same", "p", "q"), (-8, "same", "p", "q"), (-7, "same", "p", "q")]
    assert compared(spark, old, new) == sorted(map(str, plain_difference(old, new)))
    assert compared(spark, old, []) == sorted(map(str, plain_difference(old, [])))
    assert compared(spark, [], new) == sorted(map(str, plain_difference([], new)))
    assert compared(spark, [], []) == []


def test_numbers_of_one_large_group(spark):
    """A group over many range partitions is numbered without a gap."""
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.col("id").cast("string")).alias("g"), (F.col("id") * 7919 % 5003).alias("o"))
    got = defaultdict(list)
    for r in snapshot.numbered(df, "g", F.col("o")).collect():
        got[r.g].append((r.o, r.place))
    assert len(got["hot"]) == 3500 and len(got[None]) == 500
    assert all([p for _, p in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


# ---- 13: search -----------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    terms = lambda t: TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return out


def corpus(seed, n=300):
    rng = np.random.default_rng(seed)
    some = lambda size: " ".join(f"T{int(x)}" for x in rng.zipf(1.3, size) % 800)
    docs = [(k, some(rng.integers(1, 80))) for k in range(n)]
    docs += [(n + k, docs[k][1].upper() + ", É-x") for k in range(40)] + [(2000, None), (2001, ""), (2002, "--- !!"), (None, docs[5][1]), (5, docs[5][1]), (2003, some(20_000))]
    items = [(k, some(rng.integers(1, 40))) for k in range(25)] + [(100, None), (101, ""), (102, "nowhere-found"), (103, docs[3][1] + " " + docs[3][1]), (103, docs[4][1]), (None, "t1 T2 é")]
    return docs, items


@pytest.mark.parametrize("shard", [1 << 15, 37])
def test_search_is_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "ITEMS", 1 << 15 if shard > 99 else 11)
    docs, items = corpus(shard)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("score", F.lit(None)).repartition(4)
    got = lexical.search(frame, spark.createDataFrame(items, "item_id int, text string").withColumn("rank", F.lit(1)))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_search(docs, items)))


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == plain_search([(1, "a b"), (2, None)], [(1, "a"), (2, None)])


def test_the_scan_stops_before_the_ends_of_the_lists():
    """A few high documents: most postings of a long list are never read, and equal scores at the edge are all seen."""
    rng = np.random.default_rng(1)
    n = 20_000
    impact = np.where(np.arange(n) < 30, 1000, rng.integers(1, 500, n))
    best = lexical._Best(10)
    order = rng.permutation(n)
    read = lexical.search_shard(order.astype(np.int64), np.zeros(n, bool), np.arange(n + 1), np.zeros(n, np.int64), impact[order], [(np.array([0]), np.array([1]))], [best])
    assert read < n / 20
    assert best.ids.tolist() == list(range(10)) and set(best.scores.tolist()) == {1000}
