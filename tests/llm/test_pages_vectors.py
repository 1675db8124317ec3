"""Main text of pages, and search over vectors."""

import html
import math
import re

import pytest
from pyspark.sql import functions as F

from roundweave.llm import html as pages
from roundweave.llm import queries, search
from tests.conftest import SF, same_rows


def test_pages(spark):
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_html(spark, SF).collect():
        article = re.search("<article>(.*?)</article>", raw[r["page_id"]], re.S).group(1)
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        assert r["n_chars"] == len(r["text"])


LONG = "Long paragraph text with many words that go on and on and on."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><header>Site</header><div class='sidebar'>x</div><div id=content><h2>T</h2><p>{LONG}</p><p>a</p></div><div class=comments><p>{LONG}</p></div></body>", f"T {LONG} a"),
        (f"<main><article><header><h1>Title</h1></header><p>{LONG}<ul><li>one<li>two</ul></article><aside>{LONG}</aside></main>", f"Title {LONG} one two"),
        (f"<nav>a</nav><p>{LONG}</p><p>b &lt; c&nbsp;d</p><footer>x</footer>", f"{LONG} b < c d"),
        (f"<div class='post has-sidebar comments-open'><p>{LONG}</p><div class='sidebar-left'><p>no</div><p>b</div>", f"{LONG} b"),
        (f"<div class='widget'><p>{LONG}</p></div>", LONG),
        ("plain  text", "plain text"),
        ("", ""),
        ("<script>var x = '<p>no</p>'</script><!-- <p>no</p> -->", ""),
        (f"<div><p>{LONG}</div><form><p>{LONG}</form><div class='cookie-notice'>{LONG}</div>", LONG),
    ],
)
def test_page(page, text):
    assert pages.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h2 id='related-work'>Related work</h2><p>{LONG}</p><section id='search-algorithms'><h2>S</h2><p>{LONG}</p></section></article>", f"Related work {LONG} S {LONG}"),
        (f"<main><p>{LONG}</p><h2 id='social-impact'>I</h2><div id='cookies-in-http'><p>{LONG}</p></div><p class='notice-board'>Board</p></main>", f"{LONG} I {LONG} Board"),
        (f"<div><p>{LONG}</p><h2 id='related-work'>R</h2><section id='search-algorithms'><p>{LONG}</p></section></div>", f"{LONG} R {LONG}"),
        (f"<article><p>{LONG}</p><div class='related'><h3>More</h3><a href=a>{LONG}</a></div><div class=share><b>x</b><i>y</i></div><p>{LONG}</p></article>", f"{LONG} {LONG}"),
        (f"<article><div class=header><h1>Title</h1></div><p>{LONG}</p><div class=notice><p>{LONG}</p></div></article>", f"Title {LONG} {LONG}"),
        (f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>", f"{LONG} x=2"),
        (f"<body><div class=skip>Skip to text</div><form id=f><div><h1>T</h1><p>{LONG}</p></div><div class=sidebar>no</div></form></body>", f"T {LONG}"),
        (f"<form>Find</form><div class='widget'><p>{LONG}</p></div>", LONG),
    ],
)
def test_named_within_content(page, text):
    assert pages.main_text(page) == text


ITEMS = "".join(f"<li>i{n}</li>" for n in range(6))
LINKS = "<ul><li><a href=a>Home</a><li><a href=b>News</a></ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class=post><h1>T</h1><div class=lead><p>short</p></div><div class=entry><p>{LONG * 4}</p></div></div>", f"T short {LONG * 4}"),
        (f"<body><nav>n</nav><div><h1>T</h1><div><p>{LONG * 20}</p></div><div><p>{LONG}</p></div><div class=share>s</div><p>end</p></div><footer>f</footer></body>", f"T {LONG * 20} {LONG} end"),
        (f"<body>{LINKS}<h1>T</h1><p>{LONG * 3}</p><ul>{ITEMS}</ul><p>bye</p>{LINKS}</body>", f"T {LONG * 3} i0 i1 i2 i3 i4 i5 bye"),
        (f"<body><p>a</p><p>{LONG * 3}</p><p><a href=x>link</a></p><p>b</p>{LINKS}<p>c</p></body>", f"a {LONG * 3} link b"),
        (f"<table><tr><td>{LONG * 9}</td><td>cell</td></tr></table>", f"{LONG * 9} cell"),
        (f"<div><h2 id='related-work'>R</h2><section id='search-algorithms'><p>{LONG}</p></section></div>", f"R {LONG}"),
        (f"<p>before</p><article><p>{LONG * 9}</p></article><p>after</p>", LONG * 9),
    ],
)
def test_region(page, text):
    assert pages.main_text(page) == text


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>a", "x"), (1, "u", None, "x"), (2, "u", "<" * 5000, None), (3, "u", "<div>" * 3000 + "deep", None)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, __html string")).collect()
    assert sorted(r["n_chars"] for r in got)[:2] == [0, 0] and len(got) == 5
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_search(spark, duck):
    same_rows(queries.op7_search(spark, SF).toPandas(), duck.sql(queries.ORACLES["op7_search"]).df())


def test_odd_vectors(spark):
    nan, inf = float("nan"), math.inf
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-1.0, 0.25]), (8, []), (None, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (9, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in search.top_k(table, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50, 98304), (0, 2, 50, 98304), (0, 3, 1, 81920), (50, 1, 0, 98304), (50, 2, 1, 98304), (50, 3, 2, 98304)]
    assert search.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_blocks(spark):
    """Many blocks of queries and many shards give what one of each gives."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(2)
    want = search.top_k(table, F.col("vec_id") % 5 == 0).toPandas()
    same_rows(search.top_k(table, F.col("vec_id") % 5 == 0, shard_rows=50, block_queries=17).toPandas(), want)
    same_rows(search.top_k(table.repartition(7), F.col("vec_id") % 5 == 0, shard_rows=120).toPandas(), want)


def test_trees():
    """A tree is read as it was written, holds every row once, and its balls hold their rows."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for scale in (100, 2**40):
        rows, ids = rng.integers(-scale, scale, (300, 5)), np.arange(300) * 7
        tree = search.BallTree.grown(ids, rows, 20)
        back = search.BallTree.read(5, {c: pa.scalar(x, pa.binary()) for c, x in tree.written().items()})
        assert sorted(zip(back.ids.tolist(), back.rows.tolist())) == sorted(zip(ids.tolist(), rows.astype(float).tolist()))
        assert len(back.nodes) == len(tree.nodes) > 15
        for centre, radius, lo, hi, left, right in back.nodes:
            assert np.sqrt(((back.rows[lo:hi] - centre) ** 2).sum(axis=1)).max() <= radius * (1 + 1e-9)
            assert left < 0 or (back.nodes[left][2], back.nodes[left][3], back.nodes[right][3]) == (lo, back.nodes[right][2], hi)


def test_branches_are_left_out():
    """With a floor from elsewhere most leaves are never scored, and nothing that reaches it is lost."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (40, 8))
    rows = np.repeat(centres, 50, axis=0) + rng.integers(-20, 20, (2000, 8))
    tree, queries = search.BallTree.grown(np.arange(2000), rows, 50), rows[:30]
    scores = queries @ rows.T
    scores[np.arange(30), np.arange(30)] = search.LOWEST
    kth = np.sort(scores, axis=1)[:, -5]
    best, seen = search.TopK(np.arange(30), queries, 5, kth), []
    merge = best.merge
    best.merge = lambda at, ids, r: (seen.append(len(at) * len(ids)), merge(at, ids, r))
    best.search(tree)
    assert (np.sort(best.scores, axis=1) == np.sort(scores, axis=1)[:, -5:]).all()
    assert sum(seen) < 0.3 * scores.size


def test_nothing_is_broadcast(spark, monkeypatch):
    """Blocks of queries stand once for each shard in a join, so they must not go through the driver, whatever Spark takes for their size."""
    plans, kept = [], search.saved
    monkeypatch.setattr(search, "saved", lambda df, name: plans.append(df) or kept(df, name))
    plans.append(search.top_k(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 5 == 0, shard_rows=50, block_queries=17))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert len(plans) == 4 and sum("SortMergeJoin" in p for p in plans) == 2
    assert not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("scale", [1, 300, 2000, 2**20])
def test_scores_are_exact(scale):
    """Also where 32 bits don't hold them, among ties, for queries with and without a floor, and for more queries than are looked at together."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows, ids = rng.integers(-scale, scale, (700, 64)), rng.permutation(700)
    queries = np.concatenate([rows, rng.integers(-scale, scale, (500, 64))])
    own = np.concatenate([ids, 1000 + np.arange(500)])
    scores = queries @ rows.T
    scores[own[:, None] == ids] = search.LOWEST
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    want = np.take_along_axis(scores, order, axis=1)
    best = search.TopK(own, queries, 5, np.where(own % 2 == 0, search.LOWEST, want[:, -1]))
    best.search(search.BallTree.grown(ids[:300], rows[:300], 40))
    best.search(search.BallTree.grown(ids[300:], rows[300:], 40))
    assert (best.scores == want).all() and (best.found == ids[order]).all()


def test_few_bits():
    import numpy as np
    import pyarrow as pa

    for most, size in ((0, 2), (2**15 - 1, 2), (2**15, 4), (2**31 - 1, 4), (2**31, 8), (2**52, 8)):
        raw = search._written(np.array([[most, 1], [-most, 0]]))
        assert len(raw) == 4 * size
        assert search._read(pa.py_buffer(raw), 2, 2).tolist() == [[most, 1], [-most, 0]]


LINKS = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(30))
PROSE = [f"Paragraph {i} says something of its own at some length, and goes on for a while without any markup in it." for i in range(6)]


def test_pages_that_only_ratios_can_solve():
    """No article, no telling names: only links and short pieces around long text."""
    text = "".join(f"<div>{p}</div>" for p in PROSE)
    page = f"<body><div><ul>{LINKS}</ul></div><div>{text}</div><div><ul>{LINKS}</ul></div></body>"
    assert pages.main_text(page) == " ".join(PROSE)
    rows = "".join(f"<tr><td>{p}</td></tr>" for p in PROSE)
    cells = "".join(f"<tr><td><a href=/{i}>{i}</a></td></tr>" for i in range(40))
    assert pages.main_text(f"<table>{cells}</table><table>{rows}</table><table>{cells}</table>") == " ".join(PROSE)


@pytest.mark.parametrize("page", ["<div>a" * 100_000, "<b><p>x</p>" * 50_000, "<section>" * 50_000 + "<li>a b c" * 50_000, "<article>" + "<div class=share>a b" * 50_000], ids=["div", "b", "li", "share"])
def test_time_follows_the_page(page):
    import time

    began = time.process_time()
    assert pages.main_text(page)
    assert time.process_time() - began < 20


UNENDED = ["<a ", "<p a='", '<p a="', "<!--", "<![CDATA[", "<![if ", "</", "</p ", "<?", "<!d", "<script></", "<title></t", "<a b='>", "<a b='\" c", "<!-- >", "<![CDATA[ >", "<![x ", "<![x >", "<p a='>\"", "&#", "&am", "<a b=c'"]


@pytest.mark.parametrize("end", ["", ">", "</p>"])
@pytest.mark.parametrize("unended", UNENDED)
def test_time_follows_markup_without_end(unended, end):
    import time

    page = f"<p>{LONG}</p>" + unended * (1_000_000 // len(unended)) + end
    began = time.process_time()
    assert pages.main_text(page).startswith(LONG)
    assert time.process_time() - began < 15


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a</p><p>b <a href", "a b <a href"),
        ("<p>a &lt; b</p>c &amp; d <e", "a < b c & d <e"),
        ("<p>a</p><!-- b <p>c</p>", "a <!-- b <p>c"),
        ("<p>a<![foo bar>b</p><![&>c", "ab c"),
        ("<p>a<![CDATA[x > y]]>b<![if z]>c<![endif]>d</p>", "abcd"),
        ("<p>a</p><script>var x = 1 <", "a"),
        ("<p>a</p><!-- b > c --><p>d</p><!-- e", "a d <!-- e"),
    ],
)
def test_unended(page, text):
    assert pages.main_text(page) == text


def test_memory_follows_the_page():
    import tracemalloc

    tracemalloc.start()
    pages.main_text("<div>a" * 10_000)
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
