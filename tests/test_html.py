import pytest

from pagetree.operators import html, tree

DEMO = """
<html><body>
  <nav style="background:#333; height:60px">
    <a href="/" style="color:white; font-size:18px">Logo</a>
  </nav>
  <main style="padding:20px">
    <img src="hero.jpg" style="width:600px; height:300px"/>
    <h1 style="font-size:32px; color:#333">Hello</h1>
    <button class=" big   blue ">Go "now"</button>
  </main>
</body></html>
"""


def nodes(spark, page, **kw):
    df = spark.createDataFrame([(7, page)], "sample_id long, html string")
    return html.page_nodes(df, **kw).orderBy("node_idx").collect()


def test_demo_page(spark):
    got = nodes(spark, DEMO)
    assert [n.tag for n in got] == ["nav", "a", "main", "img", "h1", "button"]
    assert [n.parent_idx for n in got] == [-1, 0, -1, 2, 2, 2]
    assert got[1].node_text == '<a href="/" style="color:white; font-size:18px">Logo</a>'
    assert got[5].node_text == '<button class="big blue">Go "now"</button>'


def test_lenient_html(spark):
    got = nodes(spark, "<div><p><b>one<br>two<p>three</div><i>four</i></p>")
    assert [(n.tag, n.parent_idx, n.inner_text) for n in got] == [
        ("div", -1, ""), ("p", 0, ""), ("b", 1, "onetwo"), ("br", 2, ""), ("p", 2, "three"), ("i", -1, "four"),
    ]


def test_script_text_is_raw_and_dropped(spark):
    got = nodes(spark, '<div>a<script>var t="</p><b>";</script>b</div>')
    assert [(n.tag, n.inner_text) for n in got] == [("div", "ab")]


def test_comments_and_noscript_by_mode(spark):
    page = "<div>x<!-- y --><noscript>z<em>w</em></noscript></div>"
    assert [(n.tag, n.inner_text) for n in nodes(spark, page)] == [("div", "x y"), ("noscript", "z"), ("em", "w")]
    assert [(n.tag, n.parent_idx, n.inner_text) for n in nodes(spark, page, mode="rendered")] == [
        ("div", -1, "x"), ("em", 0, "w"),
    ]


def test_text_is_cut_and_quotes_escaped(spark):
    page = f"""<p title='a "b"'>{"x" * 150}</p>"""
    assert nodes(spark, page)[0].node_text == f'<p title="a &quot;b&quot;">{"x" * 150}</p>'
    assert nodes(spark, page, text_limit=100)[0].node_text == f'<p title="a &quot;b&quot;">{"x" * 100}</p>'


def test_kept_ancestor_over_skipped_tags(spark):
    got = nodes(spark, "<div><head><em>a</em></head></div>")
    assert [(n.tag, n.parent_idx) for n in got] == [("div", -1), ("em", 0)]


def test_unclosed_items_and_null_page(spark):
    df = spark.createDataFrame([(1, "<ul><li>a<li>b</ul>"), (2, None)], "sample_id int, html string")
    got = html.page_nodes(df).orderBy("sample_id", "node_idx").collect()
    assert [(r.sample_id, r.tag, r.parent_idx) for r in got] == [(1, "ul", -1), (1, "li", 0), (1, "li", 1)]


def test_large_page_in_batches(spark):
    n = 10_000
    df = spark.createDataFrame([(1, "<i>" * n)], "sample_id int, html string")
    got = html.page_nodes(df)
    assert got.count() == n
    assert tree.tree_depth_raw(got.select("sample_id", "node_idx", "parent_idx")).agg({"depth": "max"}).first()[0] == n - 1


def test_page_tags(spark):
    df = spark.createDataFrame([(1, "<Div a='b'><br/>text<p\n id=x></p>")], "sample_id int, html string")
    assert [(r.pos, r.tag) for r in html.page_tags(df).orderBy("pos").collect()] == [(0, "div"), (1, "br"), (2, "p")]


@pytest.mark.parametrize("mask, want", [(0.4, 0), (0.5, 1), (1.0, 1)])
def test_valid_nodes(spark, mask, want):
    assert html.valid_nodes(spark.createDataFrame([(mask,)], "node_mask double")).count() == want
