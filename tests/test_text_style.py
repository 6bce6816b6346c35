import pytest
from pyspark.sql import functions as F

from pagetree.functions import style as st
from pagetree.functions import text as tx


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, want",
    [
        ('<nav style="background:#333">', (0.2, 0.2, 0.2)),
        ('<div style="background-color:#ff0000">', (1.0, 0.0, 0.0)),
        ('<p style="color:rgb(0, 128, 255)">', (0.0, 128 / 255, 1.0)),
        ('<p style="color:rgb(9, 9, 9); background: #00f">', (0.0, 0.0, 1.0)),
    ],
)
def test_inline_fill(spark, text, want):
    fills = one(spark, text, st.inline_fill)
    assert len(fills) == 1 and fills[0].type == "SOLID" and fills[0].color.a == 1.0
    assert (fills[0].color.r, fills[0].color.g, fills[0].color.b) == pytest.approx(want)


@pytest.mark.parametrize("text", ['<div class="foo">', ""])
def test_no_inline_fill(spark, text):
    assert one(spark, text, st.inline_fill) == []


@pytest.mark.parametrize(
    "text, kind, want, loose",
    [
        ('<nav id="main-nav">', "FRAME", "nav#main-nav", None),
        ('<button class="btn-primary big">', "INSTANCE", "button.btn-primary", None),
        ('<div aria-label="hero section">', "FRAME", "div[hero section]", None),
        ("<section>", "FRAME", "section", None),
        ("some plain text", "TEXT", "TEXT", None),
        ('<div id="root" class="container">', "FRAME", "div#root", None),
        ('<div data-id="x">', "FRAME", "div", "div#x"),
    ],
)
def test_node_name(spark, text, kind, want, loose):
    assert one(spark, text, lambda v: tx.node_name(v, F.lit(kind))) == want
    assert one(spark, text, lambda v: tx.node_name(v, F.lit(kind), "reference")) == (loose or want)


@pytest.mark.parametrize(
    "text, tag, loose",
    [("<a></a>", "a", "a></a"), ("<p>Play and</p>", "p", "p>Play"), ('<img src="x"></img>', "img", "img")],
)
def test_node_tag(spark, text, tag, loose):
    assert one(spark, text, tx.node_tag) == tag
    assert one(spark, text, lambda v: tx.node_tag(v, "reference")) == loose


def test_node_type(spark):
    for tag, kind, index in (("A", "INSTANCE", 8), ("h3", "TEXT", 2), ("img", "RECTANGLE", 3), ("b", "FRAME", 0)):
        assert one(spark, tag, tx.node_type) == kind
        assert one(spark, kind, tx.node_type_index) == index


@pytest.mark.parametrize(
    "css, want",
    [
        ("rgb(255, 0, 51)", [1.0, 0.0, 0.2, 1.0]),
        ("rgba(0, 0, 255, 0.5)", [0.0, 0.0, 1.0, 0.5]),
        ("transparent", None),
        ("none", None),
        ("rgb(1, 2)", None),
        (None, None),
    ],
)
def test_parse_color(spark, css, want):
    got = one(spark, css, st.parse_color)
    assert got is None if want is None else got == pytest.approx(want)


@pytest.mark.parametrize("css, want", [("12px", 12.0), ("-3.5px 4px", -3.5), ("auto", 0.0), (None, 0.0), ("", 0.0)])
def test_parse_px(spark, css, want):
    assert one(spark, css, st.parse_px) == want


def test_encode_styles(spark):
    style = (
        "struct<backgroundColor:array<double>,color:array<double>,borderColor:array<double>,borderRadius:double,"
        "borderWidth:double,opacity:double,fontSize:double,fontWeight:double,textAlign:string,display:string>"
    )
    full = ([0.1, 0.2, 0.3, 0.0], [0.0, 0.0, 0.0, 1.0], None, 9999.0, -1.0, 0.0, 16.0, None, "center", "ruby")
    row = spark.createDataFrame([(full,)], f"s {style}").select(st.encode_styles_struct(F.col("s")).alias("e")).first().e
    assert row.reg == [1.0, 0.0, 0.0, 0.25, 0.0] and row.reg_valid == [1.0, 1.0, 1.0, 1.0, 0.0]
    assert row.color == [[0.1, 0.2, 0.3, 0.0], [0.0, 0.0, 0.0, 1.0], [0.0] * 4]
    assert row.color_valid == [0.0, 1.0, 0.0] and row.cls_textAlign == 2 and row.cls_display == 0


def test_missing_style_row_encodes_to_zeros(spark):
    empty = spark.range(1).select(F.lit(None).cast(st.STYLE_SCHEMA).alias("s"))
    row = empty.select(st.encode_styles_struct(F.col("s")).alias("e")).first().e
    assert row.reg == [0.0] * 5 and row.reg_valid == [0.0] * 5
    assert row.color == [[0.0] * 4] * 3 and row.color_valid == [0.0] * 3 and row.cls_display == 0


def test_pick_html_skips_empty_and_null(spark):
    df = spark.createDataFrame([("", None, "c"), (None, "b", "c"), ("a", "b", "c")], "t string, h string, c string")
    got = df.select(tx.pick_html(F.col("t"), F.col("h"), F.col("c")).alias("r")).collect()
    assert [r.r for r in got] == ["c", "b", "a"]


CODES = ("#fff", "#0a8", "#12345", "#12345z", "#1234", "#123456", "#1234567", "#12345678", "##abc", "abc", "#AbCdEf", "#gggggg", "#ab\n", "#abc\n",
         "#1", "", "#", "#abcé", "#é00", "#00000", "#a\nb", "#12345 ", None)


def _rgba(code):
    """By the rules: signs off the front, three characters doubled, five digits needed, pairs from the left."""
    if code is None:
        return None
    digits = code.lstrip("#")
    if len(digits) == 3:
        digits = "".join(c if c == "\n" else c + c for c in digits)
    hexes = "0123456789abcdefABCDEF"
    if len(digits) < 5 or any(c not in hexes for c in digits[:5]):
        return None
    last = digits[4:6] if digits[5:6] and digits[5] in hexes else digits[4]
    return [int(digits[0:2], 16) / 255, int(digits[2:4], 16) / 255, int(last, 16) / 255, 1.0]


def test_hex_numbers_in_generated_code(spark):
    """The colour of a code in steps without a lambda, as in one expression."""
    df = spark.createDataFrame([(c,) for c in CODES], "c string")
    steps = df.select("c", st.hex_number(F.col("c")).alias("n")).select("c", "n", st.number_to_rgba(F.col("n")).alias("rgba"))
    assert "lambda" not in steps._jdf.queryExecution().toString()
    for r in steps.withColumn("one", st.hex_to_rgba(F.col("c"))).collect():
        assert r.rgba == r.one == _rgba(r.c), r.c


TEXTS = ('<a style="color:#333">', '<a style="color:#12345">', '<a style="color:#1234">', '<a style="color: rgb(1,2,300)">', "color:rgb(1,2)", "#fff",
         '<a style="color:#1; color:rgb(9, 8, 7)">', '<a style="background : #abcdef; color:rgb(9, 8, 7)">', "rgb(1,2,3)", "", None)


def test_inline_fills_without_lambdas(spark):
    """Fills of a column of texts in steps, as in one expression."""
    df = spark.createDataFrame([(t,) for t in TEXTS], "node_text string")
    steps = st.with_inline_fill(df)
    assert "lambda" not in steps._jdf.queryExecution().toString()
    found = steps.withColumn("one", st.inline_fill(F.col("node_text"))).collect()
    assert [r.fills for r in found] == [r.one for r in found]
    assert [len(r.fills) for r in found] == [1, 1, 0, 1, 0, 0, 1, 1, 0, 0, 0]
    assert found[6].fills[0].color.r == pytest.approx(9 / 255) and found[3].fills[0].color.b == pytest.approx(300 / 255)
