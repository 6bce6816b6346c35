"""Queries on pages, texts, colours and styles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import style as st
from ..functions import text as tx
from ..functions.constants import INLINE_HEX, INLINE_RGB, NODE_TYPES, SKIP_TAGS, SKIP_TAGS_RENDERED, STYLE_CHOICES, STYLE_NORMS, TAG_TYPES, TEXT_LIMIT
from ..operators import design, html
from ..operators.dataset import align_style_rows
from ..operators.pages import IDX, SID
from . import tables as t
from .node_queries import SQL_STRICT, WITH
from .registry import query, r6

# ---------------------------------------------------------------- raw pages

SQL_TAGS = f"""
listed AS (
SELECT page_id AS sample_id, regexp_extract_all(html, '{tx.START_TAG}', 1) AS tags FROM pages),
tags AS (SELECT sample_id, CAST(unnest(generate_series(0, len(tags) - 1)) AS INT) AS pos, lower(unnest(tags)) AS tag FROM listed)"""


def _pages(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").withColumnRenamed("page_id", SID)


@query("page_tags", f"WITH {SQL_TAGS} SELECT * FROM tags")
def page_tags(spark, sf_dir):
    return html.page_tags(_pages(spark, sf_dir))


_SITE = r"https?://([^/]+)"


@query("tag_frequency", f"""WITH {SQL_TAGS}
SELECT regexp_extract(p.url, '{_SITE}', 1) AS site, tag, count(*) AS n FROM tags JOIN pages p ON p.page_id = sample_id GROUP BY ALL""")
def tag_frequency(spark, sf_dir):
    """Start tags per site."""
    pages = t.table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", _SITE, 1).alias(SID), "html"
    )
    return html.tag_frequency(html.page_tags(pages), SID).withColumnRenamed(SID, "site")


_SQL_TYPE = "coalesce(CASE lower({tag}) " + " ".join(
    f"WHEN '{k}' THEN '{kind}'" for k, kind in TAG_TYPES.items()
) + " END, 'FRAME')"
_SQL_TYPES = "[" + ", ".join(f"'{n}'" for n in NODE_TYPES) + "]"


@query("type_distribution", f"""WITH {SQL_TAGS}
SELECT regexp_extract(p.html, '<html lang="([a-z]+)"', 1) AS lang, {_SQL_TYPE.format(tag='tag')} AS node_type, count(*) AS n
FROM tags JOIN pages p ON p.page_id = sample_id
WHERE tag NOT IN ('html', 'head', 'body', 'script', 'style', 'meta', 'link') GROUP BY ALL""")
def type_distribution(spark, sf_dir):
    """Design types per language, undrawn tags left out."""
    pages = t.table(spark, sf_dir, "pages").select(
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias(SID), "html"
    )
    drawn = html.skip_tags(html.page_tags(pages))
    typed = drawn.withColumn("node_type", tx.node_type(F.col("tag")))
    return html.type_distribution(typed, SID).withColumnRenamed(SID, "lang")


def _sql_parsed(skipped: tuple[str, ...]) -> str:
    """Start tags outside comments, scripts and styles, in order, without those that are not drawn."""
    names = ", ".join(f"'{x}'" for x in skipped)
    return f"""
clean AS (
SELECT page_id AS sample_id, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'),
  '(<script[^>]*>).*?</script>', '\\1', 'gsi'), '(<style[^>]*>).*?</style>', '\\1', 'gsi') AS html FROM pages),
found AS (SELECT sample_id, list_filter(list_transform(regexp_extract_all(html, '{tx.START_TAG}', 1), lambda x: lower(x)),
  lambda x: x NOT IN ({names})) AS tags FROM clean),
parsed AS (
SELECT sample_id, CAST(unnest(range(0, len(tags))) AS INT) AS node_idx, unnest(tags) AS tag FROM found)"""


@query("page_nodes", f"WITH {_sql_parsed(SKIP_TAGS)} SELECT * FROM parsed")
def page_nodes(spark, sf_dir):
    """Every page flattened to its nodes: number and order of the drawn tags."""
    return html.page_nodes(_pages(spark, sf_dir)).select(SID, IDX, "tag")


@query("page_nodes_rendered", f"WITH {_sql_parsed(SKIP_TAGS_RENDERED)} SELECT * FROM parsed")
def page_nodes_rendered(spark, sf_dir):
    """The browser's rules: no ``noscript``, no comments in the text."""
    return html.page_nodes(_pages(spark, sf_dir), mode="rendered").select(SID, IDX, "tag")


@query("page_node_trees", f"""WITH {_sql_parsed(SKIP_TAGS)}
SELECT {_SQL_TYPE.format(tag='tag')} AS node_type, count(*) AS n, CAST(count(*) AS BIGINT) AS n_placed FROM parsed GROUP BY ALL""")
def page_node_trees(spark, sf_dir):
    """Pages to depth and type: parser and tree operators in one plan.  The nodes are parsed once and
    written, as the tree operators read them more than once."""
    from ..operators import tree
    from ..operators.pages import cut

    parsed = html.typed_nodes(html.page_nodes(_pages(spark, sf_dir)).drop("attrs"))
    deep = tree.tree_depth(cut(parsed.select(SID, IDX, "parent_idx", "node_type")))
    return deep.groupBy("node_type").agg(F.count("*").alias("n"), F.count("depth").alias("n_placed"))


# ---------------------------------------------------------------- corpus rows

@query("pick_html", """SELECT doc_id, CAST(length(coalesce(nullif(CASE WHEN lang = 'en' THEN text ELSE '' END, ''), nullif(NULL, ''), source)) AS INT) AS n
FROM documents""")
def pick_html(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    text = F.when(F.col("lang") == "en", F.col("text")).otherwise("")
    html_ = tx.pick_html(text, F.lit(None).cast("string"), F.col("source"))
    return docs.select("doc_id", F.length(html_).alias("n"))


@query("min_length", "SELECT doc_id, n_chars FROM documents WHERE length(text) >= 200")
def min_length(spark, sf_dir):
    from ..operators.dataset import min_length as keep

    return keep(t.table(spark, sf_dir, "documents"), html="text").select("doc_id", "n_chars")


@query("project_meta", """SELECT doc_id AS sample_id, '' AS bbox, CAST(coalesce(quality, 0) AS INT) AS score,
  CAST(CASE WHEN toxic IS NULL THEN 0 ELSE 2 END AS INT) AS n_scale, d.lang, md5(text) AS hash
FROM documents d LEFT JOIN labels USING (doc_id)""")
def project_meta(spark, sf_dir):
    """Documents as corpus rows; quality stands for the score, which many lack."""
    from ..operators.dataset import project_meta as meta

    docs = t.table(spark, sf_dir, "documents").join(t.table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.select(
        F.col("doc_id").alias(SID),
        F.col("quality").alias("score"),
        F.when(F.col("toxic").isNotNull(), F.array("quality", "toxic")).alias("scale"),
        "lang",
        F.md5("text").alias("hash"),
    )
    return meta(rows).withColumn("n_scale", F.size("scale")).drop("scale")


# ---------------------------------------------------------------- serialised nodes

WITH_TEXTS = f"{WITH}, {t.SQL_TEXTS}"


@query("node_tag", f"""{WITH_TEXTS}
SELECT sample_id, node_idx, regexp_extract(node_text, '^<([A-Za-z][\\w-]*)', 1) AS tag,
  trim(split_part(node_text, ' ', 1), '<>') AS loose_tag FROM texts""")
def node_tag(spark, sf_dir):
    """Both readings of a tag: by its name, and as text up to the first blank."""
    text = F.col("node_text")
    return t.texts(spark, sf_dir).select(
        SID, IDX, tx.node_tag(text).alias("tag"), tx.node_tag(text, "reference").alias("loose_tag")
    )


_T1 = "regexp_extract(node_text, '^<([A-Za-z][\\w-]*)', 1)"
_T2 = "trim(split_part(node_text, ' ', 1), '<>')"


@query("node_type", f"""{WITH_TEXTS}, typed AS (
SELECT sample_id, node_idx, {_SQL_TYPE.format(tag=_T1)} AS node_type, {_SQL_TYPE.format(tag=_T2)} AS loose_type FROM texts)
SELECT sample_id, node_idx, node_type, CAST(list_position({_SQL_TYPES}, node_type) - 1 AS INT) AS type_idx, loose_type FROM typed""")
def node_type(spark, sf_dir):
    texts = t.texts(spark, sf_dir)
    strict = html.typed_nodes(texts)
    loose = tx.node_type(tx.node_tag(F.col("node_text"), "reference"))
    return strict.select(SID, IDX, "node_type", "type_idx", loose.alias("loose_type"))


def _sql_attr(name: str, lead: str) -> str:
    return f"""regexp_extract(node_text, '{lead}{name}=["'']([^"'']+)["'']', 1)"""


def _sql_name(lead: str) -> str:
    tag = "regexp_extract(node_text, '^<(\\w+)', 1)"
    first = f"regexp_extract({_sql_attr('class', lead)}, '(\\S+)', 1)"
    return f"""CASE WHEN {_sql_attr('id', lead)} <> '' THEN {tag} || '#' || {_sql_attr('id', lead)}
    WHEN {first} <> '' THEN {tag} || '.' || {first}
    WHEN {_sql_attr('aria-label', lead)} <> '' THEN {tag} || '[' || {_sql_attr('aria-label', lead)} || ']' ELSE {tag} END"""


@query("node_name", f"""{WITH_TEXTS}
SELECT sample_id, node_idx, {_sql_name(r'\s')} AS name, {_sql_name(r'\b')} AS loose_name FROM texts""")
def node_name(spark, sf_dir):
    text, kind = F.col("node_text"), tx.node_type_name(F.col("gold_type"))
    return t.texts(spark, sf_dir).select(
        SID, IDX,
        tx.node_name(text, kind).alias("name"),
        tx.node_name(text, kind, "reference").alias("loose_name"),
    )


@query("serialize_node", f"""{WITH_TEXTS}
SELECT sample_id, node_idx, '<div class="a &quot;' || node_idx || '&quot;" title="t">' || left(trim('  ' || node_text || repeat('x', 90) || ' '), 100)
  || '</div>' AS node_text FROM texts""")
def serialize_node(spark, sf_dir):
    """Attributes with quotes and a text that is trimmed and cut."""
    attrs = F.array(
        F.struct(F.lit("class").alias("name"), F.concat(F.lit('a "'), IDX, F.lit('"')).alias("value")),
        F.struct(F.lit("title").alias("name"), F.lit("t").alias("value")),
    )
    long = F.concat(F.lit("  "), "node_text", F.lit("x" * 90), F.lit(" "))
    return t.texts(spark, sf_dir).select(
        SID, IDX, tx.serialize_node(F.lit("div"), attrs, tx.direct_text(long, TEXT_LIMIT)).alias("node_text")
    )


@query("inline_fill", f"""{WITH_TEXTS}, found AS (
SELECT sample_id, node_idx, regexp_extract(node_text, '{INLINE_HEX}', 1) AS h,
  regexp_extract(node_text, '{INLINE_RGB}', ['r', 'g', 'b']) AS c FROM texts),
full_hex AS (SELECT *, CASE WHEN length(h) = 4 THEN h[2] || h[2] || h[3] || h[3] || h[4] || h[4] ELSE h[2:] END AS x FROM found)
SELECT sample_id, node_idx, CAST(CASE WHEN h <> '' OR c.r <> '' THEN 1 ELSE 0 END AS INT) AS n_fills,
  round(CASE WHEN h <> '' THEN CAST('0x' || x[1:2] AS INT) / 255 ELSE TRY_CAST(c.r AS DOUBLE) / 255 END, 6) AS r,
  round(CASE WHEN h <> '' THEN CAST('0x' || x[3:4] AS INT) / 255 ELSE TRY_CAST(c.g AS DOUBLE) / 255 END, 6) AS g,
  round(CASE WHEN h <> '' THEN CAST('0x' || x[5:6] AS INT) / 255 ELSE TRY_CAST(c.b AS DOUBLE) / 255 END, 6) AS b
FROM full_hex""")
def inline_fill(spark, sf_dir):
    first = F.get("fills", F.lit(0))["color"]
    return st.with_inline_fill(t.texts(spark, sf_dir).select(SID, IDX, "node_text")).select(
        SID, IDX, F.size("fills").alias("n_fills"), *[r6(first[c], c) for c in "rgb"]
    )


# ---------------------------------------------------------------- colours and numbers

@query("parse_color", f"""{WITH}
SELECT sample_id, node_idx, round(CASE WHEN gold_type < 2 THEN NULL ELSE CAST(r * 255 AS INT) / 255 END, 6) AS r,
  round(CASE WHEN gold_type < 2 THEN NULL ELSE CAST(g * 255 AS INT) / 255 END, 6) AS g,
  CASE WHEN gold_type < 2 THEN NULL WHEN gold_type < 5 THEN 1.0 ELSE a / 2 END AS a FROM nodes""")
def parse_color(spark, sf_dir):
    """rgb() and rgba() texts, ``transparent`` and nonsense."""
    def part(c: str):
        return F.round(F.col(c) * 255).cast("int").cast("string")

    inside = F.concat_ws(", ", part("r"), part("g"), part("b"))
    css = (
        F.when(F.col("gold_type") == 0, "transparent")
        .when(F.col("gold_type") == 1, "rgb(1, 2)")
        .when(F.col("gold_type") < 5, F.concat(F.lit("rgb("), inside, F.lit(")")))
        .otherwise(F.concat(F.lit("rgba("), inside, F.lit(", "), (F.col("a") / 2).cast("string"), F.lit(")")))
    )
    color = st.parse_color(css)
    return t.nodes(spark, sf_dir).select(SID, IDX, color.alias("c")).select(
        SID, IDX, r6(F.get("c", F.lit(0)), "r"), r6(F.get("c", F.lit(1)), "g"), F.get("c", F.lit(3)).alias("a")
    )


@query("hex_to_rgba", f"""{WITH}
SELECT sample_id, node_idx, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b,
  round(CAST((x1::INT) % 16 * 17 AS DOUBLE) / 255, 6) AS short_r FROM nodes""")
def hex_to_rgba(spark, sf_dir):
    def two(c: str):
        return F.lpad(F.hex(F.round(F.col(c) * 255).cast("int")), 2, "0")

    long = F.concat(F.lit("#"), two("r"), two("g"), two("b"))
    digit = F.lower(F.hex((F.col("x1") % 16).cast("int")))
    short = F.concat(F.lit("#"), digit, F.lit("00"))
    codes = t.nodes(spark, sf_dir).select(SID, IDX, long.alias("c"), short.alias("s"))
    numbers = codes.select(SID, IDX, *[st.hex_number(F.col(c)).alias(c) for c in "cs"])
    return numbers.select(SID, IDX, *[st.number_to_rgba(F.col(c)).alias(c) for c in "cs"]).select(
        SID, IDX, *[r6(F.get("c", F.lit(i)), n) for i, n in enumerate("rgb")], r6(F.get("s", F.lit(0)), "short_r")
    )


@query("parse_px", f"""{WITH}
SELECT sample_id, node_idx, CASE WHEN gold_type = 0 THEN 0.0::DOUBLE WHEN gold_type = 1 THEN -(x1 + 0.5) ELSE x1 + 0.5 END AS px FROM nodes""")
def parse_px(spark, sf_dir):
    number = (F.col("x1") + 0.5).cast("string")
    css = (
        F.when(F.col("gold_type") == 0, "auto")
        .when(F.col("gold_type") == 1, F.concat(F.lit("-"), number, F.lit("px")))
        .otherwise(F.concat(number, F.lit("px solid 3")))
    )
    return t.nodes(spark, sf_dir).select(SID, IDX, st.parse_px(css).alias("px"))


@query("style_defaults", f"""{WITH}
SELECT sample_id, node_idx, a AS opacity, CASE WHEN a = 0 THEN 1.0 ELSE a END AS loose_opacity,
  coalesce(font_size, 400.0) AS weight, CASE WHEN gold_type = 0 THEN 'start' ELSE 'left' END AS align FROM nodes""")
def style_defaults(spark, sf_dir):
    """Defaults for missing values; the loose rule also replaces a real opacity of 0."""
    align = F.when(F.col("gold_type") == 0, "").otherwise("left")
    return t.nodes(spark, sf_dir).select(
        SID, IDX,
        st.style_default(F.col("a"), 1.0).alias("opacity"),
        st.style_default(F.col("a"), 1.0, falsy_zero=True).alias("loose_opacity"),
        st.style_default(F.col("font_size"), 400.0).alias("weight"),
        st.style_default(align, "start").alias("align"),
    )


_COLORS = [(i, c) for i in range(3) for c in "rgba"]


@query("encode_styles", f"""{WITH}, {t.SQL_STYLED}
SELECT sample_id, node_idx, {', '.join(f'round(t{i}, 6) AS reg{i}, v{i} AS valid{i}' for i in range(5))},
  {', '.join(f'round(c{i}{c}, 6) AS c{i}{c}' for i, c in _COLORS)}, w0, w1, w2,
  CAST(cls_align AS INT) AS "cls_textAlign", CAST(cls_display AS INT) AS cls_display FROM styled""")
def encode_styles(spark, sf_dir):
    rows = t.styled(spark, sf_dir)
    numbers = range(len(STYLE_NORMS))
    return rows.select(
        SID, IDX,
        *[r6(F.get("reg", F.lit(i)), f"reg{i}") for i in numbers],
        *[F.get("reg_valid", F.lit(i)).alias(f"valid{i}") for i in numbers],
        *[r6(F.get(F.get("color", F.lit(i)), F.lit("rgba".index(c))), f"c{i}{c}") for i, c in _COLORS],
        *[F.get("color_valid", F.lit(i)).alias(f"w{i}") for i in range(3)],
        "cls_textAlign", "cls_display",
    )


@query("align_style_rows", f"""{WITH}
SELECT n.sample_id, n.node_idx, s.font_size FROM nodes n
LEFT JOIN (SELECT * FROM nodes WHERE gold_type <> 4) s USING (sample_id, node_idx)""")
def align_style_rows_query(spark, sf_dir):
    """Type 4 has no style rows."""
    nodes = t.nodes(spark, sf_dir)
    rows = nodes.where("gold_type <> 4").select(SID, IDX, "font_size")
    return align_style_rows(nodes.select(SID, IDX), rows)


@query("denormalize_style", f"""{WITH}, {t.SQL_STYLED}
SELECT sample_id, node_idx, round(greatest(0, (p0 - 0.2) * 50), 6) AS "cornerRadius", round(greatest(0, p1 * 10), 6) AS "strokeWeight",
  round(greatest(0, least(1, p2 * 1.5)), 6) AS opacity, round(greatest(0, p3 * 64), 6) AS "fontSize",
  round(greatest(100, least(900, p4 * 2 * 900)), 6) AS "fontWeight" FROM styled""")
def denormalize_style(spark, sf_dir):
    """Predictions pushed past both ends of their ranges."""
    p = [F.get("pred_reg", F.lit(i)) for i in range(5)]
    style = st.denormalize_style(F.array(p[0] - 0.2, p[1], p[2] * 1.5, p[3], p[4] * 2))
    fields = ("cornerRadius", "strokeWeight", "opacity", "fontSize", "fontWeight")
    return t.styled(spark, sf_dir).select(SID, IDX, style.alias("s")).select(
        SID, IDX, *[r6(F.col("s")[f], f) for f in fields]
    )


@query("fills_strokes", f"""{WITH}, {t.SQL_STYLED}
SELECT sample_id, node_idx, CAST(CASE WHEN q0a > 0.05 THEN 1 ELSE 0 END AS INT) AS n_fills,
  round(CASE WHEN q0a > 0.05 THEN q0r END, 6) AS fill_r, CAST(CASE WHEN q2a > 0.05 THEN 1 ELSE 0 END AS INT) AS n_strokes,
  round(CASE WHEN q2a > 0.05 THEN q2r END, 6) AS stroke_r FROM styled""")
def fills_strokes(spark, sf_dir):
    fills, strokes = st.fills_strokes(F.get("pred_color", F.lit(0)), F.get("pred_color", F.lit(2)))
    rows = t.styled(spark, sf_dir).select(SID, IDX, fills.alias("fills"), strokes.alias("strokes"))
    return rows.select(
        SID, IDX,
        F.size("fills").alias("n_fills"),
        r6(F.get("fills", F.lit(0))["color"]["r"], "fill_r"),
        F.size("strokes").alias("n_strokes"),
        r6(F.get("strokes", F.lit(0))["color"]["r"], "stroke_r"),
    )


@query("clamp_rules", f"""{WITH}
SELECT sample_id, node_idx, greatest(0, least(1, a * 1.5)) AS opacity, greatest(0, least(1, a - 0.5)) AS fill_opacity,
  greatest(0, x1 - 50) AS corner_radius, a > 0.5 AS visible FROM nodes""")
def clamp_rules(spark, sf_dir):
    a, x = F.col("a"), F.col("x1")
    rules = st.clamp_rules(a * 1.5, a - 0.5, x - 50, a)
    return t.nodes(spark, sf_dir).select(SID, IDX, rules.alias("c")).select(SID, IDX, "c.*")




@query("argmax_style_class", f"""{WITH}, per_class AS (
SELECT sample_id, node_idx, k.range AS k, (node_idx * 7 + k.range * 5 + sample_id) % 53 AS s FROM nodes, range(6) k)
SELECT sample_id, node_idx, ['start', 'left', 'center', 'right', 'justify', 'end'][k + 1] AS text_align FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id, node_idx ORDER BY s DESC, k) AS rn FROM per_class) WHERE rn = 1""")
def argmax_style_class(spark, sf_dir):
    from ..functions.constants import STYLE_CHOICES

    picked = st.argmax_style_class(F.col("scores_textAlign"), STYLE_CHOICES["textAlign"])
    return t.choice_scores(spark, sf_dir).select(SID, IDX, picked.alias("text_align"))


# ---------------------------------------------------------------- design

def _design_input(spark, sf_dir):
    texts = t.texts(spark, sf_dir)
    return texts.withColumn("type_idx", F.col("pred_type")).withColumn("parent_idx", F.col("pred_parent"))


@query("design_nodes", f"""{WITH_TEXTS}
SELECT sample_id, node_idx, pred_parent AS parent_idx, 'node_' || node_idx AS id, {_sql_name(r'\s')} AS name,
  {_SQL_TYPES}[pred_type + 1] AS type, x1 AS x, y1 AS y, x2 - x1 AS width, y2 - y1 AS height,
  CAST(CASE WHEN gold_type BETWEEN 3 AND 5 THEN 1 ELSE 0 END AS INT) AS n_fills FROM texts""")
def design_nodes(spark, sf_dir):
    flat = design.design_nodes(_design_input(spark, sf_dir))
    return flat.select(
        SID, IDX, "parent_idx", "id", "name", "type", "absoluteBoundingBox.*", F.size("fills").alias("n_fills")
    )


def _sql_choice(key: str, step: int) -> str:
    """Name of the best-scored choice, the first on ties."""
    names = STYLE_CHOICES[key]
    listed = "[" + ", ".join(f"'{c}'" for c in names) + "]"
    scores = f"list_transform(range({len(names)}), lambda k: (node_idx * 7 + k * {step} + sample_id) % 53)"
    return f'{listed}[list_position({scores}, list_max({scores}))] AS "{key}"'


_NORM = list(STYLE_NORMS.values())


@query("design_nodes_styled", f"""{WITH}, {t.SQL_STYLED}
SELECT sample_id, node_idx, pred_parent AS parent_idx, {_SQL_TYPES}[pred_type + 1] AS type,
  round(greatest(p0 * {_NORM[0]}, 0), 6) AS corner, round(greatest(p1 * {_NORM[1]}, 0), 6) AS stroke,
  round(greatest(least(p2 * {_NORM[2]}, 1), 0), 6) AS opacity, round(greatest(p3 * {_NORM[3]}, 0), 6) AS font_size,
  round(greatest(least(p4 * {_NORM[4]}, 900), 100), 6) AS font_weight,
  CAST(CASE WHEN q0a > 0.05 THEN 1 ELSE 0 END AS INT) AS n_fills, CAST(CASE WHEN q2a > 0.05 THEN 1 ELSE 0 END AS INT) AS n_strokes,
  {_sql_choice('textAlign', 5)}, {_sql_choice('display', 11)}
FROM styled""")
def design_nodes_styled(spark, sf_dir):
    """Flat design rows with predicted numbers, colours and style choices."""
    rows = t.choice_scores(spark, sf_dir).withColumns(
        {
            "type_idx": F.col("pred_type"),
            "parent_idx": F.col("pred_parent"),
            "node_text": F.lit("<div>"),
            "reg": F.col("pred_reg"),
            "color": F.col("pred_color"),
        }
    )
    flat = design.design_nodes(rows)
    return flat.select(
        SID, IDX, "parent_idx", "type", r6("cornerRadius", "corner"), r6("strokeWeight", "stroke"), r6("opacity", "opacity"),
        r6("style.fontSize", "font_size"), r6("style.fontWeight", "font_weight"),
        F.size("fills").alias("n_fills"), F.size("strokes").alias("n_strokes"), *[f"style.{k}" for k in STYLE_CHOICES],
    )


@query("to_design_tree", f"""{WITH_TEXTS}
SELECT c.sample_id, 'node_' || c.node_idx AS id, {_sql_name(r'\s').replace('node_text', 'c.node_text').replace('pred_type', 'c.pred_type')} AS name,
  {_SQL_TYPES}[c.pred_type + 1] AS type, 'node_' || p.node_idx AS parent,
  CAST(row_number() OVER (PARTITION BY c.sample_id, coalesce(p.node_idx, -1) ORDER BY c.node_idx) - 1 AS INT) AS place
FROM texts c LEFT JOIN texts p ON p.sample_id = c.sample_id AND p.node_idx = c.pred_parent""")
def to_design_tree(spark, sf_dir):
    """Nested documents, read back to one row per node."""
    flat = design.design_nodes(_design_input(spark, sf_dir))
    return design.read_design_tree(design.to_design_tree(flat))


@query("heuristic_predict", f"""{WITH_TEXTS}, {SQL_STRICT}, typed AS (
SELECT sample_id, node_idx, {_SQL_TYPE.format(tag=_T1)} AS node_type FROM texts)
SELECT sample_id, node_idx, CAST(list_position({_SQL_TYPES}, node_type) - 1 AS INT) AS type_idx, box_parent AS parent_idx
FROM typed JOIN boxed USING (sample_id, node_idx)""")
def heuristic_predict(spark, sf_dir):
    rows = t.texts(spark, sf_dir).select(SID, IDX, "node_text", "x1", "y1", "x2", "y2")
    found = design.heuristic_predict(rows, **t.page_sizes(spark, sf_dir))
    return found.select(SID, IDX, "type_idx", "parent_idx")


@query("visible_nodes", f"""{WITH}, {t.SQL_STYLES}
SELECT sample_id, node_idx FROM styles WHERE display <> 'none' AND a > 0 AND x1 <> x2 AND y1 <> y2""")
def visible_nodes(spark, sf_dir):
    """Alpha 0 stands for a hidden node."""
    rows = t.styles(spark, sf_dir).withColumn(
        "visibility", F.when(F.col("a") > 0, "visible").otherwise("hidden")
    )
    return html.visible_nodes(rows).select(SID, IDX)


@query("valid_nodes", f"{WITH} SELECT sample_id, node_idx FROM nodes WHERE a >= 0.5")
def valid_nodes(spark, sf_dir):
    return html.valid_nodes(t.nodes(spark, sf_dir), "a").select(SID, IDX)
