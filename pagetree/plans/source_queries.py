"""Queries on the JSON that samples and logs are stored in, written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree
from ..operators.pages import IDX, SID, shared_folder
from ..sources import readers, writers
from . import tables as t
from .node_queries import SQL_CHAIN, WITH
from .registry import query, r6


def _page_json(rows, value):
    """(sample_id, value): a JSON array of a value of each node of a page, in node order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(IDX, value.alias("v")))), lambda n: n["v"])
    return rows.groupBy(SID).agg(F.to_json(listed).alias("value"))


@query("json_node_lists", f"{WITH}, {t.SQL_TEXTS} SELECT sample_id, node_idx, node_text FROM texts")
def json_node_lists(spark, sf_dir):
    return readers.parse_node_lists(_page_json(t.texts(spark, sf_dir), F.col("node_text")))


@query("json_styles", f"""{WITH}, {t.SQL_STYLES}
SELECT sample_id, node_idx, border_radius, font_size, font_weight, text_align, display, CASE WHEN has_color THEN round(b, 6) END AS color_r,
  has_border AS has_border FROM styles""")
def json_styles(spark, sf_dir):
    parsed = readers.parse_styles(_page_json(t.styles(spark, sf_dir), F.col("style")))
    style = F.col("style")
    return parsed.select(
        SID, IDX, style["borderRadius"].alias("border_radius"), style["fontSize"].alias("font_size"),
        style["fontWeight"].cast("double").alias("font_weight"), style["textAlign"].alias("text_align"), style["display"].alias("display"),
        r6(F.get(style["color"], F.lit(0)), "color_r"), style["borderColor"].isNotNull().alias("has_border"),
    )


@query("json_meta", """
SELECT page_id AS sample_id, url || ' "' || length(html) || '"' AS bbox, CAST(page_id % 5 AS INT) AS score,
  CASE WHEN page_id % 3 > 0 THEN length(html)::INT END AS width, CASE WHEN page_id % 3 > 0 THEN 'en' END AS lang, page_id % 3 = 0 AS broken
FROM pages""")
def json_meta(spark, sf_dir):
    """Metadata of the pages, every third text cut off inside the scale."""
    pages = t.table(spark, sf_dir, "pages")
    fields = F.struct(
        F.concat("url", F.lit(' "'), F.length("html").cast("string"), F.lit('"')).alias("bbox"), (F.col("page_id") % 5).cast("int").alias("score"),
        F.array(F.length("html"), F.lit(800)).alias("scale"), F.lit("en").alias("lang"), F.md5("html").alias("hash"),
    )
    whole = F.to_json(fields)
    cut = F.concat(F.substring_index(whole, '"scale":[', 1), F.lit('"scale":['))
    files = pages.select(F.col("page_id").alias(SID), F.when(F.col("page_id") % 3 == 0, cut).otherwise(whole).alias("value"))
    meta = readers.parse_meta(files)
    return meta.select(SID, "bbox", "score", F.get("scale", F.lit(0)).alias("width"), "lang", F.col("_corrupt_record").isNotNull().alias("broken"))


@query("json_run_log", f"""WITH {t.SQL_LOG}
SELECT run, seq, epoch, phase, total, round(type_acc, 6) AS type_acc FROM log WHERE seq % 7 <> 3""")
def json_run_log(spark, sf_dir):
    """Log lines, every seventh of them no JSON."""
    log = t.run_log(spark, sf_dir)
    fields = F.map_concat(
        F.create_map(F.lit("epoch"), F.col("epoch").cast("string"), F.lit("phase"), F.col("phase")),
        F.transform_values("metrics", lambda k, v: v.cast("string")),
    )
    line = F.when(F.col("seq") % 7 == 3, "Traceback: no record").otherwise(F.to_json(fields))
    parsed = readers.parse_log_lines(log.select("run", "seq", line.alias("value")))
    value = {m: F.try_element_at("metrics", F.lit(m)) for m in ("total", "type_acc")}
    return parsed.select("run", "seq", "epoch", "phase", value["total"].alias("total"), r6(value["type_acc"], "type_acc"))


@query("explode_bbox_tree", r"""WITH tags AS (
SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag,
  unnest(range(len(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)))) AS k FROM pages),
listed AS (
SELECT page_id, 2 * k AS i, CASE WHEN k = 0 THEN -1 ELSE 2 * k - 2 END AS p, tag, k::VARCHAR AS inner_text, NULL AS inline_style,
  k AS x1, 2 * k AS y1, k + 10 AS x2, 2 * k + 20 AS y2 FROM tags
UNION ALL SELECT page_id, 2 * k + 1, 2 * k, 'leaf', 'say "' || tag || '"', 'a:b', 0, 0, k, 1 FROM tags)
SELECT page_id AS sample_id, i::INT AS node_idx, p::INT AS parent_idx, tag, inner_text, inline_style,
  round(least(224, x1 * 0.175::DOUBLE), 6) AS x1, round(least(224, y1 * 0.28::DOUBLE), 6) AS y1,
  round(least(224, x2 * 0.175::DOUBLE), 6) AS x2, round(least(224, y2 * 0.28::DOUBLE), 6) AS y2
FROM listed""")
def explode_bbox_tree(spark, sf_dir):
    """Each page's tags as a tree in which every tag holds a leaf and the next tag."""
    tags = F.expr("transform(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1), (x, i) -> struct(x AS tag, i AS k))")

    def around(inner, n):
        k = n["k"].cast("string")
        box = F.concat_ws(",", k, (n["k"] * 2).cast("string"), F.lit("10"), F.lit("20"))
        leaf = F.concat(
            F.lit('{"type":"leaf","content":"say \\"'), n["tag"], F.lit('\\"","style":"a:b","bbox":[0,0,'), k, F.lit(',1],"children":[]}')
        )
        children = F.when(inner == "", leaf).otherwise(F.concat(leaf, F.lit(","), inner))
        return F.concat(
            F.lit('{"type":"'), n["tag"], F.lit('","content":"'), k, F.lit('","style":null,"bbox":['), box, F.lit('],"children":['), children, F.lit("]}")
        )

    text = F.aggregate(F.reverse(tags), F.lit(""), around)
    found = readers.explode_bbox_tree(t.table(spark, sf_dir, "pages").select(F.col("page_id").alias(SID), text.alias("bbox")))
    return found.withColumns({c: F.round(c, 6) for c in ("x1", "y1", "x2", "y2")})


@query("node_table_depth", f"""{WITH}, {SQL_CHAIN.format(p='pred_parent')}
SELECT sample_id, node_idx, depth FROM chain""")
def node_table_depth(spark, sf_dir):
    """Depths read off a table of sorted buckets."""
    name = "nodes_" + shared_folder(spark).rsplit("-", 1)[1]
    writers.save_node_table(t.nodes(spark, sf_dir).select(SID, IDX, "pred_parent"), name, shared_folder(spark), buckets=16)
    deep = tree.tree_depth_raw(spark.table(name), "pred_parent", **t.page_sizes(spark, sf_dir))
    return deep.select(SID, IDX, "depth")
