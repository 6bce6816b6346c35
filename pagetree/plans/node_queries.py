"""Queries on boxes and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import boxes, tree
from ..operators.pages import IDX, SID
from . import tables as t
from .registry import query, r6

WITH = f"WITH RECURSIVE {t.SQL_NODES}"
SQL_CHAIN = """
chain AS (
SELECT sample_id, node_idx, 0 AS depth, [node_idx] AS path FROM nodes WHERE {p} < 0
UNION ALL
SELECT n.sample_id, n.node_idx, c.depth + 1, list_append(c.path, n.node_idx)
FROM nodes n JOIN chain c ON n.sample_id = c.sample_id AND n.{p} = c.node_idx)"""


# ---------------------------------------------------------------- geometry

@query("scale_box", f"""{WITH}
SELECT sample_id, node_idx,
  round(greatest(0, least(224, x1 * 8 * 0.175::DOUBLE)), 6) AS sx1,
  round(greatest(0, least(224, (y1 - 20) * 4 * 0.28::DOUBLE)), 6) AS sy1,
  round(greatest(0, least(224, x2 * 8 * 0.175::DOUBLE)), 6) AS sx2,
  round(greatest(0, least(224, y2 * 4 * 0.28::DOUBLE)), 6) AS sy2
FROM nodes""")
def scale_box(spark, sf_dir):
    pixels = (F.col("x1") * 8, (F.col("y1") - 20) * 4, F.col("x2") * 8, F.col("y2") * 4)
    fitted = g.scale_box(pixels)
    return t.nodes(spark, sf_dir).select(
        SID, IDX, *[r6(c, f"s{e}") for e, c in zip(boxes.EDGES, fitted)]
    )


@query("patch_grid", f"""{WITH}
SELECT CAST(p.range AS INT) AS patch_idx, (p.range % 14) * 16.0::DOUBLE AS x1, (p.range // 14) * 16.0::DOUBLE AS y1,
  (p.range % 14) * 16.0::DOUBLE + 16 AS x2, (p.range // 14) * 16.0::DOUBLE + 16 AS y2, count(n.sample_id) AS n_corners
FROM range(196) p LEFT JOIN nodes n
  ON floor(n.x1 / 16) = p.range % 14 AND floor(n.y1 / 16) = p.range // 14
GROUP BY ALL""")
def patch_grid(spark, sf_dir):
    """The grid with the number of boxes whose top left corner lies in each patch."""
    cell = (F.floor(F.col("y1") / 16) * 14 + F.floor(F.col("x1") / 16)).cast("int")
    corners = t.nodes(spark, sf_dir).groupBy(cell.alias("patch_idx")).agg(F.count("*").alias("n_corners"))
    return boxes.patch_grid(spark).join(corners, "patch_idx", "left").na.fill(0, ["n_corners"])


@query("box_relations", f"""{WITH},
pairs AS (
SELECT c.*, p.x1 AS px1, p.y1 AS py1, p.x2 AS px2, p.y2 AS py2,
  greatest(0, least(c.x2, p.x2) - greatest(c.x1, p.x1)) * greatest(0, least(c.y2, p.y2) - greatest(c.y1, p.y1)) AS inter,
  (c.x2 - c.x1) * (c.y2 - c.y1) AS area, (p.x2 - p.x1) * (p.y2 - p.y1) AS parent_area
FROM nodes c JOIN nodes p ON c.sample_id = p.sample_id AND c.gold_parent = p.node_idx)
SELECT sample_id, node_idx, inter AS intersection, area, x2 - x1 AS width, y2 - y1 AS height,
  round(CASE WHEN inter > 0 AND least(area, parent_area) <> 0 THEN inter / least(area, parent_area) ELSE 0 END, 6) AS overlap,
  round(CASE WHEN inter > 0 THEN inter / (area + parent_area - inter) ELSE 0 END, 6) AS iou,
  px1 <= x1 AND py1 <= y1 AND px2 >= x2 AND py2 >= y2 AS inside
FROM pairs""")
def box_relations(spark, sf_dir):
    """Every node against its parent: shared area, overlap coefficient, IoU, containment."""
    nodes = t.nodes(spark, sf_dir).select(SID, IDX, "gold_parent", *boxes.EDGES)
    above = nodes.select(
        SID, F.col(IDX).alias("gold_parent"), *[F.col(e).alias(f"p{e}") for e in boxes.EDGES]
    )
    own, outer = g.box(), g.box("p")
    xywh = g.box_to_xywh(own)
    return nodes.where("gold_parent >= 0").join(above, [SID, "gold_parent"]).select(
        SID, IDX,
        g.intersection_area(own, outer).alias("intersection"),
        g.box_area(own).alias("area"),
        xywh["width"].alias("width"),
        xywh["height"].alias("height"),
        r6(g.overlap_coefficient(own, outer), "overlap"),
        r6(g.bbox_iou(own, outer), "iou"),
        g.contains(outer, own).alias("inside"),
    )


# ---------------------------------------------------------------- box joins

@query("align_nodes_patches", f"""{WITH}, {t.SQL_PATCHES}
SELECT sample_id, node_idx, count(*) AS n_patches, CAST(min(p) AS INT) AS first_patch, CAST(max(p) AS INT) AS last_patch,
  round(sum(overlap), 6) AS overlap
FROM cells WHERE overlap >= 0.3 GROUP BY ALL""")
def align_nodes_patches(spark, sf_dir):
    """Patches per node at the default threshold."""
    pairs = boxes.align_nodes_patches(t.nodes(spark, sf_dir))
    return pairs.groupBy(SID, IDX).agg(
        F.count("*").alias("n_patches"),
        F.min("patch_idx").alias("first_patch"),
        F.max("patch_idx").alias("last_patch"),
        r6(F.sum("score"), "overlap"),
    )


@query("label_threshold", f"""{WITH}, {t.SQL_PATCHES}
SELECT p AS patch_idx, count(*) AS n, count(*) FILTER (overlap >= 0.8) AS n_strict FROM cells WHERE overlap >= 0.3 GROUP BY p""")
def label_threshold(spark, sf_dir):
    """Nodes per patch at the thresholds 0.3 and 0.8."""
    pairs = boxes.align_nodes_patches(t.nodes(spark, sf_dir))
    loose = boxes.label_threshold(pairs, 0.3)
    return loose.groupBy("patch_idx").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.8).alias("n_strict"))


SQL_BOXED = """
boxed AS (
SELECT sample_id, node_idx, CAST(coalesce(box_parent, -1) AS INT) AS box_parent FROM (
  SELECT c.sample_id, c.node_idx, o.node_idx AS box_parent,
    row_number() OVER (PARTITION BY c.sample_id, c.node_idx
      ORDER BY (o.x2 - o.x1) * (o.y2 - o.y1) NULLS LAST, o.node_idx) AS k
  FROM nodes c LEFT JOIN nodes o ON c.sample_id = o.sample_id AND c.node_idx <> o.node_idx
    AND o.x1 <= c.x1 AND o.y1 <= c.y1 AND o.x2 >= c.x2 AND o.y2 >= c.y2 {strict}) WHERE k = 1)"""
STRICT = """AND ((o.x2 - o.x1) * (o.y2 - o.y1) > (c.x2 - c.x1) * (c.y2 - c.y1)
      OR ((o.x2 - o.x1) * (o.y2 - o.y1) = (c.x2 - c.x1) * (c.y2 - c.y1) AND o.node_idx < c.node_idx))"""
SQL_STRICT, SQL_LOOSE = SQL_BOXED.format(strict=STRICT), SQL_BOXED.format(strict="")


def _boxed(spark, sf_dir, mode="strict"):
    nodes = t.nodes(spark, sf_dir).select(SID, IDX, *boxes.EDGES)
    return boxes.parent_by_containment(nodes, mode, **t.page_sizes(spark, sf_dir)).select(
        SID, IDX, "box_parent"
    )


@query("parent_by_containment", f"{WITH}, {SQL_STRICT} SELECT * FROM boxed")
def parent_by_containment(spark, sf_dir):
    return _boxed(spark, sf_dir)


@query("parent_by_containment_reference", f"{WITH}, {SQL_LOOSE} SELECT * FROM boxed")
def parent_by_containment_reference(spark, sf_dir):
    return _boxed(spark, sf_dir, "reference")


SQL_BOX_DEPTH = """
{boxed}, deep AS (
SELECT sample_id, node_idx, 0 AS depth FROM boxed WHERE box_parent < 0
UNION ALL
SELECT n.sample_id, n.node_idx, d.depth + 1 FROM boxed n JOIN deep d
  ON n.sample_id = d.sample_id AND n.box_parent = d.node_idx)
SELECT n.sample_id, n.node_idx, d.depth, d.depth IS NULL AS is_cyclic
FROM boxed n LEFT JOIN deep d USING (sample_id, node_idx)"""


@query("containment_depth", f"{WITH}, {SQL_BOX_DEPTH.format(boxed=SQL_STRICT)}")
def containment_depth(spark, sf_dir):
    found = _boxed(spark, sf_dir)
    return tree.tree_depth(found, "box_parent", **t.page_sizes(spark, sf_dir)).drop("box_parent")


@query("containment_cycles", f"{WITH}, {SQL_BOX_DEPTH.format(boxed=SQL_LOOSE)}")
def containment_cycles(spark, sf_dir):
    """Depth over the reference rule's parents, where identical boxes hold each other."""
    found = _boxed(spark, sf_dir, "reference")
    return tree.tree_depth(found, "box_parent", **t.page_sizes(spark, sf_dir)).drop("box_parent")


# ---------------------------------------------------------------- trees

@query("tree_depth", f"""{WITH}, {SQL_CHAIN.format(p='gold_parent')}
SELECT sample_id, node_idx, least(depth, 31) AS depth, false AS is_cyclic FROM chain""")
def tree_depth(spark, sf_dir):
    nodes = t.nodes(spark, sf_dir).select(SID, IDX, "gold_parent")
    return tree.tree_depth(nodes, "gold_parent", **t.page_sizes(spark, sf_dir)).drop("gold_parent")


@query("tree_depth_raw", f"""{WITH}, {SQL_CHAIN.format(p='pred_parent')}
SELECT sample_id, node_idx, depth FROM chain""")
def tree_depth_raw(spark, sf_dir):
    nodes = t.nodes(spark, sf_dir).select(SID, IDX, "pred_parent")
    deep = tree.tree_depth_raw(nodes, "pred_parent", **t.page_sizes(spark, sf_dir))
    return deep.select(SID, IDX, "depth")


@query("depth_histogram", f"""{WITH}, {SQL_CHAIN.format(p='gold_parent')},
{SQL_CHAIN.format(p='pred_parent').replace('chain', 'chain2')}
SELECT depth, count(*) AS n, 'gold' AS side FROM chain GROUP BY depth
UNION ALL SELECT depth, count(*), 'pred' FROM chain2 GROUP BY depth""")
def depth_histogram(spark, sf_dir):
    return tree.depth_histogram(t.nodes(spark, sf_dir), **t.page_sizes(spark, sf_dir))


@query("sibling_index", f"""{WITH}
SELECT sample_id, node_idx, CAST(least(row_number() OVER (PARTITION BY sample_id, gold_parent ORDER BY node_idx) - 1, 31) AS INT)
  AS sibling_idx FROM nodes""")
def sibling_index(spark, sf_dir):
    nodes = t.nodes(spark, sf_dir).select(SID, IDX, "gold_parent")
    return tree.sibling_index(nodes, "gold_parent", **t.page_sizes(spark, sf_dir)).drop("gold_parent")


@query("child_list", f"""{WITH}
SELECT sample_id, gold_parent, node_idx,
  CAST(row_number() OVER (PARTITION BY sample_id, gold_parent ORDER BY node_idx) - 1 AS INT) AS place
FROM nodes WHERE gold_parent >= 0""")
def child_list(spark, sf_dir):
    return tree.child_list(t.nodes(spark, sf_dir), "gold_parent", **t.page_sizes(spark, sf_dir))


@query("children_of", f"""{WITH}
SELECT p.sample_id, p.node_idx, count(*) AS n_children, CAST(max(c.node_idx) AS INT) AS last_child
FROM nodes p JOIN nodes c ON p.sample_id = c.sample_id AND c.gold_parent = p.node_idx GROUP BY ALL""")
def children_of(spark, sf_dir):
    pairs = tree.children_of(t.nodes(spark, sf_dir), "gold_parent")
    return pairs.groupBy(SID, IDX).agg(
        F.count("*").alias("n_children"), F.max("child_idx").alias("last_child")
    )


@query("root_nodes", f"""{WITH}
SELECT sample_id, node_idx FROM nodes n WHERE NOT EXISTS (
  SELECT 1 FROM nodes p WHERE p.sample_id = n.sample_id AND p.node_idx = n.pred_parent)""")
def root_nodes(spark, sf_dir):
    return tree.root_nodes(t.nodes(spark, sf_dir), "pred_parent").select(SID, IDX)


@query("root_count", f"""{WITH}
SELECT sample_id, count(*) FILTER (gold_parent < 0) AS n_roots FROM nodes GROUP BY sample_id""")
def root_count(spark, sf_dir):
    return tree.root_count(t.nodes(spark, sf_dir), "gold_parent")


SQL_KEPT = """
up AS (
SELECT sample_id, node_idx, gold_parent AS at FROM nodes
UNION ALL
SELECT u.sample_id, u.node_idx, p.gold_parent FROM up u JOIN nodes p
  ON p.sample_id = u.sample_id AND p.node_idx = u.at WHERE p.gold_type % 2 = 1),
kept AS (
SELECT u.sample_id, u.node_idx, u.at AS kept_parent FROM up u LEFT JOIN nodes p
  ON p.sample_id = u.sample_id AND p.node_idx = u.at WHERE u.at < 0 OR p.gold_type % 2 = 0)"""


@query("nearest_kept_ancestor", f"{WITH}, {SQL_KEPT} SELECT * FROM kept")
def nearest_kept_ancestor(spark, sf_dir):
    """Closest ancestor of an even type."""
    flagged = t.nodes(spark, sf_dir).select(
        SID, IDX, "gold_parent", (F.col("gold_type") % 2 == 0).alias("keep")
    )
    found = tree.nearest_kept_ancestor(flagged, "keep", "gold_parent", **t.page_sizes(spark, sf_dir))
    return found.select(SID, IDX, "kept_parent")


@query("reindex_parents", f"""{WITH}, {SQL_KEPT},
new AS (
SELECT sample_id, node_idx, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY node_idx) - 1 AS INT) AS new_idx
FROM nodes WHERE gold_type % 2 = 0)
SELECT n.sample_id, n.node_idx, n.new_idx, coalesce(p.new_idx, -1) AS new_parent
FROM new n JOIN kept k USING (sample_id, node_idx)
LEFT JOIN new p ON p.sample_id = n.sample_id AND p.node_idx = k.kept_parent""")
def reindex_parents(spark, sf_dir):
    nodes = t.nodes(spark, sf_dir)
    sizes = t.page_sizes(spark, sf_dir)
    even = nodes.where("gold_type % 2 = 0").select(SID, IDX, F.lit(-1).alias("all"))
    kept = tree.sibling_index(even, "all", None, "new_idx", **sizes).drop("all")
    return tree.reindex_parents(nodes, kept, "gold_parent", **sizes)


@query("subtree_size", f"""{WITH}, {SQL_CHAIN.format(p='gold_parent')}
SELECT sample_id, CAST(above AS INT) AS node_idx, count(*) AS subtree_size
FROM (SELECT sample_id, unnest(path) AS above FROM chain) GROUP BY ALL""")
def subtree_size(spark, sf_dir):
    return tree.subtree_size(t.nodes(spark, sf_dir), "gold_parent", **t.page_sizes(spark, sf_dir))


@query("tree_size", f"{WITH} SELECT sample_id, count(*) + 1 AS tree_size FROM nodes GROUP BY sample_id")
def tree_size(spark, sf_dir):
    return tree.tree_size(t.nodes(spark, sf_dir))


SQL_CUT = f"""{SQL_CHAIN.format(p='gold_parent')},
ranked AS (
SELECT n.sample_id, n.node_idx, n.gold_parent, count(*) OVER (PARTITION BY n.sample_id) AS size,
  row_number() OVER (PARTITION BY n.sample_id ORDER BY c.depth, c.path) - 1 AS bfs
FROM nodes n JOIN chain c USING (sample_id, node_idx)),
cut AS (
SELECT sample_id, node_idx, gold_parent, CAST(CASE WHEN size <= 4 THEN node_idx ELSE bfs END AS INT) AS new_idx
FROM ranked WHERE size <= 4 OR bfs < 4)"""


@query("bfs_truncate", f"""{WITH}, {SQL_CUT}
SELECT c.sample_id, c.node_idx, c.new_idx, coalesce(p.new_idx, -1) AS new_parent
FROM cut c LEFT JOIN cut p ON p.sample_id = c.sample_id AND p.node_idx = c.gold_parent""")
def bfs_truncate(spark, sf_dir):
    """Cut at four nodes, so that many pages are cut."""
    nodes = t.nodes(spark, sf_dir).select(SID, IDX, "gold_parent")
    return tree.bfs_truncate(nodes, 4, "gold_parent", **t.page_sizes(spark, sf_dir)).drop("gold_parent")


SQL_LAYOUT = """
{chain},
{name} AS (
SELECT sample_id, node_idx,
  row_number() OVER (PARTITION BY sample_id, depth ORDER BY path)
    / (count(*) OVER (PARTITION BY sample_id, depth) + 1) AS x, CAST(-depth AS DOUBLE) AS y
FROM {src})"""
SQL_GOLD_AT = SQL_LAYOUT.format(chain=SQL_CHAIN.format(p="gold_parent"), name="gold_at", src="chain")
SQL_PRED_AT = SQL_LAYOUT.format(
    chain=SQL_CHAIN.format(p="pred_parent").replace("chain", "chain2"), name="pred_at", src="chain2"
)


@query("tree_layout", f"{WITH}, {SQL_GOLD_AT} SELECT sample_id, node_idx, round(x, 6) AS x, y FROM gold_at")
def tree_layout(spark, sf_dir):
    at = tree.tree_layout(t.nodes(spark, sf_dir), "gold_parent", **t.page_sizes(spark, sf_dir))
    return at.select(SID, IDX, r6("x", "x"), "y")


def _sql_side(at: str, parent: str, side: str) -> str:
    return f"""SELECT n.sample_id, n.node_idx, '{side}' AS side, round(a.x, 6) AS x, a.y, round(p.x, 6) AS px, p.y AS py,
  n.gold_parent = n.pred_parent AS correct, left(split_part(n.node_text, '>', 1), 20) AS label
FROM texts n JOIN {at} a USING (sample_id, node_idx)
LEFT JOIN {at} p ON p.sample_id = n.sample_id AND p.node_idx = n.{parent}"""


@query("tree_compare", f"""{WITH}, {t.SQL_TEXTS}, {SQL_GOLD_AT}, {SQL_PRED_AT}
{_sql_side('gold_at', 'gold_parent', 'gold')} UNION ALL {_sql_side('pred_at', 'pred_parent', 'pred')}""")
def tree_compare(spark, sf_dir):
    both = tree.tree_compare(
        t.texts(spark, sf_dir), label="node_text", **t.page_sizes(spark, sf_dir)
    )
    return both.withColumns({c: F.round(c, 6) for c in ("x", "px")})


SQL_TED = f"""{SQL_CHAIN.format(p='gold_parent').replace('chain', 'same').replace(
    'WHERE gold_parent < 0', 'WHERE gold_parent < 0 AND pred_parent < 0').replace(
    'n.gold_parent = c.node_idx', 'n.gold_parent = c.node_idx AND n.pred_parent = c.node_idx')},
ted AS (
SELECT n.sample_id, CAST(sum(CASE WHEN n.gold_parent = n.pred_parent THEN 0 ELSE
    (n.gold_parent < 0 OR sg.node_idx IS NOT NULL)::INT + (n.pred_parent < 0 OR sp.node_idx IS NOT NULL)::INT END) AS BIGINT)
  AS tree_edit
FROM nodes n LEFT JOIN same sg ON sg.sample_id = n.sample_id AND sg.node_idx = n.gold_parent
LEFT JOIN same sp ON sp.sample_id = n.sample_id AND sp.node_idx = n.pred_parent
GROUP BY n.sample_id)"""


@query("tree_edit_distance", f"{WITH}, {SQL_TED} SELECT * FROM ted")
def tree_edit_distance(spark, sf_dir):
    return tree.tree_edit_distance(t.nodes(spark, sf_dir), **t.page_sizes(spark, sf_dir))
