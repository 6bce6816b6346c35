"""Queries on stored scores, metrics and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import MASKED_SCORE
from ..operators import boxes, decode, losses, metrics, tree
from ..operators.pages import IDX, SID, cut
from . import tables as t
from .node_queries import SQL_STRICT, SQL_TED, WITH, _boxed
from .registry import query, r6

# ---------------------------------------------------------------- decoding

@query("argmax_type", f"""{WITH}, {t.SQL_TYPE_SCORES}
SELECT sample_id, node_idx, k AS type_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id, node_idx ORDER BY s DESC, k) AS rn FROM type_scores) WHERE rn = 1""")
def argmax_type(spark, sf_dir):
    return decode.argmax_type(t.type_scores(spark, sf_dir)).select(SID, IDX, "type_idx")


@query("candidate_parents", f"""{WITH}, {t.SQL_MASKED}
SELECT sample_id, node_idx, count(*) AS n, count(*) FILTER (allowed) AS n_allowed FROM allowed GROUP BY ALL""")
def candidate_parents(spark, sf_dir):
    return _masked(spark, sf_dir).select(SID, IDX, F.size("scores").cast("long").alias("n"), _n_allowed())


@query("candidate_parents_no_leaf_prior", f"""{WITH}, {t.SQL_SCORES}
SELECT sample_id, node_idx, count(*) FILTER (cand_idx <> node_idx) AS n_allowed FROM scores GROUP BY ALL""")
def candidate_parents_no_leaf_prior(spark, sf_dir):
    return _masked(spark, sf_dir, False).select(SID, IDX, _n_allowed())


@query("candidate_parents_long", f"""{WITH}, {t.SQL_MASKED}
SELECT sample_id, node_idx, count(*) AS n, count(*) FILTER (allowed) AS n_allowed FROM allowed GROUP BY ALL""")
def candidate_parents_long(spark, sf_dir):
    """The same from one row per candidate."""
    flagged = decode.candidate_parents(t.parent_scores(spark, sf_dir), t.types(spark, sf_dir))
    return flagged.groupBy(SID, IDX).agg(
        F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed")
    )


def _masked(spark, sf_dir, leaf_prior=True):
    return decode.mask_rows(t.score_rows(spark, sf_dir), t.types(spark, sf_dir), leaf_prior)


def _n_allowed():
    return F.size(F.filter("allowed", lambda a: a)).cast("long").alias("n_allowed")


@query("mask_scores", f"""{WITH}, {t.SQL_MASKED}
SELECT sample_id, count(*) FILTER (score = -10000) AS n_masked, round(sum(CASE WHEN allowed THEN score ELSE 0 END), 6) AS kept
FROM masked GROUP BY sample_id""")
def mask_scores(spark, sf_dir):
    masked = F.size(F.filter("scores", lambda s: s == MASKED_SCORE))
    kept = F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + F.when(s > MASKED_SCORE, s).otherwise(0.0))
    return _masked(spark, sf_dir).groupBy(SID).agg(F.sum(masked).alias("n_masked"), r6(F.sum(kept), "kept"))


@query("decode_parents", f"{WITH}, {t.SQL_DECODED} SELECT * FROM decoded")
def decode_parents(spark, sf_dir):
    return decode.decode_rows(_masked(spark, sf_dir)).select(SID, IDX, "model_parent")


@query("decode_parents_long", f"{WITH}, {t.SQL_DECODED} SELECT * FROM decoded")
def decode_parents_long(spark, sf_dir):
    """The same from one row per candidate."""
    return decode.decode_parents(t.parent_scores(spark, sf_dir), t.types(spark, sf_dir))


SQL_SPARSE = t.SQL_MASKED.replace("masked AS", "masked_all AS") + """,
masked AS (SELECT * FROM masked_all WHERE allowed)"""
_LAYERS = ["""l0 AS (
SELECT b.sample_id, b.node_idx, -1 AS parent, n.gold_type BETWEEN 3 AND 6 AS leaf FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id, node_idx ORDER BY score DESC, cand_idx < 0, cand_idx) AS k FROM masked) b
JOIN nodes n USING (sample_id, node_idx) WHERE k = 1 AND cand_idx < 0), p0 AS (SELECT * FROM l0)"""]
for _d in range(1, 8):  # no page has more than seven nodes
    _LAYERS.append(f"""l{_d} AS (
SELECT b.sample_id, b.node_idx, b.cand_idx AS parent, n.gold_type BETWEEN 3 AND 6 AS leaf FROM (
  SELECT m.*, row_number() OVER (PARTITION BY m.sample_id, m.node_idx ORDER BY m.score DESC, m.cand_idx) AS k
  FROM masked m JOIN l{_d - 1} h ON h.sample_id = m.sample_id AND h.node_idx = m.cand_idx AND NOT h.leaf
  ANTI JOIN p{_d - 1} p ON p.sample_id = m.sample_id AND p.node_idx = m.node_idx) b
JOIN nodes n USING (sample_id, node_idx) WHERE k = 1),
p{_d} AS (SELECT * FROM p{_d - 1} UNION ALL SELECT * FROM l{_d})""")
SQL_LAYERED = ",\n".join(_LAYERS)


@query("decode_parents_layered", f"""{WITH}, {SQL_SPARSE}, {SQL_LAYERED}
SELECT n.sample_id, n.node_idx, CAST(coalesce(p.parent, -1) AS INT) AS model_parent
FROM nodes n LEFT JOIN p7 p USING (sample_id, node_idx)""")
def decode_parents_layered(spark, sf_dir):
    """All scores, until no layer is left to make."""
    return decode.decode_parents_layered(t.parent_scores(spark, sf_dir), t.types(spark, sf_dir))


@query("softmax_confidence", f"{WITH}, {t.SQL_DECODED} SELECT sample_id, node_idx, round(confidence, 6) AS confidence FROM sure")
def softmax_confidence(spark, sf_dir):
    return _masked(spark, sf_dir).select(SID, IDX, r6(decode.confidence_of(), "confidence"))


@query("hybrid_parents", f"""{WITH}, {t.SQL_DECODED}, {SQL_STRICT}
SELECT d.sample_id, d.node_idx, CASE WHEN confidence >= 0.3 THEN model_parent ELSE box_parent END AS parent_idx
FROM decoded d JOIN sure USING (sample_id, node_idx) JOIN boxed USING (sample_id, node_idx)""")
def hybrid_parents(spark, sf_dir):
    return _hybrid(spark, sf_dir).select(SID, IDX, "parent_idx")


def _hybrid(spark, sf_dir, out="parent_idx"):
    """Nodes with their true parent and that of each structure mode."""
    sizes = t.page_sizes(spark, sf_dir)
    nodes = t.nodes(spark, sf_dir).select(SID, IDX, "gold_parent", F.col("gold_type").alias("type_idx"), *boxes.EDGES)
    boxed = boxes.parent_by_containment(nodes, **sizes).drop(*boxes.EDGES)
    if sizes["large_ids"] is not None:
        boxed = cut(boxed)  # read once for the small pages and several times for the large ones
    return decode.hybrid_rows(t.with_scores(spark, sf_dir, boxed), out=out, **sizes)


@query("select_structure", f"""{WITH}, {t.SQL_DECODED}, {SQL_STRICT},
picked AS (
SELECT n.sample_id, n.gold_parent, model_parent AS m, box_parent AS h,
  CASE WHEN confidence >= 0.3 THEN model_parent ELSE box_parent END AS y
FROM nodes n JOIN decoded USING (sample_id, node_idx) JOIN sure USING (sample_id, node_idx) JOIN boxed USING (sample_id, node_idx))
SELECT 'model' AS mode, count(*) FILTER (m = gold_parent) AS n_right FROM picked
UNION ALL SELECT 'heuristic', count(*) FILTER (h = gold_parent) FROM picked
UNION ALL SELECT 'hybrid', count(*) FILTER (y = gold_parent) FROM picked""")
def select_structure(spark, sf_dir):
    """Right parents under each of the three structure modes."""
    picked = _hybrid(spark, sf_dir).drop("parent_idx")
    for mode in ("model", "heuristic", "hybrid"):
        picked = boxes.select_structure(picked, mode, out=f"by_{mode}")
    right = picked.agg(
        *[F.count_if(F.col(f"by_{m}") == F.col("gold_parent")).alias(m) for m in ("model", "heuristic", "hybrid")]
    )
    return right.unpivot([], ["model", "heuristic", "hybrid"], "mode", "n_right")


# ---------------------------------------------------------------- metrics

@query("type_accuracy", f"""{WITH}
SELECT sample_id, round(avg((gold_type = pred_type)::INT), 6) AS type_acc FROM nodes GROUP BY sample_id""")
def type_accuracy(spark, sf_dir):
    return metrics.type_accuracy(t.nodes(spark, sf_dir)).select(SID, r6("type_acc", "type_acc"))


@query("confusion_matrix", f"{WITH} SELECT gold_type, pred_type, count(*) AS n FROM nodes GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(t.nodes(spark, sf_dir))


@query("confusion_wide", f"""{WITH}
SELECT gold_type, {', '.join(f'count(*) FILTER (pred_type = {c}) AS p{c}' for c in range(9))} FROM nodes GROUP BY gold_type""")
def confusion_wide(spark, sf_dir):
    return metrics.confusion_wide(t.nodes(spark, sf_dir))


@query("confusion_row_norm", f"""{WITH}
SELECT gold_type, pred_type, round(n / sum(n) OVER (PARTITION BY gold_type), 6) AS share
FROM (SELECT gold_type, pred_type, count(*) AS n FROM nodes GROUP BY ALL)""")
def confusion_row_norm(spark, sf_dir):
    shares = metrics.confusion_row_norm(metrics.confusion_matrix(t.nodes(spark, sf_dir)))
    return shares.withColumn("share", F.round("share", 6))


@query("parent_prf", f"""{WITH}
SELECT sample_id, round(avg((gold_parent = pred_parent)::INT), 6) AS precision,
  round(avg((gold_parent = pred_parent)::INT), 6) AS recall, round(avg((gold_parent = pred_parent)::INT), 6) AS f1
FROM nodes GROUP BY sample_id""")
def parent_prf(spark, sf_dir):
    prf = metrics.parent_prf(t.nodes(spark, sf_dir))
    return prf.select(SID, *[r6(c, c) for c in ("precision", "recall", "f1")])


@query("edge_overlap", f"""{WITH}
SELECT sample_id, node_idx, gold_parent AS parent_idx FROM nodes WHERE gold_parent = pred_parent""")
def edge_overlap(spark, sf_dir):
    nodes = t.nodes(spark, sf_dir)
    gold = nodes.select(SID, IDX, F.col("gold_parent").alias("parent_idx"))
    return metrics.edge_overlap(gold, nodes.select(SID, IDX, F.col("pred_parent").alias("parent_idx")))


@query("join_gold_pred", f"""{WITH}, {t.SQL_DECODED}
SELECT n.sample_id, n.node_idx, n.gold_parent, d.model_parent FROM nodes n JOIN decoded d USING (sample_id, node_idx)""")
def join_gold_pred(spark, sf_dir):
    gold = t.nodes(spark, sf_dir).select(SID, IDX, "gold_parent")
    return metrics.join_gold_pred(gold, decode_parents(spark, sf_dir))


_REG = " + ".join(f"abs(p{i} - t{i}) * v{i}" for i in range(5))
_REG_SQ = " + ".join(f"(p{i} - t{i}) * (p{i} - t{i}) * v{i}" for i in range(5))
_REG_N = " + ".join(f"v{i}" for i in range(5))
_SQ = lambda i, channels: " + ".join(f"(q{i}{c} - c{i}{c}) * (q{i}{c} - c{i}{c})" for c in channels)
_DE = " + ".join(f"sqrt({_SQ(i, 'rgb')}) * w{i}" for i in range(3))
_COLOR_SQ = " + ".join(f"({_SQ(i, 'rgba')}) * w{i}" for i in range(3))
_COLOR_N = "w0 + w1 + w2"
SQL_STYLE_ERRORS = f"""
  round(sum({_REG}) / greatest(sum({_REG_N}), 1), 9) AS style_reg_mae,
  round(sum({_DE}) / greatest(sum({_COLOR_N}), 1), 9) AS color_de,
  round(avg((cls_align = pred_align)::INT), 9) AS "cls_textAlign_acc",
  round(avg((cls_display = pred_display)::INT), 9) AS cls_display_acc"""


@query("style_metrics", f"{WITH}, {t.SQL_STYLED} SELECT sample_id, {SQL_STYLE_ERRORS} FROM styled GROUP BY sample_id")
def style_metrics(spark, sf_dir):
    per_page = metrics.style_metrics(t.styled(spark, sf_dir))
    return per_page.select(SID, *[F.round(c, 9).alias(c) for c in per_page.columns if c != SID])


SQL_FULL = f"""{t.SQL_STYLED}, {SQL_TED},
per_page AS (
SELECT sample_id, count(*) AS n_nodes, avg((gold_type = pred_type)::INT) AS type_acc,
  avg((gold_parent = pred_parent)::INT) AS parent_p, {SQL_STYLE_ERRORS} FROM styled GROUP BY sample_id)"""


@query("full_metrics", f"""{WITH}, {SQL_FULL}
SELECT sample_id, n_nodes, round(type_acc, 9) AS type_acc, round(parent_p, 9) AS parent_p, round(parent_p, 9) AS parent_r,
  round(parent_p, 9) AS parent_f1, style_reg_mae, color_de, "cls_textAlign_acc", cls_display_acc, tree_edit
FROM per_page JOIN ted USING (sample_id)""")
def full_metrics(spark, sf_dir):
    per_page = metrics.full_metrics(t.styled(spark, sf_dir), **t.page_sizes(spark, sf_dir))
    whole = (SID, "n_nodes", "tree_edit")
    return per_page.select(*[c if c in whole else F.round(c, 9).alias(c) for c in per_page.columns])


@query("macro_average", f"""{WITH}, {SQL_TED},
per_page AS (SELECT sample_id, avg((gold_type = pred_type)::INT) AS type_acc, avg((gold_parent = pred_parent)::INT) AS parent_p
FROM nodes GROUP BY sample_id)
SELECT round(avg(type_acc), 6) AS type_acc, round(avg(parent_p), 6) AS parent_p, round(avg(parent_p), 6) AS parent_r,
  round(avg(parent_p), 6) AS parent_f1, round(avg(tree_edit), 6) AS tree_edit
FROM per_page JOIN ted USING (sample_id)""")
def macro_average(spark, sf_dir):
    per_page = metrics.full_metrics(t.nodes(spark, sf_dir), styles=False, **t.page_sizes(spark, sf_dir))
    mean = metrics.macro_average(per_page)
    return mean.select(*[r6(c, c) for c in mean.columns])


@query("micro_average", f"{WITH} SELECT round(avg((gold_type = pred_type)::INT), 6) AS type_acc FROM nodes")
def micro_average(spark, sf_dir):
    return metrics.micro_average(
        t.nodes(spark, sf_dir), "gold_type", "pred_type", "type_acc"
    ).select(r6("type_acc", "type_acc"))


@query("worst_samples", f"{WITH}, {SQL_TED} SELECT * FROM ted ORDER BY tree_edit DESC, sample_id LIMIT 20")
def worst_samples(spark, sf_dir):
    edits = tree.tree_edit_distance(t.nodes(spark, sf_dir), **t.page_sizes(spark, sf_dir))
    return metrics.worst_samples(edits, 20)


@query("node_count_stats", f"""{WITH}
SELECT sample_id, count(*) AS n_nodes, count(*) FILTER (a > 0) AS n_valid FROM nodes GROUP BY sample_id""")
def node_count_stats(spark, sf_dir):
    return metrics.node_count_stats(t.nodes(spark, sf_dir), "a")


SQL_HEURISTIC = f"""{SQL_STRICT}, joined AS (
SELECT n.sample_id, n.node_idx, n.gold_parent, b.box_parent AS pred_parent FROM nodes n JOIN boxed b USING (sample_id, node_idx)),
{SQL_TED.replace('FROM nodes', 'FROM joined').replace('nodes n', 'joined n')},
n_train AS (SELECT floor(count(DISTINCT sample_id) * 0.85::DOUBLE) AS k FROM nodes),
split AS (
SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY sample_id) <= (SELECT k FROM n_train) THEN 'train' ELSE 'val' END AS split
FROM (SELECT DISTINCT sample_id FROM nodes)),
prf AS (SELECT sample_id, avg((gold_parent = pred_parent)::INT) AS f1 FROM joined GROUP BY sample_id)
SELECT split, round(avg(f1), 6) AS parent_p, round(avg(f1), 6) AS parent_r, round(avg(f1), 6) AS parent_f1,
  round(avg(tree_edit), 6) AS tree_edit, count(*) AS n_pages
FROM prf JOIN ted USING (sample_id) JOIN split USING (sample_id) GROUP BY split"""


@query("heuristic_evaluation", f"{WITH}, {SQL_HEURISTIC}")
def heuristic_evaluation(spark, sf_dir):
    """Flagship: containment parents against the truth, averaged per page, for each split."""
    from ..operators.dataset import prefix_split

    nodes = t.nodes(spark, sf_dir)
    sizes = t.page_sizes(spark, sf_dir)
    found = boxes.parent_by_containment(
        nodes.select(SID, IDX, "gold_parent", *boxes.EDGES), out="pred_parent", **sizes
    ).withColumns({"gold_type": F.lit(0), "pred_type": F.lit(0)})
    per_page = metrics.full_metrics(found, styles=False, **sizes).drop("type_acc")
    split = prefix_split(nodes.select(SID).distinct())
    mean = per_page.join(split, SID).groupBy("split").agg(
        *[r6(F.avg(c), c) for c in ("parent_p", "parent_r", "parent_f1", "tree_edit")],
        F.count("*").alias("n_pages"),
    )
    return mean


MODES = {"model": "model_parent", "heuristic": "box_parent", "hybrid": "hybrid_parent"}
SQL_MODES = f"""{t.SQL_DECODED}, {SQL_STRICT},
picked AS (
SELECT n.sample_id, n.node_idx, n.gold_parent, model_parent, box_parent,
  CASE WHEN confidence >= 0.3 THEN model_parent ELSE box_parent END AS hybrid_parent
FROM nodes n JOIN decoded USING (sample_id, node_idx) JOIN sure USING (sample_id, node_idx) JOIN boxed USING (sample_id, node_idx)),
sides AS MATERIALIZED (
{" UNION ALL ".join(f"SELECT '{m}:' || sample_id AS sample_id, sample_id AS page, '{m}' AS mode, node_idx, gold_parent, {c} AS pred_parent FROM picked" for m, c in MODES.items())}),
{SQL_TED.replace('FROM nodes', 'FROM sides').replace('nodes n', 'sides n')},
prf AS (SELECT sample_id, page, mode, avg((gold_parent = pred_parent)::INT) AS parent_p FROM sides GROUP BY ALL),
n_train AS (SELECT floor(count(DISTINCT sample_id) * 0.85::DOUBLE) AS k FROM nodes),
split AS (
SELECT sample_id AS page, CASE WHEN row_number() OVER (ORDER BY sample_id) <= (SELECT k FROM n_train) THEN 'train' ELSE 'val' END AS split
FROM (SELECT DISTINCT sample_id FROM nodes))"""


@query("structure_evaluation", f"""{WITH}, {SQL_MODES}
SELECT mode, split, round(avg(parent_p), 6) AS parent_p, round(avg(parent_p), 6) AS parent_r, round(avg(parent_p), 6) AS parent_f1,
  round(avg(tree_edit), 6) AS tree_edit, count(*) AS n_pages
FROM prf JOIN ted USING (sample_id) JOIN split USING (page) GROUP BY mode, split""")
def structure_evaluation(spark, sf_dir):
    """Model, heuristic and hybrid structures against the truth, averaged per page, for each split."""
    from ..operators.dataset import prefix_split

    per_page = metrics.structure_metrics(_hybrid(spark, sf_dir, "hybrid_parent"), MODES, **t.page_sizes(spark, sf_dir))
    split = prefix_split(t.nodes(spark, sf_dir).select(SID).distinct())
    return per_page.join(split, SID).groupBy("mode", "split").agg(
        *[r6(F.avg(c), c) for c in ("parent_p", "parent_r", "parent_f1", "tree_edit")], F.count("*").alias("n_pages")
    )


# ---------------------------------------------------------------- losses

SQL_TYPE_CE = f"""{t.SQL_TYPE_SCORES}, type_lse AS (
SELECT sample_id, node_idx, ln(sum(exp(s))) - max(CASE WHEN k = gold_type THEN s END) AS loss FROM type_scores GROUP BY ALL)"""


@query("type_cross_entropy", f"{WITH}, {SQL_TYPE_CE} SELECT round(avg(loss), 6) AS type FROM type_lse")
def type_cross_entropy(spark, sf_dir):
    return losses.type_cross_entropy(t.type_scores(spark, sf_dir)).select(r6("type", "type"))


@query("parent_cross_entropy", f"""{WITH}, {t.SQL_SCORES}, no_prior AS (
SELECT sample_id, node_idx, cand_idx, CASE WHEN cand_idx = node_idx THEN -10000.0::DOUBLE ELSE score END AS score FROM scores),
lse AS (
SELECT s.sample_id, s.node_idx, ln(sum(exp(score))) - max(CASE WHEN cand_idx = n.gold_parent THEN score END) AS loss
FROM no_prior s JOIN nodes n USING (sample_id, node_idx) GROUP BY ALL)
SELECT round(avg(loss), 6) AS struct FROM lse""")
def parent_cross_entropy(spark, sf_dir):
    """As in training: no leaf prior."""
    return losses.parent_cross_entropy_rows(_masked(spark, sf_dir, False)).select(r6("struct", "struct"))


def _sql_bce(cells: str) -> str:
    return f"""{t.SQL_PATCHES}, sums AS (
SELECT count(*)::DOUBLE AS n, sum((overlap >= 0.3)::INT)::DOUBLE AS pos,
  sum(CASE WHEN overlap >= 0.3 THEN greatest(-x, 0) + ln(1 + exp(-abs(x))) ELSE 0 END) AS pos_loss,
  sum(CASE WHEN overlap >= 0.3 THEN 0 ELSE greatest(x, 0) + ln(1 + exp(-abs(x))) END) AS neg_loss FROM cells)
SELECT round((least(greatest({cells} - pos, 1) / greatest(pos, 1), 20) * pos_loss + neg_loss) / greatest(n, 1), 6) AS align_bce
FROM sums"""


@query("weighted_bce", f"{WITH}, {_sql_bce('n')}")
def weighted_bce(spark, sf_dir):
    return losses.weighted_bce(t.patch_cells(spark, sf_dir)).select(r6("align_bce", "align_bce"))


@query("weighted_bce_padded", f"{WITH}, {_sql_bce('(SELECT count(DISTINCT sample_id) * 96.0::DOUBLE * 196 FROM nodes)')}")
def weighted_bce_padded(spark, sf_dir):
    """Negatives count the padding up to 96 nodes per page."""
    pages = t.nodes(spark, sf_dir).select(SID).distinct().count()
    padded = pages * 96 * 196
    return losses.weighted_bce(t.patch_cells(spark, sf_dir), padded).select(r6("align_bce", "align_bce"))


@query("infonce", f"""{WITH}, {t.SQL_PATCHES}, per_node AS (
SELECT sample_id, node_idx, max(x / 0.1::DOUBLE) AS top, arg_min(x / 0.1::DOUBLE, p) FILTER (overlap >= 0.3) AS hit
FROM cells GROUP BY ALL),
lse AS (
SELECT c.sample_id, c.node_idx, any_value(top) + ln(sum(exp(x / 0.1::DOUBLE - top))) - any_value(hit) AS loss
FROM cells c JOIN per_node USING (sample_id, node_idx) WHERE hit IS NOT NULL GROUP BY ALL)
SELECT round(avg(loss), 6) AS align_nce FROM lse""")
def infonce(spark, sf_dir):
    return losses.infonce(t.patch_scores(spark, sf_dir)).select(r6("align_nce", "align_nce"))


@query("style_mse", f"""{WITH}, {t.SQL_STYLED}
SELECT round(sum({_REG_SQ}) / greatest(sum({_REG_N}), 1), 6) AS style_reg FROM styled""")
def style_mse(spark, sf_dir):
    return losses.style_mse(t.styled(spark, sf_dir)).select(r6("style_reg", "style_reg"))


@query("color_mse", f"""{WITH}, {t.SQL_STYLED}
SELECT round(sum({_COLOR_SQ}) / greatest(sum({_COLOR_N}), 1) / 4, 6) AS style_color FROM styled""")
def color_mse(spark, sf_dir):
    return losses.color_mse(t.styled(spark, sf_dir)).select(r6("style_color", "style_color"))


@query("color_mse_reference", f"""{WITH}, {t.SQL_STYLED}
SELECT round(sum({_COLOR_SQ}) / greatest(sum({_COLOR_N}), 1), 6) AS style_color FROM styled""")
def color_mse_reference(spark, sf_dir):
    return losses.color_mse(t.styled(spark, sf_dir), "reference").select(r6("style_color", "style_color"))


def _sql_choice(n: int, step: int, target: str) -> str:
    s = f"CAST((node_idx * 7 + k.range * {step} + sample_id) % 53 AS DOUBLE) / 10"
    return f"""SELECT avg(loss) AS loss FROM (
  SELECT ln(sum(exp({s}))) - max(CASE WHEN k.range = {target} THEN {s} END) AS loss
  FROM styled, range({n}) k GROUP BY sample_id, node_idx)"""


@query("style_cross_entropy", f"""{WITH}, {t.SQL_STYLED}
SELECT round(avg(loss), 6) AS style_cls FROM ({_sql_choice(6, 5, 'cls_align')} UNION ALL {_sql_choice(8, 11, 'cls_display')})""")
def style_cross_entropy(spark, sf_dir):
    return losses.style_cross_entropy(t.choice_scores(spark, sf_dir)).select(r6("style_cls", "style_cls"))


@query("weighted_total", f"""{WITH}, {t.SQL_STYLED}, {SQL_TYPE_CE}
SELECT round(1.0::DOUBLE * type + 0.2::DOUBLE * style_reg + 0.05::DOUBLE * style_color + 1.0::DOUBLE * extra, 6) AS total FROM
  (SELECT avg(loss) AS type FROM type_lse),
  (SELECT sum({_REG_SQ}) / greatest(sum({_REG_N}), 1) AS style_reg,
     sum({_COLOR_SQ}) / greatest(sum({_COLOR_N}), 1) / 4 AS style_color, avg(a) AS extra FROM styled)""")
def weighted_total(spark, sf_dir):
    """Three known terms and one without a weight of its own."""
    rows = t.styled(spark, sf_dir)
    parts = {
        "type": losses.type_cross_entropy(t.type_scores(spark, sf_dir)),
        "style_reg": losses.style_mse(rows),
        "style_color": losses.color_mse(rows),
        "extra": rows.agg(F.avg("a").alias("extra")),
    }
    long = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("k"), F.col(name).alias("v"))
        long = row if long is None else long.unionByName(row)
    terms = long.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("terms"))
    return terms.select(r6(losses.weighted_total(F.col("terms")), "total"))


@query("attention_grid", f"""{WITH}, {t.SQL_PATCHES}, top AS (
SELECT sample_id, node_idx, max(1 / (1 + exp(-x))) + 1e-8 AS top FROM cells GROUP BY ALL)
SELECT CAST(p // 14 AS INT) AS "row", CAST(p % 14 AS INT) AS col, count(*) AS n, round(sum(1 / (1 + exp(-x)) / top), 5) AS heat
FROM cells JOIN top USING (sample_id, node_idx) GROUP BY ALL""")
def attention_grid(spark, sf_dir):
    """Heat of every node of every page, summed per cell."""
    from ..operators.runs import heat_sums

    heat = heat_sums(t.patch_scores(spark, sf_dir), logits=True)
    return heat.select("row", "col", "n", F.round("heat", 5).alias("heat"))
