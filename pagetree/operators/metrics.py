"""Scores of predictions against truth: per page, per node, and in one row."""

from __future__ import annotations

import pyarrow as arrow
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pagearrays as pa
from ..functions import pagebatches as pb
from ..functions.constants import NODE_TYPES, STYLE_CHOICES
from .pages import CHECK, IDX, PAGE_LIMIT, SID, by_page_size
from .tree import tree_edit_distance


def join_gold_pred(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Truth and prediction of the same node side by side."""
    return gold.join(pred, [SID, IDX])


def edge_overlap(gold: DataFrame, pred: DataFrame, parent: str = "parent_idx") -> DataFrame:
    """Edges (page, child, parent) found in both tables."""
    edge = [SID, IDX, parent]
    return gold.select(*edge).join(pred.select(*edge), edge, "left_semi")


def _hits(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.count_if(a == b)


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def f1(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both > 0, 2 * precision * recall / both).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- nodes


def type_accuracy(nodes: DataFrame, gold: str = "gold_type", pred: str = "pred_type") -> DataFrame:
    """Share of right types per page."""
    return nodes.groupBy(SID).agg(_ratio(_hits(gold, pred), F.count("*")).alias("type_acc"))


def confusion_matrix(
    nodes: DataFrame, gold: str = "gold_type", pred: str = "pred_type"
) -> DataFrame:
    """Counts in long form, zero cells left out."""
    return nodes.groupBy(F.col(gold).alias("gold_type"), F.col(pred).alias("pred_type")).agg(
        F.count("*").alias("n")
    )


def confusion_wide(nodes: DataFrame, gold: str = "gold_type", pred: str = "pred_type") -> DataFrame:
    """Dense 9×9 counts: one row per true type, one column per predicted type."""
    classes = range(len(NODE_TYPES))
    seen = nodes.groupBy(F.col(gold).alias("gold_type")).agg(
        *[F.count_if(F.col(pred) == c).alias(f"p{c}") for c in classes]
    )
    every = nodes.sparkSession.range(len(NODE_TYPES)).select(F.col("id").cast("int").alias("gold_type"))
    return every.join(seen, "gold_type", "left").na.fill(0)


def confusion_row_norm(matrix: DataFrame) -> DataFrame:
    """Counts over their row's sum (at least 1).  The matrix has at most 81 rows."""
    sums = matrix.groupBy("gold_type").agg(F.greatest(F.sum("n"), F.lit(1)).alias("_sum"))
    return matrix.join(sums, "gold_type").select(
        "gold_type", "pred_type", (F.col("n") / F.col("_sum")).alias("share")
    )


# ---------------------------------------------------------------- structure


def parent_prf(
    nodes: DataFrame,
    gold: str = "gold_parent",
    pred: str = "pred_parent",
    pages: DataFrame | None = None,
) -> DataFrame:
    """Precision, recall and F1 over child→parent edges per page, root edges included.

    Every node has one edge on each side, so the three agree.  With ``pages``, pages without nodes
    are listed with 1.
    """
    share = _ratio(_hits(gold, pred), F.count("*"))
    per_page = nodes.groupBy(SID).agg(share.alias("precision"), share.alias("recall"))
    if pages is not None:
        per_page = pages.select(SID).join(per_page, SID, "left").na.fill(
            1.0, ["precision", "recall"]
        )
    return per_page.withColumn("f1", f1(F.col("precision"), F.col("recall")))


# ---------------------------------------------------------------- style


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def reg_error(power: int = 1) -> tuple[Column, Column]:
    """Summed (absolute or squared) error of the valid numbers of a node, and their count."""
    off = F.zip_with("pred_reg", "reg", lambda p, t: F.abs(p - t) if power == 1 else (p - t) * (p - t))
    return _sum(F.zip_with(off, "reg_valid", lambda d, v: d * v)), _sum(F.col("reg_valid"))


def squares(p: Column, t: Column, channels: int) -> Column:
    """Summed squared difference of the first channels of two colours."""
    first = [F.slice(c, 1, channels) for c in (p, t)]
    return _sum(F.zip_with(*first, lambda a, b: (a - b) * (a - b)))


def color_error() -> tuple[Column, Column]:
    """Summed RGB distance of the valid colours of a node, and their count."""
    off = F.zip_with("pred_color", "color", lambda p, t: F.sqrt(squares(p, t, 3)))
    return _sum(F.zip_with(off, "color_valid", lambda d, v: d * v)), _sum(F.col("color_valid"))


def masked_mean(error: Column, weight: Column) -> Column:
    return F.sum(error) / F.greatest(F.sum(weight), F.lit(1.0))


def style_reg_mae(styled: DataFrame, by: tuple[str, ...] = (SID,)) -> DataFrame:
    return styled.groupBy(*by).agg(masked_mean(*reg_error()).alias("style_reg_mae"))


def color_delta_e(styled: DataFrame, by: tuple[str, ...] = (SID,)) -> DataFrame:
    return styled.groupBy(*by).agg(masked_mean(*color_error()).alias("color_de"))


def style_class_accuracy(styled: DataFrame, by: tuple[str, ...] = (SID,)) -> DataFrame:
    return styled.groupBy(*by).agg(*_class_accuracy())


def style_metrics(styled: DataFrame, by: tuple[str, ...] = (SID,)) -> DataFrame:
    """All style measures in one aggregation."""
    return styled.groupBy(*by).agg(
        masked_mean(*reg_error()).alias("style_reg_mae"), masked_mean(*color_error()).alias("color_de"), *_class_accuracy()
    )


def _class_accuracy() -> list[Column]:
    return [
        _ratio(_hits(f"cls_{k}", f"pred_cls_{k}"), F.count("*")).alias(f"cls_{k}_acc")
        for k in STYLE_CHOICES
    ]


# ---------------------------------------------------------------- everything at once


def full_metrics(
    nodes: DataFrame,
    gold_parent: str = "gold_parent",
    pred_parent: str = "pred_parent",
    gold_type: str = "gold_type",
    pred_type: str = "pred_type",
    styles: bool = True,
    page_limit: int = PAGE_LIMIT,
    large_ids=CHECK,
) -> DataFrame:
    """All metrics per page.  Pages within the limit take a single shuffle."""
    share = _ratio(_hits(gold_parent, pred_parent), F.count("*"))
    sums = [
        F.count("*").alias("n_nodes"),
        _ratio(_hits(gold_type, pred_type), F.count("*")).alias("type_acc"),
        share.alias("parent_p"),
        share.alias("parent_r"),
        f1(share, share).alias("parent_f1"),
    ]
    if styles:
        sums += [
            masked_mean(*reg_error()).alias("style_reg_mae"),
            masked_mean(*color_error()).alias("color_de"),
            *_class_accuracy(),
        ]

    def small(part: DataFrame) -> DataFrame:
        tree = F.sort_array(F.collect_list(F.struct(IDX, gold_parent, pred_parent)))
        grouped = part.groupBy(SID).agg(*sums, tree.alias("_tree"))
        side = {c: pa.links(F.col("_tree")[IDX], F.col("_tree")[c]) for c in (gold_parent, pred_parent)}
        linked = grouped.select("*", side[gold_parent].alias("_g"), side[pred_parent].alias("_p"))
        edits = pa.tree_edit_distance(F.col("_g"), F.col("_p")).cast("long")
        return linked.withColumn("tree_edit", edits).drop("_tree", "_g", "_p")

    def large(part: DataFrame) -> DataFrame:
        edits = tree_edit_distance(part, gold_parent, pred_parent, page_limit=0)
        return part.groupBy(SID).agg(*sums).join(edits, SID)

    return by_page_size(nodes, small, large, page_limit, large_ids)


def structure_metrics(
    nodes: DataFrame, modes: dict[str, str], gold: str = "gold_parent", page_limit: int = PAGE_LIMIT, large_ids=CHECK
) -> DataFrame:
    """(sample_id, mode, parent_p, parent_r, parent_f1, tree_edit): each predicted structure of a page
    against the true one.

    ``modes`` names a parent column per mode.  Pages within the limit are placed once, sorted, and rated
    a batch of nodes at a time; the nodes of a larger one are walked once per mode.
    """
    def rated(share: Column, edits: Column) -> list[Column]:
        return [share.alias("parent_p"), share.alias("parent_r"), f1(share, share).alias("parent_f1"), edits.alias("tree_edit")]

    def small(part: DataFrame) -> DataFrame:
        parents = [F.col(c).cast("int").alias(m) for m, c in modes.items()]
        nodes = part.select(SID, F.col(IDX).cast("int").alias(IDX), F.col(gold).cast("int").alias("_gold"), *parents)
        placed = nodes.repartition(SID).sortWithinPartitions(*nodes.columns)
        schema = T.StructType([
            part.schema[SID], T.StructField("mode", T.StringType()),
            T.StructField("_share", T.DoubleType()), T.StructField("_edits", T.LongType()),
        ])
        found = placed.mapInArrow(_rate(tuple(modes)), schema)
        return found.select(SID, "mode", *rated(F.col("_share"), F.col("_edits")))

    def large(part: DataFrame) -> DataFrame:
        found = None
        for m, c in modes.items():
            edits = tree_edit_distance(part, gold, c, page_limit=0)
            share = part.groupBy(SID).agg(_ratio(_hits(gold, c), F.count("*")).alias("_share"))
            one = share.join(edits, SID).select(SID, F.lit(m).alias("mode"), *rated(F.col("_share"), F.col("tree_edit")))
            found = one if found is None else found.unionByName(one)
        return found

    return by_page_size(nodes, small, large, page_limit, large_ids)


def _rate(modes: tuple[str, ...]):
    """Share of right parents and edit distance of each page and mode, from nodes sorted by page."""

    def rate(batches):
        for nodes in pb.whole_pages(batches, SID):
            page, starts = pb.pages(nodes[SID])
            idx, gold = (pb.numbers(nodes[c]) for c in (IDX, "_gold"))
            sizes = pb.per_page(page, page >= 0)
            links = pb.links(page, starts, idx, gold)
            for mode in modes:
                right = pc.fill_null(pc.equal(nodes["_gold"], nodes[mode]), False).to_numpy(zero_copy_only=False)
                edits = pb.tree_edits(page, links, pb.links(page, starts, idx, pb.numbers(nodes[mode])))
                yield arrow.RecordBatch.from_arrays(
                    [nodes[SID].take(arrow.array(starts)), arrow.array([mode] * len(starts)), arrow.array(pb.per_page(page, right) / sizes), arrow.array(edits)],
                    names=[SID, "mode", "_share", "_edits"],
                )

    return rate


def macro_average(per_page: DataFrame, *metrics: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the per-page values."""
    metrics = metrics or tuple(c for c in per_page.columns if c not in (SID, "n_nodes", *by))
    return per_page.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def micro_average(
    nodes: DataFrame, gold: str, pred: str, out: str, by: tuple[str, ...] = ()
) -> DataFrame:
    """Share of agreeing nodes over all nodes."""
    return nodes.groupBy(*by).agg(_ratio(_hits(gold, pred), F.count("*")).alias(out))


def worst_samples(per_page: DataFrame, k: int = 20, metric: str = "tree_edit") -> DataFrame:
    """The k pages with the largest value; ties by page id."""
    return per_page.orderBy(F.desc(metric), SID).limit(k)


def node_count_stats(nodes: DataFrame, valid: str | None = None) -> DataFrame:
    counted = F.count_if(F.col(valid) > 0) if valid else F.count("*")
    return nodes.groupBy(SID).agg(F.count("*").alias("n_nodes"), counted.alias("n_valid"))
