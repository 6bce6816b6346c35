"""Decoding stored model scores into types and parents.

A model emits one array per node: the scores of nodes 0 to n-1 of its page as parent, then that of
the root (sample_id, node_idx, scores).  The ``*_rows`` functions work on these: what they need of the
other nodes of a page is one flag each, and no score is ever a row of its own.

Sparse scores come as a long table (sample_id, node_idx, cand_idx, score) with cand_idx = -1 for the
root.  ``types`` is (sample_id, node_idx, type_idx).  Ties go to the lower candidate, root last.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pagearrays as pa
from ..functions.binding import let
from ..functions.constants import LEAF_TYPES, MASKED_SCORE, MIN_CONFIDENCE, NODE_TYPES
from ..functions.style import argmax
from .pages import CHECK, IDX, PAGE_LIMIT, SID, by_page_size, cut

CAND, SCORE, TYPE = "cand_idx", "score", "type_idx"
#: A page of so many nodes has up to 262,144 scores in its row.
LAYER_LIMIT = 512
LEAF_INDEX = [NODE_TYPES.index(t) for t in LEAF_TYPES]


def argmax_type(nodes: DataFrame, scores: str = "type_scores", out: str = TYPE) -> DataFrame:
    """Best class of a score array, the lowest on ties."""
    return nodes.withColumn(out, argmax(F.col(scores)))


def is_leaf(type_idx: Column) -> Column:
    return type_idx.isin(*LEAF_INDEX)


# ---------------------------------------------------------------- one array of scores per node


def page_flags(nodes: DataFrame, flag: Column, out: str) -> DataFrame:
    """(sample_id, out): a flag of each node of a page, in node order."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(IDX).alias("i"), flag.alias("f"))))
    return nodes.groupBy(SID).agg(listed.alias(out)).select(SID, F.col(out)["f"].alias(out))


def _flagged(rows: DataFrame, flag: Column, out: str) -> DataFrame:
    """``rows`` with the flags of all nodes of their page in node order, from a window in which they
    already lie: only for pages within the limit."""
    page = Window.partitionBy(SID).orderBy(IDX).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn(out, F.collect_list(F.struct(flag.alias("f"))).over(page)).withColumn(out, F.col(out)["f"])


def _allows(i: Column, leaf_prior: bool = True) -> Column:
    other = i != F.col(IDX)
    if leaf_prior:
        other = other & ~F.coalesce(F.get("_leaves", i), F.lit(True))
    return (i == F.size("scores") - 1) | other


def _own_leaf() -> Column:
    return F.coalesce(F.get("_leaves", F.col(IDX)), F.lit(False))


def mask_rows(rows: DataFrame, types: DataFrame, leaf_prior: bool = True) -> DataFrame:
    """``rows`` with masked ``scores``, the array ``allowed`` and ``leaf``, whether the node is one.

    Allowed are the root and the nodes of the page other than the node itself and, with the leaf
    prior, not of a leaf type; the scores of others become -10000.
    """
    flagged = rows.join(page_flags(types, is_leaf(F.col(TYPE)), "_leaves"), SID)
    allowed = F.transform("scores", lambda s, i: _allows(i, leaf_prior))
    return (
        flagged.withColumn("allowed", allowed)
        .withColumn("scores", F.zip_with("scores", "allowed", lambda s, a: F.when(a, s).otherwise(F.lit(MASKED_SCORE))))
        .withColumn("leaf", _own_leaf())
        .drop("_leaves")
    )


def _nodes_of(scores: str = "scores") -> Column:
    return F.slice(scores, F.lit(1), F.size(scores) - 1)


def _root_first() -> Column:
    return let(
        F.array_max(_nodes_of()),
        lambda top: F.coalesce(top.isNull() | (F.element_at("scores", -1) > top), F.lit(False)),
    )


def _hosted() -> Column:
    """The best-scoring host, the root without one or where the root ranks first."""
    hosted = F.zip_with(_nodes_of(), "_hosts", lambda s, h: F.when(h, s))
    best = let(hosted, lambda h: F.coalesce(F.array_position(h, F.array_max(h)), F.lit(0)) - 1)
    return F.when(F.col("_first"), F.lit(-1)).otherwise(best).cast("int")


def decode_rows(masked: DataFrame, out: str = "model_parent") -> DataFrame:
    """Parent per node of ``mask_rows``: root where it ranks first, else the best-scoring root that is
    not of a leaf type, else root.

    Scanning every ranked candidate layer by layer comes to the same: the first layer already offers
    each open node some root, so depth never exceeds one.
    """
    ranked = masked.withColumn("_first", _root_first())
    hosts = page_flags(ranked.select(SID, IDX, "_first", "leaf"), F.col("_first") & ~F.col("leaf"), "_hosts")
    return ranked.join(hosts, SID).withColumn(out, _hosted()).drop("_first", "_hosts")


def confidence_of(scores: str = "scores") -> Column:
    """Largest softmax probability of an array of (masked) scores."""
    top = F.array_max(scores)
    return 1 / let(top, lambda t: F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - t)))


def hybrid_rows(
    rows: DataFrame, min_confidence: float = MIN_CONFIDENCE, out: str = "parent_idx", page_limit: int = PAGE_LIMIT, large_ids=CHECK
) -> DataFrame:
    """Decoded parent where the model is confident, else the containment parent.

    ``rows`` have ``scores``, ``type_idx`` and ``box_parent``; ``model_parent``, ``confidence`` and ``out``
    come in place of the scores.  The nodes of a page within the limit are placed once and read the
    flags of the others there; those of a larger one go through joins, which need not hold a page.
    """
    def chosen(decoded: DataFrame) -> DataFrame:
        sure = F.col("confidence") >= min_confidence
        return decoded.withColumn("confidence", confidence_of()).select(
            *[c for c in rows.columns if c != "scores"], "model_parent", "confidence",
            F.when(sure, F.col("model_parent")).otherwise(F.col("box_parent")).cast("int").alias(out),
        )

    def small(part: DataFrame) -> DataFrame:
        masked = F.transform("scores", lambda s, i: F.when(_allows(i), s).otherwise(F.lit(MASKED_SCORE)))
        ranked = _flagged(part, is_leaf(F.col(TYPE)), "_leaves").withColumn("scores", masked).withColumn("_first", _root_first())
        return chosen(_flagged(ranked, F.col("_first") & ~_own_leaf(), "_hosts").withColumn("model_parent", _hosted()))

    def large(part: DataFrame) -> DataFrame:
        return chosen(decode_rows(mask_rows(part, part.select(SID, IDX, TYPE))))

    return by_page_size(rows, small, large, page_limit, large_ids)


# ---------------------------------------------------------------- one row per candidate


def _whole(table: DataFrame, *keys: str) -> DataFrame:
    """Rows with all keys set.  Stated up front, so that every use of the table plans the same
    exchange and the shuffle is reused."""
    for k in keys:
        table = table.where(F.col(k).isNotNull())
    return table


def candidate_parents(scores: DataFrame, types: DataFrame, leaf_prior: bool = True) -> DataFrame:
    """Scores with ``allowed``: a node of the page other than itself and, with the leaf prior, not
    of a leaf type; the root is always allowed.

    A page of n nodes has n² scores but n types, so the types are the side that is hashed and the
    scores are not sorted.
    """
    cand = _whole(types, SID, IDX).select(
        SID, F.col(IDX).alias(CAND), is_leaf(F.col(TYPE)).alias("_leaf")
    )
    other = F.col("_leaf").isNotNull() & (F.col(CAND) != F.col(IDX))
    if leaf_prior:
        other = other & ~F.col("_leaf")
    allowed = (F.col(CAND) < 0) | F.coalesce(other, F.lit(False))
    joined = _whole(scores, SID, IDX, CAND).join(cand.hint("shuffle_hash"), [SID, CAND], "left")
    return joined.select(*scores.columns, allowed.alias("allowed"))


def mask_scores(scores: DataFrame) -> DataFrame:
    """Scores of candidates that are not allowed become -10000."""
    return scores.withColumn(
        SCORE, F.when(F.col("allowed"), F.col(SCORE)).otherwise(F.lit(MASKED_SCORE))
    )


def _preference() -> Column:
    """Sort key of a candidate: score, then the lower index, root last."""
    tie = F.when(F.col(CAND) < 0, F.lit(-(1 << 40))).otherwise(-F.col(CAND).cast("long"))
    return F.struct(F.col(SCORE), tie)


def best_candidates(scores: DataFrame) -> DataFrame:
    return scores.groupBy(SID, IDX).agg(F.max_by(CAND, _preference()).alias("best"))


def decode_parents(
    scores: DataFrame, types: DataFrame, out: str = "model_parent", masked: bool = False
) -> DataFrame:
    """Parent per node: root where the root ranks first, else the best-scoring root that is not of
    a leaf type, else root.

    Scanning every ranked candidate layer by layer comes to the same: the first layer already
    offers each open node some root, so depth never exceeds one.  Two aggregations replace the
    full sort.  ``masked`` states that the scores went through ``mask_scores``.
    """
    given = _whole(scores, SID, IDX, CAND)
    ranked = given if masked else mask_scores(candidate_parents(given, types))
    root = F.col(CAND) < 0
    tops = ranked.groupBy(SID, IDX).agg(
        F.max(F.when(root, F.col(SCORE))).alias("_root"),
        F.max(F.when(~root, F.col(SCORE))).alias("_other"),
    )
    decided = tops.select(
        SID, IDX, F.coalesce(F.col("_other").isNull() | (F.col("_root") > F.col("_other")), F.lit(False)).alias("_first")
    )
    hosts = (
        decided.where("_first")
        .join(types.where(~is_leaf(F.col(TYPE))).select(SID, IDX), [SID, IDX], "left_semi")
        .select(SID, F.col(IDX).alias(CAND))
    )
    # a root of another type than leaf is allowed for every open node: its score is never masked
    hosted = best_candidates(
        given.join(hosts.hint("shuffle_hash"), [SID, CAND], "left_semi").select(SID, IDX, CAND, SCORE)
    )
    return decided.join(hosted, [SID, IDX], "left").select(
        SID,
        IDX,
        F.when(F.col("_first"), F.lit(-1))
        .otherwise(F.coalesce("best", F.lit(-1)))
        .cast("int")
        .alias(out),
    )


def decode_parents_layered(
    scores: DataFrame, types: DataFrame, max_depth: int | None = None, out: str = "model_parent",
    page_limit: int = LAYER_LIMIT, large_ids=CHECK,
) -> DataFrame:
    """Layer by layer over allowed candidates only: nodes that rank the root first make layer 0,
    then each open node joins its best candidate on the layer before, until a layer stays empty or
    ``max_depth`` layers are made; what is left becomes a root.

    Worth having for sparse score tables, where not every pair is scored.  A page within the limit is
    one row with the ranked candidates of its nodes, in which the layers are a fold; a larger one
    takes a round of joins per layer.
    """
    scored = candidate_parents(scores, types).where("allowed").drop("allowed")

    def small(part: DataFrame) -> DataFrame:
        return _layers_in_row(scored, part, max_depth, out)

    def large(part: DataFrame) -> DataFrame:
        return _layers_by_joins(scored.join(part.select(SID).distinct(), SID, "left_semi"), part, max_depth, out)

    return by_page_size(types, small, large, page_limit, large_ids)


def _layers_in_row(scored: DataFrame, types: DataFrame, max_depth: int | None, out: str) -> DataFrame:
    ranked = F.sort_array(F.collect_list(F.struct(_preference().alias("by"), F.col(CAND).alias("c"))), asc=False)
    nodes = types.select(SID, IDX, is_leaf(F.col(TYPE)).alias("leaf")).join(
        scored.groupBy(SID, IDX).agg(ranked.alias("ranked")), [SID, IDX], "left"
    )
    page = F.sort_array(F.collect_list(F.struct(IDX, "leaf", F.col("ranked")["c"].alias("cands")))).alias("page")
    gathered = nodes.groupBy(SID).agg(page)
    # candidates as places in the page, the root as -1
    placed = gathered.withColumn("places", F.transform("page", lambda n: pa.links(F.col("page")[IDX], n["cands"])))

    def on_layer(parents: Column) -> Column:
        """Whether each node has just got its parent and may have children."""
        return F.zip_with(parents, "page", lambda p, n: p.isNotNull() & ~n["leaf"])

    first = F.transform("places", lambda c: F.when(F.get(c, F.lit(0)) < 0, F.lit(-1)))
    start = F.struct(first.alias("parents"), on_layer(first).alias("layer"))

    def step(s: Column, _: Column) -> Column:
        def best(c: Column) -> Column:
            return F.get(F.filter(c, lambda at: (at >= 0) & F.get(s["layer"], at)), F.lit(0))

        joined = F.zip_with(s["parents"], "places", lambda p, c: F.when(p.isNull(), best(c)))
        following = let(
            joined,
            lambda new: F.struct(
                F.zip_with(s["parents"], new, lambda p, q: F.coalesce(p, q)).alias("parents"), on_layer(new).alias("layer")
            ),
        )
        return F.when(F.exists(s["layer"], lambda on: on), following).otherwise(s)

    rounds = F.size("page") if max_depth is None else F.least(F.size("page"), F.lit(max_depth - 1))
    steps = F.when(rounds > 0, F.sequence(F.lit(1), F.greatest(rounds, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    parents = placed.select(SID, "page", F.aggregate(steps, start, step, lambda s: s["parents"]).alias("parents"))
    idx = F.col("page")[IDX]
    rows = let(idx, lambda ids: F.zip_with(ids, "parents", lambda i, p: F.struct(i.alias(IDX), F.when(p >= 0, F.get(ids, p)).otherwise(-1).cast("int").alias(out))))
    return parents.select(SID, F.inline(rows))


def _layers_by_joins(scored: DataFrame, types: DataFrame, max_depth: int | None, out: str) -> DataFrame:
    allowed = cut(scored)
    best = best_candidates(allowed)
    leaf = types.select(SID, IDX, is_leaf(F.col(TYPE)).alias("_leaf"))
    placed = cut(
        best.where("best < 0").select(SID, IDX, F.lit(-1).alias(out)).join(leaf, [SID, IDX])
    )
    layer = placed
    for _ in itertools.count(1) if max_depth is None else range(1, max_depth):
        hosts = layer.where(~F.col("_leaf")).select(SID, F.col(IDX).alias(CAND))
        open_scores = allowed.join(placed.select(SID, IDX), [SID, IDX], "left_anti")
        layer = cut(
            best_candidates(open_scores.join(hosts, [SID, CAND], "left_semi"))
            .select(SID, IDX, F.col("best").cast("int").alias(out))
            .join(leaf, [SID, IDX])
        )
        if layer.isEmpty():
            break
        placed = cut(placed.unionByName(layer))
    return types.select(SID, IDX).join(placed.select(SID, IDX, out), [SID, IDX], "left").select(
        SID, IDX, F.coalesce(out, F.lit(-1)).cast("int").alias(out)
    )


def softmax_confidence(scores: DataFrame, out: str = "confidence") -> DataFrame:
    """Largest softmax probability per node over its (masked) candidates.

    The scores are shuffled to their nodes once; top and sum are hash aggregations over the same
    exchange, without a sort.
    """
    placed = _whole(scores, SID, IDX, SCORE).select(SID, IDX, SCORE).repartition(SID, IDX)
    tops = placed.groupBy(SID, IDX).agg(F.max(SCORE).alias("_top"))
    return (
        placed.join(tops.hint("shuffle_hash"), [SID, IDX])
        .groupBy(SID, IDX)
        .agg((1 / F.sum(F.exp(F.col(SCORE) - F.col("_top")))).alias(out))
    )


def hybrid_parents(
    scores: DataFrame,
    types: DataFrame,
    heuristic: DataFrame,
    min_confidence: float = MIN_CONFIDENCE,
    out: str = "parent_idx",
) -> DataFrame:
    """Decoded parent where the model is confident, else the containment parent.

    ``heuristic`` is (sample_id, node_idx, box_parent).
    """
    masked = mask_scores(candidate_parents(scores, types))
    model = decode_parents(masked, types, masked=True)
    sure = softmax_confidence(masked)
    return (
        heuristic.select(SID, IDX, "box_parent")
        .join(model, [SID, IDX])
        .join(sure, [SID, IDX])
        .withColumn(
            out,
            F.when(F.col("confidence") >= min_confidence, F.col("model_parent"))
            .otherwise(F.col("box_parent"))
            .cast("int"),
        )
    )
