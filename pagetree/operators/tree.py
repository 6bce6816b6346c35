"""Tree operators on parent pointers: depth, sibling rank, truncation, layout, edit distance."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pagearrays as pa
from ..functions.binding import let
from ..functions.constants import MAX_DEPTH_INDEX, MAX_NODES
from .pages import CHECK, IDX, PAGE_LIMIT, SID, by_page_size, cut, node_rows, page_rows
from .ranks import rank_within

PARENT = "parent_idx"


def page_links(parent: str) -> Column:
    return pa.links(F.col("page")[IDX], F.col("page")[parent])


# ---------------------------------------------------------------- walks over large pages


def valid_links(nodes: DataFrame, parent: str = PARENT, out: str = "link") -> DataFrame:
    """(sample_id, node_idx, link, kids): the parent where it is a node of the page, else -1, and the
    number of nodes that link to this one.

    Nodes meet the parents asked for, one row each.  A parent without a node is left over on its side;
    only if there is one are the links joined again.  The table is written out.
    """
    link = F.greatest(F.coalesce(F.col(parent).cast("int"), F.lit(-1)), F.lit(-1))
    mine = nodes.select(SID, IDX, link.alias(out))
    asked = mine.where(F.col(out) >= 0).groupBy(SID, F.col(out).alias(IDX)).agg(F.count("*").alias("kids"))
    met = cut(mine.join(asked, [SID, IDX], "full").withColumn("kids", F.coalesce("kids", F.lit(0))))
    missing = met.where(F.col(out).isNull()).select(SID, F.col(IDX).alias(out), F.lit(True).alias("_missing"))
    links = met.where(F.col(out).isNotNull())
    if missing.isEmpty():
        return links
    known = links.join(missing, [SID, out], "left")
    return cut(known.select(SID, IDX, F.when(F.col("_missing"), -1).otherwise(F.col(out)).alias(out), "kids"))


def peel(links: DataFrame) -> tuple[DataFrame, int]:
    """Links with ``layer`` and ``s``, and the number of layers.

    A layer holds the nodes that nobody links to once the layers before are gone; ``s`` is the size of
    the subtree below such a node.  Peeling goes on while a layer is a quarter of what is left, so it
    ends after a number of rounds that grows with the logarithm of the nodes, and a node is sent as
    often as it outlives a layer.  What is left (chains, cycles) has the last number as its layer, and
    in ``s`` what was peeled off it.
    """
    state = links.withColumn("s", F.lit(1).cast("long"))
    left, layers = state.count(), []
    while left:
        outer, inner = state.where("kids = 0"), state.where("kids > 0")
        n = inner.count()
        if n > left * 0.75:
            break
        layers.append(outer)
        gained = outer.where("up >= 0").groupBy(SID, F.col("up").alias(IDX)).agg(
            F.count("*").alias("_kids"), F.sum("s").alias("_s")
        )
        state, left = inner, n
        if n:
            state = cut(
                inner.join(gained, [SID, IDX], "left").select(
                    SID, IDX, "up", (F.col("kids") - F.coalesce("_kids", F.lit(0))).alias("kids"),
                    (F.col("s") + F.coalesce("_s", F.lit(0))).alias("s"),
                )
            )
    numbered = state.withColumn("layer", F.lit(len(layers)))
    for i, layer in enumerate(layers):
        numbered = numbered.unionByName(layer.withColumn("layer", F.lit(i)))
    return numbered.drop("kids"), len(layers)


def climb(state: DataFrame, layers: int, merge: dict[str, Callable], stop: str | None = None) -> DataFrame:
    """Walk every pointer up to where it rests.

    ``state`` holds (sample_id, node_idx, up, layer, …payload), layers as ``peel`` numbers them.
    ``merge`` maps a payload column to a function (mine, other) -> Column.  ``stop`` names a flag
    column saying that the pointer rests where it shows.  What no layer holds goes by pointer doubling;
    then each layer, the last one first, reads the ends of the nodes it shows at.  A node with many
    children is a hot join key with one row on its other side, which adaptive execution splits.  Each
    round is written out, so a lost executor costs one round.
    """
    columns = [SID, IDX, "up", *([stop] if stop else []), *merge]
    state = cut(state.select(*columns, "layer"))
    moves = F.col("up") >= 0
    if stop:
        moves = moves & ~F.col(stop)

    def step(moving: DataFrame, shown: DataFrame) -> DataFrame:
        shown = shown.select(SID, F.col(IDX).alias("up"), *[F.col(c).alias(f"_{c}") for c in columns if c not in (SID, IDX)])
        return moving.join(shown, [SID, "up"]).select(
            SID,
            IDX,
            F.col("_up").alias("up"),
            *([F.col(f"_{stop}").alias(stop)] if stop else []),
            *[fn(F.col(c), F.col(f"_{c}")).alias(c) for c, fn in merge.items()],
        )

    done = _double(state.where(F.col("layer") == layers).select(*columns), moves, step)
    for i in range(layers - 1, -1, -1):
        layer = state.where(F.col("layer") == i).select(*columns)
        # only nodes of the layers above are shown at, and nobody shows at a node of this one yet
        ended = layer.where(~moves).unionByName(step(layer.where(moves), done))
        done = done.unionByName(cut(ended) if i else ended)
    return done


def _double(state: DataFrame, moves: Column, step: Callable) -> DataFrame:
    """Pointer doubling over rows: every round joins each node to the node its pointer shows.

    Rounds end when no pointer moves, after log2(longest chain) of them; a pointer that still moves
    after log2(largest page) rounds runs on a cycle.
    """
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    largest = state.groupBy(SID).count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(largest + 1)) + 1):
        moving = state.where(moves)
        if moving.isEmpty():
            break
        # joins that keep their partitions would double the number of these in each round
        state = cut(state.where(~moves).unionByName(step(moving, state)).coalesce(parts))
    return state


def _large_depths(nodes: DataFrame, parent: str) -> DataFrame:
    links, layers = peel(valid_links(nodes, parent, "up"))
    start = links.withColumn("d", (F.col("up") >= 0).cast("int"))
    return climb(start, layers, {"d": lambda a, b: a + b}).select(
        SID, IDX, F.when(F.col("up") < 0, F.col("d")).alias("_depth")
    )


# ---------------------------------------------------------------- depth


def tree_depth(
    nodes: DataFrame,
    parent: str = PARENT,
    clamp: int | None = MAX_DEPTH_INDEX,
    out: str = "depth",
    page_limit: int = PAGE_LIMIT,
    large_ids=CHECK,
) -> DataFrame:
    """Nodes with their depth (root 0, clamped) and ``is_cyclic``; depth is null on a cycle."""

    def finish(df: DataFrame) -> DataFrame:
        depth = F.col("_depth")
        value = F.least(depth, F.lit(clamp)) if clamp is not None else depth
        value = F.when(depth.isNotNull(), value)
        return df.withColumn(out, value).withColumn("is_cyclic", depth.isNull()).drop("_depth")

    def small(part: DataFrame) -> DataFrame:
        staged = page_rows(part).withColumn("depths", pa.depths(page_links(parent)))
        return finish(node_rows(staged, _depth=F.col("depths")))

    def large(part: DataFrame) -> DataFrame:
        return finish(part.join(_large_depths(part, parent), [SID, IDX]))

    return by_page_size(nodes, small, large, page_limit, large_ids)


def tree_depth_raw(nodes: DataFrame, parent: str = PARENT, out: str = "depth", **sizes) -> DataFrame:
    """Depth without the clamp."""
    return tree_depth(nodes, parent, None, out, **sizes)


def depth_histogram(
    nodes: DataFrame, gold: str = "gold_parent", pred: str = "pred_parent", **sizes
) -> DataFrame:
    """Node counts per depth for the true and the predicted tree."""
    def side(parent: str, name: str) -> DataFrame:
        narrow = nodes.select(SID, IDX, parent)
        return (
            tree_depth_raw(narrow, parent, **sizes)
            .groupBy("depth")
            .agg(F.count("*").alias("n"))
            .withColumn("side", F.lit(name))
        )

    return side(gold, "gold").unionByName(side(pred, "pred"))


# ---------------------------------------------------------------- siblings and children


def sibling_index(
    nodes: DataFrame,
    parent: str = PARENT,
    clamp: int | None = MAX_DEPTH_INDEX,
    out: str = "sibling_idx",
    page_limit: int = PAGE_LIMIT,
    large_ids=CHECK,
) -> DataFrame:
    """Place among the children of the same parent, by node order; all roots are siblings."""
    rank = F.col("_rank")
    value = (rank if clamp is None else F.least(rank, F.lit(clamp))).cast("int").alias(out)
    family = F.greatest(F.coalesce(parent, F.lit(-1)), F.lit(-1)).alias("_family")

    def small(part: DataFrame) -> DataFrame:
        ranked = rank_within(part.select("*", family), [SID, "_family"], [IDX], "_rank")
        return ranked.select(*part.columns, value)

    def large(part: DataFrame) -> DataFrame:
        narrow = part.select(SID, IDX, family)
        ranked = rank_within(narrow, [SID, "_family"], [IDX], "_rank", spread=True)
        return part.join(ranked.select(SID, IDX, value), [SID, IDX]).select(*part.columns, out)

    return by_page_size(nodes, small, large, page_limit, large_ids)


def child_list(nodes: DataFrame, parent: str = PARENT, **sizes) -> DataFrame:
    """One row per (page, parent, child) with the child's place: the child lists in long form."""
    narrow = nodes.where(F.col(parent) >= 0).select(SID, IDX, parent)
    return sibling_index(narrow, parent, None, "place", **sizes)


def children_of(nodes: DataFrame, parent: str = PARENT) -> DataFrame:
    """Each parent joined to its children."""
    child = nodes.select(SID, F.col(parent).alias(IDX), F.col(IDX).alias("child_idx"))
    return nodes.select(SID, IDX).join(child, [SID, IDX])


def child_counts(nodes: DataFrame, parent: str = PARENT) -> DataFrame:
    return (
        nodes.where(F.col(parent) >= 0)
        .groupBy(SID, F.col(parent).alias(IDX))
        .agg(F.count("*").alias("n_children"))
    )


def root_nodes(nodes: DataFrame, parent: str = PARENT) -> DataFrame:
    """Nodes whose parent is negative, out of range or not in the table.

    Nodes that say themselves that they are roots stay out of the join: on a flat page they would
    all meet under one key.
    """
    says_so = F.coalesce(F.col(parent) < 0, F.lit(True))
    here = nodes.select(SID, F.col(IDX).alias(parent))
    orphans = nodes.where(~says_so).join(here, [SID, parent], "left_anti")
    return nodes.where(says_so).unionByName(orphans)


def root_count(nodes: DataFrame, parent: str = PARENT) -> DataFrame:
    """Nodes with a negative parent per page."""
    return nodes.groupBy(SID).agg(F.count_if(F.col(parent) < 0).alias("n_roots"))


# ---------------------------------------------------------------- ancestors


def nearest_kept_ancestor(
    nodes: DataFrame,
    keep: str = "keep",
    parent: str = PARENT,
    out: str = "kept_parent",
    page_limit: int = PAGE_LIMIT,
    large_ids=CHECK,
) -> DataFrame:
    """Closest proper ancestor with a true ``keep`` flag, -1 without one."""

    def small(part: DataFrame) -> DataFrame:
        staged = page_rows(part).withColumn(
            "at",
            pa.nearest_kept(
                page_links(parent),
                F.transform(F.col("page")[keep], lambda k: F.coalesce(k, F.lit(False))),
            ),
        )
        found = let(
            F.col("page")[IDX],
            lambda idx: F.transform(
                "at", lambda j: F.when(j < 0, F.lit(-1)).otherwise(F.get(idx, j)).cast("int")
            ),
        )
        return node_rows(staged, **{out: found})

    def large(part: DataFrame) -> DataFrame:
        flags = part.select(
            SID, F.col(IDX).alias("up"), F.coalesce(keep, F.lit(False)).alias("up_rests")
        )
        links, layers = peel(valid_links(part, parent, "up"))
        start = links.where("up < 0").withColumn("up_rests", F.lit(True)).unionByName(
            links.where("up >= 0").join(flags, [SID, "up"])
        )
        found = climb(start, layers, {}, stop="up_rests").select(
            SID, IDX, F.when(F.col("up_rests"), F.col("up")).otherwise(F.lit(-1)).alias(out)
        )
        return part.join(found, [SID, IDX])

    return by_page_size(nodes, small, large, page_limit, large_ids)


def subtree_size(
    nodes: DataFrame, parent: str = PARENT, page_limit: int = PAGE_LIMIT, large_ids=CHECK
) -> DataFrame:
    """1 + sizes of the subtrees below, per node off cycles."""
    narrow = nodes.select(SID, IDX, parent)

    def small(part: DataFrame) -> DataFrame:
        reached = F.filter(pa.paths(page_links(parent)), lambda p: p.isNotNull())
        above = let(
            F.col("page")[IDX],
            lambda idx: F.transform(F.flatten(reached), lambda at: F.get(idx, at)),
        )
        return (
            page_rows(part)
            .select(SID, F.explode(above).alias(IDX))
            .groupBy(SID, IDX)
            .agg(F.count("*").alias("subtree_size"))
        )

    def large(part: DataFrame) -> DataFrame:
        return _large_sizes(*peel(valid_links(part, parent, "up"))).select(SID, IDX, F.col("s").alias("subtree_size"))

    return by_page_size(narrow, small, large, page_limit, large_ids)


def _large_sizes(links: DataFrame, layers: int) -> DataFrame:
    """(sample_id, node_idx, up, layer, s) of the nodes off cycles, ``s`` being their subtrees' sizes.

    Peeled nodes have theirs, unless they are peeled off a cycle.  For what is left, ``s`` holds the
    descendants within reach; a round adds those of the nodes 2^k below.
    """
    core = links.where(F.col("layer") == layers).select(SID, IDX, "up", "s")
    if core.isEmpty():
        return links
    state = core.withColumn("to", F.col("up"))
    largest = state.groupBy(SID).count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(largest + 1)) + 1):
        moving = state.where(F.col("to") >= 0)
        if moving.isEmpty():
            break
        gained = moving.groupBy(SID, F.col("to").alias(IDX)).agg(F.sum("s").alias("_gain"))
        above = state.select(SID, F.col(IDX).alias("to"), F.col("to").alias("_to"))
        state = cut(
            state.join(gained, [SID, IDX], "left")
            .join(above, [SID, "to"], "left")
            .select(
                SID,
                IDX,
                "up",
                F.coalesce("_to", F.lit(-1)).alias("to"),
                (F.col("s") + F.coalesce("_gain", F.lit(0))).alias("s"),
            )
        )
    sized = links.where(F.col("layer") < layers).unionByName(
        state.where(F.col("to") < 0).drop("to").withColumn("layer", F.lit(layers))
    )
    cyclic = state.where(F.col("to") >= 0)
    if cyclic.isEmpty():
        return sized
    # nodes that hang on a cycle are peeled as well, but belong to no tree
    hanging = climb(links, layers, {}).where(F.col("up") >= 0).select(SID, IDX)
    return sized.join(hanging, [SID, IDX], "left_anti")


_STRETCH = 1 << 16


def _sum_before(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the same keys with a lower ``order``.

    A key may hold most of the rows: sums are taken inside stretches of 65,536 places, and over the
    sums of the stretches before, if any row is past the first stretch.
    """
    rows = df.withColumn("_stretch", F.floor(F.col(order) / _STRETCH))
    alone = rows.where("_stretch <> 0").isEmpty()
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    if alone:
        return rows.withColumn(out, own).drop("_stretch")
    stretches = rows.groupBy(*keys, "_stretch").agg(F.sum(value).alias("_sum")).select(
        *keys, "_stretch", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )
    return rows.withColumn("_own", own).join(stretches, [*keys, "_stretch"]).withColumn(
        out, F.col("_own") + F.col("_before")
    ).drop("_own", "_before", "_stretch")


def preorder(nodes: DataFrame, parent: str = PARENT) -> DataFrame:
    """(sample_id, node_idx, depth, preorder) of the nodes that a root reaches, in pages of any size.

    A node's number is that of its parent plus one plus the sizes of its earlier siblings' subtrees.
    Sizes are summed upwards by doubling, the siblings' sizes once, and the steps along each node's
    ancestors by doubling again: about twice the logarithm of the longest chain in rounds.  Among the
    nodes of one depth, preorder is breadth-first order.
    """
    links, layers = peel(valid_links(nodes, parent, "up"))
    step = _sum_before(_large_sizes(links, layers), [SID, "up"], IDX, "s", "before")
    below = (F.col("up") >= 0).cast("int")
    start = step.select(SID, IDX, "up", "layer", (F.col("before") + below).alias("w"), below.alias("d"))
    add = lambda a, b: a + b
    return climb(start, layers, {"w": add, "d": add}).select(SID, IDX, F.col("d").alias("depth"), F.col("w").alias("preorder"))


def tree_size(nodes: DataFrame) -> DataFrame:
    """Nodes per page plus the virtual root."""
    return nodes.groupBy(SID).agg((F.count("*") + 1).alias("tree_size"))


# ---------------------------------------------------------------- breadth-first order


def _large_bfs(nodes: DataFrame, parent: str, max_nodes: int) -> DataFrame:
    """First nodes in breadth-first order: depth, then preorder.

    The rank limit is applied before the shuffle as well, so a task sends at most ``max_nodes`` rows
    of a page.
    """
    order = Window.partitionBy(SID).orderBy("depth", "preorder")
    ranked = preorder(nodes, parent).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_nodes)
    return ranked.select(SID, IDX, (F.col("_r") - 1).alias("rank"))


def bfs_truncate(
    nodes: DataFrame,
    max_nodes: int = MAX_NODES,
    parent: str = PARENT,
    page_limit: int = PAGE_LIMIT,
    large_ids=CHECK,
) -> DataFrame:
    """Keep the first ``max_nodes`` nodes of each page in breadth-first order.

    Pages within ``max_nodes`` keep all nodes in their original order.  ``new_idx`` is the new
    node index and ``new_parent`` the parent's new index (-1 for a root).
    """
    if page_limit < max_nodes:
        page_limit, large_ids = max_nodes, CHECK

    def small(part: DataFrame) -> DataFrame:
        staged = page_rows(part).withColumn("links", page_links(parent))
        order = F.when(
            F.size("page") <= max_nodes, F.sequence(F.lit(0), F.size("page") - 1)
        ).otherwise(F.slice(pa.breadth_first(pa.paths(F.col("links"))), 1, max_nodes))
        def renumber(page: Column, links: Column, order: Column) -> Column:
            def new_parent(at: Column) -> Column:
                p = F.get(links, at)
                place = F.coalesce(F.array_position(order, p), F.lit(0)) - 1
                return F.when(p < 0, F.lit(-1)).otherwise(place).cast("int")

            return F.transform(
                order,
                lambda at, i: F.struct(
                    F.get(page, at).alias("node"), i.alias("new_idx"), new_parent(at).alias("new_parent")
                ),
            )

        rows = let(
            F.struct(F.col("page").alias("page"), F.col("links").alias("links"), order.alias("order")),
            lambda s: renumber(s["page"], s["links"], s["order"]),
        )
        return staged.select(SID, F.inline(rows)).select(SID, "node.*", "new_idx", "new_parent")

    def large(part: DataFrame) -> DataFrame:
        kept = _large_bfs(part, parent, max_nodes)
        new = kept.select(SID, F.col(IDX).alias(parent), F.col("rank").alias("new_parent"))
        return (
            part.join(kept, [SID, IDX])
            .join(new, [SID, parent], "left")
            .withColumn("new_parent", F.coalesce("new_parent", F.lit(-1)))
            .withColumnRenamed("rank", "new_idx")
            .select(SID, IDX, *[c for c in part.columns if c not in (SID, IDX)], "new_idx", "new_parent")
        )

    return by_page_size(nodes, small, large, page_limit, large_ids)


def reindex_parents(nodes: DataFrame, kept: DataFrame, parent: str = PARENT, **sizes) -> DataFrame:
    """New parent index of every kept node, climbing over dropped nodes; -1 without a kept one.

    ``kept`` holds (sample_id, node_idx, new_idx).
    """
    flagged = nodes.select(SID, IDX, parent).join(kept, [SID, IDX], "left").withColumn(
        "keep", F.col("new_idx").isNotNull()
    )
    climbed = nearest_kept_ancestor(flagged, "keep", parent, "kept_parent", **sizes).where("keep")
    target = kept.select(
        SID, F.col(IDX).alias("kept_parent"), F.col("new_idx").alias("new_parent")
    )
    return climbed.join(target, [SID, "kept_parent"], "left").select(
        SID, IDX, "new_idx", F.coalesce("new_parent", F.lit(-1)).cast("int").alias("new_parent")
    )


# ---------------------------------------------------------------- layout


def tree_layout(
    nodes: DataFrame, parent: str = PARENT, page_limit: int = PAGE_LIMIT, large_ids=CHECK
) -> DataFrame:
    """x = (rank+1)/(layer size+1) and y = -depth, layers in breadth-first order."""
    narrow = nodes.select(SID, IDX, parent)

    def place(df: DataFrame) -> DataFrame:
        sizes = df.groupBy(SID, "depth").agg(F.count("*").alias("_size"))
        return df.join(sizes, [SID, "depth"]).select(
            SID, IDX,
            ((F.col("rank") + 1) / (F.col("_size") + 1)).alias("x"),
            (-F.col("depth")).cast("double").alias("y"),
        )

    def small(part: DataFrame) -> DataFrame:
        rows = let(
            F.struct(F.col("page")[IDX].alias("idx"), pa.paths(page_links(parent)).alias("paths")),
            lambda s: F.transform(
                pa.breadth_first(s["paths"]),
                lambda at, i: F.struct(
                    F.get(s["idx"], at).alias(IDX),
                    (F.size(F.get(s["paths"], at)) - 1).alias("depth"),
                    i.alias("_bfs"),
                ),
            ),
        )
        flat = page_rows(part).select(SID, F.inline(rows))
        layer = Window.partitionBy(SID, "depth")
        rank = F.row_number().over(layer.orderBy("_bfs"))
        size = F.count("*").over(layer)
        return flat.select(
            SID, IDX, (rank / (size + 1)).alias("x"), (-F.col("depth")).cast("double").alias("y")
        )

    def large(part: DataFrame) -> DataFrame:
        return place(rank_within(preorder(part, parent), [SID, "depth"], ["preorder"], "rank", spread=True))

    return by_page_size(narrow, small, large, page_limit, large_ids)


def tree_compare(
    nodes: DataFrame,
    gold: str = "gold_parent",
    pred: str = "pred_parent",
    label: str | None = None,
    **sizes,
) -> DataFrame:
    """Both layouts of each page: node and parent position, right-parent flag, short label."""
    text = F.col(label) if label else F.col(IDX).cast("string")
    short = F.substring(F.substring_index(text, ">", 1), 1, 20)
    facts = nodes.select(
        SID, IDX, F.col(gold).alias("_g"), F.col(pred).alias("_p"), short.alias("label")
    )

    def side(parent: str, name: str, own: str) -> DataFrame:
        at = tree_layout(nodes.select(SID, IDX, parent), parent, **sizes)
        end = at.select(SID, F.col(IDX).alias(own), F.col("x").alias("px"), F.col("y").alias("py"))
        return (
            at.join(facts, [SID, IDX])
            .join(end, [SID, own], "left")
            .select(
                SID, IDX, F.lit(name).alias("side"), "x", "y", "px", "py",
                (F.col("_g") == F.col("_p")).alias("correct"), "label",
            )
        )

    return side(gold, "gold", "_g").unionByName(side(pred, "pred", "_p"))


# ---------------------------------------------------------------- edit distance


def tree_edit_distance(
    nodes: DataFrame,
    gold: str = "gold_parent",
    pred: str = "pred_parent",
    page_limit: int = PAGE_LIMIT,
    large_ids=CHECK,
) -> DataFrame:
    """Children held by only one of the two trees of a page, over parents both reach alike."""
    narrow = nodes.select(SID, IDX, gold, pred)

    def small(part: DataFrame) -> DataFrame:
        staged = page_rows(part).select(
            SID, page_links(gold).alias("g"), page_links(pred).alias("p")
        )
        return staged.select(
            SID, pa.tree_edit_distance(F.col("g"), F.col("p")).cast("long").alias("tree_edit")
        )

    def large(part: DataFrame) -> DataFrame:
        links, layers = peel(valid_links(part, gold, "up"))
        other = valid_links(part, pred, "p").select(SID, IDX, "p")
        both = cut(links.withColumnRenamed("up", "g").join(other, [SID, IDX]))
        start = both.select(SID, IDX, F.col("g").alias("up"), "layer", (F.col("g") == F.col("p")).alias("ok"))
        alike = climb(start, layers, {"ok": lambda a, b: a & b}).where(
            (F.col("up") < 0) & F.col("ok")
        ).select(SID, IDX)
        differs = both.where(F.col("g") != F.col("p"))
        ends = differs.select(SID, F.explode(F.array("g", "p")).alias(IDX))
        per_end = ends.groupBy(SID, IDX).agg(F.count("*").alias("n"))
        counted = per_end.where(F.col(IDX) < 0).unionByName(
            per_end.join(alike, [SID, IDX], "left_semi")
        )
        sums = counted.groupBy(SID).agg(F.sum("n").alias("tree_edit"))
        pages = part.select(SID).distinct()
        return pages.join(sums, SID, "left").select(
            SID, F.coalesce("tree_edit", F.lit(0)).cast("long").alias("tree_edit")
        )

    return by_page_size(narrow, small, large, page_limit, large_ids)
