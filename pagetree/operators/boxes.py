"""Joins on boxes: nodes to image patches, nodes to the smallest box around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions.binding import let
from ..functions.constants import GRID_SIZE, OVERLAP_THRESHOLD, PATCH_SIZE
from .pages import CHECK, IDX, PAGE_LIMIT, SID, by_page_size, cut

EDGES = ("x1", "y1", "x2", "y2")


def patch_box(patch: Column, size: int = PATCH_SIZE, n: int = GRID_SIZE) -> g.Box:
    """Box of a patch from its index (row · n + column)."""
    x = (patch % n) * float(size)
    y = F.floor(patch / n) * float(size)
    return x, y, x + float(size), y + float(size)


def patch_grid(spark: SparkSession, size: int = PATCH_SIZE, n: int = GRID_SIZE) -> DataFrame:
    patch = F.col("patch_idx")
    cells = spark.range(n * n).select(F.col("id").cast("int").alias("patch_idx"))
    return cells.select("patch_idx", *[c.alias(e) for e, c in zip(EDGES, patch_box(patch, size, n))])


def _cells(low: Column, high: Column, size: int, n: int) -> Column:
    """Rows (or columns) of the grid that an edge pair touches; null when it touches none or has
    no extent."""
    first = F.greatest(F.floor(low / size), F.lit(0)).cast("int")
    last = F.least(F.ceil(high / size) - 1, F.lit(n - 1)).cast("int")
    return F.when((high > low) & (last >= first), F.sequence(first, last))


def align_nodes_patches(
    nodes: DataFrame, threshold: float = OVERLAP_THRESHOLD, size: int = PATCH_SIZE, n: int = GRID_SIZE
) -> DataFrame:
    """(node, patch) pairs with an overlap coefficient of at least the threshold.

    Each box lists the cells it touches, at most n² of them, so there is neither join nor shuffle;
    the shared area factors into the two axes, so rows and columns are measured once per box.
    With a threshold of 0 or less every cell qualifies and is listed.
    """
    b = g.box()
    if threshold <= 0:
        placed = nodes.withColumn("patch_idx", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
        score = g.overlap_coefficient(b, patch_box(F.col("patch_idx"), size, n))
        return placed.select(SID, IDX, "patch_idx", score.alias("score"))
    smaller = F.least(g.box_area(b), F.lit(float(size * size)))
    x1, y1, x2, y2 = b
    rows = nodes.select(
        SID, IDX, x1, x2, y1, y2, smaller.alias("_a"),
        _cells(x1, x2, size, n).alias("_cols"),
        F.explode(_cells(y1, y2, size, n)).alias("_row"),
    )
    top = F.col("_row") * float(size)
    cells = rows.select(
        SID, IDX, x1, x2, "_a", "_row",
        (F.least(y2, top + float(size)) - F.greatest(y1, top)).alias("_h"),
        F.explode("_cols").alias("_col"),
    )
    left = F.col("_col") * float(size)
    width = F.least(x2, left + float(size)) - F.greatest(x1, left)
    return cells.select(
        SID,
        IDX,
        (F.col("_row") * n + F.col("_col")).cast("int").alias("patch_idx"),
        (width * F.col("_h") / F.col("_a")).alias("score"),
    ).where(F.col("score") >= threshold)


def _spans(low: Column, high: Column, size: int, n: int) -> Column:
    """Touched rows (or columns) of the grid with the length shared with each."""
    def span(i: Column) -> Column:
        start = i * float(size)
        return F.least(high, start + float(size)) - F.greatest(low, start)

    return F.transform(
        _cells(low, high, size, n), lambda i: F.struct(i.alias("i"), span(i).alias("w"))
    )


def positive_patches(
    b: g.Box, threshold: float = OVERLAP_THRESHOLD, size: int = PATCH_SIZE, n: int = GRID_SIZE
) -> Column:
    """The node's patches at a positive threshold, as a sorted list: its row of the label matrix
    without the zeros."""
    smaller = F.least(g.box_area(b), F.lit(float(size * size)))
    axes = F.struct(
        _spans(b[1], b[3], size, n).alias("rows"),
        _spans(b[0], b[2], size, n).alias("cols"),
        (smaller * threshold).alias("least"),
    )

    def pick(s: Column) -> Column:
        def in_row(r: Column) -> Column:
            met = F.filter(s["cols"], lambda c: r["w"] * c["w"] >= s["least"])
            return F.transform(met, lambda c: r["i"] * n + c["i"])

        return F.flatten(F.transform(s["rows"], in_row))

    return F.coalesce(let(axes, pick), F.array().cast("array<int>"))


def label_threshold(pairs: DataFrame, threshold: float = OVERLAP_THRESHOLD) -> DataFrame:
    return pairs.where(F.col("score") >= threshold)


# ---------------------------------------------------------------- smallest container


def parent_by_containment(
    nodes: DataFrame,
    mode: str = "strict",
    out: str = "box_parent",
    page_limit: int = PAGE_LIMIT,
    large_ids=CHECK,
) -> DataFrame:
    """Parent = smallest box around the node's box, lowest index on ties, -1 without one.

    ``strict`` nests equal areas only under a lower index and so yields a forest;
    ``reference`` excludes only the node itself, so identical boxes hold each other.  A box with
    a null edge, or with its edges in the wrong order, neither holds others nor lies in one.
    """

    def small(part: DataFrame) -> DataFrame:
        return _page_containers(part, mode, out)

    def large(part: DataFrame) -> DataFrame:
        found = _large_containers(part.select(SID, IDX, *EDGES), mode, out)
        return part.join(found, [SID, IDX])

    return by_page_size(nodes, small, large, page_limit, large_ids)


def _allowed(mode: str) -> Column:
    """Whether the box with ``_`` before its columns may be the parent of the other one."""
    area = g.box_area(g.box())
    if mode == "reference":
        return F.col("_idx") != F.col(IDX)
    return (F.col("_area") > area) | ((F.col("_area") == area) & (F.col("_idx") < F.col(IDX)))


def _whole() -> Column:
    return (F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2"))


def _page_containers(nodes: DataFrame, mode: str, out: str) -> DataFrame:
    """Smallest container inside pages of bounded size.

    The boxes of a page meet in a join on the page; the edges are compared in generated code and only
    a box and its containers go on, to an aggregation that needs no further shuffle.  Boxes are
    numbered by area and index first: the least number is kept in a hash table, where the least pair
    of values would have every container sorted by its box.
    """
    area = g.box_area(g.box())
    place = F.row_number().over(Window.partitionBy(SID).orderBy(area, IDX))
    outer = nodes.where(_whole()).select(
        SID, F.col(IDX).alias("_idx"), area.alias("_area"), place.alias("_place"), *[F.col(e).alias(f"_{e}") for e in EDGES]
    )
    more = {f.name: f.dataType for f in nodes.schema if f.name not in (SID, IDX, out)}
    # of fixed size: may change in the table; texts: part of its key; others have the groups sorted
    texts = [c for c, kind in more.items() if isinstance(kind, (T.StringType, T.BinaryType))]
    around = g.contains(g.box("_"), g.box()) & _allowed(mode) & _whole()
    met = nodes.join(outer, SID, "left").withColumn("_in", F.coalesce(around, F.lit(False)))
    # a page's own box stands for those without a container
    met = met.where(F.col("_in") | (F.col("_idx") == F.col(IDX)) | F.col("_idx").isNull() | ~F.coalesce(_whole(), F.lit(False)))
    best = F.min_by("_idx", F.when(F.col("_in"), F.col("_place")))
    found = met.groupBy(SID, IDX, *texts).agg(
        *[F.first(c).alias(c) for c in more if c not in texts], F.coalesce(best, F.lit(-1)).cast("int").alias(out)
    )
    return found.select(SID, IDX, *more, out)


_LEVELS = (-16, 40)


def _level(extent: Column) -> Column:
    """The power of two that an extent fits in."""
    low, high = _LEVELS
    fitted = F.ceil(F.log2(extent)).cast("int")
    return F.when(extent > 0, F.least(F.greatest(fitted, F.lit(low)), F.lit(high))).otherwise(low)


def _cell(edge: Column, level: Column) -> Column:
    return F.floor(edge / F.pow(F.lit(2.0), level)).cast("long")


def _smallest_first(area: Column, idx: Column) -> Column:
    """One number in the order of (area, index), as a hash table keeps a number but sorts a pair.

    The power of two that holds the area never falls as the area grows, and the area over that power is a
    fraction of 53 bits, so no two areas change places or fall together, from 2^-960 to 2^1000.
    """
    area = F.least(area, F.lit(2.0**1000))
    power = F.when(area > 2.0**-960, F.ceil(F.log2(area)).cast("int"))
    # halves of the power, as 2 to the whole of it would leave the range
    half = F.floor(power / 2)
    part = (area / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), power - half) * 2.0**53).cast("long")
    high = F.coalesce((power + 1000).cast("decimal(5,0)") * F.lit(2**54).cast("decimal(17,0)") + part, F.lit(0).cast("decimal(22,0)"))
    return (high * F.lit(_INDICES).cast("decimal(10,0)") + idx).cast("decimal(33,0)")


_INDICES = 1 << 31


def _large_containers(nodes: DataFrame, mode: str, out: str) -> DataFrame:
    """Smallest container through grids whose cells fit the boxes.

    A box belongs to the grid whose cells are as wide and as high as the next powers of two of its
    width and height, and touches at most four of its cells.  A box around another one lies in a grid
    with cells at least as wide and high and touches the cell with the other's top left corner, so a
    box asks one cell of each such grid that its page has.  A pair thus meets once at most, and the
    boxes met are those that overlap a cell of their own size around the corner.  Identical boxes ask
    nothing of one another; the lowest index (and the second, in reference mode) stands for them.
    """
    levels = [_level(F.col("x2") - F.col("x1")).alias("kx"), _level(F.col("y2") - F.col("y1")).alias("ky")]
    proper = nodes.where(_whole()).select(SID, IDX, *EDGES)
    lowest = F.min(IDX).alias("first")
    outer = proper.groupBy(SID, *EDGES).agg(lowest)
    if mode == "reference":
        others = proper.join(outer, [SID, *EDGES]).where(F.col(IDX) > F.col("first"))
        outer = outer.unionByName(others.groupBy(SID, *EDGES).agg(lowest))
    outer = cut(outer.select(SID, *EDGES, "first", g.box_area(g.box()).alias("area"), *levels))
    grids = outer.groupBy(SID).agg(F.collect_set(F.struct("kx", "ky")).alias("_grids"))

    def listed(axis: str) -> Column:
        return F.explode(F.sequence(*[_cell(F.col(f"{axis}{i}"), F.col(f"k{axis}")) for i in (1, 2)])).alias(f"c{axis}")

    ordered = outer.withColumn("_order", _smallest_first(F.col("area"), F.col("first")))
    cells = ordered.select("*", listed("x")).select("*", listed("y")).select(
        SID, "kx", "ky", "cx", "cy", F.col("first").alias("_idx"), F.col("area").alias("_area"), "_order", *[F.col(e).alias(f"_{e}") for e in EDGES]
    )
    asked = proper.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(levels)]).join(grids, SID)
    asked = asked.select(
        SID, IDX, *EDGES, F.inline(F.filter("_grids", lambda k: (k["kx"] >= F.col("_k0")) & (k["ky"] >= F.col("_k1"))))
    ).withColumns({"cx": _cell(F.col("x1"), F.col("kx")), "cy": _cell(F.col("y1"), F.col("ky"))})
    met = asked.join(cells, [SID, "kx", "ky", "cx", "cy"]).where(g.contains(g.box("_"), g.box()) & _allowed(mode))
    best = met.groupBy(SID, IDX).agg((F.min("_order") % _INDICES).cast("int").alias(out))
    return nodes.select(SID, IDX).join(best, [SID, IDX], "left").withColumn(out, F.coalesce(out, F.lit(-1)))


# ---------------------------------------------------------------- choosing a structure


def select_structure(
    nodes: DataFrame, mode: str, model: str = "model_parent", heuristic: str = "box_parent",
    confidence: str = "confidence", min_confidence: float = 0.3, out: str = "parent_idx",
) -> DataFrame:
    """Parents by mode: ``model``, ``heuristic`` or ``hybrid`` (model where it is confident)."""
    if mode == "hybrid":
        sure = F.col(confidence) >= min_confidence
        return nodes.withColumn(out, F.when(sure, F.col(model)).otherwise(F.col(heuristic)))
    return nodes.withColumn(out, F.col({"model": model, "heuristic": heuristic}[mode]))
