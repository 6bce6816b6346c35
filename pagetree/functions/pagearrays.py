"""Tree expressions on the arrays of one page (see ``operators.pages``).

A page is a set of parallel arrays.  ``links`` are parent positions, -1 for a root.  Every walk up
the tree is done by pointer doubling: after k rounds each node has seen its 2^k nearest
ancestors, so a page of n nodes takes log2(n) rounds over its arrays, whatever the order of its
nodes.  A node that has not met a root by then hangs on a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

ROOT = -1


def links(idx: Column, parents: Column) -> Column:
    """Parent ids to positions in the page; a missing or out-of-range parent makes a root."""
    def place(known: Column, p: Column) -> Column:
        return (
            F.when(p.isNull() | (p < 0), F.lit(ROOT))
            .when(F.coalesce(F.get(known, p) == p, F.lit(False)), p)
            .otherwise((F.array_position(known, p) - 1).cast("int"))
        )

    return let(
        F.transform(idx, lambda i: i.cast("int")),
        lambda known: F.transform(parents, lambda p: place(known, p.cast("int"))),
    )


def _rounds(values: Column) -> Column:
    return F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))


def _up(ups: Column) -> Column:
    return F.transform(ups, lambda u: F.when(u < 0, F.lit(ROOT)).otherwise(F.get(ups, u)))


def depths(links_: Column) -> Column:
    """Steps to the root per node; null on a cycle."""
    start = F.struct(
        links_.alias("up"), F.transform(links_, lambda p: (p >= 0).cast("int")).alias("d")
    )

    def step(s: Column, _: Column) -> Column:
        up, d = s["up"], s["d"]
        return F.struct(
            _up(up).alias("up"),
            F.zip_with(
                d, up, lambda x, u: x + F.when(u < 0, F.lit(0)).otherwise(F.get(d, u))
            ).alias("d"),
        )

    return F.aggregate(
        _rounds(links_), start, step,
        lambda s: F.zip_with(s["up"], s["d"], lambda u, d: F.when(u < 0, d)),
    )


def paths(links_: Column) -> Column:
    """Positions from the root down to each node; null on a cycle."""
    start = F.struct(
        links_.alias("up"), F.transform(links_, lambda p, i: F.array(i)).alias("path")
    )

    def step(s: Column, _: Column) -> Column:
        up, path = s["up"], s["path"]
        return F.struct(
            _up(up).alias("up"),
            F.zip_with(
                path, up, lambda x, u: F.when(u < 0, x).otherwise(F.concat(F.get(path, u), x))
            ).alias("path"),
        )

    return F.aggregate(
        _rounds(links_), start, step,
        lambda s: F.zip_with(s["up"], s["path"], lambda u, p: F.when(u < 0, p)),
    )


def chains_agree(links_: Column, agree: Column) -> Column:
    """True where a node and all its ancestors are flagged in ``agree``; false on a cycle."""
    start = F.struct(links_.alias("up"), agree.alias("ok"))

    def step(s: Column, _: Column) -> Column:
        up, ok = s["up"], s["ok"]
        return F.struct(
            _up(up).alias("up"),
            F.zip_with(ok, up, lambda x, u: x & ((u < 0) | F.get(ok, u))).alias("ok"),
        )

    return F.aggregate(
        _rounds(links_), start, step,
        lambda s: F.zip_with(s["up"], s["ok"], lambda u, ok: ok & (u < 0)),
    )


def tree_edit_distance(gold: Column, pred: Column) -> Column:
    """Children held by only one of two trees, over the parents that both trees reach alike."""
    def reached(ok: Column, parent: Column) -> Column:
        return ((parent < 0) | F.get(ok, parent)).cast("int")

    pairs = F.zip_with(gold, pred, lambda g, p: F.struct(g.alias("g"), p.alias("p")))
    return let(
        chains_agree(gold, F.zip_with(gold, pred, lambda g, p: g == p)),
        lambda ok: F.aggregate(
            F.filter(pairs, lambda s: s["g"] != s["p"]),
            F.lit(0),
            lambda n, s: n + reached(ok, s["p"]) + reached(ok, s["g"]),
        ),
    )


def nearest_kept(links_: Column, kept: Column) -> Column:
    """Position of the closest kept proper ancestor, -1 without one."""
    def walk(keep: Column) -> Column:
        def stays(j: Column) -> Column:
            return (j < 0) | F.get(keep, j)

        return F.aggregate(
            _rounds(links_),
            links_,
            lambda jump, _: F.transform(
                jump, lambda j: F.when(stays(j), j).otherwise(F.get(jump, j))
            ),
            lambda jump: F.transform(jump, lambda j: F.when(stays(j), j).otherwise(F.lit(ROOT))),
        )

    return let(kept, walk)


def breadth_first(paths_: Column) -> Column:
    """Positions of the nodes reached from a root, in breadth-first order."""
    keyed = F.transform(paths_, lambda p: F.struct(F.size(p).alias("n"), p.alias("path")))
    reached = F.array_sort(F.filter(keyed, lambda k: k["path"].isNotNull()))
    return F.transform(reached, lambda k: F.element_at(k["path"], -1))
