"""The tree and box operators on pages of hundreds of nodes, each way that they know.

The nodes of a supplier's lines make a page of about 600.  ``_wide`` gathers such a page into a row;
``_wide_split`` has it treated as a page too large for that.  Both are checked against one SQL.
"""

from __future__ import annotations

from . import node_queries, score_queries  # noqa: F401  (register what is repeated here)
from . import tables as t
from .registry import ORACLE, QUERIES, query

NAMES = (
    "tree_depth_raw", "sibling_index", "subtree_size", "bfs_truncate", "tree_layout", "tree_edit_distance", "parent_by_containment",
    "parent_by_containment_reference", "nearest_kept_ancestor",
)


def _sql(name: str) -> str:
    return ORACLE[name].replace("PARTITION BY l_orderkey", "PARTITION BY l_suppkey").replace("l_orderkey AS sample_id", "l_suppkey AS sample_id")


def _register(name: str, suffix: str, limit: int) -> None:
    @query(name + suffix, _sql(name))
    def wide(spark, sf_dir):
        with t.pages_by("l_suppkey", limit):
            return QUERIES[name](spark, sf_dir)


for _name in NAMES:
    _register(_name, "_wide", 2048)
    _register(_name, "_wide_split", 100)
