"""Design nodes: the flat table, the nested export and the rule-based prediction."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions import style as st
from ..functions import text as tx
from ..functions.constants import STYLE_CHOICES
from .boxes import parent_by_containment
from .pages import IDX, SID


def design_nodes(nodes: DataFrame, mode: str = "strict") -> DataFrame:
    """One flat row per node: id, name, type, paints, box and style.

    Expects type_idx, node_text, parent_idx and a box; predicted styles (reg, color and score
    arrays scores_*) are used where present.
    """
    have = set(nodes.columns)
    kind = tx.node_type_name(F.col("type_idx"))
    columns: list[Column] = [
        F.col(SID),
        F.col(IDX),
        F.col("parent_idx"),
        F.concat(F.lit("node_"), F.col(IDX)).alias("id"),
        tx.node_name(F.coalesce("node_text", F.lit("")), kind, mode).alias("name"),
        kind.alias("type"),
        g.box_to_xywh(g.box()).alias("absoluteBoundingBox"),
    ]
    style: list[Column] = []
    if "reg" in have:
        numbers = st.denormalize_style(F.col("reg"))
        columns += [numbers[c].alias(c) for c in ("cornerRadius", "strokeWeight", "opacity")]
        style += [numbers[c].alias(c) for c in ("fontSize", "fontWeight")]
    if "color" in have:
        background, front, border = (F.get("color", F.lit(i)) for i in range(3))
        fills, strokes = st.fills_strokes(background, border)
        style.append(st.rgba_struct(front).alias("fontColor"))
    else:
        nodes = st.with_inline_color(nodes, "_color")
        # the lambda in here keeps the row's many expressions out of one generated method that is too large to compile
        fills, strokes = st.paints(F.col("_color"), lambda c: c.isNotNull()), st.no_paints()
    for key, choices in STYLE_CHOICES.items():
        if f"scores_{key}" in have:
            style.append(st.argmax_style_class(F.col(f"scores_{key}"), choices).alias(key))
    columns += [fills.alias("fills"), strokes.alias("strokes")]
    if style:
        columns.append(F.struct(*style).alias("style"))
    return nodes.select(*columns)


def nest(ids: list[int], parents: list[int], documents: list[str]) -> str:
    """JSON list of the roots with their children, in node order; leaves get no ``children`` key.

    The text is put together from pieces in one walk, so its cost is its length.  Nodes on a cycle
    hang under no root and are left out.
    """
    place = {node: i for i, node in enumerate(ids)}
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parents):
        children.setdefault(place.get(p, -1), []).append(i)
    out, todo = ["["], [("list", -1)]
    while todo:
        kind, i = todo.pop()
        if kind == "text":
            out.append(i)
        elif kind == "list":
            below = children.get(i, ())
            for k in range(len(below) - 1, -1, -1):
                todo.append(("node", below[k]))
                if k:
                    todo.append(("text", ","))
        elif i in children:
            out.append(documents[i][:-1] + ',"children":[')
            todo += [("text", "]}"), ("list", i)]
        else:
            out.append(documents[i])
    return "".join(out) + "]"


def to_design_tree(design: DataFrame) -> DataFrame:
    """(sample_id, design): the nested JSON of each page, of any size.

    The result is one document per page, and so is the page's HTML: a page is what a row holds.
    Nodes on a cycle have no place in a tree and are left out.
    """
    fields = [c for c in design.columns if c not in (SID, IDX, "parent_idx")]
    rows = design.select(SID, IDX, "parent_idx", F.to_json(F.struct(*fields)).alias("doc"))

    @F.pandas_udf("string")
    def build(ids: pd.Series, parents: pd.Series, documents: pd.Series) -> pd.Series:
        return pd.Series([nest(*page) for page in zip(ids, parents, documents)], dtype=object)

    page = F.sort_array(F.collect_list(F.struct(IDX, "parent_idx", "doc")))
    return rows.groupBy(SID).agg(page.alias("page")).select(
        SID, build(F.col("page")[IDX], F.col("page")["parent_idx"], F.col("page")["doc"]).alias("design")
    )


def read_design_tree(trees: DataFrame) -> DataFrame:
    """(sample_id, id, name, type, parent, place) per node of nested design documents.

    ``parent`` is the id of the node above, null for a root; ``place`` counts among its children.
    """

    texts = [T.StructField(c, T.StringType()) for c in ("id", "name", "type", "parent")]
    schema = T.StructType([trees.schema[SID], *texts, T.StructField("place", T.IntegerType())])
    return trees.select(SID, "design").mapInArrow(_flatten, schema)


READ_ROWS = 10_000


def _flatten(batches):
    """The nodes of a batch of documents as columns, some ``READ_ROWS`` at a time."""
    names = ("id", "name", "type", "parent", "place")

    def table(ids, at, rows):
        kinds = [pa.string()] * 4 + [pa.int32()]
        columns = [pa.array(c, kind) for c, kind in zip(rows, kinds)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *columns], names=[SID, *names])

    for batch in batches:
        ids, documents = batch.column(0), batch.column(1)
        at, rows = [], ([], [], [], [], [])
        for i, text in enumerate(documents):
            todo = [(None, json.loads(text.as_py()))]
            while todo:
                parent, nodes = todo.pop()
                for place, node in enumerate(nodes):
                    at.append(i)
                    for column, value in zip(rows, (node.get("id"), node.get("name"), node.get("type"), parent, place)):
                        column.append(value)
                    if "children" in node:
                        todo.append((node.get("id"), node["children"]))
            if len(at) >= READ_ROWS:
                yield table(ids, at, rows)
                at, rows = [], ([], [], [], [], [])
        if at:
            yield table(ids, at, rows)


def heuristic_predict(
    nodes: DataFrame, tag_mode: str = "strict", box_mode: str = "strict", **sizes
) -> DataFrame:
    """Type from the tag, parent from box containment; no model involved."""
    kind = tx.node_type_index(tx.node_type(tx.node_tag(F.col("node_text"), tag_mode)))
    return parent_by_containment(nodes.withColumn("type_idx", kind), box_mode, "parent_idx", **sizes)
