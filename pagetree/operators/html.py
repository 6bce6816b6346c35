"""Pages to nodes.

Lenient HTML needs a tokenizer, so ``page_nodes`` runs the standard library's parser on Arrow
batches; everything after that is columns.  A page is one value, so a task holds one page at a
time and sends its nodes on in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.constants import SKIP_TAGS, SKIP_TAGS_RENDERED
from .pages import IDX, SID

# --- fixed values: void elements of the HTML standard, those of its older versions included
VOID_TAGS = (
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex",
    "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
)
# --- fixed values: attributes that the HTML standard defines as space-separated lists, joined by one blank
WORD_LISTS = {
    "*": ("class", "accesskey", "dropzone"),
    "a": ("rel", "rev"),
    "link": ("rel", "rev"),
    "td": ("headers",),
    "th": ("headers",),
    "form": ("accept-charset",),
    "object": ("archive",),
    "area": ("rel",),
    "icon": ("sizes",),
    "iframe": ("sandbox",),
    "output": ("for",),
}

ATTRS = T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
)
NODE_FIELDS = [
    T.StructField(IDX, T.IntegerType()),
    T.StructField("parent_idx", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", ATTRS),
    T.StructField("inner_text", T.StringType()),
]
_ARROW_ATTRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_BATCH_NODES = 4096


class _Walker(HTMLParser):
    """Keeps the open elements; an end tag closes its nearest match and all above it."""

    def __init__(self, skip: frozenset[str], comments: bool):
        super().__init__(convert_charrefs=True)
        self.skip, self.comments = skip, comments
        self.kept: list[tuple] = []  # (parent, tag, attrs, text pieces)
        self.open: list[tuple[str, int]] = []  # (tag, index in kept or -1)
        self.run: list[str] = []

    def _parent(self) -> int:
        return next((at for _, at in reversed(self.open) if at >= 0), -1)

    def flush(self) -> None:
        text = "".join(self.run)
        self.run.clear()
        if text and self.open and self.open[-1][1] >= 0:
            if not text.strip():
                text = "\n" if "\n" in text else " "
            self.kept[self.open[-1][1]][3].append(text)

    def _add(self, tag: str, attrs: list) -> int:
        self.flush()
        if tag in self.skip:
            return -1
        words = WORD_LISTS["*"] + WORD_LISTS.get(tag, ())
        found: dict[str, str] = {}
        for name, value in attrs:
            value = value or ""
            found[name] = " ".join(value.split()) if name in words else value
        self.kept.append((self._parent(), tag, found, []))
        return len(self.kept) - 1

    def handle_starttag(self, tag, attrs):
        at = self._add(tag, attrs)
        if tag not in VOID_TAGS:
            self.open.append((tag, at))

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.run.append(data)

    def handle_comment(self, data):
        self.flush()
        if self.comments and self.open and self.open[-1][1] >= 0:
            self.kept[self.open[-1][1]][3].append(data)


def parse_page(html: str | None, mode: str = "static", text_limit: int | None = None) -> Iterator[tuple]:
    """(node_idx, parent_idx, tag, attrs, inner_text) in document order."""
    rendered = mode == "rendered"
    walker = _Walker(frozenset(SKIP_TAGS_RENDERED if rendered else SKIP_TAGS), not rendered)
    walker.feed(html or "")
    walker.close()
    walker.flush()
    for at, (parent, tag, attrs, pieces) in enumerate(walker.kept):
        yield (
            at,
            parent,
            tag,
            [{"name": k, "value": v} for k, v in attrs.items()],
            "".join(pieces).strip()[:text_limit],
        )


def page_nodes(
    pages: DataFrame, html: str = "html", page_id: str = SID, mode: str = "static", text_limit: int | None = None
) -> DataFrame:
    """One row per node: index, nearest kept ancestor, tag, attributes, direct text, serialised text.

    ``static`` drops seven undrawn tags and counts comments as direct text; ``rendered`` also drops
    ``noscript`` and ignores comments.  ``text_limit`` cuts the direct text (``TEXT_LIMIT`` gives the
    serialised form that models are trained on); without it the whole text stays.
    """
    id_type = pages.schema[page_id].dataType
    narrow = pages.select(F.col(page_id).alias(SID), F.col(html).alias("html"))
    schema = T.StructType([T.StructField(SID, id_type), *NODE_FIELDS])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrow = pa.schema(
                [
                    (SID, batch.schema.field(SID).type),
                    (IDX, pa.int32()),
                    ("parent_idx", pa.int32()),
                    ("tag", pa.string()),
                    ("attrs", _ARROW_ATTRS),
                    ("inner_text", pa.string()),
                ]
            )
            rows: list[tuple] = []
            for sid, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                for node in parse_page(page.as_py(), mode, text_limit):
                    rows.append((sid, *node))
                    if len(rows) >= _BATCH_NODES:
                        yield _batch(rows, arrow)
                        rows = []
            if rows:
                yield _batch(rows, arrow)

    nodes = narrow.mapInArrow(parse, schema)
    return nodes.withColumn(
        "node_text", tx.serialize_node(F.col("tag"), F.col("attrs"), F.col("inner_text"))
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def page_tags(pages: DataFrame, html: str = "html", page_id: str = SID) -> DataFrame:
    """Start tags with their place on the page, by pattern only (no nesting, scripts included)."""
    return pages.select(
        F.col(page_id).alias(SID), F.posexplode(tx.start_tags(F.col(html))).alias("pos", "tag")
    )


def skip_tags(nodes: DataFrame, skip: tuple[str, ...] = SKIP_TAGS) -> DataFrame:
    return nodes.where(tx.is_drawn(F.col("tag"), skip))


def visible_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are displayed, not hidden and have a width and a height."""
    shown = (F.col("display") != "none") & (F.col("visibility") != "hidden")
    return nodes.where(shown & (F.col("x2") != F.col("x1")) & (F.col("y2") != F.col("y1")))


def valid_nodes(nodes: DataFrame, mask: str = "node_mask") -> DataFrame:
    """Rows of padded input that hold a node."""
    return nodes.where(F.col(mask) >= 0.5)


def typed_nodes(nodes: DataFrame, mode: str = "strict") -> DataFrame:
    """Design type and its index from the serialised text."""
    kind = tx.node_type(tx.node_tag(F.col("node_text"), mode))
    return nodes.withColumn("node_type", kind).withColumn(
        "type_idx", tx.node_type_index(F.col("node_type"))
    )


def tag_frequency(tags: DataFrame, *by: str) -> DataFrame:
    return tags.groupBy(*by, "tag").agg(F.count("*").alias("n"))


def type_distribution(nodes: DataFrame, *by: str) -> DataFrame:
    return nodes.groupBy(*by, "node_type").agg(F.count("*").alias("n"))
