"""Sources.  Every reader states its schema; none infers one."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.binding import let
from ..functions.geometry import scale_box
from ..functions.style import STYLE_SCHEMA
from ..operators.ranks import rank_within

SID, IDX = "sample_id", "node_idx"
SAMPLE_KINDS = ("screenshot.png", "nodes", "node_texts.json", "parents", "styles.json")
META_SCHEMA = T.StructType(
    [
        T.StructField("bbox", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("scale", T.ArrayType(T.IntegerType())),
        T.StructField("lang", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page corpus in Parquet: text, bbox, score, scale, lang, hash.  Columns no one asks for,
    images among them, are never read."""
    corpus = spark.read.parquet(path)
    wanted = [c for c in ("text", "html", "content", "bbox", "score", "scale", "lang", "hash") if c in corpus.columns]
    return corpus.select(*wanted)


def corpus_html(corpus: DataFrame) -> DataFrame:
    """Corpus rows with ``html``: the first filled one of text, html and content."""
    texts = [F.col(c) for c in ("text", "html", "content") if c in corpus.columns]
    return corpus.withColumn("html", tx.pick_html(*texts))


def read_files_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(sample_id, value): whole files of one name, the sample id being their folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    return files.select(_folder(F.col("_metadata.file_path")).alias(SID), "value")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def read_page_files(spark: SparkSession, path: str, name: str = "page.html") -> DataFrame:
    return read_files_of(spark, path, name).withColumnRenamed("value", "html")


def files_in_order(spark: SparkSession, path: str, name: str = "*.parquet") -> DataFrame:
    """(file, place, rows): the Parquet files below a folder numbered by name, as the order in which
    a corpus is read; from their metadata, no page is read."""
    held = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).parquet(path)
    files = held.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
    return rank_within(files.withColumn("_one", F.lit(1)), ["_one"], ["file"], "place", spread=True).select("file", "place", "rows")


def read_pages_in_order(spark: SparkSession, path: str) -> DataFrame:
    """The corpus with ``place``: the number of each row in the order of files by name and of rows
    within them, however their splits are packed."""
    meta = F.col("_metadata")
    corpus = spark.read.option("recursiveFileLookup", True).parquet(path)
    placed = corpus.select("*", meta["file_path"].alias("_file"), meta["row_index"].alias("_row"))
    files = files_in_order(spark, path)
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(F.col("file").alias("_file"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_file").withColumn("place", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def read_node_lists(spark: SparkSession, path: str, name: str = "node_texts.json") -> DataFrame:
    """JSON arrays of node strings to (sample_id, node_idx, node_text)."""
    return parse_node_lists(read_files_of(spark, path, name))


def parse_node_lists(files: DataFrame) -> DataFrame:
    return files.select(SID, F.posexplode(F.from_json("value", "array<string>")).alias(IDX, "node_text"))


def read_styles(spark: SparkSession, path: str, name: str = "styles.json") -> DataFrame:
    """JSON arrays of style objects to (sample_id, node_idx, style)."""
    return parse_styles(read_files_of(spark, path, name))


def parse_styles(files: DataFrame) -> DataFrame:
    return files.select(
        SID, F.posexplode(F.from_json("value", T.ArrayType(STYLE_SCHEMA))).alias(IDX, "style")
    )


def read_meta(spark: SparkSession, path: str, name: str = "meta.json") -> DataFrame:
    """Page metadata.  A truncated file gives what can be read and keeps its text in
    ``_corrupt_record``; its box tree is taken from the text where it is whole."""
    return parse_meta(read_files_of(spark, path, name))


def parse_meta(files: DataFrame) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = files.select(SID, "value", F.from_json("value", META_SCHEMA, options).alias("m"))
    broken = F.col("m._corrupt_record").isNotNull()
    # the quoted value of "bbox" and the number of "score" are whole before the cut
    quoted = F.regexp_extract("value", r'"bbox"\s*:\s*("(?:[^"\\]|\\.)*")', 1)
    tree = F.from_json(F.concat(F.lit('{"v":'), quoted, F.lit("}")), "v string")["v"]
    score = F.regexp_extract("value", r'"score"\s*:\s*(-?\d+)', 1).try_cast("int")
    return parsed.select(
        SID,
        F.coalesce("m.bbox", F.when(broken, tree)).alias("bbox"),
        F.coalesce("m.score", F.when(broken, score)).alias("score"),
        "m.scale",
        "m.lang",
        "m.hash",
        F.col("m._corrupt_record").alias("_corrupt_record"),
    )


#: Spark's JSON parser takes no text that is nested deeper.
PARSED_NESTING = 1000
TREE_NODES = T.ArrayType(
    T.StructType(
        [
            T.StructField(IDX, T.IntegerType()),
            T.StructField("parent_idx", T.IntegerType()),
            *[T.StructField(f, T.StringType()) for f in ("type", "content", "style")],
            T.StructField("bbox", T.ArrayType(T.DoubleType())),
        ]
    )
)
_TOKEN = re.compile(r'[ \t\r\n]*([\[\]{},:]|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)')


def _parsed(text: str):
    """The value of a JSON text nested to any depth, without recursion; None if it is no JSON."""
    root, above, state, key, at = [], [], "value", "", 0
    into = root
    while token := _TOKEN.match(text, at):
        at, mark = token.end(), token[1]
        if state in ("value", "item") and mark not in (",", ":", "}", "]"):
            value = [] if mark == "[" else {} if mark == "{" else json.loads(mark)
            if isinstance(into, dict):
                into[key] = value
            else:
                into.append(value)
            state = {"[": "item", "{": "key"}.get(mark, "next")
            if state != "next":
                above.append(into)
                into = value
        elif state in ("key", "name") and mark[0] == '"' and (key := json.loads(mark)) not in into:
            state = "colon"
        elif state == "colon" and mark == ":":
            state = "value"
        elif state == "next" and mark == ",":
            state = "name" if isinstance(into, dict) else "value"
        elif state in ("next", "item", "key") and mark == ("}" if isinstance(into, dict) else "]"):
            into = above.pop()
            state = "next"
        else:
            return None
        if into is root:
            return root[0]
    return None


@F.udf(TREE_NODES)
def _deep_tree(text):
    """Nodes of a box tree in document order, as ``_in_document_order`` has them."""
    def words(value):
        return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)

    def numbers(value):
        try:
            return [None if x is None else float(x) for x in value] if isinstance(value, list) else None
        except (TypeError, ValueError):
            return None

    if text is None:
        return None
    try:
        waiting, found = [(_parsed(text), -1)], []
    except ValueError:
        return []
    while waiting:
        node, up = waiting.pop()
        if isinstance(node, dict) and node.get("type") is not None:
            at = len(found)
            found.append((at, up, *[words(node.get(f)) for f in ("type", "content", "style")], numbers(node.get("bbox"))))
            children = node.get("children")
            waiting.extend((c, at) for c in (reversed(children) if isinstance(children, list) else ()))
    return found


def _nesting(text: Column, kinds: str = "[]") -> Column:
    """How deep the arrays of a JSON text are nested: a bound on the depth of its tree; with ``[]{}``
    its arrays and objects."""
    quoted = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    quoted = F.translate(quoted, "{}", "[]") if kinds == "[]{}" else quoted
    brackets = F.split(F.regexp_replace(quoted, r"[^\[\]]", ""), "")

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def _flat_tree(tree: Column, depth: Column) -> Column:
    """Nodes of a VARIANT tree, level by level: path (positions from the root), place of the parent
    in this list (-1 for the root) and fields.

    The tree is parsed once; a level holds its nodes as VARIANT values, and the next one their
    children.
    """
    def entry(path: Column, up: Column, node: Column) -> Column:
        return F.struct(path.alias("path"), up.alias("up"), node.alias("node"))

    def typed(n: Column) -> Column:
        return F.try_variant_get(n["node"], "$.type", "string").isNotNull()

    def below(n: Column) -> Column:
        children = F.coalesce(F.try_variant_get(n["node"], "$.children", "array<variant>"), F.array().cast("array<variant>"))
        return F.filter(F.transform(children, lambda c, i: entry(F.concat(n["path"], F.array(i)), n["at"], c)), typed)

    def placed(entries: Column, count: Column) -> Column:
        return F.transform(entries, lambda n, i: F.struct((count + i).alias("at"), n["path"], n["up"], n["node"]))

    def facts(n: Column) -> Column:
        texts = [F.try_variant_get(n["node"], f"$.{f}", "string").alias(f) for f in ("type", "content", "style")]
        return F.struct(n["path"], n["up"], *texts, F.try_variant_get(n["node"], "$.bbox", "array<double>").alias("bbox"))

    def state(level: Column, count: Column, found: Column) -> Column:
        return F.struct(level.alias("level"), (count + F.size(level)).alias("count"), F.concat(found, F.array(F.transform(level, facts))).alias("found"))

    root = placed(F.filter(F.array(entry(F.array(F.lit(0)), F.lit(-1), tree)), typed), F.lit(0))
    nothing = F.filter(F.array(F.transform(root, facts)), lambda _: F.lit(False))

    def step(s: Column, _: Column) -> Column:
        following = placed(F.flatten(F.transform(s["level"], below)), s["count"])
        return let(following, lambda level: state(level, s["count"], s["found"]))

    return F.aggregate(F.sequence(F.lit(0), depth), state(root, F.lit(0), nothing), step, lambda s: F.flatten(s["found"]))


def _in_document_order(found: Column) -> Column:
    """The same nodes sorted by their paths, with node_idx and parent_idx."""
    def indexed(order: Column) -> Column:
        places = F.array_sort(F.transform(order, lambda o, i: F.struct(o["at"].alias("at"), i.alias("idx"))))

        def node(o: Column, i: Column, idx_of: Column) -> Column:
            n = F.get(found, o["at"])
            parent = F.when(n["up"] < 0, F.lit(-1)).otherwise(F.get(idx_of, n["up"]))
            return F.struct(i.alias(IDX), parent.alias("parent_idx"), n["type"], n["content"], n["style"], n["bbox"])

        return let(places["idx"], lambda idx_of: F.transform(order, lambda o, i: node(o, i, idx_of)))

    return let(F.array_sort(F.transform(found, lambda n, i: F.struct(n["path"].alias("path"), i.alias("at")))), indexed)


def explode_bbox_tree(meta: DataFrame) -> DataFrame:
    """Nested box trees to flat nodes in document order.

    A tree is one text of one row, so it is taken apart inside the row: no job or shuffle per level.
    Sorting the nodes by their paths restores document order.  Children of a node without a type
    are left out with it; a text that is no JSON has no nodes.  Texts nested too deep for Spark's
    parser are read by a helper of their own.
    """
    held = meta.where(F.col("bbox").isNotNull() & (F.col("bbox") != ""))
    deep = _nesting(F.col("bbox"), "[]{}") > PARSED_NESTING
    trees = held.select(SID, "bbox", F.when(deep, F.col("bbox")).alias("_deep")).select(
        SID,
        _deep_tree("_deep").alias("_read"),
        _flat_tree(F.try_parse_json(F.when(F.col("_deep").isNull(), F.col("bbox"))), _nesting(F.col("bbox"))).alias("_found"),
    )
    rows = trees.select(SID, F.inline(F.coalesce("_read", _in_document_order(F.col("_found")))))
    corner = [F.get("bbox", F.lit(i)) for i in range(4)]
    edges = scale_box((corner[0], corner[1], corner[0] + corner[2], corner[1] + corner[3]))
    return rows.select(
        SID,
        IDX,
        "parent_idx",
        F.col("type").alias("tag"),
        F.col("content").alias("inner_text"),
        F.col("style").alias("inline_style"),
        *[e.alias(c) for c, e in zip(("x1", "y1", "x2", "y2"), edges)],
    )


def list_sample_files(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, kind) of the files below a folder; only the listing is used, not the content."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    )
    return files.select(_folder(F.col("path")).alias(SID), F.regexp_extract("path", r"([^/]+)$", 1).alias("kind"))


# ---------------------------------------------------------------- runs


def read_run_log(spark: SparkSession, path: str, name: str = "*.jsonl") -> DataFrame:
    """JSON-lines logs to (run, seq, epoch, phase, metrics); lines that are no JSON are dropped.

    All number fields but epoch become metrics, so new losses need no new schema.  ``seq`` keeps
    the order of the lines of a file, however its splits are packed.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=name).select(
        meta["file_path"].alias("_file"),
        meta["file_block_start"].alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )
    # a split holds fewer lines than bytes, so its first byte plus the line's place in it is in order
    first = F.min("_at").over(Window.partitionBy("_file", "_start"))
    seq = (F.col("_start") + F.col("_at") - first).alias("seq")
    return parse_log_lines(lines.select(_folder(F.col("_file")).alias("run"), seq, "value"))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    fields = F.from_json("value", "map<string,string>")
    parsed = lines.withColumn("_f", fields).where(F.map_contains_key("_f", F.lit("phase")))
    numbers = F.map_filter(
        F.transform_values("_f", lambda k, v: v.try_cast("double")),
        lambda k, v: v.isNotNull() & ~k.isin("epoch", "phase"),
    )
    return parsed.select(
        *[c for c in lines.columns if c != "value"],
        F.try_element_at("_f", F.lit("epoch")).try_cast("int").alias("epoch"),
        F.try_element_at("_f", F.lit("phase")).alias("phase"),
        numbers.alias("metrics"),
    )


def read_run_metrics(spark: SparkSession, path: str, split: str = "val") -> DataFrame:
    """(run, metrics) of ``metrics_<split>.json``; a run without the file has no row, so a left
    join gives null."""
    files = read_files_of(spark, path, f"metrics_{split}.json")
    return files.select(F.col(SID).alias("run"), F.from_json("value", "map<string,double>").alias("metrics"))
