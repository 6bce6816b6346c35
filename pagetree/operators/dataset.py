"""Preparing sample sets: filters, splits, sampling, duplicates, padding, batches, coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import style as st
from ..functions import text as tx
from ..functions.constants import MAX_NODES, MIN_PAGE_CHARS, OVERLAP_THRESHOLD, SEED, TEXT_LIMIT, TRAIN_RATIO
from ..functions.geometry import box
from .boxes import EDGES, positive_patches
from .html import page_nodes
from .pages import IDX, SID, cut
from .ranks import global_rank
from .tree import bfs_truncate

REQUIRED_FILES = 5


# ---------------------------------------------------------------- corpus rows


def min_length(pages: DataFrame, n: int = MIN_PAGE_CHARS, html: str = "html") -> DataFrame:
    return pages.where(tx.long_enough(F.col(html), n))


def project_meta(pages: DataFrame) -> DataFrame:
    """Page metadata with defaults: 0, [] and ''."""
    have = set(pages.columns)

    def field(name: str, kind: str, default: Column) -> Column:
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return F.coalesce(value, default).alias(name)

    empty = F.array().cast("array<int>")
    keep = [c for c in (SID,) if c in have]
    return pages.select(
        *keep,
        field("bbox", "string", F.lit("")),
        field("score", "int", F.lit(0)),
        field("scale", "array<int>", empty),
        field("lang", "string", F.lit("")),
        field("hash", "string", F.lit("")),
    )


def discover_samples(files: DataFrame, required: int = REQUIRED_FILES) -> DataFrame:
    """Samples that have all required kinds of file: (sample_id, kind) rows in, ids out."""
    kinds = files.groupBy(SID).agg(F.count_distinct("kind").alias("_n"))
    return kinds.where(F.col("_n") == required).select(SID)


def skip_existing(new: DataFrame, done: DataFrame, key: str = SID, force: bool = False) -> DataFrame:
    """Rows whose key is not among the finished ones; ``force`` keeps all."""
    return new if force else new.join(done.select(key), key, "left_anti")


def align_style_rows(nodes: DataFrame, styles: DataFrame) -> DataFrame:
    """Nodes with their style row, null where there is none."""
    return nodes.join(styles, [SID, IDX], "left")


def encode_styles(nodes: DataFrame, style: str = "style") -> DataFrame:
    """A style struct to reg, reg_valid, color, color_valid and cls_* columns."""
    return nodes.withColumn("_e", st.encode_styles_struct(F.col(style))).select(
        *nodes.columns, "_e.*"
    )


# ---------------------------------------------------------------- order, split, sample


def order_key(column: str, seed: int = SEED) -> Column:
    """Pseudo-random but reproducible sort key of an id."""
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f":{seed}")))


def prefix_split(
    samples: DataFrame, ratio: float = TRAIN_RATIO, key: str = SID, at_least_one: bool = False
) -> DataFrame:
    """(id, split): the first floor(n·ratio) ids in order are ``train``, the others ``val``.

    Only ids are ranked, by range partitioning.  They are written first, so that counting, finding the
    ranges and ranking do not each derive them anew.
    """
    ids = cut(samples.select(key))
    n_train = math.floor(ids.count() * ratio)
    if at_least_one:
        n_train = max(1, n_train)
    split = F.when(F.col("rank") < n_train, "train").otherwise("val")
    return global_rank(ids, [key]).select(key, split.alias("split"))


def pick_split(samples: DataFrame, split: DataFrame, name: str, fallback: str | None = None, key: str = SID) -> DataFrame:
    """Samples of one split.  An empty split falls back to ``fallback``: a split or ``all``."""
    chosen = split.where(F.col("split") == name)
    if fallback and chosen.isEmpty():
        chosen = split if fallback == "all" else split.where(F.col("split") == fallback)
    return samples.join(chosen.select(key), key, "left_semi")


def hash_split(samples: DataFrame, ratio: float = TRAIN_RATIO, key: str = SID, seed: int = SEED) -> DataFrame:
    """Split by a hash of the id: no ranking, and ids keep their side when samples are added."""
    share = F.conv(F.substring(order_key(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return samples.select(key, F.when(share < ratio, "train").otherwise("val").alias("split"))


def shuffle(samples: DataFrame, key: str = SID, seed: int = SEED) -> DataFrame:
    """(id, position) in a reproducible random order."""
    keyed = samples.select(key, order_key(key, seed).alias("_o"))
    return global_rank(keyed, ["_o", key], "position").select(key, "position")


def sample_n(samples: DataFrame, n: int, key: str = SID, seed: int = SEED) -> DataFrame:
    """n ids without replacement, with consecutive four-digit names in the drawn order.

    The drawn ids are those with the least sort keys.  A threshold on the key's first 32 bits, five
    standard deviations above the share asked for, leaves few more than n, and only these are ranked;
    in the rare case that it leaves fewer, it is doubled.
    """
    keyed = samples.select(key, order_key(key, seed).alias("_o"))
    lead = F.conv(F.substring("_o", 1, 8), 16, 10).cast("long")
    total = keyed.count()
    share = (n + 5 * math.sqrt(n) + 25) / max(total, 1)
    low = keyed
    while share < 1:
        low = keyed.where(lead < int(share * (1 << 32)))
        if low.count() >= n:
            break
        share, low = share * 2, keyed
    drawn = global_rank(low, ["_o", key], "position").where(F.col("position") < n)
    return drawn.select(key, four_digits(F.col("position")).alias("new_name"))


def copy_sample(corpus: DataFrame, n: int, key: str = SID, seed: int = SEED) -> DataFrame:
    """The drawn rows of a corpus under their new names."""
    return corpus.join(sample_n(corpus, n, key, seed), key)


def four_digits(number: Column) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def renumber(samples: DataFrame, key: str = SID) -> DataFrame:
    """(id, new_name): consecutive four-digit names in id order."""
    return global_rank(samples.select(key), [key]).select(
        key, four_digits(F.col("rank")).alias("new_name")
    )


def first_n(samples: DataFrame, n: int, key: str = SID) -> DataFrame:
    """The first n rows by id."""
    return samples.orderBy(key).limit(n)


# ---------------------------------------------------------------- duplicates


def content_hash(html: Column) -> Column:
    return F.md5(html)


def dedupe_samples(samples: DataFrame, html: str = "html", key: str = SID) -> DataFrame:
    """One row per content, the lowest id.

    Only (hash, id) pairs are grouped, with partial aggregation, so a page with a huge number of
    copies costs one row per task.
    """
    keep = (
        samples.select(key, content_hash(F.col(html)).alias("_h"))
        .groupBy("_h")
        .agg(F.min(key).alias(key))
        .select(key)
    )
    return samples.join(keep, key, "left_semi")


def split_leakage(samples: DataFrame, split: DataFrame, html: str = "html", key: str = SID) -> DataFrame:
    """Content hashes found in both splits, with the number of samples on each side."""
    hashed = samples.select(key, content_hash(F.col(html)).alias("hash")).join(split, key)
    sides = hashed.groupBy("hash").agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "val").alias("n_val"),
    )
    return sides.where((F.col("n_train") > 0) & (F.col("n_val") > 0))


# ---------------------------------------------------------------- export shapes


def _padded(values: Column, n: int, pad) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(pad), n)), 1, n)


def pad_array(nodes: DataFrame, max_nodes: int = MAX_NODES, parent: str = "parent_idx") -> DataFrame:
    """Fixed-length arrays per page for trainers: boxes (0), parents (-1) and mask (0).

    Takes the result of ``bfs_truncate`` with its new indices, or a table whose pages have at most
    ``max_nodes`` rows; more is an error rather than a silent cut.
    """
    if {"new_idx", "new_parent"} <= set(nodes.columns):
        nodes = nodes.select(SID, F.col("new_idx").alias(IDX), F.col("new_parent").alias(parent), "x1", "y1", "x2", "y2")
    too_many = F.raise_error(F.lit(f"more than {max_nodes} nodes on a page: truncate first"))
    fits = nodes.select(
        SID,
        F.when(F.col(IDX) < max_nodes, F.col(IDX)).otherwise(too_many.cast("int")).alias(IDX),
        parent,
        F.array("x1", "y1", "x2", "y2").cast("array<double>").alias("box"),
    )
    page = fits.groupBy(SID).agg(
        F.sort_array(F.collect_list(F.struct(IDX, parent, "box"))).alias("page")
    )
    zero = F.array(*[F.lit(0.0)] * 4)
    n = F.size("page")
    return page.select(
        SID,
        n.alias("num_nodes"),
        F.slice(F.concat(F.col("page")["box"], F.array_repeat(zero, max_nodes)), 1, max_nodes).alias("boxes"),
        _padded(F.col("page")[parent].cast("array<int>"), max_nodes, -1).alias("parents"),
        _padded(F.array_repeat(F.lit(1.0), n), max_nodes, 0.0).alias("node_mask"),
    )


ENCODED = ("reg", "reg_valid", "color", "color_valid", "cls_textAlign", "cls_display")


def training_samples(
    nodes: DataFrame, max_nodes: int = MAX_NODES, parent: str = "parent_idx", threshold: float = OVERLAP_THRESHOLD, **sizes
) -> DataFrame:
    """One row per page as a trainer takes it, from nodes with node_text, box, parent and style.

    Pages are cut to ``max_nodes`` in breadth-first order and renumbered.  ``node_texts`` has
    ``num_nodes`` entries; all other arrays have ``max_nodes``: boxes, parents (-1), node_mask, patches
    (the places of the ones in each node's row of the label matrix) and the encoded styles.  A node
    without a style has zeros and no valid entry.
    """
    rows = nodes.select(SID, IDX, parent, "node_text", *EDGES, "style")
    cut = encode_styles(bfs_truncate(rows, max_nodes, parent, **sizes))
    node = F.struct(
        F.col("new_idx").alias("at"), F.col("new_parent").alias("parents"), F.col("node_text").alias("node_texts"),
        F.array(*EDGES).cast("array<double>").alias("boxes"), positive_patches(box(), threshold).alias("patches"), *ENCODED,
    )
    page = cut.groupBy(SID).agg(F.sort_array(F.collect_list(node)).alias("page"))
    n = F.size("page")
    zeros = lambda k: F.array(*[F.lit(0.0)] * k)
    fill = {
        "boxes": zeros(4), "patches": F.array().cast("array<int>"), "reg": zeros(5), "reg_valid": zeros(5), "color": F.array(*[zeros(4)] * 3),
        "color_valid": zeros(3), "parents": F.lit(-1), "cls_textAlign": F.lit(0), "cls_display": F.lit(0),
    }
    padded = [F.slice(F.concat(F.col("page")[c], F.array_repeat(v, max_nodes)), 1, max_nodes).alias(c) for c, v in fill.items()]
    return page.select(
        SID, n.alias("num_nodes"), F.col("page")["node_texts"].alias("node_texts"),
        _padded(F.array_repeat(F.lit(1.0), n), max_nodes, 0.0).alias("node_mask"), *padded,
    )


def corpus_samples(pages: DataFrame, layout: DataFrame, max_nodes: int = MAX_NODES, mode: str = "static", **sizes) -> DataFrame:
    """From a corpus (sample_id, html) to ``training_samples``.

    ``layout`` is what a browser tells of each node: (sample_id, node_idx, x1, y1, x2, y2, style).  A
    node that it leaves out has an empty box at the origin and no style.
    """
    nodes = page_nodes(pages, mode=mode, text_limit=TEXT_LIMIT).select(SID, IDX, "parent_idx", "node_text")
    placed = align_style_rows(nodes, layout.select(SID, IDX, *EDGES, "style"))
    return training_samples(placed.na.fill(0.0, list(EDGES)), max_nodes, **sizes)


def collate(samples: DataFrame, batch_size: int, key: str = SID) -> DataFrame:
    """(id, batch_id, slot): consecutive batches in id order."""
    ranked = global_rank(samples.select(key), [key])
    return ranked.select(
        key,
        F.floor(F.col("rank") / batch_size).alias("batch_id"),
        (F.col("rank") % batch_size).cast("int").alias("slot"),
    )


def collect_batches(samples: DataFrame, batches: DataFrame, *columns: str, key: str = SID) -> DataFrame:
    """One row per batch with its samples' columns stacked in slot order (batch_size rows each)."""
    stacked = F.sort_array(F.collect_list(F.struct("slot", key, *columns))).alias("batch")
    return samples.join(batches, key).groupBy("batch_id").agg(stacked)


def coverage(nodes: DataFrame, limits: list[int]) -> DataFrame:
    """Share of pages that fit each limit whole, and share of nodes kept by the cut."""
    sizes = nodes.groupBy(SID).agg(F.count("*").alias("n"))
    listed = sizes.select("n", F.explode(F.array(*[F.lit(m) for m in limits])).alias("max_nodes"))
    return listed.groupBy("max_nodes").agg(
        F.avg((F.col("n") <= F.col("max_nodes")).cast("double")).alias("page_share"),
        (F.sum(F.least("n", "max_nodes")) / F.sum("n")).alias("node_share"),
    )
