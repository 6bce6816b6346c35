"""Mixing sources to target weights with hash-threshold histograms.

Each document has a 40-bit hash of its id and text.  A source takes every document a whole number
of times, and once more those whose hash is below the source's threshold.  The threshold is found
without sorting: words are summed by source and leading hash bits, the bucket in which the budget
ends is found on the sums, and only that bucket is summed again by its next bits.  A smaller budget
has a lower threshold, so mixes for different budgets are nested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged
from .words import n_words

_LEVELS, _BITS = 4, 10
_SALTS = 32


def _key(source: str | Column) -> Column:
    """A join key that is never null and keeps null apart from every name."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with its number of words ``size`` and its hash ``_hash``; null text has size 0."""
    content = F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return docs.withColumns(
        {
            "size": n_words(F.col("text")),
            "_hash": F.conv(F.substring(F.md5(content), 1, _LEVELS * _BITS // 4), 16, 10).cast("long"),
        }
    )


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(_key, source_size, target) from (source, size).

    Sources in code-point order, null last, weigh as ``weights`` says, repeating.  Targets are
    min(most * size, level * weight) for the one level at which they add up to all sizes: what
    sharing out the excess again and again leads to.  The window is over one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.select("source", "source_size", weight.alias("_weight"), (F.col("source_size") * most).alias("_cap"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return (
        sources.withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(everything))
        .select(
            _key("source").alias("_key"),
            "source_size",
            F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight")).alias("target"),
        )
    )


def thresholds(narrow: DataFrame, targets: DataFrame) -> DataFrame:
    """(_key, source_size, target, _copies, _threshold) per source.

    ``narrow`` has _key, size and _hash.  A level joins on source and hash prefix, so that the rows
    of one large source are spread over many keys.  In the end the bucket is one hash; it is taken
    if that brings the source nearer to its target.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("_copies", copies.cast("long")).select(
        "*",
        (F.col("target") - F.col("_copies") * F.col("source_size")).alias("_rest"),
        F.lit(0).cast("long").alias("_prefix"),
        F.lit(0).cast("long").alias("_below"),
        F.lit(False).alias("_all"),
    )
    for level in range(_LEVELS):
        state = staged(state)
        shift = (_LEVELS - 1 - level) * _BITS
        # sums of the buckets below each source's prefix
        rows = narrow.select(
            "_key", F.shiftright("_hash", shift + _BITS).alias("_prefix"), F.shiftright("_hash", shift).alias("_bucket"), "size"
        )
        sums = rows.groupBy("_key", "_prefix", "_bucket").agg(F.sum("size").alias("_words"))
        inside = sums.join(state.where("not _all").select("_key", "_prefix", "_rest", "_below"), ["_key", "_prefix"])
        upto = Window.partitionBy("_key").orderBy("_bucket")
        first = (
            inside.withColumn("_upto", F.col("_below") + F.sum("_words").over(upto))
            .where(F.col("_upto") > F.col("_rest"))
            .groupBy("_key")
            .agg(F.min(F.struct("_bucket", "_upto", "_words")).alias("_at"))
        )
        joined = state.join(first, "_key", "left")
        found = F.col("_at").isNotNull()
        state = joined.select(
            "_key", "source_size", "target", "_copies", "_rest",
            F.when(found, F.col("_at._bucket")).otherwise(F.col("_prefix")).alias("_prefix"),
            F.when(found, F.col("_at._upto") - F.col("_at._words")).otherwise(F.col("_below")).alias("_below"),
            F.when(found, F.col("_at._words")).otherwise(0).alias("_words"),
            (~found).alias("_all"),
        )
    nearer = (F.col("_rest") - F.col("_below")) * 2 > F.col("_words")
    return staged(state).select(
        "_key", "source_size", "target", "_copies",
        F.when(F.col("_all"), F.lit(1 << (_LEVELS * _BITS)))
        .otherwise(F.col("_prefix") + nearer.cast("long")).cast("long").alias("_threshold"),
    )


def mix_sources(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of ``sized`` with source_size, target, copies and taken = copies * size.

    ``copies`` is 0 for documents the mix leaves out and at most ``most``.  A source of size 0 has
    target 0.  Null sources are a source of their own; rows that are equal in id and text are taken
    together; an empty table gives an empty result.  Columns of these names are replaced.
    """
    extra = ["source_size", "target", "copies", "taken"]
    kept = [c for c in rows.columns if c not in (*extra, "_hash")]
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), "source", _key("source").alias("_key"), "size", "_hash")
    narrow = staged(rows.drop("_row"))  # read once per level; the texts are not
    state = thresholds(narrow, source_targets(narrow, weights, most))
    salted = state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    joined = rows.withColumn("_salt", F.pmod("_hash", F.lit(_SALTS)).cast("int")).join(salted, ["_key", "_salt"])
    copies = F.col("_copies") + (F.col("_hash") < F.col("_threshold")).cast("long")
    return joined.withColumn("copies", copies).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in kept], "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
