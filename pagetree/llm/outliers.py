"""Quality rules: counts of a text, and robust multivariate outliers per language and source.

The counts are turned into a vector of logarithms and log ratios.  For each language and source the
minimum-covariance-determinant estimate is approached by concentration steps: from a robust start,
take the half or more of the documents nearest to the centre, compute centre and covariance of
these, and repeat.  A document is rejected if its Mahalanobis distance under the estimate is beyond
a quantile of the chi-squared distribution.

A group too small for an estimate of its own is judged by that of its pool: all documents of its
language, or all there are if these are too few as well.  The pool's centre is then moved towards
the medians of the group, the further the more documents the group has.

Vectors are kept in whole 1/1024 and distances are ranked in whole buckets, so sums are exact and a
rerun gives the same result.  All of it is sums by group over one narrow table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged
from .words import SPACES, words

_UNIT = 1024
_P = 5
_FEATURES = tuple(f"_x{k}" for k in range(_P))
_SALTS = 16
_BINS = 16  # distance buckets for each doubling
_ALL = "*"  # the pool of all documents


@dataclass(frozen=True)
class OutlierRules:
    """Settings.

    ``share`` of a group's documents carries the estimate, after ``steps`` concentration steps.
    ``floors`` are the least standard deviations along the axes, as many clean groups have no spread
    at all in a rate; ``cutoff`` bounds the squared distance (the 0.9995 quantile of chi-squared with
    five degrees of freedom).  A group of n documents, fewer than ``least``, has the covariance of its
    pool, and a centre in which its own medians weigh n - 1 to ``prior`` for the pool's centre: a single
    document is held against the pool alone.  If the whole table has fewer than ``least`` documents,
    it is the pool all the same.
    """

    share: float = 0.75
    steps: int = 4
    floors: tuple[float, ...] = (0.5, 0.5, 0.4, 1.0, 1.0)
    cutoff: float = 22.11
    least: int = 30
    prior: float = 1.0
    window: int = 5
    min_words: int = 10
    repeat_percent: int = 20


def statistics(docs: DataFrame, window: int = 5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long).

    Windows are compared by hash.  Only a text with some equal pair of hashes has its positions
    sorted; then the words covered by repeated windows are counted from the gaps between them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("_w", words(text))
    gram = ", ".join(f"get(_w, i + {k})" for k in range(window))
    out = out.withColumn("n_words", F.size("_w").cast("long")).withColumn(
        "_h",
        F.expr(f"if(n_words < {window}, array(), transform(sequence(0, int(greatest(n_words - {window}, 0))), i -> xxhash64({gram})))").cast("array<bigint>"),
    )
    has_word = F.filter(F.split(text, "\\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    repeated = f"""transform(array(sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i)))), s ->
        array_sort(transform(filter(transform(s, (x, i) -> struct(
            x.i AS i, coalesce(get(s, i - 1).h = x.h, false) OR coalesce(get(s, i + 1).h = x.h, false) AS r)), y -> y.r), y -> y.i)))[0]"""
    covered = f"transform(array({repeated}), p -> aggregate(transform(p, (x, i) -> least({window}, coalesce(get(p, i + 1) - x, {window}))), 0, (a, x) -> a + x))[0]"
    return (
        out.withColumns(
            {
                "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
                "_lines": has_word,
                "n_repeat_words": F.expr(f"if(size(array_distinct(_h)) = size(_h), 0, {covered})").cast("long"),
            }
        )
        .withColumns(
            {
                "n_lines": F.size("_lines").cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            }
        )
        .drop("_w", "_h", "_lines")
    )


def _vector() -> dict[str, Column]:
    """Logarithms of size, word length and three percentages."""
    rate = lambda a, b: F.log1p(F.lit(100.0) * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = (
        F.log1p(F.col("n_words").cast("double")),
        F.lit(4.0) * F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
        rate("n_symbols", "word_chars"),
        rate("n_dup_lines", "n_lines"),
        rate("n_repeat_words", "n_words"),
    )
    return {name: F.floor(v * _UNIT).cast("long") for name, v in zip(_FEATURES, values, strict=True)}


def _part(c: str) -> Column:
    """A string that keeps null apart from every name."""
    return F.coalesce(F.concat(F.length(F.col(c)).cast("string"), F.lit("="), F.col(c)), F.lit("-"))


def _group_key() -> Column:
    """One string per language and source; no language's own key or ``_ALL`` is like it."""
    return F.concat(_part("lang"), F.lit("/"), _part("source"))


def _levels(narrow: DataFrame, how: OutlierRules) -> DataFrame:
    """(_group, _size, _pool, _keys) per group: its pool, null for a group with an estimate of its own;
    and what its rows count for, (_key, _fit) each, with ``_fit`` where an estimate is made."""
    sizes = narrow.groupBy("_group", "_lang").agg(F.count("*").alias("_size"))
    langs = sizes.groupBy("_lang").agg(F.sum("_size").alias("_of_lang"))
    pool = F.when(F.col("_size") < how.least, F.when(F.col("_of_lang") >= how.least, F.col("_lang")).otherwise(F.lit(_ALL)))
    levels = staged(sizes.join(langs, "_lang").select("_group", "_lang", "_size", pool.alias("_pool")))
    is_pool = lambda key: F.coalesce(F.max(F.col("_pool") == key), F.lit(False))
    by_lang = levels.groupBy("_lang").agg(is_pool(F.col("_lang")).alias("_by_lang"))
    by_all = levels.agg(is_pool(F.lit(_ALL)).alias("_by_all"))
    key = lambda name, fit: F.struct(name.alias("_key"), fit.alias("_fit"))
    keys = F.array_compact(
        F.array(
            key(F.col("_group"), F.col("_pool").isNull()),
            F.when(F.col("_by_lang"), key(F.col("_lang"), F.lit(True))),
            F.when(F.col("_by_all"), key(F.lit(_ALL), F.lit(True))),
        )
    )
    return levels.join(by_lang, "_lang").crossJoin(F.broadcast(by_all)).select("_group", "_size", "_pool", keys.alias("_keys"))


def _salted(state: DataFrame) -> DataFrame:
    return state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))


def _estimate(rows: DataFrame, scale: float, how: OutlierRules) -> DataFrame:
    """(_group, centre _m0.., factor _l00..) from the rows given, by a Cholesky factor per group."""
    sums = [F.sum(x).alias(f"_s{i}") for i, x in enumerate(_FEATURES)]
    sums += [F.sum(F.col(_FEATURES[i]) * F.col(_FEATURES[j])).alias(f"_q{i}{j}") for i in range(_P) for j in range(i + 1)]
    out = rows.groupBy("_group").agg(F.count("*").cast("double").alias("_n"), *sums)
    mean = {i: F.col(f"_s{i}") / F.col("_n") for i in range(_P)}
    out = out.select(
        "_group",
        *[mean[i].alias(f"_m{i}") for i in range(_P)],
        *[
            ((F.col(f"_q{i}{j}") / F.col("_n") - mean[i] * mean[j]) * scale / _UNIT**2 + (how.floors[i] ** 2 if i == j else 0.0)).alias(f"_c{i}{j}")
            for i in range(_P)
            for j in range(i + 1)
        ],
    )
    for j in range(_P):
        own = sum((F.col(f"_l{j}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"_l{j}{j}", F.sqrt(F.greatest(F.col(f"_c{j}{j}") - own, F.lit(how.floors[j] ** 2 / 4))))
        for i in range(j + 1, _P):
            dot = sum((F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"_l{i}{j}", (F.col(f"_c{i}{j}") - dot) / F.col(f"_l{j}{j}"))
    return staged(out.select("_group", *[f"_m{i}" for i in range(_P)], *[f"_l{i}{j}" for i in range(_P) for j in range(i + 1)]))


def _with_distance(rows: DataFrame, estimate: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the squared Mahalanobis distance ``_d``; forward substitution, one column each."""
    out = rows.join(_salted(estimate), ["_group", "_salt"], how)
    for i in range(_P):
        rest = sum((F.col(f"_l{i}{k}") * F.col(f"_y{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"_y{i}", ((F.col(_FEATURES[i]) - F.col(f"_m{i}")) / _UNIT - rest) / F.col(f"_l{i}{i}"))
    return out.select(*rows.columns, sum(F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(_P)).alias("_d"))


def _nearest(rows: DataFrame, share: float) -> DataFrame:
    """The rows of each group up to the distance bucket in which ``share`` of them is reached."""
    rows = rows.withColumn("_bin", F.floor(F.log2(F.col("_d") + 1e-9) * _BINS).cast("long"))
    counts = rows.groupBy("_group", "_bin").agg(F.count("*").alias("_k"))
    group = Window.partitionBy("_group")
    reached = (
        counts.withColumn("_upto", F.sum("_k").over(group.orderBy("_bin")))
        .withColumn("_all", F.sum("_k").over(group))
        .where(F.col("_upto") >= F.ceil(F.col("_all") * share))
        .groupBy("_group")
        .agg(F.min("_bin").alias("_most"))
    )
    return rows.join(_salted(reached), ["_group", "_salt"]).where("_bin <= _most")


def _consistency(share: float) -> float:
    """What the covariance of the nearest share of a normal sample lacks, for _P dimensions."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, _P) < share else (lo, mid)
    return share / _chi2(lo, _P + 2)


def _chi2(x: float, k: int) -> float:
    """Distribution function of chi-squared with an odd number of degrees of freedom."""
    total, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for m in range(3, k + 1, 2):
        total -= term
        term *= x / m
    return total


def _medians(narrow: DataFrame) -> DataFrame:
    """The start: per group the median of each coordinate, to 1/16, with a spread of one."""
    longer = narrow.select("_group", F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.shiftright(x, 6).alias("_b")) for i, x in enumerate(_FEATURES)])))
    counts = longer.groupBy("_group", "_i", "_b").agg(F.count("*").alias("_k"))
    axis = Window.partitionBy("_group", "_i")
    middle = (
        counts.withColumn("_upto", F.sum("_k").over(axis.orderBy("_b")))
        .withColumn("_all", F.sum("_k").over(axis))
        .where(F.col("_upto") * 2 >= F.col("_all"))
        .groupBy("_group")
        .agg(*[(F.min(F.when(F.col("_i") == i, F.col("_b"))) * 64.0 + 32.0).alias(f"_m{i}") for i in range(_P)])
    )
    return staged(middle.select("*", *[F.lit(1.0 if i == j else 0.0).alias(f"_l{i}{j}") for i in range(_P) for j in range(i + 1)]))


def robust_outliers(rows: DataFrame, how: OutlierRules = OutlierRules()) -> DataFrame:  # noqa: B008
    """``rows`` (doc_id, lang, source and the columns of ``statistics``) with distance and outlier.

    ``distance`` is the squared Mahalanobis distance; a text without words has none and is no
    outlier.  Null languages and sources are groups of their own; small ones are judged by a pool.  Columns of these names are
    replaced.
    """
    keep = [c for c in rows.columns if c not in ("distance", "outlier")]
    rows = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), "n_words", _group_key().alias("_group"), _part("lang").alias("_lang"),
        F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(_SALTS)).cast("int").alias("_salt"),
        *[v.alias(k) for k, v in _vector().items()],
    )
    rows = staged(rows)
    narrow = rows.where("n_words > 0").select("_group", "_lang", "_salt", *_FEATURES)
    levels = staged(_levels(narrow, how))
    wide = narrow.join(_salted(levels.select("_group", "_keys")), ["_group", "_salt"]).select(F.inline("_keys"), "_salt", *_FEATURES)
    wide = staged(wide.withColumnRenamed("_key", "_group"))
    medians = _medians(wide)
    fitted, estimate = wide.where("_fit").drop("_fit"), medians
    for _ in range(how.steps):
        estimate = _estimate(_nearest(_with_distance(fitted, estimate), how.share), _consistency(how.share), how)
    by = levels.select("_group", "_size", "_pool", F.coalesce("_pool", "_group").alias("_by"))
    own = medians.select("_group", *[F.col(f"_m{i}").alias(f"_o{i}") for i in range(_P)])
    weight = F.when(F.col("_pool").isNull(), 0.0).otherwise((F.col("_size") - 1) / (F.col("_size") - 1 + how.prior))
    judge = by.join(estimate.withColumnRenamed("_group", "_by"), "_by").join(own, "_group")
    judge = judge.withColumns({f"_m{i}": F.col(f"_m{i}") + weight * (F.col(f"_o{i}") - F.col(f"_m{i}")) for i in range(_P)})
    measured = _with_distance(rows, staged(judge.drop("_by", "_size", "_pool", *[f"_o{i}" for i in range(_P)])), how="left")
    distance = F.when(F.col("n_words") > 0, F.col("_d"))
    return measured.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in keep],
        distance.alias("distance"),
        F.coalesce(distance > how.cutoff, F.lit(False)).alias("outlier"),
    )


def quality_rules(docs: DataFrame, how: OutlierRules = OutlierRules()) -> DataFrame:  # noqa: B008
    """Per row of ``docs`` its statistics, base_failed, distance, outlier and kept; without the text.

    ``base_failed``: fewer than ``min_words`` words, or more than ``repeat_percent`` percent of them
    in repeated windows.  ``kept``: neither that nor an outlier.  A null text has no words and fails;
    null ids are judged like any other; an empty table gives an empty result.
    """
    counted = statistics(docs.select("doc_id", "lang", "source", "text"), how.window).drop("text")
    failed = (F.col("n_words") < how.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * how.repeat_percent)
    judged = robust_outliers(counted, how)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
