"""Loss arithmetic over stored scores, as aggregations."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.binding import let
from ..functions.constants import LOSS_WEIGHTS, NCE_TEMPERATURE, POS_WEIGHT_CAP, STYLE_CHOICES
from .metrics import _sum, masked_mean, reg_error, squares
from .pages import IDX, SID


def type_cross_entropy(
    nodes: DataFrame, scores: str = "type_scores", target: str = "gold_type"
) -> DataFrame:
    """Mean of minus log softmax at the true type over all nodes."""
    loss = v.cross_entropy(F.col(scores), F.col(target))
    return nodes.agg((F.sum(loss) / F.greatest(F.count("*"), F.lit(1))).alias("type"))


def parent_cross_entropy(
    scores: DataFrame, nodes: DataFrame, parent: str = "gold_parent", by: tuple[str, ...] = ()
) -> DataFrame:
    """Mean cross entropy at the true parent; a parent that is no candidate counts as root.

    Log-sum-exp and root score are hash aggregations over one exchange on the node.
    """
    target = nodes.select(SID, IDX, F.col(parent).alias("_t"))
    placed = scores.where(F.col("score").isNotNull()).repartition(SID, IDX)
    tops = placed.groupBy(SID, IDX).agg(F.max("score").alias("_top"))
    per_node = (
        placed.join(tops.hint("shuffle_hash"), [SID, IDX])
        .groupBy(SID, IDX)
        .agg(
            (F.max("_top") + F.log(F.sum(F.exp(F.col("score") - F.col("_top"))))).alias("_lse"),
            F.max(F.when(F.col("cand_idx") < 0, F.col("score"))).alias("_root"),
        )
    )
    hit = scores.join(
        target.select(SID, IDX, F.col("_t").alias("cand_idx")), [SID, IDX, "cand_idx"]
    ).select(SID, IDX, F.col("score").alias("_hit"))
    loss = F.col("_lse") - F.coalesce("_hit", "_root")
    return (
        per_node.join(target, [SID, IDX])
        .join(hit, [SID, IDX], "left")
        .groupBy(*by)
        .agg((F.sum(loss) / F.greatest(F.count("*"), F.lit(1))).alias("struct"))
    )


def parent_cross_entropy_rows(rows: DataFrame, parent: str = "gold_parent", by: tuple[str, ...] = ()) -> DataFrame:
    """The same over one array of scores per node, the root's last; no row leaves its place."""
    last = F.size("scores") - 1
    at = F.when((F.col(parent) >= 0) & (F.col(parent) < last), F.col(parent)).otherwise(last)
    loss = v.cross_entropy(F.col("scores"), at)
    return rows.groupBy(*by).agg((F.sum(loss) / F.greatest(F.count("*"), F.lit(1))).alias("struct"))


def positives_of(labels: Column) -> Column:
    """Dense 0/1 labels to the list of positive positions."""
    marked = F.transform(labels, lambda y, i: F.when(y == 1, i))
    return F.array_compact(marked)


def cells_of(nodes: DataFrame, sim: str = "sim", positives: str = "positives") -> DataFrame:
    """Fixed-length score arrays and sparse labels to one row per node and patch: x, positive."""
    listed = nodes.select(positives, F.posexplode(sim).alias("_p", "x"))
    return listed.select("x", F.array_contains(positives, F.col("_p")).alias("positive"))


def weighted_bce(cells: DataFrame, padded_cells: float | None = None) -> DataFrame:
    """Binary cross entropy with logits over (x, positive) rows; positives weigh min(neg/pos, 20).

    The weight enters linearly, so one pass collects the counts and both partial sums.  With
    ``padded_cells`` the negatives are counted in so many cells, as in padded tensors; the mean is
    still over the cells given.
    """
    x, hit = F.col("x"), F.col("positive")
    sums = cells.agg(
        F.count("*").cast("double").alias("n"),
        F.count_if(hit).cast("double").alias("pos"),
        F.sum(F.when(hit, v.softplus(-x)).otherwise(0.0)).alias("pos_loss"),
        F.sum(F.when(hit, 0.0).otherwise(v.softplus(x))).alias("neg_loss"),
    )
    counted = F.col("n") if padded_cells is None else F.lit(float(padded_cells))
    pos = F.greatest(F.col("pos"), F.lit(1.0))
    neg = F.greatest(counted - F.col("pos"), F.lit(1.0))
    weight = F.least(neg / pos, F.lit(POS_WEIGHT_CAP))
    loss = weight * F.coalesce("pos_loss", F.lit(0.0)) + F.coalesce("neg_loss", F.lit(0.0))
    return sums.select((loss / F.greatest("n", F.lit(1.0))).alias("align_bce"))


def infonce(
    nodes: DataFrame, sim: str = "sim", positives: str = "positives", temperature: float = NCE_TEMPERATURE
) -> DataFrame:
    """Mean of log-sum-exp minus the score of the first positive patch; 0 without positives.

    A node's scores are one short array, so its loss is computed from the row alone, for a batch of rows
    at once, and nothing is grouped by node.  A node without positives has a null loss, which the mean
    leaves out.
    """
    @F.arrow_udf("double")
    def loss(scores: pa.Array, first: pa.Array) -> pa.Array:
        listed = scores.flatten()
        flat = listed.to_numpy(zero_copy_only=False)
        n = pc.list_value_length(scores).fill_null(0).to_numpy(zero_copy_only=False)
        at = first.fill_null(-1).to_numpy(zero_copy_only=False)
        known = (at >= 0) & (at < n)
        if not known.any():
            return pa.nulls(len(n), pa.float64())
        starts = np.cumsum(n) - n
        filled = starts[n > 0]
        top = np.maximum.reduceat(flat, filled)
        total = np.add.reduceat(np.exp((flat - np.repeat(top, n[n > 0])) / temperature), filled)
        found = np.full(len(n), np.nan)
        found[n > 0] = np.log(total) + top / temperature
        found[known] -= flat[(starts + at)[known]] / temperature
        if listed.null_count:  # a null score leaves no loss
            known[n > 0] &= np.logical_and.reduceat(listed.is_valid().to_numpy(zero_copy_only=False), filled)
        return pa.array(found, mask=~known)

    per_node = loss(F.col(sim).cast("array<double>"), F.array_min(positives))
    return nodes.agg(F.coalesce(F.avg(per_node), F.lit(0.0)).alias("align_nce"))


def style_mse(styled: DataFrame) -> DataFrame:
    return styled.agg(masked_mean(*reg_error(power=2)).alias("style_reg"))


def color_mse(styled: DataFrame, mode: str = "strict") -> DataFrame:
    """Masked squared error over the four channels; ``reference`` divides by colours instead of
    channels and so is four times as large."""
    off = F.zip_with("pred_color", "color", lambda p, t: squares(p, t, 4))
    error = _sum(F.zip_with(off, "color_valid", lambda d, w: d * w))
    mean = masked_mean(error, _sum(F.col("color_valid")))
    return styled.agg((mean if mode == "reference" else mean / 4).alias("style_color"))


def style_cross_entropy(styled: DataFrame) -> DataFrame:
    """Mean of the cross entropies of the two style choices."""
    parts = [
        F.sum(v.cross_entropy(F.col(f"scores_{k}"), F.col(f"cls_{k}"))) / F.greatest(F.count("*"), F.lit(1))
        for k in STYLE_CHOICES
    ]
    return styled.agg((reduce(add, parts) / len(parts)).alias("style_cls"))


def weighted_total(terms: Column, weights: dict[str, float] | None = None) -> Column:
    """Sum of weight · term over a map of loss terms; an unknown term weighs 1."""
    known = {**LOSS_WEIGHTS, **(weights or {})}
    table = F.map_from_arrays(
        F.array(*[F.lit(k) for k in known]), F.array(*[F.lit(float(w)) for w in known.values()])
    )
    return F.aggregate(
        F.map_entries(terms),
        F.lit(0.0),
        lambda acc, e: acc + F.coalesce(F.try_element_at(table, e["key"]), F.lit(1.0)) * e["value"],
    )


def epoch_mean(steps: DataFrame) -> DataFrame:
    """Mean of each loss over the steps: (run, epoch, phase, metric, value) → one row per metric."""
    return steps.groupBy("run", "epoch", "phase", "metric").agg(F.avg("value").alias("value"))
