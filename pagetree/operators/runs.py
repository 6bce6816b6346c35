"""Run logs and run metrics: (run, seq, epoch, phase, metrics MAP<STRING,DOUBLE>)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import NO_TOTAL

BUCKET = 1 << 16
DETAIL_METRICS = (
    "type_acc", "parent_p", "parent_r", "parent_f1", "tree_edit", "style_reg_mae", "color_de", "cls_textAlign_acc", "cls_display_acc",
)
REPORT_METRICS = ("parent_f1", "tree_edit", "style_reg_mae", "color_de")


def metric(name: str, column: str = "metrics") -> Column:
    return F.try_element_at(F.col(column), F.lit(name))


def phase_filter(log: DataFrame, phase: str) -> DataFrame:
    return log.where(F.col("phase") == phase)


def has_metric(log: DataFrame, name: str) -> DataFrame:
    return log.where(F.map_contains_key("metrics", F.lit(name)))


def last_record(log: DataFrame, name: str = "total", seq: str = "seq") -> DataFrame:
    """Value of the last record per run and phase."""
    return log.groupBy("run", "phase").agg(
        F.max(seq).alias("last_seq"), F.max_by(metric(name), F.col(seq)).alias(f"last_{name}")
    )


def best_record(log: DataFrame, name: str = "total", seq: str = "seq") -> DataFrame:
    """Record with the smallest value per run and phase (missing = 1e9), the earliest on ties."""
    value = F.coalesce(metric(name), F.lit(NO_TOTAL))
    best = F.min(F.struct(value.alias("v"), F.col(seq).alias("s"))).alias("_b")
    kept = F.min_by("metrics", F.struct(value, F.col(seq))).alias("best_metrics")
    return (
        log.groupBy("run", "phase")
        .agg(best, kept, F.count("*").alias("n_records"))
        .select(
            "run", "phase", F.col("_b.s").alias("best_seq"), metric(name, "best_metrics").alias(f"best_{name}"),
            "n_records", "best_metrics",
        )
    )


def running_best(log: DataFrame, name: str = "total", seq: str = "seq") -> DataFrame:
    """Records that improve on everything before them in their run and phase.

    A run may be most of the log, so the running minimum is taken in two steps: within stretches of
    65,536 sequence numbers, and over the minima of the stretches before.
    """
    keys = ["run", "phase"]
    value = F.coalesce(metric(name), F.lit(NO_TOTAL))
    rows = log.select(*keys, seq, value.alias("value"), F.floor(F.col(seq) / BUCKET).alias("_b"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    lows = rows.groupBy(*keys, "_b").agg(F.min("value").alias("_low")).select(
        *keys, "_b", F.min("_low").over(earlier).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_in", F.min("value").over(inside)).join(lows, [*keys, "_b"])
    previous = F.least("_in", "_before")
    return seen.where(previous.isNull() | (F.col("value") < previous)).select(
        *keys, seq, F.col("value").alias(name)
    )


def loss_curve(log: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(run, phase, epoch, metric, value) of every recorded metric."""
    rows = log.select("run", "phase", "epoch", F.explode("metrics").alias("metric", "value"))
    return rows.where(F.col("metric").isin(*names)) if names else rows


def run_table(runs: DataFrame, log: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per listed run: last and best totals of its log, and its final metrics map."""
    val, train = phase_filter(log, "val"), phase_filter(log, "train")
    last_train = last_record(train).select("run", F.col("last_total").alias("final_train_total"))
    last_val = last_record(val).select("run", F.col("last_total").alias("final_val_total"))
    best = best_record(val).select(
        "run",
        F.col("n_records").alias("epochs"),
        F.col("best_total").alias("best_val_total"),
        metric("type_acc", "best_metrics").alias("best_val_type_acc"),
    )
    table = runs.select("run")
    for part in (best, last_train, last_val, metrics.select("run", "metrics")):
        table = table.join(part, "run", "left")
    return table.na.fill(0, ["epochs"])


@F.pandas_udf(T.StringType())
def _three_decimals(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else f"{v:.3f}")


def fixed(value: Column) -> Column:
    """Three decimals, a dash for null.

    Rounds the binary value, as C and Python do; ``format_string`` rounds its decimal text and
    differs on ties.  Reports have one row per run, so a Python function is fine here.
    """
    return F.coalesce(_three_decimals(value.cast("double")), F.lit("—"))


def run_comparison(table: DataFrame) -> DataFrame:
    """The comparison table: eight text columns."""
    return table.select(
        "run",
        F.col("epochs").cast("string").alias("epochs"),
        fixed(F.col("best_val_total")).alias("best_val_total"),
        fixed(F.col("best_val_type_acc")).alias("best_val_type_acc"),
        *[fixed(metric(m)).alias(m) for m in REPORT_METRICS],
    )


def run_details(metrics: DataFrame, names: tuple[str, ...] = DETAIL_METRICS) -> DataFrame:
    """(run, place, metric, value): the metrics that a run has, in the order of the report, as text
    with three decimals."""
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("metric"), metric(n).alias("_v")) for i, n in enumerate(names)])
    held = F.filter(listed, lambda m: F.map_contains_key("metrics", m["metric"]))
    rows = metrics.select("run", F.inline(held))
    return rows.select("run", "place", "metric", fixed(F.col("_v")).alias("value"))


def ablation_grid(metrics: DataFrame, baseline: str) -> DataFrame:
    """Difference of every run's metrics from the baseline run's (one row per metric name).

    The baseline is one row with one map, which every run's map meets inside its row.
    """
    base = metrics.where(F.col("run") == baseline).select(F.col("metrics").alias("_base")).limit(1)
    others = metrics.where(F.col("run") != baseline).select("run", "metrics", F.lit(1).alias("_one"))
    met = others.join(F.broadcast(base.withColumn("_one", F.lit(1))), "_one", "left")
    return met.select("run", "_base", F.explode("metrics").alias("metric", "value")).select(
        "run", "metric", "value", F.try_element_at("_base", F.col("metric")).alias("baseline")
    ).withColumn("delta", F.col("value") - F.col("baseline"))


def attention_grid(nodes: DataFrame, scores: str = "sim", k: int | None = None) -> DataFrame:
    """14×14 cells of each node's patch scores over their maximum; of the first ``k`` nodes of each
    page, for display, where that is given."""
    if k is not None:
        nodes = nodes.where(F.col("node_idx") < k)
    top = F.array_max(scores) + F.lit(1e-8)
    cells = nodes.select(
        "sample_id", "node_idx", top.alias("_top"), F.posexplode(scores).alias("patch_idx", "_s")
    )
    return cells.select(
        "sample_id",
        "node_idx",
        F.floor(F.col("patch_idx") / 14).cast("int").alias("row"),
        (F.col("patch_idx") % 14).alias("col"),
        (F.col("_s") / F.col("_top")).alias("heat"),
    )


def heat_sums(nodes: DataFrame, scores: str = "sim", logits: bool = False) -> DataFrame:
    """(row, col, n, heat): the cells of ``attention_grid`` counted and summed over all nodes.

    Each task adds up its nodes a batch at a time and passes on one row per cell, so no cell of a node
    becomes a row.  ``logits`` are scores before the sigmoid.
    """
    def add_up(batches):
        counts, held, sums = np.zeros(0), np.zeros(0), np.zeros(0)
        for batch in batches:
            lists = batch.column(0).drop_null()
            lists = lists.filter(pc.greater(pc.list_value_length(lists), 0))
            if not len(lists):
                continue
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            values = flat.to_numpy(zero_copy_only=False)
            starts = np.cumsum(n) - n
            place = np.arange(len(values)) - np.repeat(starts, n)
            with np.errstate(all="ignore"):
                values = 1 / (1 + np.exp(-values)) if logits else values
                top = np.maximum.reduceat(np.where(known, values, -np.inf), starts) + 1e-8
                heat = values / np.repeat(top, n)
            size = max(len(counts), int(n.max()))
            counts, held, sums = (np.pad(x, (0, size - len(x))) for x in (counts, held, sums))
            counts += np.bincount(place, minlength=size)
            held += np.bincount(place[known], minlength=size)
            sums += np.bincount(place[known], heat[known], minlength=size)
        cells = np.arange(len(counts), dtype=np.int32)
        columns = [pa.array(cells), pa.array(counts.astype(np.int64)), pa.array(sums, mask=held == 0)]
        yield pa.RecordBatch.from_arrays(columns, names=["patch_idx", "n", "heat"])

    parts = nodes.select(F.col(scores).cast("array<double>")).mapInArrow(add_up, "patch_idx int, n long, heat double")
    whole = parts.groupBy("patch_idx").agg(F.sum("n").alias("n"), F.sum("heat").alias("heat"))
    return whole.select(F.floor(F.col("patch_idx") / 14).cast("int").alias("row"), (F.col("patch_idx") % 14).alias("col"), "n", "heat")
