"""Row numbers that never sort an unbounded group in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pages import cut

_ROW_BITS = 33


def global_rank(df: DataFrame, order: list[str | Column], out: str = "rank") -> DataFrame:
    """0-based rank of every row in the total order, by range partitioning.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the
    sizes of the partitions before it.  The sizes are one row per partition, hence the broadcast.
    Hand in narrow rows: they are written once, which also keeps the partitions as they are when
    an executor is lost.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftrightunsigned("_at", _ROW_BITS).cast("int"))
        .withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_at") + F.col("_offset"))
        .drop("_part", "_at", "_offset")
    )


def rank_within(
    df: DataFrame, keys: list[str], order: list[str], out: str = "rank", spread: bool = False
) -> DataFrame:
    """0-based rank within each key.

    The plain window is right while a key's rows fit a task.  With ``spread`` (keys of unknown
    size) rows are range-partitioned and sorted, so that a key's rows follow each other: a row's rank
    is its place among its key's rows of the partition, and for the first key of a partition also the
    key's rows in the partitions before.  Those are two counts per partition, hence the broadcast;
    nothing is joined by key.  ``keys + order`` must identify a row.
    """
    if not spread:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(window).cast("long") - 1)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType(df.schema.fields + [T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType()), T.StructField("_lead", T.BooleanType())])
    placed = cut(
        df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(_runs(keys), schema)
    )
    per_part = placed.groupBy("_part").agg(
        F.min(F.struct(*keys)).alias("first"),
        F.max(F.when(F.col("_lead"), F.col("_run"))).alias("n"),
        F.max(F.struct(F.struct(*keys).alias("key"), F.col("_run").alias("n"), F.lit(False).alias("lead"))).alias("last"),
    )
    first = F.struct(F.col("first").alias("key"), "n", F.lit(True).alias("lead"))
    ends = F.when(F.col("first").eqNullSafe(F.col("last.key")), F.array(first)).otherwise(F.array(first, "last"))
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", F.inline(ends)).select(
        "_part", "lead", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets.where("lead").drop("lead")), "_part")
        .withColumn(out, F.col("_run") + F.when(F.col("_lead"), F.col("_offset")).otherwise(0))
        .drop("_part", "_run", "_lead", "_offset")
    )


def _runs(keys: list[str]):
    """Adds to sorted batches the partition, a row's place among its key's rows there, and whether that
    key is the partition's first."""

    def add(batches):
        part, last, length, n_runs = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for key in keys:
                column = batch.column(batch.schema.get_field_index(key))
                after, here = column.slice(1), column.slice(0, n - 1)
                differ = pc.or_(pc.fill_null(pc.not_equal(after, here), False), pc.xor(after.is_null(), here.is_null()))
                new[1:] |= differ.to_numpy(zero_copy_only=False)
            ends = [tuple(batch.column(batch.schema.get_field_index(k))[i].as_py() for k in keys) for i in (0, n - 1)]
            new[0] = ends[0] != last
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            run = np.where(start < 0, at + length, at - start)
            count = n_runs + np.cumsum(new)
            last, length, n_runs = ends[1], int(run[-1]) + 1, int(count[-1])
            arrays = [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(run.astype(np.int64)), pa.array(count == 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "_part", "_run", "_lead"])

    return add
