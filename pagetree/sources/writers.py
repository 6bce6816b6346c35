"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SID, IDX = "sample_id", "node_idx"


def write_nodes(nodes: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Nodes in Parquet, one folder per hash bucket of the page id.

    Rows are range-partitioned by bucket, page and node index: the number of tasks follows the
    session's shuffle partitions rather than the number of buckets, and a huge page is written by
    several tasks.
    """
    bucket = F.pmod(F.xxhash64(SID), F.lit(buckets)).cast("int")
    placed = nodes.withColumn("bucket", bucket).repartitionByRange("bucket", SID, IDX)
    placed.sortWithinPartitions("bucket", SID, IDX).write.mode(mode).partitionBy("bucket").parquet(path)


def save_node_table(nodes: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Nodes as a catalog table of sorted buckets by page: a page operator on it shuffles nothing.

    One task writes each bucket, so take enough buckets that the largest page fits its bucket well.
    """
    placed = nodes.repartition(buckets, SID)
    stored = placed.write.mode("overwrite").option("path", path).bucketBy(buckets, SID).sortBy(SID, IDX)
    stored.saveAsTable(table)


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Accepted pages: HTML and metadata, one row each."""
    samples.write.mode(mode).parquet(path)


def write_design_json(trees: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One design document per line, with its page id."""
    trees.write.mode(mode).json(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A metrics table of a few rows as one JSON file."""
    metrics.coalesce(1).write.mode(mode).json(path)


def write_run_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Log records as JSON lines: epoch, phase and the metrics side by side."""
    fields = F.map_concat(
        F.create_map(F.lit("epoch"), F.col("epoch").cast("string"), F.lit("phase"), F.col("phase")),
        F.transform_values("metrics", lambda k, v: v.cast("string")),
    )
    log.select(F.to_json(fields)).write.mode(mode).text(path)
