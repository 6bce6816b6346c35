"""Incremental ingest with Structured Streaming.

The checkpoint remembers which files were read and, as state, the digest of every page stored, so
neither a restart nor the same page in a later file stores it twice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import text as tx
from ..functions.constants import NO_TOTAL
from ..operators.html import page_nodes
from ..sources.readers import parse_log_lines

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def page_stream(
    spark: SparkSession, path: str, schema: T.StructType = PAGES, files_per_batch: int = 1000
) -> DataFrame:
    """New Parquet files of a folder with pages of at least 200 characters."""
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )
    return stream.where(tx.long_enough(F.col("html")))


def new_pages(stream: DataFrame, html: str = "html") -> DataFrame:
    """The pages whose content no earlier row had.

    The state is one digest of 32 bytes per different page, dealt over the shuffle partitions; for
    more than the executors' memory set the session's state store provider to RocksDB.
    """
    return stream.withColumn("_digest", F.sha2(html, 256)).dropDuplicates(["_digest"]).drop("_digest")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, then stop; run it again for what came since."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, **options) -> StreamingQuery:
    return write_stream(new_pages(page_stream(spark, source, **options)), target, checkpoint)


def node_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, page_id: str = "page_id", **options
) -> StreamingQuery:
    """Nodes of the pages that are new since the last run."""
    nodes = page_nodes(new_pages(page_stream(spark, source, **options)), page_id=page_id)
    return write_stream(nodes, target, checkpoint)


def _log_records(spark: SparkSession, path: str) -> DataFrame:
    lines = (
        spark.readStream.schema("value string")
        .option("recursiveFileLookup", True)
        .text(path)
        .select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("run"), "value")
    )
    return parse_log_lines(lines)


def improvements_stream(spark: SparkSession, path: str, metric: str = "total") -> DataFrame:
    """(run, phase, epoch, <metric>): each record that improves on all before it, once, as it comes
    (for append output mode); a record without the metric counts as 1e9.

    Records are read in the order of their epochs within a batch, so a run's lines may be spread over
    files, but a later batch may not bring earlier epochs.  The state is the best value per run and
    phase.
    """
    value = F.coalesce(F.try_element_at("metrics", F.lit(metric)), F.lit(NO_TOTAL))
    rows = _log_records(spark, path).select("run", "phase", "epoch", value.alias(metric))

    def better(key, batches, state):
        best = state.get[0] if state.exists else float("inf")
        found = pd.concat(list(batches)).sort_values(["epoch", metric], ascending=[True, False], kind="stable")
        before = found[metric].cummin().shift(fill_value=best).clip(upper=best)
        state.update((min(best, float(found[metric].min())),))
        yield found[found[metric] < before][["run", "phase", "epoch", metric]]

    schema = f"run string, phase string, epoch int, {metric} double"
    return rows.groupBy("run", "phase").applyInPandasWithState(better, schema, "best double", "append", GroupStateTimeout.NoTimeout)


def run_log_stream(spark: SparkSession, path: str, metric: str = "total") -> DataFrame:
    """Best record per run and phase of growing JSON-lines logs (for complete output mode).

    The state is one row per run and phase.
    """
    value = F.try_element_at("metrics", F.lit(metric))
    return (
        _log_records(spark, path)
        .groupBy("run", "phase")
        .agg(
            F.min_by("epoch", value).alias("best_epoch"),
            F.min(value).alias(f"best_{metric}"),
            F.count("*").alias("n_records"),
        )
    )
