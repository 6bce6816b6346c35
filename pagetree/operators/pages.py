"""Pages of bounded and of unbounded size.

Most operators work inside a page.  A page of up to ``PAGE_LIMIT`` nodes is gathered into one row
and handled with array expressions: one shuffle on ``sample_id`` and no pair of nodes ever becomes
a row.  A larger page must not be gathered, so its nodes stay rows and go through joins and
aggregations instead.  ``by_page_size`` measures the pages and picks the way for each.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SID, IDX = "sample_id", "node_idx"
PAGE_LIMIT = 2048
BROADCAST_IDS = 100_000
CHECK = object()


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``, deleted when the session's JVM ends.

    Only a session on the local master may leave that setting out; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/pages-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the table to the shared folder and read it again.

    Unlike a checkpoint, whose size estimate is that of the plan before it and grows from round to
    round, the table has its real size, by which joins are planned.
    """
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large_page_ids(nodes: DataFrame, page_limit: int = PAGE_LIMIT) -> DataFrame | None:
    """Ids of the pages above the limit, or None without any.

    There are at most rows/limit of them; they are broadcast only if they are few.
    """
    ids = nodes.groupBy(SID).count().where(F.col("count") > page_limit).select(SID)
    if ids.isEmpty():
        return None
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def by_page_size(
    nodes: DataFrame,
    small: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
    page_limit: int = PAGE_LIMIT,
    large_ids=CHECK,
) -> DataFrame:
    """Apply ``small`` to the pages within the limit and ``large`` to the others.

    ``large_ids`` carries the outcome of an earlier ``large_page_ids`` so that a pipeline measures
    its pages once; None states that no page is above the limit.
    """
    if large_ids is CHECK:
        large_ids = large_page_ids(nodes, page_limit)
    if large_ids is None:
        return small(nodes)
    rest = small(nodes.join(large_ids, SID, "left_anti"))
    return rest.unionByName(large(nodes.join(large_ids, SID, "left_semi")))


def page_rows(nodes: DataFrame, *columns: str) -> DataFrame:
    """One row per page: ``page`` holds its nodes in order.  Only for pages within the limit."""
    columns = columns or tuple(c for c in nodes.columns if c not in (SID, IDX))
    return nodes.groupBy(SID).agg(
        F.sort_array(F.collect_list(F.struct(IDX, *columns))).alias("page")
    )


def node_rows(pages: DataFrame, **computed: Column) -> DataFrame:
    """Back to one row per node, with one further column per array aligned with ``page``."""
    staged = pages.select(SID, "page", *[v.alias(f"_{k}") for k, v in computed.items()])
    zipped = F.arrays_zip("page", *[f"_{k}" for k in computed])
    return staged.select(SID, F.inline(zipped)).select(
        SID, "page.*", *[F.col(f"_{k}").alias(k) for k in computed]
    )
