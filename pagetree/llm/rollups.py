"""Token counts by source, language and tokenizer version, maintained from signed changes.

A batch of changes is summed to one row per key and written to a folder of its own.  The folder's
success mark commits it: a batch that is already committed is left alone when it comes again, and one
that broke off is written anew.  Totals are sums over the committed batches; ``compact`` puts them
into one folder that also lists the batches it holds.
"""

from __future__ import annotations

import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "version")
_SCHEMA = "source string, lang string, version string, docs long, tokens long, batch string"


def insert(rows: DataFrame) -> DataFrame:
    """Changes for new documents: ``rows`` has source, lang, version and tokens."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def delete(rows: DataFrame) -> DataFrame:
    """Changes for documents that go: ``tokens`` is what was counted for them."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))


def revise(rows: DataFrame) -> DataFrame:
    """Changes for new counts of the same documents: from ``old_tokens`` to ``tokens``."""
    changed = F.coalesce("tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))
    return rows.select(*KEYS, F.lit(0).cast("long").alias("docs"), changed.cast("long").alias("tokens"))


class TokenRollup:
    """Totals kept below ``path``, a folder that all machines share.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path)
        self._place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> list[str]:
        marks = self._files.globStatus(self._place(f"{self._path}/{kind}=*/_SUCCESS")) or []
        return sorted(m.getPath().getParent().toString() for m in marks)

    def _base(self) -> str | None:
        return next(reversed(self._committed("base")), None)

    def _read(self, *paths: str) -> DataFrame:
        if not paths:
            return self._spark.createDataFrame([], _SCHEMA)
        return self._spark.read.schema(_SCHEMA).parquet(*paths)

    def batches(self) -> list[str]:
        """The ids of the committed batches."""
        names = {urllib.parse.unquote(p.rpartition("/batch=")[2]) for p in self._committed("batch")}
        base = self._base()
        if base:
            names |= {r["batch"] for r in self._read(base).where("batch is not null").select("batch").collect()}
        return sorted(names)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes (source, lang, version, docs, tokens); False if it was there."""
        if batch in self.batches():
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums = sums.where("docs <> 0 or tokens <> 0").withColumn("batch", F.lit(None).cast("string"))
        sums.write.mode("overwrite").parquet(f"{self._path}/batch={urllib.parse.quote(batch, safe='')}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens); keys that came to nothing are left out."""
        base = self._base()
        names = {r["batch"] for r in self._read(base).where("batch is not null").select("batch").collect()} if base else set()
        fresh = [p for p in self._committed("batch") if urllib.parse.unquote(p.rpartition("/batch=")[2]) not in names]
        rows = self._read(*([base] if base else []), *fresh).where("batch is null")
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Sum all committed batches into one folder, then remove theirs."""
        names, old, bases = self.batches(), self._committed("batch"), self._committed("base")
        listed = self._spark.createDataFrame([(n,) for n in names], "batch string")
        marks = listed.select(*[F.lit(None).cast("string").alias(k) for k in KEYS], F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("tokens"), "batch")
        count = int(bases[-1].rpartition("/base=")[2].split("-")[0]) + 1 if bases else 0
        self.totals().withColumn("batch", F.lit(None).cast("string")).unionByName(marks).write.parquet(
            f"{self._path}/base={count:012d}-{uuid.uuid4().hex}"
        )
        for path in (*old, *bases):
            self._files.delete(self._place(path), True)
