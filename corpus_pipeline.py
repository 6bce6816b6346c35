"""From raw documents to packed pieces: the stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; the last one returns
pieces.  ``n_chars`` follows the text where a stage shortens it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetree.llm import ordinal
from pagetree.llm.minhash import near_duplicates
from pagetree.llm.mixing import mix_sources, sized
from pagetree.llm.packing import pack
from pagetree.llm.stage import staged
from pagetree.llm.winnow import dedup_lines
from pagetree.llm.words import SPACES


_NAMED = ("doc_id", "text", "source")


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with names for its further columns that no operator uses."""
    return docs.toDF(*[c if c in _NAMED else f"further_{i}" for i, c in enumerate(docs.columns)])


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names."""
    return found.select(*_plain(docs).columns).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are more likely toxic than not."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ordinal.fit(docs, labels.select("doc_id", F.col("toxic").alias("grade")))
    return _restored(ordinal.severity(_plain(docs), model).where("not toxic"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the later places of runs of 50 words or more in whole lines.

    A document all of whose words went that way is a copy of earlier ones and goes; one that had no
    words from the start stays.
    """
    cut = dedup_lines(_plain(docs))
    left = cut.where((F.size("removed") == 0) | (F.trim("text", F.lit(SPACES)) != ""))
    found = _restored(left, docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one row of each doc_id.

    Rows without a doc_id stay as they are.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = _plain(docs)
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    chosen = rows.join(kept, "doc_id", "left_semi").withColumn("place", F.row_number().over(first)).where("place = 1")
    return _restored(chosen.drop("place").unionByName(rows.where("doc_id is null")), docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix_sources(sized(_plain(docs))).where("copies > 0")
    return _restored(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def pack_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their ids."""
    return pack(docs, longest=4096, special=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("mixing", mix_to_weights),
    ("packing", pack_pieces),
]

#: Toxicity, line runs and connected components are not expressible in SQL; tests/llm compares each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = staged(docs)
    return docs
