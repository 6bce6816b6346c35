"""Quality by compression: which of two dictionaries shortens a text more.

One zstandard dictionary is built from labelled good texts, one from bad ones.  A text is compressed
in blocks with either; the difference of the sizes over their sum says which class it is like, and a
logistic curve fitted on other labelled rows makes it a probability.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CompressionSettings:
    """Bounds of the labelled samples, and how texts are compressed.

    ``rows_per_class`` texts of each class, of at most ``most_chars`` characters, make the
    dictionaries; ``calibration_rows`` other rows set the curve.  A hash of the id gives half of the
    labelled rows to either purpose and says which come first.  Scoring covers all rows, and whole texts in blocks of ``block`` bytes, as otherwise a
    long text would be compressed by itself rather than by the dictionary.
    """

    rows_per_class: int = 800
    most_chars: int = 32_768
    calibration_rows: int = 4000
    dictionary: int = 112_640
    level: int = 3
    block: int = 8192


@dataclass(frozen=True)
class CompressionModel:
    """The dictionaries and the curve: score = 1 / (1 + exp(-(slope * difference + intercept)))."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=data, level=level, write_content_size=False, write_dict_id=False, write_checksum=False)


def difference(text: str | None, good: bytes, bad: bytes, how: CompressionSettings) -> float:
    """From -1 to 1, higher for texts that the good dictionary shortens more; 0 without text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    sizes = []
    for dictionary in (good, bad):
        press = _compressor(dictionary, how.level)
        sizes.append(sum(len(press.compress(data[at : at + how.block])) for at in range(0, len(data), how.block)))
    return (sizes[1] - sizes[0]) / (sizes[0] + sizes[1]) if data else 0.0


def _differences(docs: DataFrame, good: bytes, bad: bytes, how: CompressionSettings, *carry: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [difference(t.as_py(), good, bad, how) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(found, pa.float64())], [*carry, "difference"])

    rows = docs.select(*carry, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, rows.drop("text").schema.add("difference", "double"))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a slight pull of the scaled slope to zero."""
    scale = float(x.std()) or 1.0
    data = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ beta, -30, 30)))
        gradient = data.T @ (p - y) + np.array([1e-2, 0]) * beta
        hessian = (data * (p * (1 - p))[:, None]).T @ data + np.diag([1e-2, 1e-6])
        beta -= np.linalg.solve(hessian, gradient)
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, how: CompressionSettings = CompressionSettings()) -> CompressionModel | None:  # noqa: B008
    """Fit on ``labels`` (doc_id, quality 0 or 1); None unless both classes occur.

    Labels of one id are taken together; the higher one counts.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.withColumn("_hash", F.xxhash64("doc_id"))
    order = ["_hash", "doc_id"]
    ours, others = (known.where((F.col("_hash").bitwiseAND(1)) == side) for side in (0, 1))
    short = docs.where(F.length(F.coalesce("text", F.lit(""))).between(1, how.most_chars)).select("doc_id", F.col("text").cast("string").alias("text"))
    samples = {}
    for quality in (1, 0):
        ids = ours.where(F.col("quality") == quality).orderBy(*order).limit(how.rows_per_class).select("doc_id")
        rows = short.join(F.broadcast(ids), "doc_id").select("doc_id", "text").collect()
        samples[quality] = [t for _, t in sorted((r["doc_id"], r["text"].encode("utf-8", "surrogatepass")) for r in rows)]
    if not all(samples.values()):
        return None
    good, bad = (_dictionary(samples[q], how) for q in (1, 0))
    ids = others.orderBy(*order).limit(how.calibration_rows).select("doc_id", "quality")
    rows = _differences(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), good, bad, how, "quality").collect()
    if {r["quality"] for r in rows} != {0, 1}:
        return None
    x, y = (np.array([float(r[c]) for r in rows]) for c in ("difference", "quality"))
    slope, intercept = _logistic(x, y)
    return CompressionModel(good, bad, slope, intercept)


def _dictionary(texts: list[bytes], how: CompressionSettings) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(how.dictionary, [t[at : at + how.block] for t in texts for at in range(0, len(t), how.block)]).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-how.dictionary :].rjust(8, b"\n")


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves this remainder; false for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def score_quality(docs: DataFrame, model: CompressionModel | None, how: CompressionSettings = CompressionSettings()) -> DataFrame:  # noqa: B008
    """(doc_id, score, predicted) per row; without a model every score is 0.5.

    The score sees the text alone.  Null and empty texts get that of no difference.  Repeated rows
    and null ids are scored like any other; other columns are ignored.
    """
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    found = _differences(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model.good, model.bad, how, "doc_id")
    score = 1 / (1 + F.exp(-(F.col("difference") * model.slope + model.intercept)))
    return found.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
