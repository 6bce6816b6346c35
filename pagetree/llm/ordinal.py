"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A document's features are its different words.  One weight per word is shared by all thresholds:
P(grade > k) = 1 / (1 + exp(threshold_k - sum of weights)).  The weights are sparse, as an L1
penalty takes most words out.  The severity is the expected grade, the sum of these probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import word_hashes

_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_FILTER_BITS = 20


@dataclass(frozen=True)
class OrdinalSettings:
    """Bounds of the sample that the weights are fitted on, and of the model.

    At most ``rows_per_side`` rows with grade 0 and as many with a higher grade are sampled by the
    hash of their id, of those with at most ``most_words`` different words.  A word must occur in
    ``least_documents`` of them, its share must differ between the sides by ``least_z`` standard
    errors, and the ``most_features`` most frequent ones are kept.  Scoring covers all rows and
    whole texts.
    """

    rows_per_side: int = 3000
    most_words: int = 20_000
    least_documents: int = 4
    least_z: float = 3.5
    most_features: int = 1 << 16
    grades: int = 3
    l1: float = 3e-4
    rounds: int = 120
    reject_at: float = 0.5


@dataclass(frozen=True)
class OrdinalModel:
    """Sorted word hashes, their weights, and increasing thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, total: np.ndarray) -> np.ndarray:
        """P(grade > k) for each sum of weights."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - total[:, None], -500, 500)))


def features(text: str | None) -> np.ndarray:
    """The hashes of a text's different words, without ASCII punctuation and case."""
    if not text:
        return np.empty(0, np.uint64)
    return np.unique(word_hashes(text.encode("utf-8", "surrogatepass").translate(_PUNCTUATION)))


def _sample(docs: DataFrame, graded: DataFrame, how: OrdinalSettings) -> list:
    """(grade, features) of the sampled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            fits = pa.array([len(f) <= how.most_words for f in found], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([f.tobytes() for f in found], pa.binary())], ["grade", "features"])
            yield out.filter(fits)

    ids = graded.where("grade is not null and doc_id is not null").select("doc_id", F.col("grade").cast("int").alias("grade"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = ids.where("grade = 0").orderBy(*order).limit(how.rows_per_side).union(ids.where("grade > 0").orderBy(*order).limit(how.rows_per_side))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("grade", "text").mapInArrow(run, "grade int, features binary").collect()


def fit(docs: DataFrame, graded: DataFrame, how: OrdinalSettings = OrdinalSettings()) -> OrdinalModel | None:  # noqa: B008
    """Fit on a bounded sample of ``graded`` (doc_id, grade from 0); None unless two grades occur.

    With grades 0 and 1 only, rows of grade 1 are graded further, up to ``how.grades``, by how many
    words they hold that mark the higher side (at least eight times as frequent there, in 1 percent
    of it), so that severity has something to order.
    """
    counts = {r["up"]: r["n"] for r in graded.where("grade is not null").groupBy((F.col("grade") > 0).alias("up")).agg(F.count("*").alias("n")).collect()}
    rows = _sample(docs, graded, how)
    grade = np.array([r["grade"] for r in rows], np.int64)
    if not len(rows) or (grade > 0).all() or not (grade > 0).any():
        return None
    n = len(rows)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r["features"]) // 8 for r in rows])
    every = np.frombuffer(b"".join(r["features"] for r in rows), np.uint64)
    del rows
    words, column, df = np.unique(every, return_inverse=True, return_counts=True)
    up = (grade > 0).sum()
    high = np.bincount(column, (grade > 0)[row], len(words)) / up
    low = (df - high * up) / (len(grade) - up)
    share = df / len(grade)
    z = np.abs(high - low) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / up + 1 / (len(grade) - up)))
    keep = (df >= how.least_documents) & (z >= how.least_z)
    if keep.sum() > how.most_features:
        keep &= df >= np.sort(df)[-how.most_features]
        keep[np.flatnonzero(keep)[how.most_features :]] = False
    place = np.cumsum(keep) - 1
    row, column = row[keep[column]], place[column[keep[column]]]
    words, high, low = words[keep], high[keep], low[keep]
    if grade.max() == 1 and how.grades > 1:
        marks = (high >= 0.01) & (high >= 8 * (low + 0.5 / (len(grade) - up)))
        hits = np.bincount(row, marks[column], n).astype(np.int64)
        grade = np.where(grade > 0, np.clip(hits, 1, how.grades), 0)
    k = int(grade.max())
    above = (grade[:, None] > np.arange(k)[None, :]).astype(float)
    weights, squares = np.zeros(len(words)), np.full(len(words), 1e-8)
    thresholds, t_squares = -np.log((above.mean(0) + 1e-3) / (1 - above.mean(0) + 1e-3)), np.full(k, 1e-8)
    for _ in range(how.rounds):
        total = np.bincount(row, weights[column], n)
        p = 1 / (1 + np.exp(np.clip(thresholds[None, :] - total[:, None], -500, 500)))
        error = (p - above) / n
        gradient = np.bincount(column, error.sum(1)[row], len(words))
        squares += gradient**2
        rate = 0.5 / np.sqrt(squares)
        weights -= rate * gradient
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * how.l1, 0)
        t_gradient = -error.sum(0)
        t_squares += t_gradient**2
        thresholds = np.maximum.accumulate(thresholds - 0.3 * t_gradient / np.sqrt(t_squares))
    # the two sides were sampled at different rates
    sampled = (grade > 0).mean() / (grade == 0).mean()
    thresholds += np.log(sampled) - np.log(counts.get(True, 1) / counts.get(False, 1))
    used = weights != 0
    return OrdinalModel(words[used], weights[used], thresholds)


def severity(docs: DataFrame, model: OrdinalModel | None, how: OrdinalSettings = OrdinalSettings()) -> DataFrame:  # noqa: B008
    """``docs`` with severity (expected grade), p_toxic = P(grade > 0), grade and toxic.

    ``grade`` counts the thresholds passed with probability ``reject_at``; ``toxic`` says that it is
    not 0.  Without a model all are 0 and false.  Null and empty texts have no features.  Other
    columns pass through; columns of these names are replaced.
    """
    extra = ["severity", "p_toxic", "grade", "toxic"]
    kept = [c for c in docs.columns if c not in extra]
    place = kept.index("text")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    if model is None or not len(model.words):
        zero = [F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("grade"), F.lit(False).alias("toxic")]
        return rows.select("*", *zero)
    rows = rows.toDF(*[f"_{i}" for i in range(len(kept))])
    known = np.zeros(1 << _FILTER_BITS, bool)
    known[(model.words >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def run(batches):
        for batch in batches:
            totals = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(place)):
                found = features(text.as_py())
                found = found[known[(found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]]
                if len(found):
                    at = np.minimum(np.searchsorted(model.words, found), len(model.words) - 1)
                    totals[i] = model.weights[at[model.words[at] == found]].sum()
            p = model.probabilities(totals)
            grade = (p >= how.reject_at).sum(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(grade), pa.array(grade > 0)], [*batch.schema.names, *extra]
            )

    out = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("severity double, p_toxic double, grade int, toxic boolean").fields])
    return rows.mapInArrow(run, out).toDF(*kept, *extra)
