"""Near-duplicate documents by circulant MinHash.

One permutation scatters the shingles of a text over the 32-bit numbers; a second one, shifted
circularly by 0, 1, 2 ... places, gives one signature coordinate per shift: the least image of the
set.  Two permutations thus serve for any number of coordinates.  Coordinates are cut into bands;
texts that agree on a whole band are candidates, and candidates are confirmed on their full sets.

Nothing here pairs up a whole group.  Texts with equal sets are one class from the start.  The
classes of a band's bucket are first compared with one of them, twice; then only classes of
different components are left to compare, which happens in blocks of signatures.  Each candidate
pair leaves its block once, and only if its signatures agree far enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .stage import staged
from .words import mix, shingle_set, word_hashes

_MISS = 5.0  # standard deviations


@dataclass(frozen=True)
class NearDuplicates:
    """Settings.  Links have ``100 * intersection >= percent * union``.

    A pair at the threshold shares no band with probability (1 - s**rows)**bands: 6e-7 with the
    defaults, 7e-7 with 30 bands of 6 rows at 85 percent.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    block: int = 2048
    block_shingles: int = 1 << 20

    @property
    def least_agreement(self) -> int:
        """Equal coordinates that a pair at the threshold has, less five standard deviations."""
        k, s = self.bands * self.rows, self.percent / 100
        return max(0, int(k * s - _MISS * (k * s * (1 - s)) ** 0.5))


def _mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a non-empty set of 64-bit shingle hashes."""
    scattered = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(scattered), 256):
        np.minimum(out, _mix32(scattered[None, at : at + 256] + shifts).min(axis=1), out=out)
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _buckets(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    parts = sig.reshape(bands, -1).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(parts.shape[1]):
        keys = mix(keys ^ (parts[:, k] + np.uint64(0x9E3779B97F4A7C15)))
    return keys.view(np.int64)


def sketches(docs: DataFrame, how: NearDuplicates) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the set and signature (both null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for text in batch.column("text"):
                found = shingle_set(word_hashes(text.as_py()), how.shingle)
                sizes.append(len(found))
                digests.append(_digest(found) if len(found) else None)
                signatures.append(signature(found, how.bands * how.rows).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "digest", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, signature binary"
    )


def _bucket_rows(nodes: DataFrame, how: NearDuplicates) -> DataFrame:
    """(bucket, node, n_shingles) for each band of each class."""

    def run(batches):
        for batch in batches:
            keys = [_buckets(np.frombuffer(s.as_py(), np.uint32), how.bands) for s in batch.column("signature")]
            ids, sizes = (np.repeat(batch.column(c).to_numpy(), how.bands) for c in ("node", "n_shingles"))
            buckets = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(ids), pa.array(sizes)], ["bucket", "node", "n_shingles"])

    return nodes.select("node", "n_shingles", "signature").mapInArrow(run, "bucket long, node long, n_shingles long")


def _sets_of(docs: DataFrame, nodes: DataFrame, how: NearDuplicates) -> DataFrame:
    """(node, shingles) of the classes in ``nodes``, read off the texts of their smallest documents."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(word_hashes(t.as_py()), how.shingle).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(run, "node long, shingles binary")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate((x, y))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, how: NearDuplicates) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = [
                _similar(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), how.percent)
                for a, b in zip(batch.column("a"), batch.column("b"), strict=True)
            ]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    two = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(two, "v").join(one, "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets that still hold several components: the rows with component, centre and totals."""
    rows = staged(buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = rows.groupBy("bucket").agg(
        F.min("component").alias("_a"), F.max("component").alias("_b"), F.min(F.struct("component", "node")).alias("centre"),
        F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"),
    )
    return rows.join(mixed.where("_a < _b").drop("_a", "_b"), "bucket")


_ROWS_AT_ONCE = 32


def _promising(bucket: int, table: pa.Table, how: NearDuplicates) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of two blocks that may be similar: a row of the lower block and some of the higher one.

    Only pairs of different components whose sizes and signatures allow the threshold, and only in
    the bucket of the first band that they share.
    """
    side, low, high = table.column("side").to_numpy(), table.column("low")[0].as_py(), table.column("high")[0].as_py()
    ids, groups, sizes = (table.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
    sigs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(ids), -1)
    left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
    columns = np.ascontiguousarray(sigs[right].T)  # coordinate by coordinate
    for at in range(0, len(left), _ROWS_AT_ONCE):
        rows = left[at : at + _ROWS_AT_ONCE]
        agree = np.zeros((len(rows), len(right)), np.int16)
        for k, column in enumerate(columns):
            agree += column == sigs[rows, k][:, None]
        small, large = np.minimum(sizes[rows][:, None], sizes[right]), np.maximum(sizes[rows][:, None], sizes[right])
        fits = (agree >= how.least_agreement) & (groups[rows][:, None] != groups[right]) & (100 * small >= how.percent * large)
        if low == high:
            fits &= ids[rows][:, None] < ids[right]
        for i, fit in zip(rows, fits, strict=True):
            other = right[fit]
            if len(other):
                same = (sigs[other] == sigs[i]).reshape(len(other), how.bands, -1).all(axis=2).argmax(axis=1)
                other = other[_buckets(sigs[i], how.bands)[same] == bucket]
                if len(other):
                    yield i, other


def _block_links(rows: DataFrame, nodes: DataFrame, sets: DataFrame, how: NearDuplicates) -> DataFrame:
    """Confirmed links between classes of different components that share a bucket.

    A bucket is cut into blocks of bounded numbers of classes and shingles, and two blocks meet in
    one group.  A first pass over signatures tells which classes have promising partners there; only
    these bring their sets to the second pass, which compares them and returns no more links than
    connect its classes.
    """
    key = ["bucket", "low", "high"]

    def look(group, table):
        ids, found = table.column("node").to_numpy(), {}
        for i, other in _promising(group[0].as_py(), table, how):
            found.setdefault(int(ids[i]), []).extend(ids[other].tolist())
            for j in other:
                found.setdefault(int(ids[j]), [])
        n = len(found)
        return pa.table(
            {
                **{k: pa.array([g.as_py()] * n, t) for k, g, t in zip(key, group, (pa.int64(), pa.int32(), pa.int32()), strict=True)},
                "node": pa.array(list(found), pa.int64()),
                "partners": pa.array(list(found.values()), pa.list_(pa.int64())),
            }
        )

    def compare(group, table):
        names = table.column("node").to_pylist()
        sets_of = {}  # a node has several sets if rows repeat its id
        for name, found in zip(names, table.column("shingles"), strict=True):
            sets_of.setdefault(name, []).append(np.frombuffer(found.as_py(), np.uint64))
        root = {}

        def top(x):
            while x in root:
                x = root[x]
            return x

        links = []
        for node, partners in zip(names, table.column("partners"), strict=True):
            for other in partners.as_py():
                a, b = top(node), top(other)
                if a != b and any(_similar(x, y, how.percent) for x in sets_of[node] for y in sets_of[other]):
                    root[a] = b
                    links.append((min(node, other), max(node, other)))
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    blocks = F.ceil(F.greatest(F.col("members") / how.block, F.col("shingles") / how.block_shingles)).cast("int")
    sides = (
        rows.withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})
        .select(*key, "side", "node", "component")
    )
    seen = staged(
        sides.join(nodes.select("node", "n_shingles", "signature"), "node")
        .groupBy(*key)
        .applyInArrow(look, "bucket long, low int, high int, node long, partners array<long>")
    )
    return seen.join(sets, "node").groupBy(*key).applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:  # noqa: B008
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, class_id, n_links.

    ``component_id`` is the smallest doc_id reachable over links, ``class_id`` the smallest doc_id
    with an equal set, ``n_links`` the confirmed links that the search found for that class (not all
    that exist: one way of connection is enough).  ``kept`` says doc_id = component_id.

    Null and blank texts have an empty set and stand alone.  A null doc_id takes no part: its
    component is null and it is kept.  Rows that share a doc_id are one node of the link graph.
    An empty table gives an empty result.  Other columns are ignored.
    """
    per_row = staged(sketches(docs, how))
    nodes = staged(
        per_row.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    )
    rows = _bucket_rows(nodes, how)
    shared = rows.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("_last")).where("centre < _last")
    buckets = staged(rows.join(shared.select("bucket", "centre"), "bucket"))
    sets = staged(_sets_of(docs, buckets.select("node").distinct(), how))

    # every class against the smallest class it shares a bucket with
    first = buckets.where("node <> centre").groupBy("node").agg(F.min("centre").alias("u")).select("u", F.col("node").alias("v"))
    links = staged(_confirmed(first, sets, how))
    labels = components(links)

    # every class against the centres of the buckets that still hold several components
    left = _labelled(buckets.select("bucket", "node", "n_shingles"), labels)
    second = left.where(F.col("component") != F.col("centre.component")).select(
        F.least("node", "centre.node").alias("u"), F.greatest("node", "centre.node").alias("v")
    ).distinct()
    links = links.union(staged(_confirmed(second, sets, how)))
    labels = components(links)

    # the pairs of different components that are left
    left = _labelled(buckets.select("bucket", "node", "n_shingles"), labels)
    links = staged(links.union(_block_links(left, nodes, sets, how)).distinct())
    labels = components(links)

    degree = links.select("u").union(links.select("v")).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_links"))
    classes = nodes.select("digest", "node").join(labels, "node", "left").join(degree, "node", "left")
    # equal sets of several nodes with one id cannot multiply rows: digests are unique here
    classes = classes.groupBy("digest").agg(
        F.first("node").alias("class_id"), F.min("component").alias("component"), F.max("n_links").alias("n_links")
    )
    out = per_row.drop("signature").join(classes, "digest", "left")
    own = F.col("doc_id")
    component = F.when(own.isNotNull(), F.coalesce("component", "class_id", own))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        own.eqNullSafe(component).alias("kept"),
        F.when(own.isNotNull(), F.coalesce("class_id", own)).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
