"""Scoring texts with a weighted backoff automaton over smoothed n-grams.

A state is the last word read.  An n-gram seen in training is an arc out of its context's state, with
the logarithm of its smoothed probability; a failure arc leads to the root and costs the logarithm
of the mass that the context leaves over, and the root has an arc for every word.  With pseudo-count
m, and p(w) = (c(w) + a) / (N + a (V + 1)) at the root,

    p(w | v) = (c(v w) + m p(w)) / (c(v) + m)

so the arc of a seen pair has log10 p(w | v), and the failure arc of v has log10 m / (c(v) + m).  A
text is read once from left to right, from the start state to its end token.

The model grows with the corpus and is never in one place.  Texts are cut into blocks; a block sends
the n-grams it holds, hashed, to the pieces of the model and gets back their training counts, as
packed arrays: a frequent word is one entry per block, not one row per place.  A block then has the
part of the automaton that its texts can reach.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import staged
from .words import mix, word_hashes

_END = np.uint64(0x5BD1E995A7C15F39)
_START = np.uint64(0x27D4EB2F165667C5)


@dataclass(frozen=True)
class BackoffSettings:
    """``modulus``: documents whose crc32(id) leaves remainder 0 are held out of the counts.
    ``base``: what is added to word counts; ``pseudo``: the weight of the root under a context.
    ``block_bytes`` and ``piece_entries`` bound what a task holds (one longer text is a block of its
    own)."""

    modulus: int = 10
    base: float = 0.1
    pseudo: float = 2.0
    block_bytes: int = 12 << 20
    piece_entries: int = 3_000_000


def _crc_held_out(doc: int | None, modulus: int) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % modulus == 0


def _pairs(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it, or with the start of its text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = _START
    return mix(mix(before) + tokens * np.uint64(0x9E3779B97F4A7C15))


def _packed(values: np.ndarray) -> bytes:
    """Sorted or small numbers, byte planes apart, as they share their upper bytes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _keys(words: np.ndarray, index: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a block, sorted, and the place of each token's pair among them."""
    return np.unique(_pairs(words[index], starts), return_inverse=True)


def blocks(docs: DataFrame, how: BackoffSettings) -> DataFrame:
    """One row per block: its number, documents, different words and word numbers in order."""

    def pack(number, ids, tokens):
        words, index = np.unique(np.concatenate(tokens), return_inverse=True)
        lengths = np.array([len(t) for t in tokens], np.int64)
        return number, ids, lengths.tobytes(), _packed(np.diff(words, prepend=np.uint64(0))), _packed(index.astype(np.int32)), int(lengths.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        ids, tokens, size = [], [], 0
        names = ["block", "ids", "lengths", "words", "index", "n_tokens"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]

        def row():
            values = pack((task << 32) + count, ids, tokens)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = word_hashes(text.as_py())
                ids.append(doc)
                tokens.append(np.append(found, _END))
                size += 8 * len(found) + 8
                if size >= how.block_bytes:
                    yield row()
                    ids, tokens, size, count = [], [], 0, count + 1
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, ids array<long>, lengths binary, words binary, index binary, n_tokens long")


def _opened(row: dict) -> tuple:
    """(ids, starts, words, index) of a block's row."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)[:-1]))
    return row["ids"], starts, np.cumsum(_unpacked(row["words"], np.uint64), dtype=np.uint64), _unpacked(row["index"], np.int32)


def _piece_of(keys: np.ndarray, pieces: int) -> np.ndarray:
    """Where each piece's part of the sorted keys begins, and the end."""
    edges = np.array([(p << 64) // pieces for p in range(1, pieces)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _requests(stored: DataFrame, pieces: int, how: BackoffSettings) -> DataFrame:
    """(piece, block, kind, keys, counts): what each block holds of each piece of the model."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, starts, words, index = _opened(row)
                lengths = np.frombuffer(row["lengths"], np.int64)
                trained = np.repeat(np.array([not _crc_held_out(d, how.modulus) for d in ids]), lengths)
                pairs, place = _keys(words, index, starts)
                for kind, keys, at in ((1, words, index), (2, pairs, place)):
                    counts = np.bincount(at[trained], minlength=len(keys)).astype(np.uint32)
                    cut = _piece_of(keys, pieces)
                    parts = [(p, slice(cut[p], cut[p + 1])) for p in range(pieces) if cut[p] < cut[p + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p for p, _ in parts], pa.int32()),
                            pa.array([row["block"]] * len(parts), pa.int64()),
                            pa.array([kind] * len(parts), pa.int32()),
                            pa.array([_packed(np.diff(keys[s], prepend=np.uint64(0))) for _, s in parts], pa.binary()),
                            pa.array([_packed(counts[s]) for _, s in parts], pa.binary()),
                        ],
                        ["piece", "block", "kind", "keys", "counts"],
                    )

    return stored.mapInArrow(run, "piece int, block long, kind int, keys binary, counts binary")


def _answers(requests: DataFrame) -> DataFrame:
    """(block, kind, piece, counts, distinct, total): training counts in the order of the keys.

    ``distinct`` and ``total`` are those of the piece's words, on one of its rows only.
    """

    def run(group, table):
        rows = table.to_pylist()
        keys = [np.cumsum(_unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        counts = np.concatenate([_unpacked(r["counts"], np.uint32) for r in rows])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, counts).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        words = group[1].as_py() == 1
        totals = [(int((sums > 0).sum()), int(sums.sum())) if words and i == 0 else (0, 0) for i in range(len(rows))]
        return pa.table(
            {
                "block": pa.array([r["block"] for r in rows], pa.int64()),
                "kind": pa.array([r["kind"] for r in rows], pa.int32()),
                "piece": pa.array([r["piece"] for r in rows], pa.int32()),
                "counts": pa.array([_packed(sums[place[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)], pa.binary()),
                "distinct": pa.array([d for d, _ in totals], pa.int64()),
                "total": pa.array([t for _, t in totals], pa.int64()),
            }
        )

    return requests.groupBy("piece", "kind").applyInArrow(
        run, "block long, kind int, piece int, counts binary, distinct long, total long"
    )


class Automaton:
    """The part of the automaton that a block's texts can reach.

    ``root[w]`` is the weight of word w's arc at the root, ``fail[w]`` that of the failure arc out of
    the state w, ``arc[k]`` that of pair k's arc, minus infinity without one.
    """

    def __init__(self, word_counts, pair_counts, pair_first, pair_second, documents: int, total: int, distinct: int, how: BackoffSettings):
        root = (word_counts + how.base) / (total + how.base * (distinct + 1))
        context = np.append(word_counts, documents)  # the start state comes last
        self.root = np.log10(root)
        self.fail = np.log10(how.pseudo / (context + how.pseudo))
        with np.errstate(divide="ignore"):
            seen = np.where(pair_counts > 0, (pair_counts + how.pseudo * root[pair_second]) / (context[pair_first] + how.pseudo), 0)
            self.arc = np.log10(seen)

    def read(self, states: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The weight of each step: the arc where there is one, else failure arc and root arc."""
        arc = self.arc[pairs]
        return np.where(np.isfinite(arc), arc, self.fail[states] + self.root[words])


def score_texts(docs: DataFrame, how: BackoffSettings = BackoffSettings()) -> DataFrame:  # noqa: B008
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (words alone) and score (the automaton's), both log10 of a probability.

    A null or blank text is the end token alone.  A null doc_id counts as training.  Repeated rows
    count and are scored each; an empty table gives an empty result; other columns are ignored.
    """
    stored = staged(blocks(docs, how))
    tokens = stored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    pieces = max(1, -(-tokens // how.piece_entries))
    answers = staged(_answers(_requests(stored, pieces, how)))
    distinct, total = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % how.modulus == 0, F.lit(False))
    documents = docs.where(~held).count()

    def run(left, right):
        out = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for row in left.to_pylist():
            ids, starts, words, index = _opened(row)
            pairs, place = _keys(words, index, starts)
            found = sorted((r["kind"], r["piece"], r["counts"]) for r in right.to_pylist())
            counts = {k: np.concatenate([_unpacked(c, np.int64) for kind, _, c in found if kind == k]) for k in (1, 2)}
            states = np.empty(len(index), np.int64)
            states[1:] = index[:-1]
            states[starts] = len(words)
            first, second = np.empty(len(pairs), np.int64), np.empty(len(pairs), np.int64)
            first[place], second[place] = states, index
            machine = Automaton(counts[1], counts[2], first, second, documents, total, distinct, how)
            known = (counts[1] > 0)[index].astype(np.int64)
            lengths = np.frombuffer(row["lengths"], np.int64)
            out["doc_id"] += ids
            out["held_out"] += [_crc_held_out(d, how.modulus) for d in ids]
            out["n_tokens"] += lengths.tolist()
            out["n_known"] += np.add.reduceat(known, starts).tolist()
            out["base_score"] += np.add.reduceat(machine.root[index], starts).tolist()
            out["score"] += np.add.reduceat(machine.read(states, index, place), starts).tolist()
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    scored = stored.groupBy("block").cogroup(answers.select("block", "kind", "piece", "counts").groupBy("block")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
