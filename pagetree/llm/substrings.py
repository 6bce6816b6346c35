"""Removing repeated passages of words by level-wise doubling.

Windows of a few words are hashed at every place of every text.  Those that occur once are out; only
where two neighbouring windows of one length both repeat is the window of twice that length looked
at, and so on until the length asked for is reached or no candidate survives.  At the last length
every window learns whether its words start earlier, and the words under later ones go.

No window is a row.  Rows are cut into blocks of bounded size.  A block sends the different windows
it holds, as sorted arrays of hashes, to pieces of the hash range, each of which is told by how many
blocks and gets back those that repeat: a window that a third of all texts share is one entry per
block.  At the last length a window is known by 96 bits of hash, and the smallest doc_id that a block
has of it goes along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .backoff import _packed, _piece_of, _unpacked
from .stage import staged
from .words import gram_hashes, mix, word_hashes

_LAST = (1 << 63) - 1
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_REQUEST = "piece int, block long, keys binary, checks binary, docs binary"
_MOST_FIRST = 64  # words in a window of the first level


@dataclass(frozen=True)
class RepeatSettings:
    """``words``: the length of a window that counts as repeated.  The first level has the smallest
    length of at least ``least`` words from which doubling leads there.  ``block_bytes`` of text and
    ``piece_entries`` hashes bound what a task holds (one longer text is a block of its own)."""

    words: int = 20
    least: int = 5
    block_bytes: int = 16 << 20
    piece_entries: int = 3_000_000

    @property
    def lengths(self) -> list[int]:
        found = [self.words]
        while found[0] % 2 == 0 and found[0] // 2 >= self.least:
            found.insert(0, found[0] // 2)
        if not 0 < found[0] <= _MOST_FIRST:
            raise ValueError(f"halving {self.words} words must lead to at most {_MOST_FIRST}")
        return found


def windows(words: np.ndarray, first: int, length: int) -> np.ndarray:
    """A hash for each window of ``length`` words, made of those of its halves down to ``first``."""
    found, at = gram_hashes(words, first), first
    while at < length:
        found = mix(found[:-at] * _LEFT + found[at:] * _RIGHT) if len(found) > at else found[:0]
        at *= 2
    return found


def _checks(words: np.ndarray, first: int, length: int) -> np.ndarray:
    """32 further bits per window, from hashes of its words that are independent of the first."""
    return (windows(mix(words * _OTHER), first, length) >> np.uint64(32)).astype(np.uint32)


def _together(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """One number for key and check, for looking windows up inside a block."""
    return mix(keys ^ (checks.astype(np.uint64) * _RIGHT))


def _rows(table) -> Iterator[tuple[int, str | None]]:
    docs = table.column("_doc").to_numpy(zero_copy_only=False)
    return zip(docs, table.column("_text"), strict=True)


def dealt(docs: DataFrame, how: RepeatSettings) -> DataFrame:
    """``docs`` with its columns by place (c0, c1 ...), ``_doc`` (null ids last), ``_text`` and ``_block``."""
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    named = named.withColumns(
        {
            "_doc": F.coalesce(F.col(f"c{docs.columns.index('doc_id')}").cast("long"), F.lit(_LAST)),
            "_text": F.col(f"c{docs.columns.index('text')}").cast("string"),
        }
    ).drop(f"c{docs.columns.index('text')}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, size = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
            before = size + np.cumsum(sizes) - sizes
            size += int(sizes.sum())
            yield batch.append_column("_block", pa.array((task << 32) + before // how.block_bytes, pa.int64()))

    return named.mapInArrow(run, StructType([*named.schema.fields, StructField("_block", LongType())]))


def _sent(block: int, keys: np.ndarray, pieces: int, **further: np.ndarray) -> pa.RecordBatch:
    """What a block asks of each piece; ``keys`` are sorted, ``further`` has one value per key."""
    cut = _piece_of(keys, pieces)
    parts = [(p, slice(cut[p], cut[p + 1])) for p in range(pieces) if cut[p] < cut[p + 1]]
    columns = {k: pa.array([_packed(v[s]) for _, s in parts] if (v := further.get(k)) is not None else [None] * len(parts), pa.binary()) for k in ("checks", "docs")}
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p for p, _ in parts], pa.int32()),
            pa.array([block] * len(parts), pa.int64()),
            pa.array([_packed(np.diff(keys[s], prepend=np.uint64(0))) for _, s in parts], pa.binary()),
            columns["checks"],
            columns["docs"],
        ],
        ["piece", "block", "keys", "checks", "docs"],
    )


def _keys_of(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _first_requests(stored: DataFrame, length: int, pieces: int) -> DataFrame:
    """The windows of the first length; one that a block holds twice is sent twice."""

    def run(batches):
        for batch in batches:
            blocks = batch.column("_block").to_numpy()
            edges = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1))
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                found = [gram_hashes(word_hashes(t.as_py(), lower=False), length) for _, t in _rows(batch.slice(start, end - start))]
                yield _sent(int(blocks[start]), _at_most_twice(np.concatenate(found)), pieces)

    return stored.select("_block", "_doc", "_text").mapInArrow(run, _REQUEST)


def _repeats(requests: DataFrame) -> DataFrame:
    """(block, keys): of the windows a block sent, those that were sent twice or more."""

    def run(table):
        sent = [_keys_of(k.as_py()) for k in table.column("keys")]
        every = np.concatenate(sent)
        every.sort()
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        blocks, answers = [], []
        for block, keys in zip(table.column("block").to_pylist(), sent, strict=True):
            at = np.minimum(np.searchsorted(twice, keys), max(len(twice) - 1, 0))
            mine = np.unique(keys[twice[at] == keys]) if len(twice) else keys[:0]
            if len(mine):
                blocks.append(block)
                answers.append(_packed(np.diff(mine, prepend=np.uint64(0))))
        return pa.table({"block": pa.array(blocks, pa.int64()), "keys": pa.array(answers, pa.binary())})

    return requests.groupBy("piece").applyInArrow(run, "block long, keys binary")


def _answered(table: pa.Table) -> np.ndarray:
    """The windows a block was told of, sorted."""
    found = [_keys_of(k.as_py()) for k in table.column("keys")]
    keys = np.concatenate(found) if found else np.empty(0, np.uint64)
    keys.sort()
    return keys


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(keys):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _with_answers(stored: DataFrame, answers: DataFrame):
    return stored.groupBy("_block").cogroup(answers.withColumnRenamed("block", "_block").groupBy("_block"))


def _at_most_twice(keys: np.ndarray) -> np.ndarray:
    """The keys in order, none more often than twice: that is enough to say that it repeats."""
    keys.sort()
    third = np.zeros(len(keys), bool)
    third[2:] = (keys[2:] == keys[1:-1]) & (keys[2:] == keys[:-2])
    return keys[~third]


def _next_requests(stored: DataFrame, answers: DataFrame, length: int, last: bool, pieces: int, how: RepeatSettings) -> DataFrame:
    """The windows of twice ``length`` whose halves both repeat; at the last level once per block,
    with the smallest doc_id."""
    first = how.lengths[0]

    def run(left, right):
        known = _answered(right)
        keys, checks, docs = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for doc, text in _rows(left) if len(known) else ():
            words = word_hashes(text.as_py(), lower=False)
            repeated = _among(windows(words, first, length), known)
            both = repeated[:-length] & repeated[length:]
            if both.any():
                keys.append(windows(words, first, 2 * length)[both])
                if last:
                    checks.append(_checks(words, first, 2 * length)[both])
                    docs.append(np.full(int(both.sum()), doc, np.int64))
        keys = np.concatenate(keys)
        block = left.column("_block")[0].as_py() if left.num_rows else 0
        if not last:
            return pa.Table.from_batches([_sent(block, _at_most_twice(keys), pieces)])
        checks, docs = np.concatenate(checks), np.concatenate(docs)
        order = np.lexsort((docs, checks, keys))
        keys, checks, docs = keys[order], checks[order], docs[order]
        new = _starts(keys, checks)
        return pa.Table.from_batches([_sent(block, keys[new], pieces, checks=checks[new], docs=docs[new])])

    return _with_answers(stored.select("_block", "_doc", "_text"), answers).applyInArrow(run, _REQUEST)


def _starts(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """True where a sorted window differs from the one before it."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    return new


def _whole_texts(stored: DataFrame, length: int, pieces: int) -> DataFrame:
    """The request of the last level where it is also the first."""

    def run(batches):
        for batch in batches:
            blocks = batch.column("_block").to_numpy()
            edges = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1))
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                keys, checks, docs = [], [], []
                for doc, text in _rows(batch.slice(start, end - start)):
                    words = word_hashes(text.as_py(), lower=False)
                    keys.append(windows(words, length, length))
                    checks.append(_checks(words, length, length))
                    docs.append(np.full(len(keys[-1]), doc, np.int64))
                keys, checks, docs = (np.concatenate(x) for x in (keys, checks, docs))
                order = np.lexsort((docs, checks, keys))
                keys, checks, docs = keys[order], checks[order], docs[order]
                new = _starts(keys, checks)
                yield _sent(int(blocks[start]), keys[new], pieces, checks=checks[new], docs=docs[new])

    return stored.select("_block", "_doc", "_text").mapInArrow(run, _REQUEST)


def _earlier(requests: DataFrame) -> DataFrame:
    """(block, keys): the windows of a block that start earlier in some other one, key and check in
    one number."""

    def run(table):
        keys = [_keys_of(k.as_py()) for k in table.column("keys")]
        ends = np.cumsum([len(k) for k in keys])
        keys = np.concatenate(keys)
        checks = np.concatenate([_unpacked(c.as_py(), np.uint32) for c in table.column("checks")])
        docs = np.concatenate([_unpacked(d.as_py(), np.int64) for d in table.column("docs")])
        order = np.lexsort((docs, checks, keys))
        new = _starts(keys[order], checks[order])
        least = docs[order][new][np.cumsum(new) - 1]
        later = np.empty(len(keys), bool)
        later[order] = docs[order] > least
        blocks, answers = [], []
        for block, end, start in zip(table.column("block").to_pylist(), ends, np.concatenate(([0], ends[:-1])), strict=True):
            mine = later[start:end]
            if mine.any():
                blocks.append(block)
                told = np.sort(_together(keys[start:end][mine], checks[start:end][mine]))
                answers.append(_packed(np.diff(told, prepend=np.uint64(0))))
        return pa.table({"block": pa.array(blocks, pa.int64()), "keys": pa.array(answers, pa.binary())})

    return requests.groupBy("piece").applyInArrow(run, "block long, keys binary")


def _repeated(places: np.ndarray, docs: np.ndarray, rows: np.ndarray, known: np.ndarray) -> np.ndarray:
    """True for each window that starts earlier: in another block, under a smaller doc_id of this
    one, or further up in its row.  Windows come in the order of doc_id, row and place."""
    found = _among(places, known)
    order = np.argsort(places, kind="stable")
    places, docs, rows = places[order], docs[order], rows[order]
    new = np.ones(len(places), bool)
    new[1:] = places[1:] != places[:-1]
    again = np.zeros(len(places), bool)
    again[1:] = ~new[1:] & (rows[1:] == rows[:-1])
    if len(places):
        again |= docs > docs[new][np.cumsum(new) - 1]
    found[order] |= again
    return found


def _spans(covered: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    return [{"start": int(a), "words": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _cut(stored: DataFrame, answers: DataFrame, with_text: bool, how: RepeatSettings) -> DataFrame:
    first, length = how.lengths[0], how.words
    passed = [f for f in stored.schema.fields if f.name not in ("_doc", "_block", "_text")]
    added = StructType.fromDDL("n_words long, n_removed long, removed array<struct<start:int,words:int>>, kept_sha256 string, text string")
    kinds = {
        "n_words": pa.int64(), "n_removed": pa.int64(), "removed": pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())])),
        "kept_sha256": pa.string(), "text": pa.string(),
    }

    def run(left, right):
        left = left.take(pc.sort_indices(left.column("_doc")))
        known = _answered(right)
        hashed = [word_hashes(t.as_py(), lower=False) for _, t in _rows(left)]
        places = [_together(windows(w, first, length), _checks(w, first, length)) for w in hashed]
        counts = np.array([len(p) for p in places], np.int64)
        rows = np.repeat(np.arange(len(places)), counts)
        every = np.concatenate(places) if places else np.empty(0, np.uint64)
        hit = _repeated(every, left.column("_doc").to_numpy()[rows], rows, known)
        out, at = {k: [] for k in kinds}, 0
        for (_, text), words, count in zip(_rows(left), hashed, counts, strict=True):
            text, starts = text.as_py(), np.flatnonzero(hit[at : at + count])
            at += count
            change = np.zeros(len(words) + 1, np.int64)
            change[starts] += 1
            change[starts + length] -= 1
            covered = np.cumsum(change[:-1]) > 0
            kept = (text or "").encode("utf-8", "surrogatepass").split()
            if len(starts):
                kept = [w for w, gone in zip(kept, covered, strict=True) if not gone]
            joined = b" ".join(kept)
            out["n_words"].append(len(words))
            out["n_removed"].append(int(covered.sum()))
            out["removed"].append(_spans(covered))
            out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
            out["text"].append((joined.decode("utf-8", "surrogatepass") if len(starts) else text) if with_text else None)
        found = left.select([f.name for f in passed])
        for k, kind in kinds.items():
            found = found.append_column(k, pa.array(out[k], kind))
        return found

    return _with_answers(stored, answers).applyInArrow(run, StructType([*passed, *added.fields]))


def remove_repeats(docs: DataFrame, how: RepeatSettings = RepeatSettings(), with_text: bool = True) -> DataFrame:  # noqa: B008
    """``docs`` without the words under windows of ``how.words`` words that start earlier as well,
    under a smaller doc_id or further up in the same row; plus n_words, n_removed, ``removed`` (start
    and number of words of each stretch) and kept_sha256 (of the kept words joined by one space).

    ``text`` stays as it is where nothing goes; else it is the kept words joined by one space, which
    can be the empty string.  Windows are judged on the input.  Null texts stay null and have no
    words; texts with fewer words than a window keep them all.  A null doc_id comes after all
    others; rows that share a doc_id (or have none) are not earlier than one another, so repeated
    rows all keep their words.  An empty table gives an empty result.  Columns that are named like
    those added are replaced; all others are kept, whatever their names.  With ``with_text=False``
    ``text`` is left out.
    """
    stored = staged(dealt(docs, how))
    size = stored.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    pieces = max(1, -(-size // (6 * how.piece_entries)))
    lengths = how.lengths
    if len(lengths) == 1:
        requests = _whole_texts(stored, how.words, pieces)
    else:
        requests = _first_requests(stored, lengths[0], pieces)
        for length in lengths[1:]:
            answers = staged(_repeats(requests))
            requests = _next_requests(stored, answers, length // 2, length == how.words, pieces, how)
    answers = staged(_earlier(requests))
    found = _cut(stored, answers, with_text, how)
    added = ["n_words", "n_removed", "removed", "kept_sha256"]
    columns = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c not in added and (with_text or c != "text")]
    picked = [F.col("text" if c == "text" else at).alias(c) for at, c in columns]
    return found.select(*picked, *added)


def repeat_profile(docs: DataFrame, how: RepeatSettings = RepeatSettings()) -> DataFrame:  # noqa: B008
    """(length, n_windows): for each length from the first one, doubled until no candidate
    survives, how many different windows occur twice or more.

    Nulls and short texts have no windows; repeated rows count; an empty table, or one without
    repeats, gives an empty result.
    """
    stored = staged(dealt(docs, how))
    size = stored.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    pieces = max(1, -(-size // (6 * how.piece_entries)))
    length = how.lengths[0]
    requests, found = _first_requests(stored, length, pieces), []

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([h for k in batch.column("keys") for h in _keys_of(k.as_py()).view(np.int64)], pa.int64())], ["key"])

    while True:
        answers = staged(_repeats(requests))
        n = answers.select("keys").mapInArrow(count, "key long").distinct().count()
        if not n:
            return docs.sparkSession.createDataFrame(found, "length int, n_windows long")
        found.append((length, n))
        requests = _next_requests(stored, answers, length, False, pieces, how)
        length *= 2
