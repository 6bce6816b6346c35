"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two, longest first: as many of the
full length as fit, then one for each binary digit of what is left.  A piece is a sequence of its
own, so no sequence crosses documents and none is padded.  Sequences of one length form a bucket,
numbered without gaps, from which a trainer takes batches of equal shape.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged
from .tokens import vocabulary, word_ids

END_ID = 2


def piece_lengths(n: int, longest: int) -> list[int]:
    """``n`` as full lengths and binary digits, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", longest: int = 4096, with_ids: bool = True, special: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids, _task, _at) per piece.

    ``_at`` counts the pieces of one length in a task.  ``ids`` is null without ``with_ids``.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(vocabulary(tokenizer), special)
        end = END_ID.to_bytes(4, "little")
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "_at")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = table.of(text.as_py()) + end
                total, start = len(ids) // 4, 0
                for length in piece_lengths(total, longest):
                    part = ids[4 * start : 4 * (start + length)]
                    at = seen[length] = seen.get(length, -1) + 1
                    for k, v in (("doc_id", doc), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(part)),
                                 ("doc_tokens", total), ("ids", part if with_ids else None), ("_at", at)):
                        rows[k].append(v)
                    start += length
            arrays = [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([task] * len(arrays[0]), pa.int32())], [*rows, "_task"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, _at long, _task int"
    )


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", longest: int = 4096, with_ids: bool = True, special: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, place, ids.

    ``sequence_id`` counts all sequences from 0, shortest bucket first; ``place`` counts within the
    bucket of one length.  ``offset`` is 0, as a piece is alone in its sequence.  ``ids`` holds the
    piece's ids as little-endian 32-bit numbers.  A null or blank text is the end id alone; repeated
    rows and null ids are packed like any other; an empty table gives an empty result.  ``special``
    takes quoted markers of the vocabulary as one id, as an unchanged tokenizer does.

    Only counts per task and length are brought together, never pieces.
    """
    cut = staged(pieces(docs, tokenizer, longest, with_ids, special))
    counts = staged(cut.groupBy("length", "_task").agg(F.count("*").alias("_n")))
    offsets = counts.select(
        "length", "_task",
        F.coalesce(F.sum("_n").over(Window.orderBy("length", "_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"),
        F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_place"),
    )
    return cut.join(offsets, ["length", "_task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_first") + F.col("_at")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        (F.col("_place") + F.col("_at")).alias("place"),
        "ids",
    )
