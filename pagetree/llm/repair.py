"""Repairing the structure of conversations with the cheapest edits.

A conversation's role initials should read ``(s?(ua)+)?``.  Four states say how far that is read:
nothing yet, after s, after u, after a.  Rows are kept, given another role or deleted, and empty rows
inserted, at a cost; a backward recursion over the rows gives for each state the least cost of the
rest, and the edits whose cost is tight form the cheapest repairs.  The first of them in ASCII order
is found by walking forward and taking the first tight edit at every place.

The recursion is checkpointed.  A conversation is cut into blocks of about the square root of its
rows, and only the state-cost vector behind each block is stored; a block is recomputed from it, in
the same way inside itself, while walking forward.  Blocks are rows of their own: one pass gives
each block's cost from every state to every state, a scan from the last block to the first gives the
vectors and, for each state that a block can be entered in, its edits and the state it is left in,
and a scan from the first block to the last picks the right ones.  So a conversation of any length
is spread over the cluster, and no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import rank_within
from .stage import staged
from .words import SPACES

INITIALS = " sua"
#: The state after a turn that fits (user or assistant), from each state, and that turn's role.
FITS = (2, 2, 3, 2)
ROLES = ("user", "user", "assistant", "user")
#: By initial (none, s, u, a) and state: the state after a kept row, -1 where it does not fit.
KEEPS = ((-1, -1, -1, -1), (1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1))
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_FAR = 1 << 60


@dataclass(frozen=True)
class RepairCosts:
    """``least_block``: rows of a block, unless the conversation's square root is larger."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3
    least_block: int = 1024


def _with_inserts(base: list[int], insert: int) -> list[int]:
    """Least costs where turns may be inserted first; two insertions in a row cover every case."""
    once = [min(base[s], insert + base[FITS[s]]) for s in range(4)]
    return [min(base[s], insert + once[FITS[s]]) for s in range(4)]


def before(code: int, after: list[int], how: RepairCosts) -> list[int]:
    """State-cost vector before a row from the one behind it.  ``code``: initial + 4 * fault."""
    initial, fault = code & 3, code >> 2
    base = [a + how.delete for a in after]
    if fault not in (BLANK, DUPLICATE):
        more = how.truncated if fault == TRUNCATED else 0
        for s in range(4):
            base[s] = min(base[s], more + how.rerole + after[FITS[s]])
            if KEEPS[initial][s] >= 0:
                base[s] = min(base[s], more + after[KEEPS[initial][s]])
    return _with_inserts(base, how.insert)


def at_end(how: RepairCosts) -> list[int]:
    """State-cost vector behind the last row: the conversation may end with nothing or after a."""
    return _with_inserts([0, _FAR, _FAR, 0], how.insert)


def _step(code: int, state: int, here: list[int], after: list[int], how: RepairCosts) -> tuple[str, int]:
    """The first tight edits in ASCII order (D, I, K, R) that deal with a row, and the state then."""
    initial, fault = code & 3, code >> 2
    more = how.truncated if fault == TRUNCATED else 0
    edits = ""
    while True:
        cost = here[state]
        if cost == after[state] + how.delete:
            return edits + "D", state
        if cost == how.insert + here[FITS[state]]:
            edits, state = edits + "I", FITS[state]
            continue
        kept = KEEPS[initial][state]
        if fault not in (BLANK, DUPLICATE) and kept >= 0 and cost == more + after[kept]:
            return edits + "K", kept
        return edits + "R", FITS[state]


def walk(codes: bytes, end: list[int], how: RepairCosts) -> tuple[list[int], list[int], list[str]]:
    """(vector before the rows, state after them, their edits), the latter two per state before.

    Vectors are kept at every so many rows, the square root of their number, and recomputed between
    these while walking forward.
    """
    n = len(codes)
    step = max(1, isqrt(n))
    marks, vector = {n: end}, end
    for i in range(n - 1, -1, -1):
        vector = before(codes[i], vector, how)
        if i % step == 0:
            marks[i] = vector
    states, edits = [0, 1, 2, 3], [[], [], [], []]
    for start in range(0, n, step):
        stop = min(start + step, n)
        vectors = [marks[stop]]
        for i in range(stop - 1, start - 1, -1):
            vectors.append(before(codes[i], vectors[-1], how))
        vectors.reverse()
        for i in range(start, stop):
            for s in range(4):
                done, states[s] = _step(codes[i], states[s], vectors[i - start], vectors[i - start + 1], how)
                edits[s].append(done)
    return vector, states, ["".join(e) for e in edits]


def _ending(state: int, how: RepairCosts) -> str:
    """Insertions behind the last row."""
    end, out = at_end(how), ""
    while end[state]:
        out, state = out + "I", FITS[state]
    return out


# ---------------------------------------------------------------- rows and their faults


def _filled(column: str, kind: str = "string") -> Column:
    return F.coalesce(F.col(column).cast(kind), F.lit(" "))


def faults(rows: DataFrame, how: RepairCosts = RepairCosts()) -> DataFrame:  # noqa: B008
    """(_key, _block, _rank, conv_id, turn, role, text, _code) for each row of (conv_id, turn, role,
    text): its place in the conversation, its block, and initial and first fault in one number."""
    known = rows.select(
        _filled("conv_id").alias("_key"), F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
        _filled("role").alias("role"), _filled("text").alias("text"),
    )
    placed = staged(rank_within(known, ["_key"], ["turn", "role", "text"], "_rank", spread=True))
    said = F.sha2(F.concat_ws("\n", "role", "text"), 256)
    placed = placed.withColumn("_said", F.concat(F.length("role").cast("string"), F.lit(":"), said))
    firsts = placed.groupBy("_key", "_said").agg(F.min("_rank").alias("_first"))
    sizes = placed.groupBy("_key").agg(F.count("*").alias("_n"))
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = (
        F.when(last == "", BLANK)
        .when(F.col("_rank") > F.col("_first"), DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(0)
    )
    initial = F.greatest(F.instr(F.lit(INITIALS), F.left("role", F.lit(1))) - 1, F.lit(0))
    block = F.floor(F.col("_rank") / F.greatest(F.lit(how.least_block), F.ceil(F.sqrt("_n"))))
    return placed.join(firsts, ["_key", "_said"]).join(sizes, "_key").select(
        "_key", block.alias("_block"), "_rank", "conv_id", "turn", "role", "text", (initial + 4 * fault).cast("int").alias("_code")
    )


# ---------------------------------------------------------------- passes over blocks


def _sorted(df: DataFrame, *order) -> DataFrame:
    """Conversations dealt over the tasks, each in order within its task."""
    return df.repartition("_key").sortWithinPartitions("_key", *order)


def _blocks(rows: DataFrame, how: RepairCosts) -> DataFrame:
    """One row per block: the rows' codes in order and the cost from each state to each state."""

    def finish(key, block, codes):
        costs = []
        for t in range(4):
            vector = [0 if s == t else _FAR for s in range(4)]
            for code in reversed(codes):
                vector = before(code, vector, how)
            costs.append([min(v, _FAR) for v in vector])
        return {"_key": key, "_block": block, "codes": bytes(codes), "costs": [costs[t][s] for s in range(4) for t in range(4)]}

    def run(batches: Iterator[pa.RecordBatch]):
        at, codes = None, []
        for batch in batches:
            done = []
            for key, block, code in zip(*(batch.column(c).to_pylist() for c in ("_key", "_block", "_code")), strict=True):
                if (key, block) != at:
                    if at:
                        done.append(finish(*at, codes))
                    at, codes = (key, block), []
                codes.append(code)
            yield pa.RecordBatch.from_pylist(done, kinds)
        if at:
            yield pa.RecordBatch.from_pylist([finish(*at, codes)], kinds)

    kinds = pa.schema([("_key", pa.string()), ("_block", pa.int64()), ("codes", pa.binary()), ("costs", pa.list_(pa.int64()))])
    ordered = rows.select("_key", "_block", "_rank", "_code").repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_rank")
    return ordered.mapInArrow(run, "_key string, _block long, codes binary, costs array<long>")


def _vectors(blocks: DataFrame, how: RepairCosts) -> DataFrame:
    """(_key, _block, vector): the state-cost vector behind each block, last block first."""

    def run(batches):
        at, vector = None, None
        for batch in batches:
            ends = []
            for key, costs in zip(batch.column("_key").to_pylist(), batch.column("costs").to_pylist(), strict=True):
                if key != at:
                    at, vector = key, at_end(how)
                ends.append(vector)
                vector = [min(costs[4 * s + t] + vector[t] for t in range(4)) for s in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_block"), pa.array(ends, pa.list_(pa.int64()))], ["_key", "_block", "vector"])

    return _sorted(blocks.select("_key", "_block", "costs"), F.desc("_block")).mapInArrow(run, "_key string, _block long, vector array<long>")


def _walks(blocks: DataFrame, how: RepairCosts) -> DataFrame:
    """Per block and state before it: the state after it and the edits; its vector before."""

    def run(batches):
        for batch in batches:
            found = [walk(c, v, how) for c, v in zip(batch.column("codes").to_pylist(), batch.column("vector").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"), batch.column("_block"), batch.column("codes"),
                    pa.array([f[0] for f in found], pa.list_(pa.int64())),
                    pa.array([f[1] for f in found], pa.list_(pa.int32())),
                    pa.array([f[2] for f in found], pa.list_(pa.string())),
                ],
                ["_key", "_block", "codes", "cost", "states", "edits"],
            )

    placed = blocks.join(_vectors(blocks, how), ["_key", "_block"]).select("_key", "_block", "codes", "vector")
    return placed.mapInArrow(run, "_key string, _block long, codes binary, cost array<long>, states array<int>, edits array<string>")


def _chosen(walks: DataFrame, how: RepairCosts) -> DataFrame:
    """(_key, _block, state, edits, cost, counts): the edits of each block as the conversation runs,
    first block first.  ``cost`` is the conversation's, on its first block only."""
    legal = {(1, 2), (2, 3), (3, 2)}

    def run(batches):
        waiting = None  # the block before, which gets the insertions at the end if it is the last
        at, state, initial = None, 0, None

        def row(last):
            if last:
                waiting["edits"] += _ending(state, how)
            return waiting

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                same = r["_key"] == at
                if waiting:
                    done.append(row(not same))
                if not same:
                    at, state, initial = r["_key"], 0, None
                firsts = [c & 3 for c in r["codes"]]
                pairs = list(zip(([initial] if same else []) + firsts, firsts if same else firsts[1:], strict=False))
                faults_ = [c >> 2 for c in r["codes"]]
                waiting = {
                    "_key": at, "_block": r["_block"], "state": state, "edits": r["edits"][state], "cost": 0 if same else r["cost"][0],
                    "blank": faults_.count(BLANK), "duplicate": faults_.count(DUPLICATE), "truncated": faults_.count(TRUNCATED),
                    "illegal": sum(p not in legal for p in pairs),
                }
                state, initial = r["states"][state], firsts[-1]
            yield pa.RecordBatch.from_pylist(done, kinds)
        if waiting:
            yield pa.RecordBatch.from_pylist([row(True)], kinds)

    numbers = ("cost", "blank", "duplicate", "truncated", "illegal")
    kinds = pa.schema([("_key", pa.string()), ("_block", pa.int64()), ("state", pa.int32()), ("edits", pa.string()), *[(c, pa.int64()) for c in numbers]])
    return _sorted(walks, "_block").mapInArrow(
        run, "_key string, _block long, state int, edits string, " + ", ".join(f"{c} long" for c in numbers)
    )


def _repaired(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(_key, _block, place, edit, role, text): the rows after the repair."""

    def run(batches):
        edits, state, at, place = "", 0, 0, 0

        def inserted(out, key, block):
            nonlocal at, state, place
            while at < len(edits) and edits[at] == "I":
                out.append({"_key": key, "_block": block, "place": place, "edit": "I", "role": ROLES[state], "text": ""})
                at, state, place = at + 1, FITS[state], place + 1

        here = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["_rank"] < 0:
                    if here:
                        inserted(out, *here)
                    here, edits, state, at, place = (r["_key"], r["_block"]), r["edits"], r["state"], 0, 0
                    continue
                inserted(out, *here)
                edit, at = edits[at], at + 1
                if edit == "D":
                    continue
                role = r["role"] if edit == "K" else ROLES[state]
                out.append({"_key": r["_key"], "_block": r["_block"], "place": place, "edit": edit, "role": role, "text": r["text"]})
                state, place = (KEEPS[max(INITIALS.find(role[:1]), 0)][state] if edit == "K" else FITS[state]), place + 1
            yield pa.RecordBatch.from_pylist(out, kinds)
        if here:
            out = []
            inserted(out, *here)
            yield pa.RecordBatch.from_pylist(out, kinds)

    kinds = pa.schema([("_key", pa.string()), ("_block", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    nothing = F.lit(None).cast("string")
    heads = chosen.select("_key", "_block", F.lit(-1).cast("long").alias("_rank"), nothing.alias("role"), nothing.alias("text"), "edits", "state")
    said = rows.select("_key", "_block", "_rank", "role", "text", nothing.alias("edits"), F.lit(None).cast("int").alias("state"))
    ordered = heads.unionByName(said).repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_rank")
    return ordered.mapInArrow(run, "_key string, _block long, place long, edit string, role string, text string")


def repair(rows: DataFrame, how: RepairCosts = RepairCosts()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(report, repaired) for the rows (conv_id, turn, role, text) of conversations.

    A conversation's rows are ordered by turn (null first), role and text.  A row's first fault
    counts: blank (no character but white space), duplicate (role and text of an earlier row) or
    truncated (the last character but white space is none of ``.!?``).  Blank and duplicate rows
    must go; a truncated one that stays costs ``how.truncated`` more.

    ``report`` has one row per conv_id: gaps (largest minus smallest turn plus one minus different
    turns, nulls ignored), blank, duplicate, truncated, illegal (neighbours whose initials are not
    su, ua or au), cost, and audit: the initials of the cheapest edits (Delete, Insert, Keep, Rerole)
    in order, the least in ASCII among equals.  ``repaired`` has (conv_id, block, place, edit, role,
    text), to be read in the order of block and place.

    A null conv_id is a conversation of its own; a null role or text is one space, so such a text
    is blank and such a role fits nowhere.  Roles go by their first letter.  Rows that are equal in
    all columns are all read, the later ones as duplicates.  An empty table gives empty results;
    other columns are ignored.
    """
    found = staged(faults(rows, how))
    blocks = staged(_blocks(found, how))
    chosen = staged(_chosen(_walks(blocks, how), how))
    turns = found.groupBy("_key", "turn").agg(F.first("conv_id").alias("conv_id"))
    gaps = turns.groupBy("_key").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
    )
    numbers = ("blank", "duplicate", "truncated", "illegal", "cost")
    parts = F.array_sort(F.collect_list(F.struct("_block", "edits")))
    sums = chosen.groupBy("_key").agg(*[F.sum(c).alias(c) for c in numbers], F.array_join(F.transform(parts, lambda p: p["edits"]), "").alias("audit"))
    report = gaps.join(sums, "_key").select("conv_id", "gaps", *numbers, "audit")
    ids = gaps.select("_key", "conv_id")
    repaired = _repaired(found, chosen).join(ids, "_key").select("conv_id", F.col("_block").alias("block"), "place", "edit", "role", "text")
    return report, repaired
