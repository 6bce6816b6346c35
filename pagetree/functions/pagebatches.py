"""Trees of whole pages in Arrow batches: the walks of ``pagearrays`` for many pages at a time.

A batch holds the nodes of its pages in order.  ``links`` are parent positions in the batch, -1 for a
root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROOT = -1
_NONE = -2  # an index that no parent has


def _starts(ids: pa.Array) -> np.ndarray:
    """Positions at which another page begins."""
    after, here = ids.slice(1), ids.slice(0, len(ids) - 1)
    differ = pc.or_(pc.fill_null(pc.not_equal(after, here), False), pc.xor(after.is_null(), here.is_null()))
    return np.append(0, np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1)


def whole_pages(batches, key: str):
    """Batches cut between pages, from batches of rows sorted by page: a batch's last page waits for the next."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        last = int(_starts(rows.column(rows.schema.get_field_index(key)))[-1])
        if last:
            yield rows.slice(0, last)
        rest = rows.slice(last)
    if rest is not None:
        yield rest


def pages(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's page in the batch, and the positions at which pages begin."""
    starts = _starts(ids)
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids)))), starts


def numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, _NONE).to_numpy(zero_copy_only=False).astype(np.int64)


def per_page(page: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Flagged rows of each page."""
    return np.bincount(page[flags], minlength=page[-1] + 1)


def links(page: np.ndarray, starts: np.ndarray, idx: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Parent ids to positions; a missing or out-of-range parent makes a root."""
    known = (page << 33) + idx
    wanted = (page << 33) + parents
    at = np.searchsorted(known, wanted)
    # the node at the place of its index goes before others of that index
    direct = np.minimum(starts[page] + np.maximum(parents, 0), len(page) - 1)
    at = np.where(known[direct] == wanted, direct, np.minimum(at, len(page) - 1))
    return np.where((parents >= 0) & (known[at] == wanted), at, ROOT)


def tree_edits(page: np.ndarray, gold: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """Children held by only one of two trees, over the parents that both trees reach alike, per page.

    Pointer doubling: after k rounds a node has seen its 2^k nearest ancestors; one that has not met a
    root after as many rounds as its page can need hangs on a cycle.
    """
    off = gold != pred
    alike, up = ~off, gold
    for _ in range(int(np.bincount(page).max()).bit_length() + 1):
        below = up >= 0
        if not below.any():
            break
        alike = alike & (~below | alike[up])
        up = np.where(below, up[up], ROOT)
    alike &= up < 0
    edits = sum(np.bincount(page[off], weights=(p[off] < 0) | alike[p[off]], minlength=page[-1] + 1) for p in (pred, gold))
    return edits.astype(np.int64)
