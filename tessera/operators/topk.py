"""The k nearest of every query, over all tiles that one task reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

FOUND = "qid bigint, ref_id bigint, d2 bigint, fraud int"
FOUND_STEP = FOUND + ", step int"
#: Rows that wait to be merged, and rows that a task holds before it hands them on.
WAITING, HELD = 1 << 18, 1 << 21


def nearest_of(order: tuple[np.ndarray, ...], keys: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Rows by keys and order (np.lexsort's, last first), of which the first k of each combination of keys stay."""
    sort = np.lexsort((*order, *keys))
    new = np.zeros(len(sort), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[sort][1:] != key[sort][:-1]
    start = np.flatnonzero(new)
    rank = np.arange(len(sort)) - np.repeat(start, np.diff(np.r_[start, len(sort)]))
    return sort[rank < k]


class TopK:
    """A bounded list for each query that lasts over all tiles of a task, so that at most k rows a query and task go on.

    With steps, a row of step s counts for the lists of s and all later ones; then k rows a query, step and task go on. A
    task with more than HELD rows hands on what it has and begins anew.
    """

    def __init__(self, k: int, steps: bool = False):
        self.k, self.steps = k, steps
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = self.held = 0

    def add(self, qid: np.ndarray, ref_id: np.ndarray, d2: np.ndarray, fraud: np.ndarray, step: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.parts.append((qid, ref_id, d2, fraud) if step is None else (qid, ref_id, d2, fraud, step))
        self.waiting += len(qid)
        if self.waiting > max(WAITING, self.held):
            self._merge()
            if self.held > HELD:
                yield from self.rows()

    def _merge(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        keys = (columns[4], columns[0]) if self.steps else (columns[0],)
        keep = nearest_of((columns[1], columns[2]), keys, self.k)
        self.parts, self.waiting, self.held = [tuple(c[keep] for c in columns)], 0, len(keep)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            qid, ref_id, d2, fraud, *step = self.parts[0]
            names = ["qid", "ref_id", "d2", "fraud", *(["step"] if step else [])]
            for s in range(0, len(qid), WAITING):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + WAITING]) for c in (qid.astype(np.int64), ref_id.astype(np.int64), d2.astype(np.int64), fraud.astype(np.int32), *(x.astype(np.int32) for x in step))], names=names)
        self.parts, self.waiting, self.held = [], 0, 0
