"""Optimal one-to-one assignment with a cost limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs (row, column) that minimise matched costs plus ``limit / 2`` for each row and column left over.

    A pair pays for itself only below ``limit``: with every cost lowered by the limit and cut off at zero, a
    full assignment of least cost holds the wanted pairs as its negative ones. Shortest augmenting paths.
    """
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T, limit))
    gain = np.minimum(np.where(np.isnan(cost), np.inf, cost) - limit, 0.0)
    if not gain.any():
        return []
    n, m = gain.shape
    row_of = np.full(m, -1)
    row_price, column_price = np.zeros(n), np.zeros(m)
    for row in range(n):
        shortest, back = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        current, at, reached, column = row, -1, 0.0, -1
        visited = [(row, 0.0)]
        while True:
            reduced = reached + gain[current] - row_price[current] - column_price
            better = ~done & (reduced < shortest)
            shortest[better], back[better] = reduced[better], at
            column = int(np.where(done, np.inf, shortest).argmin())
            reached = shortest[column]
            done[column] = True
            if row_of[column] < 0:
                break
            at, current = column, row_of[column]
            visited.append((current, reached))
        for r, d in visited:
            row_price[r] += reached - d
        column_price[done] -= reached - shortest[done]
        while column >= 0:
            before = back[column]
            row_of[column] = row if before < 0 else row_of[before]
            column = before
    return sorted((int(r), c) for c, r in enumerate(row_of) if r >= 0 and gain[r, c] < 0)


def _rivals(frame: np.ndarray, side: np.ndarray) -> np.ndarray:
    """How many pairs of the same frame have the same object on a side."""
    _, own = np.unique(side, return_inverse=True)
    _, at, counts = np.unique(frame * (own.max(initial=0) + 1) + own, return_inverse=True, return_counts=True)
    return counts[at]


def _solve(limit):
    """A batch's pairs without a rival are taken together; only the others are solved, frame by frame."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            a, b, cost = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
            frame = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            alone = (_rivals(frame, a) == 1) & (_rivals(frame, b) == 1)
            taken = [np.flatnonzero(alone)]
            rest = np.flatnonzero(~alone)
            for own in np.split(rest, np.flatnonzero(np.diff(frame[rest])) + 1) if len(rest) else []:
                (rows, i), (columns, j) = (np.unique(side[own], return_inverse=True) for side in (a, b))
                costs, place = np.full((len(rows), len(columns)), np.inf), np.zeros((len(rows), len(columns)), np.int64)
                costs[i, j], place[i, j] = cost[own], own
                taken.append(np.array([place[r, c] for r, c in assign(costs, limit)], np.int64))
            at = np.concatenate(taken)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(frame[at])), *map(pa.array, (a[at], b[at], cost[at]))], names=["frame_idx", "a", "b", "cost"])

    return run


def assigned(pairs: DataFrame, limit: float) -> DataFrame:
    """Optimal matching of each frame's pairs ``frame_idx, a, b, cost``; pairs that aren't listed can't match.

    Pairs of at least the limit never match and are dropped before a frame's few pairs meet in one row.
    """
    rows = pairs.filter(F.col("cost") < limit).select(F.col("frame_idx").cast("long"), F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("cost").cast("double").alias("cost")).alias("p"))
    return rows.groupBy("frame_idx").agg(F.collect_list("p").alias("pairs")).mapInArrow(_solve(limit), "frame_idx long, a long, b long, cost double")
