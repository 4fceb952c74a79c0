"""The best k of every query within a task, exact and with ties by key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Candidates that a task gathers before it cuts every query's back to k, and rows it returns at once.
GATHER, SEND = 500_000, 50_000


class TopK:
    """Keeps the k best of each query among candidates (query, row, score), all by number; what ties goes by row.

    Rows are numbered as ``block`` is told of them and come in the order of their key; what is added of a query comes in the order of its rows. ``floor`` is what
    a later row's score must exceed to be among a query's best: its k-th best score at the last ``cut``, or, while it has fewer, what the caller began with."""

    def __init__(self, k: int, queries: int, floor: float = -np.inf):
        self.k, self.floor, self.seen, self.done, self.size, self.full = k, np.full(queries, floor), 0, 0, 0, False
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows, self.names = [np.empty(0, np.int64)], []

    def block(self, names: pa.Table) -> int:
        """Takes note of the keys of further rows; gives the number of the first."""
        first, self.seen = self.seen, self.seen + len(names)
        self.rows.append(np.arange(first, self.seen))
        self.names.append(names)
        return first

    def add(self, q: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((q, row, score))
        self.size += len(q)
        if self.size > max(GATHER, len(self.best[0])):
            self.cut()

    def cut(self) -> None:
        """Leaves k candidates of each query and the keys of their rows."""
        q, row, s = (np.concatenate(x) for x in zip(self.best, *self.parts))
        order = _order(q, s)
        q, row, s = q[order], row[order], s[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        last = place == self.k - 1
        self.floor[q[last]] = s[last]
        self.full = int(last.sum()) == len(self.floor)
        kept = place < self.k
        self.best, self.parts, self.size, self.done = (q[kept], row[kept], s[kept]), [], 0, self.seen
        if self.names:
            numbers, used = np.concatenate(self.rows), np.unique(self.best[1])
            self.rows, self.names = [used], [pa.concat_tables(self.names).combine_chunks().take(pa.array(np.searchsorted(numbers, used)))]

    def found(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """(query_id, key, score) of the k best of each query; ``ids`` has the queries by number."""
        self.cut()
        q, row, s = self.best
        for i in range(0, len(q), SEND):
            to = slice(i, i + SEND)
            names = self.names[0].take(pa.array(np.searchsorted(self.rows[0], row[to]))).combine_chunks()
            yield from pa.table({"query_id": ids.take(pa.array(q[to])), **{c: names[c] for c in names.column_names}, "score": pa.array(s[to])}).combine_chunks().to_batches()


def _order(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The order by query and falling score of candidates whose equals are in order; scores are rounded to nine places."""
    if len(q) and np.abs(s).max() < 2**22:  # each is a whole number of billionths, which tells it from all others
        low = np.rint(s * -1e9).astype(np.int64)
        low -= low.min()
        width = int(low.max()).bit_length()
        if width + int(q.max()).bit_length() < 63:
            return np.argsort((q << width) + low, kind="stable")
    return np.lexsort((-s, q))


def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The lengths of lists, NULL counting 0, and their elements in one array."""
    one = lists.combine_chunks()
    if isinstance(one, pa.ChunkedArray):
        one = pa.concat_arrays(one.chunks) if one.num_chunks else pa.array([], one.type)
    return pc.list_value_length(one).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), one.flatten()


def blocks(batches: Iterator[pa.RecordBatch], lists: str, first: int, most: int) -> Iterator[pa.Table]:
    """The rows in tables that hold ``first`` list elements and rows, then four times as many each time, up to ``most``."""
    parts, held = [], 0
    for batch in batches:
        sizes = np.cumsum(flat(pa.chunked_array([batch.column(lists)]))[0] + 1)
        begin = done = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(sizes, done + first - held, "right")))
            parts.append(batch.slice(begin, end - begin))
            held, done, begin = held + sizes[end - 1] - done, sizes[end - 1], end
            if held >= first or begin < batch.num_rows:
                yield pa.Table.from_batches(parts)
                parts, held, first = [], 0, min(4 * first, most)
    if parts:
        yield pa.Table.from_batches(parts)


def by_key(rows, key: Sequence[str]):
    """Rows for a task a core, each in the order of the key, so that few tasks hold k rows a query and ties go by row."""
    return rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)).sortWithinPartitions(*key)
