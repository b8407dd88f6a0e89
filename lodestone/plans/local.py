"""Depth-first mining of one projected database inside a task, on NumPy arrays.

Used where a prefix's projected baskets are few enough; the data-parallel plans stay with
larger ones. Transactions are runs of (item, utility) in search order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

Found = tuple[tuple[int, ...], int]


def by_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """The rows of each prefix (the first column, all of one length), of batches that are sorted by it."""

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    held, name = [], None
    for b in batches:
        if not b.num_rows:
            continue
        names = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
        begin = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)]))
        for s, e in zip(begin, np.append(begin[1:], b.num_rows), strict=True):
            now = tuple(names[s].tolist())
            if held and now != name:
                yield name, whole(held)
                held = []
            name = now
            held.append(b.slice(s, e - s))
    if held:
        yield name, whole(held)


class Output:
    """Rows (items, util), and (null, candidates) for each search, in batches."""

    def __init__(self) -> None:
        self.items, self.utils = [], []

    def add(self, items: tuple[int, ...] | None, util: int) -> None:
        self.items.append(None if items is None else list(items))
        self.utils.append(util)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.items, pa.list_(pa.int64())), pa.array(self.utils, pa.int64())], ["items", "util"])
        self.items, self.utils = [], []
        return out


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all runs in turn, and the run of each."""
    size = end - start
    owner = np.repeat(np.arange(len(start)), size)
    shift = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    return np.arange(len(owner)) - shift[owner] + start[owner], owner


class DepthFirst:
    """Searches the extensions of a prefix by subtree and local utility.

    With ``tighten`` elements that can't matter any more are dropped, and local utility
    counts what is left; without it local utility counts the declared transaction utility
    that remains, as the published bound does. Without ``subtree`` local utility alone says
    what is explored. Itemsets found are the same.
    """

    def __init__(self, min_util: int, tighten: bool = True, subtree: bool = True):
        self.min_util, self.tighten, self.subtree, self.candidates = min_util, tighten, subtree, 0

    def extend(self, prefix: tuple[int, ...], item: np.ndarray, util: np.ndarray, start: np.ndarray, end: np.ndarray, pu: np.ndarray, extra: np.ndarray, keep: np.ndarray | None) -> Iterator[Found]:
        """Extensions of a prefix whose rows are the runs item[start:end], with the prefix's utility in each."""
        at, owner = _ranges(start, end)
        if not len(at):
            return
        items, u = item[at], util[at]
        counted = u if keep is None else np.where(np.isin(items, keep), u, 0)
        size = end - start
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        sums = np.concatenate([[0], np.cumsum(counted)])
        whole = np.concatenate([[0], np.cumsum(u)])
        last = begin + size
        order = np.argsort(items, kind="stable")
        names, first = np.unique(items[order], return_index=True)
        su = np.add.reduceat((pu[owner] + sums[last[owner]] - sums[np.arange(len(at))])[order], first)
        lu = np.add.reduceat((pu + extra + whole[last] - whole[begin])[owner][order], first)
        may = np.ones(len(names), bool) if keep is None else np.isin(names, keep)
        explore = may & ((su >= self.min_util) if self.subtree else (su >= self.min_util) | (lu >= self.min_util))
        if not explore.any():
            return
        kept = names[may & ((su >= self.min_util) | (lu >= self.min_util))]
        yield from self.children(prefix, items, u, begin, last, owner, pu, extra, order, names, first, explore, kept)

    def children(self, prefix, items, u, begin, last, owner, pu, extra, order, names, first, explore, kept) -> Iterator[Found]:  # noqa: ANN001
        self.candidates += int(explore.sum())
        bounds = np.append(first, len(order))
        if self.tighten and len(kept) < len(names):
            stay = np.isin(items, kept)
            new = np.concatenate([[0], np.cumsum(stay)])
        else:
            stay, new = None, None
        left, left_u = (items, u) if stay is None else (items[stay], u[stay])
        for i in np.flatnonzero(explore):
            place = order[bounds[i] : bounds[i + 1]]
            t = owner[place]
            below = pu[t] + u[place]
            total = int(below.sum())
            name = (*prefix, int(names[i]))
            if total >= self.min_util:
                yield name, total
            s, e = place + 1, last[t]
            if new is not None:
                s, e = new[s], new[e]
            some = s < e
            if some.any():
                yield from self.extend(name, left, left_u, s[some], e[some], below[some], extra[t][some], None if self.tighten else kept)


class ListSearch:
    """Searches by joining utility lists: tid, own utility and remaining utility of an itemset.

    ``pairs`` holds the bound of each pair of items that occur together; a pair under the
    minimum ends its extensions. A join is given up when what can remain is too little.
    """

    def __init__(self, min_util: int, pairs: dict[tuple[int, int], int]):
        self.min_util, self.pairs, self.candidates = min_util, pairs, 0

    def join(self, parent, x, y):  # noqa: ANN001, ANN201
        """The list of Pxy from those of P, Px and Py; None when it can't reach the minimum."""
        tid, at_x, at_y = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
        if int((x[1] + x[2])[at_x].sum()) < self.min_util:
            return None
        own = x[1][at_x] + y[1][at_y]
        if parent is not None:
            own = own - parent[1][np.searchsorted(parent[0], tid)]
        return tid, own, y[2][at_y]

    def search(self, prefix: tuple[int, ...], parent, lists: list[tuple[int, tuple]]) -> Iterator[Found]:  # noqa: ANN001
        """lists: (item, list) of the prefix's extensions, in search order."""
        self.candidates += len(lists)
        for i, (x, x_list) in enumerate(lists):
            total = int(x_list[1].sum())
            if total >= self.min_util:
                yield (*prefix, x), total
            if total + int(x_list[2].sum()) < self.min_util:
                continue
            after = []
            for y, y_list in lists[i + 1 :]:
                if self.pairs.get((min(x, y), max(x, y)), 0) < self.min_util:
                    continue
                self.candidates += 1
                joined = self.join(parent, x_list, y_list)
                if joined is not None and len(joined[0]):
                    after.append((y, joined))
            if after:
                yield from self.search((*prefix, x), x_list, after)
