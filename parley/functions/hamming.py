"""Hamming distances over blocks of signatures: the nearest rows of each query, and pairs within a radius.

Signatures are arrays (rows x words, uint64). Distances are worked out word by word
for blocks that fit a core's cache, and only what may be told is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Rows and columns of a block of distances.
ROWS, COLUMNS = 64, 2048
#: Pairs or candidates held at once.
HELD = 1 << 20
LAST = np.iinfo(np.int64).max


class Block:
    """Distances of some signatures to others, in buffers that are used again."""

    def __init__(self, rows: int = ROWS, columns: int = COLUMNS):
        self.cells, self.counts, self.total = np.empty(rows * columns, np.uint64), np.empty(rows * columns, np.uint8), np.empty(rows * columns, np.uint16)

    def of(self, a: list[np.ndarray], b: list[np.ndarray], most: int | None = None) -> tuple[np.ndarray, int]:
        """(distances so far, how many words they are of): with `most`, words are left out once few pairs may still be within it."""
        shape = len(a[0]), len(b[0])
        n = shape[0] * shape[1]
        cells, counts, total = (x[:n].reshape(shape) for x in (self.cells, self.counts, self.total))
        for w in range(len(a)):
            np.bitwise_xor(a[w][:, None], b[w], out=cells)
            if not w:
                np.bitwise_count(cells, out=total)
                continue
            np.bitwise_count(cells, out=counts)
            np.add(total, counts, out=total)
            if most is not None and w + 1 < len(a) and np.count_nonzero(total <= most) * 64 < n:
                return total, w + 1
        return total, len(a)


class Nearest:
    """The k nearest rows of each slot, ties to the lower id, of rows that come block by block.

    What is held are k rows a slot and the candidates since they were last settled. With
    `distinct`, an id that comes several times for a slot counts once, at its least distance.
    """

    def __init__(self, slots: int, k: int, distinct: bool = False):
        self.k, self.distinct, self.most = k, distinct, max(HELD, 2 * slots * k)
        self.bound = np.full(slots, 1 << 15, np.int32)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.block = 0, Block()

    def add(self, slots: np.ndarray, queries: np.ndarray, words: np.ndarray, ids: np.ndarray) -> None:
        """Rows (words, ids) that the queries of some slots ask for."""
        columns = [np.ascontiguousarray(words[:, w]) for w in range(words.shape[1])]
        once = not self.distinct or len(np.unique(ids)) == len(ids)
        for b in range(0, len(ids), COLUMNS):
            some, of_some = [c[b : b + COLUMNS] for c in columns], ids[b : b + COLUMNS]
            for a in range(0, len(slots), ROWS):
                mine = slots[a : a + ROWS]
                d, _ = self.block.of([queries[a : a + ROWS, w] for w in range(len(columns))], some)
                near = d <= self.bound[mine, None]
                if once and len(of_some) > self.k and np.count_nonzero(near) > 2 * self.k * len(mine):
                    self.bound[mine] = np.minimum(self.bound[mine], np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
                    near = d <= self.bound[mine, None]
                i, j = np.divmod(np.flatnonzero(near), len(of_some))
                if len(i):
                    self.found.append((mine[i].astype(np.int32), d[i, j], of_some[j]))
                    self.held += len(i)
                    if self.held > self.most:
                        self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, distance, id) of what is nearest so far."""
        if not self.found:
            return np.zeros(0, np.int32), np.zeros(0, np.uint16), np.zeros(0, np.int64)
        slot, d, ids = (np.concatenate(x) for x in zip(*self.found))
        if self.distinct:
            order = np.lexsort((d, ids, slot))
            order = order[np.concatenate([[True], (slot[order][1:] != slot[order][:-1]) | (ids[order][1:] != ids[order][:-1])])]
            slot, d, ids = slot[order], d[order], ids[order]
        order = np.lexsort((ids, d, slot))
        slot, d, ids = slot[order], d[order], ids[order]
        lead = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        size = np.diff(np.append(lead, len(slot)))
        on = np.arange(len(slot)) - np.repeat(lead, size) < self.k
        full = size >= self.k
        self.bound[slot[lead[full]]] = np.minimum(self.bound[slot[lead[full]]], d[lead[full] + self.k - 1])
        slot, d, ids = slot[on], d[on], ids[on]
        self.found, self.held = [(slot, d, ids)], len(slot)
        self.most = max(self.most, 2 * self.held)
        return slot, d, ids


def first_equal_band(diff: np.ndarray, edges: list[int]) -> np.ndarray:
    """The first of the bands in which two signatures don't differ; diff has the differing bits of each pair, band i the bits edges[i] .. edges[i + 1] - 1."""
    out = np.full(len(diff), len(edges), np.int32)
    for i in range(len(edges) - 2, -1, -1):
        same = np.ones(len(diff), bool)
        for w in range(edges[i] // 64, (edges[i + 1] - 1) // 64 + 1):
            low, high = max(edges[i], 64 * w) - 64 * w, min(edges[i + 1], 64 * w + 64) - 64 * w
            mask = ((1 << (high - low)) - 1) << (64 - high)
            same &= (diff[:, w] & np.uint64(mask)) == 0
        out[same] = i
    return out


def pairs_within(words: np.ndarray, key: np.ndarray, r: int, left: np.ndarray | None = None, part: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance, differing bits) of pairs of rows with equal keys within r bits, i before j; some at a time.

    With `left`, rows are of two kinds, and pairs are of one of each; with `part` they
    are of two parts, and pairs are of one of each too.
    """
    order = np.argsort(key, kind="stable") if part is None else np.lexsort((part, key))
    sorted_key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    columns = [np.ascontiguousarray(words[order, w]) for w in range(words.shape[1])]
    size = np.diff(edge)

    def told(x, y):
        """Of pairs of places in the order, those within r bits."""
        for kind in (left, part):
            if kind is not None:
                on = kind[order[x]] != kind[order[y]]
                x, y = x[on], y[on]
        d = np.zeros(len(x), np.int32)
        for c in columns:
            d += np.bitwise_count(c[x] ^ c[y])
            on = d <= r
            x, y, d = x[on], y[on], d[on]
        return order[x], order[y], d, np.stack([c[x] ^ c[y] for c in columns], axis=1)

    # short runs pair by pair, all of them together
    short = np.repeat(size < ROWS, size)
    at = np.flatnonzero(short)
    many = np.repeat(edge[1:], size)[at] - at - 1
    before = np.concatenate([[0], np.cumsum(many)])
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(before, before[i] + HELD, "right")) - 1)
        x = np.repeat(at[i:j], many[i:j])
        y = x + 1 + np.arange(len(x)) - np.repeat(before[i:j] - before[i], many[i:j])
        if len(x):
            yield told(x, y)
        i = j
    block = Block()
    for s, e in zip(edge[:-1][size >= ROWS], edge[1:][size >= ROWS]):
        second = s if part is None else s + int(np.searchsorted(part[order[s:e]], part[order[s]], "right"))
        yield from _in_blocks(block, columns, s, e if part is None else second, second, e, r, told)


def _in_blocks(block: Block, columns, s, e, first, last, r, told):
    """Pairs of rows s .. e - 1 with later ones of first .. last - 1."""
    for a in range(s, e, ROWS):
        mine = [c[a : min(e, a + ROWS)] for c in columns]
        for b in range(max(first, a), last, COLUMNS):
            d, _ = block.of(mine, [c[b : min(last, b + COLUMNS)] for c in columns], r)
            x, y = np.nonzero(d <= r)
            x, y = x + a, y + b
            on = x < y
            if on.any():
                yield told(x[on], y[on])
