"""A K2-treap in numpy: the points of a grid in a quadtree whose cells know the greatest value in them.

Cells with two points or more are cut into quadrants; a cell with one point holds it and is cut no further. Nodes lie in
breadth-first order, so a node is four bits (which quadrants have points; none: one point), and children are found by
counting the bits before. Values are written for cells of several points only; a point's own follows from what it counts."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable

import numpy as np
import zstandard

#: Ranges that one question opens at once.
OPENED = 64


def _spread(v: np.ndarray) -> np.ndarray:
    """Bits of v at even places."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | v << np.uint64(shift)) & np.uint64(mask)
    return v


class Treap:
    """Points (row, column) with counts; kinds: quadrants of each node; greatest: the greatest value of each node."""

    def __init__(self, height: int, kinds: np.ndarray, greatest: np.ndarray, rows: np.ndarray, columns: np.ndarray):
        self.height, self.kinds, self.greatest = height, kinds, greatest
        self.child = 1 + np.cumsum(np.bitwise_count(kinds), dtype=np.int64) - np.bitwise_count(kinds)
        self.point = np.cumsum(kinds == 0) - 1  # of nodes with one point
        self.rows, self.columns = rows, columns

    @staticmethod
    def build(rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, values: np.ndarray) -> bytes:
        """The treap of points, each pair at most once, as bytes."""
        height = max(1, int(max(rows.max(), columns.max())).bit_length()) if len(rows) else 1
        code = _spread(rows) << np.uint64(1) | _spread(columns)
        order = np.argsort(code)
        code, values = code[order], values[order]
        kinds, greatest, points = [], [], []
        sizes, inside = np.array([len(code)]), np.arange(len(code))  # nodes of a level, and the points of those with several
        for level in range(height + 1):
            if not len(sizes) or not len(code):
                break
            single = sizes == 1
            if level == 0:
                kinds.append(np.zeros(1, np.uint8))
                greatest.append(np.array([values.max()]))
                if single[0]:
                    points.append(inside)
                    break
            # kinds of this level's nodes with several points follow from their children
            several = np.flatnonzero(~single)
            if not len(several):
                break
            prefix = code[inside] >> np.uint64(2 * (height - 1 - level))
            begins = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            quadrant = (prefix[begins] & np.uint64(3)).astype(np.uint8)
            owner = np.searchsorted(np.cumsum(sizes[several]), begins, side="right")
            kinds[-1][several] = np.bitwise_or.reduceat(np.uint8(1) << quadrant, np.searchsorted(owner, np.arange(len(several))))
            sizes = np.diff(np.append(begins, len(inside)))
            kinds.append(np.zeros(len(sizes), np.uint8))
            greatest.append(np.maximum.reduceat(values[inside], begins))
            points.append(inside[begins[sizes == 1]])
            inside = inside[np.repeat(sizes > 1, sizes)]
        kind = np.concatenate(kinds or [np.zeros(0, np.uint8)])
        most = np.concatenate(greatest or [np.zeros(0, np.int64)])[kind > 0]
        at = order[np.concatenate(points or [np.zeros(0, np.int64)])]
        packed = np.append(kind, 0)[: len(kind) + len(kind) % 2].reshape(-1, 2)
        parts = [packed[:, 0] | packed[:, 1] << 4, most.astype("<u4"), rows[at].astype("<u4"), columns[at].astype("<u2"), counts[at].astype("<u4")]
        pack = zstandard.ZstdCompressor(level=1).compress
        raw = [pack(np.ascontiguousarray(p).view(np.uint8).reshape(len(p), -1).T.tobytes() if len(p) else b"") for p in parts]  # bytes of equal weight side by side
        return struct.pack("<BQ5I", height, len(kind), *map(len, raw)) + b"".join(raw)

    @classmethod
    def open(cls, raw: bytes, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Treap:
        """The treap of bytes; value(counts, columns) gives the points' values."""
        height, n, *lengths = struct.unpack_from("<BQ5I", raw)
        at, parts = struct.calcsize("<BQ5I"), []
        for length, form in zip(lengths, ("u1", "<u4", "<u4", "<u2", "<u4"), strict=True):
            got = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[at : at + length]), np.uint8)
            parts.append(np.ascontiguousarray(got.reshape(np.dtype(form).itemsize, -1).T).view(form).ravel())
            at += length
        packed, most, rows, columns, counts = parts
        kinds = np.stack([packed & 15, packed >> 4], 1).ravel()[:n]
        columns = columns.astype(np.int64)
        greatest = np.empty(n, np.int64)
        greatest[kinds > 0] = most
        greatest[kinds == 0] = value(counts.astype(np.int64), columns)
        return cls(height, kinds, greatest, rows.astype(np.int64), columns)

    def best(self, asked: list[tuple[np.ndarray, np.ndarray]], offer: list[Callable[[int, int], None]], least: list[Callable[[], int]]) -> None:
        """For each of asked(rows, weights): offer every column whose score, the sum of weight times value over the rows,
        may count, best bounds first; least tells the lowest score that still counts.

        The paths of a question's rows go down together: a range of columns is open with one node for each row that may
        have points there, and its bound is what these nodes' greatest values sum up to."""
        if not len(self.kinds):
            return
        heaps = [[(-1 << 62, 0, 0, np.arange(len(rows)), np.zeros(len(rows), np.int64))] if len(rows) else [] for rows, _ in asked]
        first = np.cumsum([0] + [len(rows) for rows, _ in asked])
        row = np.concatenate([rows for rows, _ in asked] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([weights for _, weights in asked] or [np.zeros(0, np.int64)]).astype(np.int64)
        top = self.height - 1
        while True:
            opened = []
            for q, heap in enumerate(heaps):
                floor = least[q]()
                for _ in range(min(OPENED, len(heap))):
                    if -heap[0][0] < floor:
                        heap.clear()
                        break
                    opened.append((q, *heapq.heappop(heap)[1:]))
            if not opened:
                return
            many = [len(o[3]) for o in opened]
            owner = np.repeat(np.arange(len(opened)), many)
            question = np.array([o[0] for o in opened])
            start, level = np.array([o[1] for o in opened]), np.array([o[2] for o in opened])
            term = np.concatenate([o[3] for o in opened]) + np.repeat(first[question], many)
            node = np.concatenate([o[4] for o in opened])
            shift = top - level[owner]
            kind = self.kinds[node]
            alone = kind == 0
            right = np.zeros(len(node), bool)
            right[alone] = self.columns[self.point[node[alone]]] >> shift[alone] & 1
            same = np.ones(len(node), bool)
            same[alone] = self.rows[self.point[node[alone]]] == row[term[alone]]
            for half in (0, 1):
                quadrant = ((row[term] >> shift & 1) << 1 | half).astype(np.uint8)
                goes = np.where(alone, same & (right == half), kind >> quadrant & 1 == 1)
                to = np.flatnonzero(goes)
                below = self.child[node[to]] + np.bitwise_count(kind[to] & ((np.uint8(1) << quadrant[to]) - np.uint8(1)))
                below = np.where(alone[to], node[to], below)
                single = self.kinds[below] == 0
                fits = ~single
                fits[single] = self.rows[self.point[below[single]]] == row[term[to[single]]]
                to, below = to[fits], below[fits]
                bounds = np.bincount(owner[to], weight[term[to]] * self.greatest[below], len(opened)).astype(np.int64)
                cuts = np.searchsorted(owner[to], np.arange(len(opened) + 1))
                lower = term[to] - first[question[owner[to]]]
                floors = np.array([f() for f in least])[question]
                for i in np.flatnonzero((bounds > 0) & (bounds >= floors)).tolist():
                    at, depth = int(start[i]) | half << int(top - level[i]), int(level[i]) + 1
                    if depth > top:
                        offer[question[i]](at, int(bounds[i]))
                    else:
                        a, b = cuts[i], cuts[i + 1]
                        heapq.heappush(heaps[question[i]], (-int(bounds[i]), at, depth, lower[a:b], below[a:b]))
