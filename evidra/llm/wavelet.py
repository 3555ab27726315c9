"""Wavelet matrices in numpy: a sequence of ids as bit planes that know ranks, in a few bits an id.

Ids are numbered by falling frequency. The first numbers have codes of `width` bits; all others share the code of that many
ones and go on in a second matrix of just these. The width is the one that takes the least bits in all. Each plane keeps, for
every 512 bits, the ones before; access, rank, select and decoding work on the planes as they lie in the file."""

from __future__ import annotations

import struct
import zlib
from itertools import pairwise

import numpy as np

MAGIC = b"EWM1"
_BLOCK = 512


class Plane:
    """n bits, packed, with the ones before every block of 512."""

    def __init__(self, packed: np.ndarray, before: np.ndarray, n: int):
        self.packed, self.before, self.n = packed, before, n
        self.words = packed.view("<u8")
        self.zeros = n - int(before[-1])

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.zeros(-(-max(len(bits), 1) // _BLOCK) * (_BLOCK // 8), np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        ones = np.bitwise_count(packed.view("<u8")).reshape(-1, 8).sum(1)
        return cls(packed, np.concatenate([[0], np.cumsum(ones)]).astype("<u4"), len(bits))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n, bitorder="little").view(bool)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.packed[i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(bool)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word, block = i >> 6, i >> 9
        out = self.before[block].astype(np.int64)
        for k in range(7):
            at = (block << 3) + k
            whole = at < word
            out[whole] += np.bitwise_count(self.words[at[whole]])
        part = (i & 63) > 0
        mask = (np.uint64(1) << (i[part] & 63).astype(np.uint64)) - np.uint64(1)
        out[part] += np.bitwise_count(self.words[word[part]] & mask)
        return out

    def select(self, k: int, bit: int) -> int:
        """Place of the one (or zero) that k others precede."""
        before = self.before.astype(np.int64) if bit else np.arange(len(self.before)) * _BLOCK - self.before.astype(np.int64)
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.packed[block * 64 : block * 64 + 64], bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(part == bit)[k - before[block]])


class Matrix:
    """Codes of `width` bits, the highest bit's plane first; each plane is ordered by the bits above, zeros first."""

    def __init__(self, planes: list[Plane], width: int, n: int):
        self.planes, self.width, self.n = planes, width, n

    @classmethod
    def of(cls, codes: np.ndarray, width: int) -> Matrix:
        planes = []
        for k in range(width - 1, -1, -1):
            bits = (codes >> np.uint16(k) & np.uint16(1)).astype(bool)
            planes.append(Plane.of(bits))
            codes = np.concatenate([codes[~bits], codes[bits]])
        return cls(planes, width, len(codes))

    def decode(self) -> np.ndarray:
        codes = np.zeros(self.n, np.uint16)
        for k, plane in enumerate(reversed(self.planes)):
            bits, above = plane.bits(), np.empty(self.n, np.uint16)
            above[~bits] = codes[: plane.zeros]
            above[bits] = codes[plane.zeros :] | np.uint16(1 << k)
            codes = above
        return codes

    def access(self, i: np.ndarray) -> np.ndarray:
        i, out = i.astype(np.int64), np.zeros(len(i), np.int64)
        for plane in self.planes:
            bit, ones = plane.get(i), plane.ones(i)
            out = out << 1 | bit
            i = np.where(bit, plane.zeros + ones, i - ones)
        return out

    def _span(self, code: int, i: np.ndarray) -> tuple[np.ndarray, int]:
        """Where the first i places' codes end on the last plane, and where this code begins there."""
        ends = np.append(0, i).astype(np.int64)
        for k, plane in enumerate(self.planes):
            ones = plane.ones(ends)
            ends = plane.zeros + ones if code >> (self.width - 1 - k) & 1 else ends - ones
        return ends[1:], int(ends[0])

    def rank(self, code: int, i: np.ndarray) -> np.ndarray:
        """How often a code occurs among the first i places."""
        ends, begin = self._span(code, i)
        return ends - begin

    def select(self, code: int, k: int) -> int:
        """Place of the code that k equal ones precede."""
        at = self._span(code, np.zeros(1, np.int64))[1] + k
        for bit, plane in enumerate(reversed(self.planes)):
            at = plane.select(at - plane.zeros, 1) if code >> bit & 1 else plane.select(at, 0)
        return at


class Shard:
    """Documents' ids as one file: number of the shard, ids' numbers, one or two matrices, and the documents' ids and ends."""

    def __init__(self, number: int, symbols: np.ndarray, first: Matrix, rest: Matrix | None, doc_ids: list[int | None], ends: np.ndarray):
        self.number, self.symbols, self.first, self.rest, self.doc_ids, self.ends = number, symbols, first, rest, doc_ids, ends
        self.n = first.n
        self.shared = (1 << first.width) - 1  # the code that goes on in the second matrix
        self.codes = {int(s): k for k, s in enumerate(symbols.tolist())}

    @classmethod
    def of(cls, number: int, ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> Shard:
        counts = np.bincount(ids)
        symbols = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
        have, m = np.cumsum(counts[symbols]), len(symbols)
        if m > 1 << 16:
            raise ValueError("a shard holds at most 65,536 kinds of ids")
        sizes = {}  # bits in all, by the first codes' width
        for w in range(max(1, (m - 1).bit_length()) + 1):
            if 1 << w >= m:
                sizes[w] = w * len(ids)
            elif w:
                sizes[w] = w * len(ids) + (m - (1 << w)).bit_length() * int(have[-1] - have[(1 << w) - 2])
        width = min(sizes, key=lambda w: (sizes[w], w)) if sizes else 0
        code = np.zeros(len(counts), np.uint16)
        code[symbols] = np.arange(m)
        codes = code[ids]
        if 1 << width >= m:
            return cls(number, symbols, Matrix.of(codes, width), None, doc_ids, ends)
        shared = np.uint16((1 << width) - 1)
        rest = codes[codes >= shared] - shared
        return cls(number, symbols, Matrix.of(np.minimum(codes, shared), width), Matrix.of(rest, (m - (1 << width)).bit_length()), doc_ids, ends)

    def _split(self, code: int) -> tuple[int, int | None]:
        return (self.shared, code - self.shared) if self.rest is not None and code >= self.shared else (code, None)

    def decode(self) -> np.ndarray:
        codes = self.first.decode()
        if self.rest is not None:
            codes[codes == self.shared] += self.rest.decode()
        return self.symbols[codes]

    def access(self, i: np.ndarray) -> np.ndarray:
        """The ids at places i."""
        i = np.asarray(i, np.int64)
        codes = self.first.access(i)
        if self.rest is not None and (on := codes == self.shared).any():
            codes[on] += self.rest.access(self.first.rank(self.shared, i[on]))
        return self.symbols[codes]

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs at places from start up to end."""
        if token not in self.codes:
            return 0
        code, further = self._split(self.codes[token])
        spans = self.first.rank(code, np.array([start, self.n if end is None else end]))
        if further is not None:
            spans = self.rest.rank(further, spans)
        return int(spans[1] - spans[0])

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th occurrence of an id, from 0; -1 beyond the last."""
        if not 0 <= k < self.count(token):
            return -1
        code, further = self._split(self.codes[token])
        return self.first.select(code, k if further is None else self.rest.select(further, k))

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.access(np.arange(self.ends[k - 1] if k else 0, self.ends[k]))

    def to_bytes(self) -> bytes:
        known = [d is not None for d in self.doc_ids]
        side = zlib.compress(b"".join([self.symbols.tobytes(), np.diff(self.ends, prepend=0).astype("<i8").tobytes(), np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(), bytes(known)]), 1)
        matrices = [m for m in (self.first, self.rest) if m is not None]
        head = struct.pack("<4sqqIIIB", MAGIC, self.number, self.n, len(self.symbols), len(self.doc_ids), len(side), len(matrices))
        out = [head, side]
        for m in matrices:
            out.append(struct.pack("<qB", m.n, m.width))
            for p in m.planes:
                out += [p.before.tobytes(), p.packed.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        form = "<4sqqIIIB"
        magic, number, _, m, docs, length, kinds = struct.unpack_from(form, raw)
        if magic != MAGIC:
            raise ValueError("not a shard of ids")
        at = struct.calcsize(form)
        side = zlib.decompress(raw[at : at + length])
        at += length
        cuts = np.cumsum([0, 4 * m, 8 * docs, 8 * docs, docs])
        symbols, sizes, ids, known = (side[a:b] for a, b in pairwise(cuts.tolist()))
        doc_ids = [d if k else None for d, k in zip(np.frombuffer(ids, "<i8").tolist(), known, strict=True)]
        matrices: list[Matrix | None] = []
        for _ in range(kinds):
            n, width = struct.unpack_from("<qB", raw, at)
            at += struct.calcsize("<qB")
            blocks, planes = -(-max(n, 1) // _BLOCK), []
            for _ in range(width):
                before = np.frombuffer(raw, "<u4", blocks + 1, at)
                packed = np.frombuffer(raw, np.uint8, blocks * (_BLOCK // 8), at + before.nbytes)
                at += before.nbytes + packed.nbytes
                planes.append(Plane(packed, before, n))
            matrices.append(Matrix(planes, width, n))
        first, rest = (*matrices, None)[:2]
        return cls(number, np.frombuffer(symbols, "<u4"), first, rest, doc_ids, np.cumsum(np.frombuffer(sizes, "<i8")))
