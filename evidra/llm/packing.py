"""Best-fit packing: documents become token sequences of at most one length, by patterns of few documents.

A document's ids are those of a byte-level BPE vocabulary, then one end id; null text is empty text. Documents longer than
a sequence, and no others, are cut into full pieces, what is left over coming first. The pieces' lengths are counted (at
most one row a length), patterns of one to four lengths that occur (short ones in runs of equal pieces) are fitted to the
counts by non-negative least squares, rounded and fitted again to what is left, and what no nearly full pattern takes is put
into open space or packed best fit, longest first. Pieces of one length are then numbered and dealt to the places that the
patterns have for it.

Repeated rows are documents like any other; an empty table gives an empty result; extra columns don't matter; a null
doc_id stays null. A length that holds most pieces is numbered in about the square root of as many parts."""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.llm.common import id_text, session, written

LENGTH, END = 1024, 2
VOCABULARY = "byte_bpe_50k"
#: Patterns of few lengths that one fit takes, at most; greedy ones, which make up any counts, come on top.
PATTERNS = 40_000
#: Share of the tokens that is left to best fit.
REST = 0.01
#: Share of a sequence that a fitted pattern may leave open, and the part of it up to which a piece is short.
SLACK, SHORT = 0.01, 8
#: Kinds of short pieces that are tried to fill one open space.
FILLERS = 2
#: Runs that begin patterns which are made at a time.
LEADS = 128
_SPECIAL = {"<|endoftext|>": 50256}
#: Up to U+027F all versions of Unicode agree on what is a letter; other texts go to the reference tokenizer.
_PLAIN = bytes([*range(0xCA), *range(0xF8, 0x100)])


class Encoder:
    """Ids of texts: tiktoken with the same vocabulary where it is proven equal, the reference tokenizer elsewhere."""

    def __init__(self, vocabulary: str):
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(f"{vocabulary}.tiktoken"), "rb"))}
        self.fast = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=_SPECIAL)
        self.full = cache(lambda: Tokenizer.from_file(P.path(f"{vocabulary}.json")))

    def __call__(self, text: str) -> np.ndarray:
        if text.encode("utf-8", "surrogatepass").translate(None, _PLAIN):
            return np.asarray(self.full().encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all" if "<|" in text else set(), disallowed_special=()).astype("<u4", copy=False)


@cache
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (of the little-endian 32-bit ids) of each piece; with_ids: and ids."""
    session(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encode(text).tobytes() + tail
                n = len(raw) // 4
                a, k = 0, 0
                while a < n:
                    b = min(n, a + ((n - 1) % length + 1 if k == 0 else length))
                    part = raw[4 * a : 4 * b]
                    for column, v in zip(out, (doc, k, a, b - a, zlib.crc32(part)), strict=False):
                        column.append(v)
                    if with_ids:
                        out[5].append(np.frombuffer(part, "<i4"))
                    a, k = b, k + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return id_text(docs).mapInArrow(cut, schema)


def runs(counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, times), by ascending total: what patterns are made of. Each length that occurs, once; and short ones as often
    as fit in a half, a third and a fourth of a sequence, as far as there are so many."""
    have = np.flatnonzero(counts)
    short = have[have <= length // SHORT]
    piece, times = [have], [np.ones(len(have), np.int64)]
    for share in (2, 3, 4):
        piece.append(short), times.append(np.minimum(length // share // np.maximum(short, 1), counts[short]))
    piece, times = np.concatenate(piece), np.concatenate(times)
    piece, times = np.unique(np.stack([piece, times], 1)[times > 0], axis=0).T if len(piece) else (piece, times)
    order = np.lexsort((piece, piece * times))
    return piece[order], times[order]


def fillers(counts: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every open space the short pieces that, repeated, leave least of it: a few (piece, times) by space."""
    short = np.flatnonzero(counts[: length // SHORT + 1])
    if not len(short):
        return []
    space = np.arange(length + 1)[:, None]
    times = space // short
    rest = np.where((times > 0) & (times <= counts[short]), space - times * short, length)
    order = np.argsort(rest, axis=1, kind="stable")[:, : min(FILLERS, len(short))]
    return [(np.where(rest[space[:, 0], o] < length, short[o], 0), np.where(rest[space[:, 0], o] < length, times[space[:, 0], o], 0)) for o in order.T]


def few_document_patterns(counts: np.ndarray, length: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, times), four columns each (0: none): patterns of one to four runs, longest first, that leave at most slack of a
    sequence and that the counts have the pieces for: all pairs, each with the longest third that fits, with the longest
    two that fit in turn, and with two that share what is left. Short lengths begin a pattern as runs only."""
    piece, times = runs(counts, length)
    total = piece * times
    upto = np.searchsorted(total, np.arange(length + 1), side="right") - 1  # the longest run, up to each length; -1: none
    lead = np.flatnonzero(total > length // SHORT) if (total > length // SHORT).any() else np.arange(len(total))
    sizes, of, by = (np.append(x, 0).astype(np.int32) for x in (total, piece, times))  # of the run -1, too
    below = lambda space, run: np.minimum(upto[np.maximum(space, 0)], run)
    found: list[np.ndarray] = []

    def keep(space: np.ndarray, *columns: tuple[np.ndarray, np.ndarray]) -> None:
        """Of the patterns of these (pieces, times) columns, those that leave at most slack."""
        close = np.flatnonzero(space <= slack)
        some = [c[close] for pair in columns for c in pair]
        found.append(np.stack(some[0::2] + [0 * close] * (4 - len(columns)) + some[1::2] + [0 * close] * (4 - len(columns)), 1).astype(np.int32))

    run = lambda r: (of[r], by[r])
    alone = np.arange(len(total))
    keep(length - sizes[alone], run(alone))
    fill = fillers(counts, length)  # short pieces as often as fit into what one or two leave
    for v, k in fill:
        keep(length - sizes[alone] - (v * k)[length - sizes[alone]], run(alone), (v[length - sizes[alone]], k[length - sizes[alone]]))
    steps = range(0, len(lead), LEADS)
    for first in steps:  # so many leads at a time, which bounds what is held
        a, b = (x.ravel() for x in np.meshgrid(lead[first : first + LEADS], lead[: first + LEADS], indexing="ij"))
        fits = (b <= a) & (total[a] + total[b] <= length)
        a, b = a[fits], b[fits]
        left = length - sizes[a] - sizes[b]
        kept = len(found)
        keep(left, run(a), run(b))
        for share in (1, 2, 3):
            c = below(left // share, b)
            d = np.where(c < 0, -1, below(left - sizes[c], c))
            keep(left - sizes[c] - sizes[d], run(a), run(b), run(c), run(d))
            if share == 1:
                keep(left - sizes[c], run(a), run(b), run(c))
        for v, k in fill:
            keep(left - (v * k)[left], run(a), run(b), (v[left], k[left]))
        mine = np.unique(np.concatenate(found[kept:]), axis=0)
        found[kept:] = [mine[:: max(1, len(mine) * len(steps) // (4 * PATTERNS))]]
    both = np.unique(np.concatenate(found), axis=0)
    pieces, many = both[:, :4].astype(np.int64), both[:, 4:].astype(np.int64)
    ok = np.ones(len(pieces), bool)
    for k in range(4):
        ok &= counts[pieces[:, k]] >= (many * (pieces == pieces[:, k : k + 1])).sum(1) * (pieces[:, k] > 0)
    pieces, many = pieces[ok], many[ok]
    waste = length - (pieces * many).sum(1)
    order = np.lexsort((waste, -pieces[:, 1], -pieces[:, 0]))
    order = order[:: max(1, -(-len(order) // PATTERNS))]  # evenly over all lengths
    return pieces[order], many[order]


def fitted(counts: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray], waste: np.ndarray, cost: float = 2.0, steps: int = 600) -> tuple[np.ndarray, float]:
    """Repeats of each pattern, not negative, with the least sum of squared differences from the counts, plus a cost
    of what patterns leave empty; and the sum of the differences. rows: (pattern, piece, times), waste: the empty share of each.

    Projected gradient steps with momentum, until the differences are small or no longer fall. Sums are written out:
    threads of a linear algebra library would take more time to wait than to add."""
    pattern, piece, times = rows
    wanted, n = counts.astype(float), len(waste)
    scale = 1 / np.sqrt(np.bincount(pattern, times * times, n))  # a pattern of many pieces is steep: its step is shorter
    times = times * scale[pattern]
    cost = cost * wanted.sum() / max(np.count_nonzero(wanted), 1) * waste * scale

    def pieces_of(x: np.ndarray) -> np.ndarray:
        return np.bincount(piece, x[pattern] * times, len(wanted))

    def patterns_of(off: np.ndarray) -> np.ndarray:
        return np.bincount(pattern, off[piece] * times, n)

    v = np.ones(n)
    for _ in range(8):  # the steepest direction bounds the step
        v = patterns_of(pieces_of(v))
        steep = np.sqrt((v * v).sum())
        v /= steep
    steep *= 1.05
    x = np.zeros(n)
    y, momentum, before = x, 1.0, np.inf
    for step in range(1, steps + 1):
        z = np.maximum(0, y - (patterns_of(pieces_of(y) - wanted) + cost) / steep)
        if ((y - z) * (z - x)).sum() > 0:
            momentum = 1.0
        faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y, x, momentum = z + (momentum - 1) / faster * (z - x), z, faster
        if step % 50 == 0:
            off = float(np.abs(wanted - pieces_of(x)).sum())
            if off <= 0.002 * wanted.sum() or off > 0.995 * before:
                break
            before = off
    return scale * x, float(np.abs(wanted - pieces_of(x)).sum())


def best_fit(counts: list[int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): the longest piece that is left, then ever the longest that still fits; a pattern is repeated
    as long as its pieces last. counts is used up."""
    out = []
    top = length
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return out
        pattern, space, at, taken = [top], length - top, top, {top: 1}
        while space:
            at = min(at, space)
            while at and counts[at] <= taken.get(at, 0):
                at -= 1
            if not at:
                break
            n = min(space // at, counts[at] - taken.get(at, 0))
            pattern += [at] * n
            taken[at] = taken.get(at, 0) + n
            space -= n * at
        repeats = min(counts[v] // n for v, n in taken.items())
        for v, n in taken.items():
            counts[v] -= n * repeats
        out.append((tuple(pattern), repeats))


def filled(plan: list[tuple[tuple[int, ...], int]], left: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan with pieces that are left put into its open space, longest first, each where the least stays open; left
    loses them."""
    room: list[list] = [[] for _ in range(length + 1)]
    for pattern, n in plan:
        room[length - sum(pattern)].append((pattern, n))
    for v in np.flatnonzero(left)[::-1].tolist():
        for space in range(v, length + 1):
            while left[v] and room[space]:
                pattern, n = room[space].pop()
                k = min(n, int(left[v]))
                if k < n:
                    room[space].append((pattern, n - k))
                room[space - v].append(((*pattern, v), k))
                left[v] -= k
    return [x for some in room for x in some]


def planned(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the counts of lengths.

    Patterns of few lengths that leave at most SLACK open, and those of a greedy pass, which can make up any counts, are
    fitted together. Repeats are rounded down; where that places few pieces, fractions are added up in the patterns' order
    and give one more whenever they reach a whole. What is left is fitted again, until REST of the tokens remain or a round
    places next to none; pieces that remain go to open space, and else are packed best fit."""
    left = np.zeros(length + 1, np.int64)
    for v, n in counts.items():
        left[v] = n
    out = [((length,), int(left[length]))] if left[length] else []
    left[length] = 0
    tokens = np.arange(length + 1)
    total = int((left * tokens).sum())
    while (left * tokens).sum() > REST * total + length:
        few, many = few_document_patterns(left, length, int(length * SLACK))
        at, column = np.nonzero(few)
        rows = [np.stack([at, few[at, column], many[at, column]])]
        greedy = [sorted(Counter(p).items()) for p, _ in best_fit(left.tolist(), length)]
        rows.append(np.array([(len(few) + i, v, k) for i, p in enumerate(greedy) for v, k in p]).T)
        pattern, piece, times = np.concatenate(rows, 1)
        n = len(few) + len(greedy)
        repeats, _ = fitted(left, (pattern, piece, times), 1 - np.bincount(pattern, piece * times, n) / length)
        whole = np.floor(repeats + 1e-6).astype(np.int64)
        sizes = np.bincount(pattern, times, n)
        if (whole * sizes).sum() < 0.2 * left.sum():
            whole += np.diff(np.floor(np.cumsum(repeats - whole) + 0.5), prepend=0).astype(np.int64)
        before, some = int((left * tokens).sum()), np.flatnonzero(whole)
        begins = np.searchsorted(pattern, np.arange(n + 1))
        for i in some[np.argsort(-repeats[some], kind="stable")].tolist():
            need = Counter()
            for v, k in zip(piece[begins[i] : begins[i + 1]].tolist(), times[begins[i] : begins[i + 1]].tolist(), strict=True):
                need[v] += k
            k = min(int(whole[i]), *(int(left[v]) // k for v, k in need.items()))
            if k > 0:
                for v, m in need.items():
                    left[v] -= m * k
                out.append((tuple(need.elements()), k))
        if before - (left * tokens).sum() < 0.05 * before:
            break
    out = filled(out, left, length)
    return out + best_fit(left.tolist(), length)


def places(plan: list[tuple[tuple[int, ...], int]], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Pieces of one length, numbered from 0, fill the places for it in turn. For each run of places, sorted: its key
    (length and first number), first sequence and offset."""
    key, sequence, offset = [], [], []
    filled = [0] * (length + 1)
    start = 0
    for pattern, n in plan:
        at = 0
        for v in pattern:
            key.append((v << 44) + filled[v]), sequence.append(start), offset.append(at)
            filled[v] += n
            at += v
        start += n
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (key, sequence, offset))


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """The pieces of docs, each with its sequence_id and its offset in the sequence."""
    cut = written(pieces(docs, length, end, vocabulary, with_ids))
    counted = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `length` rows at most
    key, sequence, offset = places(planned(counted, length), length)
    sizes = F.broadcast(docs.sparkSession.createDataFrame(list(counted.items()), "length long, n long"))  # as many
    line = F.xxhash64("doc_id", "piece", "ids_crc32")
    part = F.pmod(line, F.ceil(F.sqrt("n")).cast("long"))
    split = cut.select("doc_id", "piece", "start", "length", "ids_crc32").join(sizes, "length").withColumn("part", part).drop("n")
    counts = split.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = W.partitionBy("length", "part").orderBy(line, "doc_id", "piece", "ids_crc32")
    numbered = split.withColumn("number", F.row_number().over(order) - 1).join(counts, ["length", "part"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = (batch.column(3).to_numpy(zero_copy_only=False) << 44) + batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, k, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + k - key[at]), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    if not with_ids:
        return placed
    names = ("doc_id", "piece", "ids_crc32")
    ids = cut.select(*[F.col(c).alias(f"of_{c}") for c in names], "ids").dropDuplicates([f"of_{c}" for c in names])
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return placed.join(ids, same).drop(*[f"of_{c}" for c in names])
