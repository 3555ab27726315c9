"""Term counts of texts, a row a document, and from these the best documents of many questions, in Arrow batches: postings are
never rows of their own, and neither they nor their pairs with questions are shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.stem import stem

#: Pairs of a posting and a question that are added up at once, about; 24 bytes each.
PAIRS = 1 << 21
#: Bytes of one Arrow batch.
BATCH_BYTES = 8 << 20


def _bounded(df: DataFrame) -> DataFrame:
    """df, of a session whose Arrow batches have a bounded size, however long the rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


@lru_cache(1 << 18)
def _stem(word: str) -> str:
    return stem(word)


@dataclass
class Field:
    """tokens: a field's tokens, of which those of least to most bytes count; terms: what is kept of them, or of their stems."""

    tokens: Column
    terms: pa.Array
    least: int = 0
    most: int = 1 << 30
    stems: bool = False


def counted(docs: DataFrame, by: list[str], fields: list[Field], kinds: str | None = None) -> DataFrame:
    """(*by, parts, n, totals): of each value of by how many rows it has, their lengths' sums by field, and a part a row: the codes
    of those terms that it holds, their counts, and their fields' lengths. A term's code is its place in all fields' terms, one
    field after the other. Given kinds, a column, also its different values."""
    known = docs.sparkSession.sparkContext.broadcast([(f.terms, f.least, f.most, f.stems) for f in fields])
    size = max(1, sum(len(f.terms) for f in fields))
    kept = [*by, *([kinds] if kinds else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, at, sizes, found = b.num_rows, 0, [], []
            tokens = [b.column(f"tokens{i}").flatten() for i in range(len(known.value))]
            words = pa.chunked_array([t for t, f in zip(tokens, known.value, strict=True) if f[3]], pa.string()).combine_chunks().dictionary_encode()
            stemmed, indices, done = pa.array(map(_stem, words.dictionary.to_pylist()), pa.string()), words.indices.to_numpy(), 0  # each word once for all fields
            for i, (flat, (terms, least, most, stems)) in enumerate(zip(tokens, known.value, strict=True)):
                row = np.repeat(np.arange(n), pc.list_value_length(b.column(f"tokens{i}")).to_numpy())
                long = pc.binary_length(flat).to_numpy()
                counts = (long >= least) & (long <= most)
                sizes.append(np.bincount(row[counts], minlength=n))
                if stems:
                    code = pc.fill_null(pc.index_in(stemmed, value_set=terms), -1).to_numpy()[indices[done : done + len(flat)]]
                    done += len(flat)
                else:
                    code = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy()
                held = counts & (code >= 0)
                found.append(row[held] * size + at + code[held])
                at += len(terms)
            code, tf = np.unique(np.concatenate(found), return_counts=True)
            field = np.searchsorted(np.cumsum([len(f[0]) for f in known.value]), code % size, "right")
            length = np.stack(sizes)[field, code // size]
            offsets = pa.array(np.searchsorted(code, np.arange(n + 1) * size), pa.int32())
            packed = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (code % size, tf, length)]
            sizes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(sizes), pa.int32()), pa.array(np.stack(sizes, 1).ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *packed, sizes], names=[*kept, "codes", "tfs", "lengths", "sizes"])

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", codes array<int>, tfs array<int>, lengths array<int>, sizes array<int>"
    rows = _bounded(docs).select(*kept, *[F.coalesce(f.tokens, F.array().cast("array<string>")).alias(f"tokens{i}") for i, f in enumerate(fields)]).mapInArrow(run, schema)
    totals = F.array(*[F.sum(F.col("sizes")[i]) for i in range(len(fields))])
    return rows.groupBy(*by).agg(F.collect_list(F.struct("codes", "tfs", "lengths")).alias("parts"), F.count(F.lit(1)).alias("n"), totals.alias("totals"), *([F.collect_set(kinds).alias("kinds")] if kinds else []))


def frequencies(packed: DataFrame, by: list[str]) -> DataFrame:
    """(code, df): how many postings each term has; rows of one key and length are one."""
    once = packed.where("n = 1").select(F.explode("parts").alias("p")).select(F.explode("p.codes").alias("code"))
    more = packed.where("n > 1").select(*by, F.explode("parts").alias("p")).select(*by, F.explode(F.arrays_zip("p.codes", "p.lengths")).alias("x")).distinct()
    return once.unionByName(more.select("x.codes").toDF("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))


def postings(packed: DataFrame, by: list[str]) -> DataFrame:
    """(*by, length, code, tf): a row a posting."""
    part = packed.select(*by, F.explode("parts").alias("p")).select(*by, F.explode(F.arrays_zip("p.codes", "p.tfs", "p.lengths")).alias("x"))
    return part.groupBy(*by, F.col("x.lengths").alias("length"), F.col("x.codes").alias("code")).agg(F.sum("x.tfs").alias("tf"))


class _Asked:
    """Who asks for what, by the codes of a document's kind and a term together."""

    def __init__(self, code: np.ndarray, who: np.ndarray, times: np.ndarray):
        order = np.argsort(code, kind="stable")
        self.who, self.times = who[order], times[order]
        self.codes, self.start, self.count = np.unique(code[order], return_index=True, return_counts=True)

    def found(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where those who ask for each code begin, and how many they are."""
        if not len(self.codes):
            return np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return self.start[at], np.where(self.codes[at] == code, self.count[at], 0)

    def pairs(self, start: np.ndarray, count: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each posting as often as it is asked for, with who asks and what it counts there."""
        at = np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)
        of = np.repeat(np.arange(len(count)), count)
        return of, self.who[at], w[of] * self.times[at]


def _summed(code: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, all under size, in order, and the sums of their weights, which are over 0."""
    if size <= 4 * len(code):
        sums = np.bincount(code, w, minlength=size)
        hit = np.flatnonzero(sums)
        return hit, sums[hit]
    hit, at = np.unique(code, return_inverse=True)
    return hit, np.bincount(at, w, minlength=len(hit))


def _parts(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """unit, code, tf and length of each posting of a batch, by unit; a unit's rows of equal length are one."""
    of = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("parts")).to_numpy())
    lists = b.column("parts").flatten().flatten()
    unit = np.repeat(of, pc.list_value_length(lists[0]).to_numpy())
    code, tf, length = (x.flatten().to_numpy().astype(np.int64) for x in lists)
    if len(of) > b.num_rows and len(unit):
        order = np.lexsort((code, length, unit))
        unit, length, code, tf = unit[order], length[order], code[order], tf[order]
        new = np.r_[True, (np.diff(unit) != 0) | (np.diff(length) != 0) | (np.diff(code) != 0)]
        tf = np.add.reduceat(tf, np.flatnonzero(new))
        unit, length, code = unit[new], length[new], code[new]
    return unit, code, tf, length


def quantised(length: np.ndarray) -> np.ndarray:
    """As search.quantised."""
    step = np.exp2(np.floor(np.log2(np.maximum(length, 40) / 16 - 1.5)))
    start = 24 + 16 * step
    return np.where(length < 40, length, start + (length - start) // (2 * step) * 2 * step)


def best(packed: DataFrame, key: str, within: str | None, asked: pa.Table, kind: str, weights: np.ndarray, means: np.ndarray, k1: float, b: float, k: int, steps: bool = False, more: dict | None = None) -> DataFrame:
    """(as, key, score, alone) with, for each question, at least its k best documents by rounded score and key.

    asked(as, base, own, within, code, times): the terms of bases (own is false), and the own terms of questions, with their bases
    or null; without times, each counts once. Of a base each task tells the k best of some documents after the other, as long as they may still be among the k
    best of all. Documents that hold an own term of a question are told with alone, the question and their whole score, unless
    its base has k better ones already. weights, means: what each term counts and its field's mean length, by code; kind: the type of `as`; steps: whether lengths are
    quantised; more: what a base's scores have besides, by `as`."""
    own, ids = asked["own"].to_numpy(), asked["code"].to_numpy().astype(np.int64)
    column = lambda c: asked[c].combine_chunks()
    values = column(within).unique() if within else pa.array([0])
    size = len(weights)
    code = (pc.index_in(column(within), value_set=values).to_numpy(zero_copy_only=False).astype(np.int64) if within else 0) * size + ids
    names = [column("as").filter(pa.array(x)).unique() for x in (~own, own)]
    who = [pc.index_in(column("as").filter(pa.array(x)), value_set=n).to_numpy(zero_copy_only=False).astype(np.int64) for x, n in zip((~own, own), names, strict=True)]
    base_of = np.full(len(names[1]), -1)
    base_of[who[1]] = pc.fill_null(pc.index_in(column("base").filter(pa.array(own)), value_set=names[0]), -1).to_numpy(zero_copy_only=False)
    times = asked["times"].to_numpy() if "times" in asked.column_names else np.ones(len(own))
    extra = np.array([(more or {}).get(x, 0.0) for x in names[0].to_pylist()] or [0.0])
    shared = packed.sparkSession.sparkContext.broadcast((_Asked(code[~own], who[0], times[~own]), _Asked(code[own], who[1], times[own]), names, base_of, values, weights, means, extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, owns, names, base_of, values, weights, means, extra = shared.value
        n_bases, n_owns = max(1, len(names[0])), max(1, len(names[1]))
        floor = np.full(n_bases, -np.inf)  # a base has k documents with this score or a better one
        for batch in batches:
            unit, ids, tf, length = _parts(batch)
            if not len(unit):
                continue
            kinds = pc.fill_null(pc.index_in(batch.column(within), value_set=values), -1).to_numpy().astype(np.int64)[unit] if within else np.zeros(len(unit), np.int64)
            w = weights[ids] * tf / (tf + k1 * (1 - b + b * (quantised(length) if steps else length) / means[ids]))
            code = np.where(kinds < 0, -1, kinds * size + ids)
            (s0, c0), (s1, c1) = bases.found(code), owns.found(code)
            nth = np.empty(batch.num_rows, np.int64)
            nth[pc.sort_indices(batch.column(key), null_placement="at_start").to_numpy()] = np.arange(batch.num_rows)
            pairs = np.cumsum(np.bincount(unit, c0 + c1, minlength=batch.num_rows))
            out, lo = [], 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(pairs, (pairs[lo - 1] if lo else 0) + PAIRS, "right")))
                here = slice(*np.searchsorted(unit, (lo, hi)))
                at, base, each = bases.pairs(s0[here], c0[here], w[here])
                hit, sums = _summed((unit[here][at] - lo) * n_bases + base, each, (hi - lo) * n_bases)
                doc, base = hit // n_bases, hit % n_bases
                score = np.floor((sums + extra[base]) * 1000 + 0.5) / 1000
                may = score >= floor[base]
                doc, base, score = doc[may] + lo, base[may], score[may]
                order = np.lexsort((nth[doc], -score, base))
                doc, base, score = doc[order], base[order], score[order]
                rank = np.arange(len(base)) - np.searchsorted(base, base)
                last = rank == k - 1
                floor[base[last]] = np.maximum(floor[base[last]], score[last])
                out.append((names[0].take(pa.array(base[rank < k])), doc[rank < k], score[rank < k], False))
                at, q, each = owns.pairs(s1[here], c1[here], w[here])
                code, alone = _summed((unit[here][at] - lo) * n_owns + q, each, (hi - lo) * n_owns)
                doc, q = code // n_owns, code % n_owns
                base = base_of[q]
                if len(hit):
                    place = np.minimum(np.searchsorted(hit, doc * n_bases + base), len(hit) - 1)
                    alone = alone + np.where((base >= 0) & (hit[place] == doc * n_bases + base), sums[place], 0.0)
                score = np.floor(alone * 1000 + 0.5) / 1000
                may = (base < 0) | (score >= floor[base])
                out.append((names[1].take(pa.array(q[may])), doc[may] + lo, score[may], True))
                lo = hi
            doc = pa.array(np.concatenate([x[1] for x in out]))
            columns = [pa.concat_arrays([x[0] for x in out]), batch.column(key).take(doc), pa.array(np.concatenate([x[2] for x in out])), pa.array(np.repeat([x[3] for x in out], [len(x[1]) for x in out]))]
            yield pa.RecordBatch.from_arrays(columns, names=["as", key, "score", "alone"])

    return _bounded(packed).mapInArrow(run, f"`as` {kind}, `{key}` {dict(packed.dtypes)[key]}, score double, alone boolean")
