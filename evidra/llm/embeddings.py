"""Embedding near duplicates by an epsilon grid order join.

Vectors are compared when their labels are equal and not null, by cosine in double precision; a null, empty or zero
vector, one with a null or non-finite component, and one without an id, link with nothing; neither do vectors of
different lengths. As unit vectors, linked ones lie within EPSILON of each other. Principal directions, fitted on a
bounded sample, give each vector leading coordinates, which never make a distance larger; EPSILON-wide cells on these, the first
one counting most, put all vectors in order. The order is cut into intervals of bounded size, and pairs of intervals whose boxes
on the leading coordinates lie further apart than EPSILON are dropped before any vector moves. Within a task both
sequences are halved again and again by the same rule; what remains is compared in full.

Equal vectors of a label are one class from the start, however many they are. Links aren't written out: a task returns
each class's number of links and as many links as connect what it found linked. Repeated rows count as rows; an empty
table gives an empty result; extra columns don't matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import map_batches, sample_ids, session, written
from evidra.llm.components import components

COSINE = 0.93
#: Vectors that the principal directions are fitted on, at most.
SAMPLE = 4096
#: Leading coordinates: of the grid and of the boxes.
BOX = 8
#: Classes and bytes of one interval of the order that goes to a task, and classes of the shortest one.
PART, PART_BYTES, LEAF = 2048, 8 << 20, 128


def _parsed(batch: pa.RecordBatch, wide: bool) -> pa.RecordBatch:
    kind = "<f8" if wide else "<f4"
    column = batch.column(2)
    ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    keys, vectors = [], []
    for i, (vec_id, label) in enumerate(zip(ids, labels, strict=True)):
        v = column[i]
        x = np.asarray(v.values.to_numpy(zero_copy_only=False), kind) if v.is_valid and vec_id is not None and label is not None else np.zeros(0, kind)
        wide_x = x.astype(float)
        if len(x) and np.isfinite(wide_x).all() and wide_x.any():
            raw = (x + np.zeros(1, kind)).tobytes()  # -0.0 becomes 0.0
            keys.append(xxhash.xxh3_128_digest(f"{label}:{len(x)}:".encode() + raw)), vectors.append(raw)
        else:
            keys.append(None), vectors.append(None)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "same", "vector"])


def units(raw: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their lengths in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    scale = np.abs(x).max(1, keepdims=True)
    return x / scale, np.sqrt(((x / scale) ** 2).sum(1))  # scaled, so that squares neither overflow nor vanish


def directions(sample: list[bytes], kind: str) -> np.ndarray:
    """The leading principal directions of the sample's commonest length (as columns)."""
    if not sample:
        return np.eye(BOX)
    lengths = [len(r) for r in sample]
    most = max(sorted(set(lengths)), key=lengths.count)
    x, n = units([r for r in sample if len(r) == most], kind)
    u = x / n[:, None]
    _, v = np.linalg.eigh(np.cov(u.T, bias=True).reshape(u.shape[1], u.shape[1]))
    return v[:, ::-1][:, :BOX]


def leading(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """BOX coordinates of unit vectors: along the axes, or for another number of components along the first of these."""
    q = u @ axes if u.shape[1] == axes.shape[0] else u[:, :BOX]
    return np.pad(q, ((0, 0), (0, BOX - q.shape[1])))


class _Join:
    """The links between two sequences of vectors, by halving."""

    def __init__(self, ids, sizes, x, norm, q, least: float, epsilon: float):
        self.ids, self.sizes, self.x, self.norm, self.q, self.least, self.epsilon = ids, sizes, x, norm, q, least, epsilon
        self.links = np.zeros(len(ids), np.int64)
        self.root = list(range(len(ids)))
        self.edges: list[tuple[int, int]] = []

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def run(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """a, b: places of the two sequences; same: they are one, and each pair counts once."""
        todo = [(a, b, same)]
        while todo:
            a, b, same = todo.pop()
            if not len(a) or not len(b):
                continue
            if not same:
                gap = np.maximum(0, np.maximum(self.q[a].min(0) - self.q[b].max(0), self.q[b].min(0) - self.q[a].max(0)))
                if (gap**2).sum() > self.epsilon**2:
                    continue
            if max(len(a), len(b)) <= LEAF:
                self._compare(a, b, same)
            elif same:
                lo, hi = a[: len(a) // 2], a[len(a) // 2 :]
                todo += [(lo, lo, True), (lo, hi, False), (hi, hi, True)]
            elif len(a) >= len(b):
                todo += [(a[: len(a) // 2], b, False), (a[len(a) // 2 :], b, False)]
            else:
                todo += [(a, b[: len(b) // 2], False), (a, b[len(b) // 2 :], False)]

    def _compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        hit = (self.x[a] @ self.x[b].T) / (self.norm[a][:, None] * self.norm[b]) >= self.least
        if same:
            hit = np.triu(hit, 1)
        if not hit.any():
            return
        self.links[a] += hit @ self.sizes[b]
        self.links[b] += self.sizes[a] @ hit
        for i, j in zip(*(k.tolist() for k in np.nonzero(hit)), strict=True):
            r, s = self._find(int(a[i])), self._find(int(b[j]))
            if r != s:
                self.root[max(r, s)] = min(r, s)
                self.edges.append((int(a[i]), int(b[j])))


def groups(table: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of table(vec_id, embedding, label)."""
    session(table.sparkSession)
    wide = "double" in dict(table.dtypes)["embedding"]
    kind = "<f8" if wide else "<f4"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding"))
    parsed = written(map_batches(rows, lambda b: _parsed(b, wide), "vec_id long, label string, same binary, vector binary"))
    classes = written(parsed.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    chosen = sample_ids(classes, SAMPLE, "id")
    axes = directions([bytes(r.vector) for r in classes.join(F.broadcast(chosen), "id").select("vector").orderBy("id").collect()], kind)  # at most SAMPLE rows
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6

    axis = [f"q{k}" for k in range(BOX)]

    def located(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(3).to_pylist()
        q = np.zeros((len(raw), BOX))
        for n in {len(r) for r in raw}:
            at = [i for i, r in enumerate(raw) if len(r) == n]
            x, norm = units([raw[i] for i in at], kind)
            q[at] = leading(x / norm[:, None], axes)
        space = pa.array([f"{len(r)}:{x}" for r, x in zip(raw, batch.column(2).to_pylist(), strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), space, batch.column(3), *(pa.array(q[:, k]) for k in range(BOX))], names=["id", "size", "space", "vector", *axis])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order; an interval ends where it is full or another space begins."""
        number, rows, size, last = TaskContext.get().partitionId() << 32, 0, 0, None
        for b in batches:
            parts = []
            for space, v in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                n = len(v.as_buffer())
                if space != last or rows >= PART or size + n > PART_BYTES:
                    number, rows, size, last = number + 1, 0, 0, space
                rows, size = rows + 1, size + n
                parts.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.int64())], names=[*b.schema.names, "part"])

    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # blocks cost time, not bytes: as many tasks as the cluster is set to
    columns = "id long, size long, space string, vector binary, " + ", ".join(f"{c} double" for c in axis)
    placed = written(map_batches(classes.select("id", "size", "label", "vector"), located, columns))
    order = ["space", *[F.floor(F.col(c) / epsilon) for c in axis], *axis, "id"]
    parted = written(placed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(cut, columns + ", part long"))
    boxes = written(parted.groupBy("space", "part").agg(*[f(c).alias(f"{e}{k}") for k, c in enumerate(axis) for e, f in (("lo", F.min), ("hi", F.max))]))
    # two intervals meet in the first cell of the leading coordinate that one has and the other reaches
    cell = lambda c: F.floor(c / epsilon)
    ends = [f"{e}{k}" for k in range(BOX) for e in ("lo", "hi")]
    one = boxes.select("space", F.col("part").alias("x"), *[F.col(c).alias(f"x_{c}") for c in ends], cell(F.col("lo0")).alias("first_x"), F.explode(F.sequence(cell(F.col("lo0")), cell(F.col("hi0")))).alias("cell"))
    two = boxes.select("space", F.col("part").alias("y"), *[F.col(c).alias(f"y_{c}") for c in ends], cell(F.col("lo0") - epsilon).alias("first_y"), F.explode(F.sequence(cell(F.col("lo0") - epsilon), cell(F.col("hi0") + epsilon))).alias("cell"))
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"x_lo{k}") - F.col(f"y_hi{k}"), F.col(f"y_lo{k}") - F.col(f"x_hi{k}"))
    apart = sum((gap(k) * gap(k) for k in range(1, BOX)), gap(0) * gap(0))
    near = one.join(two, ["space", "cell"]).where((F.col("cell") == F.greatest("first_x", "first_y")) & (F.col("x") <= F.col("y")) & (apart <= epsilon * epsilon))
    pairs = written(near.select("x", "y"))
    vectors = parted.select(F.col("part").alias("at"), "id", "size", "vector")
    left = vectors.join(pairs, vectors.at == pairs.x).select("x", "y", F.lit(False).alias("right"), "id", "size", "vector")
    right = vectors.join(pairs.where("x <> y"), vectors.at == F.col("y")).select("x", "y", F.lit(True).alias("right"), "id", "size", "vector")
    key = ["x", "y"]

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        x, norm = units([bytes(v) for v in pdf["vector"]], kind)
        q = leading(x / norm[:, None], axes)
        order = np.lexsort((*q.T[::-1], *np.floor(q.T[::-1] / epsilon)))  # cells first, then places
        right = pdf["right"].to_numpy(bool)
        join = _Join(pdf["id"].to_numpy(), pdf["size"].to_numpy(np.int64), x, norm, q, least, epsilon)
        same = pdf["x"].iloc[0] == pdf["y"].iloc[0]
        join.run(order if same else order[~right[order]], order if same else order[right[order]], same)
        ids = join.ids
        n = np.flatnonzero(join.links)
        return pd.DataFrame({"a": np.concatenate([ids[n], ids[[i for i, _ in join.edges]]]).astype("int64"), "b": np.concatenate([ids[n], ids[[j for _, j in join.edges]]]).astype("int64"), "links": np.concatenate([join.links[n], np.zeros(len(join.edges), np.int64)])})

    found = written(left.unionByName(right).repartition(n, *key).groupBy(*key).applyInPandas(joined, "a long, b long, links long"))
    counts = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    label = components(found.where("a <> b").select("a", "b")).select(F.col("node").alias("id"), "component")
    known = written(classes.select("same", "id", "size").join(counts, "id", "left").join(label, "id", "left").select("same", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    out = parsed.select("vec_id", "same").join(known, "same", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
label AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.component_id, l.component_id = e.vec_id AS kept
FROM embeddings e JOIN label l ON l.node = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""
