"""A hash tree over a dataset, by language, with persistent versions of it.

A leaf is the hash of a row's doc_id, source, lang, n_chars and text. Per language, leaves ascend by doc_id (null first;
leaves of one doc_id by their digests), and every two consecutive nodes become one until one is left, the subroot; subroots,
ordered by language, give the root in the same way. Trees are cut into aligned blocks of 2^BLOCK leaves, each one bounded
group, and the blocks' roots are the leaves of further blocks. A changed leaf makes a version: in its block the ancestors
are copied and all other nodes are shared; above it, the version goes on through the blocks of blocks.

Repeated rows are leaves of their own, side by side; a null doc_id is never tampered with, and null n_chars stay; an
empty table gives an empty result; extra columns don't matter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from evidra.llm.common import session, spread, written

#: Levels of a block.
BLOCK = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every how many documents, by the checksum of their id, one is tampered with.
EVERY = 7


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Tree:
    """A hash tree whose versions share nodes: a node is a digest and its children's numbers, and is never changed.

    At least `height` levels are built; a node without a neighbour becomes the hash of itself."""

    def __init__(self, leaves: list[str], height: int = 0):
        self.digests, self.children = list(leaves), [()] * len(leaves)
        level, self.height = list(range(len(leaves))), 0
        while len(level) > 1 or self.height < height:
            level = [self._node(level[i : i + 2]) for i in range(0, len(level), 2)]
            self.height += 1
        self.root = level[0]

    def _node(self, children: list[int]) -> int:
        self.digests.append(digest(*[self.digests[c] for c in children]))
        self.children.append(tuple(children))
        return len(self.digests) - 1

    def path(self, place: int, root: int | None = None) -> list[int]:
        """Nodes from a version's root (the first version's, if none is given) to the leaf at place."""
        out = [self.root if root is None else root]
        for level in range(self.height - 1, -1, -1):
            out.append(self.children[out[-1]][place >> level & 1])
        return out

    def siblings(self, place: int, root: int | None = None) -> list[str]:
        """Digests beside the path, from the leaf up."""
        steps = pairwise(self.path(place, root))
        return [self.digests[other] for above, node in steps for other in self.children[above] if other != node][::-1]

    def changed(self, place: int, leaf: str, root: int | None = None) -> list[int]:
        """A version with another leaf at place: the new leaf and the copied ancestors, the new root last."""
        steps = list(pairwise(self.path(place, root)))
        self.digests.append(leaf)
        self.children.append(())
        out = [len(self.digests) - 1]
        for above, node in reversed(steps):
            out.append(self._node([out[-1] if c == node else c for c in self.children[above]]))
        return out


def ancestors(leaf: str, place: int, n: int, siblings: Iterator[str]) -> list[str]:
    """Digests above a leaf in a tree of n leaves, from the siblings beside its path."""
    out = []
    while n > 1:
        if place ^ 1 >= n:
            leaf = digest(leaf)
        elif place & 1:
            leaf = digest(next(siblings), leaf)
        else:
            leaf = digest(leaf, next(siblings))
        out.append(leaf)
        place, n = place >> 1, (n + 1) >> 1
    return out


def leaf(values: list[Column]) -> Column:
    """Hash of values in turn: "-" for null, else their length in bytes, a colon and themselves."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with place, from 0 in the given order of its tree, and n, the tree's rows: one sort over all cores, then the
    rows before each part are added up."""
    ordered = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    ordered = written(ordered.withColumn("__row", F.monotonically_increasing_id()))
    parts = ordered.groupBy(F.col(tree).alias("__tree"), F.shiftright("__row", 33).alias("__part")).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__tree").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("*", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy("__tree")).alias("n"))
    met = ordered.join(parts, ordered[tree].eqNullSafe(parts["__tree"]) & (F.shiftright("__row", 33) == F.col("__part")))
    return met.select(*rows.columns, (F.col("__row") - F.col("__first") + F.col("__before")).alias("place"), "n")


def in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes(tree, place, n, digest, changed, …) with what their blocks say: siblings in the block, block_root, and the copied
    digests of the version with `changed` at its place (null: no version)."""
    words = pa.list_(pa.string())
    schema = StructType(nodes.schema.fields + [StructField("siblings", ArrayType(StringType())), StructField("copied", ArrayType(StringType())), StructField("block_root", StringType())])

    def build(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        tree = Tree(block["digest"].to_pylist(), levels if block["n"][0].as_py() > 1 << levels else 0)
        inside = [p & (1 << levels) - 1 for p in block["place"].to_pylist()]
        siblings = [tree.siblings(p) for p in inside]
        copied = [None if c is None else [tree.digests[k] for k in tree.changed(p, c)] for p, c in zip(inside, block["changed"].to_pylist(), strict=True)]
        block = block.append_column("siblings", pa.array(siblings, words)).append_column("copied", pa.array(copied, words))
        return block.append_column("block_root", pa.array([tree.digests[tree.root]] * len(inside)))

    return nodes.withColumn("__block", F.shiftright("place", levels)).groupBy("tree", "__block").applyInArrow(lambda key, block: build(block.drop_columns(["__block"])), schema)


def paths(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes(tree, place, n, digest, changed, …) with all siblings up to their tree's root, from the leaf up, the copied
    digests of their version as far as their own block goes, and the root."""
    low = written(in_blocks(nodes, levels))
    most = low.agg(F.max("n")).first()[0] or 0  # one number
    if most <= 1 << levels:
        return low.withColumnRenamed("block_root", "root")
    heads = low.where(F.col("place").bitwiseAND((1 << levels) - 1) == 0)
    above = heads.select("tree", F.shiftright("place", levels).alias("place"), F.ceil(F.col("n") / (1 << levels)).cast("long").alias("n"), F.col("block_root").alias("digest"), F.lit(None).cast("string").alias("changed"))
    up = paths(above, levels).select(F.col("tree").alias("__tree"), F.col("place").alias("__block"), F.col("siblings").alias("__above"), "root")
    met = low.join(up, low.tree.eqNullSafe(up["__tree"]) & (F.shiftright("place", levels) == F.col("__block")))
    return met.select(*nodes.columns, F.concat("siblings", "__above").alias("siblings"), "copied", "root")


def manifest(docs: DataFrame, changed: Column | None = None, levels: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, lang, leaf, its place and the number of leaves in its language, the language's place and
    the number of languages, siblings (from the leaf up to the root), subroot, root, and of the version that `changed`
    makes (the digest to put in the leaf's place; null: none) copied: the new leaf and all copied ancestors, the new root last."""
    session(docs.sparkSession)
    rows = docs.select(F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf([F.col(c) for c in FIELDS]).alias("digest"), (F.lit(None) if changed is None else changed).cast("string").alias("changed"))
    leaves = written(paths(placed(spread(rows), "tree", ["doc_id", "digest"]), levels))
    roots = leaves.where("place = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("changed"))
    tops = paths(placed(roots, "tree", ["lang"]), levels).select(F.col("lang").alias("__lang"), F.col("place").alias("lang_place"), F.col("n").alias("langs"), F.col("siblings").alias("__above"), F.col("root").alias("whole"))
    met = leaves.join(tops, leaves.tree.eqNullSafe(tops["__lang"]))
    met = met.select("doc_id", F.col("tree").alias("lang"), F.col("digest").alias("leaf"), "place", "n", "lang_place", "langs", F.concat("siblings", "__above").alias("siblings"), "copied", F.col("root").alias("subroot"), F.col("whole").alias("root"))

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(["place", "n", "lang_place", "langs", "siblings", "copied"]).to_pylist():
                made = r["copied"]
                if made is not None:
                    done = len(made) - 1  # levels of its own block
                    inside = sum(r["place"] >> k ^ 1 < -(-r["n"] >> k) for k in range(done))
                    rest = iter(r["siblings"][inside:])
                    made = made + ancestors(made[-1], r["place"] >> done, -(-r["n"] >> done), rest)
                    made = made + ancestors(made[-1], r["lang_place"], r["langs"], rest)
                out.append(made)
            at = batch.schema.get_field_index("copied")
            yield batch.set_column(at, "copied", pa.array(out, pa.list_(pa.string())))

    return met.mapInArrow(go_on, met.schema)


def tampered() -> Column:
    """The leaf's digest with n_chars raised by one, where EVERY divides the checksum of the id; else null."""
    values = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % EVERY == 0, leaf(values))


def verify(docs: DataFrame, changed: Column, levels: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (hash of the siblings), folded_root (the root of the version that `changed`
    makes; without one recomputed from the leaf and its siblings) and verified (whether it is the root)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, folded = [], []
            for r in batch.select(["leaf", "place", "n", "lang_place", "langs", "siblings", "copied"]).to_pylist():
                proofs.append(digest(*r["siblings"]))
                if r["copied"] is not None:
                    folded.append(r["copied"][-1])
                    continue
                rest = iter(r["siblings"])
                top = [r["leaf"], *ancestors(r["leaf"], r["place"], r["n"], rest)][-1]
                folded.append([top, *ancestors(top, r["lang_place"], r["langs"], rest)][-1])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "leaf", "subroot", "root")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(proofs, pa.string()), pa.array(folded, pa.string())], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    out = manifest(docs, changed, levels).mapInArrow(fold, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = r"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail AS plain, head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail AS raised,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
      lambda a, ch: list_reduce(list_prepend(xor(a, ch), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS crc
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents)),
placed AS (
  SELECT doc_id, lang, sha256(plain) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256(raised) ELSE sha256(plain) END AS used,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(plain)) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
tree(lang, lvl, idx, n, digest) AS (
  SELECT lang, 0, idx, n, leaf FROM placed
  UNION ALL
  SELECT lang, lvl + 1, idx // 2, (n + 1) // 2, sha256(digest || coalesce(beside, ''))
  FROM (SELECT *, lead(digest) OVER (PARTITION BY lang ORDER BY idx) AS beside FROM tree WHERE n > 1) WHERE idx % 2 = 0),
subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot, count(*) OVER () AS langs FROM tree WHERE n = 1),
top(lvl, idx, n, digest) AS (
  SELECT 0, spot, langs, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(digest || coalesce(beside, ''))
  FROM (SELECT *, lead(digest) OVER (ORDER BY idx) AS beside FROM top WHERE n > 1) WHERE idx % 2 = 0),
walk(doc_id, leaf, lang, lvl, idx, n, siblings, folded) AS (
  SELECT doc_id, leaf, lang, 0, idx, n, '', used FROM placed
  UNION ALL
  SELECT w.doc_id, w.leaf, w.lang, w.lvl + 1, w.idx // 2, (w.n + 1) // 2, w.siblings || coalesce(t.digest, ''),
    sha256(CASE WHEN w.idx % 2 = 1 THEN t.digest || w.folded ELSE w.folded || coalesce(t.digest, '') END)
  FROM walk w LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM w.lang AND t.lvl = w.lvl AND t.idx = xor(w.idx, 1::BIGINT) WHERE w.n > 1),
climb(doc_id, leaf, subroot, lvl, idx, n, siblings, folded) AS (
  SELECT w.doc_id, w.leaf, s.subroot, 0, s.spot, s.langs, w.siblings, w.folded FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.lvl + 1, w.idx // 2, (w.n + 1) // 2, w.siblings || coalesce(t.digest, ''),
    sha256(CASE WHEN w.idx % 2 = 1 THEN t.digest || w.folded ELSE w.folded || coalesce(t.digest, '') END)
  FROM climb w LEFT JOIN top t ON t.lvl = w.lvl AND t.idx = xor(w.idx, 1::BIGINT) WHERE w.n > 1)
SELECT c.doc_id, c.leaf, c.subroot, t.digest AS root, sha256(c.siblings) AS proof_sha256, c.folded AS folded_root, c.folded = t.digest AS verified
FROM climb c CROSS JOIN (SELECT digest FROM top WHERE n = 1) t WHERE c.n = 1
"""
