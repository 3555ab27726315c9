"""Near duplicates by HyperMinHash.

Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased. A document's set holds the distinct
runs of `shingle` words; with fewer words the whole sequence is its one member; without words it is empty and linked
with nothing. Two documents are linked when their sets' Jaccard similarity is at least `percent` / 100, which is
confirmed on the full sets; groups are what links connect.

Registers: a shingle's hash picks one of REGISTERS buckets, which keeps the smallest of the hashes' remaining bits as its
number of leading zeros (6 bits) and the MANTISSA bits that follow. Registers that no shingle reaches borrow from others
in an order that is the same for all documents, so small sets fill all registers too. A band is ROWS registers side by
side, compressed to one hash; documents that share a band are compared. Two sets of similarity 0.8 whose registers are full
share none of the BANDS bands with a probability below 1e-6; those that borrow miss each other a little more often (1 of
24,000 made-up pairs of 5 and 4 shingles). Before sets are fetched, sizes must allow the similarity. Where both sets
have SMALL shingles or more, the share of equal registers, less what equal registers of different sets account for, must
not be below the similarity by more than MARGIN, either; smaller sets go straight to the exact check.

Documents with equal sets are one class from the start, however many they are. Each class is first compared with the
first one of each of its bands; the links found join classes to groups. Bands that still hold several groups are
then compared in blocks of bounded size: only classes of different groups whose sizes allow a link, without regard to
which is the smallest. So no band's pairs are written out, and no link that a band shows is lost.

Repeated rows have equal results; rows that repeat an id with another text are one document with all their links; a null doc_id is linked with nothing; an empty table gives an empty result; extra
columns don't matter. Texts of any length are read whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import words
from evidra.llm.common import id_text, map_batches, session, written
from evidra.llm.components import components

ROWS, BANDS, MANTISSA = 5, 40, 10
REGISTERS = ROWS * BANDS
#: Estimates below the wanted similarity by more than this aren't confirmed: five standard deviations at 0.8.
MARGIN = 0.15
#: Pairs with a set of fewer shingles are confirmed whatever their estimate, as borrowed registers move it far.
SMALL = 256
#: Classes of one part of a tier, and their shingles.
BLOCK, SHINGLES = 256, 2_000_000
_TRIES = 64
_BORROW = np.random.default_rng(7).integers(0, REGISTERS, (_TRIES, REGISTERS))  # whose register an empty one looks at
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str, n: int) -> np.ndarray:
    """The sorted hashes of a text's set."""
    ws = words.split(text, fold=True)
    if not ws:
        return np.zeros(0, np.uint64)
    h = words.hashes(ws)
    return np.unique(words.mixed(words.rolling(h, min(n, len(h))) + np.uint64(min(n, len(h)))))


def registers(s: np.ndarray) -> np.ndarray:
    """The registers of a set that isn't empty, as 16-bit numbers: leading zeros, then mantissa."""
    bucket = ((s >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    low = words.mixed(s)
    least = np.full(REGISTERS, _EMPTY)
    if len(s) > 4 * REGISTERS:  # buckets are stretches of a sorted set
        starts = np.searchsorted(bucket, np.arange(REGISTERS))
        full = np.flatnonzero(np.diff(np.append(starts, len(s))))
        least[full] = np.minimum.reduceat(low, starts[full])
    else:
        np.minimum.at(least, bucket, low)
    empty = least == _EMPTY
    if empty.any():
        own = least.copy()
        for step in _BORROW:
            there = empty & (own[step] != _EMPTY)
            least[there] = own[step][there]
            empty &= ~there
            if not empty.any():
                break
        else:  # next in the circle
            full = np.flatnonzero(own != _EMPTY)
            at = np.flatnonzero(empty)
            least[at] = own[full[np.searchsorted(full, at) % len(full)]]
    zeros = np.zeros(REGISTERS, np.int64)
    x = least.copy()
    for k in (32, 16, 8, 4, 2, 1):
        short = x < (np.uint64(1) << np.uint64(64 - k))
        zeros += k * short
        x = np.where(short, x << np.uint64(k), x)
    mantissa = (x << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((np.minimum(zeros, 63) << MANTISSA) | mantissa.astype(np.int64)).astype("<u2")


#: Registers of different elements are equal this often: the same leading zeros (1/3) and the same mantissa.
_CHANCE = 1 / (3 << MANTISSA)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of register rows, corrected for registers that are equal by chance."""
    same = (a == b).mean(axis=-1)
    return (same - _CHANCE) / (1 - _CHANCE)


def _signed(batch: pa.RecordBatch, n: int) -> pa.RecordBatch:
    size, same, regs = [], [], []
    for text in batch.column(1).to_pylist():
        s = shingles(text, n)
        size.append(len(s)), same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None), regs.append(registers(s).tobytes() if len(s) else None)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(same, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "same", "registers"])


def _band_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = batch.num_rows
    if not n:
        keys = np.zeros(0, np.int64)
    else:
        regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(n, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS))
        for r in range(ROWS):
            key = words.mixed(key * np.uint64(0x100000001B3) + regs[:, :, r])
        keys = key.reshape(-1).view(np.int64)
    rep = lambda i: pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), BANDS))
    return pa.RecordBatch.from_arrays([pa.array(keys), rep(0), rep(1)], names=["band", "id", "size"])


def _pair_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            keep.append(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
        chosen = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], names=["a", "b"])


def _similar(common, m, n, percent: int):
    return 100 * common >= percent * (m + n - common)


def _likely(regs_a: np.ndarray, regs_b: np.ndarray, smaller: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs are to be confirmed: one of the sets is small, or the estimate allows it."""
    return (smaller < SMALL) | (estimates(regs_a, regs_b) >= percent / 100 - MARGIN)


def _block_candidates(regs: np.ndarray, size: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of left, each with those of right that sizes, groups and estimates allow."""
    for i in left.tolist():
        js = right[(group[right] != group[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))]
        if len(js):
            js = js[_likely(regs[js], regs[i], np.minimum(size[js], size[i]), percent)]
            if len(js):
                yield i, js


class _Common:
    """Numbers of common members of a block's sets; those of small sets are counted for many sets at once."""

    def __init__(self, members: list[np.ndarray], percent: int):
        self.members = members
        self.size = np.array([len(x) for x in members])
        self.low = self.size * percent < 100 * SMALL  # all that a small set can be linked with
        few = [x if low else x[:0] for x, low in zip(members, self.low, strict=True)]
        kinds, codes = np.unique(np.concatenate(few), return_inverse=True)
        self.codes = np.split(codes, np.cumsum([len(x) for x in few])[:-1])
        self.mark = np.zeros(len(kinds), np.int64)

    def count(self, i: int, js: np.ndarray) -> np.ndarray:
        if not (self.low[i] and self.low[js].all()):
            return np.array([len(np.intersect1d(self.members[i], self.members[j], assume_unique=True)) for j in js.tolist()], np.int64)
        self.mark[self.codes[i]] = 1
        found = np.add.reduceat(self.mark[np.concatenate([self.codes[j] for j in js.tolist()])], np.cumsum(self.size[js]) - self.size[js])
        self.mark[self.codes[i]] = 0
        return found


def groups(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach) and kept (its own) of each row of docs."""
    session(docs.sparkSession)
    texts = id_text(docs)
    signed = written(map_batches(texts, lambda b: _signed(b, shingle), "doc_id long, n_shingles long, same binary, registers binary"))
    some = signed.where("same is not null and doc_id is not null")
    # classes are numbered in the order of their documents, so that a band's first class is its first document's
    numbers = some.groupBy("same").agg(F.min("doc_id").alias("doc")).repartitionByRange("doc", "same").sortWithinPartitions("doc", "same")
    numbers = written(numbers.withColumn("id", F.monotonically_increasing_id()))
    classes = some.groupBy("same").agg(F.first("n_shingles").alias("size"), F.first("registers").alias("registers"))
    classes = written(classes.join(numbers, "same"))
    links = written(_links(texts, classes, shingle, percent).union(_shared_ids(some, classes)))
    found = written(classes.select("id", "same", "doc").join(components(links).select(F.col("node").alias("id"), "component"), "id"))
    least = found.groupBy("component").agg(F.min("doc").alias("label"))
    known = found.join(least, "component").select("same", "label")
    labels = written(classes.select("same", "doc").join(known, "same", "left").select("same", F.coalesce("label", "doc").alias("label")))
    out = signed.select("doc_id", "n_shingles", "same").join(labels, "same", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def _shared_ids(some: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) classes that are one document's: those of the rows that repeat an id with another set."""
    repeated = some.groupBy("doc_id").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo <> hi").select("doc_id")
    held = some.join(repeated, "doc_id").select("doc_id", "same").distinct().join(classes.select("same", "id"), "same")
    return held.join(held.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b")


def _links(texts: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b) classes that are linked: enough of them to connect all that links connect."""
    bands = written(map_batches(classes.select("id", "size", "registers"), _band_rows, "band long, id long, size long"))
    first = written(bands.groupBy("band").agg(F.min(F.struct("id", "size")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", F.col("first.id").alias("first"), F.col("first.size").alias("first_size")))
    members = written(bands.join(first, "band"))
    allowed = F.least("size", "first_size") * 100 >= F.greatest("size", "first_size") * percent
    stars = members.where("id <> first").where(allowed).select("id", "first", F.least("size", "first_size").alias("smaller")).distinct()
    regs = classes.select("id", "registers")
    pairs = stars.join(regs, "id").join(regs.select(F.col("id").alias("first"), F.col("registers").alias("registers_b")), "first").select("id", "first", "registers", "registers_b", "smaller")

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(n, REGISTERS) for i in (2, 3))
        keep = pa.array(_likely(a, b, batch.column(4).to_numpy(), percent)) if n else pa.array([], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["id", "first"])

    likely = written(map_batches(pairs, near, "id long, first long"))
    wanted = members.select("id").distinct()
    wanted = wanted.join(classes.select("id", "same", F.col("doc").alias("doc_id")), "id")
    sets = written(map_batches(texts.join(wanted, "doc_id").select("id", "same", "text"), lambda b: _sets(b, shingle), "id long, members binary").dropDuplicates(["id"]))
    both = likely.join(sets.select("id", F.col("members").alias("x")), "id").join(sets.select(F.col("id").alias("first"), F.col("members").alias("y")), "first").select("id", "first", "x", "y")
    links = written(both.mapInArrow(lambda it: _pair_links(it, percent), "a long, b long"))

    grouped = components(links).select(F.col("node").alias("id"), F.col("component").alias("grp"))
    known = written(members.join(grouped, "id", "left").select("band", "id", "size", "first", F.coalesce("grp", "id").alias("grp")))
    mixed = known.groupBy("band").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("band")
    # bands whose smallest ids are of one group are looked through together, so that a class comes once for all of them
    firsts = known.where("id = first").select("band", F.col("grp").alias("family")).join(mixed, "band")
    family = written(known.join(firsts, "band").select("family", "id", "size", "grp").distinct())
    step = float(-np.log(percent / 100) + 1e-9) if percent < 100 else 1.0
    family = family.withColumn("tier", F.floor(F.log(F.col("size").cast("double")) / F.lit(step)).cast("long"))  # linked sizes differ by one tier at most
    # a tier's large groups have parts of their own, the small ones share parts; parts hold about BLOCK classes and SHINGLES shingles
    load = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / SHINGLES)).cast("long")
    spans = family.groupBy("family", "tier", "grp").agg(load.alias("own"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("m"))
    large = written(spans.where("own > 1"))
    rest = F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("m") / SHINGLES)).cast("long")
    small = written(spans.where("own = 1").groupBy("family", "tier").agg(rest.alias("shared")))
    placed = family.join(large.select("family", "tier", "grp", "own"), ["family", "tier", "grp"], "left").join(small, ["family", "tier"], "left")
    placed = placed.withColumn("of", F.when(F.col("own").isNotNull(), F.col("grp")).otherwise(-1)).withColumn("part", F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("id"), "own")).otherwise(F.pmod(F.xxhash64("grp"), "shared")))
    where = ["family", "tier", "of", "part"]
    placed = written(placed.select(*where, "id", "size", "grp"))
    parts = written(placed.groupBy(*where).agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).withColumn("x", F.monotonically_increasing_id()))
    # part pairs of one tier or of neighbouring ones, but those of one and the same group, before any registers move
    other = parts.select("family", F.col("x").alias("y"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"), "tier")
    same_tier = parts.join(other, ["family", "tier"]).where("x <= y")
    next_tier = parts.join(other.withColumn("tier", F.col("tier") - 1), ["family", "tier"])
    pairs = written(same_tier.unionByName(next_tier).where("least(lo, lo_y) <> greatest(hi, hi_y)").select("x", "y"))
    in_part = placed.join(parts.select(*where, "x"), where).select(F.col("x").alias("at"), "id", "size", "grp")
    left = in_part.join(pairs, in_part.at == pairs.x).select("x", "y", F.lit(0).alias("side"), "id", "size", "grp")
    right = in_part.join(pairs.where("x <> y"), in_part.at == F.col("y")).select("x", "y", F.lit(1).alias("side"), "id", "size", "grp")
    met = left.unionByName(right).join(regs, "id")
    key = ["x", "y"]

    def likely_in_block(pdf):
        left, right = _sides(pdf)
        regs_ = np.frombuffer(b"".join(pdf["registers"]), "<u2").reshape(len(pdf), REGISTERS)
        used = np.zeros(len(pdf), bool)
        for i, js in _block_candidates(regs_, pdf["size"].to_numpy(), pdf["grp"].to_numpy(), left, right, percent):
            used[i] = used[js] = True
        return pdf.iloc[np.flatnonzero(used)][[*key, "side", "id", "size", "grp", "registers"]]

    kinds = "x long, y long, side int, id long, size long, grp long, registers binary"
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # blocks cost time, not bytes: as many tasks as the cluster is set to
    # ranges hold like numbers of rows, so that no task gets several large blocks while others have none
    some = written(written(met).repartitionByRange(n, *key).groupBy(*key).applyInPandas(likely_in_block, kinds))

    def confirmed_in_block(pdf):
        left, right = _sides(pdf)
        regs_ = np.frombuffer(b"".join(pdf["registers"]), "<u2").reshape(len(pdf), REGISTERS)
        size, ids, group = pdf["size"].to_numpy(), pdf["id"].to_numpy(), pdf["grp"].to_numpy().copy()
        common = _Common([np.frombuffer(x, "<u8") for x in pdf["members"]], percent)
        out = []
        for i, js in _block_candidates(regs_, size, group, left, right, percent):
            for j in js[_similar(common.count(i, js), size[i], size[js], percent)].tolist():
                if group[i] != group[j]:
                    out.append((ids[i], ids[j]))
                    group[group == group[j]] = group[i]  # one link between two groups is enough
        import pandas as pd

        return pd.DataFrame({"a": [a for a, _ in out], "b": [b for _, b in out]}, dtype="int64")

    more = some.join(sets, "id").repartitionByRange(n, *key).groupBy(*key).applyInPandas(confirmed_in_block, "a long, b long")
    return links.union(more)


def _sides(pdf) -> tuple[np.ndarray, np.ndarray]:
    """Places of a block's two sides: two parts, or one part with itself."""
    at = np.arange(len(pdf))
    if pdf["x"].iloc[0] == pdf["y"].iloc[0]:
        return at, at
    left = (pdf["side"] == 0).to_numpy()
    return at[left], at[~left]


def _sets(batch: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """Sets of rows (id, same, text); rows whose set is another one of the same document give nothing."""
    ids, members = [], []
    for i, same, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        raw = shingles(text, n).tobytes()
        if xxhash.xxh3_128_digest(raw) == same:
            ids.append(i), members.append(raw)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(members, pa.binary())], names=["id", "members"])


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i : i + 3], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * c >= 80 * (m.n + n.n - c)),
reach(node, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
label AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, l.component_id, l.component_id = w.doc_id AS kept
FROM w LEFT JOIN sizes z ON z.doc_id = w.doc_id JOIN label l ON l.node = w.doc_id
"""
