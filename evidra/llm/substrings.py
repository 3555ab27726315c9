"""Substring duplicates by relative Lempel-Ziv parsing against all documents' reference blocks.

Words are runs of characters other than space and U+0009 to U+000D. Every document is indexed by blocks of BLOCK words
that its own content picks: of each window of WINDOW words, the block with the smallest hash. Equal windows pick equal
blocks, so passages that two documents share have their inner blocks, and the links from each block to the next, in
common. The index keeps, for each link, the place where the smallest id has it.

A document is parsed greedily: a factor (first word, end, reference document, place there) starts at a link whose
reference has a smaller id and grows link by link as long as the reference goes on at the same distance. Words are compared by
128-bit hashes of whole links. Factors so end at block borders; all windows of WINDOW words that hold a shared block and lie
within no single factor, so those across every factor's two ends, are looked up by 128-bit hash, with the smallest id and
place that has them. They extend factors of the same reference word by word to their true ends, or make factors of their own.
Factors of WINDOW words or more go.

Windows are judged on the input. Documents with equal words are one: all but the smallest id lose everything (if they
have WINDOW words), and only that one is indexed. Null and empty texts have no words and lose none, like all documents
of fewer than WINDOW words. Rows that repeat an id and its text have equal results; of rows that repeat an id with other texts,
each is parsed for itself, and neither is the other's reference. A row without an id is compared with nothing. An empty
table gives an empty result; extra columns don't matter."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import words
from evidra.llm.common import id_text, map_batches, session, written

WINDOW, BLOCK = 50, 12


def chosen_blocks(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a document's blocks, and for each window of WINDOW words where its chosen block starts."""
    blocks = words.mixed(words.rolling(h, BLOCK))
    reach = WINDOW - BLOCK + 1
    if len(blocks) < reach:
        return blocks, np.zeros(0, np.int64)
    at = np.empty(len(blocks) - reach + 1, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(blocks, reach)
    for i in range(0, len(at), 4096):
        at[i : i + 4096] = view[i : i + 4096].argmin(1)
    return blocks, at + np.arange(len(at))


def _digest(ws: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(ws)).hexdigest()


def _two(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word; runs hashed by both have 128 bits."""
    h = words.hashes(ws)
    return h, words.mixed(h + np.uint64(0x5851F42D4C957F2D))


def _runs(h: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """A 128-bit hash of each run of words, wherever it stands: from sums over the text, each word weighed by a power of its
    place, and the start's power divided out."""
    n = len(h[0])
    ones = np.ones(1, np.uint64)
    power = np.cumprod(np.concatenate((ones, np.full(n, words.FACTOR, np.uint64))), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate((ones, np.full(n, pow(words.FACTOR, -1, 1 << 64), np.uint64))), dtype=np.uint64)
    found = np.empty((len(starts), 2), np.uint64)
    for k, x in enumerate(h):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * power[:-1], dtype=np.uint64)))
        found[:, k] = words.mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    raw = found.tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _indexed(batch: pa.RecordBatch) -> pa.RecordBatch:
    out: list[list] = [[], [], [], [], [], []]
    for text in batch.column(1).to_pylist():
        ws = words.split(text)
        joined = b" ".join(ws)
        blocks, places, links = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        if len(ws) >= WINDOW:
            h = _two(ws)
            blocks, at = chosen_blocks(h[0])
            places = np.unique(at)
            links = _runs(h, places[:-1], places[1:] + BLOCK)
        for column, v in zip(out, (len(ws), xxhash.xxh3_128_digest(joined), hashlib.sha256(joined).digest(), blocks[places].view(np.int64), places.astype(np.int32), links), strict=True):
            column.append(v)
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "same", "kept", "blocks", "places", "links"])


def grown(links: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(first word, end, reference document, place there) of the factors of a document's links (the same four each), greedily:
    a factor takes the next link that its reference goes on with."""
    out: list[list[int]] = []
    open_: dict[tuple[int, int], int] = {}  # reference and distance: its last factor
    for start, end, doc, place in sorted(links):
        k = open_.get((doc, place - start))
        if k is not None and start <= out[k][1]:
            out[k][1] = max(out[k][1], end)
        else:
            open_[doc, place - start] = len(out)
            out.append([start, end, doc, place])
    return [tuple(f) for f in out]


def open_windows(n: int, at: np.ndarray, shared: np.ndarray, factors: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Starts of the windows whose picked block (at) is shared and that lie within no single factor."""
    todo = np.isin(at, shared)
    for start, end, _, _ in factors:
        todo[start : max(start, end - WINDOW + 1)] = False
    return np.flatnonzero(todo)


_FACTORS = "array<struct<start:int,end:int,doc:bigint,place:int>>"


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of rows (doc_id, text, same, places, links): the links' factors and the windows to look up; rows whose text is another
    one of the same id give nothing."""
    out: list[list] = [[], [], [], [], [], []]
    rows = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
    for doc, text, same, places, links in rows:
        ws = words.split(text)
        if xxhash.xxh3_128_digest(b" ".join(ws)) != same:
            continue
        h = _two(ws)
        factors = grown([(x["start"], x["end"], x["doc"], x["place"]) for x in links or []])
        starts = open_windows(len(ws), chosen_blocks(h[0])[1], np.array(places, np.int64), factors)
        pairs = [words.mixed(words.rolling(x, WINDOW)[starts]).view(np.int64) for x in h]
        for column, v in zip(out, (doc, same, [dict(zip(("start", "end", "doc", "place"), f, strict=True)) for f in factors], starts.astype(np.int32), *pairs), strict=True):
            column.append(v)
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("doc", pa.int64()), ("place", pa.int32())])), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "same", "factors", "starts", "w1", "w2"])


def factors(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every row's counts and hash of its words; the factors of documents that have some, by doc_id and same).

    Two looks at the index: links first, then only the windows that these leave open."""
    session(table.sparkSession)
    texts = id_text(table)
    indexed = written(map_batches(texts, _indexed, "doc_id long, n_words long, same binary, kept binary, blocks array<long>, places array<int>, links array<binary>"))
    first = written(indexed.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first"))
    # copies are few or many; only those whose words another document has need a look at which is the first
    every = written(indexed.select("doc_id", "n_words", "same", "kept").join(first, "same", "left").select("doc_id", "n_words", "same", "kept", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("copy")))
    alone = indexed.where("doc_id is not null and size(places) > 0").join(first, "same", "left").where("first is null or first = doc_id")
    runs = F.arrays_zip("blocks", "places", F.slice("places", 2, F.size("places")).alias("next"), "links")
    blocks = written(alone.select("doc_id", "same", F.explode(runs).alias("b")).select("doc_id", "same", F.col("b.blocks").alias("block"), F.col("b.places").alias("place"), (F.col("b.next") + BLOCK).cast("int").alias("end"), F.col("b.links").alias("link")))
    shared = written(blocks.groupBy("block").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("block"))
    inside = written(blocks.join(shared, "block", "left_semi"))
    least = written(inside.where("link is not null").groupBy("link").agg(F.min(F.struct("doc_id", "place")).alias("ref"), F.max("doc_id").alias("last")).where("ref.doc_id < last").select("link", "ref"))
    found = inside.join(least, "link").where("ref.doc_id < doc_id").groupBy("doc_id", "same").agg(F.collect_list(F.struct(F.col("place").alias("start"), "end", F.col("ref.doc_id").alias("doc"), F.col("ref.place").alias("place"))).alias("links"))
    places = inside.groupBy("doc_id", "same").agg(F.collect_list("place").alias("places")).join(found, ["doc_id", "same"], "left")
    looked = written(map_batches(texts.join(places, "doc_id").select("doc_id", "text", "same", "places", F.col("links").cast(_FACTORS).alias("links")), _windows, f"doc_id long, same binary, factors {_FACTORS}, starts array<int>, w1 array<long>, w2 array<long>"))
    windows = looked.select("doc_id", "same", F.explode(F.arrays_zip("w1", "w2", "starts")).alias("w")).select("doc_id", "same", "w.w1", "w.w2", F.col("w.starts").alias("start"))
    sources = written(windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("ref"), F.max("doc_id").alias("last")).where("ref.doc_id < last").select("w1", "w2", "ref"))
    hits = windows.join(sources, ["w1", "w2"]).where("ref.doc_id < doc_id").select("doc_id", "same", F.struct("start", (F.col("start") + WINDOW).cast("int").alias("end"), F.col("ref.doc_id").alias("doc"), F.col("ref.start").alias("place")).alias("f"))
    long_ones = looked.select("doc_id", "same", F.explode("factors").alias("f")).where(F.col("f.end") - F.col("f.start") >= WINDOW)
    return every, hits.unionByName(long_ones).groupBy("doc_id", "same").agg(F.collect_set("f").alias("found"))


def covered(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """(first word, end) of what factors cover."""
    out: list[list[int]] = []
    for start, end, *_ in sorted(found):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one space); with_text: and that text and the
    factors that went (first word, end, reference document, place there)."""
    every, parsed = factors(docs)
    texts = id_text(docs)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], []]
        for doc, text, same, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            ws = words.split(text)
            if xxhash.xxh3_128_digest(b" ".join(ws)) != same:  # another text of the same id
                continue
            gone = grown([(x["start"], x["end"], x["doc"], x["place"]) for x in found])
            kept, last = [], 0
            for a, b in covered(gone):
                kept += ws[last:a]
                last = b
            kept += ws[last:]
            for column, v in zip(out, (doc, same, len(ws) - len(kept), _digest(kept), b" ".join(kept).decode("utf-8", "surrogatepass") if with_text else None, [dict(zip(("start", "end", "doc", "place"), f, strict=True)) for f in gone] if with_text else None), strict=True):
                column.append(v)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("doc", pa.int64()), ("place", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "same", "n_removed", "kept_sha256", "kept_text", "factors"])

    shorter = written(map_batches(texts.join(parsed, "doc_id").select("doc_id", "text", "same", "found"), cut, f"doc_id long, same binary, n_removed long, kept_sha256 string, kept_text string, factors {_FACTORS}").dropDuplicates(["doc_id", "same"]))
    gone = F.col("copy") & (F.col("n_words") >= WINDOW)
    empty = hashlib.sha256(b"").hexdigest()
    return every.join(shorter, ["doc_id", "same"], "left").select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("kept")))).alias("kept_sha256"),
        *([F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"), "factors"] if with_text else []),
    )


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50),
windows AS (SELECT doc_id, s, md5(array_to_string(words[s : s + 49], ' ')) AS h FROM starts),
firsts AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS first FROM windows),
dups AS (SELECT doc_id, list(s) AS starts FROM firsts WHERE first < doc_id GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM firsts WHERE first < doc_id),
flat AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM flat ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
