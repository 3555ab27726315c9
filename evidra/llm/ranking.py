"""Ranked lexical search: documents' terms as K2-treaps, a block of documents each, and the best documents of every item.

Terms are the maximal runs of characters other than ASCII ones that are neither letters nor digits; only A-Z are lower-cased, null
text has none. The score of a document is the sum, over an item's terms, of the term's weight (from how many documents hold
it) and the term's impact there (from how often it occurs and how long the document is), in 64-bit integers. A block's grid has
a row a term, frequent terms first, and a column a document; it is written once, for any number of searches.

Equal scores are ranked by ascending doc_id, null last; repeated rows are documents of their own; rows that repeat an item_id
are one item; empty tables give an empty result; very long texts make a block of their own; extra columns don't matter.
Items go to the executors in parts of about ASKED terms, each against all blocks. A task keeps the best of each item over
its blocks, which bounds what further blocks open."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.llm.common import id_text, session, written
from evidra.llm.treap import Treap

#: Documents of a block, and about as many terms with repeats.
DOCUMENTS, WORDS = 4096, 1 << 20
#: Terms of a part of the items, but for its last item.
ASKED = 200_000
BEST = 50
#: Bytes as they count in terms: A-Z lower-cased, what separates terms a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class _Numbers(defaultdict):
    """term -> number, in the order of first asking."""

    def __missing__(self, term: bytes) -> int:
        got = self[term] = len(self)
        return got


def index(docs: DataFrame, figures: tuple[int, int] | None = None) -> tuple[DataFrame, tuple[int, int]]:
    """(blocks, figures): a row a block with its documents' ids, their m, its terms (most frequent first), how many of
    its documents hold each, and the treap; figures are the number of documents with terms and the number of terms."""
    spark = session(docs.sparkSession)
    rows = id_text(docs)
    if figures is None:
        got = rows.select("text").mapInArrow(_count_terms, "held long, total long").agg(F.sum("held"), F.sum("total")).first()
        figures = int(got[0] or 0), int(got[1] or 0)
    held, total = figures

    def block(ids: list[int | None], words: list[np.ndarray], numbers: _Numbers) -> pa.RecordBatch:
        lengths = [len(w) for w in words]
        order = np.argsort([float("inf") if d is None else d for d in ids], kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        key, tf = np.unique(np.concatenate(words).astype(np.int64) << 13 | np.repeat(place, lengths), return_counts=True)
        number, column = key >> 13, key & (1 << 13) - 1
        df = np.bincount(number, minlength=len(numbers))
        frequent = np.argsort(-df, kind="stable")
        row = np.empty(len(numbers), np.int64)
        row[frequent] = np.arange(len(numbers))
        m = np.array([50 + 50 * lengths[i] * held // total if total else 50 for i in order], np.int64)
        names = list(numbers)
        return pa.RecordBatch.from_pylist([{
            "doc_ids": [ids[i] for i in order], "m": m.tolist(), "terms": zstandard.ZstdCompressor(level=1).compress(b"\n".join(names[i] for i in frequent.tolist())),
            "df": df[frequent].astype("<u4").tobytes(), "treap": Treap.build(row[number], column, tf, impact(tf, m[column])),
        }], pa.schema([("doc_ids", pa.list_(pa.int64())), ("m", pa.list_(pa.int64())), ("terms", pa.binary()), ("df", pa.binary()), ("treap", pa.binary())]))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, numbers, n = [], [], _Numbers(), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = terms(text.as_py())
                if not got:
                    continue
                ids.append(doc), words.append(np.fromiter(map(numbers.__getitem__, got), np.uint32, len(got)))
                n += len(got)
                if len(ids) == DOCUMENTS or n >= WORDS:
                    yield block(ids, words, numbers)
                    ids, words, numbers, n = [], [], _Numbers(), 0
        if ids:
            yield block(ids, words, numbers)

    return written(rows.mapInArrow(build, "doc_ids array<long>, m array<long>, terms binary, df binary, treap binary")), figures


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(terms(text.as_py())) for text in batch.column(0)]
        yield pa.RecordBatch.from_pydict({"held": [sum(x > 0 for x in n)], "total": [sum(n)]})


def _names(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split(b"\n")


def frequencies(blocks: DataFrame, asked: frozenset[bytes]) -> DataFrame:
    """(term, df): how many documents hold each of the asked terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, df in zip(batch.column(0), batch.column(1), strict=True):
                df = np.frombuffer(df.as_py(), "<u4")
                met = [(t, int(df[i])) for i, t in enumerate(_names(names.as_py())) if t in asked]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in met], pa.binary()), pa.array([n for _, n in met], pa.int64())], names=["term", "n"])

    return blocks.select("terms", "df").mapInArrow(counted, "term binary, n long").groupBy("term").agg(F.sum("n").alias("df"))


class _Best:
    """The k best (score, doc_id) that have been offered; of equal scores those with the smallest ids, null last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def offer(self, doc: int | None, score: int) -> None:
        entry = (score, doc is not None, -(doc or 0))
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.k else 1


def search(blocks: DataFrame, figures: tuple[int, int], items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of each of items(item_id, text)."""
    spark = session(blocks.sparkSession)
    held = figures[0]
    asked = written(id_text(items.select(F.col("item_id").alias("doc_id"), "text")).mapInArrow(_item_terms, "item_id long, term binary, n long").groupBy("item_id", "term").agg(F.lit(1).alias("one")))
    parts = -(-asked.count() // ASKED)
    out = None
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        distinct = frozenset(bytes(r[0]) for r in mine.select("term").distinct().collect())  # about ASKED
        weight = F.floor(1000 * F.log((2.0 * held + 2) / (2 * F.col("df") + 1))).cast("long")
        weighed = mine.join(frequencies(blocks, distinct), "term").groupBy("item_id").agg(F.collect_list(F.struct("term", weight.alias("w"))).alias("terms")).collect()
        questions = [(r["item_id"], {bytes(t["term"]): t["w"] for t in r["terms"] if t["w"] > 0}) for r in weighed]

        def ranked(batches: Iterator[pa.RecordBatch], questions=questions) -> Iterator[pa.RecordBatch]:
            kept = [_Best(best) for _ in questions]
            wanted = frozenset().union(*[q.keys() for _, q in questions])
            for batch in batches:
                for r in batch.to_pylist():
                    rows = {t: i for i, t in enumerate(_names(r["terms"])) if t in wanted}
                    m, ids = np.array(r["m"], np.int64), r["doc_ids"]
                    treap = Treap.open(r["treap"], lambda tf, column, m=m: impact(tf, m[column]))
                    met = [[(rows[t], w) for t, w in q.items() if t in rows] for _, q in questions]
                    pairs = [(np.array([a for a, _ in x], np.int64), np.array([w for _, w in x], np.int64)) for x in met]
                    treap.best(pairs, [lambda column, score, k=k, ids=ids: k.offer(ids[column], score) for k in kept], [k.least for k in kept])
            rows = [(q, None if not known else -doc, score) for (q, _), k in zip(questions, kept, strict=True) for score, known, doc in k.heap]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(3)], names=["item_id", "doc_id", "score"])

        found = blocks.mapInArrow(ranked, "item_id long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for t in set(terms(text.as_py()))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.binary()), pa.array([1] * len(rows), pa.int64())], names=["item_id", "term", "n"])


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
figures AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS held, sum(len(terms))::BIGINT AS total FROM docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
postings AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * held + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), figures),
scores AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * held) // total))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) CROSS JOIN figures GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""
