"""Token ids of a dataset as files, each a wavelet matrix, in ascending order of doc_id.

A document's ids are those of a byte-level BPE vocabulary, then one end id; null text is empty text. Rows are sorted over
all cores (null ids first, rows of one id by their text's hash), and each part's ids are cut into shards of about
SHARD ids, no document being split. A shard is one file: ids can be read at any place, counted, and found from it alone.

Repeated rows are documents like any other; a very long text makes a larger shard of its own; an empty table gives no file
and an empty result; extra columns don't matter. Files are written beside their place and moved there, so a task that runs
again or twice leaves the same file; the folder must be one that executors can write, of any kind that pyarrow.fs knows."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.llm.common import id_text, session, shared_dir, written
from evidra.llm.packing import END, VOCABULARY, encoder
from evidra.llm.wavelet import Shard

#: Ids of a shard, but for its last document.
SHARD = 1 << 20


def _save(folder: str, shard: Shard) -> str:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    name = f"{path}/ids-{shard.number:016x}.ewm"
    part = f"{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(part) as out:
        out.write(shard.to_bytes())
    try:
        where.move(part, name)
    except OSError:  # another run of this task has moved the same file there, on systems that don't overwrite
        if where.get_file_info(name).type != fs.FileType.File:
            raise
        where.delete_file(part)
    return name


def write(docs: DataFrame, folder: str | None = None, end: int = END, vocabulary: str = VOCABULARY, shard: int = SHARD) -> tuple[str, DataFrame]:
    """The folder (one in the shared folder, if none is given), and its shards: (shard, file, docs, n_tokens, start), start being the
    ids in all shards before."""
    spark = session(docs.sparkSession)
    folder = folder or f"{shared_dir(spark)}/evidra-ids-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(vocabulary), np.array([end], "<u4")
        number = TaskContext.get().partitionId() << 32
        ids, names, ends, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            made = Shard.of(number, np.concatenate(ids), names, np.array(ends))
            return pa.RecordBatch.from_pylist([{"shard": number, "file": _save(folder, made), "docs": len(names), "n_tokens": made.n}])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = encode(text.as_py())
                ids += [got, tail]
                n += len(got) + 1
                names.append(doc), ends.append(n)
                if n >= shard:
                    yield close()
                    ids, names, ends, n, number = [], [], [], 0, number + 1
        if names:
            yield close()

    rows = id_text(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = written(rows.mapInArrow(build, "shard long, file string, docs long, n_tokens long"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row a shard
    return folder, shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of a folder's shards."""
    return session(spark).read.format("binaryFile").option("pathGlobFilter", "*.ewm").load(folder).select("path", "content")


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of little-endian 32-bit ids) of each document, from the files."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1):
                s = Shard.from_bytes(raw.as_py())
                ids = s.decode()
                starts = np.concatenate([[0], s.ends[:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), s.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([s.number] * len(crc), pa.int64()), pa.array(s.doc_ids, pa.int64()), pa.array(starts), pa.array(s.ends - starts), pa.array(crc, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = files(spark, folder).mapInArrow(documents, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(shards.select("shard", "start"), "shard").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def count(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each id occurs in a folder's files, counted by rank."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1):
                s = Shard.from_bytes(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([s.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return files(spark, folder).mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """(doc_id, place): every occurrence of an id, with its place in its document, found by select."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1):
                s = Shard.from_bytes(raw.as_py())
                at = np.array([s.occurrence(token, k) for k in range(s.count(token))], np.int64)
                doc = np.searchsorted(s.ends, at, side="right")
                yield pa.RecordBatch.from_arrays([pa.array([s.doc_ids[d] for d in doc], pa.int64()), pa.array(at - np.concatenate([[0], s.ends])[doc])], names=["doc_id", "place"])

    return files(spark, folder).mapInArrow(found, "doc_id long, place long")
