"""Helpers that every operator of this folder shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: A table of more bytes than this for each core isn't dealt out anew.
SPREAD_BYTES = 64 << 20


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session and send this package to its executors, once; every operator calls it
    before it plans Python work."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if not getattr(sc, "_evidra_sent", False):
        root = Path(__file__).resolve().parents[1]
        handle, archive = tempfile.mkstemp(suffix=".zip", prefix="evidra-")
        os.close(handle)
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(archive)
        sc._evidra_sent = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names, or a temporary one where none is named (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read, and read it back: it is computed once, its lineage ends, and it
    outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidra-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """Apply a function of one Arrow batch to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(batch)

    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it has fewer and is small: a small table in one file would keep one
    core busy. Tables of more than SPREAD_BYTES for each core stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > cores * SPREAD_BYTES:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty), whatever else the table has."""
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))


def sample_ids(df: DataFrame, n: int, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """At most n distinct keys, the same ones in every run: those with the smallest hashes."""
    h = F.xxhash64(F.lit(seed), key)
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(h, key).limit(n)
