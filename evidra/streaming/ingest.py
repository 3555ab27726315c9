"""Streams: new source files indexed as they come, and counts of a log in windows with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidra.jobs import index
from evidra.sources.generations import Generations


def index_new_files(spark: SparkSession, folder: str, schema: str, root: str, checkpoint: str) -> StreamingQuery:
    """Index the Parquet files that came into a folder since the last call, then stop: each batch is laid over the
    sources of the generation before it, and publishes the next."""
    stream = spark.readStream.schema(schema).parquet(folder)

    def add(batch: DataFrame, number: int) -> None:
        store = Generations(spark, root)
        new = batch.dropDuplicates(["source_id"])
        if store.current() is not None and store.read("sources") is not None:
            new = new.unionByName(store.read("sources").join(new, "source_id", "left_anti"))
        new = new.select("source_id", "version", "precedence", "text")
        index.run(_with_sources(store, new), new)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _with_sources(store: Generations, sources: DataFrame) -> Generations:
    publish = store.publish
    store.publish = lambda tables, *parts: publish(tables | {"sources": sources}, *parts)
    return store


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of events(ts, event_type, value), batch or stream; rows later than `late` are left
    out of a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")
