"""Generations of an index: a directory of Parquet tables each, published by one rename, found through a CURRENT file.

Tables of sources' rows are kept in buckets of sources. A generation names, for each of its buckets, the generation whose
directory holds it: only buckets with a changed source are written again, all others are shared with generations before.
All goes through Spark's file system classes, so the index may be in any store that Spark can write. Readers open what
CURRENT names and never see a half-written generation; a failed run leaves a staging directory and nothing else."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 2
KEPT = 2
#: Buckets of sources; a store keeps the number that it was made with.
BUCKETS = 64
#: Columns by which the rows of a bucket are sorted, so that readers skip row groups by their bounds.
CLUSTERED = {"pages": ["source_id", "page"], "chunks": ["source_id", "page", "ordinal"], "operations": ["version", "path", "method"], "schemas": ["version", "name"], "records": ["record_id"], "terms": ["term"], "places": ["term"]}


def bucket(source_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(source_id), F.lit(buckets)).cast("int")


class Generations:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        current = self.current()
        self.buckets = buckets if current is None else self.layout(current)["buckets"]

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *filter(None, parts)]))

    def numbers(self) -> list[int]:
        """The generations that can be read."""
        place = self._path("generations")
        if not self.fs.exists(place):
            return []
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(place) if s.getPath().getName().isdigit() and self.fs.exists(self._path("generations", s.getPath().getName(), "layout")))

    def layout(self, number: int) -> dict:
        """{buckets, parts: {table: {schema, places: {bucket: generation}}}} of a generation."""
        return json.loads(self.spark.read.text(self._path("generations", str(number), "layout").toString(), wholetext=True).first()[0])

    def current(self) -> int | None:
        place = self._path("CURRENT")
        if not self.fs.exists(place):
            return None
        text = self.spark.read.text(place.toString()).first()
        if text is None or not text[0].strip().isdigit() or int(text[0]) not in self.numbers():
            raise ValueError("CURRENT names no generation")
        return int(text[0])

    def buckets_of(self, source_ids: list[str]) -> list[int]:
        ids = self.spark.sql("SELECT explode(:ids) AS id", args={"ids": F.array(*map(F.lit, source_ids))}) if source_ids else None
        return [] if ids is None else [r[0] for r in ids.select(bucket(F.col("id"), self.buckets)).distinct().collect()]

    def read(self, name: str, number: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """A table of a generation (the current one), or None where there is none yet; only: the rows of these buckets."""
        number = self.current() if number is None else number
        if number is None:
            return None
        part = self.layout(number)["parts"].get(name)
        if part is None:
            place = self._path("generations", str(number), name)
            return self.spark.read.parquet(place.toString()) if self.fs.exists(place) else None
        held = {int(b): g for b, g in part["places"].items()}
        paths = [self._path("generations", str(g), name, f"bucket={b}").toString() for b, g in sorted(held.items()) if only is None or b in only]
        schema = StructType.fromJson(part["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, tables: dict[str, DataFrame], parts: dict[str, DataFrame] | None = None, touched: list[int] | None = None) -> int:
        """Write the next generation, make it the current one and drop all but the last KEPT. tables are written whole; parts,
        each with a source_id, give all rows of the touched buckets (of all, if none are named)."""
        current = self.current()
        number = max([current or 0, *self.numbers()]) + 1
        staging = self._path("staging", str(number))
        self.fs.delete(staging, True)
        for name, df in tables.items():
            df.write.parquet(f"{staging.toString()}/{name}")
        before = self.layout(current)["parts"] if current is not None and touched is not None else {}
        layout = {"buckets": self.buckets, "parts": {}}
        for name, df in (parts or {}).items():
            rows = df.withColumn("bucket", bucket(F.col("source_id"), self.buckets))
            order = [c for c in CLUSTERED.get(name, []) if c in df.columns]
            rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{staging.toString()}/{name}")
            places = {b: g for b, g in before.get(name, {"places": {}})["places"].items() if int(b) not in touched}
            written = [s.getPath().getName() for s in self.fs.listStatus(self._path("staging", str(number), name))]
            places |= {d.removeprefix("bucket="): number for d in written if d.startswith("bucket=")}
            layout["parts"][name] = {"schema": df.schema.jsonValue(), "places": places}
        meta = self.spark.createDataFrame([(SCHEMA_VERSION, number)], "schema_version int, generation long").withColumn("indexed_at", F.current_timestamp()).coalesce(1)
        meta.write.parquet(f"{staging.toString()}/meta")
        self._put(self._path("staging", str(number), "layout"), json.dumps(layout))
        self.fs.mkdirs(self._path("generations"))
        if not self.fs.rename(staging, self._path("generations", str(number))):
            raise OSError("the generation can't be published")
        new, old = self._path("CURRENT.new"), self._path("CURRENT")
        self._put(new, f"{number}\n")
        self.fs.delete(old, False)
        self.fs.rename(new, old)
        self._drop([n for n in self.numbers() if n > number - KEPT])
        return number

    def _put(self, path, text: str) -> None:
        out = self.fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _drop(self, kept: list[int]) -> None:
        """Delete what no kept generation reads: other generations but for the buckets that kept ones share."""
        used = {(g, name, int(b)) for n in kept for name, part in self.layout(n)["parts"].items() for b, g in part["places"].items()}
        for s in self.fs.listStatus(self._path("generations")):
            n = s.getPath().getName()
            if not n.isdigit() or int(n) in kept:
                continue
            self.fs.delete(self._path("generations", n, "layout"), False)
            shared = {name for g, name, _ in used if g == int(n)}
            for t in self.fs.listStatus(s.getPath()):
                name = t.getPath().getName()
                if name not in shared:
                    self.fs.delete(t.getPath(), True)
                    continue
                for d in self.fs.listStatus(t.getPath()):
                    b = d.getPath().getName().removeprefix("bucket=")
                    if b.isdigit() and (int(n), name, int(b)) not in used:
                        self.fs.delete(d.getPath(), True)
            if not shared:
                self.fs.delete(s.getPath(), True)
