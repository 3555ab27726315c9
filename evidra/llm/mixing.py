"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

A document's size is its number of words (runs of characters other than space and U+0009 to U+000D; null text: 0).
Sources go by code point, null last, and have the weights in turn. Together they shall give `share` times all words, in
proportion to their weights; no source more than `most` times its own words, what it can't give being shared by the others
in the same way. Within a source, each document is expected target / size-of-source times; documents are lined up by
size, then by a hash of their id, their expected copies are summed up from one random offset, and a document is taken
once per whole number that its own stretch crosses. So reruns agree, every document is taken the expected number of
times but for rounding, and large and small documents are taken alike.

Empty documents count as documents of size 0. Repeated rows are rows like any other; a null id is an id. An empty table
gives an empty result, a table without words gives targets of 0. Extra columns don't matter. A source or size that holds
most rows is lined up in about the square root of as many parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.llm.common import spread, written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SEED = "mix"


def unit(text: Column) -> Column:
    """A number in [0, 1) from a text's hash."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source key (nulls last), size and the id's hash; written once, so that texts are read once."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    text = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    docs = spread(docs.select("doc_id", "source", "text"))
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), F.md5(text.cast("binary")).alias("line")))


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """key, source_size and target of each source: min(most * size, level * weight), the level being such that the
    targets sum up to the share. A row for each source, so one task may line them up."""
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy("key")) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    x = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    line = W.orderBy(F.col("cap") / F.col("weight"), "key")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    after = line.rowsBetween(0, W.unboundedFollowing)
    x = x.withColumn("level", (F.sum("source_size").over(W.partitionBy()) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # sources reach their caps in this order; the level is that of the first that doesn't
    x = x.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("key"), F.col("level").alias("level")))).over(W.partitionBy())["level"])
    return x.select("key", "source_size", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def drawn(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and copies (how often the mix takes the document) of each row of docs."""
    rows = sized(docs)
    groups = rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"))
    groups = written(groups.withColumn("before", F.sum("n").over(W.partitionBy("key").orderBy("size").rowsBetween(W.unboundedPreceding, -1))))
    # a (source, size) of n rows is lined up in sqrt(n) parts by hash
    parts = F.greatest(F.lit(1.0), F.ceil(F.sqrt("n")))
    place = F.floor(F.conv(F.substring("line", 1, 8), 16, 10).cast("long") / F.lit(4294967296.0) * parts)
    split = written(rows.join(groups, ["key", "size"]).select("doc_id", "key", "size", "line", F.coalesce("before", F.lit(0)).alias("before"), place.cast("long").alias("part")))
    counts = split.groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("key", "size", "part", F.coalesce(F.sum("n").over(W.partitionBy("key", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_before"))
    ranked = split.withColumn("rank", F.row_number().over(W.partitionBy("key", "size", "part").orderBy("line", "doc_id")))
    ranked = ranked.join(counts, ["key", "size", "part"]).withColumn("rank", F.col("before") + F.col("part_before") + F.col("rank") - 1)
    goal = targets(rows, weights, share, most).withColumn("offset", unit(F.concat(F.lit(f"{seed}:"), F.col("key"))))
    out = ranked.join(goal, "key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor((F.col("rank") + 1) * rate + F.col("offset")) - F.floor(F.col("rank") * rate + F.col("offset"))
    return out.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def plan(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of each row of docs."""
    return drawn(docs, **settings).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; documents without words aren't taken. Rows that share an id
    are taken alike."""
    copies = drawn(docs, **settings).where("copies > 0 and size > 0").groupBy("doc_id").agg(F.max("copies").cast("int").alias("__copies"))
    copies = copies.withColumnRenamed("doc_id", "__doc_id")
    taken = docs.join(copies, docs["doc_id"].cast("long").eqNullSafe(copies["__doc_id"]))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[c] for c in docs.columns])


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY key),
weighed AS (SELECT key, source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY key) - 1) % 3) + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT key, source_size, least(cap, coalesce((SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, key LIMIT 1) * weight, cap)) AS target,
    CAST(('0x' || substr(md5('mix:' || key), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS random_offset
  FROM levels),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY key ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank FROM sized s),
drawn AS (SELECT r.*, g.source_size, g.target, g.random_offset, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate FROM ranked r JOIN goals g USING (key))
SELECT doc_id, size, source_size, target, CAST(floor((rank + 1) * rate + random_offset) - floor(rank * rate + random_offset) AS BIGINT) * size AS taken FROM drawn
"""
