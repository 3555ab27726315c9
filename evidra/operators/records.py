"""Curated requirements as records with their hash and place, and the texts that citations mean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators import endpoints
from evidra.sources.tables import written

#: Bytes of a cited text that are told, and pages of one locator.
EXCERPT, MAX_PAGES = 1200, 50
#: Parts that the pieces of one locator are cut down in.
PARTS = 1024
#: Control characters whose escapes have letters, which a record writes in lower case.
_LETTERED = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def canonical_json() -> Column:
    """A requirement as JSON: fields in their fixed order, null ones left out, empty lists kept, no spaces, letters as they are."""
    texts = lambda name: F.coalesce(name, F.array().cast("array<string>")).alias(name)
    endpoint = lambda e: F.concat_ws(" ", T.method(F.regexp_extract(e, r"^\s*(\S+)\s", 1)), F.regexp_extract(e, r"^\s*\S+\s+(.*?)\s*$", 1))
    cited = F.transform("sources", lambda s: F.struct(*[s[f].alias(f) for f in ("source_id", "locator", "sha256", "note")]))
    others = F.transform(F.arrays_zip(texts("conflicts_with"), texts("conflict_notes")), lambda c: F.struct(c["conflicts_with"].alias("requirement_id"), c["conflict_notes"].alias("note")))
    json = F.to_json(F.struct(
        "id", "version", "title", "description", cited.alias("sources"), F.transform(texts("endpoints"), endpoint).alias("endpoints"),
        texts("schemas"), texts("acceptance_criteria"), others.alias("conflicts_with"), texts("tags")))
    return reduce(lambda j, x: F.regexp_replace(j, rf"(?<!\\)((?:\\\\)*)\\u{x}", rf"$1\\u{x.lower()}"), _LETTERED, json)


def records(requirements: DataFrame, file: str, file_sha256: str) -> DataFrame:
    """requirements with json, the record, and mapping(file, file_sha256, locator, sha256), its place and hash."""
    place = F.struct(F.lit(file).alias("file"), F.lit(file_sha256).alias("file_sha256"), F.concat(F.lit("requirement:"), "id").alias("locator"), F.sha2(F.col("json").cast("binary"), 256).alias("sha256"))
    return requirements.withColumn("json", canonical_json()).withColumn("mapping", place)


def cited_texts(cited: DataFrame, pages: DataFrame, chunks: DataFrame, operations: DataFrame, schemas: DataFrame, documents: DataFrame | None = None, most: int = EXCERPT) -> DataFrame:
    """cited(source_id, locator, …) with text, what each locator says, at most `most` bytes and a mark where more follows; null
    where nothing is found. Null texts of pages and chunks are empty.

    Pages (MAX_PAGES of a locator at most) and chunks of a section stand in order, a line each; an operation is its method, path
    and summary; a schema its JSON; a document, where documents(source_id, metadata) are given, its metadata. Each locator is
    looked up once, however often it is cited, by typed joins; no more of a text moves than is told."""
    at = written(cited.select("source_id", "locator").distinct().select("source_id", "locator", T.locator(F.col("locator")).alias("l"))).select("source_id", "locator", "l.*")
    kind, key = F.col("kind"), F.col("value").alias("key")
    named = lambda k, *columns: at.where(kind == k).select("source_id", "locator", *(columns or (key,)))
    piece = lambda rows, text, *order: rows.select("source_id", "locator", F.array(*[F.coalesce(F.lpad(o.cast("string"), 20, "0") if n else o, F.lit("")) for o, n in order]).alias("place"), F.left(F.coalesce(text, F.lit("")), F.lit(most + 1)).alias("piece"))
    c, number = F.col, lambda name: (F.col(name), True)
    last = F.least("last", c("first") + (MAX_PAGES - 1))
    asked_pages = at.where(kind.isin("page", "pages")).select("source_id", "locator", F.explode(F.sequence("first", last)).alias("page"))
    chunks, operations, schemas = chunks.select("source_id", "chunk_id", "section", "page", "ordinal", "text"), operations.select("source_id", "method", "path", "summary"), schemas.select("source_id", "name", "schema")
    sections = chunks.where("section is not null and section <> ''").withColumn("key", F.explode(endpoints.beginnings(c("section"))))
    spoken = F.concat_ws(" ", "method", "path", F.coalesce("summary", F.lit("")))
    by_path = named("path", c("value").alias("path")).unionByName(named("operation", c("value").alias("path"), c("method").alias("wanted")), allowMissingColumns=True)
    parts = [
        piece(asked_pages.join(pages.select("source_id", c("page").cast("long").alias("page"), "text"), ["source_id", "page"]), c("text"), number("page")),
        piece(named("section").join(sections, ["source_id", "key"]), c("text"), number("page"), number("ordinal")),
        piece(named("chunk").join(chunks.withColumnRenamed("chunk_id", "key"), ["source_id", "key"]), c("text"), number("page")),
        piece(by_path.join(operations, ["source_id", "path"]).where("wanted is null or wanted = method"), spoken, (c("method"), False)),
        piece(named("schema").join(schemas.withColumnRenamed("name", "key"), ["source_id", "key"]), c("schema"), (F.lit(""), False)),
    ]
    if documents is not None:
        parts.append(piece(named("document", F.lit("")).join(documents, "source_id"), c("metadata"), (F.lit(""), False)))
    all_ = reduce(DataFrame.unionByName, parts)
    # no piece is told that has more than `most` bytes before it: first so in parts, as one section may hold very many chunks, then in all
    all_ = all_.withColumn("part", F.pmod(F.xxhash64("place", "piece"), F.lit(PARTS)))
    for by in (["source_id", "locator", "part"], ["source_id", "locator"]):
        turn = W.partitionBy(*by).orderBy("place", "piece").rowsBetween(W.unboundedPreceding, -1)
        all_ = all_.withColumn("before", F.sum(F.octet_length("piece") + 1).over(turn)).where(F.coalesce("before", F.lit(0)) <= most + 1)
    told = all_.groupBy("source_id", "locator")
    told = told.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), "\n").alias("text"))
    return cited.join(told.select("source_id", "locator", T.excerpt(c("text"), most).alias("text")), ["source_id", "locator"], "left").select(*cited.columns, "text")
