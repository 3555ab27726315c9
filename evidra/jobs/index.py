"""The index job: changed sources only are read again, and a new generation is published as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators import chunks, pages, phrases, search
from evidra.sources import contracts
from evidra.sources.generations import Generations, bucket
from evidra.sources.tables import written

FORMAT = 3


def fingerprint(sources: DataFrame, **settings) -> DataFrame:
    """sources with sha256 of the text and the fingerprint of all that the result depends on."""
    given = F.lit(",".join(f"{k}={v}" for k, v in sorted({"format": FORMAT, **settings}.items())))
    s = sources.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    return s.withColumn("fingerprint", F.sha2(F.concat_ws("|", given, "source_id", "version", F.col("precedence").cast("string"), *[F.coalesce(c, F.lit("")) for c in ("kind", "authority", "title") if c in sources.columns], "sha256").cast("binary"), 256))


def actions(now: DataFrame, before: DataFrame | None, force: bool = False) -> DataFrame:
    """(source_id, action): skipped, indexed, missing or removed."""
    if before is None:
        return now.select("source_id", F.when(F.col("text").isNull(), "missing").otherwise("indexed").alias("action"))
    old = before.select("source_id", F.col("fingerprint").alias("old"), F.lit(True).alias("was"))
    both = now.select("source_id", "text", "fingerprint", F.lit(True).alias("is")).join(old, "source_id", "full")
    same = (F.col("old") == F.col("fingerprint")) & F.lit(not force)
    return both.select("source_id", F.when(F.col("is").isNull(), "removed").when(F.col("text").isNull(), "missing").when(same, "skipped").otherwise("indexed").alias("action"))


def search_records(documents: DataFrame, chunk_rows: DataFrame, operations: DataFrame, texts: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each chunk, operation and schema as it is searched, with the lengths of its fields."""
    d = documents.select("source_id", "version", "kind", F.col("title").alias("of"))
    none, words = F.lit(None), F.array().cast("array<string>")
    c = chunk_rows.join(d, "source_id").select("source_id", F.col("chunk_id").alias("record_id"), F.lit("chunk").alias("record_type"), "version", "kind", F.coalesce("of", "source_id").alias("title"), F.array_join("section_path", " > ").alias("section_context"), F.col("text").alias("content"), T.identifiers(F.col("text")).alias("identifiers"), F.concat(F.lit("page:"), F.col("page").cast("string")).alias("locator"), "page", F.sha2("text", 256).alias("sha256"))
    o = operations.select("source_id", "version", "method", "path", "locator", "sha256").join(texts, ["source_id", "version", "method", "path"])
    o = o.select("source_id", F.concat("source_id", F.lit("#"), "locator").alias("record_id"), F.lit("operation").alias("record_type"), "version", F.lit("openapi").alias("kind"), "title", none.cast("string").alias("section_context"), "content", "identifiers", "locator", none.cast("long").alias("page"), "sha256")
    s = contracts.schema_text(schemas).select("source_id", F.concat("source_id", F.lit("#schema:"), "name").alias("record_id"), F.lit("schema").alias("record_type"), "version", F.lit("openapi").alias("kind"), "title", none.cast("string").alias("section_context"), "content", F.array(F.lower("name")).alias("identifiers"), F.concat(F.lit("schema:"), "name").alias("locator"), none.cast("long").alias("page"), "sha256")
    all_ = c.unionByName(o).unionByName(s)
    lengths = F.struct(*[F.size(phrases.words(F.col(f))).alias(f) for f in search.BOOSTS], F.size(F.coalesce("identifiers", words)).alias("identifiers"))
    return all_.withColumn("lengths", lengths)


def search_figures(records: DataFrame) -> DataFrame:
    """(field, n, mean_length) of all records: one row a field."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"lengths.{f}").alias("length")) for f in (*search.BOOSTS, "identifiers")]))
    return records.select(fields.alias("f")).groupBy("f.field").agg(F.count(F.lit(1)).alias("n"), F.avg("f.length").alias("mean_length"))


def run(store: Generations, sources: DataFrame, force: bool = False, max_chars: int = chunks.MAX_CHARS, overlap: int = chunks.OVERLAP, min_chars: int = 16, requirements: DataFrame | None = None) -> DataFrame:
    """Index sources(source_id, version, precedence, text; if given: kind, authority, title) and publish them as a new generation: documents,
    pages, chunks, operations, schemas, and search's records, terms and places of words, each in buckets of which only those with a
    changed source are written; figures and requirements as a whole. Returns what was done with each source.

    A source of kind openapi is a contract, JSON or YAML; one that can't be read is a document with status failed."""
    for name, default in (("kind", "text"), ("authority", None), ("title", None)):
        if name not in sources.columns:
            sources = sources.withColumn(name, F.lit(default).cast("string"))
    now = fingerprint(sources, max_chars=max_chars, overlap=overlap, min_chars=min_chars)
    number = store.current()
    before = store.read("documents", number)
    done = written(actions(now, before, force).withColumn("bucket", bucket(F.col("source_id"), store.buckets)))
    touched = None if before is None else [r["bucket"] for r in done.where("action <> 'skipped'").select("bucket").distinct().collect()]  # no more than there are buckets
    todo = written(now.join(done.where("action = 'indexed'"), "source_id", "left_semi"))
    p = written(pages.with_quality(pages.with_status(pages.split_pages(todo.where("kind <> 'openapi'"), "source_id", "text"), min_chars)))
    clean = written(pages.cleaned(p, "source_id"))
    figures = pages.document_figures(p, "source_id").join(pages.cleaning_figures(p, clean, "source_id"), "source_id", "left")
    parsed = written(contracts.parsed(todo.where("kind = 'openapi'")))
    listed = now.join(done.where("action in ('indexed', 'missing')"), "source_id", "left_semi").join(figures, "source_id", "left").join(parsed.select("source_id", "error"), "source_id", "left")
    documents = written(listed.select(
        "source_id", T.document_id(F.col("source_id"), F.col("sha256")).alias("document_id"), "version", "precedence", "kind", "authority", "title", "sha256", "fingerprint",
        F.when(F.col("text").isNull(), "missing").when(F.col("error").isNotNull(), "failed").when(F.col("kind") == "openapi", "indexed").otherwise(F.col("status")).alias("status"), "error", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("ocr_required", F.lit(0)).alias("ocr_required"), F.coalesce("low_quality_pages", F.lit(0)).alias("low_quality_pages"),
        F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"), F.coalesce("repairs", F.lit(0)).alias("repairs"), F.coalesce("patterns", F.array().cast("array<string>")).alias("removed_patterns"),
    ))
    given = parsed.where("error is null").select("source_id", "version", "json")
    ops, parts = written(contracts.operations(given)), contracts.components(given)
    texts = contracts.search_text(ops, contracts.parameters(ops, parts), contracts.responses(ops, parts))
    named = written(contracts.schemas(given))
    body = p.select("source_id", F.col("page").cast("long").alias("page"), "status").join(clean.select("source_id", "page", "text"), ["source_id", "page"])
    chunk_rows = written(chunks.chunk_pages(body, "source_id", max_chars, overlap))
    records = written(search_records(documents, chunk_rows, ops, texts, named))
    terms = search.index_terms(records, "record_id")[0].join(records.select("record_id", "source_id"), "record_id")
    places = phrases.positions(records, "record_id", list(search.BOOSTS), stem=True).join(records.select("record_id", "source_id"), "record_id")
    tables = {"documents": documents, "pages": p.select("source_id", "page", "text", "status", "char_count", "sha256", "low_quality"), "chunks": chunk_rows, "operations": ops, "schemas": named, "records": records, "terms": terms, "places": places}
    if before is not None:
        kept = done.where("action = 'skipped'").select("source_id")
        tables = {n: t.unionByName(store.read(n, number, touched).join(kept, "source_id", "left_semi").select(*t.columns)) for n, t in tables.items()}
    whole = {"report": done.select("source_id", "action").orderBy("source_id")}
    needs = requirements if requirements is not None else store.read("requirements", number)
    if needs is not None:
        whole["requirements"] = needs
    store.publish(whole, tables, touched)
    return store.read("report")


def health(store: Generations) -> DataFrame:
    """(problem, n) of the current generation: missing sources, pages that need text recognition, pages of low quality."""
    d = store.read("documents")
    one = lambda name, c: d.agg(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias("n")).select(F.lit(name).alias("problem"), "n")
    return one("missing_source", F.col("status") == "missing").unionByName(one("ocr_required", F.col("ocr_required"))).unionByName(one("low_quality_page", F.col("low_quality_pages"))).where("n > 0")


def doctor(store: Generations, sources: DataFrame) -> DataFrame:
    """(check, source_id) of what doesn't fit: documents that aren't declared, declared ones that aren't indexed, texts
    that have changed since, documents with pages but no chunk."""
    d = store.read("documents")
    now = sources.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    tell = lambda df, name: df.select(F.lit(name).alias("check"), "source_id")
    drift = d.join(now.select("source_id", F.col("sha256").alias("now")), "source_id").where("sha256 <> now")
    empty = store.read("pages").where("status = 'extracted'").select("source_id").distinct().join(store.read("chunks"), "source_id", "left_anti")
    parts = [tell(d.join(now, "source_id", "left_anti"), "not_declared"), tell(now.join(d, "source_id", "left_anti"), "not_indexed"), tell(drift, "hash_drift"), tell(empty, "search_index")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
