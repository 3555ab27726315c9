"""Questions to an index, as DataFrames: search, reading by locator, listing, finding and tracing requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.jobs import index
from evidra.operators import endpoints, phrases, records, search
from evidra.sources.generations import Generations
from evidra.sources.tables import written

MAX_QUERY, MAX_PAGES = 1000, 50


class Refused(ValueError):
    """A question that can't be answered: invalid_input, invalid_locator or not_found."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def among(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """rows whose column has one of these values: a filter that the scan knows, or for long lists a semi-join."""
    if len(values) <= 100:
        return rows.where(F.col(column).isin(*values)) if values else rows.where(F.lit(False))
    asked = rows.sparkSession.sql("SELECT explode(:v) AS v", args={"v": F.array(*map(F.lit, values))})
    return rows.join(asked.select(F.col("v").alias(column)).distinct(), column, "left_semi").select(*rows.columns)


class Catalog:
    """The tables of the generation that was current when this was made; reload() follows a newer one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Generations(spark, root)
        self.number = None
        self.reload()

    def reload(self) -> bool:
        newest = self.store.current()
        if newest == self.number:
            return False
        self.documents, self.pages, self.chunks, self.operations, self.schemas, self.records, self.terms, self.places, self.requirements = (
            self.store.read(n, newest) for n in ("documents", "pages", "chunks", "operations", "schemas", "records", "terms", "places", "requirements")
        )
        self.figures = None if self.records is None else written(index.search_figures(self.records))
        self.number = newest
        return True

    def list_sources(self, version: str | None = None) -> DataFrame:
        d = self.documents if version is None else self.documents.where(F.col("version") == version)
        return d.orderBy("version", F.desc("precedence"), "source_id")

    def of_sources(self, name: str, source_ids: list[str]) -> DataFrame:
        """A table's rows of these sources; only the files of their buckets are opened."""
        rows = self.store.read(name, self.number, self.store.buckets_of(source_ids))
        return among(rows, "source_id", source_ids)

    def get_documents(self, source_ids: list[str]) -> DataFrame:
        return self.of_sources("documents", source_ids).orderBy("source_id")

    def page_chunks(self, source_id: str, page: int) -> DataFrame:
        return self.of_sources("chunks", [source_id]).where(F.col("page") == page).orderBy("ordinal")

    def source_operations(self, source_id: str, path: str, method: str | None = None) -> DataFrame:
        rows = self.of_sources("operations", [source_id]).where(F.col("path") == path)
        return (rows if method is None else rows.where(F.col("method") == method)).orderBy("method")

    def source_schemas(self, source_id: str, names: list[str]) -> DataFrame:
        return among(self.of_sources("schemas", [source_id]), "name", names).orderBy("name")

    def find_schemas(self, version: str, names: list[str]) -> DataFrame:
        """All definitions of these names in a version: by name, the most binding source first."""
        rows = among(self.schemas.where(F.col("version") == version), "name", names)
        ranks = self.documents.select("source_id", "precedence")
        return rows.join(ranks, "source_id").orderBy("name", F.desc("precedence"), "source_id").select(*rows.columns, "precedence")

    def get_requirements(self, version: str | None = None, ids: list[str] | None = None) -> DataFrame:
        rows = self.requirements if version is None else self.requirements.where(F.col("version") == version)
        return (rows if ids is None else among(rows, "id", ids)).orderBy("id")

    def cited_texts(self, cited: DataFrame, most: int = records.EXCERPT) -> DataFrame:
        """cited(source_id, locator, …) with text, what each says; all in one pass."""
        about = F.to_json(F.struct("title", "version", "kind", "authority", "pages", "sha256"))
        return records.cited_texts(cited, self.pages, self.chunks, self.operations, self.schemas, self.documents.select("source_id", about.alias("metadata")), most)

    def meta(self) -> DataFrame:
        """One row: schema_version, generation, indexed_at and the hash of the requirements' file, if it is known."""
        known = self.requirements is not None and "mapping" in self.requirements.columns
        sha = self.requirements.agg(F.max("mapping.file_sha256")).first()[0] if known else None
        return self.store.read("meta", self.number).withColumn("requirements_file_sha256", F.lit(sha).cast("string"))

    def search(self, query: str, version: str | None = None, source_id: str | None = None, limit: int = 10, kind: str | None = None) -> DataFrame:
        """Best chunks, operations and schemas for a question: words and quoted phrases over titles, sections and contents,
        identifiers as they are. Equal texts, pages and schemas stand behind the first of them. Statistics are those of all
        records, whatever the filters, and each filter adds its value's weight."""
        query = " ".join(query.split())
        if not query or len(query) > MAX_QUERY:
            raise Refused("invalid_input", "a question has 1 to 1000 characters")
        if version is not None and self.documents.where(F.col("version") == version).isEmpty():
            raise Refused("invalid_input", "no such version is indexed")
        if source_id is not None and self.documents.where(F.col("source_id") == source_id).isEmpty():
            raise Refused("not_found", "no such source is indexed")
        limit = max(1, min(limit, 50))
        filters = {"version": version, "source_id": source_id, "kind": kind}
        asked = self.spark.createDataFrame([(0, query, *filters.values())], "q int, text string, version string, source_id string, kind string")
        terms = phrases.phrase_terms(asked.select("q", phrases.quoted(F.col("text")).alias("phrases")), stem=True)
        quoted = phrases.phrase_scores(self.places, self.figures, "record_id", terms, search.BOOSTS) if '"' in query else None
        words = asked.withColumn("text", phrases.unquoted(F.col("text"))) if '"' in query else asked
        scores = search.ask(self.records, self.terms, self.figures, "record_id", words, list(filters), quoted)
        hits = written(search.top(scores, "q", "record_id", max(3 * limit, limit + 10)).join(self.records, "record_id"))
        rows = hits.select("q", "rank", F.col("record_id").alias("key_id"), "version", "sha256", "source_id", "page", "locator", "record_type")
        attached = written(search.collapse_hits(rows, limit).join(hits.select("rank", "record_id"), "rank"))
        behind = attached.groupBy("kept_by").agg(F.array_sort(F.collect_list(F.when(F.col("kept_by") != F.col("rank"), F.col("record_id")))).alias("duplicates"))
        kept = hits.join(behind, F.col("rank") == F.col("kept_by")).drop("kept_by", "lengths")
        stems = phrases.phrase_terms(asked.select("q", F.array("text").alias("phrases"))).select("q", "term").distinct()
        weights = stems.withColumn("w", F.length("term").cast("double"))  # longer words say more
        parts = phrases.best_fragments(kept.select("q", "record_id"), self.records, "record_id", "content", weights).select("record_id", F.col("fragment").alias("excerpt"))
        return kept.join(parts, "record_id").drop("q").orderBy("rank").limit(limit)

    def read(self, source_id: str, locator: str) -> DataFrame:
        """What a locator of a source says: the document's row, pages, or chunks of a section."""
        p = self.spark.range(1).select(T.locator(F.lit(locator)).alias("l")).select("l.*").first()
        if p.error:
            raise Refused("invalid_locator", locator)
        d = self.of_sources("documents", [source_id])
        row = d.first()
        if row is None:
            raise Refused("not_found", source_id)
        if p.kind == "document":
            return d
        if row.status in ("missing", "failed"):
            raise Refused("not_found", f"{source_id} is {row.status}")
        mine = lambda name: self.of_sources(name, [source_id])
        if p.kind in ("page", "pages"):
            if p.first > row.pages:
                raise Refused("not_found", f"{source_id} has {row.pages} pages")
            return mine("pages").where(F.col("page").between(p.first, min(p.last, p.first + MAX_PAGES - 1))).orderBy("page")
        if p.kind == "section":
            s, v = F.col("section"), p.value
            return mine("chunks").where((s == v) | (s.startswith(v) & F.substring(s, len(v) + 1, 1).isin(".", " ", "/"))).orderBy("page", "ordinal")
        if p.kind == "chunk":
            return mine("chunks").where(F.col("chunk_id") == p.value)
        if row.kind == "openapi" and p.kind in ("operation", "path", "schema"):
            o = mine("operations").where((F.col("path") == p.value) & (F.lit(p.method is None) | (F.col("method") == p.method)))
            found = mine("schemas").where(F.col("name") == p.value) if p.kind == "schema" else o
            if found.isEmpty():
                raise Refused("not_found", locator)
            return found
        raise Refused("invalid_input", f"{locator} doesn't fit a text")


def find_requirement(requirements: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Requirements by id (0), part of an id (1), or words that all begin some word of theirs (2)."""
    q = query.strip()
    if not q:
        raise Refused("invalid_input", "a question is wanted")
    asked = [w for w in requirements.sparkSession.range(1).select(T.search_tokens(F.lit(q)).alias("t")).first().t]
    text = F.concat_ws(" ", "id", "title", "description", F.array_join("acceptance_criteria", " "), F.array_join("tags", " "), F.array_join("endpoints", " "))
    words = T.search_tokens(text)
    fits = F.lit(bool(asked)) & F.forall(F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>"), lambda a: F.exists(words, lambda w: w.startswith(a)))
    rank = F.when(F.upper("id") == q.upper(), 0).when(F.contains(F.upper("id"), F.lit(q.upper())), 1).when(fits, 2)
    return requirements.withColumn("rank", rank).where("rank is not null").orderBy("rank", "id").limit(max(1, min(limit, 50)))


def trace(requirements: DataFrame, documents: DataFrame, pages: DataFrame, ops: DataFrame, prefixes: dict[str, str]) -> dict[str, DataFrame]:
    """All requirements' sources with status, endpoints, acceptance criteria and conflicts, as tables: one pass traces
    them all."""
    cited = requirements.select(F.col("id").alias("requirement_id"), F.explode("sources").alias("s")).select("requirement_id", "s.source_id", "s.locator", F.col("s.sha256").alias("pin"))
    locators = requirements.select("id", "version", "endpoints", F.transform("sources", lambda s: s["locator"]).alias("locators"))
    ties = cited.join(documents.select("source_id", "version", "precedence", "authority"), "source_id").groupBy("requirement_id", "version", "precedence").agg(F.array_sort(F.collect_set("authority")).alias("authorities")).where(F.size("authorities") > 1)
    return {
        "sources": endpoints.source_status(cited, documents, pages),
        "endpoints": endpoints.requirement_links(locators, ops, prefixes),
        "criteria": requirements.select("id", F.posexplode("acceptance_criteria").alias("n", "text")).select(F.concat("id", F.lit("/AC"), (F.col("n") + 1).cast("string")).alias("criterion_id"), "id", "text"),
        "conflicts": endpoints.conflict_pairs(requirements),
        "precedence_ties": ties,
    }
