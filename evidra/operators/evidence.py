"""What is known of many endpoints at once: operations, schemas, curated requirements, conflicts, related texts, and all that
is cited, in order and each once. One pass answers all who ask; conflicts are told, never resolved."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators import endpoints, graph, search
from evidra.sources.tables import written

#: Related texts of an endpoint, unless asked otherwise, and those that are ranked so that copies can be taken out.
EVIDENCE = 5
_ROLES = ("openapi_operation", "openapi_schema", "requirement_source", "discovered_evidence")


def question(found: DataFrame) -> Column:
    """What an endpoint's related texts are asked by: summary, the operation's name in words, its path's fixed parts, tags;
    without an operation, the path's parts."""
    fixed = F.array_join(F.filter(F.split("path", "/"), lambda s: (s != "") & ~s.startswith("{")), " ")
    of_op = F.concat_ws(" ", F.coalesce("summary", F.lit("")), T.split_camel(F.coalesce("operation_id", F.lit(""))), fixed, F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    return F.when(F.col("found"), of_op).otherwise(F.translate("asked_path", "/{}", "   "))


def first_of_each(rows: DataFrame, by: list[str], same: list[str], order: list[str]) -> DataFrame:
    """rows without those that repeat `same` of an earlier row, with nth, their place, from 1, in what stays."""
    packed = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(c) for c in same])
    kept = rows.withColumn("__n", F.row_number().over(W.partitionBy(*by, packed).orderBy(*order))).where("__n = 1").drop("__n")
    return kept.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


class Bundles(Mapping):
    """Tables by name, each made when it is first asked for: who wants the conflicts alone doesn't pay for a search."""

    def __init__(self, made: dict[str, Callable[[], DataFrame]]):
        self.made, self.known = made, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.known:
            self.known[name] = self.made[name]()
        return self.known[name]

    def __iter__(self):
        return iter(self.made)

    def __len__(self) -> int:
        return len(self.made)


def bundles(asked: DataFrame, operations: DataFrame, definitions: DataFrame, refs: DataFrame, requirements: DataFrame, documents: DataFrame, pages: DataFrame, records: DataFrame, prefixes: dict[str, str] | None = None, keys: DataFrame | None = None, limit: int = EVIDENCE) -> Mapping[str, DataFrame]:
    """Tables by ask_id for asked(ask_id, version, method, path): endpoints, schemas, requirements, related, conflicts, citations.

    operations(source_id, version, method, path, operation_id, summary, tags, referenced_schemas, locator, sha256);
    definitions(source_id, version, name, precedence, sha256); refs(source_id, version, name, target, position);
    requirements(id, version, endpoints, sources(source_id, locator, sha256), conflicts_with); documents(source_id, version,
    precedence, authority, status, sha256); pages(source_id, page, sha256); records(record_id, source_id, version, locator,
    page, content, sha256), the texts that may be related. An ask without operation and requirement is told as not_found."""
    prefixes = prefixes or {}
    asks = written(endpoints.keyed(asked.select("ask_id", "version", "method", "path"), prefixes))
    ops = written(endpoints.keyed(operations, prefixes))
    hit = endpoints.lookup_many(asks, ops, documents).select("ask_id", "source_id", "path", "others", "ambiguous", "matched_by")
    own = ops.drop("path_key").dropDuplicates(["source_id", "version", "method", "path"])
    found = asks.withColumnRenamed("path", "asked_path").join(hit, "ask_id", "left").join(own, ["source_id", "version", "method", "path"], "left").withColumn("found", F.col("source_id").isNotNull())
    found = written(found)

    # requirements that mean the endpoint
    needs = requirements.withColumn("locators", F.transform("sources", lambda s: s["locator"]))
    linked = endpoints.requirement_links(needs.select("id", "version", "endpoints", "locators"), ops, prefixes)
    linked = found.where("found").select("ask_id", "source_id", "version", "method", "path").join(linked, ["source_id", "version", "method", "path"]).select("ask_id", "requirement_id", "via")
    nowhere = found.where("not found").select("ask_id", "version", "method", F.col("asked_path").alias("path"), F.lit("").alias("source_id"), "path_key")
    alone = endpoints.requirement_links(needs.select("id", "version", "endpoints", "locators"), nowhere.select("source_id", "version", "method", "path", "path_key").distinct(), prefixes)
    alone = nowhere.join(alone.drop("source_id"), ["version", "method", "path"]).select("ask_id", "requirement_id", "via")
    links = written(linked.unionByName(alone))

    # their sources and conflicts
    mine = links.select("ask_id", "requirement_id").join(requirements.withColumnRenamed("id", "requirement_id").drop("version"), "requirement_id")
    cited = written(mine.select("requirement_id", "sources").dropDuplicates(["requirement_id"]).select("requirement_id", F.posexplode("sources").alias("at", "s")).select("requirement_id", "at", "s.source_id", "s.locator", F.col("s.sha256").alias("pin")))
    status = written(endpoints.resolved_citations(cited, documents, pages, keys))
    say = lambda kind, *parts: (F.lit(kind).alias("kind"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("description"))
    c = F.col
    trouble = status.where("status <> 'resolved'").select("requirement_id", F.when(c("status") == "stale", "stale_hash").otherwise("dangling_reference").alias("kind"), F.concat("requirement_id", F.lit(" cites "), "source_id", F.lit(" "), "locator", F.lit(": "), "status").alias("description"))
    of_docs = status.where("status in ('resolved', 'stale', 'dangling')").select("requirement_id", "source_id").distinct().join(documents.select("source_id", "version", "precedence", "authority"), "source_id")
    ties = of_docs.groupBy("requirement_id", "version", "precedence").agg(F.array_sort(F.collect_set("source_id")).alias("ss"), F.array_sort(F.collect_set("authority")).alias("aa")).where("size(aa) > 1")
    ties = ties.select("requirement_id", *say("precedence_tie", c("requirement_id"), ": ", F.array_join("ss", ", "), " of ", c("version"), " share precedence ", c("precedence").cast("string"), " but are ", F.array_join("aa", " and ")))
    declared = endpoints.conflict_pairs(requirements).select("requirement_id", "kind", F.concat("requirement_id", F.when(c("kind") == "declared", " and ").otherwise(" names "), F.col("other_id"), F.when(c("kind") == "declared", " are declared to conflict").otherwise(", which there is none of")).alias("description"))
    by_need = links.select("ask_id", "requirement_id").join(trouble.unionByName(ties).unionByName(declared), "requirement_id").select("ask_id", "kind", "description")
    same = ops.select("version", "method", "path", c("source_id").alias("other"), c("sha256").alias("other_sha"))
    twice = found.where("found").join(same, ["version", "method", "path"]).where("other <> source_id and not (other_sha <=> sha256)").groupBy("ask_id", "method", "path", "source_id").agg(F.array_sort(F.collect_set("other")).alias("others"))
    twice = twice.select("ask_id", *say("duplicate_definition", "operation ", c("method"), " ", c("path"), " is defined otherwise by ", F.array_join("others", ", "), " than by ", c("source_id")))
    undefined = found.where("not found").join(links.select("ask_id").distinct(), "ask_id").select("ask_id", *say("dangling_reference", "requirements name ", c("method"), " ", c("asked_path"), ", which no operation of ", c("version"), " defines"))
    conflicts = by_need.unionByName(twice).unionByName(undefined).distinct()
    conflicts = conflicts.withColumn("nth", F.row_number().over(W.partitionBy("ask_id").orderBy("kind", "description")))

    @cache
    def schemas() -> DataFrame:
        """Schemas that the operation refers to, in order; operations of a source that refer to the same have one closure."""
        asks = found.where("found").select("ask_id", F.sha2(F.to_json(F.struct("version", "source_id", "referenced_schemas")), 256).alias("root"), "version", "source_id", "referenced_schemas")
        start = asks.drop("ask_id").dropDuplicates(["root"]).select("root", "version", "source_id", F.posexplode("referenced_schemas").alias("position", "name"))
        reached = graph.ordered_closure(start, definitions, refs)
        reached = written(reached.join(definitions.groupBy("source_id", "version", "name").agg(F.max("sha256").alias("sha256")), ["source_id", "version", "name"], "left"))
        return reached.join(asks.select("ask_id", "root"), "root").drop("root")

    @cache
    def related() -> DataFrame:
        """Texts that are related: one search for all."""
        asking = written(found.select("ask_id", c("version").alias("of"), search.related_terms(question(found)).alias("terms")))
        near = search.best(records.select("record_id", c("version").alias("of"), "content"), "record_id", "content", asking, "ask_id", "terms", max(3 * limit, limit + 10), "of")
        near = near.join(records.drop("content"), "record_id")
        near = written(near.select(c("ask_id").alias("q"), "rank", c("record_id").alias("key_id"), "version", "sha256", "source_id", "page", "locator", F.lit("chunk").alias("record_type"), "score"))
        kept = search.collapse_hits(near.drop("score"), limit).where("kept_by = rank").select("q", "rank")
        return written(near.join(kept, ["q", "rank"]).withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("rank"))).select(c("q").alias("ask_id"), "rank", c("key_id").alias("record_id"), "source_id", "locator", "sha256", "score"))

    told = links.select("ask_id").distinct().withColumn("curated", F.lit(True))
    out = found.join(told, "ask_id", "left").select("ask_id", "version", "method", "asked_path", "found", "source_id", "path", "matched_by", "ambiguous", "others", F.when(~c("found") & c("curated").isNull(), "not_found").alias("error"))
    known = out.where("error is null").select("ask_id")
    role = lambda r: (F.lit(r).alias("role"), F.lit(_ROLES.index(r)).alias("turn"))
    first = lambda *order: F.to_json(F.array(*order)).alias("place")
    pad = lambda n: F.lpad(n.cast("string"), 10, "0")

    def citations() -> DataFrame:
        rows = found.where("found").select("ask_id", *role(_ROLES[0]), first(F.lit("")), "source_id", "locator", "sha256")
        rows = rows.unionByName(schemas().where("not unresolved").select("ask_id", *role(_ROLES[1]), first(c("name")), "source_id", F.concat(F.lit("schema:"), "name").alias("locator"), "sha256"))
        rows = rows.unionByName(links.select("ask_id", "requirement_id").join(status, "requirement_id").select("ask_id", *role(_ROLES[2]), first(c("requirement_id"), pad(c("at"))), "source_id", "locator", "sha256"))
        rows = rows.unionByName(related().select("ask_id", *role(_ROLES[3]), first(pad(c("rank"))), "source_id", "locator", "sha256"))
        return first_of_each(rows.join(known, "ask_id", "left_semi"), ["ask_id"], ["role", "source_id", "locator", "sha256"], ["turn", "place"]).drop("turn", "place")

    sources = status.select("requirement_id", "at", "source_id", "locator", "pin", "status", "sha256")
    conflicts = conflicts.join(known, "ask_id", "left_semi")
    return Bundles({
        "endpoints": lambda: out, "schemas": schemas, "requirements": lambda: links, "sources": lambda: sources,
        "related": lambda: related().join(known, "ask_id", "left_semi"), "conflicts": lambda: conflicts, "citations": citations})
