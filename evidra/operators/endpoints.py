"""Endpoints across versions: canonical lookup, requirement links, structural differences. Facts only, no verdict."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators.pages import first_by
from evidra.sources.tables import written


def keyed(ops: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """ops with path_key: the path without its own version's prefix, else without another's."""
    own = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])[F.col("version")] if prefixes else F.lit("")
    key = T.path_key(F.col("path"), F.coalesce(own, F.lit("")))
    for other in prefixes.values():
        key = F.when(key == T.path_key(F.col("path")), T.path_key(F.col("path"), other)).otherwise(key)
    return ops.withColumn("path_key", key)


def lookup(asked: DataFrame, ops: DataFrame, documents: DataFrame) -> DataFrame:
    """The operation that each of asked(ask_id, version, method, path, path_key) means.

    Same version, method and key; the best template score wins, then the source's precedence, then its id. others: how
    many more sources define the same path; ambiguous: another path scores as well."""
    candidates = ops.join(documents.select("source_id", "precedence"), "source_id")
    a = asked.select("ask_id", "version", "method", F.col("path").alias("asked_path"), "path_key")
    met = a.join(candidates, ["version", "method", "path_key"]).withColumn("score", T.template_score(F.col("path"), F.col("asked_path")))
    ask = W.partitionBy("ask_id")
    met = met.withColumn("best", F.max("score").over(ask)).withColumn("best_paths", F.size(F.collect_set(F.when(F.col("score") == F.col("best"), F.col("path"))).over(ask)))
    met = met.withColumn("same_path", F.count(F.lit(1)).over(W.partitionBy("ask_id", "path")))
    top = first_by(met, ["ask_id"], F.desc("score"), F.desc("precedence"), "source_id")
    return top.withColumn("others", F.col("same_path") - 1).withColumn("ambiguous", F.col("best_paths") > 1).withColumn("matched_by", F.when(F.col("score") == 3, "exact").otherwise("canonical")).drop("best", "best_paths", "same_path")


def lookup_many(asked: DataFrame, ops: DataFrame, documents: DataFrame) -> DataFrame:
    """As lookup(), for tables in which a key is defined and asked for by very many: what each (version, method, key, asked path)
    means is found once, from one row a path, and then told to all who ask."""
    ranked = ops.join(documents.select("source_id", "precedence"), "source_id")
    best = F.min(F.struct((-F.col("precedence")).alias("p"), F.col("source_id").alias("source_id")))
    paths = ranked.groupBy("version", "method", "path_key", "path").agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
    questions = asked.select("version", "method", F.col("path").alias("asked_path"), "path_key").distinct()
    met = questions.join(paths, ["version", "method", "path_key"]).withColumn("score", T.template_score(F.col("path"), F.col("asked_path")))
    key = ["version", "method", "path_key", "asked_path"]
    met = met.withColumn("best", F.max("score").over(W.partitionBy(*key))).where("score = best")
    met = met.withColumn("paths", F.count(F.lit(1)).over(W.partitionBy(*key)))
    top = first_by(met, key, "b", "path")
    answer = top.select(*key, "path", F.col("b.source_id").alias("source_id"), "score", (F.col("n") - 1).alias("others"), (F.col("paths") > 1).alias("ambiguous"), F.when(F.col("score") == 3, "exact").otherwise("canonical").alias("matched_by"))
    return asked.select("ask_id", "version", "method", "path_key", F.col("path").alias("asked_path")).join(answer, key)


def requirement_links(requirements: DataFrame, ops: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(requirement_id, source_id, method, path, via) from requirements(id, version, endpoints, locators): declared
    endpoints, operation locators (under either name) and path locators, which hold for any method."""
    declared = requirements.select("id", "version", F.explode("endpoints").alias("e")).select("id", "version", T.method(F.regexp_extract("e", r"^\s*(\S+)\s", 1)).alias("method"), F.regexp_extract("e", r"\s(\S+)\s*$", 1).alias("path"), F.lit("endpoint").alias("via"))
    cited = requirements.select("id", "version", F.explode("locators").alias("l")).withColumn("p", T.locator(F.col("l"))).where("p.kind in ('operation', 'path')").select("id", "version", "p.method", F.col("p.value").alias("path"), F.when(F.col("p.kind") == "operation", "source_operation").otherwise("source_path").alias("via"))
    links = keyed(declared.unionByName(cited), prefixes).withColumnRenamed("path", "wanted").withColumnRenamed("method", "wanted_method")
    met = links.join(ops, ["version", "path_key"]).where("wanted_method is null or wanted_method = method")
    best = met.withColumn("score", T.template_score(F.col("wanted"), F.col("path"))).withColumn("best", F.max("score").over(W.partitionBy("id", "wanted", "version", "path_key")))
    only = best.withColumn("paths", F.size(F.collect_set("path").over(W.partitionBy("id", "wanted", "version", "path_key"))))
    held = only.where("paths = 1 or (score > 0 and score = best)")  # a template that fits another one better isn't meant
    return held.groupBy(F.col("id").alias("requirement_id"), "source_id", "version", "method", "path").agg(F.array_sort(F.collect_set("via")).alias("via"))


def conflict_pairs(requirements: DataFrame) -> DataFrame:
    """(requirement_id, other_id, kind) of declared conflicts in both directions; dangling_reference where there is no
    such requirement. Conflicts are told, never resolved."""
    declared = requirements.select("id", F.explode("conflicts_with").alias("other")).where("id <> other")
    both = declared.union(declared.select("other", "id")).distinct().toDF("requirement_id", "other_id")
    known = requirements.select(F.col("id").alias("other_id"), F.lit(True).alias("known"))
    return both.join(requirements.select(F.col("id").alias("requirement_id")), "requirement_id", "left_semi").join(known, "other_id", "left").select("requirement_id", "other_id", F.when(F.col("known"), "declared").otherwise("dangling_reference").alias("kind"))


def beginnings(section: Column) -> Column:
    """What a section can be named by: its beginnings that end before a point, a space or a slash, and itself."""
    ends = F.filter(F.sequence(F.lit(1), F.length(section)), lambda i: (i == F.length(section)) | F.substr(section, i + 1, F.lit(1)).isin(".", " ", "/"))
    return F.transform(ends, lambda i: F.substr(section, F.lit(1), i))


def locator_keys(chunks: DataFrame, operations: DataFrame, schemas: DataFrame) -> DataFrame:
    """(source_id, kind, key, sha256): all that section, chunk, operation, path and schema locators can name; a section under
    each of its beginnings that end before a point, a space or a slash."""
    none = F.lit(None).cast("string").alias("sha256")
    sections = chunks.where("section is not null and section <> ''").select("source_id", F.lit("section").alias("kind"), F.explode(beginnings(F.col("section"))).alias("key"), none)
    named = chunks.select("source_id", F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    ops = operations.select("source_id", F.lit("operation").alias("kind"), F.concat_ws(" ", "method", "path").alias("key"), "sha256")
    paths = operations.select("source_id", F.lit("path").alias("kind"), F.col("path").alias("key"), none)
    parts = schemas.select("source_id", F.lit("schema").alias("kind"), F.col("name").alias("key"), "sha256")
    all_ = sections.unionByName(named).unionByName(ops).unionByName(paths).unionByName(parts)
    return all_.groupBy("source_id", "kind", "key").agg(F.max("sha256").alias("sha256"))


def resolved_citations(citations: DataFrame, documents: DataFrame, pages: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """citations(requirement_id, source_id, locator, pin, …) with status unknown_source, unavailable, dangling, stale or
    resolved, and the sha256 of what is cited. Pages are looked up; given locator_keys, so are sections, chunks, operations,
    paths and schemas, which else count as found."""
    c = citations.withColumn("l", T.locator(F.col("locator"))).join(documents.select("source_id", F.col("status").alias("doc_status"), F.col("sha256").alias("doc_sha"), F.lit(True).alias("known")), "source_id", "left")
    p = pages.select("source_id", F.col("page").alias("first"), F.col("sha256").alias("page_sha"))
    c = c.withColumn("first", F.col("l.first")).join(p, ["source_id", "first"], "left").withColumn("kind", F.col("l.kind"))
    c = c.withColumn("key", F.when(F.col("kind") == "operation", F.concat_ws(" ", "l.method", "l.value")).when(F.col("kind").isin("section", "chunk", "path", "schema"), F.col("l.value")))
    if keys is None:
        c = c.withColumn("key_sha", F.lit(None).cast("string")).withColumn("held", F.lit(True))
    else:
        c = c.join(keys.select("source_id", "kind", "key", F.col("sha256").alias("key_sha"), F.lit(True).alias("held")), ["source_id", "kind", "key"], "left")
    sha = F.when(F.col("first").isNotNull(), F.col("page_sha")).otherwise(F.coalesce("key_sha", "doc_sha"))
    lost = F.col("kind").isNull() | (F.col("first").isNotNull() & F.col("page_sha").isNull()) | (F.col("key").isNotNull() & F.col("held").isNull())
    status = (
        F.when(F.col("known").isNull(), "unknown_source").when(F.col("doc_status").isin("missing", "failed"), "unavailable")
        .when(lost, "dangling").when(F.col("pin").isNotNull() & ~F.coalesce(sha.startswith(F.lower("pin")), F.lit(True)), "stale").otherwise("resolved")
    )
    return c.withColumn("status", status).select(*citations.columns, "status", F.when(F.col("status").isin("resolved", "stale"), sha).alias("sha256"))


def source_status(citations: DataFrame, documents: DataFrame, pages: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """citations(requirement_id, source_id, locator, pin) with their status, as in resolved_citations."""
    return resolved_citations(citations, documents, pages, keys).select("requirement_id", "source_id", "locator", "pin", "status")


# --- differences


def changes(old: DataFrame, new: DataFrame, key: list[str], compared: list[str], area: str) -> DataFrame:
    """(key…, area, change, before, after): rows of two versions by key; compared columns decide on modified."""
    pack = lambda d, n: d.select(*key, F.to_json(F.struct(*compared), {"ignoreNullFields": "false"}).alias(n))
    d = pack(old, "before").join(pack(new, "after"), key, "full")
    changed = T.change(F.col("before"), F.col("after"))
    return d.select(*key, F.lit(area).alias("area"), changed.alias("change"), F.when(changed != "unchanged", F.col("before")).alias("before"), F.when(changed != "unchanged", F.col("after")).alias("after"))


def parameter_key(location: Column, name: Column, path: Column) -> Column:
    """Path parameters go by their place in the template, headers by their lower-cased name."""
    place = F.array_position(T.template_params(path), name)
    return F.when((location == "path") & (place > 0), F.concat(F.lit("path:#"), (place - 1).cast("string"))).when(location == "header", F.concat(F.lit("header:"), F.lower(name))).otherwise(F.concat(location, F.lit(":"), name))


def compare(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """All changes between two versions' tables operations, parameters, responses and media, by (method, path_key)."""
    e = ["method", "path_key"]
    ops = changes(old["operations"], new["operations"], e, ["operation_id", "deprecated", "tags", "security"], "operation").withColumn("item", F.lit(""))
    pk = lambda d: d.withColumn("item", parameter_key(F.col("location"), F.col("name"), F.col("path")))
    params = changes(pk(old["parameters"]), pk(new["parameters"]), [*e, "item"], ["name", "required", "deprecated", "schema"], "parameter")
    status = lambda d: d.withColumn("item", F.col("status")).withColumn("names", F.array_sort(F.transform("headers", F.lower)))
    answers = changes(status(old["responses"]), status(new["responses"]), [*e, "item"], ["names"], "response")
    media = lambda d: d.withColumn("item", F.concat_ws(" ", "place", "media_type"))
    bodies = changes(media(old["media"]), media(new["media"]), [*e, "item"], ["schema"], "media_type")
    out = [x.select(*e, "area", "item", "change", "before", "after") for x in (ops, params, answers, bodies)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


#: Keys of a schema that are compared as they stand.
CONSTRAINTS = "format minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern minItems maxItems uniqueItems minProperties maxProperties default const readOnly writeOnly".split()


def _facts(node, pointer: str, out: list[tuple[str, str, str]]) -> None:
    """(pointer, kind, value) of a schema's parts."""
    if not isinstance(node, dict):
        return
    add = lambda kind, v: out.append((pointer, kind, json.dumps(v, ensure_ascii=False, sort_keys=True)))
    if "$ref" in node:
        return add("ref", node["$ref"])
    kinds = node.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    add("type", sorted(set(kinds) - {"null"}))
    add("nullable", bool(node.get("nullable")) or "null" in kinds)
    for v in node.get("enum") or []:
        out.append((pointer, "enum:" + json.dumps(v), "true"))
    for k in CONSTRAINTS:
        if k in node:
            add(k, node[k])
    properties = node.get("properties") or {}
    for name in node.get("required") or []:
        out.append((f"{pointer}/properties/{name}", "required", "true"))
    for name, v in properties.items():
        out.append((f"{pointer}/properties/{name}", "property", "true"))
        _facts(v, f"{pointer}/properties/{name}", out)
    if isinstance(node.get("additionalProperties"), bool):
        add("additionalProperties", node["additionalProperties"])
    for k in ("items", "additionalProperties", "not"):
        _facts(node.get(k), f"{pointer}/{k}", out)
    for k in ("allOf", "oneOf", "anyOf"):
        parts = node.get(k)
        if isinstance(parts, list):
            add(f"{k} length", len(parts))
            for i, v in enumerate(parts):
                _facts(v, f"{pointer}/{k}/{i}", out)


def schema_facts(schemas: DataFrame) -> DataFrame:
    """(version, name, pointer, kind, value): schemas(version, name, schema) taken apart; references aren't followed, so
    a circle ends where it closes and each schema is compared once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for version, name, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found: list[tuple[str, str, str]] = []
                _facts(json.loads(text), "", found)
                rows += [(version, name, *f) for f in dict.fromkeys(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], names=["version", "name", "pointer", "kind", "value"])

    return schemas.select("version", "name", "schema").mapInArrow(run, "version string, name string, pointer string, kind string, value string")


def schema_changes(schemas: DataFrame, old: str, new: str) -> DataFrame:
    """(name, pointer, kind, change, before, after) of schemas that both versions have."""
    f = written(schema_facts(schemas))
    shared = schemas.where(F.col("version") == old).select("name").intersect(schemas.where(F.col("version") == new).select("name"))
    side = lambda v, n: f.where(F.col("version") == v).join(shared, "name", "left_semi").select("name", "pointer", "kind", F.col("value").alias(n))
    d = side(old, "before").join(side(new, "after"), ["name", "pointer", "kind"], "full")
    return d.withColumn("change", T.change(F.col("before"), F.col("after"))).where("change <> 'unchanged'").select("name", "pointer", "kind", "change", "before", "after")


def sentences(changed: DataFrame) -> DataFrame:
    """changed with one plain sentence for each change."""
    what = F.concat(F.upper(F.substring("area", 1, 1)), F.replace(F.substring("area", 2, 100), F.lit("_"), F.lit(" ")), F.when(F.col("item") != "", F.concat(F.lit(" "), "item")).otherwise(""), F.lit(" was "), "change")
    return changed.where("change <> 'unchanged'").withColumn("fact", F.concat(what, F.when(F.col("change") == "modified", F.concat(F.lit(": "), F.substring("before", 1, 160), F.lit(" -> "), F.substring("after", 1, 160))).otherwise(""), F.lit(".")))
