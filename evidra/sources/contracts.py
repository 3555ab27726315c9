"""API contracts as tables: files are read and hashed by Spark, YAML becomes JSON one file at a time, and all that follows
is exploded, joined and ranked as DataFrames, JSON texts keeping their source's key order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators.pages import first_by
from evidra.sources.tables import written

MAX_REFS = 16
_MAP, _LIST = "map<string,string>", "array<string>"


def _to_json(raw: bytes, path: str) -> tuple[str | None, str | None]:
    try:
        if path.endswith(".json"):
            root = json.loads(raw)
        else:
            import yaml

            class Loader(yaml.SafeLoader):  # dates stay as they are written
                yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

            root = yaml.load(raw, Loader)
        if not isinstance(root, dict):
            return None, "root_not_a_mapping"
        return json.dumps(root, separators=(",", ":"), ensure_ascii=False), None
    except Exception as e:  # a broken file is a row with an error, not a failed run
        return None, f"parse_failed: {type(e).__name__}"


def read(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, size_bytes, sha256, json, error) of contract files."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_to_json(raw, path) for path, raw in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([j for j, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["path", "size_bytes", "sha256", "json", "error"])

    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content").mapInArrow(parse, "path string, size_bytes long, sha256 string, json string, error string")


def parsed(sources: DataFrame) -> DataFrame:
    """(source_id, version, json, error) of sources(source_id, version, text) that are contracts, JSON or YAML; a dialect that
    isn't supported is an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_to_json(t.encode(), ".json" if t.lstrip()[:1] == "{" else ".yaml") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([j for j, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["source_id", "version", "json", "error"])

    rows = sources.where("text is not null").select("source_id", "version", "text").mapInArrow(parse, "source_id string, version string, json string, error string")
    return rows.withColumn("error", F.coalesce("error", F.when(dialect(F.col("json")).isNull(), "unsupported_dialect")))


def dialect(root: Column) -> Column:
    """3.0, 3.1, or null for what isn't supported."""
    v = F.get_json_object(root, "$.openapi")
    return F.when(v.startswith("3.0"), "3.0").when(v.startswith("3.1") | v.startswith("3.2"), "3.1")


def _entries(c: Column, path: str) -> Column:
    return F.map_entries(F.from_json(F.get_json_object(c, path), _MAP))


def pointed(contracts: DataFrame) -> DataFrame:
    """(source_id, pointer, json): what every local reference of a contract points at, wherever that stands; one row a
    reference, none for those that lead nowhere. Segments of digits are keys of a mapping or places in a list."""
    refs = contracts.select("source_id", F.explode(F.array_distinct(F.regexp_extract_all("json", F.lit(r'"\$ref"\s*:\s*"(#/[^"]+)"'), 1))).alias("pointer"))
    steps = F.transform(F.slice(F.split("pointer", "/"), 2, 1 << 30), lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    path = lambda step: F.concat(F.lit("$"), F.array_join(F.transform(steps, step), ""))
    key = lambda s: F.concat(F.lit("['"), s, F.lit("']"))
    rows = refs.withColumns({"keys": path(key), "places": path(lambda s: F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(key(s)))})
    got = rows.join(contracts.select("source_id", "json"), "source_id").select("source_id", "pointer", F.expr("coalesce(get_json_object(json, keys), get_json_object(json, places))").alias("json"))
    return got.where("json is not null")


def components(contracts: DataFrame) -> DataFrame:
    """(source_id, pointer, json): components, and all else that local references point at, by JSON pointer, references
    followed up to MAX_REFS times; those that lead nowhere or in a circle are left out."""
    parts = contracts.select("source_id", F.explode(_entries(F.col("json"), "$.components")).alias("s")).select("source_id", F.col("s.key").alias("section"), F.explode(F.map_entries(F.from_json("s.value", _MAP))).alias("c"))
    all_ = parts.select("source_id", F.concat(F.lit("#/components/"), "section", F.lit("/"), T.pointer_escape(F.col("c.key"))).alias("pointer"), F.col("c.value").alias("json"))
    all_ = written(all_)
    all_ = written(all_.unionByName(pointed(contracts).join(all_.select("source_id", "pointer"), ["source_id", "pointer"], "left_anti")))
    found = all_.withColumn("ref", F.get_json_object("json", "$.$ref"))
    target = all_.select("source_id", F.col("pointer").alias("ref"), F.col("json").alias("target"))
    done, open_ = found.where("ref is null").select("source_id", "pointer", "json"), found.where("ref is not null").select("source_id", "pointer", "ref")
    for _ in range(MAX_REFS):
        step = written(open_.join(target, ["source_id", "ref"]).select("source_id", "pointer", F.col("target").alias("json"), F.get_json_object("target", "$.$ref").alias("ref")))
        done = done.unionByName(step.where("ref is null").select("source_id", "pointer", "json"))
        open_ = step.where("ref is not null").select("source_id", "pointer", "ref")
        if open_.isEmpty():
            break
    return written(done)


def deref(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows(source_id, json, …) with references replaced by what they lead to; ref: the reference; unresolved: whether it
    leads nowhere (external ones do)."""
    r = rows.withColumn("ref", F.get_json_object("json", "$.$ref"))
    p = parts.select("source_id", F.col("pointer").alias("ref"), F.col("json").alias("__to"))
    return r.join(p, ["source_id", "ref"], "left").withColumn("unresolved", F.col("ref").isNotNull() & F.col("__to").isNull()).withColumn("json", F.coalesce("__to", F.when(F.col("ref").isNull(), F.col("json")))).drop("__to")


def operations(contracts: DataFrame) -> DataFrame:
    """One row per operation of contracts(source_id, version, json), with its identity, texts and security."""
    paths = contracts.where(dialect(F.col("json")).isNotNull()).select("source_id", "version", F.get_json_object("json", "$.security").alias("root_security"), F.explode(_entries(F.col("json"), "$.paths")).alias("p"))
    paths = paths.where(~F.col("p.key").startswith("x-") & T.valid_path(F.col("p.key"))).select("source_id", "version", "root_security", F.col("p.key").alias("path"), F.from_json("p.value", _MAP).alias("item"))
    ops = paths.select("*", F.explode(F.map_entries("item")).alias("o")).where(F.upper("o.key").isin(*T.METHODS) & (F.lower("o.key") == F.col("o.key")))
    j = F.col("operation")
    o = ops.select("source_id", "version", F.upper("o.key").alias("method"), "path", F.col("o.value").alias("operation"), F.col("item")["parameters"].alias("path_parameters"), "root_security")
    get = lambda f: F.get_json_object(j, f"$.{f}")
    own = get("security")
    return o.select(
        "source_id", "version", "method", "path", "operation", "path_parameters",
        get("operationId").alias("operation_id"), get("summary").alias("summary"), get("description").alias("description"),
        F.coalesce(F.from_json(get("tags"), _LIST), F.array().cast(_LIST)).alias("tags"), F.coalesce(get("deprecated") == "true", F.lit(False)).alias("deprecated"),
        F.coalesce(own, "root_security").alias("security"), F.when(own.isNotNull(), "operation").when(F.col("root_security").isNotNull(), "global").otherwise("none").alias("security_origin"),
        T.schema_refs(j).alias("referenced_schemas"), F.concat(F.lit("op:"), "method", F.lit(" "), "path").alias("locator"),
        F.concat(F.lit("/paths/"), T.pointer_escape(F.col("path")), F.lit("/"), F.lower("method")).alias("json_pointer"),
        F.sha2(F.concat(F.lit('{"path_item_parameters":'), F.coalesce("path_parameters", F.lit("null")), F.lit(',"operation":'), j, F.lit("}")).cast("binary"), 256).alias("sha256"),
    )


_OP = ["source_id", "version", "method", "path"]


def parameters(ops: DataFrame, parts: DataFrame) -> DataFrame:
    """Each operation's parameters: the path's, then its own; its own replace the path's of equal name and place, where
    these stood."""
    level = lambda c, n: F.transform(F.coalesce(F.from_json(c, _LIST), F.array().cast(_LIST)), lambda x, i: F.struct(F.lit(n).alias("level"), i.alias("i"), x.alias("json")))
    both = F.concat(level(F.col("path_parameters"), 0), level(F.get_json_object("operation", "$.parameters"), 1))
    rows = deref(ops.select(*_OP, F.explode(both).alias("x")).select(*_OP, "x.*"), parts).where("json is not null")
    get = lambda f: F.get_json_object("json", f"$.{f}")
    content = F.from_json(get("content"), _MAP)
    p = rows.select(*_OP, "level", "i", get("name").alias("name"), get("in").alias("location"), F.coalesce(get("required") == "true", get("in") == "path").alias("required"), F.coalesce(get("deprecated") == "true", F.lit(False)).alias("deprecated"), get("description").alias("description"), F.coalesce(get("schema"), F.get_json_object(F.element_at(F.map_values(content), 1), "$.schema")).alias("schema"), F.col("ref").alias("component")).where("name is not null")
    p = p.withColumn("position", F.min(F.struct("level", "i")).over(W.partitionBy(*_OP, "name", "location")))
    return first_by(p, [*_OP, "name", "location"], F.desc("level"), "i").drop("level", "i")


def responses(ops: DataFrame, parts: DataFrame) -> DataFrame:
    """(operation, status, description, content, headers, error) of each response; headers are sorted names. A response whose
    reference leads nowhere stays, with an error."""
    rows = ops.select(*_OP, F.explode(_entries(F.col("operation"), "$.responses")).alias("r")).where(~F.col("r.key").startswith("x-")).select(*_OP, F.col("r.key").alias("status"), F.col("r.value").alias("json"))
    d = deref(rows, parts)
    headers = F.array_sort(F.map_keys(F.from_json(F.get_json_object("json", "$.headers"), _MAP)))
    return d.select(*_OP, "status", F.get_json_object("json", "$.description").alias("description"), F.from_json(F.get_json_object("json", "$.content"), _MAP).alias("content"), F.coalesce(headers, F.array().cast(_LIST)).alias("headers"), F.when(F.col("unresolved"), F.concat(F.lit("unresolved_reference: "), "ref")).alias("error"))


def media_types(ops: DataFrame, parts: DataFrame) -> DataFrame:
    """(operation, place, media_type, schema): place is requestBody or a response's status."""
    body = deref(ops.select(*_OP, F.get_json_object("operation", "$.requestBody").alias("json")).where("json is not null"), parts).where("json is not null").select(*_OP, F.lit("requestBody").alias("place"), F.from_json(F.get_json_object("json", "$.content"), _MAP).alias("content"))
    both = body.unionByName(responses(ops, parts).select(*_OP, F.col("status").alias("place"), "content"))
    return both.select(*_OP, "place", F.explode(F.map_entries("content")).alias("m")).select(*_OP, "place", F.col("m.key").alias("media_type"), F.get_json_object("m.value", "$.schema").alias("schema"))


def schemas(contracts: DataFrame) -> DataFrame:
    """(source_id, version, name, schema, referenced_schemas, sha256, json_pointer)."""
    rows = contracts.select("source_id", "version", F.explode(_entries(F.col("json"), "$.components.schemas")).alias("s"))
    return rows.select("source_id", "version", F.col("s.key").alias("name"), F.col("s.value").alias("schema"), T.schema_refs(F.col("s.value")).alias("referenced_schemas"), F.sha2(F.col("s.value").cast("binary"), 256).alias("sha256"), F.concat(F.lit("/components/schemas/"), T.pointer_escape(F.col("s.key"))).alias("json_pointer"))


def metadata(contracts: DataFrame) -> DataFrame:
    """One row per contract: versions, title, servers, tags, security schemes and counts."""
    get = lambda f: F.get_json_object("json", f)
    size = lambda f: F.coalesce(F.size(F.map_keys(F.from_json(get(f), _MAP))), F.lit(0))
    names = lambda f, k: F.transform(F.coalesce(F.from_json(get(f), _LIST), F.array().cast(_LIST)), lambda x: F.get_json_object(x, f"$.{k}"))
    return contracts.select("source_id", "version", get("$.openapi").alias("openapi"), get("$.info.title").alias("title"), get("$.info.version").alias("api_version"), names("$.servers", "url").alias("servers"), names("$.tags", "name").alias("tags"), F.array_sort(F.coalesce(F.map_keys(F.from_json(get("$.components.securitySchemes"), _MAP)), F.array().cast(_LIST))).alias("security_schemes"), size("$.components.schemas").alias("schema_count"), size("$.paths").alias("path_count"))


def search_text(ops: DataFrame, params: DataFrame, answers: DataFrame) -> DataFrame:
    """(operation, title, content, identifiers) for the search index."""
    answers = answers.where("error is null")
    p = params.groupBy(*_OP).agg(F.array_sort(F.collect_list(F.struct("position", "name", "location", "required", "description"))).alias("ps"))
    r = answers.groupBy(*_OP).agg(F.array_sort(F.collect_list(F.struct("status", "description", "headers"))).alias("rs"))
    x = ops.join(p, _OP, "left").join(r, _OP, "left")
    lines = F.concat(
        F.array(F.concat_ws(" ", "method", "path"), F.concat(F.lit("operationId: "), "operation_id"), F.col("summary"), F.col("description"), F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", ")))),
        F.coalesce(F.transform("ps", lambda q: F.concat(F.lit("Parameter "), q["name"], F.lit(" ("), q["location"], F.when(q["required"], ", required)").otherwise(", optional)"), F.coalesce(F.concat(F.lit(": "), q["description"]), F.lit("")))), F.array().cast(_LIST)),
        F.coalesce(F.transform("rs", lambda q: F.concat(F.lit("Response "), q["status"], F.coalesce(F.concat(F.lit(": "), q["description"]), F.lit("")))), F.array().cast(_LIST)),
        F.array(F.when(F.size("referenced_schemas") > 0, F.concat(F.lit("Schemas: "), F.array_join("referenced_schemas", ", ")))),
    )
    ids = F.concat(F.array("path", F.concat_ws(" ", "method", "path"), "operation_id"), F.coalesce(F.transform("ps", lambda q: q["name"]), F.array().cast(_LIST)), F.coalesce(F.flatten(F.transform("rs", lambda q: q["headers"])), F.array().cast(_LIST)))
    return x.select(*_OP, F.concat_ws(" ", "method", "path", F.coalesce("summary", "operation_id")).alias("title"), F.array_join(F.filter(lines, lambda l: l.isNotNull()), "\n").alias("content"), F.array_distinct(F.transform(F.filter(ids, lambda i: i.isNotNull()), F.lower)).alias("identifiers"))


#: The keys of a schema whose texts are searched.
SPOKEN = frozenset("description title enum format type pattern $ref".split())


def _spoken(node, key: str | None) -> Iterator[str]:
    """The lines that a schema's part says, in its order; items of a list stand for the list's key."""
    if isinstance(node, str):
        if key in SPOKEN:
            yield node
    elif isinstance(node, list):
        for part in node:
            yield from _spoken(part, key)
    elif isinstance(node, dict):
        for k, part in node.items():
            if k != "properties":
                yield from _spoken(part, k)
            elif isinstance(part, dict):
                for name, said in part.items():
                    yield f"property {name}"
                    yield from _spoken(said, None)


def schema_text(named: DataFrame) -> DataFrame:
    """named(source_id, version, name, schema, …) with title and content for the search index; a schema that is no JSON has
    its name alone."""

    @F.pandas_udf("string")
    def lines(schemas: pd.Series) -> pd.Series:
        def said(text: str | None) -> str:
            try:
                return "".join(f"{line}\n" for line in _spoken(json.loads(text or "null"), None))
            except ValueError:
                return ""

        return schemas.map(said)

    title = F.concat(F.lit("Schema "), "name")
    return named.withColumn("title", title).withColumn("content", F.concat(title, F.lit("\n"), lines("schema")))
