"""Registered queries that put the given tables into API contracts and requirements, and ask the library about them.

Each page is one small contract: its host is the authority, its folder the version, its url the path; each part a schema in two
versions; benchmark items and events make requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import endpoints
from evidra.sources import contracts
from evidra.sources.tables import table, written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def page_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, version, json): one contract for each page that has a folder in its path."""
    p = table(spark, sf_dir, "pages").where("url is not null")
    p = p.select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"), (F.col("page_id") % 6).alias("k"))
    p = p.withColumn("version", F.regexp_extract("path", "^/([a-z]+)/", 1)).where("version <> ''")
    i = F.col("page_id").cast("string")
    own = F.struct(F.lit("limit").alias("name"), F.lit("query").alias("in"), (F.col("k") == 1).alias("required"), F.concat(F.lit("at most "), i).alias("description"))
    parameters = F.array(F.to_json(own), F.lit('{"$ref":"#/components/parameters/trace"}'))
    operation = F.concat(
        F.lit('{"operationId":"read'), i, F.lit('","summary":"Read page '), i, F.lit('","deprecated":'), (F.col("k") == 2).cast("string"), F.lit(',"tags":["'), "version", F.lit('","k'), F.col("k").cast("string"), F.lit('"],'),
        F.when(F.col("k") == 3, '"security":[{"key":[]}],').otherwise(""), F.lit('"parameters":['), F.array_join(parameters, ","), F.lit('],"responses":{"200":{"description":"page '), i,
        F.lit('","headers":{"X-Trace":{},"ETag":{}},"content":{"text/html":{"schema":{"$ref":"#/components/schemas/Page'), F.col("k").cast("string"), F.lit('"}}}},"404":{"$ref":"#/components/responses/missing"},"410":{"$ref":"#/components/responses/nowhere"}}}'),
    )
    shared = '"components":{"parameters":{"trace":{"$ref":"#/components/parameters/traceId"},"traceId":{"name":"X-Trace","in":"header","required":true}},"responses":{"missing":{"description":"no such page"}},"schemas":{'
    schemas = F.concat(F.lit('"Page'), F.col("k").cast("string"), F.lit('":{"type":"object","properties":{"next":{"$ref":"#/components/schemas/Link"}}},"Link":{"type":"string"}'))
    path = F.concat(F.lit('"paths":{"'), "path", F.lit('":{"'), F.when(F.col("k") == 4, "post").otherwise("get"), F.lit('":'), operation, F.lit(',"parameters":[{"name":"limit","in":"query","description":"shared"},{"name":"lang","in":"query"}]}}'))
    json = F.concat(F.lit('{"openapi":"3.'), (F.col("k") % 2).cast("string"), F.lit('.0","info":{"title":"'), "host", F.lit('","version":"'), i, F.lit('"},'), F.when(F.col("k") == 5, '"security":[{"oauth":[]}],').otherwise(""), path, F.lit(","), F.lit(shared), schemas, F.lit("}}}"))
    return p.select(F.concat(F.lit("page-"), i).alias("source_id"), "version", json.alias("json"))


_PAGES = r"""
raw AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, page_id % 6 AS k FROM pages WHERE url IS NOT NULL),
p AS (SELECT *, 'page-' || page_id AS source_id, regexp_extract(path, '^/([a-z]+)/', 1) AS version, CASE WHEN k = 4 THEN 'POST' ELSE 'GET' END AS method FROM raw WHERE regexp_extract(path, '^/([a-z]+)/', 1) <> '')
"""


@query(rf"""WITH {_PAGES}
SELECT source_id, version, method, path, 'read' || page_id AS operation_id, 'Read page ' || page_id AS summary, k = 2 AS deprecated, version || ',k' || k AS tags,
  CASE k WHEN 3 THEN 'operation' WHEN 5 THEN 'global' ELSE 'none' END AS security_origin, CASE k WHEN 3 THEN '[{{"key":[]}}]' WHEN 5 THEN '[{{"oauth":[]}}]' END AS security,
  'op:' || method || ' ' || path AS locator, '/paths/' || replace(replace(path, '~', '~0'), '/', '~1') || '/' || lower(method) AS json_pointer, 'Page' || k AS schemas FROM p""")
def contract_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = contracts.operations(page_contracts(spark, sf_dir))
    return ops.select("source_id", "version", "method", "path", "operation_id", "summary", "deprecated", F.array_join("tags", ",").alias("tags"), "security_origin", "security", "locator", "json_pointer", F.array_join("referenced_schemas", ",").alias("schemas"))


def _ops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = written(page_contracts(spark, sf_dir))
    return contracts.operations(c), contracts.components(c)


@query(rf"""WITH {_PAGES}
SELECT source_id, method, path, x.name, x.location, CASE WHEN x.name = 'limit' THEN k = 1 ELSE x.required END AS required, CASE WHEN x.name = 'limit' THEN 'at most ' || page_id END AS description, x.component
FROM p CROSS JOIN (VALUES ('limit', 'query', false, NULL), ('lang', 'query', false, NULL), ('X-Trace', 'header', true, '#/components/parameters/trace')) x(name, location, required, component)""")
def contract_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path's parameters, replaced by the operation's own of equal name and place; references are followed."""
    p = contracts.parameters(*_ops(spark, sf_dir))
    return p.select("source_id", "method", "path", "name", "location", "required", "description", "component")


@query(rf"""WITH {_PAGES}
SELECT source_id, method, path, '200' AS status, 'page ' || page_id AS description, 'ETag,X-Trace' AS headers, NULL AS error FROM p
UNION ALL SELECT source_id, method, path, '404', 'no such page', '', NULL FROM p
UNION ALL SELECT source_id, method, path, '410', NULL, '', 'unresolved_reference: #/components/responses/nowhere' FROM p""")
def contract_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = contracts.responses(*_ops(spark, sf_dir))
    return r.select("source_id", "method", "path", "status", "description", F.array_join("headers", ",").alias("headers"), "error")


@query(rf"""WITH {_PAGES}
SELECT source_id, version, 'Page' || k AS name, 'Link' AS refs, '/components/schemas/Page' || k AS json_pointer FROM p
UNION ALL SELECT source_id, version, 'Link', '', '/components/schemas/Link' FROM p""")
def contract_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = contracts.schemas(page_contracts(spark, sf_dir))
    return s.select("source_id", "version", "name", F.array_join("referenced_schemas", ",").alias("refs"), "json_pointer")


@query(rf"""WITH {_PAGES}
SELECT source_id, 'Schema Page' || k AS title, 'Schema Page' || k || chr(10) || 'object' || chr(10) || 'property next' || chr(10) || '#/components/schemas/Link' || chr(10) AS content FROM p
UNION ALL SELECT source_id, 'Schema Link', 'Schema Link' || chr(10) || 'string' || chr(10) FROM p""")
def schema_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index says of each schema."""
    return contracts.schema_text(contracts.schemas(page_contracts(spark, sf_dir))).select("source_id", "title", "content")


@query(rf"""WITH {_PAGES}
SELECT source_id, version, '3.' || (k % 2) || '.0' AS openapi, host AS title, CAST(page_id AS VARCHAR) AS api_version, CAST(2 AS INT) AS schema_count, CAST(1 AS INT) AS path_count FROM p""")
def contract_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.metadata(page_contracts(spark, sf_dir)).select("source_id", "version", "openapi", "title", "api_version", "schema_count", "path_count")


@query(rf"""WITH {_PAGES},
t AS (SELECT page_id, version, method, host, CASE page_id % 4 WHEN 0 THEN '/{{page_id}}' WHEN 1 THEN '/{{page-id}}' WHEN 2 THEN '/{{id}}' ELSE '/{{pageId}}' END AS path FROM p),
ops AS (SELECT DISTINCT host AS source_id, version, method, path FROM t),
docs AS (SELECT host AS source_id, count(*) AS precedence FROM t GROUP BY host),
asked AS (SELECT page_id AS ask_id, version, method, CASE page_id % 3 WHEN 0 THEN '/{{page_id}}' WHEN 1 THEN '/{{PageId}}' ELSE '/{{id}}' END AS path FROM t),
met AS (SELECT a.ask_id, o.source_id, o.path, d.precedence, CASE WHEN o.path = a.path THEN 3 WHEN lower(replace(replace(o.path, '-', ''), '_', '')) = lower(replace(replace(a.path, '-', ''), '_', '')) THEN 1 ELSE 0 END AS score
  FROM asked a JOIN ops o ON a.version = o.version AND a.method = o.method JOIN docs d ON o.source_id = d.source_id),
best AS (SELECT *, max(score) OVER (PARTITION BY ask_id) AS top, count(*) OVER (PARTITION BY ask_id, path) - 1 AS others FROM met),
paths AS (SELECT ask_id, count(DISTINCT path) AS n FROM best WHERE score = top GROUP BY ask_id)
SELECT b.ask_id, b.source_id, b.path, b.score, b.others, n > 1 AS ambiguous, CASE WHEN b.score = 3 THEN 'exact' ELSE 'canonical' END AS matched_by FROM best b JOIN paths USING (ask_id)
QUALIFY row_number() OVER (PARTITION BY b.ask_id ORDER BY b.score DESC, b.precedence DESC, b.source_id, b.path) = 1""")
def endpoint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's question for an endpoint means: the template whose parameters fit best, then the host with most pages."""
    p = table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*/([a-z]+)/", 1).alias("version"), F.when(F.col("page_id") % 6 == 4, "POST").otherwise("GET").alias("method")).where("version <> ''")
    i = F.col("page_id")
    ops = p.select(F.col("host").alias("source_id"), "version", "method", F.when(i % 4 == 0, "/{page_id}").when(i % 4 == 1, "/{page-id}").when(i % 4 == 2, "/{id}").otherwise("/{pageId}").alias("path")).distinct()
    docs = p.groupBy(F.col("host").alias("source_id")).agg(F.count(F.lit(1)).alias("precedence"))
    asked = p.select(i.alias("ask_id"), "version", "method", F.when(i % 3 == 0, "/{page_id}").when(i % 3 == 1, "/{PageId}").otherwise("/{id}").alias("path"))
    out = endpoints.lookup_many(endpoints.keyed(asked, {}), endpoints.keyed(ops, {}), docs)
    return out.select("ask_id", "source_id", "path", "score", "others", "ambiguous", "matched_by")


@query("""
WITH e AS (SELECT DISTINCT user_id AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) AS b FROM events),
known AS (SELECT DISTINCT user_id FROM events),
pairs AS (SELECT a, b FROM e WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM e WHERE b IS NOT NULL AND a <> b)
SELECT a AS requirement_id, b AS other_id, CASE WHEN b IN (SELECT user_id FROM known) THEN 'declared' ELSE 'dangling_reference' END AS kind FROM pairs WHERE a IN (SELECT user_id FROM known)""")
def conflict_pairs_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are requirements that conflict with the number in their events' JSON."""
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("other"))
    needs = e.groupBy(F.col("user_id").alias("id")).agg(F.collect_set("other").alias("conflicts_with"))
    return endpoints.conflict_pairs(needs)


@query(r"""
WITH d AS (SELECT 'conv-' || conv_id AS source_id, count(*) AS n FROM conversations GROUP BY conv_id),
pg AS (SELECT 'conv-' || conv_id AS source_id, turn AS page, sha256(coalesce(text, '')) AS sha FROM conversations),
c AS (SELECT c.conv_id AS requirement_id, 'conv-' || CASE WHEN conv_id % 7 = 0 THEN conv_id + 100000000 ELSE conv_id END AS source_id, CASE conv_id % 5 WHEN 4 THEN 'bogus:1' ELSE 'page:' || (1 + conv_id % 3) END AS locator, 1 + conv_id % 3 AS page, CASE WHEN conv_id % 2 = 0 THEN substr(sha256(coalesce(text, '')), 1, 8) END AS pin, conv_id % 5 = 4 AS bogus
  FROM conversations c WHERE turn = 1)
SELECT c.requirement_id, c.source_id, c.locator, c.pin, CASE WHEN d.source_id IS NULL THEN 'unknown_source' WHEN c.requirement_id % 11 = 0 THEN 'unavailable' WHEN bogus OR pg.sha IS NULL THEN 'dangling' WHEN pin IS NOT NULL AND NOT starts_with(pg.sha, pin) THEN 'stale' ELSE 'resolved' END AS status
FROM c LEFT JOIN d ON c.source_id = d.source_id LEFT JOIN pg ON pg.source_id = c.source_id AND pg.page = c.page AND NOT bogus""")
def source_status_of_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of turns, some of unknown or missing sources, bad locators, turns that aren't there, or with another turn's hash."""
    v = table(spark, sf_dir, "conversations").withColumn("source_id", F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))).withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    docs = v.groupBy("source_id", "conv_id").agg(F.lit(None).cast("string").alias("sha256")).withColumn("status", F.when(F.col("conv_id") % 11 == 0, "missing").otherwise("indexed"))
    i = F.col("conv_id")
    source = F.concat(F.lit("conv-"), F.when(i % 7 == 0, i + 100000000).otherwise(i).cast("string"))
    cited = v.where("turn = 1").select(i.alias("requirement_id"), source.alias("source_id"), F.when(i % 5 == 4, "bogus:1").otherwise(F.concat(F.lit("page:"), (1 + i % 3).cast("string"))).alias("locator"), F.when(i % 2 == 0, F.substring("sha256", 1, 8)).alias("pin"))
    return endpoints.source_status(cited, docs, v.select("source_id", F.col("turn").alias("page"), "sha256"))


@query(rf"""WITH {_PAGES},
o AS (SELECT host, regexp_replace(path, '^/[a-z]+/', '/') AS key, version, min(page_id) AS page_id FROM p WHERE method = 'GET' GROUP BY 1, 2, 3),
a AS (SELECT * FROM o WHERE version = 'en'), b AS (SELECT * FROM o WHERE version = 'de')
SELECT coalesce(a.host, b.host) AS host, coalesce(a.key, b.key) AS path_key, CASE WHEN a.host IS NULL THEN 'added' WHEN b.host IS NULL THEN 'removed' WHEN a.page_id = b.page_id THEN 'unchanged' ELSE 'modified' END AS change
FROM a FULL JOIN b ON a.host = b.host AND a.key = b.key""")
def operation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes between the English and the German operations of a host, by path without its version."""
    ops = contracts.operations(page_contracts(spark, sf_dir)).where("method = 'GET'")
    meta = contracts.metadata(page_contracts(spark, sf_dir)).select("source_id", F.col("title").alias("host"))
    o = ops.join(meta, "source_id").withColumn("path_key", F.regexp_replace("path", "^/[a-z]+/", "/"))
    o = o.groupBy("host", "path_key", "version").agg(F.min(F.regexp_extract("operation_id", "([0-9]+)", 1).cast("long")).alias("operation"))
    side = lambda v: o.where(F.col("version") == v)
    return endpoints.changes(side("en"), side("de"), ["host", "path_key"], ["operation"], "operation").select("host", "path_key", "change")


_PARTS = r"""
s AS (SELECT 'P' || (p_partkey // 2) AS name, 'v' || (p_partkey % 2) AS version, p_size, p_brand, p_partkey FROM part),
f AS (
  SELECT name, version, '' AS pointer, 'type' AS kind, '["object"]' AS value FROM s UNION ALL SELECT name, version, '', 'nullable', 'false' FROM s
  UNION ALL SELECT name, version, '/properties/size', 'property', 'true' FROM s UNION ALL SELECT name, version, '/properties/size', 'type', '["integer"]' FROM s
  UNION ALL SELECT name, version, '/properties/size', 'nullable', CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'false' END FROM s UNION ALL SELECT name, version, '/properties/size', 'maximum', CAST(p_size AS VARCHAR) FROM s
  UNION ALL SELECT name, version, '/properties/size', 'required', 'true' FROM s WHERE p_size % 2 = 0
  UNION ALL SELECT name, version, '/properties/' || lower(replace(p_brand, '#', '')), 'property', 'true' FROM s UNION ALL SELECT name, version, '/properties/' || lower(replace(p_brand, '#', '')), 'ref', '"#/components/schemas/Brand"' FROM s),
old AS (SELECT * FROM f WHERE version = 'v0'), new AS (SELECT * FROM f WHERE version = 'v1'),
shared AS (SELECT name FROM s WHERE version = 'v0' INTERSECT SELECT name FROM s WHERE version = 'v1'),
d AS (SELECT coalesce(o.name, n.name) AS name, coalesce(o.pointer, n.pointer) AS pointer, coalesce(o.kind, n.kind) AS kind, o.value AS before, n.value AS after FROM old o FULL JOIN new n ON o.name = n.name AND o.pointer = n.pointer AND o.kind = n.kind)
"""


@query(rf"""WITH {_PARTS}
SELECT name, pointer, kind, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'modified' END AS change, before, after FROM d WHERE before IS DISTINCT FROM after AND name IN (SELECT name FROM shared)""")
def schema_changes_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with even keys are the old, those with odd keys the new version of a schema."""
    brand = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
    size = F.concat(F.lit('{"type":"integer","nullable":'), (F.col("p_size") % 3 == 0).cast("string"), F.lit(',"maximum":'), F.col("p_size").cast("string"), F.lit("}"))
    json = F.concat(F.lit('{"type":"object","properties":{"size":'), size, F.lit(',"'), brand, F.lit('":{"$ref":"#/components/schemas/Brand"}}'), F.when(F.col("p_size") % 2 == 0, ',"required":["size"]').otherwise(""), F.lit("}"))
    schemas = table(spark, sf_dir, "part").select(F.concat(F.lit("v"), (F.col("p_partkey") % 2).cast("string")).alias("version"), F.concat(F.lit("P"), F.expr("p_partkey div 2").cast("string")).alias("name"), json.alias("schema"))
    return endpoints.schema_changes(written(schemas), "v0", "v1")
