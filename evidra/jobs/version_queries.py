"""Registered queries that put the given tables into two versions of contracts, and compare them.

Each part is a schema, and so are its brand and its type, which refer to each other; the new version changes some of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import endpoints, graph, schemas
from evidra.sources import contracts
from evidra.sources.tables import spread, table, written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def part_schemas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(schemas(side, name, schema), roots(root, old_name, new_name)): a schema a part, a brand and a type in both versions."""
    p = spread(table(spark, sf_dir, "part")).withColumn("new", F.explode(F.array(F.lit(False), F.lit(True))))
    k, new, text = F.col("p_partkey"), F.col("new"), lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    side = F.when(new, "new").otherwise("old").alias("side")
    brand = F.when(new & (k % 4 == 1), '{"type":"object"}').otherwise(text('{"$ref":"#/components/schemas/', F.col("p_brand"), '"}'))
    part = text('{"type":"object"', F.when(new & (k % 7 == 0), ',"required":["size"]').otherwise(""), ',"properties":{"size":{"type":"integer","maximum":', F.col("p_size") + F.when(new & (k % 5 == 0), 1).otherwise(0), '},"brand":', brand, "}}")
    b, t = F.col("p_brand"), F.col("p_type")
    brands = p.groupBy("p_brand", "new").agg(F.min("p_type").alias("to"))
    brands = brands.select(side, b.alias("name"), text('{"type":"object"', F.when(new & b.endswith("3"), ',"enum":["x"]').otherwise(""), F.when(new & b.endswith("1"), ',"required":["main"]').otherwise(""), ',"properties":{"main":{"$ref":"#/components/schemas/', F.col("to"), '"}}}').alias("schema"))
    types = p.groupBy("p_type", "new").agg(F.max("p_brand").alias("to"))
    home = F.when(new & (F.length(t) % 3 == 0), "Other").otherwise(F.col("to"))
    types = types.select(side, t.alias("name"), text('{"type":', F.when(new & (F.length(t) % 2 == 0), '["object","null"]').otherwise('"object"'), ',"properties":{"home":{"$ref":"#/components/schemas/', home, '"}}}').alias("schema"))
    other = p.where("new").limit(1).select(side, F.lit("Other").alias("name"), F.lit('{"type":"object"}').alias("schema"))
    parts = p.select(side, text("Part", k).alias("name"), part.alias("schema"))
    all_ = parts.unionByName(brands).unionByName(types).unionByName(other)
    roots = p.where("not new").select(text("Part", k).alias("root")).select("root", F.col("root").alias("old_name"), F.col("root").alias("new_name"))
    return written(all_), roots


@query(r"""
WITH RECURSIVE brands AS (SELECT p_brand AS node, min(p_type) AS beyond FROM part GROUP BY p_brand),
types AS (SELECT p_type AS node, max(p_brand) AS beyond FROM part GROUP BY p_type),
links AS (
  SELECT 'brand' AS kind, node, 'type' AS to_kind, beyond, '/properties/main' AS step FROM brands
  UNION ALL SELECT 'type', node, 'brand', beyond, '/properties/home' FROM types WHERE length(node) % 3 <> 0),
walk(root, kind, node, ptr, seen) AS (
  SELECT 'Part' || p_partkey, 'brand', p_brand, '/properties/brand', [p_brand] FROM part WHERE p_partkey % 4 <> 1
  UNION ALL
  SELECT w.root, l.to_kind, l.beyond, w.ptr || l.step, list_append(w.seen, l.beyond)
  FROM walk w JOIN links l ON l.kind = w.kind AND l.node = w.node WHERE NOT list_contains(w.seen, l.beyond)),
own AS (SELECT 'Part' || p_partkey AS root, p_partkey AS k, p_size, p_brand FROM part)
SELECT root, '/properties/size/maximum' AS pointer, 'constraint_changed' AS kind, 'modified' AS change, p_size::VARCHAR AS before, (p_size + 1)::VARCHAR AS after, root AS schema_name FROM own WHERE k % 5 = 0
UNION ALL SELECT root, '/properties/size', 'required_added', 'modified', 'false', 'true', root FROM own WHERE k % 7 = 0
UNION ALL SELECT root, '/properties/brand', 'ref_changed', 'modified', '"#/components/schemas/' || p_brand || '"', '"inline"', root FROM own WHERE k % 4 = 1
UNION ALL SELECT root, '/properties/brand/properties/main', 'property_removed', 'removed', '{"required":false,"schema":{"$ref":"#/components/schemas/' || beyond || '"}}', NULL, p_brand FROM own JOIN brands ON node = p_brand WHERE k % 4 = 1
UNION ALL SELECT root, ptr || '/enum', 'enum_constraint_changed', 'added', NULL, '["x"]', node FROM walk WHERE kind = 'brand' AND node LIKE '%3'
UNION ALL SELECT root, ptr || '/properties/main', 'required_added', 'modified', 'false', 'true', node FROM walk WHERE kind = 'brand' AND node LIKE '%1'
UNION ALL SELECT root, ptr, 'nullable_changed', 'modified', 'false', 'true', node FROM walk WHERE kind = 'type' AND length(node) % 2 = 0
UNION ALL SELECT root, ptr || '/properties/home', 'ref_changed', 'modified', '"#/components/schemas/' || t.beyond || '"', '"#/components/schemas/Other"', w.node FROM walk w JOIN types t USING (node) WHERE kind = 'type' AND length(w.node) % 3 = 0
UNION ALL SELECT root, ptr || '/properties/home/properties/main', 'property_removed', 'removed', '{"required":false,"schema":{"$ref":"#/components/schemas/' || b.beyond || '"}}', NULL, 'Other'
  FROM walk w JOIN types t USING (node) JOIN brands b ON b.node = t.beyond WHERE kind = 'type' AND length(w.node) % 3 = 0""")
def schema_changes_through_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's schema in two versions, through the brands and types that it refers to."""
    return schemas.differences(*part_schemas(spark, sf_dir))


@query(r"""
WITH RECURSIVE defs AS (SELECT DISTINCT left(p_brand, 7) AS version, p_brand AS source_id, right(p_brand, 1)::BIGINT AS precedence, p_partkey // 10 AS name FROM part),
refs AS (SELECT source_id, version, name, unnest([name // 2, name + 7, name // 3]) AS target, unnest([0, 1, 2]) AS position FROM defs),
links AS (SELECT source_id, version, name, target, min(position) AS position FROM refs GROUP BY ALL),
best AS (SELECT version, name, source_id AS best, count(*) OVER (PARTITION BY version, name) AS candidates FROM defs QUALIFY row_number() OVER (PARTITION BY version, name ORDER BY precedence DESC, source_id) = 1),
walk(root_source, root_name, name, version, source_id, referenced_from, depth, place, cross_source, candidates) USING KEY (root_source, root_name, name) AS (
  SELECT source_id, name, -1::BIGINT, version, source_id, source_id, 0, 1::BIGINT, false, NULL::BIGINT FROM defs
  UNION
  SELECT root_source, root_name, name, version, source_id, referenced_from, depth, place, cross_source, candidates FROM (
    SELECT *, row_number() OVER (PARTITION BY root_source, root_name ORDER BY parent, position) AS place,
      coalesce(count(source_id) OVER (PARTITION BY root_source, root_name ORDER BY parent, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + had AS before
    FROM (
      SELECT n.*, CASE WHEN o.source_id IS NOT NULL THEN n.referenced_from ELSE b.best END AS source_id, o.source_id IS NULL AND b.best IS NOT NULL AS cross_source, CASE WHEN o.source_id IS NULL THEN b.candidates END AS candidates
      FROM (
        SELECT w.root_source, w.root_name, l.target AS name, w.version, w.source_id AS referenced_from, w.depth + 1 AS depth, w.place AS parent, l.position, h.had
        FROM walk w JOIN links l ON l.source_id = w.source_id AND l.version = w.version AND l.name = CASE WHEN w.depth = 0 THEN w.root_name ELSE w.name END
        JOIN (SELECT root_source, root_name, count(source_id) - 1 AS had FROM recurring.walk GROUP BY ALL) h ON h.root_source = w.root_source AND h.root_name = w.root_name
        LEFT JOIN recurring.walk s ON s.root_source = w.root_source AND s.root_name = w.root_name AND s.name = l.target WHERE s.name IS NULL
        QUALIFY row_number() OVER (PARTITION BY w.root_source, w.root_name, l.target ORDER BY w.place, l.position) = 1) n
      LEFT JOIN defs o ON o.source_id = n.referenced_from AND o.version = n.version AND o.name = n.name LEFT JOIN best b ON b.version = n.version AND b.name = n.name))
  WHERE before < 25),
kept AS (SELECT * FROM walk WHERE depth > 0),
cut AS (
  SELECT DISTINCT w.root_source, w.root_name FROM walk w JOIN links l ON l.source_id = w.source_id AND l.version = w.version AND l.name = CASE WHEN w.depth = 0 THEN w.root_name ELSE w.name END
  ANTI JOIN kept s ON s.root_source = w.root_source AND s.root_name = w.root_name AND s.name = l.target)
SELECT k.root_source, k.root_name, k.name, k.version, k.source_id, k.referenced_from, k.depth::INT AS depth, k.cross_source, k.candidates, k.source_id IS NULL AS unresolved, c.root_name IS NOT NULL AS truncated
FROM kept k LEFT JOIN cut c ON c.root_source = k.root_source AND c.root_name = k.root_name""")
def ordered_closure_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each brand's tens of parts refer to, each name once; several brands of a version define one name. At most 25."""
    p = table(spark, sf_dir, "part").select(F.substring("p_brand", 1, 7).alias("version"), F.col("p_brand").alias("source_id"), F.right("p_brand", F.lit(1)).cast("long").alias("precedence"), F.expr("p_partkey div 10").alias("name")).distinct()
    defs = written(p)
    refs = defs.select("source_id", "version", "name", F.posexplode(F.array(F.expr("name div 2"), F.col("name") + 7, F.expr("name div 3"))).alias("position", "target"))
    root = F.struct("source_id", "name").alias("root")
    asked = refs.select(root, "version", "source_id", F.col("target").alias("name"), "position")
    return graph.ordered_closure(asked, defs, refs, 25).select(F.col("root.source_id").alias("root_source"), F.col("root.name").alias("root_name"), "name", "version", "source_id", "referenced_from", "depth", "cross_source", "candidates", "unresolved", "truncated")


def supplier_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, version, json): a contract a supplier and version; some suppliers have but the old, some but the new one."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.array(F.lit(False), F.lit(True))).alias("new"))
    k, new, text = F.col("k"), F.col("new"), lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    s = s.where((new & (k % 5 != 0)) | (~new & (k % 5 != 1)))
    name = F.when(new, "supplierId").otherwise("supplier-id")
    parameters = text(
        '[{"name":"', name, '","in":"path","required":true},{"name":"limit","in":"query","required":', F.when(new & (k % 2 == 0), "true").otherwise("false"), "}",
        F.when(new, "").otherwise(',{"name":"X-Old","in":"header"}'), "]")
    body = F.when(new & (k % 7 == 0), '{"type":"integer"}').otherwise('{"type":"string"}')
    answers = text('{"200":{"description":"it","headers":{"ETag":{}},"content":{"application/json":{"schema":', body, "}}}", F.when(new & (k % 4 == 0), ',"429":{"description":"later"}').otherwise(""), "}")
    operation = text('{"operationId":"read', k, F.when(new & (k % 3 == 0), "x").otherwise(""), '","parameters":', parameters, ',"responses":', answers, "}")
    version = F.when(new, "v2").otherwise("v1")
    json = text('{"openapi":"3.0.1","info":{"title":"s","version":"1"},"paths":{"/', version, "/suppliers/", k, "/{", name, '}":{"get":', operation, "}}}")
    return s.select(text("supplier-", k, "-", version).alias("source_id"), version.alias("version"), json.alias("json"))


@query(r"""
WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' END AS side FROM supplier),
items AS (
  SELECT k, side, 'operation' AS area, '' AS item, CASE WHEN k % 3 = 0 THEN 'modified' ELSE 'unchanged' END AS change FROM s
  UNION ALL SELECT k, side, 'parameter', 'path:#0', 'modified' FROM s
  UNION ALL SELECT k, side, 'parameter', 'query:limit', CASE WHEN k % 2 = 0 THEN 'modified' ELSE 'unchanged' END FROM s
  UNION ALL SELECT k, side, 'parameter', 'header:x-old', 'removed' FROM s WHERE side IS DISTINCT FROM 'added'
  UNION ALL SELECT k, side, 'response', '200', 'unchanged' FROM s
  UNION ALL SELECT k, side, 'response', '429', 'added' FROM s WHERE k % 4 = 0 AND side IS DISTINCT FROM 'removed'
  UNION ALL SELECT k, side, 'media_type', '200 application/json', CASE WHEN k % 7 = 0 THEN 'modified' ELSE 'unchanged' END FROM s)
SELECT 'GET' AS method, '/suppliers/' || k || '/{}' AS path_key, area, item, coalesce(side, change) AS change FROM items""")
def compared_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations, parameters, responses and bodies of two versions, met by path without the version and parameters' names."""
    c = written(supplier_contracts(spark, sf_dir))
    parts = contracts.components(c)
    ops = written(endpoints.keyed(contracts.operations(c), {"v1": "/v1", "v2": "/v2"}))
    of = ops.select("source_id", "version", "method", "path", "path_key")
    key = ["source_id", "version", "method", "path"]
    tables = {"parameters": contracts.parameters(ops, parts), "responses": contracts.responses(ops, parts), "media": contracts.media_types(ops, parts)}
    tables = {"operations": ops} | {n: written(t.join(of, key)) for n, t in tables.items()}
    side = lambda v: {n: t.where(F.col("version") == v) for n, t in tables.items()}
    return endpoints.compare(side("v1"), side("v2")).select("method", "path_key", "area", "item", "change")
