"""Registered queries that put the given tables into requirements and cited sources, and ask for records and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import records
from evidra.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


@query("""WITH r AS (
  SELECT item_id AS i, '{"id":"R' || lpad(item_id::VARCHAR, 8, '0') || '","version":"v' || item_id % 3 || '","title":' || to_json(text)
    || CASE WHEN item_id % 2 = 0 THEN ',"description":' || to_json('about "' || left(text, 20) || '"') ELSE '' END
    || ',"sources":[{"source_id":"conv-' || item_id || '","locator":"page:1"' || CASE WHEN item_id % 3 = 0 THEN ',"sha256":"' || left(sha256(text), 12) || '"' ELSE '' END || CASE WHEN item_id % 5 = 0 THEN ',"note":"first"' ELSE '' END || '}]'
    || ',"endpoints":[' || CASE WHEN item_id % 4 > 0 THEN '"GET /items/' || item_id || '"' ELSE '' END || '],"schemas":[' || CASE WHEN item_id % 7 = 0 THEN '"Item"' ELSE '' END || '],"acceptance_criteria":["' || item_id || ' is read"]'
    || ',"conflicts_with":[' || CASE WHEN item_id % 6 = 0 THEN '{"requirement_id":"R' || lpad((item_id + 1)::VARCHAR, 8, '0') || '"' || CASE WHEN item_id % 12 = 0 THEN ',"note":"so said"' ELSE '' END || '}' ELSE '' END || '],"tags":[]}' AS json
  FROM benchmark WHERE text IS NOT NULL)
SELECT 'R' || lpad(i::VARCHAR, 8, '0') AS id, json, 'requirement:R' || lpad(i::VARCHAR, 8, '0') AS locator, sha256(json) AS sha256 FROM r""")
def requirement_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requirement for each benchmark item, as its canonical record with hash and place."""
    i, t, none = F.col("item_id"), F.col("text"), F.array().cast("array<string>")
    name = lambda n: _text("R", F.lpad(n.cast("string"), 8, "0"))
    some = lambda on, value: F.when(on, F.array(value)).otherwise(none)
    source = F.struct(_text("conv-", i).alias("source_id"), F.lit("page:1").alias("locator"), F.when(i % 3 == 0, F.left(F.sha2(t.cast("binary"), 256), F.lit(12))).alias("sha256"), F.when(i % 5 == 0, "first").alias("note"))
    needs = table(spark, sf_dir, "benchmark").where("text is not null").select(
        name(i).alias("id"), _text("v", i % 3).alias("version"), t.alias("title"), F.when(i % 2 == 0, _text('about "', F.left(t, F.lit(20)), '"')).alias("description"), F.array(source).alias("sources"),
        some(i % 4 > 0, _text(" get  /items/", i)).alias("endpoints"), some(i % 7 == 0, F.lit("Item")).alias("schemas"), F.array(_text(i, " is read")).alias("acceptance_criteria"),
        some(i % 6 == 0, name(i + 1)).alias("conflicts_with"), some(i % 6 == 0, F.when(i % 12 == 0, "so said")).alias("conflict_notes"), none.alias("tags"))
    return records.records(needs, "benchmark", "").select("id", "json", "mapping.locator", "mapping.sha256")


@query("""WITH
conv AS (SELECT 'conv-' || conv_id AS source_id, turn + 1 AS page, coalesce(text, '') AS text FROM conversations),
asked_pages AS (SELECT DISTINCT source_id, page AS first, page + 2 AS last FROM conv),
ops AS (SELECT '/suppliers/' || s_suppkey // 3 AS path, CASE s_suppkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'DELETE' END AS method, CASE WHEN s_suppkey % 5 > 0 THEN s_name ELSE '' END AS summary FROM supplier),
docs AS (SELECT source, lang || '.' || n_chars % 3 AS section, lang, doc_id, left(coalesce(text, ''), 1201) AS text FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL),
whole AS (
  SELECT a.source_id, 'pages:' || first || '-' || last AS locator, string_agg(text, chr(10) ORDER BY page, text) AS text FROM asked_pages a LEFT JOIN conv c ON c.source_id = a.source_id AND page BETWEEN first AND last GROUP BY ALL
  UNION ALL SELECT 'api', 'path:' || path, string_agg(method || ' ' || path || ' ' || summary, chr(10) ORDER BY method) FROM ops GROUP BY path
  UNION ALL SELECT 'api', 'op:' || method || ' ' || path, method || ' ' || path || ' ' || summary FROM ops
  UNION ALL SELECT 'api', 'schema:' || n_name, '{"type":"' || n_name || '"}' FROM nation
  UNION ALL SELECT 'api', 'schema:no-' || n_name, NULL FROM nation
  UNION ALL SELECT source, 'section:' || lang, string_agg(text, chr(10) ORDER BY doc_id, text) FROM docs GROUP BY source, lang
  UNION ALL SELECT source, 'section:' || section, string_agg(text, chr(10) ORDER BY doc_id, text) FROM docs GROUP BY source, section),
cut AS (SELECT source_id, locator, text, list_max(list_filter(range(0, 1201), lambda k: strlen(left(text, k)) <= 1200)) AS k FROM whole)
SELECT source_id, locator, CASE WHEN strlen(text) <= 1200 THEN text ELSE left(text, k) || '…' END AS text FROM cut""")
def cited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What citations of conversations' turns, suppliers' operations, nations' schemas and documents' sections say."""
    k = F.col("s_suppkey")
    pages = table(spark, sf_dir, "conversations").select(_text("conv-", F.col("conv_id")).alias("source_id"), (F.col("turn") + 1).alias("page"), "text")
    operations = table(spark, sf_dir, "supplier").select(F.lit("api").alias("source_id"), _text("/suppliers/", F.floor(k / 3)).alias("path"), F.when(k % 3 == 0, "GET").when(k % 3 == 1, "POST").otherwise("DELETE").alias("method"), F.when(k % 5 > 0, F.col("s_name")).alias("summary"))
    schemas = table(spark, sf_dir, "nation").select(F.lit("api").alias("source_id"), F.col("n_name").alias("name"), _text('{"type":"', F.col("n_name"), '"}').alias("schema"))
    docs = table(spark, sf_dir, "documents").where("source is not null and lang is not null and n_chars is not null")
    chunks = docs.select(F.col("source").alias("source_id"), _text("d", F.col("doc_id")).alias("chunk_id"), _text(F.col("lang"), ".", F.col("n_chars") % 3).alias("section"), "lang", F.col("doc_id").alias("page"), F.lit(0).alias("ordinal"), "text")
    cite = lambda rows, *parts: rows.select("source_id", _text(*parts).alias("locator")).distinct()
    cited = cite(pages, "pages:", F.col("page"), "-", F.col("page") + 2)
    for more in (cite(operations, "path:", F.col("path")), cite(operations, "op:", F.col("method"), " ", F.col("path")), cite(schemas, "schema:", F.col("name")), cite(schemas, "schema:no-", F.col("name")), cite(chunks, "section:", F.col("lang")), cite(chunks, "section:", F.col("section"))):
        cited = cited.unionByName(more)
    return records.cited_texts(cited, pages, chunks, operations, schemas)
