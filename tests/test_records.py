"""Requirements as records, texts of citations, and reads of a catalogue by lists of keys."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evidra.jobs import index, services
from evidra.operators import records
from evidra.sources import manifest
from evidra.sources.generations import Generations

YAML = r"""
schema_version: 1
requirements:
  - id: R-1
    version: v1
    title: "Zahlungen lesen – \"möglich\" a/b \\u000B \v \u001f\tend"
    sources:
      - {source_id: guide, locator: "page:1", sha256: abcdefabcdef}
      - {source_id: api, locator: "op:GET /cards/{cardId}", note: main}
    endpoints: ["get  /cards/{cardId}"]
    conflicts_with: [{requirement_id: R-2, note: other day}, {requirement_id: R-3}]
  - {id: R-2, version: v2, title: Short, description: Said twice, sources: [{source_id: guide, locator: document}], schemas: [Card], acceptance_criteria: [one, two], tags: [x]}
"""


def test_records_are_canonical(spark):
    rows = {r["id"]: r for r in records.records(manifest.requirements(spark, YAML), "requirements.yaml", "ab" * 32).collect()}
    want = {
        "R-1": {"id": "R-1", "version": "v1", "title": "Zahlungen lesen – \"möglich\" a/b \\u000B \v \x1f\tend", "sources": [{"source_id": "guide", "locator": "page:1", "sha256": "abcdefabcdef"}, {"source_id": "api", "locator": "op:GET /cards/{cardId}", "note": "main"}], "endpoints": ["GET /cards/{cardId}"], "schemas": [], "acceptance_criteria": [], "conflicts_with": [{"requirement_id": "R-2", "note": "other day"}, {"requirement_id": "R-3"}], "tags": []},
        "R-2": {"id": "R-2", "version": "v2", "title": "Short", "description": "Said twice", "sources": [{"source_id": "guide", "locator": "document"}], "endpoints": [], "schemas": ["Card"], "acceptance_criteria": ["one", "two"], "conflicts_with": [], "tags": ["x"]},
    }
    for i, r in want.items():
        text = json.dumps(r, ensure_ascii=False, separators=(",", ":"))
        assert rows[i]["json"] == text
        assert rows[i]["mapping"].asDict() == {"file": "requirements.yaml", "file_sha256": "ab" * 32, "locator": f"requirement:{i}", "sha256": hashlib.sha256(text.encode()).hexdigest()}


def contract(summary: str) -> str:
    operation = lambda s: {"summary": s, "responses": {"200": {"description": "done", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/Card"}}}}}}
    return json.dumps({"openapi": "3.0.1", "info": {"title": "Cards", "version": "1"}, "paths": {"/cards": {"get": operation(summary), "post": operation("Make a card")}}, "components": {"schemas": {"Card": {"type": "object"}, "Amount": {"type": "string"}}}})


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    store = Generations(spark, str(tmp_path_factory.mktemp("index")), buckets=16)
    guide = "1 Cards\nOne card has one limit.\n\n1.1 Limits\nThe limit is kept for a day.\f1.1.1 Days\nA day ends at midnight, as said.\f" + "ü" * 3000
    rows = [("api", "v1", 90, contract("Read cards"), "openapi"), ("old-api", "v1", 10, contract("Read old cards"), "openapi"), ("new-api", "v1", 90, contract("Read new cards"), "openapi"), ("guide", "v1", 50, guide, "text"), *((f"text{i}", "v2", 1, f"Number {i}, of no use to anyone here.", "text") for i in range(20))]
    needs = records.records(manifest.requirements(spark, YAML), "requirements.yaml", "cd" * 32)
    index.run(store, spark.createDataFrame(rows, "source_id string, version string, precedence int, text string, kind string"), requirements=needs)
    return services.Catalog(spark, store.root)


def test_lists_of_keys_give_what_single_ones_do(catalog):
    ids = [r["source_id"] for r in catalog.documents.collect()]
    assert [r["source_id"] for r in catalog.get_documents([*ids, "none"]).collect()] == sorted(ids) and catalog.get_documents([]).count() == 0
    names = ["Card", "Amount", "NoSuchSchema", "Card"]
    assert [r["name"] for r in catalog.source_schemas("api", names).collect()] == ["Amount", "Card"]
    single = [(n, r["source_id"]) for n in sorted(set(names)) for r in catalog.find_schemas("v1", [n]).collect()]
    assert [(r["name"], r["source_id"]) for r in catalog.find_schemas("v1", names).collect()] == single == [(n, s) for n in ("Amount", "Card") for s in ("api", "new-api", "old-api")]
    assert catalog.find_schemas("v2", names).count() == 0
    many = [f"N{i}" for i in range(200)] + ["Card"]  # too many for a filter
    assert [r["source_id"] for r in catalog.find_schemas("v1", many).collect()] == ["api", "new-api", "old-api"]
    assert [r["ordinal"] for r in catalog.page_chunks("guide", 1).collect()] == [0, 1] and catalog.page_chunks("guide", 9).count() == 0
    assert [r["method"] for r in catalog.source_operations("api", "/cards").collect()] == ["GET", "POST"] and catalog.source_operations("api", "/cards", "POST").first()["summary"] == "Make a card"
    assert [r["id"] for r in catalog.get_requirements().collect()] == ["R-1", "R-2"] and [r["id"] for r in catalog.get_requirements("v2").collect()] == ["R-2"] and [r["id"] for r in catalog.get_requirements(ids=["R-1", "R-9"]).collect()] == ["R-1"]
    m = catalog.meta().first()
    assert (m["generation"], m["requirements_file_sha256"]) == (1, "cd" * 32) and m["indexed_at"] is not None


def test_only_files_of_the_sources_asked_for_are_opened(catalog):
    some = catalog.of_sources("pages", ["text3", "guide"])
    opened, all_ = set(some.inputFiles()), set(catalog.pages.inputFiles())
    assert 0 < len(opened) <= 2 < len(all_) and opened < all_
    plan = some.where("page = 2")._jdf.queryExecution().explainString(some.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in plan and "In(source_id" in plan and "EqualTo(page,2)" in plan


def test_texts_of_citations(spark, catalog):
    cited = [("guide", loc) for loc in ("page:2", "pages:1-2", "section:1.1", "section:1.1 Limits", "page:3", "page:9", "section:1.2", "nonsense", "document")] + [("api", loc) for loc in ("op:GET /cards", "path:/cards", "schema:Card", "schema:None", "op:PUT /cards")] + [("nowhere", "page:1")]
    chunk = catalog.page_chunks("guide", 1).first()["chunk_id"]
    cited += [("guide", f"chunk:{chunk}"), ("guide", "page:2")]  # twice
    rows = catalog.cited_texts(spark.createDataFrame([(n, *c) for n, c in enumerate(cited)], "n int, source_id string, locator string")).collect()
    got = {(r["source_id"], r["locator"]): r["text"] for r in rows}
    assert len(rows) == len(cited)
    page = {r["page"]: r["text"] for r in catalog.pages.where("source_id = 'guide'").collect()}
    assert got["guide", "page:2"] == page[2] and got["guide", "pages:1-2"] == f"{page[1]}\n{page[2]}"
    above = "1.1 Limits\n\nThe limit is kept for a day.\n1.1.1 Days\n\nA day ends at midnight, as said.\n"  # and what page 3 goes on with
    assert got["guide", "section:1.1"] == above + "ü" * ((1200 - len(above)) // 2) + "…"
    assert got["guide", "section:1.1 Limits"] == "1.1 Limits\n\nThe limit is kept for a day." and got["guide", f"chunk:{chunk}"] == "1 Cards\n\nOne card has one limit."
    assert got["guide", "page:3"] == "ü" * 600 + "…"  # cut at a character's end
    assert got["api", "op:GET /cards"] == "GET /cards Read cards" and got["api", "path:/cards"] == "GET /cards Read cards\nPOST /cards Make a card" and json.loads(got["api", "schema:Card"]) == {"type": "object"}
    assert json.loads(got["guide", "document"])["version"] == "v1"
    assert all(got[k] is None for k in (("guide", "page:9"), ("guide", "section:1.2"), ("guide", "nonsense"), ("api", "schema:None"), ("api", "op:PUT /cards"), ("nowhere", "page:1")))


def test_bounds_of_a_cited_text(spark):
    """A text that ends where the bound is has a mark if more follows; pieces of one place stand by their text; nulls are empty."""
    pages = spark.createDataFrame([("a", 1, "x" * 10), ("a", 2, "y"), ("b", 1, "x" * 10), ("b", 2, None), ("c", 1, "two"), ("c", 1, "one"), ("d", 1, None)], "source_id string, page int, text string")
    chunks = spark.createDataFrame([("s", f"c{n}", "1.2", n, 0, f"{n % 10}") for n in range(500)], "source_id string, chunk_id string, section string, page int, ordinal int, text string")
    none = lambda columns: spark.createDataFrame([], columns)
    ask = lambda *rows: records.cited_texts(spark.createDataFrame(rows, "source_id string, locator string"), pages, chunks, none("source_id string, method string, path string, summary string"), none("source_id string, name string, schema string"), most=10)
    got = {(r["source_id"], r["locator"]): r["text"] for r in ask(("a", "pages:1-2"), ("a", "page:1"), ("b", "pages:1-2"), ("c", "page:1"), ("d", "page:1"), ("s", "section:1"), ("s", "section:1.2"), (None, "page:1"), ("a", None)).collect()}
    few = "0\n1\n2\n3\n4\n…"
    assert got == {("a", "pages:1-2"): "x" * 10 + "…", ("a", "page:1"): "x" * 10, ("b", "pages:1-2"): "x" * 10 + "…", ("c", "page:1"): "one\ntwo", ("d", "page:1"): "", ("s", "section:1"): few, ("s", "section:1.2"): few, (None, "page:1"): None, ("a", None): None}
