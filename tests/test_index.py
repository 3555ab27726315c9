"""Contracts in generations, buckets that are shared between them, and search as users ask it."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidra.jobs import index, services
from evidra.sources.generations import Generations, bucket

SOURCES = "source_id string, version string, precedence int, text string, kind string, authority string, title string"
CONTRACT = json.dumps({
    "openapi": "3.0.1", "info": {"title": "Cards", "version": "1"},
    "paths": {"/cards/{cardId}": {"get": {"operationId": "readCard", "summary": "Read one card", "responses": {"200": {"description": "the card", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/Card"}}}}}}}},
    "components": {"schemas": {"Card": {"type": "object", "description": "A plastic thing", "properties": {"limit": {"$ref": "#/components/schemas/Amount"}}}, "Amount": {"type": "string"}}}})


def sources(spark, *rows):
    return spark.createDataFrame([(*r, *([None] * (7 - len(r)))) for r in rows], SOURCES)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Generations(spark, str(tmp_path_factory.mktemp("index")))
    requirements = spark.createDataFrame([("R1", "v1", "Cards are read", ["GET /cards/{cardId}"])], "id string, version string, title string, endpoints array<string>")
    guide = "# Limits\nA card has a spending limit per day.\n\nThe limit of a card may be raised.\fDay and limit, card and spending: other words in between here."
    rows = [("api", "v1", 90, CONTRACT, "openapi", "technical", "Cards API"), ("broken", "v1", 10, "{no json", "openapi"), ("old", "v1", 10, '{"openapi":"2.0"}', "openapi"), ("guide", "v1", 50, guide, "text", "normative", "Guide to cards"), ("notes", "v2", 1, "Notes on a card and its spending limit, long enough.", "text")]
    index.run(s, sources(spark, *rows), requirements=requirements)
    return s


def test_contracts_are_tables_of_a_generation(store):
    assert [(r["method"], r["path"], r["operation_id"]) for r in store.read("operations").collect()] == [("GET", "/cards/{cardId}", "readCard")]
    assert {r["name"] for r in store.read("schemas").collect()} == {"Card", "Amount"} and store.read("requirements").count() == 1
    assert {r["source_id"]: (r["status"], r["error"] is None) for r in store.read("documents").collect()} == {"api": ("indexed", True), "broken": ("failed", False), "old": ("failed", False), "guide": ("indexed", True), "notes": ("indexed", True)}
    assert {r["record_type"] for r in store.read("records").collect()} == {"chunk", "operation", "schema"}


def test_search_finds_all_kinds(spark, store):
    catalog = services.Catalog(spark, store.root)
    found = catalog.search("readCard").collect()
    assert found[0]["record_type"] == "operation" and found[0]["locator"] == "op:GET /cards/{cardId}"
    assert catalog.search("plastic").collect()[0]["locator"] == "schema:Card"
    assert {r["version"] for r in catalog.search("card", version="v2").collect()} == {"v2"}
    assert {r["kind"] for r in catalog.search("card", kind="text").collect()} == {"text"} and {r["source_id"] for r in catalog.search("card", source_id="guide").collect()} == {"guide"}
    assert len({r["page"] for r in catalog.search("limit", source_id="guide").collect()}) == 2  # hits of one page stand behind the first
    for asked, code in (("", "invalid_input"), ("x" * 1001, "invalid_input")):
        with pytest.raises(services.Refused) as e:
            catalog.search(asked)
        assert e.value.code == code


def test_phrases_and_excerpts(spark, store):
    catalog = services.Catalog(spark, store.root)
    hits = catalog.search('"spending limits"').collect()  # stems of the words, in turn
    assert {r["source_id"] for r in hits} == {"guide", "notes"} and all("spending limit" in r["excerpt"] for r in hits) and 2 not in {r["page"] for r in hits if r["source_id"] == "guide"}
    assert catalog.search('"limit spending"').collect() == [] and catalog.search('"nowhere else"').collect() == []
    assert len(catalog.search('raised "spending limit"').collect()) >= 2


def test_contracts_are_read_by_locator(spark, store):
    catalog = services.Catalog(spark, store.root)
    assert catalog.read("api", "op:GET /cards/{cardId}").first()["operation_id"] == "readCard" and catalog.read("api", "path:/cards/{cardId}").count() == 1
    assert catalog.read("api", "schema:Card").first()["name"] == "Card"
    for source, locator, code in (("api", "schema:None", "not_found"), ("api", "op:PUT /cards/{cardId}", "not_found"), ("guide", "schema:Card", "invalid_input"), ("broken", "schema:Card", "not_found")):
        with pytest.raises(services.Refused) as e:
            catalog.read(source, locator)
        assert e.value.code == code
    assert services.find_requirement(catalog.requirements.selectExpr("*", "'' AS description", "array() AS acceptance_criteria", "array() AS tags"), "R1").count() == 1


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = tmp_path / "index"
    store = Generations(spark, str(root), buckets=8)
    texts = {f"s{i}": f"Text number {i} about things that stay as they are." for i in range(24)}
    rows = lambda: [(k, "v", 1, t, "text") for k, t in texts.items()]
    index.run(store, sources(spark, *rows()))
    where = {r["source_id"]: r["b"] for r in sources(spark, *rows()).select("source_id", bucket(F.col("source_id"), 8).alias("b")).collect()}
    texts["s3"] += " Changed."
    index.run(store, sources(spark, *rows()))
    layout = store.layout(2)["parts"]["pages"]["places"]
    assert layout[str(where["s3"])] == 2 and {g for b, g in layout.items() if int(b) != where["s3"]} == {1}
    size = lambda n: sum(f.stat().st_size for f in (root / "generations" / str(n) / "pages").rglob("*.parquet"))
    assert size(2) < size(1) / 2
    assert {r["source_id"]: r["text"] for r in store.read("pages").collect()} == texts
    del texts["s5"]
    for n in (3, 4, 5):
        texts["s3"] += f" And again {n}."
        index.run(store, sources(spark, *rows()))
        assert {r["source_id"]: r["text"] for r in store.read("pages").collect()} == texts and store.numbers() == [n - 1, n]
    assert {r["source_id"]: r["text"] for r in Generations(spark, str(root)).read("pages", 4).collect()} == {**texts, "s3": texts["s3"].removesuffix(" And again 5.")}
    assert Generations(spark, str(root)).buckets == 8 and not Path(root, "generations", "2", "pages", f"bucket={where['s3']}").exists()
    unchanged = {r["action"] for r in index.run(store, sources(spark, *rows())).collect()}
    assert unchanged == {"skipped"} and store.read("pages").count() == 23


def test_chunks_are_of_cleaned_pages(spark, tmp_path):
    """Running heads and feet are taken out and split words joined before chunking; pages keep their text; figures tell."""
    store = Generations(spark, str(tmp_path / "index"))
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    text = "\f".join(f"Handbook of cards\n{w} opens\nThis sentence has a bro-\nken word in it.\n{w} closes\nPage {i} of 5" for i, w in enumerate(words, 1))
    index.run(store, sources(spark, ("book", "v", 1, text, "text"), ("short", "v", 1, "Handbook of cards\nonly one page with enough text", "text")))
    d = {r["source_id"]: r for r in store.read("documents").collect()}
    assert (d["book"]["removed_lines"], d["book"]["repairs"], d["book"]["removed_patterns"]) == (10, 5, ["Handbook of cards", "Page # of #"])
    assert (d["short"]["removed_lines"], d["short"]["repairs"], d["short"]["removed_patterns"]) == (0, 0, [])
    chunk = {r["source_id"]: r["text"] for r in store.read("chunks").collect()}
    assert "Handbook" in chunk["short"] and all("broken word" in r["text"] and "Handbook" not in r["text"] and "Page" not in r["text"] for r in store.read("chunks").where("source_id = 'book'").collect())
    assert all("bro-\nken" in r["text"] for r in store.read("pages").where("source_id = 'book'").collect())
