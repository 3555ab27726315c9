"""Typed citations, and bundles of evidence on a small corpus."""

import pytest
from pyspark.sql import functions as F

from evidra.operators import endpoints, evidence


@pytest.fixture(scope="module")
def corpus(spark):
    documents = spark.createDataFrame([("api", "v", 90, "technical", "indexed", "aa11"), ("guide", "v", 90, "normative", "indexed", "bb22"), ("lost", "v", 10, "normative", "missing", None)], "source_id string, version string, precedence long, authority string, status string, sha256 string")
    pages = spark.createDataFrame([("guide", 1, "cc33"), ("guide", 2, "dd44")], "source_id string, page int, sha256 string")
    operations = spark.createDataFrame(
        [("api", "v", "GET", "/cards/{id}", "getCard", "Read a card", ["cards"], ["Card", "Gone"], "op:GET /cards/{id}", "ee55"), ("api", "v", "GET", "/cards/{id}/holds", "listHolds", "List holds", [], [], "op:GET /cards/{id}/holds", "ee66")],
        "source_id string, version string, method string, path string, operation_id string, summary string, tags array<string>, referenced_schemas array<string>, locator string, sha256 string")
    schemas = spark.createDataFrame([("api", "v", "Card", 90, "ff77"), ("api", "v", "Owner", 90, "ff88")], "source_id string, version string, name string, precedence long, sha256 string")
    refs = spark.createDataFrame([("api", "v", "Card", "Owner", 0), ("api", "v", "Owner", "Card", 0)], "source_id string, version string, name string, target string, position int")
    cites = "id string, version string, endpoints array<string>, sources array<struct<source_id: string, locator: string, sha256: string>>, conflicts_with array<string>"
    requirements = spark.createDataFrame([
        ("R1", "v", ["GET /cards/{card-id}"], [("guide", "page:1", "CC33"), ("guide", "page:1", None), ("guide", "page:9", None), ("api", "op:GET /cards/{id}", None)], ["R2"]),
        ("R2", "v", ["DELETE /cards/{id}"], [("guide", "page:2", "0000")], ["R9"]), ("R3", "w", ["GET /cards/{id}"], [], [])], cites)
    records = spark.createDataFrame([("g1", "guide", "v", "page:1", 1, "cards are read with care", "cc33"), ("g2", "guide", "v", "page:2", 2, "holds of a card", "dd44"), ("g3", "twin", "v", "page:1", 1, "cards are read with care", "cc33"), ("w1", "other", "w", "page:1", 1, "cards cards cards", "gg99")], "record_id string, source_id string, version string, locator string, page int, content string, sha256 string")
    return operations, schemas, refs, requirements, documents, pages, records


def test_a_bundle(spark, corpus):
    asked = spark.createDataFrame([(1, "v", "GET", "/cards/{cardId}"), (2, "v", "DELETE", "/cards/{x}"), (3, "v", "PUT", "/nothing")], "ask_id long, version string, method string, path string")
    got = {n: df.collect() for n, df in evidence.bundles(asked, *corpus).items()}
    assert {r["ask_id"]: (r["found"], r["path"], r["error"]) for r in got["endpoints"]} == {1: (True, "/cards/{id}", None), 2: (False, None, None), 3: (False, None, "not_found")}
    assert {(r["ask_id"], r["requirement_id"]) for r in got["requirements"]} == {(1, "R1"), (2, "R2")}
    assert {(r["name"], r["unresolved"]) for r in got["schemas"]} == {("Card", False), ("Owner", False), ("Gone", True)}
    cited = [(r["role"], r["source_id"], r["locator"], r["sha256"]) for r in sorted(got["citations"], key=lambda r: r["nth"]) if r["ask_id"] == 1]
    assert cited == [
        ("openapi_operation", "api", "op:GET /cards/{id}", "ee55"), ("openapi_schema", "api", "schema:Card", "ff77"), ("openapi_schema", "api", "schema:Owner", "ff88"), ("requirement_source", "guide", "page:1", "cc33"),
        ("requirement_source", "guide", "page:9", None), ("requirement_source", "api", "op:GET /cards/{id}", "aa11"), ("discovered_evidence", "guide", "page:2", "dd44"), ("discovered_evidence", "guide", "page:1", "cc33")]
    assert all(r["source_id"] != "other" for r in got["related"]) and [r["nth"] for r in got["citations"] if r["ask_id"] == 3] == []
    said = {(r["ask_id"], r["kind"], r["description"]) for r in got["conflicts"]}
    assert (1, "declared", "R1 and R2 are declared to conflict") in said and (2, "declared", "R2 and R1 are declared to conflict") in said and (2, "dangling_reference", "R2 names R9, which there is none of") in said
    assert (2, "stale_hash", "R2 cites guide page:2: stale") in said and (1, "dangling_reference", "R1 cites guide page:9: dangling") in said
    assert (1, "precedence_tie", "R1: api, guide of v share precedence 90 but are normative and technical") in said and (2, "dangling_reference", "requirements name DELETE /cards/{x}, which no operation of v defines") in said


def test_conflicts_alone_need_no_search(spark, corpus, monkeypatch):
    def searched(*_, **__):
        raise AssertionError("a search for the conflicts alone")

    for name in ("scored", "best"):
        monkeypatch.setattr(evidence.search, name, searched, raising=False)
    asked = spark.createDataFrame([(1, "v", "GET", "/cards/{cardId}")], "ask_id long, version string, method string, path string")
    assert {r["kind"] for r in evidence.bundles(asked, *corpus)["conflicts"].collect()} == {"declared", "dangling_reference", "precedence_tie"}


def test_operations_that_refer_to_the_same_have_one_closure(spark, corpus, monkeypatch):
    roots, closure = [], evidence.graph.ordered_closure
    monkeypatch.setattr(evidence.graph, "ordered_closure", lambda start, *a: roots.extend(r.root for r in start.select("root").distinct().collect()) or closure(start, *a))
    asked = spark.createDataFrame([(i, "v", "GET", f"/cards/{{card{i}}}") for i in range(20)], "ask_id long, version string, method string, path string")
    got = sorted((r["ask_id"], r["depth"], r["name"], r["sha256"]) for r in evidence.bundles(asked, *corpus)["schemas"].collect())
    assert got == [(i, *x) for i in range(20) for x in ((1, "Card", "ff77"), (1, "Gone", None), (2, "Owner", "ff88"))] and len(roots) == 1


def test_nothing_asked(spark, corpus):
    asked = spark.createDataFrame([], "ask_id long, version string, method string, path string")
    assert all(df.collect() == [] for n, df in evidence.bundles(asked, *corpus).items() if n != "sources")


def test_typed_citations(spark, corpus):
    operations, schemas, _, _, documents, pages, _ = corpus
    chunks = spark.createDataFrame([("guide", "guide#1", "4.2 Fees/Limits", "text"), ("guide", "guide#2", None, "more")], "source_id string, chunk_id string, section string, text string")
    keys = endpoints.locator_keys(chunks, operations, schemas)
    wanted = {
        "section:4": "resolved", "section:4.2": "resolved", "section:4.2 Fees": "resolved", "section:4.2 Fees/Limits": "resolved", "section:4.2 Fee": "dangling", "section:5": "dangling", "chunk:guide#2": "resolved", "chunk:guide#9": "dangling",
        "page:2": "resolved", "page:3": "dangling", "document": "resolved", "nonsense": "dangling"}
    rows = [("R", "guide", x, None) for x in wanted] + [("R", "api", x, p) for x, p in (("op:GET /cards/{id}", "EE5"), ("op:get /cards/{id}", "00"), ("op:PUT /cards/{id}", None), ("path:/cards/{id}/holds", None), ("schema:Owner", "ff88"), ("schema:Nobody", None))]
    rows += [("R", "lost", "section:1", None), ("R", "unknown", "page:1", None)]
    cited = spark.createDataFrame(rows, "requirement_id string, source_id string, locator string, pin string")
    got = {(r["source_id"], r["locator"]): r["status"] for r in endpoints.source_status(cited, documents, pages, keys).collect()}
    assert {x: got["guide", x] for x in wanted} == wanted
    assert [got["api", x] for x in ("op:GET /cards/{id}", "op:get /cards/{id}", "op:PUT /cards/{id}", "path:/cards/{id}/holds", "schema:Owner", "schema:Nobody")] == ["resolved", "stale", "dangling", "resolved", "resolved", "dangling"]
    assert got["lost", "section:1"] == "unavailable" and got["unknown", "page:1"] == "unknown_source"
    assert endpoints.resolved_citations(cited, documents, pages, keys).where(F.col("locator") == "schema:Owner").first()["sha256"] == "ff88"
