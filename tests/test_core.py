"""The library outside llm: functions, pages, contracts, differences, index generations, services, streams."""

import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.jobs import index, registry, services
from evidra.operators import chunks, endpoints, graph, pages, search
from evidra.sources import contracts, manifest
from evidra.sources.generations import Generations
from evidra.streaming import ingest
from tests.conftest import DATA


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("path", "prefix", "key"),
    [("/v1/accounts/{account-id}/x", "/v1", "/accounts/{}/x"), ("/v10/accounts", "/v1", "/v10/accounts"), ("/v1", "/v1", "/"), (" /a//b/ ", "", "/a/b")],
)
def test_path_key(spark, path, prefix, key):
    assert value(spark, T.path_key(F.lit(path), prefix)) == key


@pytest.mark.parametrize(("a", "b", "score"), [("/a/{x}", "/a/{x}", 3), ("/v1/a/{x}", "/v2/a/{x}", 2), ("/a/{account-id}", "/b/{accountId}", 1), ("/a/{x}", "/a/{y}", 0)])
def test_template_score(spark, a, b, score):
    assert value(spark, T.template_score(F.lit(a), F.lit(b))) == score


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("document", ("document", None, None, None, None, None)),
        (" Page:3 ", ("page", 3, 3, None, None, None)),
        ("pages:2-2", ("page", 2, 2, None, None, None)),
        ("pages:2-51", ("pages", 2, 51, None, None, None)),
        ("pages:2-52", (None, None, None, None, None, "invalid_locator")),
        ("page:0", (None, None, None, None, None, "invalid_locator")),
        ("operation:get /a/{b}", ("operation", None, None, "GET", "/a/{b}", None)),
        ("op:FETCH /a", (None, None, None, None, None, "invalid_locator")),
        ("path:/a/../b", (None, None, None, None, None, "invalid_locator")),
        ("schema:Amount", ("schema", None, None, None, "Amount", None)),
        ("schema:a b", (None, None, None, None, None, "invalid_locator")),
        ("section: 4.1 Scope", ("section", None, None, None, "4.1 Scope", None)),
        ("", (None, None, None, None, None, "invalid_locator")),
    ],
)
def test_locators(spark, text, want):
    assert tuple(value(spark, T.locator(F.lit(text)))) == want


def test_identifiers(spark):
    text = 'Call GET /v2/things/{thing-id}/parts with header "X-Trace-Id", sortOrder.'
    assert value(spark, T.identifiers(F.lit(text))) == ["/v2/things/{thing-id}/parts", "get /v2/things/{thing-id}/parts", "sortorder", "x-trace-id"]


def test_plain_words_part_identifiers(spark):
    """However many plain words lie between a method and a path, they are no neighbours; what plain words touch stays whole."""
    for n in (0, 1, 63, 64, 65, 128, 129):
        got = value(spark, T.identifiers(F.lit("start GET " + "word, " * n + "(/x) camelCase\u00e9 word-word. end")))
        assert got == ["/x", "camelcase\u00e9", *["get /x"] * (n == 0), "word-word"]
    assert value(spark, T.identifiers(F.lit("plain " * 200))) == [] and value(spark, T.identifiers(F.lit(None).cast("string"))) is None
    assert spark.range(1).select(F.regexp_replace(F.lit("plain words " * 64), T._PLAIN, ". ").alias("x")).first().x == ". . "  # looked at by runs, not one by one


def test_many_identifiers_are_all_kept(spark):
    want = [f"key-{i:04}" for i in range(1000)]
    assert value(spark, T.identifiers(F.lit(" ".join(reversed(want))))) == want


@pytest.mark.parametrize(("line", "want"), [("## Scope", ("markdown", "2", "Scope")), ("4.2. Access rules", ("numbered", "4.2", "4.2 Access rules")), ("4.2 access rules", None), ("Annex B", ("annex", "", "Annex B")), ("Annex", None), ("Annex b", None), ("##Scope", ("markdown", "2", "Scope")), ("# ", None), ("5. Error Codes", ("numbered", "5", "5 Error Codes")), ("200 Things", None), ("10 Items are listed here:", None), ("#hash", None)])
def test_headings_agree(spark, line, want):
    got = value(spark, T.heading(F.lit(line)))
    assert (tuple(got) if got else None) == want
    plain = chunks.heading(line)
    assert (plain and (plain[0], plain[2])) == (want and (want[0], want[2]))


def test_excerpt_cuts_at_characters(spark):
    assert value(spark, T.excerpt(F.lit("é" * 700))) == "é" * 600 + "…" and value(spark, T.excerpt(F.lit("é" * 3), 3)) == "é…" and value(spark, T.excerpt(F.lit("aé" * 10), 4)) == "aéa…"


def test_rejoined_words():
    assert pages.rejoin("a transac-\ntion and re-\n  issue.") == ("a transaction and reissue.", 2)
    assert pages.rejoin("X-Request-\nID and {account-\nid} a-\nb") == ("X-Request-\nID and {account-\nid} a-\nb", 0)
    assert pages.rejoin("over-\nlap-\nping, yes")[0] == "overlapping, yes"


def _pages(spark, texts):
    return pages.with_quality(pages.with_status(spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "source_id string, page long, text string")))


def test_margins(spark):
    texts = [f"Guide v1.{i}\nbody text number {'abcde'[i]} is here\nmore of it\nPage {i} of 5" for i in range(5)]
    p = _pages(spark, texts)
    assert {r.margin for r in pages.repeated_margins(p, "source_id").collect()} == {"Guide v#.#", "Page # of #", "more of it"}
    cleaned = {r.page: r.text for r in pages.clean_margins(p, "source_id").collect()}
    assert cleaned[2] == "body text number b is here"
    assert pages.repeated_margins(_pages(spark, texts[:3]), "source_id").collect() == []


def test_page_quality_and_status(spark):
    rows = {r.page: r for r in _pages(spark, ["", "good text that is long enough", "��\x01 broken text here ok", "a b c d e f g h i j k l m n o p q r s t u"]).collect()}
    assert [rows[i].status for i in (1, 2, 3, 4)] == ["ocr_required", "extracted", "extracted", "extracted"]
    assert [rows[i].low_quality for i in (1, 2, 3, 4)] == [False, False, True, True]


def test_chunks_carry_headings_over_pages(spark):
    p = _pages(spark, ["# Guide\nintro words here and more\n1 Access\nFirst part. Second part.", "1.1 Rules\nrule text stands here", "2 Other\nlast of the text here"])
    rows = chunks.chunk_pages(p, "source_id").orderBy("page", "ordinal").collect()
    assert [r.section_path for r in rows] == [["Guide"], ["1 Access"], ["1 Access", "1.1 Rules"], ["2 Other"]] or [r.section for r in rows] == ["Guide", "1 Access", "1.1 Rules", "2 Other"]
    assert rows[0].chunk_id == "d:p1:c0" and rows[1].text == "1 Access\n\nFirst part. Second part."


def test_packing_sentences_with_overlap():
    sentences = [f"Sentence number {i} is of this length." for i in range(40)]
    got = chunks.pack([" ".join(sentences)], 200, 60)
    assert all(len(c) <= 200 for c in got) and all(any(s in c for c in got) for s in sentences)
    assert all(a.endswith(b.split(". ")[0] + ".") for a, b in zip(got, got[1:], strict=False))  # the last sentence is repeated
    assert [len(c) for c in chunks.pack(["x" * 500], 100, 20)] == [100] * 5 and chunks.pack([], 100, 20) == []


def test_paragraphs_stay_whole_where_they_fit():
    line = "First line. Second one\nand its end. Third."
    assert chunks.pack([line, line], 200, 0) == [f"{line}\n\n{line}"]
    assert chunks.pack([line, line], 64, 0) == [line, line]
    assert chunks.pack(["a " * 40 + "b.", "Next one here."], 100, 30) == ["a " * 40 + "b.\n\nNext one here."]
    long = " ".join(["word"] * 30) + "."
    assert chunks.pack([long], 64, 0) == [" ".join(["word"] * 12), " ".join(["word"] * 12), " ".join(["word"] * 6) + "."]
    # no sentence begins in the repeated part: it begins at a word; where the unit leaves no room, nothing is repeated
    assert chunks.pack(["one two three four five six seven eight nine ten", "eleven " * 4 + "end"], 64, 20) == ["one two three four five six seven eight nine ten", "eight nine ten\n\n" + "eleven " * 4 + "end"]
    assert chunks.pack(["one two three four five six seven eight nine ten", "x" * 64], 64, 20)[1] == "x" * 64


def test_sentences_end_where_a_new_one_begins():
    text = "See e.g. the table. It says so! Does it? 4 cases. \"Yes.\" done. no split here"
    assert chunks._units(text, 40) == ["See e.g. the table.", "It says so!", "Does it?", "4 cases.", '"Yes." done. no split here']


def test_blocks_of_a_document_are_chunked_apart(spark):
    """Any blocks give what reading the pages one after the other gives, over headings of all kinds, pages without any, gaps and
    several documents; outlines may be put together in any order of steps."""
    rng = random.Random(5)
    lines = ["# Top", "## Under", "### Deeper", "1 First", "1.2 Second part", "1.2.3 Third", "2.1 Other", "Annex Tables", "plain words here.", "", "more words, and more."]
    texts = {(d, p): "\n".join(rng.choices(lines, k=rng.randrange(6))) for d in "abc" for p in range(1, 40) if rng.random() < 0.9}
    want = set()
    for d in "abc":
        stack = []
        for (k, p), text in sorted(texts.items()):
            if k == d and text.strip():
                want |= {(d, p, i, tuple(path), chunk) for i, (path, chunk) in enumerate(chunks.page_chunks(text, stack, 80, 20))}
    assert len({w[3] for w in want}) > 15
    pages_ = spark.createDataFrame([(d, p, "extracted" if t.strip() else "blank", t) for (d, p), t in texts.items()] + [("a", 50, "extracted", None)], "source_id string, page int, status string, text string")
    for block in (1, 4, 1000):
        got = chunks.chunk_pages(pages_.repartition(5), "source_id", 80, 20, block).collect()
        assert {(r.source_id, r.page, r.ordinal, tuple(r.section_path), r.text) for r in got} == want and len(got) == len(want)
    assert chunks.chunk_pages(pages_.limit(0), "source_id").count() == 0
    outlines = [chunks.outline(t) for t in texts.values()]
    for x, y, z in zip(outlines, outlines[1:], outlines[2:], strict=False):
        assert chunks.then(chunks.then(x, y), z) == chunks.then(x, chunks.then(y, z))


def test_chunks_hold_all_of_a_text(spark):
    """Without overlap, a page's chunks in order are its words in order."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("doc_id < 60")
    p = pages.with_status(pages.split_pages(docs, "doc_id", "text"))
    for most in (80, 700):
        got: dict = {}
        for r in chunks.chunk_pages(p, "doc_id", most, 0).orderBy("doc_id", "page", "ordinal").collect():
            assert len(r.text) <= max(most, max(len(x) for x in r.text.split("\n")) if r.ordinal == 0 else most) and r.chunk_id == f"{r.doc_id}:p{r.page}:c{r.ordinal}"
            got.setdefault(r.doc_id, []).extend(r.text.split())
        for r in p.where("status = 'extracted'").collect():
            want = r.text.split()
            assert "".join(got[r.doc_id]) == "".join(want) or "#" in r.text


CONTRACT = {
    "openapi": "3.0.1", "info": {"title": "T", "version": "1"}, "security": [{"oauth": []}], "servers": [{"url": "https://x"}],
    "paths": {
        "/v1/things/{thing-id}": {
            "parameters": [{"$ref": "#/components/parameters/Trace"}, {"name": "thing-id", "in": "path", "schema": {"type": "string"}}],
            "get": {"operationId": "readThing", "summary": "Read", "tags": ["a"], "parameters": [{"name": "X-Trace", "in": "header", "required": True}], "responses": {"200": {"description": "ok", "headers": {"B": {}, "A": {}}, "content": {"application/json": {"schema": {"$ref": "#/components/schemas/Thing"}}}}, "404": {"$ref": "#/components/responses/Missing"}}},
            "post": {"security": [], "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Thing"}}}}, "responses": {"default": {"$ref": "#/components/responses/None"}}},
        },
        "x-extra": {}, "bad path": {"get": {}},
    },
    "components": {
        "parameters": {"Trace": {"$ref": "#/components/parameters/Real"}, "Real": {"name": "X-Trace", "in": "header"}, "Loop": {"$ref": "#/components/parameters/Loop"}},
        "responses": {"Missing": {"description": "gone"}},
        "schemas": {"Thing": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "sub": {"$ref": "#/components/schemas/Sub"}}}, "Sub": {"type": "object", "properties": {"back": {"$ref": "#/components/schemas/Thing"}}}},
    },
}


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("api")
    second = json.loads(json.dumps(CONTRACT).replace("/v1/", "/v2/").replace("{thing-id}", "{thingId}").replace('"thing-id"', '"thingId"'))
    second["components"]["schemas"]["Thing"]["properties"]["id"] = {"type": "string", "format": "date"}
    second["components"]["schemas"]["Thing"]["required"] = ["id", "sub"]
    second["paths"]["/v2/things/{thingId}"]["get"]["responses"]["429"] = {"description": "slow down"}
    import yaml

    (folder / "one.json").write_text(json.dumps(CONTRACT))
    (folder / "two.yaml").write_text(yaml.safe_dump(second, sort_keys=False))
    (folder / "broken.yaml").write_text("a: [")
    raw = contracts.read(spark, str(folder))
    return raw.withColumn("source_id", F.regexp_extract("path", r"([^/.]+)\.\w+$", 1)).withColumn("version", F.when(F.col("source_id") == "one", "v1").otherwise("v2")).cache()


def test_contract_operations(spark, api):
    assert {r.source_id: r.error for r in api.collect()}["broken"].startswith("parse_failed")
    ok = api.where("error is null")
    ops = contracts.operations(ok)
    rows = {(r.source_id, r.method): r for r in ops.collect()}
    assert set(rows) == {(s, m) for s in ("one", "two") for m in ("GET", "POST")}
    get, post = rows[("one", "GET")], rows[("one", "POST")]
    assert (get.security_origin, post.security_origin, post.security, get.tags) == ("global", "operation", "[]", ["a"])
    assert get.json_pointer == "/paths/~1v1~1things~1{thing-id}/get" and get.referenced_schemas == ["Thing"]
    item = CONTRACT["paths"]["/v1/things/{thing-id}"]
    import hashlib

    record = json.dumps({"path_item_parameters": item["parameters"], "operation": item["get"]}, separators=(",", ":"))
    assert get.sha256 == hashlib.sha256(record.encode()).hexdigest()
    parts = contracts.components(ok)
    params = [(r.name, r.required) for r in contracts.parameters(ops.where("source_id = 'one' and method = 'GET'"), parts).orderBy("position").collect()]
    assert params == [("X-Trace", True), ("thing-id", True)]  # the operation's own stands where the path's stood
    answers = {r.status: (r.headers, (r.error or "").split(":")[0]) for r in contracts.responses(ops.where("source_id = 'one'"), parts).collect()}
    assert answers == {"200": (["A", "B"], ""), "404": ([], ""), "default": ([], "unresolved_reference")}  # told, not dropped
    meta = contracts.metadata(ok.where("source_id = 'one'")).first()
    assert (meta.title, meta.servers, meta.schema_count) == ("T", ["https://x"], 2)
    text = {r.method: r for r in contracts.search_text(ops.where("source_id = 'one'"), contracts.parameters(ops, parts), contracts.responses(ops, parts)).collect()}
    assert "Parameter X-Trace (header, required)" in text["GET"].content and "readthing" in text["GET"].identifiers


def test_contract_comparison(spark, api):
    ok = api.where("error is null")
    ops, parts = endpoints.keyed(contracts.operations(ok), {"v1": "/v1", "v2": "/v2"}), contracts.components(ok)
    key = ops.select("source_id", "version", "method", "path", "path_key")
    tables = lambda v: {n: t.where(F.col("version") == v) for n, t in {"operations": ops, "parameters": contracts.parameters(ops, parts).join(key, contracts._OP), "responses": contracts.responses(ops, parts).join(key, contracts._OP), "media": contracts.media_types(ops, parts).join(key, contracts._OP)}.items()}
    changed = endpoints.compare(tables("v1"), tables("v2"))
    got = {(r.method, r.area, r["item"], r.change) for r in changed.collect()}
    assert ("GET", "response", "429", "added") in got and ("GET", "parameter", "path:#0", "modified") in got and ("GET", "operation", "", "unchanged") in got
    assert any("was added" in r.fact for r in endpoints.sentences(changed).collect())
    schemas = contracts.schemas(ok)
    diff = {(r.name, r.pointer, r.kind, r.change) for r in endpoints.schema_changes(schemas, "v1", "v2").collect()}
    assert diff == {("Thing", "/properties/id", "format", "added"), ("Thing", "/properties/sub", "required", "added")}
    edges = schemas.where("source_id = 'one'").select(F.col("name").alias("src"), F.explode("referenced_schemas").alias("dst"))
    assert {r.node for r in graph.cyclic(edges).collect()} == {"Thing", "Sub"}
    docs = spark.createDataFrame([("one", 10), ("two", 20)], "source_id string, precedence int")
    asked = endpoints.keyed(spark.createDataFrame([(1, "v2", "GET", "/things/{thing_id}"), (2, "v2", "GET", "/none")], "ask_id int, version string, method string, path string"), {"v1": "/v1", "v2": "/v2"})
    found = endpoints.lookup(asked, ops, docs).collect()
    assert [(r.ask_id, r.source_id, r.score, r.matched_by) for r in found] == [(1, "two", 1, "canonical")]


REQUIREMENTS = """
schema_version: 1
requirements:
  - {id: R-1, version: v1, title: Read things, sources: [{source_id: guide, locator: "page:1"}, {source_id: guide, locator: "op:GET /things/{thing-id}"}], acceptance_criteria: [one, two], conflicts_with: [{requirement_id: R-2}]}
  - {id: R-2, version: v1, title: Write things, sources: [{source_id: guide, locator: "page:9", sha256: 000000000000}, {source_id: nowhere, locator: document}], endpoints: ["POST /v1/things/{thing-id}"], conflicts_with: [{requirement_id: R-9}]}
"""


def test_requirements(spark, api):
    r = manifest.requirements(spark, REQUIREMENTS.replace("000000000000", '"000000000000"'))
    ops = endpoints.keyed(contracts.operations(api.where("error is null")), {"v1": "/v1", "v2": "/v2"})
    docs = spark.createDataFrame([("guide", "v1", 5, "normative", "indexed", "ab" * 32)], "source_id string, version string, precedence int, authority string, status string, sha256 string")
    pages_ = spark.createDataFrame([("guide", 1, "cd" * 32)], "source_id string, page long, sha256 string")
    t = services.trace(r, docs, pages_, ops, {"v1": "/v1", "v2": "/v2"})
    assert {(x.requirement_id, x.locator, x.status) for x in t["sources"].collect()} == {("R-1", "page:1", "resolved"), ("R-1", "op:GET /things/{thing-id}", "resolved"), ("R-2", "page:9", "dangling"), ("R-2", "document", "unknown_source")}
    assert {(x.requirement_id, x.method, tuple(x.via)) for x in t["endpoints"].collect()} == {("R-1", "GET", ("source_operation",)), ("R-2", "POST", ("endpoint",))}
    assert {x.criterion_id for x in t["criteria"].collect()} == {"R-1/AC1", "R-1/AC2"}
    assert {(x.requirement_id, x.other_id, x.kind) for x in t["conflicts"].collect()} == {("R-1", "R-2", "declared"), ("R-2", "R-1", "declared"), ("R-2", "R-9", "dangling_reference")}
    assert [x["rank"] for x in services.find_requirement(r, "r-1").collect()] == [0]
    assert [x.id for x in services.find_requirement(r, "thin writ").collect()] == ["R-2"]


@pytest.mark.parametrize("bad", ["schema_version: 2\nsources: []", "schema_version: 1\nsources: [{id: A, kind: text, version: v, path: a}]", "schema_version: 1\nsources: [{id: a, kind: text, version: v, path: ../a}]", "schema_version: 1\nsources: [{id: a, kind: openapi, version: v, path: a, blank_pages: [1]}]", "schema_version: 1\nsources: [{id: a, kind: text, version: v, path: a}, {id: a, kind: text, version: v, path: b}]"])
def test_bad_manifests(spark, bad):
    with pytest.raises(manifest.Invalid):
        manifest.sources(spark, bad)


def test_manifest_and_config(spark):
    s = manifest.sources(spark, "schema_version: 1\nsources: [{id: a, kind: text, version: v1, path: text/a.md, blank_pages: [2]}]")
    assert s.first().precedence == 0 and s.first().blank_pages == [2]
    assert manifest.config("[chunking]\nmax_chars = 2000\n[prefixes]\nv1 = '/v1'").max_chars == 2000
    for bad in ("[chunking]\nmax_chars = 400", "[other]\na = 1", "[prefixes]\nv1 = 'v1'", "[corpus]\nmanifest = '/a'"):
        with pytest.raises(manifest.Invalid):
            manifest.config(bad)


SOURCES = "source_id string, version string, precedence long, text string"


def test_index_generations_and_services(spark, tmp_path):
    root = str(tmp_path / "index")
    store = Generations(spark, root)
    a, b = ("a", "v1", 1, "# Guide\nAccounts are read with a consent.\fSecond page about payments and accounts."), ("b", "v1", 2, "Short notes on consent, long enough.")
    first = {r.source_id: r.action for r in index.run(store, spark.createDataFrame([a, b, ("c", "v1", 1, None)], SOURCES)).collect()}
    assert first == {"a": "indexed", "b": "indexed", "c": "missing"}
    catalog = services.Catalog(spark, root)
    again = {r.source_id: r.action for r in index.run(store, spark.createDataFrame([a, (*b[:3], b[3] + " Changed.")], SOURCES)).collect()}
    assert again == {"a": "skipped", "b": "indexed", "c": "removed"}
    assert catalog.number == 1 and catalog.reload() and catalog.number == 2
    assert catalog.pages.count() == 3 and {r.source_id for r in catalog.list_sources("v1").collect()} == {"a", "b"}
    hits = catalog.search("consent accounts").collect()
    assert hits[0].source_id == "a" and hits[0].score >= hits[-1].score
    assert [r.page for r in catalog.read("a", "pages:1-9").collect()] == [1, 2]
    assert catalog.read("a", "section:Guide").count() == 2
    for source, locator, code in (("a", "page:7", "not_found"), ("zz", "document", "not_found"), ("a", "nonsense", "invalid_locator"), ("a", "schema:X", "invalid_input")):
        with pytest.raises(services.Refused) as e:
            catalog.read(source, locator)
        assert e.value.code == code
    assert index.health(store).collect() == []
    assert {(r.check, r.source_id) for r in index.doctor(store, spark.createDataFrame([a, ("d", "v1", 1, "x")], SOURCES)).collect()} == {("not_declared", "b"), ("not_indexed", "d")}
    index.run(store, spark.createDataFrame([a], SOURCES))
    assert store.numbers() == [2, 3]
    Path(root, "CURRENT").write_text("77\n")
    Path(root, ".CURRENT.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        store.current()


def test_streamed_files(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "index")
    for n, rows in enumerate(([("a", "v1", 1, "first text of the source a")], [("a", "v1", 1, "new text of the source a"), ("b", "v1", 1, "text of the source b here")])):
        spark.createDataFrame(rows, SOURCES).coalesce(1).write.mode("append").parquet(folder)
        ingest.index_new_files(spark, folder, SOURCES, root, str(tmp_path / "state")).awaitTermination()
        assert Generations(spark, root).current() == n + 1
    docs = Generations(spark, root).read("pages")
    assert {(r.source_id, r.text) for r in docs.collect()} == {("a", "new text of the source a"), ("b", "text of the source b here")}


def test_event_counts_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").select("ts", "event_type", "value")
    want = {tuple(r) for r in ingest.event_counts(events).collect()}
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    q = ingest.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("counted").collect()} == want


def test_search_scores(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "delta"), (4, None)], "id int, text string")
    asked = spark.createDataFrame([(0, ["beta", "alpha"]), (1, ["none"])], "q int, terms array<string>")
    rows = search.top(search.scored(docs, "id", "text", asked, "q", "terms"), "q", "id", 5).orderBy("rank").collect()
    assert [(r.q, r.id) for r in rows] == [(0, 1), (0, 2)]


@pytest.mark.parametrize(("word", "want"), [("consigning", "consign"), ("generated", "generat"), ("communism", "communism"), ("skies", "sky"), ("hopping", "hop"), ("hoping", "hope"), ("abilities", "abil"), ("conditional", "condit"), ("ties", "tie"), ("by", "by"), ("luxuriating", "luxuri"), ("knightly", "knight")])
def test_stems(word, want):
    from evidra.functions.stem import stem

    assert stem(word) == want


def test_quantised_lengths(spark):
    got = [r.v for r in spark.range(0, 340).select(search.quantised(F.col("id")).alias("v")).collect()]
    steps = [*range(40), *range(40, 56, 2), *range(56, 88, 4), *range(88, 152, 8), *range(152, 280, 16), *range(280, 340, 32)]
    assert sorted(set(got)) == steps and all(v <= i for i, v in enumerate(got))


def test_fielded_scores_match_plain_python(spark):
    import math

    from evidra.functions.stem import stem

    records = [(1, "v1", "pdf", "Account access", "Guide", "Accounts are accessed with a consent by accounts", ["/accounts", "x-id"]), (2, "v1", "text", "Payments", None, "payment of an account " * 12, None), (3, "v2", "pdf", None, None, "nothing here", ["x-id"])]
    df = spark.createDataFrame(records, "id int, version string, kind string, title string, section_context string, content string, identifiers array<string>")
    asked = spark.createDataFrame([(0, "account accounts x-id", "v1", None), (1, "payment", None, "text")], "q int, text string, version string, kind string")
    postings, figures = search.index_terms(df, "id")
    got = {(r.q, r.id): r.score for r in search.ask(df, postings, figures, "id", asked, ["version", "kind"]).collect()}
    import re

    words = lambda t: [stem(w) for w in re.split(r"[^0-9a-z]+", (t or "").lower()) if w]
    fields = {f: {r[0]: words(r[i]) for r in records} for f, i in (("title", 3), ("section_context", 4), ("content", 5))} | {"identifiers": {r[0]: r[6] or [] for r in records}}
    idf = lambda n, d: math.log(1 + (n - d + 0.5) / (d + 0.5))
    floor = lambda n: n if n < 40 else n - n % 2
    want = {}
    for q, text, version, kind in ((0, "account accounts x-id", "v1", None), (1, "payment", None, "text")):
        for r in records:
            if (version and r[1] != version) or (kind and r[2] != kind):
                continue
            score, hit = 0.0, False
            for f, rows in fields.items():
                terms = [text, *text.split()] if f == "identifiers" else words(text)
                terms = sorted(set(terms)) if f == "identifiers" else terms
                mean = sum(map(len, rows.values())) / 3
                for t in terms:
                    tf = rows[r[0]].count(t)
                    if tf:
                        hit = True
                        n = sum(t in x for x in rows.values())
                        score += (search.BOOSTS | {"identifiers": 3.0})[f] * idf(3, n) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * floor(len(rows[r[0]])) / mean))
            if hit:
                score += (idf(3, sum(x[1] == version for x in records)) if version else 0) + (idf(3, sum(x[2] == kind for x in records)) if kind else 0)
                want[(q, r[0])] = round(score, 3)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.0011 for k in want)


def test_collapse_in_rank_order(spark):
    rows = [("a", "h1", "s", 1, None, "chunk"), ("b", "h2", "s", 1, None, "chunk"), ("c", "h3", "s", 2, None, "chunk"), ("d", "h3", "t", 1, None, "chunk"), ("e", "h5", "u", None, "schema:X", "schema"), ("f", "h6", "u", 7, None, "chunk"), ("g", "h7", "u", 8, None, "chunk"), ("h", "h8", "w", None, "schema:X", "schema")]
    hits = spark.createDataFrame([(0, i + 1, k, "v", sha, src, page, loc, kind) for i, (k, sha, src, page, loc, kind) in enumerate(rows)], "q int, rank int, key_id string, version string, sha256 string, source_id string, page int, locator string, record_type string")
    got = {r["rank"]: (r.kept_by, r.reason) for r in search.collapse_hits(hits, 4).collect()}
    assert got == {1: (1, None), 2: (1, "same_page"), 3: (3, None), 4: (3, "identical_content"), 5: (5, None), 6: (6, None), 8: (5, "same_schema")}


def test_all_tokens_of_a_statement_are_asked(spark):
    """Against brute force; the fourth and later tokens count, too, and short ones."""
    asked = {1: "Alpha beta gamma delta", 2: "alpha BETA gamma omega", 3: "be al", 4: "..."}
    texts = {1: "gammas deltas alphabet betas", 2: "alpha beta gamma", 3: "omega, gamma; alpha-beta", 4: "", 5: "beta"}
    tokens = lambda t: {w for w in re.split(r"[^a-z]+", t.lower()) if len(w) >= 2}
    want = {(q, d) for q, a in asked.items() for d, t in texts.items() if tokens(a) and all(any(w.startswith(x) for w in tokens(t)) for x in tokens(a))}
    got = registry.documents_with_prefixes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(asked.items()), "item_id long, text string"))
    assert {(r.item_id, r.doc_id) for r in got.collect()} == want == {(1, 1), (2, 3), (3, 1), (3, 2), (3, 3)}


def test_closure_of_a_long_chain(spark):
    """More than 64 levels."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(67)], "src int, dst int")
    got = graph.closure(edges, spark.createDataFrame([(0,)], "root int"))
    assert {(r.node, r.depth) for r in got.collect()} == {(i, i) for i in range(68)}


def test_cyclic_nodes_of_several_circles(spark):
    """Against a plain walk: circles that share nodes, tails before and behind, a bridge, a node that refers to itself."""
    import random

    draw = random.Random(5)
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 7), (8, 1), (9, 9), (10, 11), (None, 1), (2, None)] + [(draw.randrange(20, 60), draw.randrange(20, 60)) for _ in range(45)]
    after = {}
    for a, b in pairs:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)

    def reached(a):
        seen, open_ = set(), list(after.get(a, ()))
        while open_:
            x = open_.pop()
            if x not in seen:
                seen.add(x)
                open_ += after.get(x, ())
        return seen

    got = graph.cyclic(spark.createDataFrame(pairs, "src int, dst int"))
    assert sorted(r.node for r in got.collect()) == sorted(a for a in after if a in reached(a))
    assert graph.cyclic(spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")).isEmpty()


def test_references_across_sources(spark):
    """Own definitions first, then the version's best; circles end; what nobody defines is told."""
    defs = spark.createDataFrame([("a", "v", "X", 1), ("a", "v", "Y", 1), ("b", "v", "Z", 2), ("c", "v", "Z", 3), ("b", "w", "Q", 2)], "source_id string, version string, name string, precedence int")
    refs = spark.createDataFrame([("a", "v", "X", "Y"), ("a", "v", "Y", "Z"), ("a", "v", "Y", "Q"), ("c", "v", "Z", "X")], "source_id string, version string, name string, target string")
    got = graph.reference_closure(defs, refs).where("root_name = 'X'")
    assert {(r.source_id, r.name, r.depth, r.cross_source, r.unresolved) for r in got.collect()} == {("a", "X", 0, False, False), ("a", "Y", 1, False, False), ("c", "Z", 2, True, False), (None, "Q", 2, False, True)}


def test_reference_closure_keeps_a_name_of_each_source_that_is_reached(spark):
    """X of a leads to its own Y, and by Z, which only c has, to the Y of c; beyond 2,000 definitions nothing is left out."""
    defs = spark.createDataFrame([("a", "v", "X", 1), ("a", "v", "Y", 1), ("c", "v", "Z", 5), ("c", "v", "Y", 5)], "source_id string, version string, name string, precedence long")
    refs = spark.createDataFrame([("a", "v", "X", "Y"), ("a", "v", "X", "Z"), ("c", "v", "Z", "Y"), ("c", "v", "Y", "X")], "source_id string, version string, name string, target string")
    got = graph.reference_closure(defs, refs).where("root_name = 'X'")
    assert sorted((r.source_id, r.name, r.depth) for r in got.collect()) == [("a", "X", 0), ("a", "Y", 1), ("c", "Y", 2), ("c", "Z", 1)]
    wide = spark.range(2100).selectExpr("'a' AS source_id", "'v' AS version", "concat('N', id) AS name", "1L AS precedence")
    to = wide.where("name <> 'N0'").selectExpr("source_id", "version", "'N0' AS name", "name AS target")
    assert graph.reference_closure(wide, to, wide.where("name = 'N0'")).count() == 2100


def test_traced_takes_the_first_source_of_all_that_are_reached(spark):
    """X of b leads to Y of b and, by Z, to Y of a: both are reached, and a comes first."""
    defs = spark.createDataFrame([("b", "v", "X", 1), ("b", "v", "Y", 1), ("a", "v", "Z", 5), ("a", "v", "Y", 0)], "source_id string, version string, name string, precedence long")
    refs = spark.createDataFrame([("b", "v", "X", "Y"), ("b", "v", "X", "Z"), ("a", "v", "Z", "Y")], "source_id string, version string, name string, target string")
    roots = spark.createDataFrame([("R", "v", 0, "X", "explicit", None)], "requirement_id string, version string, seq int, name string, via string, source_id string")
    got = graph.traced(roots, defs, refs)
    assert sorted((r["name"], r.via, r.source_id) for r in got.collect()) == [("X", "explicit", "b"), ("Y", "transitive:X", "a"), ("Z", "transitive:X", "a")]


def test_schema_text(spark):
    """Properties by name, texts of the keys that are searched, items of lists, in the source's order; no JSON, no lines."""
    schema = '{"type":["string","null"],"x-note":"not said","properties":{"b":{"enum":["x","y",1],"title":"B"},"description":{"$ref":"#/a"}},"minimum":"3","allOf":[{"pattern":"p"}]}'
    named = spark.createDataFrame([("s", "v", "Thing", schema), ("s", "v", "Broken", "{"), ("s", "v", "None", None)], "source_id string, version string, name string, schema string")
    got = {r.name: r.content for r in contracts.schema_text(named).collect()}
    assert got == {"Thing": "Schema Thing\nstring\nnull\nproperty b\nx\ny\nB\nproperty description\n#/a\np\n", "Broken": "Schema Broken\n", "None": "Schema None\n"}


def _closure(spark, defs, refs, asked, most=2000):
    d = spark.createDataFrame(defs, "source_id string, version string, name string, precedence long")
    r = spark.createDataFrame([(s, "v", n, t, i) for s, n, targets in refs for i, t in enumerate(targets)], "source_id string, version string, name string, target string, position int")
    a = spark.createDataFrame(asked, "root string, version string, source_id string, name string, position int")
    got = graph.ordered_closure(a, d, r, most).orderBy("depth", "place").collect()
    return [(x["root"], x["name"], x["source_id"], x["depth"]) for x in got], got


def test_ordered_closure_settles_a_name_once(spark):
    """Two sources define Y: the first reference to arrive decides which one counts; circles end; a cross-source reference
    has its candidates; what no source defines is unresolved."""
    defs = [("a", "v", "X", 1), ("a", "v", "Y", 1), ("b", "v", "Y", 5), ("b", "v", "Z", 5), ("c", "v", "Z", 9)]
    refs = [("a", "X", ["Z", "Y"]), ("c", "Z", ["Y", "Q"]), ("a", "Y", ["X"]), ("b", "Y", ["never"])]
    names, rows = _closure(spark, defs, refs, [("r", "v", "a", "X", 0)])
    assert names == [("r", "X", "a", 1), ("r", "Z", "c", 2), ("r", "Y", "a", 2), ("r", "Q", None, 3)]
    assert [(x["cross_source"], x["candidates"], x["unresolved"], x["truncated"]) for x in rows] == [(False, None, False, False), (True, 2, False, False), (False, None, False, False), (False, None, True, False)]
    names, _ = _closure(spark, defs, [("a", "X", ["Z"]), *refs[1:]], [("r", "v", "a", "X", 0)])
    assert ("r", "Y", "b", 3) in names and ("r", "never", None, 4) in names


def test_ordered_closure_tells_what_it_leaves_out(spark):
    defs = [("a", "v", n, 1) for n in "ABCDE"]
    refs = [("a", "A", ["B", "none", "C", "D"]), ("a", "B", ["A"]), ("a", "C", ["E"])]
    asked = [("r", "v", "a", "A", 0), ("s", "v", "a", "B", 0), ("t", "v", "a", "E", 0)]
    names, rows = _closure(spark, defs, refs, asked, 3)
    assert {x["root"]: x["truncated"] for x in rows} == {"r": True, "s": True, "t": False}
    assert {n for r, n, *_ in names if r == "r"} == {"A", "B", "none", "C"} and {n for r, n, *_ in names if r == "s"} == {"B", "A", "none", "C"}
    assert _closure(spark, defs, refs, asked[2:], 1)[0] == [("t", "E", "a", 1)] and not _closure(spark, defs, refs, asked[2:], 1)[1][0]["truncated"]
    assert _closure(spark, defs, refs, asked[:0])[0] == []


def test_ordered_closure_walks_no_further_from_a_root_that_is_cut(spark, monkeypatch):
    levels, keep = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: levels.append(1) or keep(df) if "place" in df.columns else keep(df))
    names = [f"B{i:02}" for i in range(30)]
    names, rows = _closure(spark, [("a", "v", n, 1) for n in ["A", *names, "C"]], [("a", "A", names), *[("a", n, ["C", "A"]) for n in names]], [("r", "v", "a", "A", 0)], 10)
    assert len(names) == 10 and all(x["truncated"] for x in rows) and len(levels) == 2


def test_chunks_read_a_batch_in_small_parts():
    """A batch of Arrow may hold 10,000 pages; few of them are Python objects at one time."""
    import pyarrow as pa

    real, sizes = pa.RecordBatch.from_pydict({"k": list(range(1000)), "text": ["x"] * 1000}), []

    class Batch:
        num_rows = 1000

        def slice(self, at, n):
            sizes.append(n)
            return real.slice(at, n)

    assert list(chunks._rows([Batch()])) == [(k, "x") for k in range(1000)] and max(sizes) <= chunks.ROWS
