"""References of a contract, wherever they point."""

import json

from evidra.sources import contracts

SHARED = {"name": "limit", "in": "query", "required": True, "schema": {"type": "integer"}}
CONTRACT = {
    "openapi": "3.0.3", "info": {"title": "t", "version": "1"},
    "paths": {
        "/a/{id}": {"get": {"parameters": [SHARED, {"$ref": "#/components/parameters/one"}], "responses": {"200": {"description": "fine"}}}},
        "/b": {"get": {"parameters": [{"$ref": "#/paths/~1a~1{id}/get/parameters/0"}, {"$ref": "other.yaml#/x"}], "responses": {"200": {"$ref": "#/paths/~1a~1{id}/get/responses/200"}, "404": {"$ref": "#/x-shared/gone"}, "500": {"$ref": "#/x-shared/chain"}, "503": {"$ref": "#/x-shared/loop"}}}}},
    "x-shared": {"chain": {"$ref": "#/components/responses/bad"}, "loop": {"$ref": "#/x-shared/loop"}},
    "components": {"parameters": {"one": {"$ref": "#/paths/~1a~1{id}/get/parameters/0"}}, "responses": {"bad": {"description": "went wrong"}}}}


def test_any_local_pointer(spark):
    df = spark.createDataFrame([("s", "v", json.dumps(CONTRACT)), ("t", "v", json.dumps({"openapi": "3.0.0", "paths": {}}))], "source_id string, version string, json string")
    parts = contracts.components(df)
    assert {r["pointer"]: json.loads(r["json"]) for r in parts.collect()} == {
        "#/components/parameters/one": SHARED, "#/components/responses/bad": {"description": "went wrong"}, "#/paths/~1a~1{id}/get/parameters/0": SHARED, "#/paths/~1a~1{id}/get/responses/200": {"description": "fine"}, "#/x-shared/chain": {"description": "went wrong"}}
    ops = contracts.operations(df)
    assert {(r["path"], r["name"], r["component"]) for r in contracts.parameters(ops, parts).collect()} == {("/a/{id}", "limit", None), ("/b", "limit", "#/paths/~1a~1{id}/get/parameters/0")}
    got = {r["status"]: (r["description"], r["error"]) for r in contracts.responses(ops, parts).where("path = '/b'").collect()}
    assert got == {"200": ("fine", None), "404": (None, "unresolved_reference: #/x-shared/gone"), "500": ("went wrong", None), "503": (None, "unresolved_reference: #/x-shared/loop")}
