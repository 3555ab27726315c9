"""Schemas compared through their references."""

import json

import pytest

from evidra.operators import schemas

REF = "#/components/schemas/"


def changes(spark, old, new, roots=("A",)):
    rows = [(side, name, json.dumps(s)) for side, given in (("old", old), ("new", new)) for name, s in given.items()]
    df = schemas.differences(spark.createDataFrame(rows, "side string, name string, schema string"), spark.createDataFrame([(r, *(r.split(">") * 2)[:2]) for r in roots], "root string, old_name string, new_name string"))
    return sorted((r["root"], r["pointer"], r["kind"], r["change"], r["before"], r["after"], r["schema_name"]) for r in df.collect())


def kinds(old, new):
    return sorted((k, at) for at, k, *_ in schemas.compared(old, new)[0])


def test_parts_of_one_schema():
    old = {"type": "object", "required": ["a", "gone"], "properties": {"a": {"type": "integer", "format": "int32"}, "b": {"enum": [1, 2]}, "c": {"maxLength": 4}, "gone": {}}}
    new = {"type": "object", "required": ["c"], "properties": {"a": {"type": "string", "format": "uuid"}, "b": {"enum": [2, True]}, "c": {"maxLength": 5, "nullable": True}, "come/~": {}}}
    assert kinds(old, old) == []
    assert kinds(old, new) == [
        ("constraint_changed", "/properties/c/maxLength"), ("enum_values_added", "/properties/b/enum"), ("enum_values_removed", "/properties/b/enum"), ("format_changed", "/properties/a/format"),
        ("nullable_changed", "/properties/c"), ("property_added", "/properties/come~1~0"), ("property_removed", "/properties/gone"), ("required_added", "/properties/c"), ("required_removed", "/properties/a"), ("type_changed", "/properties/a")]


@pytest.mark.parametrize(("old", "new", "want"), [
    ({"enum": ["x"]}, {}, [("enum_constraint_changed", "/enum")]),
    ({}, {"items": {"type": "string"}}, [("constraint_changed", "/items")]),
    ({"items": {"type": "string"}}, {"items": {"type": "number"}}, [("type_changed", "/items")]),
    ({"oneOf": [{}]}, {"oneOf": [{"type": "string"}, {}]}, [("composition_changed", "/oneOf"), ("type_changed", "/oneOf/0")]),
    ({"allOf": [{}]}, {}, [("composition_changed", "/allOf")]),
    ({"type": "string"}, {"type": ["string", "null"]}, [("nullable_changed", "")]),
    ({"additionalProperties": False}, {"additionalProperties": {"type": "string"}}, [("additional_properties_changed", "/additionalProperties")]),
    ({"additionalProperties": {"type": "integer"}}, {"additionalProperties": {"type": "string"}}, [("type_changed", "/additionalProperties")]),
    ({"default": 1}, {"default": True}, [("constraint_changed", "/default")]),
    ({"default": None}, {}, [("constraint_changed", "/default")]),
    ({"required": ["x"]}, {}, [("required_removed", "/properties/x")]),
    ({"type": 3, "properties": []}, {"enum": 4}, []),
])
def test_rules(old, new, want):
    assert kinds(old, new) == want


def test_a_circle_is_told_once(spark):
    node = lambda t: {"A": {"properties": {"next": {"$ref": REF + "A"}, "v": {"type": t}}}}
    assert changes(spark, node("string"), node("integer")) == [("A", "/properties/v", "type_changed", "modified", '["string"]', '["integer"]', "A")]


def test_first_pointer_settles_a_shared_schema(spark):
    base = lambda t: {"A": {"properties": {"far": {"properties": {"x": {"$ref": REF + "B"}}}, "near": {"$ref": REF + "C"}, "also": {"$ref": REF + "C"}}}, "B": {"items": {"$ref": REF + "D"}}, "C": {"items": {"$ref": REF + "D"}}, "D": {"type": t}}
    assert [r[1:3] for r in changes(spark, base("string"), base("number"))] == [("/properties/also/items", "type_changed")]


def test_chains_moves_and_dangling_references(spark):
    old = {"A": {"properties": {"x": {"$ref": REF + "B"}, "y": {"$ref": REF + "Nowhere"}, "z": {"$ref": REF + "D"}, "w": {"$ref": "other.yaml#/x"}}}, "B": {"$ref": REF + "C"}, "C": {"type": "string"}, "D": {"type": "string"}}
    new = {"A": {"properties": {"x": {"$ref": REF + "E"}, "y": {"$ref": REF + "Nowhere"}, "z": {"type": "number"}, "w": {"$ref": "other.yaml#/y"}}}, "E": {"type": ["string", "null"]}}
    assert changes(spark, old, new) == [
        ("A", "/properties/x", "nullable_changed", "modified", "false", "true", "E"), ("A", "/properties/x", "ref_changed", "modified", f'"{REF}C"', f'"{REF}E"', "A"),
        ("A", "/properties/z", "ref_changed", "modified", f'"{REF}D"', '"inline"', "A"), ("A", "/properties/z", "type_changed", "modified", '["string"]', '["number"]', "D")]


def test_roots_share_pairs_and_may_be_renamed(spark):
    old = {"A": {"items": {"$ref": REF + "S"}}, "B": {"items": {"$ref": REF + "S"}}, "S": {"minimum": 1}}
    new = {"A": {"items": {"$ref": REF + "S"}}, "C": {"items": {"$ref": REF + "S"}}, "S": {"minimum": 2}}
    got = changes(spark, old, new, ("A", "B>C"))
    assert [(r[0], r[1], r[2], r[6]) for r in got] == [("A", "/items/minimum", "constraint_changed", "S"), ("B>C", "/", "ref_changed", None), ("B>C", "/items/minimum", "constraint_changed", "S")]


def test_circles_of_references_alone(spark):
    loop = {"A": {"$ref": REF + "B"}, "B": {"$ref": REF + "A"}}
    assert changes(spark, loop, loop) == []


def test_equal_texts_are_compared_once(monkeypatch):
    calls, keep = [], schemas.compared
    monkeypatch.setattr(schemas, "compared", lambda *a: calls.append(a) or keep(*a))
    old, new, ref = '{"type":"string"}', '{"type":"integer"}', '{"items":{"$ref":"#/components/schemas/B"}}'
    rows = list(schemas._told([("p", old, new), ("q", old, new), ("r", ref, ref), ("s", ref, ref), ("t", old, old)]))
    assert [r[:3] for r in rows] == [("p", "", "type_changed"), ("q", "", "type_changed"), ("r", "/items", "edge"), ("s", "/items", "edge")] and len(calls) == 3
