"""Schemas of two versions compared through their references: each pair of definitions that a comparison meets is compared
once, however many schemas lead to it, and what a schema's comparison says is gathered along the pairs that it leads to.

A pair's two definitions are taken apart side by side as far as they are written out; where either side refers to another
schema, an edge leads to the next pair. The pairs are found level by level, each by one join against those that are known;
the walk from each root is level by level, too, and the first to arrive (level, then pointer) settles a pair for its root, so
circles end where they close. Facts only, no verdict."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.operators.endpoints import CONSTRAINTS
from evidra.sources.tables import spread, written

#: References that are followed from one to the next.
MAX_REFS = 32
_PREFIX = "#/components/schemas/"
_MISSING = object()


def _plain(v) -> str | None:
    return None if v is _MISSING else json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _facts(node: dict) -> dict[tuple[str, str], object]:
    """What is compared as it stands: {(pointer below the node, kind): value}."""
    types = node.get("type")
    types = [types] if isinstance(types, str) else types if isinstance(types, list) else []
    out: dict[tuple[str, str], object] = {("", "type_changed"): sorted({t for t in types if isinstance(t, str)} - {"null"})}
    out["", "nullable_changed"] = node.get("nullable") is True or (isinstance(node.get("type"), list) and "null" in types)
    for key in CONSTRAINTS:
        if key in node:
            out[f"/{key}", "format_changed" if key == "format" else "constraint_changed"] = node[key]
    if not isinstance(node.get("additionalProperties", _MISSING), dict) and "additionalProperties" in node:
        out["/additionalProperties", "additional_properties_changed"] = node["additionalProperties"]
    return out


def _named(node) -> bool:
    return isinstance(node, dict) and isinstance(node.get("$ref"), str) and node["$ref"].startswith(_PREFIX)


def compared(old: dict, new: dict) -> tuple[list[tuple], list[tuple]]:
    """(changes, edges) of two definitions: (pointer, kind, change, before, after), and (pointer, old part, new part) where a
    part is a reference to a schema."""
    changes, edges, open_ = [], [], [("", old, new)]

    def tell(pointer, kind, before, after, change=None):
        change = change or ("added" if before is _MISSING else "removed" if after is _MISSING else "modified")
        changes.append((pointer, kind, change, _plain(before), _plain(after)))

    def children(node: dict) -> dict[str, object]:
        """Parts that are compared with the other side's, where it has them."""
        out = {f"/{k}": node[k] for k in ("items", "additionalProperties") if isinstance(node.get(k), dict)}
        for key in ("allOf", "oneOf", "anyOf"):
            if isinstance(node.get(key), list):
                out |= {f"/{key}/{i}": part for i, part in enumerate(node[key])}
        return out

    while open_:
        at, a, b = open_.pop()
        if at and (_named(a) or _named(b)):
            edges.append((at, a, b))
            continue
        a, b = (x if isinstance(x, dict) else {} for x in (a, b))
        one, two = _facts(a), _facts(b)
        mixed = isinstance(a.get("additionalProperties"), dict) != isinstance(b.get("additionalProperties"), dict)
        for where, kind in sorted(one.keys() | two.keys()):
            before, after = one.get((where, kind), _MISSING), two.get((where, kind), _MISSING)
            if kind != "additional_properties_changed" and _plain(before) != _plain(after):
                tell(at + where, kind, before, after)
        if mixed or _plain(one.get(("/additionalProperties", "additional_properties_changed"), _MISSING)) != _plain(two.get(("/additionalProperties", "additional_properties_changed"), _MISSING)):
            tell(f"{at}/additionalProperties", "additional_properties_changed", a.get("additionalProperties", _MISSING), b.get("additionalProperties", _MISSING), "modified")
        values = [x["enum"] if isinstance(x.get("enum"), list) else _MISSING for x in (a, b)]
        if _MISSING in values:
            if values != [_MISSING, _MISSING]:
                tell(f"{at}/enum", "enum_constraint_changed", *values)
        else:
            for kind, these, those in (("enum_values_added", values[1], values[0]), ("enum_values_removed", values[0], values[1])):
                known = set(map(_plain, those))  # texts, as true is no 1
                if only := [v for v in these if _plain(v) not in known]:
                    tell(f"{at}/enum", kind, *((_MISSING, only) if kind == "enum_values_added" else (only, _MISSING)))
        has = [x["properties"] if isinstance(x.get("properties"), dict) else {} for x in (a, b)]
        must = [{n for n in x["required"] if isinstance(n, str)} if isinstance(x.get("required"), list) else set() for x in (a, b)]
        for name in sorted(has[0].keys() | has[1].keys() | must[0] | must[1]):
            where = f"{at}/properties/{name.replace('~', '~0').replace('/', '~1')}"
            inside = [name in h for h in has]
            if inside == [True, True]:
                open_.append((where, has[0][name], has[1][name]))
            elif any(inside):
                sides = [{"required": name in m, "schema": h[name]} if i else _MISSING for m, h, i in zip(must, has, inside, strict=True)]
                tell(where, "property_added" if inside[1] else "property_removed", *sides)
            now = [name in m for m in must]
            new_side = 1 if now[1] else 0
            if now[0] != now[1] and (inside[1 - new_side] or not inside[new_side]):
                tell(where, "required_added" if now[1] else "required_removed", *now, "modified")
        for key, kind in (("items", "constraint_changed"), ("allOf", "composition_changed"), ("oneOf", "composition_changed"), ("anyOf", "composition_changed")):
            parts = [x[key] if key in x and (key == "items" or isinstance(x[key], list)) else _MISSING for x in (a, b)]
            if _MISSING in parts:
                if parts[0] is not parts[1]:
                    tell(f"{at}/{key}", kind, *parts)
            elif key != "items" and len(parts[0]) != len(parts[1]):
                tell(f"{at}/{key}", kind, len(parts[0]), len(parts[1]))
        left, right = children(a), children(b)
        open_ += [(at + where, left[where], right[where]) for where in left.keys() & right.keys()]
    return changes, edges


def ends(schemas: DataFrame) -> DataFrame:
    """(side, name, end, schema): each of schemas(side, name, schema) with the definition that its references lead to, and
    that one's name; a reference to nothing ends at itself, under the name it asks for."""
    ref = lambda c: F.when(F.get_json_object(c, "$.$ref").startswith(_PREFIX), F.substring(F.get_json_object(c, "$.$ref"), len(_PREFIX) + 1, 1 << 20))
    all_ = written(schemas.select("side", "name", "schema", ref("schema").alias("next")))
    target = all_.select("side", F.col("name").alias("next"), F.col("schema").alias("to"), F.col("next").alias("further"))
    done, open_ = all_.where("next is null").select("side", "name", F.col("name").alias("end"), "schema"), all_.where("next is not null").select("side", "name", "schema", "next")
    for _ in range(MAX_REFS):
        step = written(open_.join(target, ["side", "next"], "left"))
        done = done.unionByName(step.where("to is null").select("side", "name", F.col("next").alias("end"), "schema"))
        done = done.unionByName(step.where("to is not null and further is null").select("side", "name", F.col("next").alias("end"), F.col("to").alias("schema")))
        open_ = step.where("further is not null").select("side", "name", F.col("to").alias("schema"), F.col("further").alias("next"))
        if open_.isEmpty():
            return written(done)
    return written(done.unionByName(open_.select("side", "name", F.col("next").alias("end"), "schema")))


_PAIR = ["old_name", "old", "new_name", "new"]


def _told(pairs: Iterable[tuple[str, str, str]]) -> Iterator[tuple]:
    """(key, pointer, kind, change, before, after) of pairs(key, old, new); neighbours with equal texts are compared once."""
    last: tuple = ()
    for key, *texts in pairs:
        if texts != last:
            last = texts
            changes, edges = compared(*map(json.loads, texts))
            changes += [(at, "edge", "", json.dumps(x), json.dumps(y)) for at, x, y in edges]
        yield from ((key, *c) for c in changes)


def _compare_pairs(pairs: DataFrame) -> DataFrame:
    """What each of pairs says: its changes, and its edges (kind: edge) with the two parts as before and after. Every core takes
    its share of them, equal ones in a row, as many schemas are written alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_told(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(6)], names=["pair", "at", "kind", "change", "before", "after"])

    dealt = spread(pairs.select("pair", "old", "new")).sortWithinPartitions("old", "new")
    return dealt.mapInArrow(run, "pair string, at string, kind string, change string, before string, after string")


def _keyed(pairs: DataFrame) -> DataFrame:
    """pairs(old_name, old, new_name, new) with a key: the names where both sides have one, the texts too where not."""
    both = F.col("old_name").isNotNull() & F.col("new_name").isNotNull()
    side = lambda n, s: F.coalesce(n, F.concat(F.lit("\u0000"), s))
    return pairs.withColumn("pair", F.to_json(F.array(side(F.col("old_name"), F.col("old")), side(F.col("new_name"), F.col("new"))))).withColumn("named", both)


def _resolved(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """edges(before, after) with both sides' names (null: written out) and definitions."""
    for part, side in (("before", "old"), ("after", "new")):
        ref = F.get_json_object(part, "$.$ref")
        edges = edges.withColumn("__name", F.when(ref.startswith(_PREFIX), F.substring(ref, len(_PREFIX) + 1, 1 << 20)))
        to = definitions.where(F.col("side") == side).select(F.col("name").alias("__name"), F.col("end").alias("__end"), F.col("schema").alias("__schema"))
        edges = edges.join(to, "__name", "left").withColumn(f"{side}_name", F.coalesce("__end", "__name")).withColumn(side, F.coalesce("__schema", part)).drop("__name", "__end", "__schema")
    return edges


def differences(schemas: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, pointer, kind, change, before, after, schema_name): all that differs between roots(root, old_name, new_name) of
    schemas(side, name, schema), side being old or new.

    A change below a reference is told at the pointer at which its root comes by the pair first, under the pair's name (the
    new side's before the old side's). References to schemas of different names are changes of their own."""
    definitions = ends(schemas)
    side = lambda s: definitions.where(F.col("side") == s).select(F.col("name").alias(f"{s}_name"), F.col("end").alias(f"{s}_end"), F.col("schema").alias(s))
    start = roots.join(side("old"), "old_name").join(side("new"), "new_name")
    start = written(_keyed(start.select("root", F.col("old_end").alias("old_name"), "old", F.col("new_end").alias("new_name"), "new")))
    name = F.coalesce("new_name", "old_name").alias("schema_name")
    fresh = known = start.select("pair", "named", *_PAIR).dropDuplicates(["pair"])
    found, links = None, None
    while True:  # ends: each level brings pairs that aren't known yet
        fresh = written(fresh)
        told = written(_compare_pairs(fresh).join(fresh.select("pair", name), "pair"))
        edges = written(_keyed(_resolved(told.where("kind = 'edge'").withColumnRenamed("pair", "from"), definitions)))
        step = told.where("kind <> 'edge'")
        found = step if found is None else found.unionByName(step)
        links = edges if links is None else links.unionByName(edges)
        known_keys = known.select("pair")
        fresh = edges.select("pair", "named", *_PAIR).dropDuplicates(["pair"]).join(known_keys, "pair", "left_anti")
        fresh = written(fresh)
        if fresh.isEmpty():
            break
        known = written(known_keys.union(fresh.select("pair")))
    label = lambda n, raw: F.when(n.isNotNull(), F.concat(F.lit(f'"{_PREFIX}'), n, F.lit('"'))).when(F.get_json_object(raw, "$.$ref").isNotNull(), F.to_json(F.array(F.get_json_object(raw, "$.$ref")))).otherwise('"inline"')
    moved = links.where(~F.col("old_name").eqNullSafe(F.col("new_name")))
    refs = moved.select(F.col("from").alias("pair"), "at", F.lit("ref_changed").alias("kind"), F.lit("modified").alias("change"), label(F.col("old_name"), F.col("before")).alias("before"), label(F.col("new_name"), F.col("after")).alias("after"), "schema_name")
    found = written(found.select("pair", "at", "kind", "change", "before", "after", "schema_name").unionByName(refs))
    reached = _walk(start.select("root", "pair", "named"), written(links.select("from", "at", "pair", "named")))
    out = reached.join(found, "pair").select("root", F.concat("pointer", "at").alias("pointer"), "kind", "change", "before", "after", "schema_name")
    top = start.where("old_name <> new_name").select("root", F.lit("").alias("pointer"), F.lit("ref_changed").alias("kind"), F.lit("modified").alias("change"), label(F.col("old_name"), F.lit("{}")).alias("before"), label(F.col("new_name"), F.lit("{}")).alias("after"), F.lit(None).cast("string").alias("schema_name"))
    return out.unionByName(top).withColumn("pointer", F.when(F.col("pointer") == "", "/").otherwise(F.col("pointer")))


def _walk(start: DataFrame, links: DataFrame) -> DataFrame:
    """(root, pair, pointer): the pairs that each root leads to; one with two names counts where it is come by first."""
    first = W.partitionBy("root", "pair").orderBy("pointer")
    last = reached = written(start.select("root", "pair", "named", F.lit("").alias("pointer")))
    for _ in count():
        step = last.select("root", F.col("pair").alias("from"), "pointer").join(links, "from").select("root", "pair", "named", F.concat("pointer", "at").alias("pointer"))
        seen = reached.where("named").select("root", "pair")
        named = step.where("named").join(seen, ["root", "pair"], "left_anti").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
        last = written(named.unionByName(step.where("not named")))
        if last.isEmpty():
            return reached.select("root", "pair", "pointer")
        reached = written(reached.unionByName(last))
