"""The declared corpus: configuration, manifest and curated requirements. Small files that the driver reads and checks;
everything after is tables."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

KINDS = ("pdf", "openapi", "text")
AUTHORITIES = ("normative", "technical", "informative", "project", "test", "unknown")
SOURCES = "source_id string, kind string, version string, authority string, precedence int, path string, title string, blank_pages array<int>"
REQUIREMENTS = "id string, version string, title string, description string, sources array<struct<source_id:string,locator:string,sha256:string,note:string>>, endpoints array<string>, schemas array<string>, acceptance_criteria array<string>, conflicts_with array<string>, tags array<string>, conflict_notes array<string>"


class Invalid(ValueError):
    """A declared file breaks a rule; code says which file."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Config:
    manifest: str
    requirements: str
    max_chars: int = 6000
    overlap: int = 500
    min_chars_per_page: int = 16
    jobs: int = 0
    default_limit: int = 10
    max_limit: int = 50
    prefixes: dict[str, str] = field(default_factory=dict)


def _check(ok: bool, code: str, message: str) -> None:
    if not ok:
        raise Invalid(code, message)


def relative(path: str) -> bool:
    return bool(path) and not path.startswith("/") and "\\" not in path and not {"", ".", ".."} & set(path.split("/"))


def config(raw: str) -> Config:
    d = tomllib.loads(raw)
    known = {"corpus": {"manifest", "requirements"}, "chunking": {"max_chars", "overlap"}, "index": {"min_chars_per_page", "jobs"}, "search": {"default_limit", "max_limit"}, "prefixes": None}
    for section, values in d.items():
        _check(section in known and isinstance(values, dict), "config", f"unknown section {section}")
        _check(known[section] is None or set(values) <= known[section], "config", f"unknown field in {section}")
    flat = {k: v for s, values in d.items() if s != "prefixes" for k, v in values.items()}
    c = Config(**{"manifest": "manifest.yaml", "requirements": "requirements.yaml"} | flat, prefixes=d.get("prefixes", {}))
    _check(relative(c.manifest) and relative(c.requirements), "config", "paths must be relative and stay below the corpus")
    _check(c.max_chars >= 500 and 0 <= c.overlap < c.max_chars / 2, "config", "chunk sizes")
    _check(0 <= c.jobs <= 64 and 0 < c.default_limit <= c.max_limit, "config", "limits")
    _check(all(p.startswith("/") for p in c.prefixes.values()), "config", "prefixes start with /")
    return c


def _yaml(raw: str, code: str, what: str) -> list[dict]:
    import yaml

    d = yaml.safe_load(raw)
    _check(isinstance(d, dict) and set(d) <= {"schema_version", what} and d.get("schema_version") == 1, code, "schema_version 1 is wanted")
    return d.get(what) or []


def sources(spark: SparkSession, raw: str) -> DataFrame:
    """The manifest's sources as a table."""
    rows, seen = [], set()
    for s in _yaml(raw, "manifest", "sources"):
        _check(set(s) <= {"id", "kind", "version", "authority", "precedence", "path", "title", "description", "tags", "blank_pages"}, "manifest", "unknown field")
        _check(bool(re.fullmatch(r"[a-z0-9][a-z0-9._-]{0,127}", str(s.get("id")))), "manifest", f"id {s.get('id')}")
        _check(bool(re.fullmatch(r"[A-Za-z0-9._-]{1,64}", str(s.get("version")))), "manifest", f"version of {s['id']}")
        _check(s.get("kind") in KINDS and s.get("authority", "unknown") in AUTHORITIES and 0 <= s.get("precedence", 0) <= 1000, "manifest", f"kind, authority or precedence of {s['id']}")
        _check(relative(s.get("path", "")), "manifest", f"path of {s['id']}")
        blank = s.get("blank_pages") or []
        _check(not blank or (s["kind"] != "openapi" and len(set(blank)) == len(blank) and min(blank) >= 1), "manifest", f"blank pages of {s['id']}")
        _check(not {s["id"], s["path"]} & seen, "manifest", f"{s['id']} or its path is there twice")
        seen |= {s["id"], s["path"]}
        rows.append((s["id"], s["kind"], str(s["version"]), s.get("authority", "unknown"), s.get("precedence", 0), s["path"], s.get("title", s["id"]), blank))
    return spark.createDataFrame(rows, SOURCES)


def requirements(spark: SparkSession, raw: str) -> DataFrame:
    """The curated requirements as a table; sources that the manifest doesn't know are left to a later check."""
    rows, seen = [], set()
    for r in _yaml(raw, "requirements", "requirements"):
        i = str(r.get("id"))
        _check(bool(re.fullmatch(r"[A-Z0-9][A-Z0-9._-]{0,127}", i)) and i not in seen, "requirements", f"id {i}")
        seen.add(i)
        cited = r.get("sources") or []
        _check(bool(str(r.get("title", "")).strip()) and bool(cited), "requirements", f"{i} needs a title and a source")
        for s in cited:
            _check(s.get("sha256") is None or bool(re.fullmatch("[0-9a-fA-F]{12,64}", s["sha256"])), "requirements", f"pin of {i}")
        others = [c["requirement_id"] for c in r.get("conflicts_with") or []]
        _check(i not in others, "requirements", f"{i} conflicts with itself")
        rows.append((i, str(r.get("version")), r["title"], r.get("description"), [(s["source_id"], s["locator"], s.get("sha256"), s.get("note")) for s in cited], r.get("endpoints") or [], r.get("schemas") or [], r.get("acceptance_criteria") or [], others, r.get("tags") or [], [c.get("note") for c in r.get("conflicts_with") or []]))
    return spark.createDataFrame(rows, REQUIREMENTS)


def orphans(spark: SparkSession, root: str, declared: DataFrame) -> DataFrame:
    """(path): files below the corpus that the manifest doesn't declare; hidden ones don't count."""
    base = str(Path(root))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    from pyspark.sql import functions as F

    below = files.select(F.substring_index("path", f"{base}/", -1).alias("path")).where(~F.col("path").rlike(r"(^|/)\."))
    return below.join(declared.select("path"), "path", "left_anti").orderBy("path")
