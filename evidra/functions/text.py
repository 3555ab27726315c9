"""Text and path functions as Column expressions: they stay inside Spark's generated code.

Character classes are written out, since engines differ in what \\s and \\w mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[ \t\n\x0B\f\r]"


def trim_ends(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{_SPACE}+", ""), rf"(?<!{_SPACE}){_SPACE}++\z", "")  # a run of spaces is tried once


def short_hash(sha: Column) -> Column:
    return F.substring(sha, 1, 12)


def document_id(source_id: Column, sha: Column) -> Column:
    """source@first 12 digits, or source@unavailable."""
    return F.concat(source_id, F.lit("@"), F.coalesce(short_hash(sha), F.lit("unavailable")))


def normalised_page(c: Column) -> Column:
    """Lines without trailing white space, and the page without surrounding white space."""
    return trim_ends(F.regexp_replace(c, r"(?<![ \t\x0B\f\r])[ \t\x0B\f\r]++(?=\n)", ""))


def significant_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"{_SPACE}+", ""))


def page_status(text: Column, error: Column | None = None, declared_blank: Column | None = None, min_chars: int = 16) -> Column:
    """extraction_failed, blank (declared so), ocr_required (too little text) or extracted."""
    small = significant_chars(text) < min_chars
    out = F.when(small & (declared_blank if declared_blank is not None else F.lit(False)), "blank").when(small, "ocr_required").otherwise("extracted")
    return out if error is None else F.when(error.isNotNull(), "extraction_failed").otherwise(out)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def garbage_chars(c: Column) -> Column:
    """Replacement, control and private-use characters."""
    return F.length(F.regexp_replace(c, r"[^\x{FFFD}\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]", ""))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"{_SPACE}+"), lambda t: t != "")


def fragment_tokens(words: Column) -> Column:
    """How many tokens are one letter."""
    return F.size(F.filter(words, lambda t: t.rlike(r"^\p{L}$")))


def margin_key(line: Column) -> Column:
    """The line with single spaces and each run of digits as #; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(trim_ends(line), f"{_SPACE}+", " "), "[0-9]+", "#"), F.lit(""))


def heading(line: Column) -> Column:
    """struct(kind, number, label) of a heading line, or null: Markdown, numbered, or annex and appendix lines."""
    t = trim_ends(line)
    label = trim_ends(F.regexp_replace(t, r"^#+", ""))
    markdown = t.rlike(r"^#[# ]") & (label != "")
    number = F.regexp_extract(t, rf"^([0-9]{{1,2}}(?:\.[0-9]{{1,2}}){{0,5}})\.?{_SPACE}+", 1)
    annex = t.rlike(rf"^(Annex|Appendix|ANNEX|APPENDIX){_SPACE}")
    title = trim_ends(F.regexp_replace(t, rf"^(?:[0-9.]+|Annex|Appendix|ANNEX|APPENDIX){_SPACE}+", ""))
    plain = (F.octet_length(t) >= 3) & (F.octet_length(t) <= 120) & ~F.substring(t, -1, 1).isin(".", ",", ";", ":") & title.rlike(r"^\p{Lu}") & (F.size(tokens(title)) <= 14)
    return (
        F.when(markdown, F.struct(F.lit("markdown").alias("kind"), F.length(F.regexp_extract(t, "^(#+)", 1)).cast("string").alias("number"), label.alias("label")))
        .when(plain & (number != ""), F.struct(F.lit("numbered").alias("kind"), number.alias("number"), F.concat(number, F.lit(" "), title).alias("label")))
        .when(plain & annex, F.struct(F.lit("annex").alias("kind"), F.lit("").alias("number"), t.alias("label")))
    )


def path_key(path: Column, prefix: Column | str = "") -> Column:
    """The path without its version prefix (cut at a segment's end only) and empty segments; {name} becomes {}."""
    p = trim_ends(path)
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    fits = (prefix != "") & ((p == prefix) | p.startswith(F.concat(prefix, F.lit("/"))))
    rest = F.when(fits, F.substr(p, F.length(prefix) + 1)).otherwise(p)
    segments = F.transform(F.filter(F.split(rest, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(r"^\{[^}]*\}$"), "{}").otherwise(s))
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def template_params(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(r"\{([^}]*)\}"), 1)


def template_score(a: Column, b: Column) -> Column:
    """3: equal paths; 2: equal parameter names; 1: equal but for case, - and _; else 0."""
    shape = lambda p: F.transform(template_params(p), lambda n: F.lower(F.regexp_replace(n, "[-_]", "")))
    return F.when(a == b, 3).when(template_params(a) == template_params(b), 2).when(shape(a) == shape(b), 1).otherwise(0)


def valid_path(path: Column) -> Column:
    p = trim_ends(path)
    return p.startswith("/") & (F.octet_length(p) <= 1024) & ~p.rlike(r"[ \t\n\x0B\f\r\x00-\x1F\x7F]") & ~p.rlike(r"(^|/)\.{1,2}(/|$)")


#: HTTP methods in the order in which a path's operations are read.
METHODS = ("GET", "PUT", "POST", "DELETE", "OPTIONS", "HEAD", "PATCH", "TRACE")


def method(c: Column) -> Column:
    m = F.upper(trim_ends(c))
    return F.when(m.isin(*METHODS), m)


def locator(c: Column) -> Column:
    """struct(kind, first, last, method, value, error) of a locator: document, page(s):N or N-M, section:, chunk:,
    op:METHOD path, path:, schema:. The scheme may be in either case; what doesn't fit has an error and no kind."""
    t = trim_ends(c)
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z]+)(?::|$)", 1))
    rest = trim_ends(F.regexp_extract(t, r"(?s)^[A-Za-z]+:(.*)$", 1))
    a = F.regexp_extract(rest, r"^([0-9]{1,9})(?:-[0-9]{1,9})?$", 1).try_cast("long")
    b = F.coalesce(F.regexp_extract(rest, r"^[0-9]{1,9}-([0-9]{1,9})$", 1).try_cast("long"), a)
    m, p = method(F.regexp_extract(rest, r"^([A-Za-z]+)[ \t]+", 1)), F.regexp_extract(rest, r"^[A-Za-z]+[ \t]+(.+)$", 1)
    page = scheme.isin("page", "pages")
    op = scheme.isin("op", "operation")
    kind = (
        F.when((scheme == "document") & (t.rlike(r"^[A-Za-z]+$")), "document")
        .when(page & (a >= 1) & (b >= a) & (b - a < 50), F.when(a == b, "page").otherwise("pages"))
        .when(scheme.isin("section", "chunk") & (rest != ""), scheme)
        .when(op & m.isNotNull() & valid_path(p), "operation")
        .when((scheme == "path") & valid_path(rest), "path")
        .when((scheme == "schema") & (rest != "") & (F.octet_length(rest) <= 256) & ~rest.rlike(_SPACE), "schema")
    )
    one = lambda cond, v: F.when(cond, v)
    value = F.when(kind.isin("section", "chunk", "schema", "path"), rest).when(kind == "operation", p)
    return F.struct(
        kind.alias("kind"),
        one(kind.isin("page", "pages"), a).alias("first"),
        one(kind.isin("page", "pages"), b).alias("last"),
        one(kind == "operation", m).alias("method"),
        value.alias("value"),
        F.when(kind.isNull(), "invalid_locator").alias("error"),
    )


_EDGE = r"""[\"'`()\[\]<>,;:.!?]"""


def code_like(t: Column) -> Column:
    """Tokens that look like identifiers: paths, camelCase, and words joined by - or _."""
    plain = t.rlike(r"^[\p{L}\p{N}_-]+$") & (t.rlike(r"[\p{L}\p{N}][-_][\p{L}\p{N}]") | t.rlike(r"\p{Ll}\p{Lu}"))
    return (F.length(t) >= 2) & (F.length(t) <= 200) & t.rlike(r"[\p{L}\p{N}]") & (t.startswith("/") | plain)


#: Runs of tokens without capital, -, _, / or letters beyond ASCII: no identifiers, no methods, no paths. Bounded, as Java recurses.
_PLAIN = rf"(?<![^ \t\n\x0B\f\r])(?:[a-z0-9\"'`()\[\]<>,;:.!?]++{_SPACE}++){{1,64}}+"


def identifiers(text: Column) -> Column:
    """Sorted identifiers of a text, lower-cased, and METHOD /path pairs of neighbouring tokens.

    Plain words are one token in one pass over the text, so that only what may be an identifier is looked at by itself."""
    text = F.regexp_replace(text, _PLAIN, ". ")
    words = tokens(text)
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, f"^{_EDGE}+", ""), f"{_EDGE}+$", "")
    code = F.filter(F.transform(F.filter(words, lambda t: t.rlike(r"[/_-]|\p{Ll}\p{Lu}")), bare), code_like)
    pairs = F.zip_with(F.transform(words, bare), F.slice(F.transform(words, bare), 2, 1_000_000_000), lambda a, b: F.when(a.isin(*METHODS) & b.startswith("/"), F.concat(F.lower(a), F.lit(" "), F.lower(b))))
    pairs = F.when(text.rlike(rf"(?:{'|'.join(METHODS)}){_EDGE}*+{_SPACE}++{_EDGE}*+/"), F.filter(pairs, lambda p: p.isNotNull())).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.transform(code, F.lower), pairs)))


def query_terms(text: Column) -> Column:
    """The whole text with single spaces and each token, of 2 to 200 characters, lower-cased and sorted."""
    words = tokens(F.lower(text))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.array_join(words, " ")), words), lambda t: (F.length(t) >= 2) & (F.length(t) <= 200))))


def search_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits of 2 bytes or more."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!^)(\p{Lu})", " $1")


def pointer_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def schema_refs(json: Column) -> Column:
    """Sorted names of the schemas that a JSON text refers to."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(json, F.lit(r'"\$ref"\s*:\s*"#/(?:components/schemas|definitions)/([^"/]+)"'), 1)))


def excerpt(c: Column, most: int = 1200) -> Column:
    """At most `most` bytes, cut at a character's end, with a mark."""
    raw = c.cast("binary")
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, most).cast("string")), r"\x{FFFD}+$", "")
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(cut, F.lit("…")))


def change(before: Column, after: Column) -> Column:
    return F.when(before.isNull() & after.isNull(), "unchanged").when(before.isNull(), "added").when(after.isNull(), "removed").when(before == after, "unchanged").otherwise("modified")
