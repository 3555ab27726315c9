"""Chunks of paged text: headings with the stack of those above, and sentence-aligned packing with overlap.

Headings reach over page ends, so what is open at a page depends on all pages before it: blocks of pages learn it by a prefix
scan and are then chunked each for itself."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import batched, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MAX_CHARS, OVERLAP, LEAST_MAX = 6000, 500, 64
_NUMBERED = re.compile(r"([0-9]{1,2}(?:\.[0-9]{1,2}){0,5})\.?\s+(\S.*)")
_ANNEX = re.compile(r"(?:Annex|Appendix|ANNEX|APPENDIX)\s+(\S.*)")
#: A sentence ends at one of these marks with white space behind it, before an ASCII capital, digit or quote, or at the end.
_SENTENCE_END = re.compile(r'[.!?][ \t\n\r\f]+(?=[A-Z0-9"]|\Z)')
_SPACE = re.compile(r"\s")


def heading(line: str) -> tuple[str, tuple[int, ...], str] | None:
    """(kind, place in the outline, label)."""
    t = line.strip()
    if t.startswith("#"):
        label = t.lstrip("#")
        depth = len(t) - len(label)
        return ("markdown", (depth,), label.strip()) if label.strip() and (depth > 1 or label.startswith(" ")) else None
    if not 3 <= len(t.encode()) <= 120 or t[-1] in ".,;:":
        return None
    numbered = _NUMBERED.fullmatch(t)
    found = numbered or _ANNEX.fullmatch(t)
    title = found[found.lastindex] if found else ""
    if not title or not title[0].isupper() or len(title.split()) > 14:
        return None
    return ("numbered", tuple(map(int, numbered[1].split("."))), f"{numbered[1]} {title}") if numbered else ("annex", (), t)


def _above(top, new) -> bool:
    if top[0] != new[0]:
        return False
    if new[0] == "numbered":
        return len(top[1]) < len(new[1]) and new[1][: len(top[1])] == top[1]
    return new[0] == "markdown" and top[1] < new[1]


def _pieces(sentence: str, most: int) -> list[str]:
    """A sentence that is too long, cut at the last white space that fits, else anywhere."""
    out = []
    while len(sentence) > most:
        at = max((m.start() for m in _SPACE.finditer(sentence, 0, most)), default=0) or most
        out.append(sentence[:at])
        sentence = sentence[at:].lstrip()
    return out + [sentence] * bool(sentence)


def _units(paragraph: str, most: int) -> list[str]:
    """The paragraph as a whole, if it fits; else its sentences, and pieces of those that don't."""
    if len(paragraph) <= most:
        return [paragraph]
    ends = [0, *(m.end() for m in _SENTENCE_END.finditer(paragraph)), len(paragraph)]
    sentences = [paragraph[a:b] for a, b in zip(ends, ends[1:], strict=False) if a < b]
    return [u for s in sentences for u in (_pieces(s, most) if len(s) > most else [s.rstrip()])]


def _tail(chunk: str, overlap: int) -> str:
    """What the next chunk repeats: the last `overlap` characters from the first sentence that begins among them, else from the
    first word."""
    if len(chunk) <= overlap:
        return chunk
    tail = chunk[len(chunk) - overlap :]
    end = _SENTENCE_END.search(tail)
    if end and end.end() < len(tail):
        return tail[end.end() :].lstrip()
    space = _SPACE.search(tail)
    return tail[space.start() :].lstrip() if space else ""


def pack(paragraphs: list[str], most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most `most` characters: paragraphs stay whole where they fit, a line apart; a chunk that follows another
    begins with the end of that one, where the next unit leaves room for it."""
    most = max(LEAST_MAX, most)
    overlap = min(overlap, most // 2)
    done, now = [], ""
    for p in paragraphs:
        for k, unit in enumerate(_units(p, most)):
            gap = " " if k else "\n\n"
            if now and len(now) + len(gap) + len(unit) > most:
                done.append(now)
                now = _tail(now, overlap) if overlap else ""
                if len(now) + 1 + len(unit) > most:
                    now = ""
                elif len(now) + len(gap) + len(unit) > most:
                    gap = " "
            now = f"{now}{gap}{unit}" if now else unit
    return done + [now] * bool(now.strip())


def page_chunks(text: str, stack: list, most: int, overlap: int) -> list[tuple[list[str], str]]:
    """(section path, text) of a page's chunks; stack: the headings that are open, which the page's own change."""
    groups: list[tuple[list[str], list[str]]] = [([s[2] for s in stack], [])]
    paragraph: list[str] = []

    def end() -> None:
        if paragraph:
            groups[-1][1].append("\n".join(paragraph))
            paragraph.clear()

    for line in text.split("\n"):
        if h := heading(line):
            end()
            while stack and not _above(stack[-1], h):
                stack.pop()
            stack.append(h)
            groups.append(([s[2] for s in stack], [h[2]]))
        elif line.strip():
            paragraph.append(line.rstrip())
        else:
            end()
    end()
    return [(path, chunk) for path, paragraphs in groups for chunk in pack(paragraphs, most, overlap)]


#: Pages of a document that one task reads in turn.
BLOCK = 256
_STACK = pa.list_(pa.struct([("kind", pa.string()), ("place", pa.list_(pa.int32())), ("label", pa.string())]))
_STACK_SQL = "array<struct<kind:string,place:array<int>,label:string>>"


def meet(a: tuple, b: tuple) -> tuple:
    """(kind, place) below just those headings that are above both of two."""
    if a[0] != b[0] or a[0] == "annex":
        return ("annex", ())  # nothing is above an annex
    if a[0] == "markdown":
        return min(a[:2], b[:2])
    short = min(len(a[1]), len(b[1]))
    same = next((i for i in range(short) if a[1][i] != b[1][i]), short)
    return ("numbered", a[1][: min(same + 1, short)])  # above it: what both begin with, and not all of either


def then(first: list, second: list) -> list:
    """The outline of two stretches of text, one after the other.

    An outline is empty for a text without headings, else the meet of all its headings and then those that are open at its end:
    of headings open before, the text leaves open those above the meet. Associative, so that parts of a document can be told
    each for itself and be put together."""
    if not first or not second:
        return first or second
    below = second[0]
    return [(*meet(first[0], below), ""), *(h for h in first[1:] if _above(h, below)), *second[1:]]


def outline(text: str) -> list:
    return reduce(then, ([h, h] for line in text.split("\n") if (h := heading(line))), [])


#: Rows, and characters of texts, that are Python objects at one time: a batch of Arrow may hold 10,000 pages.
ROWS, CHARS = 64, 1 << 20


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in b.slice(i, ROWS).columns), strict=True)


def _stack(rows: list[dict] | None) -> list[tuple]:
    return [(r["kind"], tuple(r["place"]), r["label"]) for r in rows or ()]


def open_headings(pages: DataFrame, key: str) -> DataFrame:
    """(key, block, stack): the headings that are open where a block of pages(key, block, page, text) begins, if there are any.

    A prefix scan: pages become outlines where they lie, those of a block one, and those of a document's blocks are put
    together in turn. Texts don't move; the task of a document reads a short row for each of its blocks."""
    kind = dict(pages.dtypes)[key]
    schema = pa.schema([(key, to_arrow_type(pages.schema[key].dataType)), ("block", pa.int64()), ("page", pa.int64()), ("stack", _STACK)])

    def packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for some in batched(rows, 1024):
            *columns, stacks = zip(*some, strict=True)
            stacks = [[{"kind": k, "place": list(p), "label": t} for k, p, t in s] for s in stacks]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, stacks], schema.types, strict=True)], schema=schema)

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed((k, n, page, outline(text)) for k, n, page, text in _rows(batches))

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groupby(_rows(batches), lambda r: r[:2])
        yield from packed((*at, None, reduce(then, (_stack(r[3]) for r in rows), [])) for at, rows in groups)

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scan() -> Iterator[tuple]:
            for k, rows in groupby(_rows(batches), lambda r: r[0]):
                now: list = []
                for _, n, _, more in rows:
                    if now[1:]:
                        yield k, n, None, now[1:]
                    now = then(now, _stack(more))

        yield from packed(scan())

    shape = f"{key} {kind}, block long, page long, stack {_STACK_SQL}"
    told = pages.select(key, "block", "page", "text").mapInArrow(of_pages, shape)
    told = told.repartition(key, "block").sortWithinPartitions(key, "block", "page").mapInArrow(of_blocks, shape)
    return told.repartition(key).sortWithinPartitions(key, "block").mapInArrow(before, shape).drop("page")


def chunk_pages(pages: DataFrame, key: str, most: int = MAX_CHARS, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """(key, page, ordinal, chunk_id, section, section_path, text) of extracted pages(key, page, status, text).

    Blocks of pages are dealt out, each with the headings that are open where it begins, and read page by page: many tasks share
    a long document, and neither it nor a block has to fit into memory. Null texts have no chunks."""
    kind = dict(pages.dtypes)[key]
    kinds = [to_arrow_type(pages.schema[key].dataType), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    names = ["page", "ordinal", "chunk_id", "section", "section_path", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stack = object(), []
        rows, chars = [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[key, *names])

        for k, n, page, text, opened in _rows(batches):
            if (k, n) != last:
                last, stack = (k, n), _stack(opened)
            if text is None:  # the row that tells what is open
                continue
            for i, (path, chunk) in enumerate(page_chunks(text, stack, most, overlap)):
                rows.append((k, page, i, f"{k}:p{page}:c{i}", path[-1] if path else None, path, chunk))
                chars += len(chunk)
            if len(rows) >= ROWS or chars >= CHARS:
                yield packed()
                rows, chars = [], 0
        yield packed()

    schema = f"{key} {kind}, page long, ordinal long, chunk_id string, section string, section_path array<string>, text string"
    page = F.col("page").cast("long")
    rows = pages.where("status = 'extracted' and text is not null").select(key, F.floor((page - 1) / block).alias("block"), page.alias("page"), "text")
    none = lambda t: F.lit(None).cast(t)
    opened = open_headings(rows, key).select(key, "block", none("long").alias("page"), none("string").alias("text"), "stack")
    dealt = rows.withColumn("stack", none(_STACK_SQL)).unionByName(opened).repartition(key, "block")
    return dealt.sortWithinPartitions(key, "block", F.col("text").isNotNull(), "page").mapInArrow(run, schema)
