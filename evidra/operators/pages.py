"""Paged text: status and quality of pages, repeated margins, cleaning, and figures of whole documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.functions import text as T

MARGIN_LINES, MARGIN_PAGES = 2, 4
GARBAGE, FRAGMENTS, FRAGMENT_TOKENS = 0.05, 0.5, 20


def split_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, text): a form feed ends a page; pages count from 1."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\f")).alias("page", "text")).withColumn("page", (F.col("page") + 1).cast("long"))


def with_status(pages: DataFrame, min_chars: int = 16) -> DataFrame:
    """pages with normalised text, status, char_count and sha256."""
    p = pages.withColumn("text", T.normalised_page(F.col("text")))
    return p.withColumns({"status": T.page_status(F.col("text"), min_chars=min_chars), "char_count": F.length("text").cast("long"), "sha256": F.sha2(F.col("text").cast("binary"), 256)})


def with_quality(pages: DataFrame) -> DataFrame:
    """pages with the shares of garbage characters and one-letter tokens, and whether the text is of low quality."""
    words = T.tokens(F.col("text"))
    p = pages.withColumns({"significant": T.significant_chars(F.col("text")).cast("long"), "garbage": T.garbage_chars(F.col("text")).cast("long"), "n_tokens": F.size(words).cast("long"), "fragments": T.fragment_tokens(words).cast("long")})
    p = p.withColumns({"garbage_ratio": T.ratio(F.col("garbage"), F.col("significant")), "fragment_ratio": T.ratio(F.col("fragments"), F.col("n_tokens"))})
    return p.withColumn("low_quality", (F.col("garbage_ratio") > GARBAGE) | ((F.col("n_tokens") >= FRAGMENT_TOKENS) & (F.col("fragment_ratio") > FRAGMENTS)))


def margin_lines(pages: DataFrame, key: str) -> DataFrame:
    """(key, page, line, margin): the first and last lines of each page that aren't empty, with their margin keys; all
    inside the row, so nothing is shuffled."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), T.margin_key(x).alias("margin"))), lambda s: s["margin"].isNotNull())
    n = F.size("lines")
    ends = F.array_distinct(F.concat(F.slice("lines", 1, MARGIN_LINES), F.slice("lines", F.greatest(n - MARGIN_LINES + 1, F.lit(1)), F.lit(MARGIN_LINES))))
    return pages.select(key, "page", lines.alias("lines")).where(n > 0).select(key, "page", F.explode(ends).alias("m")).select(key, "page", F.col("m.line").alias("line"), F.col("m.margin").alias("margin"))


def repeated_margins(pages: DataFrame, key: str) -> DataFrame:
    """(key, margin, pages): margins on half of a document's extracted pages or more, and three at least, where it has
    MARGIN_PAGES pages or more."""
    extracted = pages.where("status = 'extracted'")
    totals = extracted.groupBy(key).agg(F.countDistinct("page").alias("total")).where(F.col("total") >= MARGIN_PAGES)
    seen = margin_lines(extracted, key).groupBy(key, "margin").agg(F.countDistinct("page").alias("pages"))
    return seen.join(totals, key).where(F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.col("total") / 2))).select(key, "margin", "pages")


def clean_margins(pages: DataFrame, key: str) -> DataFrame:
    """(key, page, text, removed): pages without their repeated margin lines."""
    repeated = repeated_margins(pages, key).select(key, "margin")
    drop = margin_lines(pages.where("status = 'extracted'"), key).join(repeated, [key, "margin"], "left_semi").groupBy(key, "page").agg(F.array_sort(F.collect_set("line")).alias("drop"))
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(F.coalesce("drop", F.array().cast("array<int>")), s["i"]))
    joined = pages.join(drop, [key, "page"], "left")
    return joined.select(key, "page", T.trim_ends(F.array_join(F.transform(kept, lambda s: s["x"]), "\n")).alias("text"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("removed"))


_BROKEN = re.compile(r"(?<![^\W\d_])([^\W\d_]+)-\n[ \t]*([^\W\d_]+)(?=$|[\s.,;:)!?])")


def rejoin(text: str) -> tuple[str, int]:
    """Words that a line's end has split, joined again; and how many. The left part must have two letters or more and
    end in lower case, the right one start in lower case; a line that still ends in a hyphen is looked at again."""
    total = 0
    while True:
        n = 0

        def join(m: re.Match) -> str:
            nonlocal n
            if len(m[1]) < 2 or not m[1][-1].islower() or not m[2][0].islower():
                return m[0]
            n += 1
            return m[1] + m[2]

        text = _BROKEN.sub(join, text)
        if not n:
            return text, total
        total += n


def rejoined(pages: DataFrame, key: str) -> DataFrame:
    """(key, page, text, repairs): pages with their split words joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rejoin(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=[key, "page", "text", "repairs"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, F.col("page").cast("long").alias("page"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"{key} {kind}, page long, text string, repairs long")


def cleaned(pages: DataFrame, key: str) -> DataFrame:
    """(key, page, text, removed, repairs): pages as they are chunked: without repeated margin lines, then with words that a
    line's end has split joined; pages that aren't extracted keep their text."""
    without = clean_margins(pages, key)
    joined = rejoined(without, key).withColumnRenamed("text", "__text")
    return without.select(key, F.col("page").cast("long").alias("page"), "removed").join(joined, [key, "page"]).select(key, "page", F.col("__text").alias("text"), "removed", "repairs")


def cleaning_figures(pages: DataFrame, clean: DataFrame, key: str) -> DataFrame:
    """(key, removed_lines, repairs, patterns): what cleaning has changed in each document, and the margins that it took out."""
    sums = clean.groupBy(key).agg(F.sum("removed").alias("removed_lines"), F.sum("repairs").alias("repairs"))
    patterns = repeated_margins(pages, key).groupBy(key).agg(F.array_sort(F.collect_list("margin")).alias("patterns"))
    return sums.join(patterns, key, "left").withColumn("patterns", F.coalesce("patterns", F.array().cast("array<string>")))


def document_figures(pages: DataFrame, key: str) -> DataFrame:
    """Per document: counts by page status, mean garbage share, low-quality pages and the document's status."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    g = pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("pages"), is_("extracted").alias("extracted"), is_("ocr_required").alias("ocr_required"), is_("blank").alias("blank"),
        F.round(F.avg(F.when(F.col("status") == "extracted", F.col("garbage_ratio"))), 4).alias("garbage_ratio"), F.count_if("low_quality").alias("low_quality_pages"),
    )
    return g.withColumn("status", F.when((F.col("extracted") + F.col("blank") == F.col("pages")) & (F.col("extracted") > 0), "indexed").otherwise("partial"))


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
