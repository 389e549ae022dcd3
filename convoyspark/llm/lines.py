"""Line deduplication by site-relative frequency.

A line is boilerplate on a site when more than a given share of the site's pages contain it. Pages are counted, not
occurrences. Counts are pre-aggregated by (site, line), so a hot site or line moves a row per task. On a site with L lines a
page there can be at most L / ratio such lines, so each site has a short list, which pages look up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import stored


def _key(line: Column) -> Column:
    """96 bits of a line without the spaces at its ends; null for blank lines, which are never dropped."""
    bare = F.trim(line)
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.crc32(bare).alias("b")))


_UNSEEN = r"(?is)<(?:!--.*?--|(?:script|style)[^>]*>.*?</(?:script|style))>"
_BLOCK = r"(?i)</?(?:html|head|body|title|nav|header|main|section|article|aside|footer|div|h[1-6]|p|br|ul|ol|li|table|tr|td|th)(?:[ \t\r\n/][^>]*)?>"


def block_text(html: Column) -> Column:
    """The text of a page with a line for each block element, without blank lines and spaces at the ends of lines. Scripts, styles and
    comments go; entities stay as they are. Null stays null, and a page without text is empty."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _UNSEEN, ""), _BLOCK, "\n"), "<[^>]*>", "")
    return F.array_join(F.filter(F.transform(F.split(marked, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def boilerplate(pages: DataFrame, *, site: Column, text: Column, ratio: float, least_pages: int) -> DataFrame:
    """``_site`` and its boilerplate lines' keys (``_lines``), for the sites that have any."""
    own = pages.select(site.alias("_site"), F.array_distinct(F.transform(F.split(text, "\n"), _key)).alias("_keys"))
    totals = own.groupBy("_site").agg(F.count("*").alias("_pages"))
    counts = own.select("_site", F.explode("_keys").alias("_k")).filter("_k IS NOT NULL").groupBy("_site", "_k").agg(F.count("*").alias("_n"))
    counts = counts.filter(F.col("_n") >= least_pages).withColumnRenamed("_site", "_of")
    often = counts.join(totals, F.col("_of").eqNullSafe(F.col("_site"))).filter(F.col("_n") > ratio * F.col("_pages"))
    return often.groupBy("_site").agg(F.collect_list("_k").alias("_lines"))


def deduplicated(pages: DataFrame, *, site: str = "source", text: str = "text", ratio: float = 0.1, least_pages: int = 5) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``, and the struct ``_lines`` with their number ``dropped`` and ``all``.

    A line is dropped from every page of a site when at least ``least_pages`` pages and more than ``ratio`` of the site's pages hold it.
    Lines end at newlines and are compared without spaces at their ends; blank lines stay. A null site is a site. A page of which only
    blank lines would be left is a copy rather than a frame around something, and keeps its text. Null texts stay null and have no lines.
    """
    found = stored(boilerplate(pages, site=F.col(site), text=F.col(text), ratio=ratio, least_pages=least_pages), "boilerplate")
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("_row")).join(
        found, F.col(f"_row.{site}").eqNullSafe(F.col("_site")), "left")
    every = F.split(F.col(f"_row.{text}"), "\n")
    bad = F.coalesce(F.col("_lines"), F.array().cast(found.schema["_lines"].dataType))
    kept = F.filter(F.col("_all"), lambda x: F.coalesce(~F.array_contains(F.col("_bad"), _key(x)), F.lit(True)))
    left = F.exists(F.col("_kept"), lambda x: F.trim(x) != "")
    cut = rows.withColumn("_all", every).withColumn("_bad", bad).withColumn("_kept", kept).withColumn(
        "_kept", F.when(left, F.col("_kept")).otherwise(F.col("_all")))
    number = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    columns = [F.array_join("_kept", "\n").alias(text) if c == text else F.col(f"_row.`{c}`") for c in pages.columns]
    return cut.select(*columns, F.struct((number("_all") - number("_kept")).alias("dropped"), number("_all").alias("all")).alias("_lines"))
