"""Auditing an index: totals, sections, and what looks wrong with its texts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY, REPEAT, SAMPLE, CUT, BIGGEST, REPEATED = 25, 60, 8, 140, 10, 8


def totals(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: pages, blocks, chars, anchored, words (different, unfolded, of two characters or more)."""
    words = blocks.select(F.explode(F.split(F.lower("text"), "[^0-9a-zа-яё]+")).alias("w")).where(F.length("w") >= 2).distinct()
    p = pages.agg(F.count(F.lit(1)).alias("pages"))
    b = blocks.agg(
        F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"), F.count_if(F.coalesce(F.col("anchor") != "", F.lit(False))).alias("anchored")
    )
    w = words.agg(F.count(F.lit(1)).alias("words"))
    return p.join(b, F.lit(True)).join(w, F.lit(True))  # one row each


def ratios(of: DataFrame) -> DataFrame:
    """Totals with anchored_percent, chars_a_block and blocks_a_page, rounded half up; null where there is nothing to divide by."""
    share = lambda a, b, k=1: F.floor(F.try_divide(F.col(a) * k, F.col(b)) + 0.5).cast("long")
    return of.withColumns({"anchored_percent": share("anchored", "blocks", 100), "chars_a_block": share("chars", "blocks"), "blocks_a_page": share("blocks", "pages")})


def page_sizes(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    sizes = blocks.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).cast("long").alias("chars"))
    return pages.join(sizes, "page_id", "left").fillna(0, ["blocks", "chars"])


def sections(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(section, pages, blocks, chars, order_): pages without a section under —, the order that of the first page."""
    return page_sizes(pages, blocks).groupBy(F.coalesce("section", F.lit("—")).alias("section")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum("blocks").cast("long").alias("blocks"), F.sum("chars").cast("long").alias("chars"), F.min_by("order_", "page_id").alias("order_")
    )


def section_table(of: DataFrame) -> DataFrame:
    """Sections in the order in which they are shown, by order and name; none if all pages are without one."""
    some = of.where("section <> '—'").limit(1).select(F.lit(1).alias("some"))
    return of.join(F.broadcast(some), F.lit(True), "left_semi").orderBy(F.coalesce("order_", F.lit(0)), "section")  # one row


def across(**blocks: DataFrame) -> DataFrame:
    """(index, blocks, chars, pages): of each index's blocks, and of all of them (index null). Pages of different indexes are different pages."""
    rows = functools.reduce(DataFrame.unionByName, (of.select(F.lit(name).alias("index"), "page_id", "text") for name, of in blocks.items()))
    pages = F.count_distinct(F.struct("index", "page_id")).alias("pages")
    each = rows.withColumn("of", F.col("index")).rollup("of").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).cast("long").alias("chars"), pages)
    return each.withColumnRenamed("of", "index")


def biggest(pages: DataFrame, blocks: DataFrame, n: int = BIGGEST) -> DataFrame:
    return page_sizes(pages, blocks).orderBy(F.desc("chars"), "page_id").limit(n).select("page_id", "url", "title", "blocks", "chars")


def empty(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    return pages.join(blocks.select("page_id").distinct(), "page_id", "left_anti").select("page_id", "url", "title")


def duplicate_urls(pages: DataFrame) -> DataFrame:
    """(url, again): addresses that stand more than once, and how often besides the first."""
    return pages.groupBy("url").agg((F.count(F.lit(1)) - 1).alias("again")).where("again > 0")


def leak(text: Column) -> Column:
    """What was left in a text: markup, else entities, else markdown; null if nothing was."""
    # The three patterns.
    return (
        F.when(text.rlike("(?i)</?[a-z][^>]*>"), "markup").when(text.rlike(r"(?i)&(?:[a-z]+|#\d+);"), "entities").when(text.rlike(r"\]\(|^\s*#{1,6}\s|\*\*"), "markdown")
    )


def complaints(blocks: DataFrame) -> DataFrame:
    """(kind, page_id, block_seq, text): every block with a leak, and every tiny one besides."""
    kinds = F.filter(F.array(leak(F.col("text")), F.when(F.length("text") < TINY, F.lit("tiny"))), lambda x: x.isNotNull())
    return blocks.select("page_id", "block_seq", "text", F.explode(kinds).alias("kind")).select("kind", "page_id", "block_seq", "text")


def complaint_counts(of: DataFrame) -> DataFrame:
    return of.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def complaint_samples(of: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The first of each kind, their texts cut."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("page_id", "block_seq"))
    return of.withColumn("rank", rank).where(F.col("rank") <= n).select("kind", "rank", "page_id", "block_seq", F.left("text", F.lit(CUT)).alias("text"))


def repeated(blocks: DataFrame) -> DataFrame:
    """(text, n): texts of REPEAT characters or more that are several blocks."""
    return blocks.where(F.length("text") >= REPEAT).groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated_table(of: DataFrame, n: int = REPEATED) -> DataFrame:
    """(rank, text, n): the texts that are most often repeated, cut, equal ones in the order of their texts."""
    first = of.orderBy(F.desc("n"), "text").limit(n)  # so few that one window ranks them
    return first.select(F.row_number().over(Window.orderBy(F.desc("n"), "text")).alias("rank"), F.left("text", F.lit(CUT)).alias("text"), "n")
