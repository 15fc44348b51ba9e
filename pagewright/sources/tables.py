"""Pages and blocks from tables of texts.

pages:  page_id, url, title, also, lang, section, order_, fallback
blocks: page_id, block_seq, anchor, heading, text
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.storage import written


def language(tag: Column) -> Column:
    """The first two letters of a language tag, in lower case; null if there are none."""
    return F.nullif(F.lower(F.left(F.coalesce(tag, F.lit("")), F.lit(2))), F.lit(""))


def visible(pages: DataFrame, lang: str | None) -> DataFrame:
    """Pages in the reader's language, and those that name none; all if the reader names none."""
    if not lang:
        return pages
    own = language(F.col("lang"))
    return pages.where(own.isNull() | (own == language(F.lit(lang))))


def document_pages(docs: DataFrame) -> DataFrame:
    url = F.concat(F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"))
    return docs.select(
        F.col("doc_id").alias("page_id"), url.alias("url"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("also"),
        "lang", F.col("source").alias("section"), F.lit(0).alias("order_"), F.lit(False).alias("fallback"),
    )


def line_blocks(docs: DataFrame, page_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A block for each line that isn't empty, numbered within its page."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x != "")
    return docs.select(F.col(page_id).alias("page_id"), F.posexplode(lines).alias("block_seq", "text")).select(
        "page_id", "block_seq", F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("string").alias("heading"), "text"
    )


#: A block's class or comment that keeps it out.
_UNSEARCHED = r"(class\s*=\s*[\"'][^\"']*|\{:[^}]*\.|<!--[^>]*)\bnosearch\b"


def content_pages(pages: DataFrame, own: tuple[str, ...] = (), path: str = "path", front: str = "front") -> DataFrame:
    """Pages of Markdown that take part: those in folders of `own` don't, nor those whose front matter (a map of strings) says search: false."""
    kept = F.col(path).contains(".md") & (F.coalesce(F.lower(F.try_element_at(front, F.lit("search"))), F.lit("")) != "false")
    for folder in own:
        kept = kept & ~F.col(path).contains(folder)
    return pages.where(kept)


_FRONT = r"(?s)\A\x{FEFF}?---[ \t]*\r?\n(.*?\r?\n)??---[ \t]*(\r?\n|\z)"


def front_matter(text: Column) -> Column:
    """The lines `key: value` between the two lines --- at a text's start, as a map; the last one of a key counts, quotes around a value go. Nested lines and lists don't count."""
    lines = F.filter(F.split(F.regexp_extract(text, _FRONT, 1), r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*[ \t]*:"))
    name = lambda x: F.regexp_extract(x, r"^([\w-]+)", 1)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\w-]+[ \t]*:[ \t]*|[ \t]+$", ""), "^([\"'])(.*)\\1$", "$2")
    last = lambda k: F.element_at(F.filter(lines, lambda x: name(x) == k), -1)
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(lines, name)), lambda k: F.struct(k, bare(last(k)))))


def markdown_pages(files: DataFrame, own: tuple[str, ...] = ("sitesearch/",), lang: str | None = None) -> DataFrame:
    """(page_id, url, title, also, lang, section, order_, fallback, content) of (page_id, path, text): those Markdown files that take part, without front matter.

    A page's address is its permalink, else its path without ending, index being its folder. Its title is its
    address if it has none, its language the site's. Sections by address are `with_sections`'s; one in the front matter stays.
    """
    parted = files.withColumns({"front": front_matter(F.coalesce("text", F.lit(""))), "content": F.regexp_replace("text", _FRONT, "")})
    of = lambda key: F.nullif(F.try_element_at("front", F.lit(key)), F.lit(""))
    stem = F.regexp_replace(F.regexp_replace("path", r"\.md$", ""), r"(^|/)index$", "$1")
    url = F.coalesce(of("permalink"), F.regexp_replace(F.concat(F.lit("/"), stem, F.lit("/")), "/+", "/"))
    return content_pages(parted, own).select(
        "page_id", url.alias("url"), F.coalesce(of("title"), url).alias("title"), of("also").alias("also"), F.coalesce(of("lang"), F.lit(lang)).alias("lang"),
        of("section").alias("section"), F.coalesce(of("order").try_cast("int"), F.lit(0)).alias("order_"), F.lit(False).alias("fallback"), "content",
    )


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, path, text): all Markdown files below root, each a row, numbered in the order of their paths. Spark lists no files of zero bytes.

    The numbering lists paths only (binaryFile reads no contents for that) and is written, so that it stays what it is.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.md"}
    listed = spark.read.options(**options).format("binaryFile").load(root).select(F.regexp_replace("path", "^file:/+", "file:/").alias("file"))
    numbers = written(listed.repartitionByRange("file").sortWithinPartitions("file").withColumn("page_id", F.monotonically_increasing_id()), "paths")
    texts = spark.read.options(**options).text(root, wholetext=True).select(F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/"), F.lit("+"), F.lit("%2B"))).alias("file"), F.col("value").alias("text"))
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    return texts.join(numbers, "file").select("page_id", F.substring("file", len(re.sub("^file:/+", "file:/", base)) + 1, 1 << 20).alias("path"), "text")


def paragraph_blocks(pages: DataFrame, page_id: str, content: str, least: int = 17) -> DataFrame:
    """Blocks of Markdown or plain text cut at blank lines, of `least` characters or more once its marks are gone.

    Chunks with the class nosearch, or a comment that says so, are left out.
    """
    chunks = F.filter(F.split(F.col(content), r"\n[ \t]*\n"), lambda x: ~x.rlike(_UNSEARCHED))
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>|\{:[^}]*\}", " "), r"(^|\n)\s*(#{1,6}|>|[-*+])\s+|\*\*|__|`|!?\[([^\]]*)\]\([^)]*\)", "$1$3"), r"\s+", " "))
    kept = F.filter(F.transform(chunks, clean), lambda x: F.length(x) >= least)
    return pages.select(F.col(page_id).alias("page_id"), F.posexplode(kept).alias("block_seq", "text")).select(
        "page_id", "block_seq", F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("string").alias("heading"), "text"
    )


def with_sections(pages: DataFrame, sections: DataFrame, lang: str | None = None) -> DataFrame:
    """Pages with section, order_ and fallback from their address: its first segment, or the second where the first is the page's language.

    sections: segment (null: the default), section, named (map of language to name), order_. It is a list
    that somebody wrote, of which only the entries are joined; pages of other segments fall back to the default.
    """
    parts = F.filter(F.split("url", "/"), lambda x: x != "")
    segment = F.when((F.size(parts) > 2) & (F.lower(F.get(parts, F.lit(0))) == language(F.col("lang"))), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    naming = F.coalesce(F.try_element_at("named", F.lit(lang)) if lang else F.lit(None), F.col("s_section"))
    named = sections.select("segment", "named", F.col("section").alias("s_section"), F.col("order_").alias("s_order"))
    default = named.where("segment IS NULL").select(naming.alias("d_section"), F.col("s_order").alias("d_order")).limit(1)
    entries = named.where("segment IS NOT NULL").select("segment", naming.alias("s_section"), "s_order")
    joined = pages.drop("section", "order_", "fallback").withColumn("segment", segment).join(entries, "segment", "left").join(F.broadcast(default), F.lit(True), "left")
    return joined.select(
        *(c for c in pages.columns if c not in ("section", "order_", "fallback")),
        F.coalesce("s_section", "d_section").alias("section"), F.coalesce("s_order", "d_order", F.lit(99)).alias("order_"), F.col("s_section").isNull().alias("fallback"),
    )
