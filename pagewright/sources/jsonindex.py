"""Indexes as JSON files: pages with their blocks, and other indexes they name."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PAGE = "url:string,title:string,also:string,lang:string,section:string,`order`:int,fallback:boolean,blocks:array<string>"
INDEX = f"pages array<struct<{_PAGE}>>, shards array<struct<url:string,section:string,named:map<string,string>,`order`:int,defer:boolean>>"
#: A page of an index of lines, which has its own number.
LINE = f"number:long,{_PAGE}"
_BLOCK = "struct<text:string,anchor:string,section:string>"


def resolved(here: str, there: str) -> str:
    """An address as the index at `here` means it, whatever the file system."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", there):
        return there
    at = urlsplit(here)
    root = here[: len(here) - len(at.path)] if at.path else here
    return root + posixpath.normpath(posixpath.join(posixpath.dirname(at.path), there)) + "/" * there.endswith("/")


def _qualified(spark: SparkSession, url: str) -> str:
    """The address as `_metadata.file_path` gives it, but for how many slashes a scheme has."""
    at = spark._jvm.org.apache.hadoop.fs.Path(url)
    return _slashes(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString())


def _slashes(url: str) -> str:
    return re.sub("^file:/+", "file:/", url)


def _file() -> Column:
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")


def read_sources(spark: SparkSession, url: str, most: int = 10_000) -> list[dict]:
    """The index at url and all it names, directly or not, each once, in the order of breadth.

    Only their lists of other indexes are read here, which people write: all those of one depth in one job.
    Folders of lines name none. More than `most` indexes are an error.
    """
    known, level = {_qualified(spark, url).rstrip("/"): {"url": url}}, [url]
    while level:
        place = {_qualified(spark, u).rstrip("/"): n for n, u in enumerate(level)}
        at = lambda file: place.get(file, place.get(posixpath.dirname(file)))  # noqa: E731, a source may be a folder of one file
        named = spark.read.schema(INDEX).json(level, multiLine=True).select(_file().alias("file"), F.posexplode("shards").alias("n", "s"))
        rows = named.select("file", "n", "s.*").where("url <> ''").limit(most * len(level) + 1).collect()
        if len(rows) > most * len(level):
            raise ValueError(f"more than {most} indexes are named")
        level_before, level = level, []
        for r in sorted(rows, key=lambda r: (at(r.file), r.n)):
            there = resolved(level_before[at(r.file)], r.url)
            if (key := _qualified(spark, there).rstrip("/")) not in known:
                known[key] = {k: v for k, v in r.asDict().items() if k not in ("file", "n")} | {"url": there}
                if not there.endswith("/"):
                    level.append(there)
        if len(known) > most:
            raise ValueError(f"more than {most} indexes are named")
    return list(known.values())


def read_index(spark: SparkSession, sources: list[dict], lang: str | None = None) -> tuple[DataFrame, DataFrame]:
    """pages and blocks of the sources. A block may be a string or an object; those without text are left out.

    One scan reads all sources that are single documents, one more all folders of lines (addresses that end in
    a slash; what `write_index` writes), whose files Spark splits; lines without an address are no pages. A source that is listed again counts once. A
    page's number within its index must be below 2^40; an error is raised if a folder's isn't.
    """
    first: dict[str, tuple[int, dict]] = {}
    for s in sources:
        first.setdefault(_qualified(spark, s["url"]).rstrip("/"), (len(first), s))
    listed = [(n, at, (s.get("named") or {}).get(lang) or s.get("section"), s.get("order")) for at, (n, s) in first.items()]
    of = F.broadcast(spark.createDataFrame(listed, "source_seq int, source string, s_section string, s_order int"))  # one row for each index, of which there are a bounded number
    single = [s["url"] for _, s in first.values() if not s["url"].endswith("/")]
    folders = [s["url"] for _, s in first.values() if s["url"].endswith("/")]
    parts = []
    if single:
        read = spark.read.schema(INDEX).json(single, multiLine=True).select(_file().alias("source"), F.posexplode("pages").alias("number", "p"))
        parts.append(read.select("source", F.col("number").cast("long").alias("number"), "p"))
    if folders:
        fields = [f.split(":")[0] for f in _PAGE.replace("array<string>", "array").split(",")]
        read = spark.read.schema(LINE.replace(":", " ")).json(folders).where("url IS NOT NULL")
        fits = F.coalesce(F.col("number").between(0, (1 << 40) - 1), F.lit(False))
        number = F.when(fits, F.col("number")).otherwise(F.raise_error(F.lit("a page's number is missing or too large")).cast("long"))
        parts.append(read.select(F.regexp_replace(_file(), "/[^/]*$", "").alias("source"), number.alias("number"), F.struct(*fields).alias("p")))
    rows = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).join(of, "source")
    page_id = F.shiftleft(F.col("source_seq").cast("long"), 40) + F.col("number")  # up to 10,000 sources: 54 bits
    pages = rows.select(
        page_id.alias("page_id"), "p.url", "p.title", "p.also", "p.lang", F.coalesce("p.section", "s_section").alias("section"),
        F.coalesce("p.order", "s_order", F.lit(0)).alias("order_"), F.coalesce("p.fallback", F.lit(False)).alias("fallback"),
    )
    parsed = lambda b: F.when(b.startswith("{"), F.from_json(b, _BLOCK)).otherwise(F.struct(b.alias("text"), F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("string").alias("section")))
    kept = F.filter(F.transform("p.blocks", parsed), lambda b: b["text"] != "")
    blocks = rows.select(page_id.alias("page_id"), F.posexplode(kept).alias("block_seq", "b"))
    return pages, blocks.select("page_id", "block_seq", F.col("b.anchor").alias("anchor"), F.col("b.section").alias("heading"), F.col("b.text").alias("text"))


def write_index(pages: DataFrame, blocks: DataFrame, path: str, compression: str = "none") -> None:
    """The pages as JSON lines with their blocks, in site order within each file, numbered by page_id; one file holds a part of the pages."""
    block = F.struct("block_seq", F.struct("text", "anchor", F.col("heading").alias("section")).alias("b"))
    listed = blocks.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(block)), lambda x: x["b"]).alias("blocks"))
    rows = pages.join(listed, "page_id", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(f"array<{_BLOCK}>")))
    out = rows.select(F.col("page_id").alias("number"), "url", "title", "also", "lang", "section", F.col("order_").alias("order"), "fallback", "blocks")
    out.repartitionByRange("order", "number").sortWithinPartitions("order", "number").write.option("compression", compression).json(path)


def numbered(pages: DataFrame, n: str = "n_chunks") -> DataFrame:
    """pages with `first`: the sum of n over all pages before, in order of (order_, page_id).

    Sums are taken for each part of the order, of which there are as many as partitions, then within parts.
    """
    key = F.struct("order_", "page_id")
    parts = pages.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cuts = pages.agg(F.percentile_approx("page_id", [k / int(parts) for k in range(1, int(parts))] or [0.5]).alias("cuts"))
    part = F.size(F.filter("cuts", lambda c: c < F.col("page_id")))
    placed = pages.join(F.broadcast(cuts), F.lit(True)).withColumn("part", part).drop("cuts")
    sums = placed.groupBy("order_", "part").agg(F.sum(n).alias("s"))
    before = sums.select("order_", "part", (F.sum("s").over(Window.orderBy("order_", "part")) - F.col("s")).alias("before"))
    within = F.sum(n).over(Window.partitionBy("order_", "part").orderBy(key)) - F.col(n)
    return placed.withColumn("within", within).join(before, ["order_", "part"]).withColumn("first", F.col("before") + F.col("within")).drop("part", "before", "within")
