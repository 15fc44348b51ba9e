"""The inverted index: chunks of blocks, their vocabulary, postings and lexicon."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.formulas import PART, with_record
from pagewright.functions.query import started
from pagewright.functions.tables import GLYPHS, LETTERS
from pagewright.operators.repair import Dictionary
from pagewright.storage import bytes_of

#: Blocks to a chunk, of 64 at most; characters from which a text is furniture; the number of a title among blocks and chunks.
CHUNK, REPEAT_CHARS, TITLE = 32, 60, -1
#: Pages of a Parquet column in entries and lists: small ones, so that a reader can leave out most of a file.
PAGED = {"compression": "zstd", "parquet.page.size": "65536", "parquet.page.row.count.limit": "256", "parquet.block.size": str(32 << 20)}
WORDS = f"[{LETTERS}]+|[{GLYPHS}]"
#: Bytes of stored entries to a task that cuts them into words; postings that it holds at most before it puts them out, but for those of a chunk.
DEALT, HELD = 16 << 20, 1 << 19
SITE = "order_", "page_id", "chunk"


def without_repeated(blocks: DataFrame, threshold: int = 4, least: int = REPEAT_CHARS) -> DataFrame:
    """Blocks less those whose text, of `least` characters or more, stands on `threshold` different pages; all if threshold is below 2."""
    if threshold < 2:
        return blocks
    long = blocks.where(F.length("text") >= least).select("text", "page_id")
    # Distinct first, then counted: both are summed up before the shuffle, so one text on very many pages is few rows.
    furniture = long.distinct().groupBy("text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold).select("text")
    return blocks.join(furniture, "text", "left_anti").select(*blocks.columns)


def entries(pages: DataFrame, blocks: DataFrame, size: int = CHUNK, clustered: bool = False) -> DataFrame:
    """What is searched: (order_, page_id, block_seq, chunk, anchor, heading, text, marked, squeezed).

    A page's title and other names are its block TITLE, in a chunk of its own; its other chunks are `size`
    blocks each. marked is the fold of heading and text with a sign before each word. Folding is most of the
    work of a search: `build` stores these rows. If clustered, each task sorts its rows in site order
    before they are folded, so that a few pages of the site are a few parts of a file.
    """
    none = F.lit(None).cast("string")
    titles = pages.select(
        "order_", "page_id", F.lit(TITLE).alias("block_seq"), none.alias("anchor"), none.alias("heading"), F.col("title").alias("text"),
        F.concat("title", F.lit(" "), F.coalesce("also", F.lit(""))).alias("said"),
    )
    under = blocks.join(pages.select("page_id", "order_"), "page_id").select(
        "order_", "page_id", "block_seq", "anchor", "heading", "text", F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.col("text")).alias("said")
    )
    rows = titles.unionByName(under)
    if clustered:
        rows = rows.sortWithinPartitions("order_", "page_id", "block_seq")
    rows = with_record(rows, F.col("said"))
    chunk = F.when(F.col("block_seq") == TITLE, TITLE).otherwise(chunk_of(size=size)).cast("int")
    return rows.select("order_", "page_id", "block_seq", chunk.alias("chunk"), "anchor", "heading", "text", started(F.col("fold")).alias("marked"), "squeezed")


def chunk_of(block_seq: str = "block_seq", size: int = CHUNK) -> Column:
    """A chunk's number within its page: (page_id, chunk) is its key, so neither runs over."""
    return F.floor(F.col(block_seq) / size).cast("int")


def chunk_map(blocks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(page_id, chunk, first_block, n_blocks) of each chunk."""
    return blocks.groupBy("page_id", chunk_of(size=size).alias("chunk")).agg(F.min("block_seq").cast("long").alias("first_block"), F.count(F.lit(1)).alias("n_blocks"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """Entries with words: the distinct words and glyphs of the fold, and pairs of neighbours in formulas with a $ in front."""
    words = F.array_distinct(F.regexp_extract_all("marked", F.lit(WORDS), F.lit(0)))
    n = F.length("squeezed")
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(F.col("squeezed"), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    pairs = F.transform(F.filter(pairs, lambda p: ~p.contains(PART)), lambda p: F.concat(F.lit("$"), p))
    return rows.withColumn("words", F.array_union(words, pairs))


def postings(rows: DataFrame, size: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """(word, order_, page_id, chunk, blocks): which chunks of the entries hold a word, and a bit for each of their blocks that does.

    Long lists stay rows, so a word of every chunk is no array. A title is the first and only block of its chunk.
    """
    bit = F.when(F.col("block_seq") == TITLE, 0).otherwise(F.col("block_seq") - F.col("chunk") * size).cast("int")
    # Blocks are dealt out by chunk before they are cut into words, so that no word is dealt out: it would be many times the text.
    dealt = rows.select(*SITE, bit.alias("bit"), "marked", "squeezed").repartition(*(() if tasks is None else (tasks,)), *SITE)
    each = vocabulary(dealt).select(*SITE, "bit", F.explode("words").alias("word"))
    return each.groupBy("word", *SITE).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("blocks"))


#: Postings as they are stored: a word's chunks in site order for a stretch of the site, whose first and last page stand beside them.
LISTS = """word string, weight bigint, titles bigint, from_order int, from_page bigint, to_order int, to_page bigint,
    held array<struct<order_:int,page_id:bigint,chunk:int,blocks:bigint>>"""
_WORDS = re.compile(WORDS)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class _Lot:
    """The chunks of a stretch of the site, and of each word in which of them it is, with their bits."""

    def __init__(self):
        self.sites: tuple[list, list, list] = [], [], []
        self.words: dict[str, list[int]] = {}
        self.n = 0

    def add(self, site: tuple, blocks: dict[str, int]) -> None:
        at = len(self.sites[0])
        for column, value in zip(self.sites, site):
            column.append(value)
        self.n += len(blocks)
        for word, bits in blocks.items():
            # A chunk and its bits, one after the other.
            if (of := self.words.get(word)) is None:
                self.words[word] = [at, bits]
            else:
                of += at, bits

    def batch(self) -> pa.RecordBatch:
        words = sorted(self.words)
        lists = [self.words[w] for w in words]
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint64, 2 * self.n)
        at, bits = flat[::2].astype(np.int32), flat[1::2].astype(np.int64)
        ends = np.cumsum([0, *map(len, lists)]) // 2
        orders, pages, chunks = (pa.array(c, t) for c, t in zip(self.sites, (pa.int32(), pa.int64(), pa.int32())))
        titles = np.add.reduceat(chunks.to_numpy()[at] == TITLE, ends[:-1], dtype=np.int64)
        site = [c.take(pa.array(at)) for c in (orders, pages, chunks)]
        held = pa.StructArray.from_arrays([*site, pa.array(bits)], names=["order_", "page_id", "chunk", "blocks"])
        edge = lambda column, k, otherwise: [otherwise if column[k] is None else column[k]] * len(words)
        orders, pages = self.sites[:2]
        first, last = [edge(orders, 0, -(1 << 31)), edge(pages, 0, _LEAST)], [edge(orders, -1, (1 << 31) - 1), edge(pages, -1, _MOST)]
        stretch = [pa.array(c, t) for c, t in zip((*first, *last), (pa.int32(), pa.int64()) * 2)]
        columns = [pa.array(words, pa.string()), pa.array(np.diff(ends) - titles), pa.array(titles), *stretch, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), held)]
        return pa.RecordBatch.from_arrays(columns, names=["word", "weight", "titles", "from_order", "from_page", "to_order", "to_page", "held"])


def _words_of(marked: str, squeezed: str) -> set[str]:
    """What `vocabulary` gives of an entry."""
    words = set(_WORDS.findall(marked))
    return words.union(f"${a}{b}" for a, b in zip(squeezed, squeezed[1:]) if PART not in (a, b)) if len(squeezed) > 1 else words


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in site order (order_, page_id, chunk, bit, marked, squeezed) as lists by word."""
    rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
    lot = _Lot()
    for site, of in itertools.groupby(rows, lambda r: r[:3]):
        blocks: dict[str, int] = {}
        for *_, bit, marked, squeezed in of:
            if marked is not None:
                for word in _words_of(marked, squeezed):
                    blocks[word] = blocks.get(word, 0) | 1 << bit
        if blocks:
            lot.add(site, blocks)
        if lot.n >= HELD:
            yield lot.batch()
            lot = _Lot()
    if lot.n:
        yield lot.batch()


def lists(rows: DataFrame, size: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """The postings of entries as LISTS: each task takes a stretch of the site and lists its words, so that no posting is a row that is shuffled, grouped or sorted.

    A list is as long as what a task holds at most (HELD), so a word of every chunk is many rows.
    """
    bit = F.when(F.col("block_seq") == TITLE, 0).otherwise(F.col("block_seq") - F.col("chunk") * size).cast("int")
    dealt = rows.select(*SITE, bit.alias("bit"), "marked", "squeezed").repartitionByRange(*(() if tasks is None else (tasks,)), *SITE)
    return dealt.sortWithinPartitions(*SITE).mapInArrow(_lots, LISTS)


def weights(of: DataFrame) -> DataFrame:
    """(word, weight, titles): from postings, in how many chunks of blocks each entry is, and in how many titles."""
    return of.groupBy("word").agg(F.count_if(F.col("chunk") != TITLE).alias("weight"), F.count_if(F.col("chunk") == TITLE).alias("titles"))


def lexicon(of: DataFrame, titles: bool = False) -> DataFrame:
    """(word, weight) of weights: the number of chunks, those of titles too if they count; formulas' pairs left out."""
    weight = F.col("weight") + F.col("titles") if titles else F.col("weight")
    return of.where("word NOT LIKE '$%'").select("word", weight.alias("weight")).where("weight > 0")


def merged(*lexicons: DataFrame) -> DataFrame:
    """One lexicon of several indexes' ones: weights are summed."""
    rows = functools.reduce(DataFrame.unionByName, (of.select("word", "weight") for of in lexicons))
    return rows.groupBy("word").agg(F.sum("weight").alias("weight"))


def lexicon_by_occurrence(rows: DataFrame, titles: bool = False) -> DataFrame:
    """(word, weight): the number of occurrences, from entries."""
    rows = rows if titles else rows.where(F.col("block_seq") != TITLE)
    words = rows.select(F.explode(F.regexp_extract_all("marked", F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("weight"))


def lexicon_of_blocks(blocks: DataFrame) -> DataFrame:
    """(word, weight): the occurrences in headings and texts, for a lexicon alone: the blocks are folded and counted as they are read, nothing is stored or joined."""
    said = F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.col("text"))
    words = with_record(blocks.select("heading", "text"), said, squeezed=None).select(F.explode(F.regexp_extract_all("fold", F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("weight"))


def glyphs_of_blocks(blocks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(word, page_id, chunk): the postings of single glyphs alone, of all blocks with a page. The blocks are folded as they are read, nothing is stored or joined; no words are posted."""
    said = F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.col("text"))
    rows = with_record(blocks.where("page_id IS NOT NULL").select("page_id", chunk_of(size=size).alias("chunk"), "heading", "text"), said, squeezed=None)
    return rows.select(F.explode(F.array_distinct(F.regexp_extract_all("fold", F.lit(f"[{GLYPHS}]"), F.lit(0)))).alias("word"), "page_id", "chunk").distinct()


def _after(place: tuple[int, int], order: str = "order_", page: str = "page_id") -> Column:
    return (F.col(order) > place[0]) | (F.col(order) == place[0]) & (F.col(page) > place[1])


def between(low: tuple[int, int] | None, high: tuple[int, int] | None) -> Column:
    """Whether a row stands behind the page (order_, page_id) `low`, up to `high`; None: no limit."""
    return (F.lit(True) if low is None else _after(low)) & (F.lit(True) if high is None else ~_after(high))


def _each(of: DataFrame) -> DataFrame:
    """Stored postings as rows (word, order_, page_id, chunk, blocks), whether they are stored as lists or so already, beside what else stands there."""
    told = ("weight", "titles", "from_order", "from_page", "to_order", "to_page", "held")
    return of.select(*(c for c in of.columns if c not in told), F.inline("held")) if "held" in of.columns else of


@dataclass(frozen=True)
class Index:
    """A stored index: pages, what is searched of them, and which chunks hold which words."""

    folder: str
    size: int = CHUNK
    #: Whether the words' dictionary is stored too.
    repairs: bool = False

    def _table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")

    def pages(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "pages")

    def entries(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "entries")

    def postings(self, spark: SparkSession) -> DataFrame:
        return _each(self._table(spark, "postings"))

    def posted(self, spark: SparkSession, words: DataFrame, low: tuple[int, int] | None = None, high: tuple[int, int] | None = None) -> DataFrame:
        """The postings of (word, ...) in the part of the site behind the page (order_, page_id) `low` up to `high`: words meet whole lists, of which those of other parts aren't read."""
        of = self._table(spark, "postings")
        if "held" in of.columns:
            if low is not None:
                of = of.where(_after(low, "to_order", "to_page"))
            if high is not None:
                of = of.where(~_after(high, "from_order", "from_page"))
            of = of.select("word", "held")
        return _each(words.join(of, "word")).where(between(low, high))

    def weights(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "weights")

    def dictionary(self, spark: SparkSession) -> Dictionary:
        """The words, titles' too, as repairs look them up."""
        return Dictionary.stored(spark, f"{self.folder}/dictionary")


def write_postings(of: DataFrame, path: str) -> None:
    """Postings as they are dealt out, each file by word and site order: a prefix, or a word's part of the site, is a few pages of each file.

    A word of every chunk is dealt out too, so that no task has the whole of it.
    """
    of.sortWithinPartitions("word", *SITE).write.options(**PAGED | {"parquet.page.row.count.limit": "8192"}).parquet(path)


def write_lists(of: DataFrame, path: str) -> None:
    """Lists as their tasks have them, each file by word and then site order."""
    of.sortWithinPartitions("word", "from_order", "from_page").write.options(**PAGED | {"parquet.page.row.count.limit": "1024"}).parquet(path)


def write_entries(of: DataFrame, path: str) -> None:
    of.write.options(**PAGED).parquet(path)


def build(pages: DataFrame, blocks: DataFrame, folder: str, size: int = CHUNK, posted: bool = True, repairs: bool = False) -> Index:
    """Write the index below folder. Every text is folded once, here; searches read what they need of it.

    Without `posted` there are no postings and weights, which only searches by index and repairs need, nor are
    entries in site order. Repairs also need the words' dictionary, with `repairs`.
    """
    if not 1 <= size <= 64:
        raise ValueError("a chunk has 1 to 64 blocks")
    spark, index = pages.sparkSession, Index(folder, size, posted and repairs)
    pages.write.option("compression", "zstd").parquet(f"{folder}/pages")
    write_entries(entries(index.pages(spark), blocks, size, clustered=posted), f"{folder}/entries")
    if posted:
        stored = index.entries(spark)
        write_lists(lists(stored, size, max(spark.sparkContext.defaultParallelism, -(-bytes_of(stored) // DEALT))), f"{folder}/postings")
        of = spark.read.parquet(f"{folder}/postings").groupBy("word").agg(F.sum("weight").alias("weight"), F.sum("titles").alias("titles"))
        of.write.option("compression", "zstd").parquet(f"{folder}/weights")
    if posted and repairs:
        Dictionary.of(lexicon(index.weights(spark), titles=True)).write(f"{folder}/dictionary")
    return index
