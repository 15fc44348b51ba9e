"""An index that follows its source: new documents are folded, cut and posted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators import index
from pagewright.sources import tables

_TABLES = ("pages", "entries", "postings")


def _add(folder: str):
    def batch(docs: DataFrame, epoch: int) -> None:
        # A batch that is repeated after a failure writes its own folders again, so nothing is there twice.
        spark, at = docs.sparkSession, f"epoch={epoch}"
        pages = tables.document_pages(docs)
        pages.write.mode("overwrite").parquet(f"{folder}/pages/{at}")
        index.entries(pages, tables.line_blocks(docs)).write.mode("overwrite").parquet(f"{folder}/entries/{at}")
        posted = index.postings(spark.read.parquet(f"{folder}/entries/{at}"))
        posted.sortWithinPartitions("word").write.mode("overwrite").parquet(f"{folder}/postings/{at}")

    return batch


def maintain(docs: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Start following a stream of documents (doc_id, text, lang, source) into tables below folder.

    A document may come again: its latest epoch counts. Within one batch it should come once.
    """
    return docs.writeStream.foreachBatch(_add(folder)).option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pages, entries and postings as they are now: of each page what its latest epoch says."""
    pages, *others = (spark.read.parquet(f"{folder}/{name}") for name in _TABLES)
    latest = pages.groupBy("page_id").agg(F.max("epoch").alias("epoch"))
    now = lambda of: of.join(latest, ["page_id", "epoch"], "left_semi").select(*(c for c in of.columns if c != "epoch"))
    return now(pages), *map(now, others)


def compact(spark: SparkSession, folder: str, into: str) -> index.Index:
    """The index as it is now in one piece, in a folder of its own: few files, postings in order, nothing outdated."""
    pages, entries, postings = read(spark, folder)
    pages.write.option("compression", "zstd").parquet(f"{into}/pages")
    index.write_entries(entries.sortWithinPartitions("order_", "page_id", "block_seq"), f"{into}/entries")
    index.write_postings(postings.repartition("word", *index.SITE), f"{into}/postings")
    whole = index.Index(into)
    index.weights(whole.postings(spark)).write.option("compression", "zstd").parquet(f"{into}/weights")
    return whole


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return index.lexicon(index.weights(read(spark, folder)[2]))
