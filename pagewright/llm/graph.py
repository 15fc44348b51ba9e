"""Connected components of a table of links, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import new_folder, removed, write


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of a link the smallest node that can be reached.

    Large and small stars in turn (Kiveris et al., 2014): every round hangs a node's larger neighbours, then
    its smaller ones, on the smallest, until all hang on the root of their component. Rounds grow with the
    logarithm of the longest path. Each is written to the shared folder, where the last one stays. Minima are taken before rows are
    joined, so that a node with very many links is summed up where its links are.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    spark, path = links.sparkSession, new_folder(links.sparkSession, "links")
    now = write(pairs.distinct(), path)
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lowest.select("u", F.col("m").alias("v")))
        last, path = path, new_folder(spark, "links")
        now = write(small.distinct(), path)
        before, state = state, _state(now)
        removed(spark, last)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
