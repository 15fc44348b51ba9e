"""Ranking names: pages by title, section and address; symbols by what is typed of them."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.fold import fold, fold_places, with_fold
from pagewright.functions.tables import SYMBOLS

SHOWN, OFFERED = 12, 8


def prepared(pages: DataFrame) -> DataFrame:
    """Pages with fold, depth, key (`natural`), tail and home: the folded section of pages that lie no deeper than any other of their section.

    Pages that are in a section by default are no doors and don't count.
    """
    depth = F.size(F.filter(F.split("url", "/"), lambda x: x != ""))
    own = F.col("section").isNotNull() & (F.col("section") != "") & ~F.coalesce("fallback", F.lit(False))
    rows = pages.withColumns({"depth": depth, "own": own, "order_": F.coalesce("order_", F.lit(0))})
    # Sections are counted before they are joined, so that one of very many pages is one row.
    least = with_fold(rows.where("own").groupBy("section").agg(F.min("depth").alias("least")), "section", "door")
    joined = rows.join(least, "section", "left").withColumn("said", F.concat("url", F.lit(" "), F.coalesce("section", F.lit(""))))
    home = F.when(F.col("own") & (F.col("depth") == F.col("least")), F.col("door"))
    return with_fold(with_fold(joined, "title", "fold"), "said", "tail").select(
        "url", "title", "section", "order_", "depth", "fold", "tail", home.alias("home"), natural(F.col("title")).alias("key")
    )


def _against(name: Column, word: str) -> Column:
    w = F.lit(word)
    return F.when(name == w, 0).when(name.startswith(w), 1).when(name.contains(" " + word) | name.contains("—" + word), 2).when(name.contains(w), 3)


def scored(names: DataFrame, query: str) -> DataFrame:
    """Names that hold all words of the query, with score: the worst of the words' grades (0 equal, 1 begins, 2 a word begins, 3 within, 4 in the address)."""
    score = F.lit(0)
    test = F.lit(True)
    for word in fold(query).split():
        grade = F.coalesce(F.least(_against(F.col("fold"), word), _against(F.col("home"), word)), F.when(F.col("tail").contains(word), 4))
        score, test = F.greatest(score, grade), test & grade.isNotNull()
    return names.where(test).withColumn("score", score)


def natural(title: Column) -> Column:
    """A key by which numbers of any length in titles sort by value: each run of digits becomes its length, without zeros at its start, and its digits."""

    def part(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(x)

    return F.array_join(F.transform(F.regexp_extract_all(title, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), part), "")


#: Whose alphabet orders names that are otherwise equal.
COLLATION = "ru"


def pick(names: DataFrame, query: str, shown: int = SHOWN) -> DataFrame:
    return scored(names, query).orderBy("score", "order_", "depth", F.collate("key", COLLATION), "url").limit(shown).drop("key")


def marks(title: Column, query: str) -> Column:
    """Places in titles (start, end) of the first occurrence of each of the query's words, none within another; for the few that are shown."""
    words = fold(query).split()

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(titles: pa.Array) -> pa.Array:
        rows = []
        for text in titles.to_pylist():
            folded_text, places = fold_places(text or "")
            found = sorted((places[at], places[at + len(w)]) for w in words if (at := folded_text.find(w)) >= 0)
            apart = itertools.accumulate(found, lambda held, m: m if m[0] >= held[1] else held)
            rows.append([{"start": a, "end": b} for a, b in dict.fromkeys(apart)])
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return run(title)


def frequent(usage: DataFrame, symbols: DataFrame, n: int = OFFERED) -> DataFrame:
    """(glyph, uses): the symbols used most, the earlier in the catalogue first among equal ones."""
    ranked = usage.join(symbols.groupBy("glyph").agg(F.min("ord").alias("ord")), "glyph")
    return ranked.orderBy(F.desc("uses"), "ord").limit(n).select("glyph", "uses")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, name, glyph) for n, (name, glyph) in enumerate(SYMBOLS)], "ord int, name string, glyph string")


def matching(symbols: DataFrame, tokens: DataFrame, usage: DataFrame | None = None, shown: int = OFFERED) -> DataFrame:
    """(token, rank, name, glyph): for each of (token), the symbols it may begin: exact, prefix, and both in either case; then by usage (glyph, uses) and order."""
    low, token = F.lower("name"), F.col("token")
    grade = F.when(F.col("name") == token, 0).when(F.expr("startswith(name, token)"), 1).when(low == F.lower(token), 2).when(F.expr("startswith(lower(name), lower(token))"), 3)
    # The catalogue has some hundred rows; each token takes its first letter's.
    met = tokens.distinct().withColumn("k", F.lower(F.left("token", F.lit(1)))).join(symbols.withColumn("k", F.lower(F.left("name", F.lit(1)))), "k")
    rows = met.withColumn("grade", grade).where("grade IS NOT NULL")
    rows = rows.join(usage, "glyph", "left") if usage is not None else rows.withColumn("uses", F.lit(0))
    order = Window.partitionBy("token").orderBy("grade", F.coalesce("uses", F.lit(0)).desc(), "ord")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown).select("token", "rank", "name", "glyph")


def cells(symbols: DataFrame) -> DataFrame:
    """(ord, glyph, names): each glyph once, in the order it first comes, with its names."""
    listed = symbols.groupBy("glyph").agg(F.min("ord").alias("ord"), F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("l"))
    return listed.select("ord", "glyph", F.array_join(F.transform("l", lambda x: x["name"]), " ").alias("names"))


def token_at_end(text: Column) -> Column:
    """The command being typed at the end of a text, without its backslash; '' if there is none."""
    return F.regexp_extract(text, r"(?<!\\)\\([A-Za-z]+)$", 1)


def usage(texts: DataFrame, text: str, symbols: DataFrame) -> DataFrame:
    """(glyph, uses): how often each symbol's glyph stands in the texts."""
    glyphs = texts.select(F.explode(F.regexp_extract_all(text, F.lit("[^\\x00-\\x7F]"), F.lit(0))).alias("glyph"))
    return glyphs.groupBy("glyph").agg(F.count(F.lit(1)).alias("uses")).join(symbols.select("glyph").distinct(), "glyph", "left_semi")
