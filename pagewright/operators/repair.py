"""Repairing queries that find nothing: shorter stems, nearest words.

A lexicon is looked up in three tables that are derived from it once and stored in order: its words, their
prefixes, and keys at which words meet that differ by one or two letters. All lookups are joins on equal keys.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.storage import spread

#: Letters up to which prefixes are listed one by one; longer ones are told by their first so many and the words themselves.
LISTED = 64
#: Letters up to which words meet with a letter left out; longer ones meet in an unchanged half.
SHORT = 12
TABLES = "words", "prefixes", "near"
_PAGED = {"compression": "zstd", "parquet.page.size": "65536", "parquet.page.row.count.limit": "2048", "parquet.block.size": str(32 << 20)}
#: Keys up to which a lookup says in its filter which it wants, so that little is read.
FEW = 128


def allowance(word: Column) -> Column:
    """How many letters of a word may be wrong."""
    n = F.length(word)
    return F.when(n >= 8, 2).when(n >= 4, 1).otherwise(0)


def _part(word: Column, start: Column | int, end: Column | int) -> Column:
    """Letters from start (counted from 0) up to end."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.substr(word, start + 1, end - start)


def _without_one(word: Column) -> Column:
    """A word and all that are left of it without one letter."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), less))


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *(p.cast("string") for p in parts))


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def _thirds(n: Column) -> tuple[Column, Column]:
    return F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int")


def _cut(arrays: list[Column]) -> Column:
    return F.array_distinct(F.concat(*arrays))


def _none() -> Column:
    return F.array().cast("array<string>")


def keys_of(word: Column) -> Column:
    """The keys of a lexicon word.

    For one change: short words with a letter left out; of longer ones the two halves, one of which stays whole.
    For two changes behind the first two letters: three parts of the rest, one of which stays whole.
    """
    n = F.length(word)
    h, (a, b) = _half(n), _thirds(n - 2)
    one = F.when(n <= SHORT, F.transform(_without_one(word), lambda w: _key("d", w))).otherwise(F.array(_key("h", n, F.lit(0), _part(word, 0, h)), _key("h", n, F.lit(1), _part(word, h, n))))
    two = [_key("t", n, F.lit(k), F.left(word, F.lit(2)), _part(word, x + 2, y + 2)) for k, x, y in ((0, F.lit(0), a), (1, a, b), (2, b, n - 2))]
    return _cut([one, F.when(n >= 6, F.array(*two)).otherwise(_none())])


def keys_for(spelling: Column, most: Column) -> Column:
    """The keys at which words up to `most` (0 to 2) changes from a spelling are found; words two away begin with its first two letters."""
    n = F.length(spelling)
    one = [F.when(n <= SHORT + 1, F.transform(_without_one(spelling), lambda w: _key("d", w))).otherwise(_none())]
    for d in (-1, 0, 1):
        size = n + d
        h = _half(size)
        one.append(F.when(size > SHORT, F.array(_key("h", size, F.lit(0), _part(spelling, 0, h)), _key("h", size, F.lit(1), _part(spelling, n - (size - h), n)))).otherwise(_none()))
    two = []
    for d in (-2, -1, 0, 1, 2):
        size = n + d
        a, b = _thirds(size - 2)
        start = lambda k, x, y: _key("t", size, F.lit(k), F.left(spelling, F.lit(2)), _part(spelling, x, y))  # noqa: B023, E731
        # The first part stands where it stood, the last one counted from the end; before the middle one there is one change.
        parts = [start(0, F.lit(2), a + 2), start(2, n - (size - 2 - b), n), *(start(1, a + 2 + s, b + 2 + s) for s in (-1, 0, 1))]
        two.append(F.when(size >= 6, F.array(*parts)).otherwise(_none()))
    return F.when(most >= 1, F.when(most >= 2, _cut(one + two)).otherwise(_cut(one))).otherwise(_none())


@dataclass(frozen=True)
class Dictionary:
    """A lexicon as lookups need it: words (word, weight), prefixes (prefix, n, owner, weight), near (key, near, weight).

    Of a prefix: how many words begin with it, the first of them and the sum of their weights. Words
    of more letters than are LISTED have no longer prefixes here.
    """

    words: DataFrame
    prefixes: DataFrame
    near: DataFrame

    @staticmethod
    def of(lexicon: DataFrame) -> Dictionary:
        """The tables as they follow from (word, weight)."""
        words = lexicon.where("word <> ''").select("word", "weight")
        cut = words.select("word", "weight", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(LISTED)))).alias("n"))
        # Counted before they are shuffled: short prefixes are those of very many words.
        prefixes = cut.select(F.left("word", F.col("n")).alias("prefix"), "word", "weight").groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("owner"), F.sum("weight").alias("weight"))
        near = words.select(F.explode(keys_of(F.col("word"))).alias("key"), F.col("word").alias("near"), "weight")
        return Dictionary(words, prefixes, near)

    def write(self, folder: str, tables: tuple[str, ...] = TABLES) -> Dictionary:
        """The tables stored below folder, each file in the order of its key, so that an equal key is a page of it; those named, where not all are needed."""
        spark = self.words.sparkSession
        put = lambda of, key, name: of.sortWithinPartitions(key).write.options(**_PAGED).parquet(f"{folder}/{name}")
        put(self.words, "word", "words")
        of = Dictionary.of(spread(spark.read.parquet(f"{folder}/words")))
        # Prefixes come dealt out by their groups; keys are too many words' for that, and are dealt out by the words.
        for name, key in (("prefixes", "prefix"), ("near", "key")):
            if name in tables:
                put(getattr(of, name), key, name)
        return Dictionary(*(spark.read.parquet(f"{folder}/{name}") if name == "words" or name in tables else getattr(of, name) for name in TABLES))

    @staticmethod
    def stored(spark: SparkSession, folder: str) -> Dictionary:
        return Dictionary(*(spark.read.parquet(f"{folder}/{name}") for name in TABLES))


def _tables(lexicon: DataFrame | Dictionary) -> Dictionary:
    return lexicon if isinstance(lexicon, Dictionary) else Dictionary.of(lexicon)


def narrowed(table: DataFrame, column: str, asked: DataFrame, few: int) -> DataFrame:
    """The table's rows for the asked keys if there are at most `few` of these, by a filter that the files' statistics answer; else all. 0 does not look."""
    some = [r[0] for r in asked.select(column).distinct().limit(few + 1).collect()] if few else None
    if some is None or len(some) > few:
        return table
    return table.where(functools.reduce(operator.or_, (F.col(column) == k for k in some), F.lit(False)))


def known(prefixes: DataFrame, lexicon: DataFrame | Dictionary, few: int = 0) -> DataFrame:
    """(prefix, n, owner, weight): of (prefix), those that lexicon words begin with, how many, and the first of these."""
    of = _tables(lexicon)
    asked = prefixes.distinct()
    listed = asked.where(F.length("prefix") <= LISTED)
    met = narrowed(of.prefixes, "prefix", listed, few).join(listed, "prefix")
    long = asked.where(F.length("prefix") > LISTED).withColumn("start", F.left("prefix", F.lit(LISTED)))
    words = of.words.where(F.length("word") > LISTED).withColumn("start", F.left("word", F.lit(LISTED)))
    rest = long.join(words, "start").where(F.expr("startswith(word, prefix)")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("owner"), F.sum("weight").alias("weight"))
    return met.select("prefix", "n", "owner", "weight").unionByName(rest)


def widen(words: DataFrame, lexicon: DataFrame | Dictionary, few: int = 0) -> DataFrame:
    """(word, stem): of (word), the longest proper prefix that some lexicon word begins with, of 4 letters and 60 % of it at least; null if there is none."""
    least = F.greatest(F.lit(4), F.ceil(F.length("word") * 0.6).cast("int"))
    n = F.length("word") - 1
    tried = words.distinct().select("word", F.explode(F.when(n >= least, F.sequence(least, n))).alias("n")).select("word", F.left("word", F.col("n")).alias("prefix"))
    found = tried.join(known(tried.select("prefix"), lexicon, few), "prefix").groupBy("word").agg(F.max_by("prefix", F.length("prefix")).alias("stem"))
    return words.distinct().join(found, "word", "left")


def nearest(words: DataFrame, lexicon: DataFrame | Dictionary, cap: int | Column = 2, few: int = 0) -> DataFrame:
    """(word, nearest, distance): the lexicon word with the fewest letters changed, then the greatest weight, then the first; null if none is near enough.

    Words and their spelling with vowels after r count alike. Two changes count only if the first two letters agree.
    """
    other = F.regexp_replace("word", "r(?![aeiou])", "ri")
    most = F.least(allowance(F.col("word")), cap if isinstance(cap, Column) else F.lit(cap))
    asked = words.select("word", most.alias("most")).distinct()
    spelt = asked.select("word", "most", F.explode(F.array_distinct(F.array(F.col("word"), other))).alias("spelling")).where("most > 0")
    probes = spelt.withColumn("key", F.explode(keys_for(F.col("spelling"), F.col("most"))))
    met = probes.join(narrowed(_tables(lexicon).near, "key", probes, few), "key").select("word", "most", "spelling", "near", "weight").distinct()
    near = met.withColumn("d", F.levenshtein("spelling", "near")).where("d <= most AND (d <= 1 OR left(spelling, 2) = left(near, 2))")
    best = near.groupBy("word", "most").agg(F.min(F.struct("d", (-F.col("weight")).alias("w"), "near")).alias("b"))
    return asked.join(best, ["word", "most"], "left").select("word", F.col("b.near").alias("nearest"), F.col("b.d").alias("distance"))


def respelt(queries: DataFrame, lexicon: DataFrame | Dictionary, cap: int = 2, few: int = 0) -> DataFrame:
    """(query_id, pos, word, now, missing): each word of (query_id, pos, word) as it is if a lexicon word begins with it, else missing and the nearest or null."""
    words = queries.select("word").distinct()
    have = known(words.select(F.col("word").alias("prefix")), lexicon, few).select(F.col("prefix").alias("word"))
    put = nearest(words.join(have, "word", "left_anti"), lexicon, cap, few).select("word", "nearest", F.lit(True).alias("missing"))
    each = queries.join(put, "word", "left")
    return each.select("query_id", "pos", "word", F.when(F.col("missing"), F.col("nearest")).otherwise(F.col("word")).alias("now"), F.coalesce("missing", F.lit(False)).alias("missing"))


def correct(queries: DataFrame, lexicon: DataFrame | Dictionary, cap: int = 2, few: int = 0) -> DataFrame:
    """(query_id, corrected): of (query_id, pos, word), the query with its words that no lexicon word begins with replaced by the nearest; null if one has none, or none is to be replaced."""
    listed = respelt(queries, lexicon, cap, few).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "now"))).alias("l"), F.bool_and(F.col("now").isNotNull()).alias("whole"), F.bool_or("missing").alias("changed")
    )
    return listed.select("query_id", F.when(F.col("whole") & F.col("changed"), F.array_join(F.transform("l", lambda x: x["now"]), " ")).alias("corrected"))


def only(prefixes: DataFrame, lexicon: DataFrame | Dictionary, few: int = 0) -> DataFrame:
    """(word, only): of (word), the one lexicon word that begins with it; null if there are none or several."""
    asked = prefixes.distinct()
    told = known(asked.select(F.col("word").alias("prefix")), lexicon, few).where("n = 1").select(F.col("prefix").alias("word"), F.col("owner").alias("only"))
    return asked.join(told, "word", "left").select("word", "only")
