"""Answering queries: all terms in one block or title, in site order."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.query import Term, all_found, exact, least_keys, parse, parsed
from pagewright.operators.index import SITE, TITLE, Index, between
from pagewright.storage import spread, written

LIMIT = 100
#: Pages, first in site order, in which many queries are answered first, and how much further each round reaches.
FIRST, FURTHER = 1024, 16
#: Chunks that a search by index reads first and at most by name; ranges of pages that a filter names.
READ, NAMED, RANGES = 128, 8192, 64
#: Pages, about, by which the site's order is known for rounds.
SAMPLED = 4096


def matches(entries: DataFrame, terms: list[Term]) -> DataFrame:
    """Entries that hold all terms, with kind: 0 for titles, 1 for blocks."""
    return entries.where(all_found(F.col("marked"), F.col("squeezed"), terms)).withColumn("kind", F.when(F.col("block_seq") == TITLE, 0).otherwise(1))


def top(of: DataFrame, limit: int = LIMIT) -> DataFrame:
    return of.orderBy("order_", "page_id", "block_seq").limit(limit)


def search(entries: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """The first entries that answer the query, read from all."""
    return top(matches(entries, parse(query)), limit)


def found(entries: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """One row (found, titles, pages, shown): how much answers the query, and how many rows of it are shown."""
    n = F.count(F.lit(1))
    return matches(entries, parse(query)).agg(n.alias("found"), F.count_if(F.col("kind") == 0).alias("titles"), F.count_distinct("page_id").alias("pages"), F.least(n, F.lit(limit)).alias("shown"))


def candidates(postings: DataFrame, terms: list[Term], together: bool = True) -> DataFrame | None:
    """(order_, page_id, chunk, blocks): chunks that may hold all terms in one block, with a bit for each such block; None if the index can tell of no term.

    A needle's keys must all be there, any needle of a term will do, and all terms must be met. Where all terms are
    `exact`, these blocks are the answer. If not `together`, terms may be in different blocks of the chunk. One pass over the keys' postings, whose bits are summed up before the shuffle.
    """
    told = [least for term in terms if (least := least_keys(term))]
    if not told:
        return None
    wanted = list(dict.fromkeys(key for term in told for keys in term for key in keys))
    # The query's keys are known here; each becomes a filter that reaches the scan.
    hit = functools.reduce(operator.or_, (F.col("word").startswith(key) for key in wanted))
    each = [F.coalesce(F.bit_or(F.when(F.col("word").startswith(key), F.col("blocks"))), F.lit(0).cast("long")).alias(f"k{n}") for n, key in enumerate(wanted)]
    bits = lambda k: F.col(f"k{k}") if together else F.when(F.col(f"k{k}") != 0, F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long"))
    both = lambda keys: functools.reduce(lambda a, b: a.bitwiseAND(b), (bits(wanted.index(k)) for k in keys))
    any_ = lambda term: functools.reduce(lambda a, b: a.bitwiseOR(b), map(both, term))
    blocks = functools.reduce(lambda a, b: a.bitwiseAND(b), map(any_, told))
    return postings.where(hit).groupBy(*SITE).agg(*each).select(*SITE, blocks.alias("blocks")).where("blocks <> 0")


def _blocks(of: DataFrame, size: int) -> DataFrame:
    """Chunks with bits as rows of (..., block_seq)."""
    seq = F.when(F.col("chunk") == TITLE, TITLE).otherwise(F.col("chunk") * size + F.col("bit")).cast("int")
    some = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("blocks").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    return of.withColumn("bit", F.explode(some)).withColumn("block_seq", seq).drop("bit", "blocks")


def _in_pages(pages: list[tuple[int, int]]) -> Column:
    """A filter that files' statistics can answer, for (order_, page_id) in site order: at most RANGES ranges, which may hold more than these pages."""
    widest = sorted((b[1] - a[1] if a[0] == b[0] else 1 << 62, k) for k, (a, b) in enumerate(zip(pages, pages[1:]), 1))
    edges = [0, *sorted(k for _, k in widest[-(RANGES - 1) :] if pages[k] != pages[k - 1]), len(pages)]
    spans = [(pages[a], pages[b - 1]) for a, b in zip(edges, edges[1:])]
    # A span over several orders has the pages of all of them between the least and the greatest.
    return functools.reduce(operator.or_, (F.col("order_").between(x[0], y[0]) & F.col("page_id").between(*sorted((x[1], y[1]))) if x[0] == y[0] else F.col("order_").between(x[0], y[0]) for x, y in spans))


def _chunks_read(entries: DataFrame, named: list[Row]) -> DataFrame:
    """The entries of the named chunks, by a filter on their pages."""
    if not named:
        return entries.where("false")
    keys = entries.sparkSession.createDataFrame([(r.page_id, r.chunk) for r in named], "page_id long, chunk int")
    return entries.where(_in_pages(sorted({(r.order_, r.page_id) for r in named}))).join(F.broadcast(keys), ["page_id", "chunk"], "left_semi")  # NAMED rows at most


def _behind(place: Row) -> Column:
    at = (place.order_, place.page_id, place.chunk)
    step = lambda k: functools.reduce(operator.and_, (F.col(c) == v for c, v in zip(SITE[:k], at)), F.lit(True)) & (F.col(SITE[k]) > at[k])
    return step(0) | step(1) | step(2)


def search_by_index(entries: DataFrame, postings: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """The same rows as search: the index names chunks, in site order; these alone are read from the stored entries and tested.

    The first READ chunks are read by name, then FURTHER times as many, until `limit` rows are found or no chunk
    is left. Beyond NAMED chunks the rest is joined.
    """
    terms = parse(query)
    chunks = candidates(postings, terms)
    if chunks is None:
        return search(entries, query, limit)
    # If the index tells all, each chunk has an answer.
    sure = all(map(exact, terms))
    parts, most, left = [], max(READ, limit) if sure else READ, chunks
    while True:
        if most > NAMED:
            parts.append(matches(entries.join(left.select("page_id", "chunk"), ["page_id", "chunk"], "left_semi"), terms))
            break
        named = left.orderBy(*SITE).limit(most + 1).collect()
        parts.append(matches(_chunks_read(entries, named[:most]), terms))
        if len(named) <= most or sure:
            break
        if functools.reduce(DataFrame.unionByName, parts).limit(limit).count() >= limit:
            break
        left, most = chunks.where(_behind(named[most - 1])), most * FURTHER
    return top(functools.reduce(DataFrame.unionByName, parts), limit)


@dataclass(frozen=True)
class _Asked:
    """What different lists of keys (of) ask of postings: words of needles with one key (of, word); and needles with several keys: (of, n, need, key) and the words of these keys (key, word)."""

    single: DataFrame
    #: Both None if there are none.
    several: DataFrame | None
    words: DataFrame | None

    def only(self, of: DataFrame) -> _Asked:
        return _Asked(self.single.join(of, "of", "left_semi"), None if self.several is None else self.several.join(of, "of", "left_semi"), self.words)

    def lists(self, posted: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(of, order_, page_id, chunk, blocks): for each list of keys the chunks that may have a needle, and in which blocks; posted adds their postings to (word, ...)."""
        one = posted(self.single).select("of", *SITE, "blocks")
        if self.several is None:
            return one.groupBy("of", *SITE).agg(F.bit_or("blocks").alias("blocks"))
        held = posted(self.words).groupBy("key", *SITE).agg(F.bit_or("blocks").alias("blocks"))
        whole = self.several.join(held, "key").groupBy("of", "n", "need", *SITE).agg(F.count(F.lit(1)).alias("c"), F.bit_and("blocks").alias("blocks")).where("c = need AND blocks <> 0")
        return one.unionByName(whole.select(*one.columns)).groupBy("of", *SITE).agg(F.bit_or("blocks").alias("blocks"))


def _words_of(index: Index, terms: DataFrame) -> tuple[_Asked, DataFrame]:
    """Of the different lists of keys (of, needles): what they ask, and how many chunks each has at most (of, size)."""
    spark = terms.sparkSession
    each = written(terms.select("of", F.posexplode("needles").alias("n", "keys")).select("of", "n", F.size("keys").alias("need"), F.explode("keys").alias("key")), "keys")
    # Keys meet words as equals: by three letters, or by all that shorter ones have.
    starts = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.left("word", i))))
    words = spread(index.weights(spark)).select("word", (F.col("weight") + F.col("titles")).alias("w"), starts.alias("k3"))
    met = each.select("key").distinct().withColumn("k3", F.left("key", F.lit(3))).join(words, "k3").where(F.expr("startswith(word, key)"))
    met = written(met.select("key", "word", "w"), "words")
    least = each.join(met.groupBy("key").agg(F.sum("w").alias("w")), "key", "left").groupBy("of", "n").agg(F.min(F.coalesce("w", F.lit(0))).alias("w"))
    single = written(each.where("need = 1").join(met, "key").select("of", "word").distinct(), "single")
    several = each.where("need > 1")
    asked = _Asked(single, None, None) if several.isEmpty() else _Asked(single, several, met.join(several, "key", "left_semi").select("key", "word"))
    return asked, least.groupBy("of").agg(F.sum("w").alias("size"))


def _all_met() -> Column:
    """The test of a block for all of a row's terms, if the index can't tell."""
    one = lambda n, t: F.when(t["formula"], F.contains(F.col("squeezed"), n)).otherwise(F.contains(F.col("marked"), n))
    return F.forall("terms", lambda t: F.exists(t["needles"], lambda n: one(n, t)))


def _bounds(index: Index, spark: SparkSession, first: int, further: int) -> list[tuple[int, int] | None]:
    """Where rounds end: about the first `first` pages in site order, then `further` times as many, and so on; None for the end of the site.

    The order is known by some SAMPLED pages, the same ones each time.
    """
    pages = index.pages(spark).select("order_", "page_id")
    n, ends = pages.count(), []
    while first < n:
        ends.append(first / n)
        first *= further
    if not ends:
        return [None]
    sample = sorted(map(tuple, pages.where(F.pmod(F.xxhash64("page_id"), F.lit(max(1, n // SAMPLED))) == 0).collect()))
    return [*dict.fromkeys(sample[int(share * len(sample))] for share in ends if sample), None]


def search_terms(index: Index, asked: DataFrame, limit: int = LIMIT, first: int = FIRST, further: int = FURTHER) -> DataFrame:
    """(query_id, rank, order_, page_id, block_seq): the rows of `search` for each of (query_id, terms), terms as `query.parsed` gives them.

    Each query is answered from the chunks of that of its terms which the fewest chunks have; in these, the bits of its other
    terms' lists leave the blocks that hold all. Lists are made once for all queries with a term, from the
    postings of a part of the site, in site order; a query that has its rows leaves, and the next part is
    `further` times as long. Blocks are read only for terms that the index can't tell, and of the same part.
    """
    spark = asked.sparkSession
    asked = written(asked.select("query_id", "terms").where(F.size("terms") > 0), "queries")
    told = asked.select("query_id", F.explode("terms.keys").alias("needles")).where(F.size("needles") > 0).withColumn("of", F.to_json("needles"))
    asks_of, sizes = _words_of(index, told.select("of", "needles").distinct())
    lists_of = told.select("query_id", "of").distinct().join(sizes, "of", "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("size", F.lit(0)).alias("size"), "of"))).alias("l"))
    # A list that is empty ends the query; the shortest is where it is answered from.
    left = asked.join(lists_of, "query_id", "left").where("l IS NULL OR l[0].size > 0").select(
        "query_id", "terms", F.coalesce(F.col("l")[0]["of"], F.lit("[]")).alias("of"), F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(1))), lambda x: x["of"]).alias("others"),
        F.forall("terms", lambda t: t["exact"]).alias("sure"),
    )
    left = written(left, "left")
    order = Window.partitionBy("query_id").orderBy("order_", "page_id", "block_seq")
    rounds, low = [], None
    for high in _bounds(index, spark, first, further):
        part = between(low, high)
        asks_now = asks_of.only(_lists_left(left)) if rounds else asks_of
        lists = written(asks_now.lists(lambda words: index.posted(spark, words, low, high)), "lists")
        near = lists.join(left.select("query_id", "of", "others", "sure"), "of").select("query_id", "sure", "others", *SITE, "blocks")
        more = near.select("query_id", *SITE, F.explode("others").alias("of")).join(lists, ["of", *SITE]).select("query_id", *SITE, "blocks", F.lit(0).alias("n"), F.lit(None).cast("boolean").alias("sure"))
        every = near.select("query_id", *SITE, "blocks", (F.size("others") + 1).alias("n"), "sure").unionByName(more)
        met = every.groupBy("query_id", *SITE).agg(F.bit_and("blocks").alias("blocks"), F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("sure").alias("sure")).where("c = n AND blocks <> 0")
        # A chunk of a sure query has a row at least: no more chunks than rows are opened.
        by_site = Window.partitionBy("query_id").orderBy(*SITE)
        sure = met.where("sure").select("query_id", *SITE, "blocks").withColumn("r", F.row_number().over(by_site)).where(F.col("r") <= limit).drop("r")
        sure, open_ = (_blocks(of.select("query_id", *SITE, "blocks"), index.size) for of in (sure, met.where("NOT sure")))
        keys = ["query_id", "order_", "page_id", "block_seq"]
        entries = index.entries(spark).where(part).select("page_id", "block_seq", "order_", "marked", "squeezed")
        unsure = open_.select(*keys).join(left.select("query_id", "terms"), "query_id")
        read = entries.join(unsure.drop("order_"), ["page_id", "block_seq"]).where(_all_met()).select(*keys)
        # Queries whose terms are nothing that the index lists are tested on all blocks.
        blind = entries.withColumn("of", F.lit("[]")).join(left.where("of = '[]'").select("query_id", "of", "terms"), "of").where(_all_met()).select(*keys)
        found = sure.select(*keys).unionByName(read).unionByName(blind)
        rounds.append(written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit), "answers"))
        low = high
        full = functools.reduce(DataFrame.unionByName, rounds).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
        left = written(left.join(full, "query_id", "left_anti"), "left")
        if left.isEmpty():
            break
    rows = functools.reduce(DataFrame.unionByName, rounds).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return rows.select("query_id", "rank", "order_", "page_id", "block_seq")


def _lists_left(left: DataFrame) -> DataFrame:
    """(of): the lists that queries still need."""
    return left.select(F.explode(F.concat(F.array("of"), F.coalesce("others", F.array().cast("array<string>")))).alias("of")).distinct()


def search_batch(index: Index, queries: DataFrame, limit: int = LIMIT, first: int = FIRST, further: int = FURTHER) -> DataFrame:
    """(query_id, rank, page_id, block_seq): for each of (query_id, query) the rows of `search`."""
    return search_terms(index, queries.select("query_id", parsed("query").alias("terms")), limit, first, further).drop("order_")
