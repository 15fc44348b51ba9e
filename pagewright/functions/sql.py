"""The library's functions as columns and for SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import formulas, query
from pagewright.functions.fold import fold as fold_of
from pagewright.sources.html import page_blocks


@F.arrow_udf(T.StringType())
def fold(texts: pa.Array) -> pa.Array:
    """The fold of each text; null of null."""
    return pa.array([None if t is None else fold_of(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def vocabulary(texts: pa.Array) -> pa.Array:
    """What an index lists of each text, sorted; null of null."""
    return pa.array([None if t is None else sorted(formulas.vocabulary(formulas.record(t))) for t in texts.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.BooleanType())
def answers(texts: pa.Array, queries: pa.Array) -> pa.Array:
    """Whether each text answers the query beside it; null if either is null."""
    rows = zip(texts.to_pylist(), queries.to_pylist())
    return pa.array([None if t is None or q is None else query.answers(t, q) for t, q in rows], pa.bool_())


def answering(text: Column, q: str) -> Column:
    """Whether texts answer one query. Searches over stored entries are far cheaper."""
    return answers(text, F.lit(q))


def _fields(*named: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in named])


_TEXT = T.StringType()


@F.arrow_udf(_fields(("fold", _TEXT), ("squeezed", _TEXT)))
def record(texts: pa.Array) -> pa.Array:
    """What an index stores of each text: its fold and its formulas squeezed; null of null."""
    return formulas.records(texts)


@F.udtf(returnType=_fields(("block_seq", T.IntegerType()), ("anchor", _TEXT), ("heading", _TEXT), ("text", _TEXT)))
class HtmlBlocks:
    """The blocks of a page of HTML, none of null."""

    def eval(self, html: str):
        yield from page_blocks(html)


@F.udtf(returnType=_fields(("pos", T.IntegerType()), ("word", _TEXT), ("formula", T.BooleanType()), ("needles", T.ArrayType(_TEXT))))
class QueryTerms:
    """A query's terms in order, with the spellings that each may have; none of null, nor of what isn't a query."""

    def eval(self, q: str):
        if q is not None and query.asks(q):
            for pos, term in enumerate(query.parse(q)):
                yield pos, term.word, term.formula, list(term.needles)


def register(spark: SparkSession) -> None:
    """For SQL: fold(text), vocabulary(text), answers(text, query), record(text), parse_query(query), and the table functions html_blocks(html) and query_terms(query)."""
    for name, f in (("fold", fold), ("vocabulary", vocabulary), ("answers", answers), ("record", record), ("parse_query", query.parsed)):
        spark.udf.register(name, f)
    for name, t in (("html_blocks", HtmlBlocks), ("query_terms", QueryTerms)):
        spark.udtf.register(name, t)
