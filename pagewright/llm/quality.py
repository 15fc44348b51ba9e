"""Quality rules as a ledger of failure bits.

Each text is measured once. Every rule sets one bit where it fails; the ledger keeps measurements and bits,
not verdicts. A policy is a version and a mask of rules, so another policy, or the effect of leaving a rule
out, needs no look at the texts: it is bitwise arithmetic over the ledger.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import tokens
from pagewright.llm.shared import binaries, spread, struct_array, struct_of, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_TYPE = struct_of(",".join(f"{m} long" for m in MEASURES))
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words within windows of `size` words that stand twice or more in the list."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) ** size < 2**62:
        grams = ids[:n].copy()
        for k in range(1, size):
            grams = grams * len(known) + ids[k : k + n]
    else:  # ranks of ever longer runs, exact for any number of different words
        grams, ranks = ids, len(known)
        for k in range(1, size):
            different, grams = np.unique(grams[: len(words) - k] * len(known) + ids[k:], return_inverse=True)
            ranks = len(different)
        if ranks == n:
            return 0
    order = np.argsort(grams, kind="stable")
    equal = grams[order][1:] == grams[order][:-1]
    if not equal.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + size, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """MEASURES of a text; null and empty texts have zeros throughout."""
    text = text or b""
    words = words_of(text)
    joined = b"".join(words)
    seen: set[bytes] = set()
    lines = [line for line in text.split(b"\n") if line.strip()]
    again = 0
    for line in lines:
        again += line in seen
        seen.add(line)
    return (
        len(words),
        len(joined.translate(None, _CONTINUATION)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        again,
        repeated_words(words),
        len(lines),
    )


@F.arrow_udf(_TYPE)
def measured(texts: pa.Array) -> pa.Array:
    tokens.forget()
    return struct_array(_TYPE, [measure(t) for t in binaries(texts)])


#: Name and failure condition by bit, over the measurements of a row. Bits are never given to another rule.
RULES: tuple[tuple[str, Callable[[Callable[[str], Column]], Column]], ...] = (
    ("too_few_words", lambda m: m("n_words") < 10),
    ("repeated_phrases", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    ("symbols", lambda m: 100 * m("n_symbols") > 5 * m("word_chars")),
    ("repeated_lines", lambda m: 100 * m("n_dup_lines") > 40 * m("n_lines")),
    ("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    ("long_words", lambda m: m("word_chars") > 20 * m("n_words")),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_phrases"))
FULL = Policy("full-1", tuple(name for name, _ in RULES))


def failed_bits(m: Callable[[str], Column] = F.col) -> Column:
    """A bit for each rule that fails, over measurements by name."""
    bits = (F.when(failure(m), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, failure) in enumerate(RULES))
    return functools.reduce(Column.bitwiseOR, bits)


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, MEASURES..., failed_bits): a row for each row of docs, whatever its doc_id.

    A null or empty text measures zero and so has too few words; a very long one is measured whole. Repeated
    rows have a row each; an empty table has an empty ledger. Other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), measured(F.col(text)).alias("m"))
    return rows.select("doc_id", *(F.col(f"m.{m}").alias(m) for m in MEASURES)).select("*", failed_bits().alias("failed_bits"))


def judged(of: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the policy's version and verdict."""
    return of.withColumns({"policy": F.lit(policy.version), "kept": kept(F.col("failed_bits"), policy)})


def kept(bits: Column, policy: Policy) -> Column:
    """Whether a policy keeps a row with these failure bits."""
    return bits.bitwiseAND(F.lit(policy.mask)) == 0


def ablations(of: DataFrame, policy: Policy) -> DataFrame:
    """(rule, n_failed, n_only, n_kept, n_kept_without): what each rule of the policy does, and alone does.

    Rows are first counted by failure bits, of which there are at most 2 to the number of rules. An empty ledger
    has no rows here either.
    """
    masked = F.col("failed_bits").bitwiseAND(F.lit(policy.mask))
    counts = of.groupBy(masked.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(Policy("", (r,)).mask).cast("long").alias("bit")) for r in policy.rules))
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    n = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    bits, bit = F.col("bits"), F.col("bit")
    return each.groupBy("rule").agg(
        n(bits.bitwiseAND(bit) != 0).alias("n_failed"),
        n(bits == bit).alias("n_only"),
        n(bits == 0).alias("n_kept"),
        n((bits == 0) | (bits == bit)).alias("n_kept_without"),
    )


def passing(docs: DataFrame, policy: Policy = FULL, text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps by their failure bits, all their columns unchanged.

    Null and empty texts have too few words, very long ones are measured whole, repeated rows stay or go
    together. Columns of any name come along. An empty table stays empty.
    """
    m, bits = "_measures", "_failed_bits"
    while m in docs.columns or bits in docs.columns:
        m, bits = m + "_", bits + "_"
    rows = docs.withColumn(m, measured(F.col(f"`{text}`"))).withColumn(bits, failed_bits(lambda name: F.col(f"`{m}`.{name}")))
    return rows.where(kept(F.col(f"`{bits}`"), policy)).drop(m, bits)


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the full policy does to all documents, and what leaving it out would do."""
    return ablations(ledger(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))), FULL)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the full policy."""
    rows = judged(ledger(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))), FULL)
    base = F.col("failed_bits").bitwiseAND(F.lit(BASE.mask)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits", "policy")


_LEDGER = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT k, i, list_slice(ws, i, i + 4) AS gram FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
c AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT k, count(DISTINCT i + j) AS n FROM c, unnest(range(0, 5)) AS u(j) GROUP BY k),
l AS (SELECT k, line, count(*) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k, line),
lines AS (SELECT k, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM l GROUP BY k),
m AS (
  SELECT w.k, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN rep USING (k) LEFT JOIN lines USING (k)
), b AS (
  SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 5 * word_chars)::BIGINT
    + 8 * (100 * n_dup_lines > 40 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT)::BIGINT AS failed_bits
  FROM m
)
"""

ORACLE = _LEDGER + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept,
       failed_bits, 'full-1' AS policy
FROM b
"""

#: The rules' names stand in the order of their bits.
ABLATIONS_ORACLE = _LEDGER + """
SELECT rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits = bit) AS n_only,
       count(*) FILTER (failed_bits = 0) AS n_kept, count(*) FILTER (failed_bits & ~bit = 0) AS n_kept_without
FROM b, (VALUES ('too_few_words', 1::BIGINT), ('repeated_phrases', 2::BIGINT), ('symbols', 4::BIGINT), ('repeated_lines', 8::BIGINT), ('short_words', 16::BIGINT), ('long_words', 32::BIGINT)) AS r(rule, bit)
GROUP BY rule
"""
