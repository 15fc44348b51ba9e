"""Language identification by hyperdimensional profiles.

A letter is a random vector of signs, drawn by a rule from its code point. Three letters in a row are bound into
one vector: the first one's turned by two places times the second's turned by one times the third's. A text is
the bundle, the sum, of all its three-letter vectors; a language is the bundle of its texts. A text is said to be
of the language whose bundle has the greatest cosine with its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.shared import blocks_of, mixed, written

#: Places of a vector, languages that can be told apart, and what is said of texts without letters.
DIMENSIONS, MOST_LANGUAGES, UNKNOWN = 1024, 8192, "und"
#: Bytes of texts that are counted at once, three-letter vectors that are held at once, and letters up to which triples are numbered by a table.
BLOCK, HELD, TABLED = 1 << 18, 8192, 160


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A vector of signs for each code point; 0, the gap between words, has one too."""
    lanes = np.arange(-(-dimensions // 64), dtype=np.uint64)
    bits = mixed(mixed(points.astype(np.uint64) + np.uint64(1))[:, None] ^ (lanes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    signs = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(len(points), -1), axis=1, bitorder="little")[:, :dimensions]
    return signs.astype(np.int8) * np.int8(2) - np.int8(1)


@functools.lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), bool)


def triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, triples, text of each triple): the different letters of lower-case texts, and the places in them of each three in a row.

    What isn't a letter is a gap, and there is one gap between words and at both ends; a triple has a letter in its
    middle or, if it begins and ends with one, a gap.
    """
    points = np.frombuffer("".join(f" {t.lower()} \0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 0) if not any("\0" in t for t in texts) else np.cumsum([len(t.lower()) + 3 for t in texts]) - 1
    letter = _is_letter()[np.minimum(points, 0x10FFFF)]
    of = np.zeros(len(points), np.int64)
    of[ends[:-1] + 1] = 1
    of = np.cumsum(of)
    kept = letter.copy()
    # The first of each run of gaps stays; a text's end is never kept.
    kept[1:] |= letter[:-1]
    kept[0] = True
    kept[ends[:-1] + 1] = True
    kept[ends] = False
    points, of = np.where(letter, points, 0)[kept], of[kept]
    letters, places = np.unique(points, return_inverse=True)
    rows = np.column_stack([places[:-2], places[1:-1], places[2:]]) if len(places) > 2 else np.zeros((0, 3), np.int64)
    same = of[2:] == of[:-2] if len(places) > 2 else np.zeros(0, bool)
    return letters, rows[same], of[2:][same] if len(places) > 2 else np.zeros(0, np.int64)


def bundles(texts: list[str], groups: np.ndarray, n: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The sum of all three-letter vectors of the texts of each of n groups, as n vectors of integers; groups has each text's."""
    out = np.zeros((n, dimensions))
    letters, rows, of = triples(texts)
    if not len(rows):
        return out.astype(np.int64)
    a = len(letters)
    codes = (rows[:, 0] * a + rows[:, 1]) * a + rows[:, 2]
    if a <= TABLED:
        seen = np.zeros(a**3, bool)
        seen[codes] = True
        different = np.flatnonzero(seen)
        number = np.zeros(a**3, np.int64)
        number[different] = np.arange(len(different))
        number = number[codes]
    else:
        different, number = np.unique(codes, return_inverse=True)
    first, middle, last = different // (a * a), different // a % a, different % a
    signs = letter_vectors(letters, dimensions)
    twice, once = np.roll(signs, 2, axis=1), np.roll(signs, 1, axis=1)
    group = groups[of]
    # Sums below 2^24 are whole numbers in single precision too, in whatever order they are added.
    kind = np.float32 if np.bincount(group, minlength=n).max() < 1 << 24 else np.float64
    for k in range(0, len(different), HELD):
        part = slice(k, k + HELD)
        size = len(different[part])
        within = (number >= k) & (number < k + size) if len(different) > HELD else slice(None)
        counts = np.bincount(group[within] * size + (number[within] - k), minlength=n * size).reshape(n, size)
        bound = twice[first[part]] * once[middle[part]] * signs[last[part]]
        out += counts.astype(kind) @ bound.astype(kind)
    return np.rint(out).astype(np.int64)


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    return blocks_of([t.encode("utf-8", "surrogatepass") for t in texts], BLOCK)


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundle of each language's texts. Null languages and texts teach nothing, and no more do texts without letters.

    Each task sums up its own texts; what is shuffled are its sums, by language and place. At most MOST_LANGUAGES
    languages, whose bundles the driver holds, can be learned; more raise an error.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in _parts(texts):
                names = {name: k for k, name in enumerate(dict.fromkeys(langs[start:end]))}
                told = bundles(texts[start:end], np.array([names[x] for x in langs[start:end]]), len(names), dimensions)
                for name, k in names.items():
                    if told[k].any():
                        known[name] = known[name] + told[k] if name in known else told[k]
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([v.tolist() for v in known.values()], pa.list_(pa.int64()))], ["lang", "sums"])

    usable = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    told = written(usable.mapInArrow(learn, "lang string, sums array<bigint>"), "profiles")
    if told.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums = told.select("lang", F.posexplode("sums").alias("k", "s")).groupBy("lang", "k").agg(F.sum("s").alias("s"))
    rows = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("sums")).orderBy("lang").collect()
    return {r.lang: np.array(r.sums, np.int64) for r in rows}


def predicted(docs: DataFrame, by: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score: the language with the greatest cosine, of equal ones the first by name, and that cosine (0 if it is less).

    UNKNOWN and 0 for null texts, those without letters, and all texts if nothing was learned. Whole texts of any
    length are read. Columns of these names are replaced, all others kept.
    """
    names = [*by, UNKNOWN]
    vectors = np.array(list(by.values()), float).reshape(len(by), -1 if by else 1)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)

    def judge(texts: pa.Array) -> pa.Array:
        said, scores = [], []
        values = [t or "" for t in texts.to_pylist()]
        for start, end in _parts(values) if len(by) else [(0, len(values))]:
            n = end - start
            told = bundles(values[start:end], np.arange(n), n, vectors.shape[1]).astype(float) if len(by) else np.zeros((n, 1))
            norms = np.linalg.norm(told, axis=1)
            cosines = told @ vectors.T / np.where(norms > 0, norms, 1)[:, None] if len(by) else np.zeros((n, 1))
            best = cosines.argmax(axis=1)
            said += np.where(norms > 0, best, len(by)).tolist()
            scores += np.where(norms > 0, np.clip(cosines[np.arange(n), best], 0.0, 1.0), 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array([names[k] for k in said], pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    told = "__told"
    while told in docs.columns:
        told += "_"
    out = docs.withColumn(told, F.arrow_udf(judge, "struct<lang_pred:string,score:double>")(F.col(f"`{text}`")))
    return out.withColumns({"lang_pred": F.col(f"{told}.lang_pred"), "score": F.col(f"{told}.score")}).drop(told)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all documents, learned from those that aren't held out. A null doc_id counts as an empty one: not held out. Repeated rows stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
    by = profiles(docs.where(~held).select("text", "lang"))
    return predicted(docs.select("doc_id", held.alias("held_out"), "text"), by).select("doc_id", "held_out", "lang_pred", "score")
