"""Hard negatives by inner product: length buckets with sorted coordinate lists, as in LEMP, and exact scores.

Every task packs its rows into blocks, the longest vectors first; a block's rows are cut into buckets of nearly
one length. Anchors, a stated hundredth of all rows, meet every block, in blocks of their own. In a bucket an
anchor needs scores of at least some threshold; its length and the bucket's make that a least cosine, and a cosine
leaves each coordinate a range. The ranges of the anchor's largest coordinates, its focus, are cut out of the
bucket's sorted lists; what stands in all of them is scored in integers. Blocks answer with their few best rows for
each anchor, which are merged.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.shared import written

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Scores of negatives, in hundredths of the positive's: from, to.
FROM, TO = 80, 100
#: Rows to a block, to a bucket and anchors to a block; coordinates in focus.
ROWS, BUCKET, ANCHORS, FOCUS = 8192, 1024, 1024, 3
#: Fewest tasks that anchors are dealt to, and the largest integer that a component may become.
DEALT, LARGEST = 6, 1 << 40


def integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, x, length): the usable vectors of the first usable one's length, as integers; larger components than LARGEST become it."""
    sizes = pc.list_value_length(vectors)
    length = max((n for n in pc.unique(sizes).to_pylist() if n), default=0)
    rows = np.flatnonzero(pc.fill_null(pc.equal(sizes, length), False).to_numpy(zero_copy_only=False)) if length else np.zeros(0, np.int64)
    values = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), length)
    finite = np.isfinite(values).all(axis=1)
    return rows[finite], np.clip(np.floor(values[finite] * SCALE), -LARGEST, LARGEST).astype(np.int64), length


@dataclass
class Bucket:
    """Rows of nearly one length: ids, labels, integers, lengths, directions; and lists of rows by coordinate, sorted when first asked for."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    lengths: np.ndarray
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @functools.cached_property
    def directions(self) -> np.ndarray:
        return self.x / np.where(self.lengths > 0, self.lengths, 1)[:, None]

    @functools.cached_property
    def exact(self) -> Callable[[np.ndarray], np.ndarray]:
        """Scores of all rows: in double precision where all sums are whole numbers below 2^53, else in integers of any size."""
        most = float(np.abs(self.x).max(initial=0)) * self.x.shape[1]
        as_floats = self.x.astype(float)

        def scores(q: np.ndarray) -> np.ndarray:
            if most * float(np.abs(q).max(initial=0)) < 1 << 53:
                return (as_floats @ q.astype(float)).astype(np.int64)
            return np.clip(self.x.astype(object) @ q.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)

        return scores

    def sorted_list(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.lists:
            order = np.argsort(self.directions[:, k], kind="stable")
            self.lists[k] = order, self.directions[order, k]
        return self.lists[k]

    def candidates(self, q: np.ndarray, length: float, least: float, focus: int = FOCUS) -> np.ndarray | None:
        """Which rows may have a score of at least `least`; None: all. A little more than the bounds is taken, for rounding."""
        reach = length * float(self.lengths[0])  # the longest stands first
        if reach * (1 + 1e-9) < least:
            return np.zeros(0, np.int64)
        cosine = least / reach if reach else 0.0
        if cosine <= 0:
            return None
        turn = np.arccos(min(1.0, cosine))
        inside = None
        for k in np.argsort(-np.abs(q), kind="stable")[:focus]:
            order, values = self.sorted_list(int(k))
            at = np.arccos(np.clip(q[k] / length, -1.0, 1.0))
            low, high = np.cos(min(np.pi, at + turn)) - 1e-9, np.cos(max(0.0, at - turn)) + 1e-9
            here = order[np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]
            if inside is None:
                inside = np.zeros(len(self.ids), bool)
                inside[here] = True
            else:
                also = np.zeros(len(self.ids), bool)
                also[here] = True
                inside &= also
        return np.flatnonzero(inside)


def buckets(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, size: int = BUCKET) -> list[Bucket]:
    """The rows by falling length, cut into buckets; a bucket ends early where rows are a tenth shorter than its first."""
    lengths = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    out, start = [], 0
    while start < len(order):
        least = lengths[order[start]] * 0.9
        end = start + int(np.searchsorted(-lengths[order[start : start + size]], -least, "right"))
        part = order[start : max(end, start + 1)]
        out.append(Bucket(ids[part], labels[part], x[part], lengths[part]))
        start += len(part)
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: greater scores, then smaller ids."""
    if len(ids) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = np.flatnonzero(scores >= kth)
    else:
        few = np.arange(len(ids))
    return few[np.lexsort((ids[few], -scores[few]))[:k]]


class Best:
    """The k best rows so far among those with scores from `low` to `high`, and the score that a further one must have."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        """Rows of just this score may still come, with smaller ids."""
        floor = -np.inf if self.low is None else self.low
        return max(floor, self.scores[-1]) if len(self.scores) == self.k else floor

    def put(self, ids: np.ndarray, scores: np.ndarray) -> None:
        wanted = scores >= self.least
        if self.high is not None:
            wanted &= scores <= self.high
        if wanted.any():
            ids, scores = np.concatenate([self.ids, ids[wanted]]), np.concatenate([self.scores, scores[wanted]])
            chosen = best(ids, scores, self.k)
            self.ids, self.scores = ids[chosen], scores[chosen]


def search(of: list[Bucket], q: np.ndarray, wanted: Callable[[Bucket], np.ndarray], lists: list[Best]) -> None:
    """Fill the lists from the buckets' rows that `wanted` allows. The threshold is what any list still lacks, and rises on the way."""
    length = float(np.sqrt((q.astype(float) ** 2).sum()))
    for bucket in of:
        least = min(one.least for one in lists)
        found = bucket.candidates(q, length, least)
        if found is not None and not len(found):
            continue
        scores = bucket.exact(q)
        rows = np.flatnonzero(wanted(bucket)) if found is None else found[wanted(bucket)[found]]
        for one in lists:
            one.put(bucket.ids[rows], scores[rows])


def _packed(batch: tuple[list, list, list], length: int, number: int) -> tuple:
    ids, labels, x = (np.concatenate(p) for p in batch)
    x = x.astype(next(kind for kind in (np.int16, np.int32, np.int64) if np.abs(x).max() <= np.iinfo(kind).max))
    return number, len(ids), length, ids.tobytes(), labels.tobytes(), x.tobytes()


_BLOCK = "number long, n int, length int, ids binary, labels binary, x binary"
_BLOCK_ARROW = pa.schema([("number", pa.int64()), ("n", pa.int32()), ("length", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary())])


def _unpacked(row: dict, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape = row[f"{name}_n"], row[f"{name}_length"]
    x = np.frombuffer(row[f"{name}_x"], f"i{len(row[f'{name}_x']) // (shape[0] * shape[1])}").reshape(shape).astype(np.int64)
    return np.frombuffer(row[f"{name}_ids"], np.int64), np.frombuffer(row[f"{name}_labels"], np.int64), x


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(number, n, length, ids, labels, x): the rows (id, label, vector) of each task, packed by vector length; written, so that numbers stay."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 32

        def block(length: int) -> pa.RecordBatch:
            nonlocal number
            row = _packed(tuple(zip(*held.pop(length))), length, number)
            number += 1
            return pa.RecordBatch.from_pylist([dict(zip(_BLOCK_ARROW.names, row))], _BLOCK_ARROW)

        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                for n in [n for n in pc.unique(pc.list_value_length(part.column(2))).to_pylist() if n]:
                    some = part.filter(pc.fill_null(pc.equal(pc.list_value_length(part.column(2)), n), False))
                    kept, x, _ = integers(some.column(2))
                    if len(kept):
                        held.setdefault(n, []).append((some.column(0).to_numpy()[kept], some.column(1).to_numpy()[kept], x))
                        if sum(len(p[0]) for p in held[n]) >= size:
                            yield block(n)
        for n in list(held):
            yield block(n)

    return written(rows.mapInArrow(pack, _BLOCK), "blocks")


def _met(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Each block of anchors beside each block of rows with vectors of its length, every pair a key of its own, so that no key holds more than a pair.

    The anchors are stated queries; blocks, not rows, are paired.
    """
    names = ["n", "length", "ids", "labels", "x"]
    numbers = lambda of: of.select("length", "number")
    pairs = numbers(anchors).withColumnRenamed("number", "a").join(numbers(rows).withColumnRenamed("number", "r"), "length").select("a", "r")
    left = anchors.select(F.col("number").alias("a"), *(F.col(c).alias(f"a_{c}") for c in [*names, *(c for c in anchors.columns if c not in names and c != "number")]))
    right = rows.select(F.col("number").alias("r"), *(F.col(c).alias(f"r_{c}") for c in names))
    return pairs.join(left, "a").join(right, "r")


_FOUND = "number long, at int, other int, id long, score long"
_FOUND_ARROW = pa.schema([("number", pa.int64()), ("at", pa.int32()), ("other", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[Bucket], tuple]]:
    """Pairs of blocks one by one; a block of rows that comes again at once is not cut again."""
    last, cut = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["r"] != last:
                last, cut = row["r"], buckets(*_unpacked(row, "r"))
            yield row, cut, _unpacked(row, "a")


def _found(number: int, told: list[tuple[int, int, Best]]) -> pa.RecordBatch:
    sizes = [len(b.ids) for *_, b in told]
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(sum(sizes), number)), pa.array(np.repeat([a for a, *_ in told], sizes).astype(np.int32)), pa.array(np.repeat([o for _, o, _ in told], sizes).astype(np.int32)),
            pa.array(join([b.ids for *_, b in told])), pa.array(join([b.scores for *_, b in told])),
        ],
        schema=_FOUND_ARROW,
    )


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each key over all blocks, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = FROM, high: int = TO) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of all anchors.

    rows: (id long, label int, vector). A row's score is its integer inner product with the anchor; of equal scores
    the smaller id comes first. An anchor's positives are its `positives` best other rows of its label; the negatives
    of each are the `negatives` best rows of other labels whose scores are low to high hundredths of the
    positive's. Rows without id, label or a usable vector take no part. Anchors meet rows with vectors of their
    length only. Rows that repeat count as often as they stand there, an anchor's too; rows with an anchor's own
    id are not other rows. No anchors or no rows: no result. A score beyond a long is the largest (least) long.
    """
    spark = rows.sparkSession
    usable = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select("id", F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    every = blocks(usable, ROWS)
    stated = usable.where(is_anchor)
    n = stated.count()
    asked = blocks(stated.repartition(max(DEALT, -(-n // ANCHORS))), ANCHORS)

    def best_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, cut, (ids, labels, x) in _pairs(batches):
            told = []
            for at in range(len(ids)):
                told.append((at, 0, Best(positives)))
                search(cut, x[at], lambda b: (b.labels == labels[at]) & (b.ids != ids[at]), [told[-1][2]])
            yield _found(row["a"], told)

    near = written(_ranked(_met(asked, every).mapInArrow(best_positives, _FOUND), ["number", "at"], positives).select("number", "at", "rank", "id", "score"), "positives")
    # Each block of anchors with its positives' scores: a bounded list, by place in the block.
    lists = near.groupBy("number").agg(F.collect_list(F.struct("at", "rank", "score")).alias("near"))

    def best_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, cut, (_, labels, x) in _pairs(batches):
            told, of = [], {}
            for p in row["a_near"]:
                # Scores below 0 have no range: 80 hundredths of them are more than all.
                if p["score"] >= 0:
                    one = Best(negatives, -(-low * p["score"] // 100), high * p["score"] // 100)
                    told.append((p["at"], p["rank"], one))
                    of.setdefault(p["at"], []).append(one)
            for at, wanted in of.items():
                search(cut, x[at], lambda b: b.labels != labels[at], wanted)
            yield _found(row["a"], told)

    hard = _ranked(_met(asked.join(lists, "number"), every).mapInArrow(best_negatives, _FOUND), ["number", "at", "other"], negatives)
    hard = hard.select("number", "at", F.col("other"), F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    met = hard.join(near.select("number", "at", F.col("rank").alias("other"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["number", "at", "other"])
    names = asked.select("number", "n", F.expr("ids")).mapInArrow(_named, "number long, at int, anchor_id long")
    return met.join(names, ["number", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.frombuffer(ids, np.int64))], ["number", "at", "anchor_id"])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the rows of embeddings whose vec_id is divisible by 100, against all rows; labels of rows divisible by 7 are moved on by one first."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = df.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, F.col("id") % 100 == 0)


ORACLE = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, p.id, a.label = p.label AS same, list_sum([a.v[i] * p.v[i] FOR i IN range(1, len(a.v) + 1)])::BIGINT AS score FROM r a JOIN r p ON a.id % 100 = 0 AND a.id <> p.id AND len(a.v) = len(p.v)),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
neg AS (SELECT pos.anchor_id, pos.id AS positive_id, (row_number() OVER (PARTITION BY pos.anchor_id, pos.id ORDER BY s.score DESC, s.id))::INTEGER AS rank, s.id AS negative_id, pos.score AS positive_score, s.score AS negative_score
        FROM pos JOIN s ON pos.anchor_id = s.anchor_id AND NOT s.same AND 80 * pos.score <= 100 * s.score AND 100 * s.score <= 100 * pos.score)
SELECT * FROM neg WHERE rank <= 5
"""
