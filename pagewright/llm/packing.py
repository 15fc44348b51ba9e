"""Packing documents into sequences: bin completion with branch and bound, best fit as incumbent."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.shared import binaries, grouped, spread, written
from pagewright.llm.tokens import encoder, tokenizer_path

CAPACITY = 4096
#: Pieces that are packed together, and sequences of each such lot that are tried again with those of others.
LOT, AGAIN = 4096, 16


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: the longest first, each where it leaves the least room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = bisect.bisect_left(rooms, (lengths[i], -1))
        if k == len(rooms):
            bins.append([i])
            bisect.insort(rooms, (capacity - lengths[i], len(bins) - 1))
        else:
            room, b = rooms.pop(k)
            bins[b].append(i)
            bisect.insort(rooms, (room - lengths[i], b))
    return bins


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's items can be dealt into a's, each group within one item (both in descending order)."""
    if not b:
        return True
    if sum(b) > sum(a) or not a or b[0] > a[0]:
        return False
    # An item may as well stand in one of its own size: whatever else is there then stands where the item stood.
    rooms, rest = list(a), []
    for s in b:
        if s in rooms:
            rooms.remove(s)
        else:
            rest.append(s)
    return _dealt(rooms, rest, 0)


def _dealt(rooms: list[int], items: list[int], k: int) -> bool:
    if k == len(items):
        return True
    s, seen = items[k], set()
    for n, room in enumerate(rooms):
        if room >= s and room not in seen:
            seen.add(room)
            rooms[n] = room - s
            whole = _dealt(rooms, items, k + 1)
            rooms[n] = room
            if whole:
                return True
    return False


@dataclass(frozen=True)
class Bounds:
    """What the search may do in a lot. No bound leaves a piece out; each may cost sequences, which `proved` then tells."""

    #: Maximal fillings of a bin that are looked for, steps for each of them, and undominated ones that are tried.
    fillings: int = 48
    steps: int = 20
    tried: int = 12
    #: Bins that are completed in all: so many, or so many for each bin of the incumbent.
    nodes: int = 3000
    nodes_a_bin: int = 4


def fillings(counts: Counter, room: int, waste: int, bounds: Bounds = Bounds()) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated ways to fill room from counts leaving at most `waste`, the fullest first; and whether these are all."""
    return _fillings(counts, sorted(s for s in counts if counts[s] > 0), room, waste, bounds)


def _fillings(counts: Counter, present: list[int], room: int, waste: int, bounds: Bounds) -> tuple[list[tuple[int, ...]], bool]:
    """fillings from counts whose sizes above 0 are `present`, in ascending order."""
    fitting = bisect.bisect_right(present, room)
    smallest = present[0] if fitting else room + 1
    found: list[tuple[int, ...]] = []
    steps = bounds.steps * bounds.fillings

    def search(k: int, left: int, chosen: tuple[int, ...]) -> None:
        # Sizes from the k-th downwards are tried; those above what is left are passed over at once.
        nonlocal steps
        steps -= 1
        if len(found) >= bounds.fillings or steps < 0:
            return
        if left < smallest:
            if left <= waste:
                found.append(chosen)
            return
        maximal = True
        for k in range(bisect.bisect_right(present, left, 0, k), 0, -1):
            s = present[k - 1]
            if chosen.count(s) < counts[s]:
                maximal = False
                search(k, left - s, (*chosen, s))
                if len(found) >= bounds.fillings or steps < 0:
                    return
        if maximal and left <= waste:
            found.append(chosen)

    search(fitting, room, ())
    whole = len(found) < bounds.fillings and steps >= 0
    found = sorted(set(found), key=lambda f: (room - sum(f), len(f), f))
    if found and sum(found[0]) == room and len(found[0]) <= 1:
        found = found[:1]  # one item that fills the room dominates whatever else would
    sums = [*map(sum, found)]
    free = [f for k, f in enumerate(found) if not any(f != g and sums[n] >= sums[k] and g[:1] >= f[:1] and dominates(g, f) and not (dominates(f, g) and n > k) for n, g in enumerate(found))]
    return free[: bounds.tried], whole and len(free) <= bounds.tried


def completed(lengths: list[int], capacity: int, bounds: Bounds = Bounds()) -> tuple[list[list[int]], bool]:
    """Bins of indices, never more than best fit gives, and whether it is proved that fewer are impossible.

    Bins are completed around the largest item left. A branch ends where the waste of its bins is more than
    one bin fewer than the incumbent allows; if there is no such waste, best fit is optimal at once.
    """
    incumbent = best_fit(lengths, capacity)
    total, proved = sum(lengths), True
    floor = -(-total // capacity)
    nodes = max(bounds.nodes, bounds.nodes_a_bin * len(incumbent))
    while len(incumbent) > floor:
        allowed = (len(incumbent) - 1) * capacity - total
        counts = Counter(lengths)
        present = sorted(counts)

        def taken(way: tuple[int, ...]) -> None:
            for s in way:
                counts[s] -= 1
                if not counts[s]:
                    del present[bisect.bisect_left(present, s)]

        def put_back(way: tuple[int, ...]) -> None:
            for s in way:
                if not counts[s]:
                    bisect.insort(present, s)
                counts[s] += 1

        path: list[tuple[int, ...]] = []
        stack: list[Iterator[tuple[int, ...]]] = []
        wasted, better, all_seen = [0], False, True

        def options() -> Iterator[tuple[int, ...]]:
            nonlocal all_seen
            top = present[-1]
            taken((top,))
            ways, whole = _fillings(counts, present, capacity - top, allowed - wasted[-1], bounds)
            all_seen &= whole
            put_back((top,))
            return iter([(top, *w) for w in ways])

        stack.append(options())
        while stack and nodes > 0:
            way = next(stack[-1], None)
            if way is None:
                stack.pop()
                if path:
                    put_back(path.pop())
                    wasted.pop()
                continue
            nodes -= 1
            taken(way)
            path.append(way)
            wasted.append(wasted[-1] + capacity - sum(way))
            if not present:
                better = True
                break
            stack.append(options())
        if not better:
            proved = all_seen and not stack
            break
        by_length: dict[int, list[int]] = {}
        for i, length in enumerate(lengths):
            by_length.setdefault(length, []).append(i)
        incumbent = [[by_length[s].pop() for s in way] for way in path]
    return incumbent, proved


def complete_bins(lengths: list[int], capacity: int, bounds: Bounds = Bounds()) -> list[list[int]]:
    return completed(lengths, capacity, bounds)[0]


def _pieces(path: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        of = encoder(path)
        for batch in batches:
            texts, doc_ids = binaries(batch.column("text")), batch.column("doc_id").to_pylist()
            for k in range(0, len(texts), 256):
                rows = []
                for doc_id, data in zip(doc_ids[k : k + 256], of.encode(texts[k : k + 256])):
                    data += end
                    for n, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each row's ids and end_id, cut only if longer than capacity.

    A null or empty text is one piece of the end id, a very long one has as many as it needs. Repeated rows have
    their pieces each; other columns are left out; an empty table gives none.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _packed(capacity: int, level: int, final: bool, bounds: Bounds):
    def run(batches):
        for lot in grouped(batches, ["lot"]):
            lot = lot.combine_chunks().sort_by("rid")
            lengths = lot.column("length").to_pylist()
            bins, proved = completed(lengths, capacity, bounds)
            bins.sort(key=lambda b: -sum(lengths[i] for i in b))
            number = (level << 56) | lot.column("lot")[0].as_py() << 20
            sequence, offset, done = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
            for k, b in enumerate(bins):
                at = 0
                for i in b:
                    sequence[i], offset[i] = number + k, at
                    done[i] = final or k < len(bins) - AGAIN
                    at += lengths[i]
            yield from pa.table({"rid": lot.column("rid"), "length": lot.column("length"), "sequence_id": sequence, "offset": offset, "done": done, "proved": np.full(len(lengths), proved)}).to_batches()

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, bounds: Bounds = Bounds()) -> DataFrame:
    """The pieces with sequence_id, offset and proved: sequences of at most capacity, without gaps.

    proved tells whether its lot's pieces can't be in fewer sequences, or a bound ended the search for them.
    Ties go by the pieces' order; repeated pieces have a place each; other columns come along.

    Pieces are dealt at random into lots of some LOT pieces, packed by a task each. The AGAIN emptiest
    sequences of every lot are dealt anew and packed together, until one lot is left; a level has a small
    part of the pieces of the one before, or is the last. An empty table gives none.
    """
    cut = written(cut.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    left, level, placed, before = cut.select("rid", "length"), 0, [], None
    n = left.count()
    while True:
        lots = max(1, -(-n // LOT))
        dealt = left.withColumn("lot", F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(lots)))
        last = lots == 1 or before is not None and n > before // 2
        run = _packed(capacity, level, last, bounds)
        done = written(dealt.repartition(min(lots, 100_000), "lot").sortWithinPartitions("lot").mapInArrow(run, "rid long, length long, sequence_id long, offset long, done boolean, proved boolean"), "packed")
        placed.append(done.where("done").select("rid", "sequence_id", "offset", "proved"))
        if last:
            break
        before, left, level = n, done.where("NOT done").select("rid", "length"), level + 1
        n = left.count()
    rows = placed[0]
    for more in placed[1:]:
        rows = rows.unionAll(more)
    return cut.join(rows, "rid").drop("rid")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(spread(docs), tokenizer_path(), end_id=1))
