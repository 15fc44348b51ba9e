"""Near-duplicate documents: an LSH forest for candidates, whole shingle sets for links.

1. A document's set is that of its hashed word shingles. Documents with equal sets are one class, linked by
   that; only its representative (the smallest doc_id) goes on.
2. Signatures of PERMUTATIONS minima, and an LSH forest of TREES sorted orders: each tree sorts by the signature in
   a permutation of its own. Documents with equal first DEPTH values are in one region of a tree. In a region
   of up to SMALL all are neighbours of all. A larger one is split by further minima, the more the more crowded
   it is, and read in sorted order, where those with the longest common prefix stand side by side: each document
   proposes the next one on either side whose signature agrees, past up to REACH - 1 that don't.
3. Documents whose signatures agree in at least half the places form clusters. What sorting or splitting has kept apart
   in a region meets after that: all documents but those of its largest cluster meet all of the region, pairs of blocks to
   a task. So all documents of a region have met, directly or in a cluster. Documents that are similar enough share a region
   in some tree up to a chance of 1e-8 (similarity 0.85; 1e-5 at 0.8), so linked documents are in one cluster.
4. Each document's NEAREST neighbours by signature are tried on whole sets first, and what is linked becomes one. Within a cluster then
   all sets meet but those of its largest part among themselves. Large clusters are dealt into blocks, and pairs
   of blocks to tasks, so that a task holds two blocks at most; links come back as a spanning forest. A set is
   computed once.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm import tokens
from pagewright.llm.graph import components
from pagewright.llm.shared import WordHashes, binaries, grouped, mixed, partitions_for, spread, windows_of, words_of, written

PERMUTATIONS, TREES, DEPTH = 128, 40, 5
#: Documents of a region that are named in pairs, and those from which it is split; also those in a block.
SMALL, CROWD = 8, 2048
#: How far neighbours are looked for in a sorted order, and how many of a document's are tried on whole sets at first.
REACH, NEAREST = 16, 3
#: Documents, and shingles of all of them, in a block.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Pairs with one document in common that are tried together.
TRIED = 512
#: Tasks that the documents of one cluster are dealt to, where each learns of the cluster's blocks.
SALTS = 32
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text: bytes | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words, A-Z lower-cased; of all words if they are fewer."""
    words = words_of(text.translate(_LOWER)) if text else []
    of = hashes.of(words)
    return np.unique(windows_of(of, min(size, len(words)))) if words else np.zeros(0, np.uint64)


def set_class(of: np.ndarray) -> bytes | None:
    return hashlib.blake2b(of.tobytes(), digest_size=16).digest() if len(of) else None


@functools.lru_cache(1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    a = rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
    orders = np.array([rng.permutation(PERMUTATIONS) for _ in range(TREES)])
    return a, b, orders


def signatures(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of PERMUTATIONS hash functions over each set; none may be empty."""
    out = np.empty((len(sets), PERMUTATIONS), np.uint32)
    first = 0
    while first < len(sets):
        last, total = first + 1, len(sets[first])
        while last < len(sets) and total + len(sets[last]) <= 40_000:
            total += len(sets[last])
            last += 1
        items = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *map(len, sets[first : last - 1])])
        for k in range(PERMUTATIONS):
            out[first:last, k] = np.minimum.reduceat(((items * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
        first = last
    return out


def _signed(size: int):
    def run(batches):
        tokens.forget()
        hashes, (a, b, orders) = WordHashes(), _constants()
        salts = mixed(np.arange(1, TREES + 1, dtype=np.uint64))
        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id")
            for k in range(0, len(texts), 256):
                sets = [shingle_set(t, size, hashes) for t in binaries(texts.slice(k, 256))]
                full = [i for i, s in enumerate(sets) if len(s)]
                signed: list[bytes | None] = [None] * len(sets)
                trees: list[np.ndarray | None] = [None] * len(sets)
                if full:
                    of = signatures([sets[i] for i in full], a, b)
                    low = of.astype(np.uint8)
                    region = np.broadcast_to(salts, (len(full), TREES)).copy()
                    for d in range(DEPTH):
                        region = mixed(region * np.uint64(0x9E3779B97F4A7C15) + of[:, orders[:, d]])
                    for n, i in enumerate(full):
                        signed[i], trees[i] = low[n].tobytes(), region[n].view(np.int64)
                offsets = np.cumsum([0, *(TREES if t is not None else 0 for t in trees)])
                held = [t for t in trees if t is not None]
                values = pa.array(np.concatenate(held) if held else np.zeros(0, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(k, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_class(s) for s in sets], pa.binary()),
                        pa.array(signed, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                    ],
                    names=["doc_id", "n_shingles", "class", "signature", "trees"],
                )

    return run


def _equal_places(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places signatures (rows of bytes) are equal."""
    # Eight places to a word, up to 16 in each byte; the product adds its bytes up.
    return ((x == y).view(np.uint64).sum(axis=1) * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int32)


def _rows(array: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(array.to_pylist()), np.uint8).reshape(-1, PERMUTATIONS)


def _agreeing(batches):
    """(a, b, same): of rows (a, b, sa, sb) those whose signatures agree in at least half the places, and their equal places.

    Told and chosen in one go: a function whose result is filtered is run for the filter and again for the column, each time
    by a Python worker of its own.
    """
    for batch in batches:
        same = _equal_places(_rows(batch.column("sa")), _rows(batch.column("sb")))
        found = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.int32())], names=["a", "b", "same"])
        yield found.filter(pa.array(same * 2 >= PERMUTATIONS))


def _ordered(tree: pa.Array, signature: pa.Array) -> pa.Array:
    """Signatures in the order of a tree."""
    orders = _constants()[2]
    of = np.take_along_axis(_rows(signature), orders[tree.to_numpy()], axis=1)
    return pa.array([row.tobytes() for row in of], pa.binary())


def neighbours(regions: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, equal places): for each row of a sorted order the next one on either side that agrees, within REACH and its region."""
    n = len(regions)
    right, left, out = np.ones(n, bool), np.ones(n, bool), []
    for step in range(1, min(REACH, n - 1) + 1):
        wanted = np.flatnonzero((regions[:-step] == regions[step:]) & (right[:-step] | left[step:]))
        same = _equal_places(orders[wanted], orders[wanted + step])
        near = same * 2 >= PERMUTATIONS
        found = wanted[near]
        right[found] = left[found + step] = False
        out.append((found, found + step, same[near]))
    i, j, same = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return i, j, same


def _neighbours(batches):
    """Links of neighbours from rows sorted by (region, order); the last rows of a batch are seen again with the next."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        regions, nodes, orders = batch.column("region").to_numpy(), batch.column("node").to_numpy(), _rows(batch.column("order"))
        if held is not None:
            regions, nodes, orders = (np.concatenate(x) for x in zip(held, (regions, nodes, orders)))
        i, j, same = neighbours(regions, orders)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i], pa.int64()), pa.array(nodes[j], pa.int64()), pa.array(same, pa.int32())], names=["a", "b", "same"])
        held = regions[-REACH:], nodes[-REACH:], orders[-REACH:]


def meeting(signed: np.ndarray, main: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of signatures (rows of bytes) that agree in at least half the places.

    Rows of `main` are known to belong together: none of them is compared with another.
    """
    main = np.zeros(len(signed), bool) if main is None else main
    left, rows, fixed, out = np.flatnonzero(~main), signed[~main], signed[main], []
    names = np.flatnonzero(main)
    while len(left):
        rest, left, rows = [int(left[0])], left[1:], rows[1:]
        reached = not len(names)
        while rest and (len(left) or not reached):
            x = rest.pop()
            if not reached:
                near = np.flatnonzero(_equal_places(fixed, signed[x]) * 2 >= PERMUTATIONS)
                if reached := bool(len(near)):
                    out.append((x, int(names[near[0]])))
            near = _equal_places(rows, signed[x]) * 2 >= PERMUTATIONS
            if near.any():
                rest += left[near].tolist()
                out += [(x, y) for y in left[near].tolist()]
                left, rows = left[~near], rows[~near]
    return out


def _met(batches):
    for group in grouped(batches, ["cluster", "pair"]):
        group = group.combine_chunks()
        nodes = group.column("node").to_numpy()
        found = meeting(_rows(group.column("signature")), group.column("main").to_numpy())
        if found:
            i, j = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i], pa.int64()), pa.array(nodes[j], pa.int64())], names=["a", "b"])


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b, same): links that join all nodes that share a region and agree, from (class, node, signature, trees), and their equal places."""
    # A class by its hash: a node stands for several only if its doc_id has several texts; then any agreement counts.
    keyed = classes.select(F.xxhash64("class").alias("k"), "node", "signature")
    placed = classes.select(F.xxhash64("class").alias("k"), F.posexplode("trees").alias("tree", "region"))
    # Counted before rows are dealt, so a region's size doesn't matter.
    sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = written(placed.join(sizes, "region"), "places")

    few = places.where(F.col("n") <= SMALL).groupBy("region").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    pairs = few.select(F.explode(F.expr(f"flatten(transform(ks, (x, i) -> transform(slice(ks, i + 2, {SMALL}), y -> struct(x AS ka, y AS kb))))")).alias("p")).select("p.*").distinct()
    sides = [keyed.select(F.col("k").alias(f"k{x}"), F.col("node").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab"]
    told = pairs.join(sides[0], "ka").join(sides[1], "kb").where("a <> b").select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a long, b long, same int")

    crowd = places.where(F.col("n") > SMALL)
    sorted_by = crowd.join(keyed, "k").select("region", "n", "node", F.arrow_udf(_ordered, "binary")("tree", "signature").alias("order"))
    # A further minimum, 256 ways, for each 64 times that a region is more crowded.
    deeper = F.expr(f"CASE WHEN n <= {CROWD} THEN X'' ELSE substring(order, {DEPTH} + 1, 1 + cast(log(64, n / {CROWD}) AS int)) END")
    dealt = sorted_by.withColumn("deeper", deeper).repartition("region", "deeper").sortWithinPartitions("region", "order")
    told = told.unionAll(dealt.select("region", "node", "order").mapInArrow(_neighbours, "a long, b long, same int").where("a <> b"))
    told = told.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same")
    told = written(told.groupBy("a", "b").agg(F.max("same").alias("same")), "told")

    members = crowd.join(keyed.select("k", "node"), "k").select(F.col("region").alias("cluster"), "node", F.lit(1).alias("n")).distinct()
    members = members.join(components(told), "node", "left").withColumn("part", F.coalesce("component", "node"))
    rest = _blocks(written(members.select("cluster", "part", "node", "n"), "crowds"), CROWD)
    apart = rest.join(keyed.select("node", "signature"), "node").select("cluster", "pair", "node", "main", "signature")
    met = apart.repartition("cluster", "pair").sortWithinPartitions("cluster", "pair").mapInArrow(_met, "a long, b long").where("a <> b")
    return told.unionAll(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(PERMUTATIONS // 2).alias("same")))


def nearest(pairs: DataFrame) -> DataFrame:
    """(a, b): of the pairs (a, b, same) those that are among the NEAREST of one of their nodes."""
    both = pairs.select("a", "b", "same").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "same"))
    # A limit within a window is applied before rows are dealt, so a node of very many pairs sends a few from each task.
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("same"), "b"))
    first = both.withColumn("rank", rank).where(F.col("rank") <= NEAREST)
    return first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many items each two sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ids = ids.astype(np.int32)
    common = counts > max(8, n // 16)
    out = np.zeros((n, n), np.int32)
    number = np.cumsum(common) - 1
    dense = common[ids]
    columns, rows = number[ids[dense]], owner[dense]
    for start in range(0, int(common.sum()), 2048):
        here = (columns >= start) & (columns < start + 2048)
        x = np.zeros((n, min(2048, int(common.sum()) - start)), np.float32)
        x[rows[here], columns[here] - start] = 1
        out += (x @ x.T).astype(np.int32)
    del columns, rows
    rare = ~dense & (counts[ids] > 1)
    item, doc = ids[rare], owner[rare]
    del ids, owner, dense, rare
    order = np.argsort(item, kind="stable")
    item, doc = item[order], doc[order].astype(np.int64)
    step, half = 1, np.zeros(n * n, np.int32)
    while step < len(item):
        same = item[step:] == item[:-step]
        if not same.any():
            break
        half += np.bincount(doc[:-step][same] * n + doc[step:][same], minlength=n * n).astype(np.int32)
        step += 1
    half = half.reshape(n, n)
    out += half
    out += half.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def spanning(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links 100 * intersection >= percent * union between sets."""
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * shared >= percent * (sizes.sum() - shared) else []
    shared = overlaps(sets)
    out, left = [], np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        rest = [root]
        while rest:
            x = rest.pop()
            of = shared[x].astype(np.int64)
            for y in np.flatnonzero((100 * of >= percent * (sizes[x] + sizes - of)) & left).tolist():
                left[y] = False
                out.append((x, y))
                rest.append(y)
    return out


def _sets(size: int):
    """The sets of documents, those rows only that are of the class they stand for."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingle_set(t, size, hashes) for t in binaries(part.column("text"))]
                right = [set_class(s) == c for s, c in zip(sets, part.column("class").to_pylist())]
                out = pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])
                yield out.filter(pa.array(right, pa.bool_()))

    return run


def _alike(percent: int):
    """Whether two sets are linked, by one after the other."""

    @F.arrow_udf(T.BooleanType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return pa.array(out, pa.bool_())

    return run


def _tried(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are linked. A document of very many pairs has its set sent once for TRIED of them."""
    times = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TRIED).cast("int").alias("times"))
    dealt = pairs.join(times, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("times")).cast("int").alias("turn"))
    first = times.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("turn")).join(sets, "node")
    first = first.select(F.col("node").alias("a"), "turn", F.col("shingles").alias("sa"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    met = dealt.hint("merge").join(first.hint("merge"), ["a", "turn"]).hint("merge").join(second.hint("merge"), "b")
    return met.where(_alike(percent)("sa", "sb")).select("a", "b")


def _blocks(members: DataFrame, most: int) -> DataFrame:
    """(cluster, pair, node, main): the pairs of blocks of up to `most` in which documents meet, of (node, cluster, part, n).

    The largest part of a cluster is linked already, so its blocks meet those of the rest; these meet each other
    too. A cluster of one part meets nowhere.
    """
    parts = members.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("items"))
    whole = parts.groupBy("cluster").agg(
        F.max(F.struct("docs", "part", "items")).alias("l"), F.count(F.lit(1)).alias("parts"), F.sum("docs").alias("docs"), F.sum("items").alias("items")
    )
    blocks = lambda docs, items: F.greatest(F.ceil(docs / most), F.ceil(items / BLOCK_SHINGLES)).cast("int")
    sizes = whole.where("parts > 1").select(
        "cluster", F.col("l.part").alias("largest"), blocks(F.col("l.docs"), F.col("l.items")).alias("mains"),
        blocks(F.col("docs") - F.col("l.docs"), F.col("items") - F.col("l.items")).alias("rests"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    told = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(sizes, ["cluster", "salt"])
    told = told.withColumn("main", F.col("part") == F.col("largest"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    placed = told.withColumn("own", own)
    # A pair of the rest's blocks is x * 2^31 + y, one of the rest's block x and the largest part's y is negative.
    across = "transform(sequence(0, {n} - 1), y -> -1L - ({rest} * 2147483648L + {main}))"
    among = "transform(sequence(0, rests - 1), y -> least(y, own) * 2147483648L + greatest(y, own))"
    pairs = F.when(F.col("main"), F.expr(across.format(n="rests", rest="y", main="own"))).otherwise(F.concat(F.expr(across.format(n="mains", rest="own", main="y")), F.expr(among)))
    return placed.select("cluster", F.explode(pairs).alias("pair"), "node", "main")


def _linked(percent: int):
    def run(batches):
        for group in grouped(batches, ["cluster", "pair"]):
            nodes = group.column("node").to_pylist()
            found = spanning([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row for each row of docs.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id reachable. A document without words (or null) has no set and is linked with nothing, one
    with fewer than `size` words has its whole sequence as the only shingle. Rows that repeat a doc_id count
    as one document with several texts. Rows without doc_id lead nowhere: no component_id, kept. An empty
    table gives none. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = written(rows.mapInArrow(_signed(size), "doc_id long, n_shingles long, class binary, signature binary, trees array<long>"), "signed")
    named = signed.where("class IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(named.groupBy("class").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("trees").alias("trees")), "classes")

    pairs = written(candidates(classes), "pairs")
    clusters = components(pairs).withColumnRenamed("component", "cluster")
    members = written(classes.select("node", "class").join(clusters, "node").join(named.groupBy("class").agg(F.max("n_shingles").alias("n")), "class"), "members")
    # Sorted and merged whatever the size: the table of members grows with the documents.
    dealt = rows.repartition(partitions_for(rows, "text"), "doc_id")
    told = dealt.hint("merge").join(members.select("node", "class"), dealt.doc_id == F.col("node")).select("node", "class", "text")
    sets = written(told.distinct().mapInArrow(_sets(size), "node long, shingles binary"), "sets")

    links = written(_tried(nearest(pairs), sets, percent), "links")
    parts = components(links).withColumnRenamed("component", "part")
    kept = members.groupBy("node", "cluster").agg(F.sum("n").alias("n")).join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    left = _blocks(kept, BLOCK).hint("merge").join(sets.hint("merge"), "node").select("cluster", "pair", "node", "shingles")
    met = left.repartition("cluster", "pair").sortWithinPartitions("cluster", "pair")
    found = components(links.unionAll(met.mapInArrow(_linked(percent), "a long, b long")))

    reached = classes.select("class", "node").join(found, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    # Classes of one document with several texts are one node, whatever its texts. Documents without words have no class to meet by.
    plain = signed.select("doc_id", "n_shingles", "class")
    out = plain.where("class IS NOT NULL").join(reached, "class", "left").select("doc_id", "n_shingles", "component")
    out = out.unionAll(plain.where("class IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.least(F.coalesce("component", "doc_id"), "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs less all documents that aren't the smallest doc_id of their component.

    Rows without words or doc_id stay, rows that repeat a doc_id stay or go together; all columns are kept as they
    are, and an empty table stays empty.
    """
    gone = near_duplicates(docs, size, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of alike texts: that of the smallest doc_id, rows without one last.

    Every row counts by its own text, so of rows that repeat a doc_id, or have none, one stays of each group
    too, and rows of one doc_id with different texts stay each. Rows without words (null or empty texts) are alike
    to none. Columns of any name stay as they are; very long texts count whole; an empty table stays empty. With
    unique ids these are the rows of without_near_duplicates.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows, size, percent, doc_id=row).select(F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    # A minimum is taken before rows are dealt, so a group's size doesn't matter.
    first = groups.join(ids, row).groupBy("component_id").agg(F.min(F.struct("none", "id", row)).alias("first"))
    dealt = rows.repartition(partitions_for(rows, "text"), row)
    return dealt.join(first.select(F.col("first")[row].alias(row)), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: three words to a shingle, similarity 0.85."""
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), size=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS shingle FROM w, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id, w.doc_id <= coalesce(c.least, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id
"""
