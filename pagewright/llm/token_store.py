"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's stream into chunks, so that equal passages give equal
chunks wherever they stand. A chunk is stored once, under the hash of its content. A document is a recipe:
the hashes of its chunks in order, under a Merkle root. Recipes stand in ascending order of doc_id. Their
roots are gathered page by page in a manifest, pages in roots of parts, and these in the store's root.

Files (Parquet, zstd), in a folder of their own:
    objects/kind=chunk      key = BLAKE2b-128 of the ids, body = width of an id (2 or 4) and the ids, little-endian
    objects/kind=recipe     the recipes as they were cut; recipes/ has them in order
    recipes                 doc_id, n_tokens, hashes (16 bytes each), root, part (of the order), rid (within all)
    manifest                part, page, n_docs, n_tokens, root: of each PAGE recipes of a part
    root                    n_parts, root: over all parts
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.shared import binaries, blocks_of, mixed, new_folder, spread, struct_array, struct_of, windows_of
from pagewright.llm.tokens import encoder, tokenizer_path

WINDOW, LEAST, MOST = 16, 64, 4096
#: Recipes to a page of the manifest.
PAGE = 1024
#: A window ends a chunk if its hash is below this: one in 512.
_BELOW = np.uint64(1 << 55)
#: A hash for each of the usual ids.
_SPREAD = mixed(np.arange(1 << 16, dtype=np.uint64))
#: The hashes of a recipe as an array.
_KEYS = "transform(sequence(0, cast(length(hashes) div 16 as int) - 1), k -> substring(hashes, k * 16 + 1, 16))"
_ROWS = "kind string, key binary, doc_id long, n_tokens long, body binary, root binary"
_RECIPES = "doc_id long, n_tokens long, hashes binary, root binary, part int, rid long"
_MANIFEST = "part int, page long, n_docs long, n_tokens long, root binary"


def cuts(ids: np.ndarray, lengths: list[int]) -> list[list[int]]:
    """For each of the documents whose ids stand one after the other, where its chunks end, counted over all.

    A chunk ends after ids whose last WINDOW hash low enough, and has LEAST to MOST ids; a document's last may have fewer.
    """
    hashes = windows_of(_SPREAD[ids] if not len(ids) or ids.max() < len(_SPREAD) else mixed(ids.astype(np.uint64)), WINDOW, spread=False)
    ends = np.flatnonzero(hashes < _BELOW) + WINDOW
    bounds = np.cumsum([0, *lengths])
    # Windows that begin in the document before count for none.
    first = np.searchsorted(ends, bounds[:-1] + WINDOW).tolist()
    last = np.searchsorted(ends, bounds[1:]).tolist()
    ends, bounds, out = ends.tolist(), bounds.tolist(), []
    for k, start in enumerate(bounds[:-1]):
        stops, whole = [], bounds[k + 1]
        for end in [*ends[first[k] : last[k]], whole]:
            while end - start > MOST:
                start += MOST
                stops.append(start)
            if end - start >= LEAST or end == whole:
                if end > start:
                    stops.append(end)
                start = end
        out.append(stops)
    return out


def address(data: bytes) -> bytes:
    """Of a chunk, by its ids as little-endian u32."""
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(hashes: list[bytes]) -> bytes:
    """The root over hashes in order; an odd one moves up as it is."""
    level = [hashlib.blake2b(b"\0" + h, digest_size=16).digest() for h in hashes] or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def _body(data: bytes) -> bytes:
    ids = np.frombuffer(data, "<u4")
    return b"\2" + ids.astype("<u2").tobytes() if len(ids) and ids.max() < 1 << 16 else b"\4" + data


def body_ids(body: bytes) -> bytes:
    """A stored chunk's ids as little-endian u32."""
    return np.frombuffer(body, "<u2", offset=1).astype("<u4").tobytes() if body[0] == 2 else body[1:]


def _cut(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()
    names = ["kind", "key", "doc_id", "n_tokens", "body", "root"]
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        of, sent = encoder(path), set()
        for batch in batches:
            texts, doc_ids = binaries(batch.column("text")), batch.column("doc_id").to_pylist()
            for k, stop_at in blocks_of(texts):
                found = of.encode(texts[k:stop_at])
                data = end.join([*found, b""])
                ids, lengths = np.frombuffer(data, "<u4"), [len(x) // 4 + 1 for x in found]
                narrow = ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else None
                chunks, recipes, start = [], [], 0
                for doc_id, n, stops in zip(doc_ids[k:stop_at], lengths, cuts(ids, lengths)):
                    hashes = []
                    for stop in stops:
                        chunk = data[4 * start : 4 * stop]
                        hashes.append(key := address(chunk))
                        if key not in sent:  # a chunk that this task has sent need not go again
                            if len(sent) < 200_000:
                                sent.add(key)
                            chunks.append((key, stop - start, _body(chunk) if narrow is None else b"\2" + narrow[2 * start : 2 * stop]))
                        start = stop
                    # Recipes go anywhere, evenly.
                    listed = b"".join(hashes)
                    recipes.append((hashlib.blake2b(b"%s%r" % (listed, doc_id), digest_size=8).digest(), doc_id, n, listed, merkle(hashes)))
                none = [None] * len(chunks)
                columns = [["chunk"] * len(chunks) + ["recipe"] * len(recipes)]
                parts = list(zip(*chunks)) or [()] * 3, list(zip(*recipes)) or [()] * 5
                columns += [[*parts[0][0], *parts[1][0]], [*none, *parts[1][1]], [*parts[0][1], *parts[1][2]], [*parts[0][2], *parts[1][3]], [*none, *parts[1][4]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def _first_of_key(batches):
    """Of chunks sorted by key the first of each; all recipes."""
    last = pa.scalar(None, pa.binary())
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        before = pa.concat_arrays([pa.array([last.as_py()], keys.type), keys.slice(0, len(keys) - 1)])
        again = pc.and_(pc.equal(batch.column("kind"), "chunk"), pc.fill_null(pc.equal(keys, before), False))
        last = keys[len(keys) - 1]
        yield batch.filter(pc.invert(again))


@dataclass(frozen=True)
class Store:
    path: str

    def chunks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{_ROWS}").parquet(f"{self.path}/objects").where("kind = 'chunk'").select("key", "n_tokens", "body")

    def recipes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_RECIPES).parquet(f"{self.path}/recipes")

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> Store:
    """Every row's ids and end_id, in a new store at path.

    A null or empty text is the end id alone; a very long one has as many chunks as it needs. Rows with equal
    doc_id keep a recipe each, rows with equal texts share their chunks, null doc_ids come first, and an empty
    table leaves an empty store. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_cut(tokenizer, end_id), _ROWS)
    dealt = rows.repartition("key").sortWithinPartitions("kind", "key").mapInArrow(_first_of_key, _ROWS)
    dealt.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    cut = spark.read.schema(_ROWS).parquet(f"{path}/objects").where("kind = 'recipe'")
    ordered = cut.select("doc_id", "n_tokens", F.col("body").alias("hashes"), "root").repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    numbered = ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid"))
    numbered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    store = Store(path)
    pages_of(store.recipes(spark)).write.option("compression", "zstd").parquet(f"{path}/manifest")
    spark.createDataFrame([_root(store, spark)], "n_parts int, root binary").coalesce(1).write.parquet(f"{path}/root")
    return store


@F.arrow_udf(struct_of("x binary")["x"].dataType)
def _roots(hashes: pa.Array) -> pa.Array:
    return pa.array([merkle(x) for x in hashes.to_pylist()], pa.binary())


def pages_of(recipes: DataFrame) -> DataFrame:
    """(part, page, n_docs, n_tokens, root): a Merkle root over the documents of each page of each part."""
    page = F.expr(f"(rid & {(1 << 33) - 1}L) div {PAGE}").alias("page")
    listed = recipes.groupBy("part", page).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("rid", "root"))).alias("r")
    )
    return listed.select("part", "page", "n_docs", "n_tokens", _roots(F.col("r.root")).alias("root"))


def _root(store: Store, spark: SparkSession) -> tuple[int, bytes]:
    """How many parts the manifest has, and the root over theirs; there are as many as the order had partitions."""
    pages = store.manifest(spark).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("page", "n_docs", "n_tokens", "root"))).alias("r"))
    said = F.transform("r", lambda x: F.concat(x["root"], F.to_binary(F.concat_ws(" ", x["n_docs"], x["n_tokens"]), F.lit("utf-8"))))
    parts = pages.select("part", _roots(said).alias("root")).orderBy("part").collect()
    return len(parts), merkle([bytes(r.root) + str(r.part).encode() for r in parts])


_CHECKED = struct_of("n long,crc long")


@F.arrow_udf(_CHECKED)
def _checked(keys: pa.Array, bodies: pa.Array) -> pa.Array:
    rows = []
    for key, body in zip(keys.to_pylist(), bodies.to_pylist()):
        data = body_ids(body)
        if address(data) != key:
            raise ValueError(f"chunk {key.hex()} doesn't hold what its key says")
        rows.append((len(data) // 4, zlib.crc32(data)))
    return struct_array(_CHECKED, rows)


_ZEROS = bytes(4 * MOST)


def crc_joined(first: int, second: int, n_bytes: int) -> int:
    """The CRC-32 of two strings in a row, from that of each and the second's length (up to that of a chunk)."""
    zeros = _ZEROS[:n_bytes]
    return zlib.crc32(zeros, first) ^ zlib.crc32(zeros) ^ second


_WHOLE = struct_of("n_tokens long,crc long,root binary")


@F.arrow_udf(_WHOLE)
def _whole(parts: pa.Array) -> pa.Array:
    lengths, flat = pc.list_value_length(parts).to_numpy(zero_copy_only=False), parts.flatten()
    of = np.repeat(np.arange(len(parts)), lengths)
    flat = flat.take(pa.array(np.lexsort((flat.field("seq").to_numpy(), of))))
    keys, ns, crcs = (flat.field(c).to_pylist() for c in ("key", "n", "crc"))
    rows, at = [], 0
    for length in lengths.tolist():
        total = crc = 0
        for k in range(at, at + length):
            if ns[k] is None:
                raise ValueError(f"no chunk {keys[k].hex()} in the store")
            crc = crc_joined(crc, crcs[k], 4 * ns[k])
            total += ns[k]
        rows.append((total, crc, merkle(keys[at : at + length])))
        at += length
    return struct_array(_WHOLE, rows)


def _verified(store: Store, spark: SparkSession) -> DataFrame:
    """(part, n): the manifest's parts with their tokens, once all above and below agrees.

    The store's root is compared at once, pages when the rows are computed: each must have the documents,
    tokens and root that the manifest says, and none may be missing.
    """
    kept = spark.read.schema("n_parts int, root binary").parquet(f"{store.path}/root").first()
    if kept is None or _root(store, spark) != (kept.n_parts, bytes(kept.root)):
        raise ValueError("the manifest isn't what the store's root says")
    said = store.manifest(spark).select("part", "page", *(F.col(c).alias(f"said_{c}") for c in ("n_docs", "n_tokens", "root")))
    pages = pages_of(store.recipes(spark)).join(said, ["part", "page"], "full")
    same = F.lit(True)
    for c in ("n_docs", "n_tokens", "root"):
        same = same & F.coalesce(F.col(c) == F.col(f"said_{c}"), F.lit(False))
    return pages.select("part", _or_raise(same, F.col("n_tokens"), "recipes aren't what the manifest says").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))


def _or_raise(right: Column, value: Column, message: str) -> Column:
    return F.when(right, value).otherwise(F.raise_error(F.lit(message)).cast("long"))


def read_store(store: Store, spark: SparkSession) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks, root): every document as its files give it, verified.

    Chunks are read once each and checked against their keys; documents follow from their chunks' lengths
    and checksums, so no ids are sent around. A document's root must be that of its chunks, a page's that of
    its documents, and so on to the store's: what is lost or changed raises an error. An empty store gives no rows.
    """
    chunks = store.chunks(spark).select("key", _checked("key", "body").alias("c")).select("key", "c.n", "c.crc")
    recipes = store.recipes(spark)
    parts = recipes.select("rid", F.posexplode(F.expr(_KEYS)).alias("seq", "key")).join(chunks, "key", "left")
    whole = parts.groupBy("rid").agg(F.collect_list(F.struct("seq", "key", "n", "crc")).alias("parts")).select("rid", F.size("parts").cast("long").alias("n_chunks"), _whole("parts").alias("w"))
    # The order's parts are as many as its partitions; their sums are few rows.
    before = _verified(store, spark).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = recipes.join(F.broadcast(before), "part").select(
        "rid", "doc_id", "root", (F.col("before") + F.sum("n_tokens").over(Window.partitionBy("part").orderBy("rid")) - F.col("n_tokens")).alias("start")
    )
    read = placed.join(whole, "rid", "left")
    same = _or_raise(F.col("w.root").eqNullSafe(F.col("root")), F.col("w.n_tokens"), "a recipe's root doesn't match its chunks")
    return read.select("doc_id", "start", same.alias("n_tokens"), F.col("w.crc").alias("ids_crc32"), "n_chunks", F.hex("root").alias("root"))


def reconstruct(store: Store, spark: SparkSession) -> DataFrame:
    """(doc_id, ids): the documents' ids, joined from their chunks.

    A chunk that is lost, or isn't what its key says, and a recipe that isn't what its root says raise an
    error. Documents that repeat come back as often as they were written; an empty store gives no rows.
    """
    recipes = store.recipes(spark).select("rid", "doc_id", "root", F.posexplode(F.expr(_KEYS)).alias("seq", "key"))
    parts = recipes.join(store.chunks(spark), "key", "left")

    @F.arrow_udf("array<bigint>")
    def joined(parts: pa.Array, roots: pa.Array) -> pa.Array:
        out = []
        for chunks, root in zip(parts.to_pylist(), roots.to_pylist()):
            ids = []
            for c in chunks:
                data = None if c["body"] is None else body_ids(c["body"])
                if data is None or address(data) != c["key"]:
                    raise ValueError(f"chunk {c['key'].hex()} is lost or isn't what its key says")
                ids.append(np.frombuffer(data, "<u4").astype(np.int64))
            if merkle([c["key"] for c in chunks]) != root:
                raise ValueError("a recipe's root doesn't match its chunks")
            out.append(np.concatenate(ids))
        return pa.array(out, pa.list_(pa.int64()))

    listed = parts.groupBy("rid", "doc_id", "root").agg(F.sort_array(F.collect_list(F.struct("seq", "key", "body"))).alias("p"))
    return listed.select("doc_id", joined("p", "root").alias("ids"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenized, stored, and read back from the files."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_store(write_store(docs, new_folder(spark, "token-store"), tokenizer_path(), end_id=2), spark)
