"""What the operators of this subpackage share: shared folders, words, stable hashes, row streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.storage import new_folder, removed, shared_root, spread, write, written  # noqa: F401


#: Bytes of text to a partition where whole texts are shuffled.
TEXT_BYTES = 32 << 20


def partitions_for(docs: DataFrame, text: str) -> int:
    """How many partitions whole texts are shuffled to: those of the session, or more if they would hold more than TEXT_BYTES."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TEXT_BYTES))


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def struct_of(fields: str) -> T.StructType:
    """The struct type of "name kind, ..."; unlike a DDL string it needs no session, so workers can import it."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(","))])


def struct_array(kind: T.StructType, rows: list[tuple]) -> pa.StructArray:
    """Rows as an Arrow array of that struct."""
    columns = list(zip(*rows)) if rows else [[] for _ in kind]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.StructArray.from_arrays([pa.array(c, arrow[f.dataType.simpleString()]) for c, f in zip(columns, kind)], names=kind.names)


def binaries(array: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 of a string array's values, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return array.cast(kind).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of [^\\x20\\x09-\\x0D], as UTF-8: just where bytes.split() cuts."""
    return text.split() if text else []


class WordHashes(dict):
    """64-bit xxhash by word, remembered for at most `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_RNG = np.random.default_rng(20_240_301)
#: Random odd numbers for each byte and place, in two lanes of their own.
_BYTE, _PLACE = (_RNG.integers(0, 2**63, (2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, 1024))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[*range(9, 14), 32]] = True


def hashed_words(texts: list[bytes | None], lanes: int = 1) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words of all texts, one after the other, in as many independent lanes, and how many words each text has.

    A word is what words_of gives. All arithmetic is over the bytes of the texts together, which should be
    some hundred kB: a sum of products of random numbers for each byte and place, then spread.
    """
    counts = np.zeros(len(texts), np.int64)
    data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    space = _IS_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return *(np.zeros(0, np.uint64) for _ in range(lanes)), counts
    bounds = np.cumsum([len(t or b"") + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = (np.arange(int(lengths.sum())) - np.repeat(first, lengths)) & 1023
    letters, added = data[~space], lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return *(mixed(np.add.reduceat(_BYTE[k][letters] * _PLACE[k][place], first) + added) for k in range(lanes)), counts


def blocks_of(texts: list[bytes | None], size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some `size` bytes, one text at least."""
    first = total = 0
    for k, t in enumerate(texts):
        total += len(t or b"")
        if total >= size:
            yield first, k + 1
            first, total = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows_of(hashes: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15, spread: bool = True) -> np.ndarray:
    """A 64-bit hash of each run of `size` consecutive items; empty if there are fewer items. Without spread only its high bits are good."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power = np.zeros(n, np.uint64), size
    # Doubling: a run of 2k items joins two runs of k, so the work grows with log(size).
    part, length, done = hashes, 1, 0
    while power:
        if power & 1:
            out = out * np.uint64(pow(base, length, 1 << 64)) + part[done : done + n] if done else part[:n]
            done += length
        power >>= 1
        if power:
            part = part[:-length] * np.uint64(pow(base, length, 1 << 64)) + part[length:]
            length *= 2
    return mixed(out) if spread else out


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys, one table each, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        differs = np.zeros(batch.num_rows, bool)
        for c in columns:
            values = c.to_numpy(zero_copy_only=False)
            differs[1:] |= values[1:] != values[:-1]
        first = tuple(c[0].as_py() for c in columns)
        differs[0] = last is not None and first != last
        cuts = [*np.flatnonzero(differs).tolist(), batch.num_rows]
        start = 0
        for cut in cuts:
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if cut < batch.num_rows and held:
                yield pa.Table.from_batches(held)
                held = []
            start = cut
        last = tuple(c[-1].as_py() for c in columns)
    if held:
        yield pa.Table.from_batches(held)
