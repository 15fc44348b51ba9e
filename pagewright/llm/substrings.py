"""Removing passages that recur, by automata of repeated phrases.

Documents are dealt into parts of some 8 MB, and whatever travels between parts by value into shards.

1. Anchors. Of every window of WINDOW words the smallest hash among its runs of SEED words: equal windows
   have equal anchors, and few words in a hundred begin one. Anchors met once are dropped.
2. Confirmation. Windows with an anchor that recurs send their own hash, of 128 bits; those met twice
   recur. Of the parts that hold such a window the first owns it, and is told the others.
3. Phrases. An owner cuts the runs of windows that it owns out of its texts, and sends their words to every
   part that holds them. No window is in two phrases.
4. Location. A part compiles the tiles of the phrases it got into an automaton with pyahocorasick, and streams
   all of its documents through it. A tile found is extended word by word against its phrase, so what is
   removed is equal in wording to what another place has. Every WINDOW words of a phrase hold a whole tile,
   so none is missed.

A part's automaton is the shard of all phrases that occur in it: work grows with the text, not with parts times phrases.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.shared import binaries, blocks_of, hashed_words, windows_of, words_of

WINDOW, SEED = 35, 8
PART_BYTES = 8 << 20
_SENT = "shard int, part int, hashes binary"
_PAIRS = "shard int, part int, hashes binary, others binary"
_OWNED = "part int, hashes binary, others binary, sizes binary, holders binary"
_PHRASES = "part int, phrases binary"
#: A second base, for the other half of a window's 128 bits.
_OTHER = 0xC2B2AE3D27D4EB4F


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every `size` items in a row."""
    length = 1
    while 2 * length <= size:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    return np.minimum(x[: len(x) - (size - length)], x[size - length :]) if size > length else x


def _inside(counts: np.ndarray, size: int) -> np.ndarray:
    """Of the runs of `size` words over texts one after the other, those that lie within one text."""
    total = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(max(0, total - size + 1)) + size <= ends[: max(0, total - size + 1)]


def _anchors(hashes: np.ndarray, counts: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds that lie within a text, which windows do, and the anchor of each window."""
    seeds, inside = windows_of(hashes, seed), _inside(counts, window)
    return seeds[_inside(counts, seed)], inside, sliding_min(seeds, window - seed + 1)


def _changes(x: np.ndarray) -> np.ndarray:
    """x without what repeats the value before."""
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _once_or_twice(values: list[np.ndarray]) -> np.ndarray:
    """Each value once, or twice if it is there more than once; sorted."""
    if not values:
        return np.zeros(0, np.uint64)
    different, counts = np.unique(np.concatenate(values), return_counts=True)
    return np.repeat(different, np.minimum(counts, 2))


def _shards(values: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values the shard that each belongs to, and where a shard's values begin."""
    shard = ((values >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    return shard, np.flatnonzero(np.diff(shard, prepend=-1))


def _dealt(values: np.ndarray, part: int, shards: int, **more: np.ndarray) -> pa.Table:
    """Sorted values, and others beside them, packed by the shard that they belong to."""
    shard, starts = _shards(values, shards)
    pack = lambda x: pa.array([y.tobytes() for y in np.split(x, starts[1:])] if len(starts) else [], pa.binary())
    columns = {"shard": pa.array(shard[starts], pa.int32()), "part": pa.array(np.full(len(starts), part), pa.int32()), "hashes": pack(values)}
    return pa.table(columns | {name: pack(x) for name, x in more.items()})


def _joined(column: pa.ChunkedArray, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _recurring(group: pa.Table) -> pa.Table:
    """Of a shard's values, by part, those that are there twice."""
    held = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
    every = np.sort(np.concatenate(held))
    again = _changes(every[1:][every[1:] == every[:-1]])
    found = [_changes(x[_among(x, again)]) for x in held]
    parts = [p for p, x in zip(group.column("part").to_pylist(), found) if len(x)]
    return pa.table({"part": pa.array(parts, pa.int32()), "hashes": pa.array([x.tobytes() for x in found if len(x)], pa.binary())})


def _owners(group: pa.Table) -> pa.Table:
    """Of a shard's windows those that are there twice: for each part the ones it owns, and which parts hold them."""
    of = np.repeat(np.array(group.column("part").to_pylist(), np.int32), [len(x) // 8 for x in group.column("hashes").to_pylist()])
    a, b = _joined(group.column("hashes")), _joined(group.column("others"))
    order = np.lexsort((of, b, a))
    a, b, of = a[order], b[order], of[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    number = np.cumsum(first) - 1
    recurs = np.bincount(number)[number] > 1
    # A part stands twice for a window that it has twice.
    keep = recurs & (first | np.concatenate([[True], of[1:] != of[:-1]]))
    starts = np.flatnonzero(first & recurs)
    sizes = np.diff(np.append(np.searchsorted(np.flatnonzero(keep), starts), keep.sum())).astype(np.int32)
    holders, begins = of[keep], np.cumsum(sizes) - sizes
    owner, rows = of[starts], []
    for part in np.unique(owner).tolist():
        mine = np.flatnonzero(owner == part)
        held = np.repeat(begins[mine] - np.cumsum(sizes[mine]) + sizes[mine], sizes[mine]) + np.arange(int(sizes[mine].sum()))
        rows.append((part, a[starts[mine]].tobytes(), b[starts[mine]].tobytes(), sizes[mine].tobytes(), holders[held].tobytes()))
    kinds = [pa.int32(), *[pa.binary()] * 4]
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.table({name: pa.array(c, k) for name, c, k in zip(("part", "hashes", "others", "sizes", "holders"), columns, kinds)})


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among the known, which are sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Phrases:
    """Word sequences, and an automaton over their tiles that finds every run of `window` words or more which they share with a text.

    A word is a number below `most`. The automaton reads it as so many digits of five bits: its nodes have few
    children then, which it looks through one by one.
    """

    def __init__(self, window: int, most: int):
        # Any `window` words of a phrase hold a whole tile.
        self.window, self.tile = window, (window + 1) // 2
        self.digits = max(1, -(-max(1, (most - 1).bit_length()) // 5))
        self.phrases: list[np.ndarray] = []
        self.tiles: dict[str, list[tuple[int, int]]] = {}
        self.automaton = None

    def spelled(self, words: np.ndarray) -> str:
        shifts = np.arange(5 * (self.digits - 1), -1, -5)
        return (((words[:, None] >> shifts) & 31) + 64).astype(np.uint8).tobytes().decode("ascii")

    def add(self, phrase: np.ndarray) -> None:
        number, spelled, width = len(self.phrases), self.spelled(phrase), self.digits
        self.phrases.append(phrase)
        for at in range(0, len(phrase) - self.tile + 1, self.tile):
            self.tiles.setdefault(spelled[at * width : (at + self.tile) * width], []).append((number, at))

    def compile(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for tile, places in self.tiles.items():
            self.automaton.add_word(tile, places)
        if self.tiles:
            self.automaton.make_automaton()

    def covered(self, words: np.ndarray) -> np.ndarray:
        """Which words lie in a run of `window` words that a phrase has too."""
        out = np.zeros(len(words), bool)
        if not self.tiles or len(words) < self.window:
            return out
        seen: dict[tuple[int, int], int] = {}
        for end, places in self.automaton.iter(self.spelled(words)):
            last, odd = divmod(end + 1, self.digits)
            if odd:  # from the middle of a word
                continue
            at = last - self.tile
            for number, offset in places:
                if seen.get((number, at - offset), -1) >= last:
                    continue
                phrase = self.phrases[number]
                n = min(at, offset)
                differs = np.flatnonzero(words[at - n : at] != phrase[offset - n : offset])
                start = at - n + (int(differs[-1]) + 1 if len(differs) else 0)
                n = min(len(words) - at, len(phrase) - offset)
                differs = np.flatnonzero(words[at : at + n] != phrase[offset : offset + n])
                end_of = at + (int(differs[0]) if len(differs) else n)
                seen[number, at - offset] = end_of
                if end_of - start >= self.window:
                    out[start:end_of] = True
        return out


class Owned:
    """The windows that a part owns, by their 128 bits, and the parts that hold each."""

    def __init__(self, told: pa.Table):
        a, b = _joined(told.column("hashes")), _joined(told.column("others"))
        sizes, holders = _joined(told.column("sizes"), np.int32), _joined(told.column("holders"), np.int32)
        order = np.lexsort((b, a))
        self.a, self.b = a[order], b[order]
        ends = np.cumsum(sizes)
        sets: dict[bytes, int] = {}
        named = [sets.setdefault(holders[e - n : e].tobytes(), len(sets)) for e, n in zip(ends.tolist(), sizes.tolist())]
        self.sets = [np.frombuffer(x, np.int32).tolist() for x in sets]
        self.set_of = np.array(named, np.int64)[order] if named else np.zeros(0, np.int64)
        self.taken = np.zeros(len(self.a), bool)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each window among those owned; -1 if it isn't."""
        out = np.full(len(a), -1)
        if not len(self.a):
            return out
        at = np.searchsorted(self.a, a)
        left = np.flatnonzero(self.a[np.minimum(at, len(self.a) - 1)] == a)
        at = at[left]
        while len(left):  # several windows may have the first half in common
            same = self.b[at] == b[left]
            out[left[same]] = at[same]
            left, at = left[~same], at[~same] + 1
            more = at < len(self.a)
            left, at = left[more], at[more]
            more = self.a[at] == a[left]
            left, at = left[more], at[more]
        return out


def phrases_of(texts: list[bytes | None], owned: Owned, window: int, mask: np.uint64) -> dict[int, list[bytes]]:
    """By part the phrases that it needs: the words of runs of owned windows with the same holders, each window once."""
    out: dict[int, list[bytes]] = {}
    for first, end in blocks_of(texts) if len(owned.a) else ():
        *lanes, counts = hashed_words(texts[first:end], 2)
        inside = _inside(counts, window)
        if not inside.any():
            continue
        at = owned.places(windows_of(lanes[0], window) & mask, windows_of(lanes[1], window, _OTHER))
        at[~inside] = -1
        starts = np.cumsum(counts) - counts
        found = np.flatnonzero(at >= 0)
        # Of each window its first place here, if no text before had it.
        _, once = np.unique(at[found], return_index=True)
        found = np.sort(found[once])
        found = found[~owned.taken[at[found]]]
        owned.taken[at[found]] = True
        document = np.searchsorted(starts, found, side="right") - 1
        # Texts without a word begin where the next does; the last of them has the words.
        sets = owned.set_of[at[found]]
        cut = np.flatnonzero((np.diff(found, prepend=-2) != 1) | (np.diff(sets, prepend=-1) != 0) | (np.diff(document, prepend=-1) != 0))
        words, held = [], -1
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(found)]):
            k = int(document[i])
            if k != held:
                words, held = words_of(texts[first + k]), k
            here = int(found[i] - starts[k])
            phrase = b" ".join(words[here : here + j - i + window - 1])
            for part in owned.sets[int(sets[i])]:
                out.setdefault(part, []).append(phrase)
    return out


def covered_words(texts: list[bytes | None], phrases: list[bytes], window: int):
    """For each text its words, and which of them lie in `window` words that a phrase has too; None if none do."""
    vocabulary: dict[bytes, int] = {}
    lists = [p.split(b" ") for p in phrases]
    for words in lists:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    of = Phrases(window, len(vocabulary) + 1)
    for words in lists:
        of.add(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
    of.compile()
    for text in texts:
        words = words_of(text)
        gone = None
        if of.tiles and len(words) >= window:
            ids = np.fromiter(map(vocabulary.get, words, itertools.repeat(0)), np.int64, len(words))
            gone = of.covered(ids)
        yield words, gone if gone is not None and gone.any() else None


def _fresh(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def _dealing(docs: DataFrame) -> Column:
    """A hash of a row's values; what may hold a map goes by its JSON."""
    plain = (F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes)
    return F.xxhash64(*plain)


def _located(docs: DataFrame, text: str, window: int, seed: int, bits: int) -> tuple[DataFrame, tuple[str, str, str]]:
    """docs with three columns whose names they don't have: words, words removed, and the text that is kept."""
    spark, mask = docs.sparkSession, np.uint64((1 << bits) - 1) << np.uint64(64 - bits)
    part, *named = (_fresh(docs.columns, name) for name in ("_part", "_n_words", "_n_removed", "_kept"))
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    dealt = docs.withColumn(part, F.pmod(_dealing(docs), F.lit(parts)).cast("int"))

    def anchors(table: pa.Table) -> pa.Table:
        found, texts = [], binaries(table.column(text))
        for first, end in blocks_of(texts):
            hashes, counts = hashed_words(texts[first:end])
            seeds, inside, of = _anchors(hashes, counts, window, seed)
            found.append(seeds[_among(seeds, np.unique(_changes(of[inside])))] & mask)
        return _dealt(_once_or_twice(found), table.column(part)[0].as_py(), parts)

    def windows(table: pa.Table, told: pa.Table) -> pa.Table:
        known, texts = np.sort(_joined(told.column("hashes"))), binaries(table.column(text))
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64),) * 2]
        for first, end in blocks_of(texts) if len(known) else ():
            *lanes, counts = hashed_words(texts[first:end], 2)
            _, inside, of = _anchors(lanes[0], counts, window, seed)
            some = inside & _among(of & mask, known)
            if some.any():
                found.append(((windows_of(lanes[0], window) & mask)[some], windows_of(lanes[1], window, _OTHER)[some]))
        a, b = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        # Each window once, or twice if it is there more than once.
        third = np.zeros(len(a), bool)
        third[2:] = (a[2:] == a[:-2]) & (b[2:] == b[:-2])
        return _dealt(a[~third], table.column(part)[0].as_py() if table.num_rows else 0, parts, others=b[~third])

    def phrases(table: pa.Table, told: pa.Table) -> pa.Table:
        sent = phrases_of(binaries(table.column(text)), Owned(told), window, mask)
        return pa.table({"part": pa.array(sent, pa.int32()), "phrases": pa.array([b"\n".join(x) for x in sent.values()], pa.binary())})

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(named, (T.LongType(), T.LongType(), T.StringType())))])

    def located(table: pa.Table, told: pa.Table) -> pa.Table:
        counts, removed, kept = [], [], []
        got = [p for x in told.column("phrases").to_pylist() for p in x.split(b"\n")]
        for words, gone in covered_words(binaries(table.column(text)), got, window):
            counts.append(len(words))
            removed.append(0 if gone is None else int(gone.sum()))
            kept.append(b" ".join(words if gone is None else itertools.compress(words, (~gone).tolist())).decode("utf-8", "replace"))
        out = table.drop_columns([part])
        for name, values, kind in zip(named, (counts, removed, kept), (pa.int64(), pa.int64(), pa.string())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    # The passes read the same exchange of documents, which Spark then makes once; it has as many partitions as
    # there are parts, whatever the session says, and so have the exchanges of hashes.
    by_part = dealt.repartition(parts, part).groupBy(part)
    by_shard = lambda of: of.repartition(parts, "shard").groupBy("shard")
    recurring = by_shard(by_part.applyInArrow(anchors, _SENT)).applyInArrow(_recurring, "part int, hashes binary")
    owned = by_shard(by_part.cogroup(recurring.groupBy("part")).applyInArrow(windows, _PAIRS)).applyInArrow(_owners, _OWNED)
    sent = by_part.cogroup(owned.groupBy("part")).applyInArrow(phrases, _PHRASES)
    return by_part.cogroup(sent.groupBy("part")).applyInArrow(located, schema), tuple(named)


def remove_repeated(docs: DataFrame, text: str = "text", window: int = WINDOW, seed: int = SEED, bits: int = 64) -> DataFrame:
    """docs with n_words, n_removed and kept_text: the words outside windows that recur, joined by one space.

    A window recurs if its words also start anywhere else, in the same text too. All columns of docs come
    along unchanged; those it has of these three names are replaced. A null or empty text has no words and an
    empty kept_text; a very long one is taken whole, by a task that holds it and its part. Repeated rows are
    copies of each other, so they lose all windows. An empty table gives none. bits are those of the first half
    of a hash, by which values are dealt; fewer make collisions, not errors.
    """
    out, named = _located(docs, text, window, seed, bits)
    told = dict(zip(("n_words", "n_removed", "kept_text"), named))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in told), *(F.col(f"`{was}`").alias(name) for name, was in told.items()))


def without_repeated(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with what remains of their texts, and the length in characters set anew if there is such a column.

    Every other column stays as it is, whatever its name. A null text stays null, one without words becomes empty.
    Repeated rows lose what they share and stay; an empty table gives none.
    """
    out, (_, _, kept) = _located(docs, text, WINDOW, SEED, 64)
    new = F.when(F.col(f"`{text}`").isNotNull(), F.col(f"`{kept}`"))
    changed = {text: new} | ({length: F.length(new).cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return out.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less every window of 35 words that recurs."""
    out = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT k, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS win FROM d, unnest(range(1, len(ws) - 33)) AS u(i)),
c AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY win) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT k, i + j AS p FROM c, unnest(range(0, 35)) AS u(j)),
w AS (SELECT k, p, ws[p] AS word FROM d, unnest(range(1, len(ws) + 1)) AS u(p)),
kept AS (SELECT k, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM w ANTI JOIN gone USING (k, p) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""
