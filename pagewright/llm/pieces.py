"""SentencePiece encoding and decoding: the best-scored segmentation in one pass of an automaton.

An Aho-Corasick automaton over the pieces reads a text once. At every position its output links name all
pieces that end there, the longest first; each relaxes the best score of that position. Characters that no
piece covers are written as their bytes' pieces.
"""

from __future__ import annotations

import array
import functools
import math
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.shared import spread

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Pieces:
    """Encoder and decoder for a SentencePiece model file.

    Where no piece has a space mark after another character (piece_bpe_32k.model has none), a text falls into
    units, marks and what follows them, that can be segmented each by itself. Units of up to 64 characters
    are remembered, in two generations of `most`.
    """

    def __init__(self, path: str, most: int = 150_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.names = [model.id_to_piece(i) for i in ids]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.hidden = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {i: model.get_score(i) for i in plain}
        #: As the library has it for a character without a piece.
        self.unknown_score = min(self.scores.values()) - 10
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.names[i], (len(self.names[i]), i, self.scores[i]))
        self.automaton.make_automaton()
        self.singles = frozenset(self.names[i] for i in plain if len(self.names[i]) == 1)
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", self.names[i]) for i in plain)
        self.most = most
        self.young: dict[str, tuple[bytes, float]] = {}
        self.old: dict[str, tuple[bytes, float]] = {}

    @staticmethod
    def normalized(text: str) -> str:
        """A mark for each space and one in front; nothing of an empty text."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def best(self, unit: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation; of equal ones that whose last piece is longest, and so on to the front."""
        n = len(unit)
        if self.singles.issuperset(unit):  # every place can be reached by pieces
            score, start, piece = [0.0] + [-math.inf] * n, [0] * (n + 1), [0] * (n + 1)
            for last, (length, i, value) in self.automaton.iter(unit):
                value += score[last + 1 - length]
                if value > score[last + 1]:  # of equal ones the longest comes first
                    score[last + 1], start[last + 1], piece[last + 1] = value, last + 1 - length, i
            out, end = [], n
            while end:
                out.append(piece[end])
                end = start[end]
            return out[::-1], score[n]
        score, start, piece = [0.0] + [0.0] * n, [-1] * (n + 1), [-1] * (n + 1)
        start[0], done = 0, 0

        def unknown(to: int) -> None:
            # Positions at which no piece ends, and those that only have longer ones: a character by itself.
            nonlocal done
            while done < to:
                done += 1
                if not single[done]:
                    value = score[done - 1] + self.unknown_score
                    if start[done] < 0 or value > score[done]:
                        score[done], start[done], piece[done] = value, done - 1, -1

        single = [False] * (n + 1)
        for last, (length, i, value) in self.automaton.iter(unit):
            end = last + 1
            if end - 1 > done:
                unknown(end - 1)
            value += score[end - length]
            single[end] |= length == 1
            if start[end] < 0 or value > score[end] or value == score[end] and end - length < start[end]:
                score[end], start[end], piece[end] = value, end - length, i
        unknown(n)
        ids: list[int] = []
        end = n
        while end:
            if piece[end] >= 0:
                ids.append(piece[end])
            else:
                ids += [self.byte_ids[b] for b in reversed(unit[start[end] : end].encode("utf-8", "replace"))]
            end = start[end]
        return ids[::-1], score[n]

    def encode(self, text: str) -> tuple[bytes, float]:
        """Ids as little-endian u32, and their score."""
        text = self.normalized(text)
        young, old, out, total = self.young, self.old, [], 0.0
        for unit in _UNITS.findall(text) if self.apart else (text,) if text else ():
            known = young.get(unit)
            if known is None:
                known = old.get(unit)
                if known is None:
                    ids, score = self.best(unit)
                    known = _packed(ids), score
                if len(unit) <= 64:
                    young[unit] = known
                    if len(young) > self.most:
                        self.old, self.young = young, {}
                        young, old = self.young, self.old
            out.append(known[0])
            total += known[1]
        return b"".join(out), total

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian u32): pieces joined, byte pieces decoded, marks as spaces, without the first."""
        out, held = [], bytearray()
        for i in np.frombuffer(ids, "<u4").tolist():
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i not in self.hidden:
                out.append(self.names[i])
        out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ").removeprefix(" ")


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _sliced(run, names: list[str], kinds: list[pa.DataType], size: int = 256):
    """A function on batches that hands rows on some hundred at a time, so that few results are in memory at once."""

    def batches_of(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                columns = run(part)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=[*part.schema.names, *names])

    return batches_of


def encode_documents(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_pieces, score, ids): a row for each row of docs; ids are little-endian u32.

    A null or empty text has no pieces, score 0; a very long one is encoded whole, a unit after the other. Of
    segmentations with equal scores that with the longest last piece is taken. Repeated rows are encoded each; an
    empty table gives none; other columns are left out.
    """

    def run(batch: pa.RecordBatch):
        of = pieces(model)
        found = [of.encode(t) for t in batch.column("text").to_pylist()]
        return [len(ids) // 4 for ids, _ in found], [score for _, score in found], [ids for ids, _ in found]

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_sliced(run, ["n_pieces", "score", "ids"], [pa.int64(), pa.float64(), pa.binary()]), "doc_id long, text string, n_pieces long, score double, ids binary")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of encode_documents with decoded: the text of their ids, empty where there are none. Repeated rows are decoded each; an empty table gives none."""

    def run(batch: pa.RecordBatch):
        of = pieces(model)
        return [[of.decode(x) for x in batch.column("ids").to_pylist()]]

    kind = "doc_id long, text string, n_pieces long, score double, ids binary, decoded string"
    return encoded.mapInArrow(_sliced(run, ["decoded"], [pa.string()]), kind)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded again.

    (doc_id, n_pieces, score, ids_crc32, decoded_sha256, same): same tells whether the text came back, which
    only texts with a space mark of their own do not.
    """
    model = model_path()
    rows = decode_documents(encode_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), model), model)
    return rows.select("doc_id", "n_pieces", "score", F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("same"))
