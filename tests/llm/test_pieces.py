import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import pieces

PATH = pieces.model_path()
TEXTS = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("  the ing▁aeé\n中")), max_size=40)


@pytest.fixture(scope="module")
def unigram():
    """The library's own best path over the same pieces: the model file with its type set to unigram."""
    import sentencepiece

    data = bytearray(open(PATH, "rb").read())

    def varint(at):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    def fields(at, end):
        while at < end:
            tag, at = varint(at)
            place = at
            if tag & 7 == 2:
                size, at = varint(at)
                yield tag >> 3, at, at + size
                at += size
            elif tag & 7 == 0:
                _, at = varint(at)
                yield tag >> 3, place, at
            else:
                at += 4 if tag & 7 == 5 else 8

    for number, at, end in list(fields(0, len(data))):
        if number == 2:
            for inner, place, _ in fields(at, end):
                if inner == 3:
                    data[place] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(data))


def brute(of, text):
    """Best segmentation by looking every substring up."""
    text = of.normalized(text)
    ids = {of.names[i]: i for i in of.scores}
    longest = max(map(len, ids))
    best = [(0.0, 0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            name = text[start:end]
            if name in ids:
                value, tail = best[start][0] + of.scores[ids[name]], [ids[name]]
            elif end - start == 1:
                value, tail = best[start][0] + of.unknown_score, [of.byte_ids[b] for b in name.encode("utf-8", "replace")]
            else:
                continue
            if best[end] is None or value > best[end][0]:
                best[end] = (value, start, tail)
    out, end = [], len(text)
    while end:
        out.append(best[end][2])
        end = best[end][1]
    return [i for tail in reversed(out) for i in tail], best[len(text)][0]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_best_path(text):
    of = pieces.pieces(PATH)
    ids, score = of.encode(text)
    assert (np.frombuffer(ids, "<u4").tolist(), score) == brute(of, text)
    back = of.decode(ids)
    assert back == text.replace("▁", " ") or "\ud800" <= max(text, default="") <= "\udfff"


def test_no_path_of_the_library_is_better(spark, unigram):
    """The library's search misses the best path now and then; where scores are equal the ids are too."""
    of, equal, lines = pieces.pieces(PATH), 0, 0
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        for line in row.text.split("\n")[:4]:
            line = line[:60].strip()
            ids, score = of.encode(line)
            other = unigram.encode(line)
            if all(i in of.scores for i in other):
                value = sum(of.scores[i] for i in other)
                assert score >= value
                assert score > value or np.frombuffer(ids, "<u4").tolist() == other
                equal, lines = equal + (score == value), lines + 1
    assert equal > 0.7 * lines > 70


def test_forgetting_changes_nothing():
    small = pieces.Pieces(PATH, most=2)
    for text in ("one two three one two four", "four three " * 20, "x" * 300):
        assert small.encode(text) == pieces.pieces(PATH).encode(text)
    assert len(small.young) <= 3 and len(small.old) <= 3


def test_documents(spark):
    of = pieces.pieces(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in pieces.op5_sentencepiece(spark, "/root/testdata/sf0.001").collect():
        ids, score = brute(of, docs[r.doc_id])
        assert (r.n_pieces, r.ids_crc32, r.score) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), score)
        assert r.same and r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_awkward_rows(spark, awkward, nothing):
    rows = pieces.encode_documents(awkward, PATH).collect()
    assert len(rows) == awkward.count()
    assert {r.n_pieces for r in rows if r.doc_id in (2, 3)} == {0}
    of = pieces.pieces(PATH)
    for r in pieces.decode_documents(pieces.encode_documents(awkward, PATH), PATH).collect():
        ids, score = brute(of, r.text)
        assert (np.frombuffer(r.ids, "<u4").tolist(), r.score) == (ids, score) and r.decoded == r.text
    assert pieces.encode_documents(nothing, PATH).count() == 0
