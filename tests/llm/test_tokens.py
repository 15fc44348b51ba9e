import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import packing, token_store, tokens
from pagewright.llm.shared import new_folder, windows_of

PATH = tokens.tokenizer_path()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85'stremld.,İΣAé́<|>")), max_size=40))
def test_encoder_gives_the_library_s_ids(text):
    from tokenizers import Tokenizer

    global _TOKENIZER
    try:
        tokenizer = _TOKENIZER
    except NameError:
        tokenizer = _TOKENIZER = Tokenizer.from_file(PATH)
    text += " <|endoftext|>x <|startoftext|> <|STARTOFTEXT|> H\u0331. I\u0307, It'S. A.. b,. \u00e9. x\u0301, 5."
    assert np.frombuffer(tokens.encoder(PATH).encode([text.encode()])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_on_every_plain_character():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    characters = [chr(c) for c in range(0x250) if not chr(c).isspace()]
    texts = [f"{a} x{a} {a}x {a}{b}. {b}{a}{a}q 1{a}2" for a in characters for b in ("e", "É", "$", "7")]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_encoder_that_remembers_little():
    small, large = tokens.Encoder(PATH, most=3), tokens.Encoder(PATH)
    texts = [b"one two three four", None, b"", b"five one two six"]
    assert small.encode(texts) == large.encode(texts) and small.encode(texts) == large.encode(texts)
    assert not small.young and len(small.old) <= 7


def test_windows_hash_runs_of_items():
    items = np.array([1, 2, 3, 4, 1, 2, 3, 4, 5], np.uint64)
    for size in range(1, 9):
        hashes = windows_of(items, size)
        assert len(hashes) == 10 - size
        for i in range(len(hashes)):
            for j in range(len(hashes)):
                assert (hashes[i] == hashes[j]) == (items[i : i + size].tolist() == items[j : j + size].tolist())


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49_000, 20_000).astype(np.uint32)
    (at,) = token_store.cuts(ids, [len(ids)])
    assert at[-1] == len(ids) and all(token_store.LEAST <= b - a <= token_store.MOST for a, b in zip([0, *at], at[:-1]))
    (moved,) = token_store.cuts(np.concatenate([ids[:5], ids]), [len(ids) + 5])
    assert len({len(ids) - a for a in at} & {len(ids) + 5 - a for a in moved}) > 0.8 * len(at)
    assert token_store.cuts(np.zeros(10_000, np.uint32), [10_000])[0][-1] == 10_000 and token_store.cuts(ids[:1], [1]) == [[1]]
    # Documents that stand one after the other are cut as each by itself.
    lengths = [1, 7_000, 15, 16, 5_000, 63, 64, 7_841]
    starts = np.cumsum([0, *lengths[:-1]])
    alone = [[int(a) + s for a in token_store.cuts(ids[s : s + n], [n])[0]] for s, n in zip(starts.tolist(), lengths)]
    assert token_store.cuts(ids, lengths) == alone


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_checksums_join(a, b):
    assert token_store.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def expected(rows, plain, end):
    return sorted(((i, [*plain(t), end]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))


def test_store_round_trip(spark, awkward, plain):
    from .conftest import AWKWARD

    store = token_store.write_store(awkward, new_folder(spark, "t"), PATH, 2)
    want = expected(AWKWARD, plain, 2)
    read = sorted(token_store.read_store(store, spark).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in read] == [i for i, _ in want]
    start = 0
    for r, (_, ids) in zip(read, want):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = Counter((r.doc_id, tuple(r.ids)) for r in token_store.reconstruct(store, spark).collect())
    assert got == Counter((i, tuple(ids)) for i, ids in want)
    keys = [r.key for r in store.chunks(spark).collect()]
    assert len(keys) == len(set(keys))
    assert sum(r.n_docs for r in store.manifest(spark).collect()) == len(want)


def test_empty_store(spark, nothing):
    store = token_store.write_store(nothing, new_folder(spark, "t"), PATH, 2)
    assert token_store.read_store(store, spark).count() == 0 and token_store.reconstruct(store, spark).count() == 0
    assert store.manifest(spark).count() == 0


def test_other_tokenizers_encode_whole_texts(plain):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    own, library = tokens.Encoder(path), Tokenizer.from_file(path)
    texts = ["  two  spaces, and It's", "", "ünï 12345\n\tx"]
    assert not own.by_word and tokens.Encoder(PATH).by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture
def store(spark, awkward):
    return token_store.write_store(awkward, new_folder(spark, "t"), PATH, 2)


def replaced(spark, folder, change):
    """The table in folder, changed."""
    whole = spark.read.parquet(folder)
    changed = spark.createDataFrame([tuple(r) for r in change(whole.collect())], whole.schema)
    changed.coalesce(1).write.mode("overwrite").parquet(folder)


def refused(spark, store, message):
    with pytest.raises(Exception, match=message):
        token_store.read_store(store, spark).collect()


def test_a_changed_chunk_is_found(spark, store):
    broken = store.chunks(spark).selectExpr("key", "n_tokens", "concat(substring(body, 1, 1), X'0102', substring(body, 4)) AS body")
    with pytest.raises(Exception, match="doesn't hold"):
        broken.select(token_store._checked("key", "body")).collect()


def test_a_lost_chunk_is_found(spark, store):
    replaced(spark, f"{store.path}/objects/kind=chunk", lambda rows: rows[1:])
    refused(spark, store, "no chunk")
    with pytest.raises(Exception, match="is lost"):
        token_store.reconstruct(store, spark).collect()


def test_a_lost_recipe_is_found(spark, store):
    replaced(spark, f"{store.path}/recipes", lambda rows: rows[:-1])
    refused(spark, store, "what the manifest says")


@pytest.mark.parametrize("column,value", [("n_tokens", 3), ("root", bytes(16)), ("hashes", bytes(16))])
def test_a_changed_recipe_is_found(spark, store, column, value):
    def change(rows):
        return [{**rows[0].asDict(), column: value}.values(), *rows[1:]]

    replaced(spark, f"{store.path}/recipes", change)
    refused(spark, store, "no chunk" if column == "hashes" else "what the manifest says")


@pytest.mark.parametrize("change", [lambda rows: rows[:-1], lambda rows: [{**rows[0].asDict(), "n_docs": 77}.values(), *rows[1:]]])
def test_a_changed_manifest_is_found(spark, store, change):
    replaced(spark, f"{store.path}/manifest", change)
    refused(spark, store, "the store's root")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=14))
def test_bins_are_as_few_as_can_be(lengths):
    bins = packing.complete_bins(lengths, 30, packing.Bounds(nodes=20_000))
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 30 for b in bins)
    assert len(bins) <= len(packing.best_fit(lengths, 30))

    def fits(k):
        rooms = [30] * k

        def place(rest):
            if not rest:
                return True
            tried = set()
            for j in range(k):
                if rooms[j] >= rest[0] and rooms[j] not in tried:
                    tried.add(rooms[j])
                    rooms[j] -= rest[0]
                    if place(rest[1:]):
                        return True
                    rooms[j] += rest[0]
            return False

        return place(sorted(lengths, reverse=True))

    assert not bins or not fits(len(bins) - 1)
    few, proved = packing.completed(lengths, 30, packing.Bounds(2, 3, 1, 2, 0))
    assert sorted(i for b in few for i in b) == list(range(len(lengths))) and (not proved or len(few) == len(bins))


def test_branch_and_bound_beats_best_fit():
    lengths = [6, 5, 5, 4, 4, 3, 3]  # 30 in bins of 10: best fit may take 4
    assert len(packing.complete_bins(lengths, 10)) == 3
    lengths = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    assert len(packing.best_fit(lengths, 61)) == 4 and len(packing.complete_bins(lengths, 60)) == 3


def test_dominance():
    assert packing.dominates((7,), (4, 3)) and not packing.dominates((4, 3), (7,))
    assert packing.dominates((5, 5), (3, 2, 5)) and not packing.dominates((6, 3), (5, 4))


def check_packed(rows, docs, plain, end, capacity):
    by_sequence = {}
    ids = Counter((i, tuple([*plain(t), end])) for i, t in docs)
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for (i, whole), times in ids.items():
        for n, s in enumerate(range(0, len(whole), capacity)):
            part = whole[s : s + capacity]
            want[i, n, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += times
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by_sequence)


@pytest.mark.parametrize("lot", [4096, 3])
def test_packing(spark, awkward, plain, monkeypatch, lot):
    from .conftest import AWKWARD

    monkeypatch.setattr(packing, "LOT", lot)
    monkeypatch.setattr(packing, "AGAIN", min(packing.AGAIN, lot // 3))
    rows = packing.pack(packing.pieces(awkward, PATH, 1)).collect()
    n = check_packed(rows, AWKWARD, plain, 1, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + (lot < 10) * 3


def test_packing_nothing(nothing):
    assert packing.pack(packing.pieces(nothing, PATH, 1)).count() == 0


def test_packing_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.op3_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    n = check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()], plain, 1, 4096)
    assert n == -(-sum(r.length for r in rows) // 4096)


def test_store_of_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want, start = [], 0
    for i, ids in expected([(r.doc_id, r.text) for r in docs], plain, 2):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    rows = token_store.op2_token_store(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_fillings_from_sorted_sizes_are_those_of_a_plain_search():
    """Dominance against trying all ways to deal, and fillings from the sorted sizes against a plain enumeration."""
    rng = random.Random(3)
    for _ in range(300):
        a, b = (tuple(sorted((rng.randint(1, 12) for _ in range(rng.randint(0, 4))), reverse=True)) for _ in range(2))
        dealt = any(all(sum(s for s, k in zip(b, where) if k == n) <= room for n, room in enumerate(a)) for where in itertools.product(range(len(a)), repeat=len(b)))
        assert packing.dominates(a, b) == dealt, (a, b)
    for _ in range(100):
        counts, room = Counter(rng.randint(1, 9) for _ in range(6)), rng.randint(1, 20)
        items = sorted(counts.elements(), reverse=True)
        every = {tuple(x for x, on in zip(items, mask) if on) for mask in itertools.product((0, 1), repeat=len(items))}
        maximal = {f for f in every if sum(f) <= room and not any(n > f.count(s) and s <= room - sum(f) for s, n in counts.items())}
        found, whole = packing.fillings(counts, room, room, packing.Bounds(1000, 1000, 1000))
        assert whole and set(found) <= maximal and all(any(packing.dominates(f, g) for f in found) for g in maximal)
