import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import substrings
from pagewright.llm.shared import hashed_words, windows_of


def brute(texts, window):
    lists = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding_min(items, size):
    x = np.array(items, np.uint64)
    if len(x) >= size:
        assert substrings.sliding_min(x, size).tolist() == [min(items[i : i + size]) for i in range(len(items) - size + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aab"), max_size=40), max_size=5), st.integers(2, 6), st.sampled_from([64, 8]))
def test_automaton_locates_whatever_recurs(texts, window, bits):
    joined = [" ".join(t).encode() for t in texts]
    mask = np.uint64((1 << bits) - 1) << np.uint64(64 - bits)
    *lanes, counts = hashed_words(joined, 2)
    inside = substrings._inside(counts, window)
    a, b = (windows_of(lanes[0], window) & mask)[inside[: max(0, len(lanes[0]) - window + 1)]], windows_of(lanes[1], window, substrings._OTHER)[inside[: max(0, len(lanes[0]) - window + 1)]]
    group = pa.table({"part": pa.array([7], pa.int32()), "hashes": [a.tobytes()], "others": [b.tobytes()]})
    owned = substrings.Owned(substrings._owners(group) if len(a) else group.slice(0, 0).append_column("sizes", pa.array([], pa.binary())).append_column("holders", pa.array([], pa.binary())))
    sent = substrings.phrases_of(joined, owned, window, mask)
    assert set(sent) <= {7}
    got = [(len(w), 0 if gone is None else int(gone.sum())) for w, gone in substrings.covered_words(joined, sent.get(7, []), window)]
    assert got == [(x, y) for x, y, _ in brute([" ".join(t) for t in texts], window)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b\x0c\r\x1c\x85 ", max_size=30)), max_size=6))
def test_hashed_words(texts):
    data = [None if t is None else t.encode() for t in texts]
    lists = [(t or b"").split() for t in data]
    hashes, counts = hashed_words(data)
    assert counts.tolist() == [len(x) for x in lists]
    words = [w for x in lists for w in x]
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
    assert len(set(zip(words, hashes.tolist()))) == len(set(words))


def test_long_words():
    texts = [b"x" * 5000 + b" " + b"x" * 4999 + b" y", b"", b"x" * 5000]
    hashes, counts = hashed_words(texts)
    assert counts.tolist() == [3, 0, 1] and hashes[0] == hashes[3] and len(set(hashes.tolist())) == 3


def corpus():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [draw(n) for n in (34, 35, 36, 60, 300)]
    texts = []
    for k in range(60):
        t = draw(rng.randrange(5, 120))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            i, j = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            at = rng.randrange(len(t))
            t[at:at] = p if rng.random() < 0.5 else p[i:j]
        texts.append(" ".join(t))
    texts += [texts[0], texts[1] + " end", "x " * 100, "x y " * 60, " ".join(passages[3]), None, ""]
    return texts


@pytest.mark.parametrize("window,seed,bits", [(35, 8, 64), (10, 3, 64), (35, 8, 16), (10, 3, 6)])
def test_removal(spark, window, seed, bits):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "other") for k, t in enumerate(texts)], "doc_id long, text string, part string")
    rows = substrings.remove_repeated(docs, window=window, seed=seed, bits=bits).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_text) for r in rows] == brute(texts, window)
    assert all(r.part == "other" for r in rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = [(d.doc_id, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in zip(docs, brute([d.text for d in docs], 35))]
    rows = substrings.op6_substring_dedup(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == want and any(n for _, _, n, _ in want)


def test_awkward_rows(spark, awkward, nothing):
    from .conftest import AWKWARD

    rows = substrings.remove_repeated(awkward).collect()
    want = Counter(zip([i for i, _ in AWKWARD], brute([t for _, t in AWKWARD], 35)))
    assert Counter((r.doc_id, (r.n_words, r.n_removed, r.kept_text)) for r in rows) == want
    assert substrings.remove_repeated(nothing).count() == 0
    left = substrings.without_repeated(awkward)
    assert left.columns == awkward.columns and left.count() == len(AWKWARD)


def test_columns_stay_as_they_are(spark):
    words = " ".join(f"w{k}" for k in range(50))
    rows = [(1, words, 777, "mine", {"k": [{"m": 1}]}, 5), (2, words + " end", 778, "too", None, 6), (3, None, 1, None, {}, 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_words int, kept_text string, m map<string,array<map<string,int>>>, _part int")
    left = substrings.without_repeated(docs)
    assert left.dtypes == docs.dtypes
    assert sorted(tuple(r) for r in left.collect()) == [(1, "", 777, "mine", {"k": [{"m": 1}]}, 5), (2, "end", 778, "too", None, 6), (3, None, 1, None, {}, 7)]
    seen = substrings.remove_repeated(docs).orderBy("doc_id").collect()
    assert [(r.n_words, r.kept_text, r._part) for r in seen] == [(50, "", 5), (51, "end", 6), (0, "", 7)]
