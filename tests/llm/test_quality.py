from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import quality


def brute(words, size=5):
    grams = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    covered = set()
    for i in range(len(words) - size + 1):
        if grams[tuple(words[i : i + size])] > 1:
            covered.update(range(i, i + size))
    return len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
def test_repeated_words(words):
    assert quality.repeated_words(words) == brute(words)


def test_repeated_words_of_many_kinds():
    words = [b"w%d" % (k * 7919 % 9001) for k in range(9001)]
    words += words[100:200] + [b"end"] + words[3:9]
    assert quality.repeated_words(words) == brute(words)


def test_measures():
    text = "ünï #a\nb b\n\nb b\n \nb b c".encode()
    assert quality.measure(text) == (9, 12, 1, 1, 6, 4)
    assert quality.measure(None) == quality.measure(b"") == (0,) * 6


def test_ledger_of_awkward_rows(spark, awkward, nothing):
    rows = quality.ledger(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].failed_bits == by_id[3].failed_bits == by_id[4].failed_bits == 1
    assert by_id[6].n_words == by_id[6].n_repeat_words == 30_000
    assert quality.ledger(nothing).count() == 0
    left = quality.passing(awkward)
    assert left.columns == awkward.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in rows if not r.failed_bits}


def test_policies_and_ablations(spark):
    texts = ["good words all along the way to the end of it", "short", "## $$ %% && ** here are some symbols and words", "again and again so it goes " * 9, "#"]
    of = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    base, full = ({r.doc_id: r.kept for r in quality.judged(of, p).collect()} for p in (quality.BASE, quality.FULL))
    assert base == {0: True, 1: False, 2: True, 3: False, 4: False} and full == {0: True, 1: False, 2: False, 3: False, 4: False}
    bits = [r.failed_bits for r in of.collect()]
    for r in quality.ablations(of, quality.FULL).collect():
        bit = quality.Policy("", (r.rule,)).mask
        assert r.n_failed == sum(b & bit != 0 for b in bits) and r.n_only == sum(b == bit for b in bits)
        assert r.n_kept == 1 and r.n_kept_without == sum(b & ~bit == 0 for b in bits)
