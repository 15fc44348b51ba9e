import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm import quality
from pagewright.llm.tokens import tokenizer_path

from .test_neardup import brute as components
from .test_substrings import brute as removal

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bits = dict((r.doc_id, r.failed_bits) for r in quality.ledger(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    docs = {i: t for i, t in docs.items() if not bits[i]}
    kept = {i for i, _, component, first in components(sorted(docs.items()), 5, 80) if first}
    rows = sorted((i, t) for i, t in docs.items() if i in kept)
    texts = [kept_text for _, _, kept_text in removal([t for _, t in rows], 35)]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for (i, _), text in zip(rows, texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for n, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[i, n, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 4096)


def test_stages_keep_the_columns(spark, awkward):
    docs = spark.createDataFrame(
        [(1, "plain different words stand here one after the other " * 1, "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == COLUMNS and out.dtypes == docs.dtypes
        stage(spark, docs.where("false"), SF).collect()
    left = corpus_pipeline.quality_rules(spark, docs, SF).collect()
    assert [r.doc_id for r in left] == []  # nine words are too few
    assert corpus_pipeline.near_dedup(spark, docs, SF).count() == 3
    texts = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.substring_dedup(spark, docs, SF).collect()}
    assert texts[2] == (None, None) and texts[3] == ("", 0) and texts[1][0] == "plain different words stand here one after the other"


AWKWARD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rid string, body string, n_words int, kept_text string, _row int, _measures string, part int, lot int, sequence_id string"


def test_stages_on_awkward_rows(spark):
    from .conftest import AWKWARD

    rows = [(i, t, None, None, None, "r", "b", 7, "k", 1, "m", 2, 3, "s") for i, t in AWKWARD]
    docs = spark.createDataFrame(rows, AWKWARD_COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        for r in out.collect():
            assert tuple(r)[5:] == ("r", "b", 7, "k", 1, "m", 2, 3, "s")
        assert stage(spark, docs.where("false"), SF).count() == 0
    packed = corpus_pipeline.best_fit_packing(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _ in AWKWARD) and max(r.piece for r in packed) == 7
    assert all(r.proved for r in packed) and corpus_pipeline.best_fit_packing(spark, docs.where("false"), SF).count() == 0
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()} <= {i for i, _ in AWKWARD}
    # Of the rows that repeat one stays; those without words, and the one without an id, stay too.
    assert Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == Counter({i for i, _ in AWKWARD})


def test_order():
    assert [re.sub("_.*", "", n) for n, _ in corpus_pipeline.STAGES] == ["quality", "minhash", "substring", "best"]


@pytest.mark.parametrize("text,failed", [("one two three four five six seven eight nine ten", 0), ("a", 1), ("", 1), ("x y z w q " * 30, 2 | 16), ("#### word$$ " * 40, 2 | 4)])
def test_rules(spark, text, failed):
    row = quality.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.failed_bits & 7 == failed & 7


def test_copies_without_an_id_of_their_own_stay_once(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(4, a), (4, a), (None, b), (None, b + " more"), (7, c), (7, b), (3, a.upper()), (None, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, [(3, a.upper()), (7, b), (7, c), (None, None), (8, None)]))
    texts = [r.text for r in corpus_pipeline.substring_dedup(spark, left, "").where("doc_id IN (3, 7)").collect()]
    assert sorted(texts) == sorted([a.upper(), b, c])
