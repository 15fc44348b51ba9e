import zlib

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import language

D = 64


def _slowly(text):
    """A text's bundle letter by letter."""
    out = np.zeros(D, np.int64)
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = f" {' '.join(runs)} " if runs else ""
    sign = lambda c: language.letter_vectors(np.array([0 if c == " " else ord(c)]), D)[0].astype(np.int64)
    for a, b, c in zip(line, line[1:], line[2:]):
        out += np.roll(sign(a), 2) * np.roll(sign(b), 1) * sign(c)
    return out


TEXTS = ["The cat sat.", "", "  12 !! ", "a", "ÉTÉ ß İstanbul, ночь", "x\0y z", "日本語のテキスト" * 9, "the the the", "".join(map(chr, range(0x4E00, 0x4F00))), "B"]


def test_bundles():
    got = language.bundles(TEXTS, np.arange(len(TEXTS)), len(TEXTS), D)
    assert [g.tolist() for g in got] == [_slowly(t).tolist() for t in TEXTS]
    together = language.bundles(TEXTS, np.arange(len(TEXTS)) % 3, 3, D)
    assert together.tolist() == [sum(got[k::3]).tolist() for k in range(3)]


def test_slices(monkeypatch):
    """Triples held a few at a time, and numbered without a table, give the same."""
    whole = language.bundles(TEXTS, np.arange(len(TEXTS)), len(TEXTS), D)
    monkeypatch.setattr(language, "HELD", 7)
    monkeypatch.setattr(language, "TABLED", 2)
    assert (language.bundles(TEXTS, np.arange(len(TEXTS)), len(TEXTS), D) == whole).all()


def test_signs():
    v = language.letter_vectors(np.arange(200)).astype(int)
    assert set(np.unique(v)) == {-1, 1}
    assert np.abs(v @ v.T - np.eye(200, dtype=int) * language.DIMENSIONS).max() < 6 * language.DIMENSIONS**0.5


def test_brute_force(spark, awkward):
    docs = awkward.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "aa").when(F.col("doc_id") % 3 == 1, "bb")).withColumn("score", F.lit("clash"))
    by = language.profiles(docs, dimensions=D)
    told = {}
    for r in docs.collect():
        if r.text and r.lang:
            told[r.lang] = told.get(r.lang, 0) + _slowly(r.text)
    assert list(by) == ["aa", "bb"] and all((by[k] == told[k]).all() for k in by)
    got = language.predicted(docs, by)
    assert got.columns == [*docs.columns, "lang_pred"] and got.count() == docs.count()
    for r in got.collect():
        v = _slowly(r.text or "")
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            cosines = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in by.items()}
            assert r.lang_pred == max(cosines, key=cosines.get) and abs(r.score - max(0, max(cosines.values()))) < 1e-12


def test_nothing(spark, awkward, nothing):
    langs = F.lit(None).cast("string")
    assert language.profiles(awkward.withColumn("lang", langs)) == {}
    assert {(r.lang_pred, r.score) for r in language.predicted(awkward, {}).collect()} == {("und", 0.0)}
    assert language.predicted(nothing, {"aa": np.ones(language.DIMENSIONS)}).count() == 0


def test_held_out(spark):
    """Only documents that aren't held out teach; held-out accuracy of whole texts in four languages."""
    got = language.op12_language_id(spark, "/root/testdata/sf0.01")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r.held_out and r.lang]
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)
