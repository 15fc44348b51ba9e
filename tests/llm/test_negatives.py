import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import negatives

KIND = "id long, label int, vector array<float>, score long, n int"


def _brute(rows, step):
    """By scoring all rows: (anchor, positive, rank, negative, scores) as a sorted list."""
    good = []
    for i, label, v, *_ in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, q in good:
        if i % step:
            continue
        scored = [(-sum(a * b for a, b in zip(q, x)), j, other) for j, other, x in good if j != i and len(x) == len(q)]
        near = sorted((s, j) for s, j, other in scored if other == label)[:5]
        for s, j in near:
            far = sorted((t, k) for t, k, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(far, 1)]
    return sorted(out)


def _mined(df, step):
    return sorted(map(tuple, negatives.mine(df, F.col("id") % step == 0).collect()))


@pytest.mark.parametrize("kind", ["clustered", "lengths", "negative"])
def test_brute_force(spark, monkeypatch, kind):
    """Small buckets, so that lists, ranges and rising thresholds decide; ties; a third of all rows one vector."""
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "BUCKET", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rng = np.random.default_rng(len(kind))
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) * 0.3
    if kind == "lengths":
        x *= np.exp(rng.normal(size=(300, 1)) * 1.5)
    if kind == "negative":
        x = rng.normal(size=(300, 8)) * 0.05
    x[100:200] = x[100]
    rows = [(k, int(rng.integers(0, 3)), [float(v) for v in x[k]], 0, 0) for k in range(300)]
    got = _mined(spark.createDataFrame(rows, KIND).repartition(5), 10)
    assert got and got == _brute(rows, 10)


def test_ranges_lose_nothing():
    """Every row with the score is a candidate, and with a high threshold few others are."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(2000, 6)) * 200).astype(np.int64)
    cut = negatives.buckets(np.arange(2000), np.zeros(2000, np.int64), x, 256)
    assert sum(len(b.ids) for b in cut) == 2000
    spared = 0
    for q in x[:50]:
        length = float(np.sqrt((q.astype(float) ** 2).sum()))
        for b in cut:
            scores = b.x @ q
            for least in (0.0, float(np.quantile(scores, 0.99)), float(scores.max())):
                found = b.candidates(q, length, least)
                want = np.flatnonzero(scores >= least)
                assert found is None or set(want) <= set(found)
                spared += 0 if found is None else len(b.ids) - len(found)
    assert spared > 50 * 2000


def test_awkward(spark):
    """Nulls, non-finite entries, other lengths, zeros, repeated rows and anchors, few rows of a label, equal scores."""
    rows = [
        (0, 1, [1.0, 0.5], 0, 0), (0, 1, [1.0, 0.5], 0, 0), (1, 1, [1.0, 0.5], 0, 0), (2, 1, [1.0, 0.5], 0, 0), (3, 2, [1.0, 0.5], 0, 0), (3, 2, [1.0, 0.5], 0, 0), (4, 2, [0.9, 0.5], 0, 0),
        (5, None, [1.0, 0.5], 0, 0), (6, 2, None, 0, 0), (7, 2, [None, 1.0], 0, 0), (8, 2, [math.nan, 1.0], 0, 0), (9, 2, [], 0, 0), (None, 2, [1.0, 0.5], 0, 0), (10, 3, [0.0, 0.0], 0, 0), (11, 3, [0.0, 0.0], 0, 0),
        (20, 4, [1.0, 1.0, 1.0], 0, 0), (21, 4, [1.0, 1.0, 1.0], 0, 0), (22, 5, [1.0, 1.0, 0.9], 0, 0), (30, 9, [1.0, 0.5], 0, 0),
    ]
    df = spark.createDataFrame(rows, KIND)
    got = _mined(df, 10)
    assert got == _brute(rows, 10)
    assert {r[0] for r in got} == {0, 10, 20} and len([r for r in got if r[:3] == (0, 1, 1)]) == 2
    assert _mined(df.where("false"), 10) == [] and _mined(df.where("id = 1"), 10) == []


def test_large_components(spark):
    """Whole numbers beyond 2^53 are added up exactly."""
    rows = [(k, k % 2, [2.0**20 * (k + 1), 2.0**17 + k], 0, 0) for k in range(12)]
    assert _mined(spark.createDataFrame(rows, KIND), 10) == _brute(rows, 10)


def test_label_moves_on(spark, tmp_path):
    """Rows divisible by 7 have the next label: 7 becomes the anchor's fellow, 14 is one no longer."""
    rows = [(100, 9, [1.0]), (7, 8, [1.0]), (14, 9, [1.0]), (3, 9, [0.9])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = negatives.op13_hard_negatives(spark, str(tmp_path)).collect()
    assert [(r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got] == [(7, 1, 14, 65536, 65536)]
