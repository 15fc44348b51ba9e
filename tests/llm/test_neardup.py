import random
import re
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import graph, neardup

def brute(rows, size, percent):
    import re

    def shingles(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset({tuple(w)}) if w else frozenset())

    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(sets):
        for j in range(k):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(rows[k][0]), top(rows[j][0])))
                parent[y] = x
    return sorted((i, len(s), top(i), top(i) == i) for (i, _), s in zip(rows, sets))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)] + [(7, 7)]
    parent = {x: x for pair in links for x in pair}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    want = {x: top(x) for pair in links if pair[0] != pair[1] for x in pair}
    rows = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1), min_size=1, max_size=40))
def test_overlaps(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    assert neardup.overlaps(arrays).tolist() == [[len(a & b) for b in sets] for a in sets]


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(neardup.op9_minhash_near_dedup(spark, "/root/testdata/sf0.001")) == brute(rows, 3, 85)


def test_groups_at_the_threshold(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice((30, 80, 200)))]
        for _ in range(rng.choice((2, 3, 12))):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        assert got(neardup.near_duplicates(docs, size, percent)) == brute(rows, size, percent)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "TRIED", 2)
    assert got(neardup.near_duplicates(docs, 3, 85)) == brute(rows, 3, 85)


def test_chains_within_one_cluster(spark, monkeypatch):
    """A family whose neighbours are alike while its ends are not: parts of a cluster must meet across blocks."""
    rng = random.Random(9)
    line = [f"c{k}" for k in range(400)]
    rows = [(n, " ".join(line[4 * n : 4 * n + 100])) for n in range(60)] + [(100 + n, " ".join(line[4 * n : 4 * n + 100][::-1])) for n in range(20)]
    rows += [(200 + n, " ".join([*line[:100], *(f"r{n}.{k}" for k in range(rng.choice((3, 9, 40, 60))))])) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 1, 85)
    assert got(neardup.near_duplicates(docs, 1, 85)) == want and len({c for _, _, c, _ in want}) > 10
    monkeypatch.setattr(neardup, "BLOCK", 5)
    monkeypatch.setattr(neardup, "TRIED", 3)
    assert got(neardup.near_duplicates(docs, 1, 85)) == want


def test_several_texts_of_one_document(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, None), (4, "")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).select("doc_id", "component_id").distinct().collect()
    assert sorted(map(tuple, out)) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    df = neardup.op9_minhash_near_dedup(spark, "/root/testdata/sf0.01")
    want = con.sql(neardup.ORACLE).select(", ".join(df.columns)).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_crowded_regions_lose_nothing(spark):
    """What the forest finds of linked pairs where thousands share a frame: all, in families around the threshold."""
    rng = random.Random(2)
    frame = [f"f{k}" for k in range(120)]
    rows = []
    for family in range(150):
        own = [f"o{family}.{k}" for k in range(60)]
        for copy in range(4):
            rows.append((len(rows), " ".join([*frame, *own, *(f"n{family}.{copy}.{k}" for k in range(rng.randrange(4, 22)))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_duplicates(docs, 1, 85)) == brute(rows, 1, 85)


def test_awkward_rows(spark, awkward, nothing):
    from .conftest import AWKWARD

    rows = neardup.near_duplicates(awkward, 3, 85).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].kept and by_id[None].component_id is None
    assert all(r.kept for r in rows) and by_id[2].n_shingles == 0 and by_id[7].n_shingles == 1
    assert neardup.near_duplicates(nothing).count() == 0
    left = neardup.without_near_duplicates(awkward)
    assert left.columns == awkward.columns and left.count() == len(AWKWARD)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text), (3, text.upper()), (9, text + " more"), (1, "something else entirely here today")]
    left = neardup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_meeting():
    rng = np.random.default_rng(7)
    rows = rng.integers(0, 2, (60, neardup.PERMUTATIONS)).astype(np.uint8)
    agree = (rows[:, None] == rows[None]).sum(axis=2) * 2 >= neardup.PERMUTATIONS
    for n in (0, 1, 2, 60):
        group = np.arange(n)
        for x in range(n):
            for y in np.flatnonzero(agree[x, :n]):
                group[group == max(group[x], group[y])] = min(group[x], group[y])
        found = neardup.meeting(rows[:n])
        assert len(found) == n - len(set(group)) and all(agree[x, y] for x, y in found)


def test_crowded_boilerplate(spark, monkeypatch):
    # In all ten trees where documents 0 and 4001 share a region, others of the family are sorted between them.
    common = [f"b{k}" for k in range(100)]
    rows = [(n, " ".join([*common, *(f"x{n - 1}.{k}" for k in range(150))])) for n in range(1, 4001)]
    rows += [(n, " ".join([*common, *(f"{side}5153.{k}" for k in range(12))])) for n, side in ((0, "p"), (4001, "q"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((n, len(t.split()), 0 if n == 4001 else n, n != 4001) for n, t in rows)
    assert got(neardup.near_duplicates(docs, 1, 80)) == want
    monkeypatch.setattr(neardup, "CROWD", 16)
    assert got(neardup.near_duplicates(docs, 1, 80)) == want


def test_neighbours_of_a_sorted_order():
    rng = np.random.default_rng(11)
    rows = np.repeat(rng.integers(0, 256, (12, neardup.PERMUTATIONS)).astype(np.uint8), 9, axis=0)
    rows = np.where(rng.random(rows.shape) < 0.2, rng.integers(0, 256, rows.shape), rows).astype(np.uint8)[rng.permutation(108)]
    regions = np.repeat([3, 5, 9], (1, 47, 60))
    want = set()
    for x in range(108):
        for side in (range(x + 1, min(108, x + neardup.REACH + 1)), range(x - 1, max(-1, x - neardup.REACH - 1), -1)):
            y = next((y for y in side if regions[x] == regions[y] and 2 * (rows[x] == rows[y]).sum() >= neardup.PERMUTATIONS), None)
            if y is not None:
                want.add((min(x, y), max(x, y), int((rows[x] == rows[y]).sum())))
    assert set(zip(*map(np.ndarray.tolist, neardup.neighbours(regions, rows)))) == want and len(want) > 50
    assert all(len(x) == 0 for n in (0, 1) for x in neardup.neighbours(regions[:n], rows[:n]))


def test_meeting_of_what_belongs_together_already():
    rng = np.random.default_rng(13)
    rows = rng.integers(0, 2, (50, neardup.PERMUTATIONS)).astype(np.uint8)
    main = np.arange(50) % 3 == 0
    agree = (rows[:, None] == rows[None]).sum(axis=2) * 2 >= neardup.PERMUTATIONS
    found = neardup.meeting(rows, main)
    assert all(agree[x, y] and not (main[x] and main[y]) for x, y in found)

    def groups(links):
        group = np.where(main, 0, np.arange(50))
        for x, y in links:
            group[group == max(group[x], group[y])] = min(group[x], group[y])
        return group.tolist()

    assert groups(found) == groups([(x, y) for x in range(50) for y in range(50) if x != y and agree[x, y]])


def test_no_function_runs_twice_in_a_plan(spark, monkeypatch):
    plans = []

    def written(df, name, write=neardup.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(neardup, "written", written)
    neardup.op9_minhash_near_dedup(spark, "/root/testdata/sf0.001")
    # A function that runs twice in a task takes two Python workers of every core.
    found = [re.findall(r"(?:EvalPython|InArrow) \[?(\w+)\(", plan) for plan in plans]
    assert sum(map(len, found)) >= 6 and all(len(names) == len(set(names)) for names in found), found


def test_memory_of_two_full_blocks():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 600, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(600) < 0.12, rng.integers(0, 2**63, 600, dtype=np.uint64), words)) for _ in range(2 * neardup.BLOCK)]
    tracemalloc.start()
    found = neardup.spanning(sets, 85)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110e6 and len(found) < len(sets)
