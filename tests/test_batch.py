"""Many queries at once: what one query's answer says, for all of a table."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.functions import query as query_of
from pagewright.operators import answer, index, repair, search
from pagewright.plans import catalog
from tests.test_catalog import read_of

SF = "/root/testdata/sf0.001"


def _site(spark, path, texts, repairs=True):
    pages = spark.createDataFrame([(n, f"/p/{n}/", f"Page {n}", "Cakes", n % 2) for n in range(len(texts))], "page_id long, url string, title string, section string, order_ int").withColumn("also", F.lit(None).cast("string"))
    blocks = [(n, k, "top" if k else None, "Mixing" if k else None, t) for n, ts in enumerate(texts) for k, t in enumerate(ts)]
    blocks = spark.createDataFrame(blocks, "page_id long, block_seq int, anchor string, heading string, text string")
    return index.build(pages, blocks, f"{path}/index", repairs=repairs)


TEXTS = [["Kneading the Crémeuse", "kneaded twice"], ["raisin bread, crust", "flour flower flowed"], ["e-mail a baker", "x = 2 and y"], [f"line {k} of dough" for k in range(80)]]
#: Queries and, by hand, how they are answered, what was looked for instead, and the rows in site order (pages 0 and 2 before 1 and 3).
ANSWERED = {
    "bread": (None, None, [(1, 0)]),
    "cremeusing": ("only", "Crémeuse", [(0, 0)]),
    "kneadxy": ("root", None, [(0, 0), (0, 1)]),
    "xaisin": ("corrected", "raisin", [(1, 0)]),
    "crusb raisin": ("corrected", "crust", [(1, 0)]),
    "e-mail": (None, None, [(2, 0)]),
    "x=2": (None, None, [(2, 1)]),
    "mixing kneaded": (None, None, [(0, 1)]),
    "mixing line 79": (None, None, [(3, 79)]),
    "dough": (None, None, [(3, k) for k in range(80)]),
    "page 1": (None, None, [(1, -1)]),
    "baker bread": ("none", None, []),
    "zzzzzz": ("none", None, []),
    "x": ("none", None, []),
    "": ("none", None, []),
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    return _site(spark, tmp_path_factory.mktemp("batch"), TEXTS)


def test_answers_by_hand(spark, stored):
    queries = spark.createDataFrame([*enumerate(ANSWERED), (-1, None), (-2, "bread")], "query_id int, query string")
    got = {}
    for r in answer.answer_batch(stored, queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, (r.how, r.instead, []))[2].append((r.page_id, r.block_seq))
    assert {q: got.get(k, ("none", None, [])) for k, q in enumerate(ANSWERED)} == ANSWERED
    assert got[-2] == ANSWERED["bread"] and -1 not in got
    assert answer.answer_batch(stored, queries.where("false")).count() == 0


def test_each_is_its_answer(spark):
    """Misspelt pairs of benchmark words: some of every outcome, each as `answer` has it."""
    whole = catalog._index(spark, SF, repairs=True)
    queries = catalog._misspelt_pairs(spark, SF).where("query_id < 100000")
    got, by_how = {}, {}
    for r in answer.answer_batch(whole, queries, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, (r.how, r.instead, []))[2].append((r.page_id, r.block_seq))
    for r in queries.orderBy("query_id").collect():
        by_how.setdefault(got.get(r.query_id, ("none",))[0], []).append(r)
    assert set(by_how) == {None, "root", "corrected", "only", "none"}
    for r in (r for rs in by_how.values() for r in rs[:2]):
        one = answer.answer(whole, spark, r.query, 20)
        rows = [(x.page_id, x.block_seq) for x in one.rows.collect()]
        assert got.get(r.query_id, (None, None, [])) == ((one.how, one.instead, rows) if rows else (None, None, [])), r.query


def test_shown(spark, stored):
    queries = spark.createDataFrame([(1, "doug"), (2, "page 1"), (3, "x=2"), (4, "kneaded")], "query_id int, query string")
    rows = answer.shown_batch(stored, queries, search.search_batch(stored, queries, 3)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.kind, r.url, r.trail, r.snippet) for r in rows] == [
        (1, 1, 1, "/p/3/", "Cakes → Page 3", "line 0 of dough"), (1, 2, 1, "/p/3/#top", "Cakes → Page 3 → Mixing", "line 1 of dough"), (1, 3, 1, "/p/3/#top", "Cakes → Page 3 → Mixing", "line 2 of dough"),
        (2, 1, 0, "/p/1/", "Cakes", "Page 1"), (3, 1, 1, "/p/2/#top", "Cakes → Page 2 → Mixing", "x = 2 and y"), (4, 1, 1, "/p/0/#top", "Cakes → Page 0 → Mixing", "kneaded twice"),
    ]
    assert [[r.snippet[a:b] for a, b in r.marks] for r in rows] == [["dough"], ["dough"], ["dough"], ["Page", "1"], ["x = 2"], ["kneaded"]]


def test_snippets_by_rule(spark):
    """Each snippet is a part of its line, and each mark the beginning of a word of it that begins with one of the query's needles."""
    found = catalog.snippet_batch(spark, SF).collect()
    lines = {(r.doc_id, n): x for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for n, x in enumerate(y for y in (r.text or "").split("\n") if y)}
    asked = {r.query_id: r.query for r in catalog._benchmark_queries(spark, SF).collect()}
    assert len(found) > 1000
    for r in found:
        text = lines[r.page_id, r.block_seq] if r.block_seq >= 0 else f"Document {r.page_id}"
        assert r.snippet.strip("…") in text and query_of.answers(text, asked[r.query_id]) and r.marks >= 1


def test_lookups_are_brute_force(spark):
    """Words of all lengths: prefixes beyond those listed, halves and thirds; changed in one place and in two."""
    import random

    rng = random.Random(4)
    letters = "abcdefghr"
    words = {"".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 14, 20, 70, 80]))) for _ in range(250)}
    words |= {w[:66] + x for w in list(words) if len(w) > 66 for x in ("", "aa", "ab")}
    lexicon = {w: rng.randint(1, 3) for w in sorted(words)}

    def changed(w, times):
        for _ in range(times):
            w = w or "a"
            k, kind = rng.randrange(len(w)), rng.choice("dir")
            w = w[:k] + ("" if kind == "d" else rng.choice(letters) + (w[k] if kind == "i" else "")) + w[k + 1 :]
        return w or "a"

    asked = sorted({changed(w, n) for w in sorted(lexicon) for n in (0, 1, 2)} | {w[: rng.randint(1, len(w))] for w in sorted(lexicon)})
    df = spark.createDataFrame([(w,) for w in asked], "word string")
    of = spark.createDataFrame(list(lexicon.items()), "word string, weight long")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    near, stems, owners = {}, {}, {}
    for w in asked:
        most = 2 if len(w) >= 8 else 1 if len(w) >= 4 else 0
        best = []
        for spelling in {w, re.sub("r(?![aeiou])", "ri", w)} if most else ():
            for known, weight in lexicon.items():
                d = distance(spelling, known) if abs(len(known) - len(spelling)) <= most else 9
                if d <= most and (d <= 1 or spelling[:2] == known[:2]):
                    best.append((d, -weight, known))
        near[w] = min(best)[2] if best else None
        cuts = [w[:n] for n in range(max(4, -(-len(w) * 6 // 10)), len(w)) if any(k.startswith(w[:n]) for k in lexicon)]
        stems[w] = cuts[-1] if cuts else None
        begun = [k for k in lexicon if k.startswith(w)]
        owners[w] = begun[0] if len(begun) == 1 else None
    assert {r.word: r.nearest for r in repair.nearest(df, of).collect()} == near
    assert {r.word: r.stem for r in repair.widen(df, of).collect()} == stems
    assert {r.word: r.only for r in repair.only(df, of).collect()} == owners
    assert sum(v is not None for v in near.values()) > 100 and sum(len(v or "") > 64 for v in stems.values()) > 5


def test_stored_lookups_read_little(spark, stored, tmp_path):
    """A lookup of few words filters the stored tables by its keys, and none explodes the lexicon."""
    known = repair.Dictionary.of(spark.range(200_000).select(F.concat(F.lit("w"), F.col("id")).alias("word"), F.lit(1).cast("long").alias("weight"))).write(str(tmp_path / "d"))
    asked = spark.createDataFrame([("w1234x",), ("w77777",)], "word string")
    for lookup, column in ((repair.nearest, "key"), (repair.widen, "prefix"), (repair.only, "prefix")):
        of = lookup(asked, known, few=repair.FEW)
        plan = of._jdf.queryExecution().executedPlan().toString()
        assert f"EqualTo({column}" in plan, lookup
        table = "near" if lookup is repair.nearest else "prefixes"
        rows, files = read_of(of, f"/d/{table}]")
        assert rows < (known.near if lookup is repair.nearest else known.prefixes).count() / 5, (lookup, rows)
    assert {r.word: r.only for r in repair.only(asked, known, few=repair.FEW).collect()} == {"w1234x": None, "w77777": "w77777"}


def test_postings_are_made_and_stored_as_lists(spark, tmp_path, monkeypatch):
    """Lists hold the postings that grouped rows give, whatever a task holds at once; no posting is a row until it is asked for, and a part of the site is read as such."""
    rows = [(n % 2, None if n == 7 else n // 90, n % 90, f"w{n % 11} a{'b' * (n % 5)} common {'x = y' if n % 13 == 0 else ''} α") for n in range(400)]
    blocks = spark.createDataFrame(rows, "order_ int, page_id long, block_seq int, text string").withColumns({"anchor": F.lit(None).cast("string"), "heading": F.lit(None).cast("string")})
    pages = blocks.groupBy("page_id").agg(F.min("order_").alias("order_"), F.lit("common title").alias("title")).withColumn("also", F.lit(None).cast("string"))
    for size in (32, 64):
        stored = index.build(pages, blocks.drop("order_"), f"{tmp_path}/{size}", size)
        want = index.postings(stored.entries(spark), size).cache()
        got = stored.postings(spark)
        assert got.dtypes == want.dtypes and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
        assert stored.weights(spark).exceptAll(index.weights(want)).count() == 0
        listed = spark.read.parquet(f"{tmp_path}/{size}/postings")
        assert 0 < listed.count() < want.count()
        asked = spark.createDataFrame([("common", 1), ("w3", 2), ("none", 3)], "word string, of int")
        for low, high in ((None, None), (None, (0, 2)), ((0, 1), (1, 3)), ((1, 2), None)):
            rest = asked.join(want, "word").where(index.between(low, high)).select("word", "of", *index.SITE, "blocks")
            mine = stored.posted(spark, asked, low, high).select(*rest.columns)
            assert sorted(map(tuple, mine.collect()), key=repr) == sorted(map(tuple, rest.collect()), key=repr)
    # A task that holds few postings puts out many lists, which say the same.
    monkeypatch.setattr(index, "HELD", 3)
    columns = ["order_", "page_id", "chunk", "bit", "marked", "squeezed"]
    batch = pa.RecordBatch.from_pydict(dict(zip(columns, zip(*((0, n // 4, 0, n % 4, f"a w{n} a", "") for n in range(40))))))
    out = [r for b in index._lots(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["word"], h["page_id"], h["blocks"]) for r in out for h in r["held"]) == sorted([*(("a", p, 15) for p in range(10)), *((f"w{n}", n // 4, 1 << n % 4) for n in range(40))])
    assert len([r for r in out if r["word"] == "a"]) == 10 and all((r["from_page"], r["to_page"]) == (h["page_id"],) * 2 for r in out for h in r["held"])
