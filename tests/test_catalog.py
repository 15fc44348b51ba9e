"""Every query against its SQL on the smallest tables, and what has no SQL against plain Python."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pagewright.functions import formulas
from pagewright.functions import query as queries_of
from pagewright.operators import answer, index, search
from pagewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(names, found):
    return sorted((tuple(r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_agrees(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    relation = con.sql(catalog.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    want = relation.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert rows(columns, df.select(*columns).collect()) == rows(columns, want)


def test_every_query_is_listed():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 100


ASKED = ("the and", "ver keit", "que", "$$", "|", "Document 7", "elle la", "nothinglikethis", "ing's the", "über", "an", "a", "e.", "document 19", "ñ", "#", "t", "sein. der")


@pytest.fixture(scope="module")
def stored(spark):
    return catalog._index(spark, SF)


def test_index_search_is_scan_search(spark, stored):
    entries, postings = stored.entries(spark).cache(), stored.postings(spark).cache()
    texts = {(r.page_id, r.block_seq): (r.heading, r.text) for r in entries.select("page_id", "block_seq", "heading", "text").collect()}
    for q in ASKED:
        scan = [tuple(r) for r in search.search(entries, q, 10**6).select("page_id", "block_seq").collect()]
        assert [tuple(r) for r in search.search_by_index(entries, postings, q, 10**6).select("page_id", "block_seq").collect()] == scan
        assert set(scan) == {k for k, (h, t) in texts.items() if queries_of.answers(f"{h or ''} {t}", q)}, q


@pytest.mark.parametrize("first,further", [(5, 3), (2048, 16)])
def test_batch_is_search(spark, stored, first, further):
    benchmark = [" ".join(r.text.split()[n : n + k]) for n, k, r in zip(range(32), (1, 2, 3, 4) * 8, spark.read.parquet(f"{SF}/benchmark.parquet").limit(32).collect())]
    asked = [*ASKED, *benchmark, "", None, " x "]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {}
    for r in search.search_batch(stored, queries, 20, first, further).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.page_id, r.block_seq))
    entries = stored.entries(spark).cache()
    for n, q in enumerate(asked):
        want = [tuple(r) for r in search.search(entries, q, 20).select("page_id", "block_seq").collect()] if q and queries_of.asks(q) else []
        assert got.get(n, []) == want, q


def test_no_nested_loops(spark):
    for name in ("nearest_word", "widen_stem", "correct_query", "prefix_owner", "two_tier_search"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_searches_are_small_plans_over_stored_rows(spark):
    for name in ("search_and", "search_count", "two_tier_search", "palette_pick"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert len(plan) < 12_000 and "regexp_replace" not in plan.replace("regexp_replace(regexp_replace(title", ""), name
    assert "StringStartsWith(word,que)" in catalog.candidates_intersect(spark, SF)._jdf.queryExecution().executedPlan().toString()


def read_of(df, table):
    """(rows, files): how many rows the scans of a stored table gave when df ran, and of how many files."""
    df.collect()
    plan, rows, found = df._jdf.queryExecution().executedPlan(), 0, 0
    queue = [plan]
    while queue:
        node = queue.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            queue.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            queue.append(node.plan())
        if node.nodeName().startswith("Scan parquet") and table in node.toString():
            metrics = node.metrics()
            rows += metrics.apply("numOutputRows").value()
            found += metrics.apply("numFiles").value()
        queue += [node.children().apply(k) for k in range(node.children().size())]
    return rows, found


def test_rare_words_read_little(spark, tmp_path_factory):
    """A pair of rare words: of the stored entries, the pages in which both stand are read, and no others."""
    sf = "/root/testdata/sf0.01"
    stored = catalog._index(spark, sf)
    entries = stored.entries(spark)
    every = entries.count()
    rare = stored.weights(spark).where("weight = 1 AND word RLIKE '^[a-z]{8,}$'").select("word")
    pair = stored.postings(spark).join(rare, "word").groupBy("page_id", "chunk", "blocks").agg(F.sort_array(F.collect_list("word")).alias("ws")).where("size(ws) > 1").orderBy("page_id", "chunk").first()
    q = " ".join(pair.ws[:2])
    found = search.search_by_index(entries, stored.postings(spark), q)
    rows, _ = read_of(found, "marked")
    scan, _ = read_of(search.search(entries, q), "marked")
    assert 0 < rows * 10 < every and rows < scan
    assert [r.page_id for r in found.collect()] == [pair.page_id]


@pytest.fixture(scope="module")
def lines(spark):
    out = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        for n, line in enumerate(x for x in (r.text or "").split("\n") if x):
            out[r.doc_id, n] = line
    return out


def test_formula_pairs(spark, lines):
    """In these texts formulas are words with a sign or glyph, and lone characters beside them."""
    import re

    signed = re.compile(r"[\\\\^_{}=+<>|]|(^|[^a-z0-9])-|-($|[^a-z0-9])")
    chunks = {}
    for (page, n), line in lines.items():
        if "$" in line.replace("$$$", "") or "\\" in line or "_" in line or "^" in line or "~" in line:
            continue  # what could be fenced or scripted is left to the tests of formulas
        words = line.lower().split()
        flags = [bool(signed.search(w)) for w in words]
        lone = [bool(re.fullmatch("[a-z0-9]", w)) for w in words]
        whole = [f or lone[k] and (k + 1 < len(words) and flags[k + 1] or k > 0 and flags[k - 1]) for k, f in enumerate(flags)]
        run = ""
        for w, f in [*zip(words, whole), ("", False)]:
            run = run + w.replace("{", "").replace("}", "") if f else run
            if not f:
                for a, b in zip(run, run[1:]):
                    chunks.setdefault(f"${a}{b}", set()).add((page, n // 32))
                run = ""
    got = {r.word: r.chunks for r in catalog.formula_bigrams(spark, SF).collect()}
    sure = {w: len(c) for w, c in chunks.items() if w.isascii()}
    assert sure and {w: got.get(w, 0) >= n for w, n in sure.items()} == dict.fromkeys(sure, True)


def test_formula_search(spark, lines):
    """The sign stands in formulas only, and whatever holds it is one."""
    want = [k for k, line in sorted(lines.items()) if "|" in line][:100]
    assert [(r.page_id, r.block_seq) for r in catalog.formula_search(spark, SF).collect()] == want and want


def test_snippet_rows(spark, lines):
    """By the window's rules: from a word near 60 characters before the first mark, 240 characters and a word's end."""
    import re

    got = catalog.snippet_rows(spark, SF).collect()
    assert len(got) == 100
    for r in got:
        line = lines[r.page_id, r.block_seq]
        places = [m.span() for m in re.finditer(r"(?<![a-zà-ÿ0-9])(the|and)[a-z0-9]*", line.lower())]
        assert places and r.snippet.strip("…") in line
        start = max(0, places[0][0] - 60)
        start = line.find(" ", start) + 1 if start and 0 <= line.find(" ", start) < start + 20 else start
        end = start + 240 if start + 240 < len(line) else len(line)
        end = re.compile("[a-z0-9]*").match(line.lower(), end).end()
        if line.isascii() and "$" not in line:
            assert r.snippet == ("…" if start else "") + line[start:end] + ("…" if end < len(line) else "")
            assert r.marks == len([p for p in places if p[0] < end])


def site(spark, tmp_path, texts):
    pages = spark.createDataFrame([(n, f"/p/{n}/", f"Page {n}", "Cakes" if n else "Page 0", 0) for n in range(len(texts))], "page_id long, url string, title string, section string, order_ int").withColumn("also", F.lit(None).cast("string"))
    blocks = [(n, k, "top" if k else None, "Mixing" if k else None, t) for n, ts in enumerate(texts) for k, t in enumerate(ts)]
    return index.build(pages, spark.createDataFrame(blocks, "page_id long, block_seq int, anchor string, heading string, text string"), str(tmp_path / "index"))


def test_shown(spark, tmp_path):
    stored = site(spark, tmp_path, [["knead the dough", "dough again"], ["no such thing", "Dough rests"]])
    rows = answer.shown(stored.entries(spark), stored.pages(spark), queries_of.parse("dough"), limit=2).orderBy("rank").collect()
    assert [(r.rank, r.kind, r.url, r.trail, r.snippet, r.found) for r in rows] == [
        (1, 1, "/p/0/", "Page 0", "knead the dough", 3), (2, 1, "/p/0/#top", "Page 0 → Mixing", "dough again", 3)
    ]
    assert [[r.snippet[a:b] for a, b in r.marks] for r in rows] == [["dough"], ["dough"]]
    rows = answer.shown(stored.entries(spark), stored.pages(spark), queries_of.parse("page 1")).collect()
    assert [(r.kind, r.url, r.trail, r.snippet) for r in rows] == [(0, "/p/1/", "Cakes", "Page 1")]
    rows = answer.shown(stored.entries(spark), stored.pages(spark), queries_of.parse("rests")).collect()
    assert [(r.url, r.trail) for r in rows] == [("/p/1/#top", "Cakes → Page 1 → Mixing")]


def test_answers_and_repairs(spark, tmp_path):
    stored = site(spark, tmp_path, [["Kneading the Crémeuse", "kneaded twice"], ["raisin bread, crust", "flour flower flowed"]])
    told = lambda q: (lambda a: (a.how, a.instead, [(r.page_id, r.block_seq) for r in a.rows.collect()]))(answer.answer(stored, spark, q))
    assert told("bread") == (None, None, [(1, 0)])
    assert told("cremeusing") == ("only", "Crémeuse", [(0, 0)])  # one word shortened, and one word only begins so
    assert told("kneadxy") == ("root", None, [(0, 0), (0, 1)])
    assert told("xaisin") == ("corrected", "raisin", [(1, 0)])
    assert told("crusb raisin")[:2] == ("corrected", "crust")
    assert told("zzzzzz") == (None, None, []) and told("x") == (None, None, []) and told("") == (None, None, [])
    assert answer.surface(["some Kneading", "Knead it"], "knead") == "Knead" and answer.surface(["some Kneading"], "knead") == "Kneading" and answer.surface([], "knead") == "knead"


def test_repaired_query(spark, stored):
    got = catalog.answer_repaired(spark, SF).collect()
    want = [tuple(r) for r in search.search(stored.entries(spark), "ation the").select("page_id", "block_seq").collect()]
    assert got and {(r.how, r.instead) for r in got} == {("only", "ationouha")} and [(r.page_id, r.block_seq) for r in got] == want


def test_sql_functions(spark):
    from pagewright.functions import sql

    sql.register(spark)
    row = spark.sql("SELECT fold('Ünï ВЬЮГА 1 202') AS f, answers('the dough rests', 'doughs') AS a, vocabulary('a α') AS v, parse_query('doughs x=2') AS q").first()
    assert (row.f, row.a) == ("uni vyuga 1202", True) and {"a", "α"} <= set(row.v) and [t.formula for t in row.q] == [False, True]
    assert spark.range(1).select(sql.answering(F.lit("the dough"), "oven").alias("x")).first().x is False


def test_owned_folders_are_removed(spark):
    import os
    from urllib.parse import urlparse

    from pagewright import storage

    with storage.owned(spark) as folder:
        df = storage.written(spark.range(3), "kept")
        assert df.count() == 3 and os.path.isdir(urlparse(folder).path or folder)
    assert not os.path.isdir(urlparse(folder).path or folder)
    assert storage.new_folder(spark, "x").startswith(storage.run_folder(spark))


def test_paragraphs(spark):
    import re

    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for part in re.split(r"\n[ \t]*\n", r.text.replace("\n", "\n\n")):
            part = re.sub(r"<[^>]*>", " ", part)
            part = re.sub(r"(^|\n)\s*(#{1,6}|>|[-*+])\s+|\*\*|__|`|!?\[([^\]]*)\]\([^)]*\)", lambda m: (m[1] or "") + (m[3] or ""), part)
            part = re.sub(r"[ \t-\r]+", " ", part).strip(" ")
            if len(part) >= 17 and "nosearch" not in part:
                n, chars = want.get(r.doc_id, (0, 0))
                want[r.doc_id] = (n + 1, chars + len(part))
    assert {r.page_id: (r.blocks, r.chars) for r in catalog.blocks_from_paragraphs(spark, SF).collect()} == want


def test_index_lists_all(spark, tmp_path):
    """Words, pairs and glyphs of a few texts, by hand; the three queries of postings share them out."""
    texts = ["so a=b", "plain words", None]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(3).collect()
    rows = [tuple({**r.asDict(), "doc_id": n, "text": t}.values()) for n, (r, t) in enumerate(zip(docs, texts))]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: {r.word: r.chunks for r in catalog.queries()[name](spark, str(tmp_path)).collect()} for name in ("postings", "formula_bigrams", "glyph_postings")}
    assert got == {"postings": dict.fromkeys(("so", "a", "b", "plain", "words"), 1), "formula_bigrams": {"$a=": 1, "$=b": 1}, "glyph_postings": dict.fromkeys(("α", "→", "β"), 1)}


def test_addresses_and_titles_with_a_number_agree_with_sql(spark, tmp_path):
    """Two addresses side by side are no number in groups, and a page called by a number that is looked for is no line of it."""
    told = ["a 38.211.12.42 208.45.6.17 b 7", "1 345.6.7.8 c", "plain", "que 3.4 123.5.6", "", "x 99.114.106.61 408.0.0.1"]
    docs = [(12341 + n, t, "en", "src1", len(t)) for n, t in enumerate(told)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "10.0.0.12 300.1.2.3")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("search_scripts", "lexicon_df", "lexicon_merged", "lexicon_tf", "postings"):
        df = catalog.queries()[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        want = con.sql(catalog.oracle_sql()[name]).select(", ".join(f'"{c}"' for c in columns)).fetchall()
        assert rows(columns, df.select(*columns).collect()) == rows(columns, want), name


def test_lines_that_answer_by_themselves_are_not_counted(spark, tmp_path):
    """Words that answer without an ending, or together with another's, are no lines of search_scripts in its SQL."""
    told = ["a 12345ab stepping", "12345 c", "stepson of omega_g\nb $x", "vyug 12345", "Вьюга", None, "costs $5 in steps"]
    docs = [(12340 + n, t, "en", "src1", 0) for n, t in enumerate(told)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["search_scripts"]).select("query, found, pages").fetchall()
    assert rows(None, catalog.search_scripts(spark, str(tmp_path)).collect()) == rows(None, want)
