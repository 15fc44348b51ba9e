import json

from pyspark.sql import functions as F

from pagewright.functions import sql
from pagewright.operators import index, names, profile, repair
from pagewright.sources import html, jsonindex, tables


def cut(spark, page):
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    return [(r.anchor, r.heading, r.text) for r in html.html_blocks(df).orderBy("block_seq").collect()]


def test_html_blocks(spark):
    page = """<html><head><title>x</title><script>var t="</p>";</script></head><body><!-- <p>no</p> --><nav>menu item</nav>
    <h2 id="first">One <b>bold</b></h2><p>Text a<b>b</b>c &amp; d<p id="two">Second &copy; &#169; &#60;b&#62;<br>third line
    <table><tr><td>term</td><td>gloss</td></tr></table><h3></h3><a name="x">inside</a> piece<p>after x<p>z</body></html>"""
    assert cut(spark, page) == [
        (None, None, "menu item"), ("first", "One bold", "Text abc & d"), ("two", "One bold", "Second © © <b>"), ("two", "One bold", "third line"),
        ("two", "One bold", "term · gloss"), ("two", "One bold", "inside piece"), ("x", "One bold", "after x"),
    ]


def test_formulas_in_html(spark):
    page = """<body><p>so <span class="math inline">x_1 &lt; y</span>5 and <span class="math display">z</span> <script type="math/tex">q</script>
    <span class="katex-display"><span class="katex"><span><annotation encoding="application/x-tex">a
    b</annotation></span><span>junk</span></span></span> end</p></body>"""
    assert cut(spark, page) == [(None, None, "so \\(x_1 < y\\)5 and \\[z\\] \\(q\\) \\[a b\\] end")]


def test_html_without_body_or_text(spark):
    assert cut(spark, None) == [] and cut(spark, "") == [] and cut(spark, "<p>x</p>") == [] and cut(spark, "bare text") == [(None, None, "bare text")]


def test_json_index(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    first = {"pages": [{"url": "/a/", "title": "A", "lang": "de-AT", "blocks": ["plain", {"text": "object", "anchor": "x", "section": "H"}, "", {"text": ""}]}], "shards": [{"url": "sub/b.json", "section": "B", "named": {"en": "Bee"}, "order": 3}, {"url": "sub/b.json"}]}
    second = {"pages": [{"url": "/b/", "title": "B", "order": 7, "blocks": []}, {"url": "/c/", "title": "C", "section": "Own", "blocks": ["c"]}], "shards": [{"url": "../a.json"}]}
    (tmp_path / "a.json").write_text(json.dumps(first))
    (tmp_path / "sub/b.json").write_text(json.dumps(second))
    sources = jsonindex.read_sources(spark, f"file://{tmp_path}/a.json")
    assert [s["url"].rsplit("/", 1)[1] for s in sources] == ["a.json", "b.json"]
    pages, blocks = jsonindex.read_index(spark, sources, "en")
    got = {r.url: (r.section, r.order_, r.lang) for r in pages.collect()}
    assert got == {"/a/": (None, 0, "de-AT"), "/b/": ("Bee", 7, None), "/c/": ("Own", 3, None)}
    assert sorted((r.block_seq, r.anchor, r.heading, r.text) for r in blocks.collect()) == [(0, None, None, "c"), (0, None, None, "plain"), (1, "x", "H", "object")]
    jsonindex.write_index(pages, blocks, str(tmp_path / "out"), "gzip")
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 3 and back.where("url = '/a/'").first().blocks[1].anchor == "x"
    sizes = pages.withColumn("n_chunks", F.lit(2))
    assert sorted(r["first"] for r in jsonindex.numbered(sizes).collect()) == [0, 2, 4]


def test_many_sources_have_keys_of_their_own(spark, tmp_path):
    for n in range(40):
        (tmp_path / f"{n}.json").write_text(json.dumps({"pages": [{"url": f"/{n}/", "title": f"T {n}", "blocks": [f"block {k} of {n}" for k in range(40)]}]}))
    sources = [{"url": f"file://{tmp_path}/{n}.json"} for n in range(40)]
    pages, blocks = jsonindex.read_index(spark, sources)
    chunks = index.chunk_map(blocks)
    assert pages.select("page_id").distinct().count() == 40 and chunks.count() == chunks.select("page_id", "chunk").distinct().count() == 80
    assert {tuple(r) for r in chunks.select("first_block", "n_blocks").distinct().collect()} == {(0, 32), (32, 8)}


def test_many_sources_are_one_scan(spark, tmp_path):
    for n in range(1000):
        (tmp_path / f"a b+{n}.json").write_text(json.dumps({"pages": [{"url": f"/{n}/", "blocks": ["x"]}], "shards": [{"url": f"./a b+{n + 1}.json"}] if n in (0, 1) else []}))
    assert len(jsonindex.read_sources(spark, f"file:{tmp_path}/a b+0.json")) == 3
    pages, blocks = jsonindex.read_index(spark, [{"url": f"{tmp_path}/a b+{n}.json", "order": n} for n in (*range(1000), 5)])
    assert pages._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted((int(r.url.strip("/")), r.order_) for r in pages.collect()) == [(n, n) for n in range(1000)] and blocks.count() == 1000


def test_addresses_in_indexes():
    of = jsonindex.resolved
    assert of("s3a://b/x/all.json", "y/z.json") == "s3a://b/x/y/z.json" and of("hdfs://h:9/x/a.json", "../b.json") == "hdfs://h:9/b.json"
    assert of("file:/x/a.json", "/b.json") == "file:/b.json" and of("/x/a/", "../b/") == "/x/b/" and of("/x/a.json", "https://h/b.json") == "https://h/b.json" and of("/x/a/", "../b") == "/x/b"


def test_folders_of_lines(spark, tmp_path):
    pages = spark.createDataFrame([(7, "/a/", "A"), (3, "/b/", None)], "page_id long, url string, title string")
    pages = pages.withColumns({c: F.lit(None).cast("string") for c in ("also", "lang", "section")} | {"order_": F.lit(None).cast("int"), "fallback": F.lit(False)})
    blocks = spark.createDataFrame([(7, 0, "x", None, "{not json"), (7, 1, None, "H", "plain")], "page_id long, block_seq int, anchor string, heading string, text string")
    jsonindex.write_index(pages, blocks, f"{tmp_path}/lines")
    got, of = jsonindex.read_index(spark, [{"url": f"{tmp_path}/lines/", "section": "S", "order": 2}])
    assert sorted((r.page_id, r.url, r.section, r.order_) for r in got.collect()) == [(3, "/b/", "S", 2), (7, "/a/", "S", 2)]
    assert [(r.page_id, r.anchor, r.heading, r.text) for r in of.orderBy("block_seq").collect()] == [(7, "x", None, "{not json"), (7, None, "H", "plain")]


def test_markdown_files(spark, tmp_path):
    files = {
        "b/index.md": "---\ntitle: \"Bee: one\"\nlang: en\norder: 3\ntags:\n  - x\n---\nA paragraph that is long enough\n\nshort\n\n## Another of some length",
        "a/ü+ %41.md": "no front matter in this one, which is long enough", "a/hidden.md": "---\nsearch: FALSE\n---\nthis text is long enough to be one", "sitesearch/x.md": "a file of the search's own, long enough",
        "c.md": "---\r\npermalink: /see/\r\ntitle:\r\n---\r\nwindows lines that are long enough", "d.txt": "not a page at all, but long", "e.md": "", "f.md": "---\n---\nan empty front matter, and text",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    of = tables.markdown_files(spark, str(tmp_path))
    assert [r.path for r in of.orderBy("page_id").collect()] == sorted(n for n in files if n.endswith(".md") and files[n])
    pages = tables.markdown_pages(of, lang="ru")
    got = {r.url: (r.title, r.lang, r.order_) for r in pages.collect()}
    assert got == {"/b/": ("Bee: one", "en", 3), "/a/ü+ %41/": ("/a/ü+ %41/", "ru", 0), "/see/": ("/see/", "ru", 0), "/f/": ("/f/", "ru", 0)}
    texts = tables.paragraph_blocks(pages, "page_id", "content").join(pages.select("page_id", "url"), "page_id").orderBy("url", "block_seq")
    assert [(r.url, r.block_seq, r.text) for r in texts.collect()] == [
        ("/a/ü+ %41/", 0, "no front matter in this one, which is long enough"), ("/b/", 0, "A paragraph that is long enough"), ("/b/", 1, "Another of some length"),
        ("/f/", 0, "an empty front matter, and text"), ("/see/", 0, "windows lines that are long enough"),
    ]


def test_natural_order(spark):
    titles = ["ель 2", "Ёлка 10", "Ёлка 9", "август", "жук 123456789012346", "жук 123456789012345", "жук 0099", "Part 2b", "Part 2a", "", "007", "8"]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    got = [r.title for r in df.orderBy(F.collate(names.natural(F.col("title")), names.COLLATION)).collect()]
    # Russian has its own letters before Latin ones.
    assert got == ["", "007", "8", "август", "Ёлка 9", "Ёлка 10", "ель 2", "жук 0099", "жук 123456789012345", "жук 123456789012346", "Part 2a", "Part 2b"]


def test_audit_tables(spark):
    of = spark.createDataFrame([("—", 1, 0), ("Z", 2, None), ("B", 3, 1), ("A", 4, 1)], "section string, pages long, order_ int")
    assert [r.section for r in profile.section_table(of).collect()] == ["Z", "—", "A", "B"]
    assert profile.section_table(of.where("section = '—'")).count() == 0
    repeated = spark.createDataFrame([(c * 200, n) for c, n in zip("abcdefghij", (3, 9, 2, 2, 5, 5, 2, 2, 2, 2))], "text string, n long")
    assert [(r["rank"], r.text[:1], len(r.text)) for r in profile.repeated_table(repeated).collect()] == [(k + 1, c, 140) for k, c in enumerate("befacdgh")]


def test_table_functions(spark):
    sql.register(spark)
    page = """<body>&#60;x <nav>menu</nav><H2 ID="a">He<b>ad</b></H2>one<td>x</td><td></td></tr><h3 id="b"></h3>two two<a name="c">three<p>four<div id="d"><h4></div>in a heading</h4>five
    <span class="math inline">a &lt; b</span><script>x</script> y<br></body>z"""
    spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>x</p>"), (5, "bare &amp;lt; text")], "page_id long, html string").createOrReplaceTempView("t_pages")
    by_function = spark.sql("SELECT page_id, b.* FROM t_pages, LATERAL html_blocks(html) AS b")
    assert sorted(map(str, by_function.collect())) == sorted(map(str, html.html_blocks(spark.table("t_pages")).collect())) and by_function.count() > 5
    terms = spark.sql("SELECT t.* FROM VALUES ('Foo $x_1$'), (NULL), ('') AS v(q), LATERAL query_terms(q) AS t").orderBy("pos").collect()
    assert [(t.pos, t.formula) for t in terms] == [(0, False), (1, True)] and terms[0].word == "foo"
    assert spark.sql("SELECT r.* FROM (SELECT record('Übel $x_1$') AS r)").first().asDict() == {"fold": "ubel  x_1 ", "squeezed": "x1"}


def test_content_pages(spark):
    rows = [(1, "a/b.md", {"search": "false"}), (2, "a/c.md", {"search": "true"}), (3, "own/d.md", None), (4, "x.html", None), (5, "y.md", None)]
    pages = spark.createDataFrame(rows, "id int, path string, front map<string,string>")
    assert [r.id for r in tables.content_pages(pages, ("own/",)).orderBy("id").collect()] == [2, 5]


def test_marks_in_names(spark):
    titles = spark.createDataFrame([("Ünder the Crust crust",), ("none",), (None,)], "title string")
    got = [[(m.start, m.end) for m in r.m] for r in titles.select(names.marks(F.col("title"), "crust und rus").alias("m")).collect()]
    assert got == [[(0, 3), (10, 15)], [], []]


def test_paragraphs_and_visibility(spark):
    df = spark.createDataFrame([(1, "a nosearch flag is explained in this prose\n\nnot this one of some length\n{: .nosearch}\n\n<p class=\"x nosearch\">nor this long one here</p>\n\n# A heading of some length\n\nshort\n\n**Bold** text with [a link](http://x) in it\n\n<!-- nosearch --> this long chunk is left out")], "id long, content string")
    assert [r.text for r in tables.paragraph_blocks(df, "id", "content").orderBy("block_seq").collect()] == ["a nosearch flag is explained in this prose", "A heading of some length", "Bold text with a link in it"]
    pages = spark.createDataFrame([(1, "de"), (2, "EN-us"), (3, None), (4, "")], "page_id long, lang string")
    assert [r.page_id for r in tables.visible(pages, "en").orderBy("page_id").collect()] == [2, 3, 4] and tables.visible(pages, None).count() == 4


def test_doors(spark):
    rows = [("/s/", "S", "Sec", False), ("/s/a/", "A", "Sec", False), ("/t/x/", "X", "Tee", False), ("/t/y/", "Y", "Tee", False), ("/", "Home", "Fall", True), ("/u/", "U", None, False)]
    pages = spark.createDataFrame(rows, "url string, title string, section string, fallback boolean").withColumn("order_", F.lit(0))
    doors = {r.url for r in names.prepared(pages).where("home IS NOT NULL").collect()}
    assert doors == {"/s/", "/t/x/", "/t/y/"}
    assert [r.title for r in names.pick(names.prepared(pages), "sec").collect()] == ["S", "A"]
    numbered = spark.createDataFrame([(f"/p/{n}/", f"Part {n}", "P", False) for n in (10, 9, 2)], "url string, title string, section string, fallback boolean").withColumn("order_", F.lit(0))
    assert [r.title for r in names.pick(names.prepared(numbered), "part").collect()] == ["Part 2", "Part 9", "Part 10"]


def test_repair(spark):
    lexicon = spark.createDataFrame([("suffering", 3), ("suffer", 9), ("nritta", 2), ("mind", 5), ("mint", 7), ("house", 1)], "word string, weight long")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    near = {r.word: (r.nearest, r.distance) for r in repair.nearest(words("sufering", "nrta", "minx", "abc", "xouse", "zzffering"), lexicon).collect()}
    assert near == {"sufering": ("suffering", 1), "nrta": ("nritta", 1), "minx": ("mint", 1), "abc": (None, None), "xouse": ("house", 1), "zzffering": (None, None)}
    stems = {r.word: r.stem for r in repair.widen(words("sufferance", "minding", "house", "hou"), lexicon).collect()}
    assert stems == {"sufferance": "suffer", "minding": None, "house": "hous", "hou": None}
    asked = spark.createDataFrame([(1, 0, "mind"), (1, 1, "hause"), (2, 0, "qqqq"), (3, 0, "mind")], "query_id int, pos int, word string")
    assert {r.query_id: r.corrected for r in repair.correct(asked, lexicon).collect()} == {1: "mind house", 2: None, 3: None}
    assert {r.word: r.only for r in repair.only(words("suff", "hou", "x"), lexicon).collect()} == {"suff": None, "hou": "house", "x": None}


def test_profile_and_repeats(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "a", "<b>x</b> &amp; **"), (1, 1, None, "&nbsp; text of an entity in a line"), (2, 0, None, "see [this](that) for more about it"), (2, 1, None, "r" * 60), (3, 0, None, "r" * 60), (3, 1, None, "r" * 60)],
        "page_id long, block_seq int, anchor string, text string",
    )
    assert {(r.kind, r.n) for r in profile.complaint_counts(profile.complaints(blocks)).collect()} == {("markup", 1), ("entities", 1), ("markdown", 1), ("tiny", 1)}
    assert [(r.n) for r in profile.repeated(blocks).collect()] == [3]
    assert index.without_repeated(blocks, 2).count() == 3 and index.without_repeated(blocks, 3).count() == 6 and index.without_repeated(blocks, 1).count() == 6
