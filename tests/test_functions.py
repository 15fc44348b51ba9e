"""Folds, formulas and queries by the rules they follow: generated spellings of one thing must meet."""

import random
import unicodedata

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import fold as fold_module
from pagewright.functions import formulas, query, snippets, tables

PLAIN = ["Straße", "ÇA VA", "naïve café", "ΣΟΦΟΣ", "ﬂour", "밥", "ДОЖДЬ", "съёмка", "вьюга", "маяк", "ячмень", "дождь и джем", "пирог по-русски", "3 250 g", "12 2500", "1,250", "≤ ≱", "İnce", "", "ъ"]
GAP = tables.GAPS[0]


@st.composite
def cyrillic(draw):
    """A word of letters whose spelling needs no neighbours, and its Latin spelling."""
    letters = draw(st.lists(st.sampled_from([c for c in tables.CYRILLIC if c not in "дюяьъ"]), min_size=1, max_size=8))
    return "".join(letters), "".join(tables.CYRILLIC[c] for c in letters)


@given(cyrillic())
def test_letters_have_their_latin_spelling(pair):
    word, latin = pair
    assert fold_module.fold(word) == fold_module.fold(word.upper()) == latin


@given(cyrillic(), st.sampled_from("юя"), st.sampled_from("ьъ"))
def test_letters_that_look_at_their_neighbours(pair, soft, sign):
    word, latin = pair
    sound = tables.CYRILLIC[soft]
    assert fold_module.fold(soft + word) == f"y{sound}{latin}"
    glide = "" if word[-1] not in tables.VOWELS else "y"
    assert fold_module.fold(word + soft) == latin + glide + sound
    # A sign glides before a soft vowel and is silent elsewhere; behind it the vowel has its own glide.
    assert fold_module.fold(word + sign + soft).startswith(latin + "y")
    assert fold_module.fold(word + sign + "к") == latin + "k"
    assert fold_module.fold(f"{word}дж{word}") == f"{latin}j{latin}"


@given(st.integers(1000, 10**12), st.sampled_from(tables.GAPS), st.sampled_from(["", " to bake", "g"]))
def test_digit_groups_are_one_number(n, gap, after):
    grouped = f"{n:,}".replace(",", gap)
    assert fold_module.fold(f"take {grouped}{after}") == f"take {n}{after}"
    assert query.answers(f"take {grouped} grains", str(n)) and query.answers(f"take {n} grains", grouped)
    # Groups of other sizes, and commas, part numbers.
    assert fold_module.fold(f"{n}{gap}12") == f"{n}{gap}12" and fold_module.fold(f"{n:,}") == f"{n:,}"


@given(st.text(alphabet="aeiouncszy", min_size=1, max_size=8), st.sampled_from(["̀", "́", "̂", "̃", "̈", "̌"]))
def test_marks_are_dropped(word, mark):
    assert fold_module.fold(unicodedata.normalize("NFC", mark.join(word) + mark)) == word


def test_strokes_of_operators_stay():
    for c in "≠≱∉↛":
        assert fold_module.fold(f"p {c} q") == f"p {c} q"


def test_native_fold_is_the_fold(spark):
    rng = random.Random(1)
    letters = "".join(tables.CYRILLIC) + f"дждьяюеё ij1{GAP}23 éß"
    texts = PLAIN + ["".join(rng.choice(letters) for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.where(~F.col("text").rlike(fold_module.needs_python())).select("text", fold_module.folded(F.col("text")).alias("f")).collect()
    assert len(rows) > 400
    for r in rows:
        assert r.f == fold_module.fold(r.text), r.text
    assert fold_module.fold("밥") == unicodedata.normalize("NFD", "밥")


def test_native_fold_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in df.select("text", fold_module.folded(F.col("text")).alias("f")).collect():
        assert r.f == fold_module.fold(r.text)


GREEK = sorted({(name, glyph) for name, glyph in tables.SYMBOLS if name in tables.GREEK})
_NAMES = {glyph: name for name, glyph in GREEK}
_BRACKETS = {glyph: name for name, glyph in tables.NAMED.items() if not name.startswith(("Curly", "Final"))}


def symbol(glyph: str, way: int) -> str:
    return (glyph, f"\\{_NAMES[glyph]} ", f"\\[{_BRACKETS[glyph]}]")[way % 3]


def scripted(base: str, index: str, digit: str, way: int) -> str:
    """base with index below and digit above it, in one of the ways that mean the same."""
    low = (f"_{index}", f"_{{{index}}}", f"_{index}")[way % 3]
    high = (f"^{digit}", f"^{{{digit}}}", {v: k for k, v in tables.RAISED.items()}[digit])[way // 3 % 3]
    return base + low + high


def fenced(formula: str, way: int) -> str:
    return (f"${formula}$", f"\\({formula}\\)", f"$${formula}$$", f"\\[{formula}\\]")[way % 4]


@st.composite
def spellings(draw):
    """Two spellings of one formula: one fenced, in the text, the other as it may be typed."""
    parts = draw(st.lists(st.tuples(st.sampled_from([g for _, g in GREEK]), st.sampled_from("bkhw"), st.sampled_from("3579")), min_size=1, max_size=3))
    sign = draw(st.sampled_from(["=", "+", "<"]))
    write = lambda ways, space: f"{space}{sign}{space}".join(scripted(symbol(g, w), i, d, w // 3) for (g, i, d), w in zip(parts, ways))
    ways = st.lists(st.integers(0, 26), min_size=3, max_size=3)
    text, typed = write(draw(ways), draw(st.sampled_from(["", " "]))), write(draw(ways), "")
    return fenced(text, draw(st.integers(0, 3))), fenced(typed, draw(st.integers(0, 3)))


@settings(max_examples=300, deadline=None)
@given(spellings())
def test_spellings_of_a_formula_meet(pair):
    text, typed = pair
    whole = f"the dough obeys {text} while it rests"
    assert query.answers(whole, typed) and query.answers(whole, f"dough {typed}") and not query.answers(whole, f"oven {typed}")
    # The index never misses what the text answers.
    of = formulas.record(whole)
    known = formulas.vocabulary(of)
    for term in query.parse(f"dough {typed}"):
        met = [(n, ks) for n, ks in zip(term.needles, query.keys(term)) if query.located(of, term, n)]
        assert met and all(any(w.startswith(k) for w in known) for _, ks in met for k in ks)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(GREEK), st.sampled_from(GREEK), st.sampled_from("bkhw"))
def test_other_symbols_do_not_meet(one, other, index):
    text = f"heat ${one[1]}_{index} = 4$ of the oven"
    assert query.answers(text, f"{one[1]}_{index}")
    assert one == other or not query.answers(text, f"{other[1]}_{index}")
    assert not query.answers(text, f"{one[1]}_q")
    # A letter's name finds it within a formula, an accent above it doesn't matter.
    assert query.answers(text, f"{one[0]}_{index}")
    assert query.answers(f"mean $\\bar{{{one[1]}}}_{index}$", f"{one[1]}_{index}")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("bread crust ovens хлеба мука naïve x=2 e^- $k_1$ 1 250 q→r ¬ a-b rye".split(" ")), min_size=1, max_size=8), st.data())
def test_the_index_never_misses(words, data):
    text = " ".join(words)
    asked = " ".join(data.draw(st.lists(st.sampled_from(words), min_size=1, max_size=3)))
    of = formulas.record(text)
    known = formulas.vocabulary(of)
    for term in query.parse(asked):
        for needle, ks in zip(term.needles, query.keys(term)):
            if query.located(of, term, needle):
                assert all(any(w.startswith(k) for w in known) for k in ks), (text, needle)


@pytest.mark.parametrize(
    "text,q,want",
    [
        ("two loaves of rye", "loaf", False), ("two loaves of rye", "loave", True), ("one loaf", "loafs", True), ("overbaked", "baked", False), ("over-baked", "baked", True),
        ("eggs for $4 or $9", "$9", True), ("eggs for $4 or $9", "or", True), ("mix p q", "pq", False), ("тесто", "теста", True), ("растёртый", "тёрт", False),
        ("anything", " \t ", False), ("salt", "salt pepper", False), ("salt, pepper", "pepper salt", True),
    ],
)
def test_words(text, q, want):
    assert query.answers(text, q) == want


def test_predicate_in_spark(spark):
    rng = random.Random(4)
    bits = ["rye", "bread", "ovens", "хлеба", "$\\lambda_k$", "λ_k", "x = 2", "4 500", "naïve", "p→q", "$7", "a-b", "≠"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    df = formulas.with_record(spark.createDataFrame([(t,) for t in texts], "text string"), F.col("text")).cache()
    assert df.count() == len(texts)
    for q in [*bits, "oven", "хлеб rye", "lambda_k", "≠ bread", "x=2"]:
        for r in df.withColumn("got", query.all_found(query.started(F.col("fold")), F.col("squeezed"), query.parse(q))).collect():
            assert r.got == query.answers(r.text, q), (r.text, q)


def test_native_branch_is_the_record(spark):
    texts = [*PLAIN, "a_b $$ x", "~", "x+y", None, "plain", "$\\hat{β}$ and \\(\\sqrt2\\)", "4 500 → 5"]
    for r in formulas.with_record(spark.createDataFrame([(t, "f") for t in texts], "text string, fold2 string"), F.col("text")).collect():
        if r.text is not None:
            of = formulas.record(r.text)
            assert (r.fold, r.squeezed) == (of.text, of.squeezed), r.text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 $\\()[]{}^_~-+=μ≠²₂→>.,", max_size=30))
def test_record_keeps_places(text):
    of = formulas.record(text)
    assert len(of.places) == len(of.text) + 1 and len(of.squeezed_at) == len(of.squeezed)
    assert of.places == sorted(of.places) and of.places[-1] == len(text)


@given(st.text(alphabet="abrs-e1", min_size=1, max_size=7), st.text(alphabet="abrs-e1 ", max_size=12))
def test_fewer_keys_tell_the_same(word, text):
    for term in query.parse(word):
        words = formulas.vocabulary(formulas.record(text))
        holds = lambda needles: any(all(any(w.startswith(k) for w in words) for k in ks) for ks in needles)
        if all(query.keys(term)):
            assert query.least_keys(term) and holds(query.keys(term)) == holds(query.least_keys(term))


@given(st.text(alphabet="bcdfstn", min_size=3, max_size=5), st.text(alphabet="aeiouy", max_size=4))
def test_ladder(stem, vowels):
    assert query.ladder(stem + vowels, True) == [(stem + vowels)[: len(stem + vowels) - k] for k in range(min(2, len(vowels)) + 1)]
    assert query.ladder(f"{stem}{vowels}ts", False) == [f"{stem}{vowels}ts", f"{stem}{vowels}t"]
    assert query.ladder(f"{stem}r", True) == [f"{stem}r", f"{stem}ri", f"{stem}r"][:2]


def test_snippets(spark):
    long = "flour " * 40 + "cardamom and salt " + "water " * 80
    shown, marks = snippets.snippet(long, query.parse("cardamom"))
    assert shown.startswith("…") and shown.endswith("…") and [shown[a:b] for a, b in marks] == ["cardamom"]
    assert 200 < len(shown) < 260
    shown, marks = snippets.snippet("пирогами с вишней", query.parse("пирог"))
    assert (shown, [shown[a:b] for a, b in marks]) == ("пирогами с вишней", ["пирогами"])
    assert snippets.snippet("o " * 200, query.parse("zzz"))[0] == ("o " * 110).rstrip() + "…"
    row = spark.createDataFrame([(long,)], "text string").select(snippets.snippets(F.col("text"), query.parse("cardamom")).alias("s")).first()
    assert row.s.snippet.count("cardamom") == 1 and len(row.s.marks) == 1


def test_tables():
    assert len({name for name, _ in tables.SYMBOLS}) == len(tables.SYMBOLS) and len(tables.GREEK) == 24
    assert set(tables.NAMED.values()) <= {glyph for _, glyph in tables.SYMBOLS}
    assert regex.search(tables.SIGNED, "n-") and not regex.search(tables.SIGNED, "oven-baked")


def test_records_keep_no_places(monkeypatch):
    """Of a batch's texts one at a time has its places in memory."""
    import gc

    import pyarrow as pa

    gc.collect()
    most, plain = 0, formulas.record

    def counted(text):
        nonlocal most
        most = max(most, sum(isinstance(x, formulas.Record) for x in gc.get_objects()))
        return plain(text)

    monkeypatch.setattr(formulas, "record", counted)
    got = formulas.records(pa.array(["a = b", None, "plain", ""] * 20))
    assert got.to_pylist()[:4] == [{"fold": "a = b", "squeezed": "a=b"}, None, {"fold": "plain", "squeezed": ""}, {"fold": "", "squeezed": ""}]
    assert most <= 1


def test_texts_with_glyphs_fold_without_python(spark):
    """The fold alone of every glyph, among letters, is Python's; only texts with something to spell are sent there."""
    glyphs = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and regex.match(f"[{tables.GLYPHS}]", chr(c))]
    texts = [t for g in glyphs for t in (g, f"Éa{g} Ω = {g}Ж")]
    df = formulas.with_record(spark.createDataFrame([(t,) for t in texts], "text string"), F.col("text"), squeezed=None)
    assert df.columns == ["text", "fold"]
    assert [r for r in df.collect() if r.fold != formulas.record(r.text).text] == []
    used = formulas.records

    def refused(texts):
        if any(t.is_valid for t in texts):
            raise ValueError("a text without formulas")
        return used(texts)

    formulas.records = refused
    try:
        assert [r.fold for r in formulas.with_record(spark.createDataFrame([("É α → b ±",)], "text string"), F.col("text"), squeezed=None).collect()] == ["e α → b ±"]
    finally:
        formulas.records = used
