"""The fold: one spelling for every way to write a word.

`folded` is the fold as a Spark expression; `fold` and `fold_places` are the same in Python, for queries and
for the few texts that need the formula fold or whose characters fall into several.
"""

from __future__ import annotations

import functools
import unicodedata

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.tables import CYRILLIC, GAP, GAPS, GLIDED, VOWELS

_CONSONANTS = "".join(c for c in CYRILLIC if c not in VOWELS)
_GROUPED = regex.compile(f"[0-9][{GAPS}][0-9]")
#: Stand-ins while letters still need their neighbours: a glide, and дж.
_GLIDE, _J = "﷐", "﷑"


def _plain(c: str) -> str:
    """A lower-case character without its marks; arrows and operators keep their strokes."""
    if all("←" <= x <= "⫿" for x in c):
        return c
    return "".join(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ")


@functools.lru_cache(1)
def _table() -> tuple[str, str, str]:
    """Characters that fold to one, what they fold to followed by nothing for those that fold to none, and characters that fold to several."""
    one, to, none, several = [], [], [], []
    for cp in range(0x80, 0x10000):
        c = chr(cp)
        if 0xD800 <= cp < 0xE000 or c in CYRILLIC or c.lower() != c:
            continue
        p = _plain(c)
        if len(p) == 1 and p != c:
            one.append(c)
            to.append(p)
        elif not p:
            none.append(c)
        elif len(p) > 1 and not "가" <= c <= "힣":
            several.append(c)
    return "".join(one + none), "".join(to), "".join(several)


def needs_python() -> str:
    """A Java regular expression for texts with characters that fold to several, as ranges: a class of many single ones is slow."""
    ranges: list[list[str]] = []
    for c in sorted(_table()[2]):
        if ranges and ord(c) == ord(ranges[-1][1]) + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return f"[가-힣{''.join(a if a == b else f'{a}-{b}' for a, b in ranges)}]"


def has_several(text: Column) -> Column:
    """Whether `needs_python` finds a text; it is only tried where a character is of the scripts that it knows."""
    return text.rlike(r"[\x{622}-\x{1FFF}\x{2C00}-\x{FFFF}]") & text.rlike(needs_python())


def _without_gaps(c: Column) -> Column:
    return F.regexp_replace(c, GAP, "")


def _lower(c: Column) -> Column:
    # Character by character: at the end of a word lower() would give another sigma.
    return F.lower(F.replace(c, F.lit("Σ"), F.lit("σ")))


def _from_cyrillic(c: Column) -> Column:
    c = F.regexp_replace(c, "дж", _J)
    c = F.regexp_replace(c, f"[ьъ](?=[{GLIDED}])", _GLIDE)
    c = F.regexp_replace(c, f"(?<![{_CONSONANTS}{_J}{_GLIDE}])([яю])", "й$1")
    c = F.regexp_replace(F.regexp_replace(c, "ж", "zh"), "ц", "ts")
    single = {k: v for k, v in CYRILLIC.items() if len(v) == 1} | {_J: "j", _GLIDE: "y"}
    return F.translate(F.translate(c, "".join(single), "".join(single.values())), "ьъ", "")


def _without_marks(c: Column) -> Column:
    ones, to, _ = _table()
    return F.translate(F.replace(F.replace(c, F.lit("ṛ"), F.lit("ri")), F.lit("ṝ"), F.lit("ri")), ones, to)


def folded(text: Column) -> Column:
    """The fold as built-in functions, for texts that `needs_python` doesn't find."""
    return _without_marks(_from_cyrillic(_lower(_without_gaps(text))))


def with_fold(df: DataFrame, text: str, fold: str) -> DataFrame:
    """df with the fold of column text. Steps that most texts don't need are only taken where a test finds work for them."""
    step = lambda test, f: F.when(F.col(fold).rlike(test), f(F.col(fold))).otherwise(F.col(fold))
    out = df.withColumn(fold, F.when(F.col(text).rlike(f"[0-9][{GAPS}][0-9]"), _without_gaps(F.col(text))).otherwise(F.col(text)))
    out = out.withColumn(fold, _lower(F.col(fold)))
    out = out.withColumn(fold, step("[\u0400-\u04FF]", _from_cyrillic))
    return out.withColumn(fold, step("[^\\x00-\\x7F]", _without_marks))


#: What is spelled anew in lower-case text and how, the first that fits; None: without its marks.
_RULES: tuple[tuple[str, str | None], ...] = (
    (GAP, ""),
    ("дж", "j"),
    (f"[ьъ](?=[{GLIDED}])", "y"),
    *((f"(?<![{_CONSONANTS}]){c}", f"y{CYRILLIC[c]}") for c in "яю"),
    *CYRILLIC.items(),
    ("[ṛṝ]", "ri"),
    (r"[^\x00-\x7F]", None),
)
_RULE = regex.compile("|".join(f"({pattern})" for pattern, _ in _RULES))
_marked = functools.lru_cache(1 << 16)(_plain)


def fold_places(text: str) -> tuple[str, list[int]]:
    """The folded text and, for each of its characters and its end, the place in text that it comes from."""
    if text.isascii() and not _GROUPED.search(text):
        return text.lower(), list(range(len(text) + 1))
    # Lower case character by character; some characters become two.
    lower = [c.lower() for c in text]
    low = "".join(lower)
    out: list[str] = []
    places: list[int] = []
    at = 0
    for m in _RULE.finditer(low):
        new = _RULES[m.lastindex - 1][1]
        new = _marked(m[0]) if new is None else new
        out += (low[at : m.start()], new)
        places += range(at, m.start())
        places += [m.start()] * len(new)
        at = m.end()
    places += range(at, len(low) + 1)
    if len(low) != len(text):
        origin = [i for i, piece in enumerate(lower) for _ in piece]
        places = [*map([*origin, len(text)].__getitem__, places)]
    return "".join(out) + low[at:], places


def fold(text: str) -> str:
    return fold_places(text)[0]
