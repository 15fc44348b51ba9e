"""License scans by templates compiled into token automata.

Templates are marked up: <<optional>> ... <<end>> may be left out, <<var LEAST-MOST>> stands for any words,
that many of them. All other wording is mandatory, word for word. A template becomes a nondeterministic
automaton over words; texts are accepted where it reaches its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.shared import binaries, spread, struct_array, struct_of

#: Upper case to lower case; whatever is no letter, digit or part of a longer character to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MARK = re.compile(r"<<(optional|end|var (\d+)-(\d+))>>")


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z, as UTF-8."""
    return text.translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    #: A plain phrase, of which each place counts.
    base: bool = False


#: Phrases and labels of the contract, of which every place counts.
BASE: tuple[Template, ...] = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)

#: Wording of public license notices, in full.
_MIT = [
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute " + sublicense + " and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and " + noninfringement + " "
    "in no event shall <<var 1-20>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    for sublicense in ("sublicense", "sub license")
    for noninfringement in ("noninfringement", "non infringement")
]
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<var 0-1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<var 0-1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
    "<<optional>><<var 0-1>> all advertising materials mentioning features or use of this software must display the following <<var 1-1>> this product includes software developed by <<var 1-20>><<end>> "
    "<<optional>><<var 0-1>> neither the name of <<var 1-20>> nor the names of <<var 0-4>> contributors may be used to endorse or promote products derived from this software without specific prior written permission<<end>> "
    "this software is provided by <<var 1-20>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<var 1-20>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC = (
    "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and <<var 1-20>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall <<var 1-20>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)


_0BSD = (
    "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted "
    "the software is provided as is and <<var 1-20>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall <<var 1-20>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will <<var 1-20>> be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
    "<<var 0-1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software "
    "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
    "<<var 0-1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
    "<<var 0-1>> this notice may not be removed or altered from any source distribution"
)
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
    "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
    "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
    "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
    "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
    "<<optional>>noninfringement<<end>> <<optional>>non infringement<<end>> in no event shall the authors be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BOOST = (
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
    "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so "
    "all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer "
    "must be included in all copies of the software in whole or in part and all derivative works of the software "
    "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and "
    "<<optional>>noninfringement<<end>> <<optional>>non infringement<<end>> in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability "
    "whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_POSTGRESQL = (
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted "
    "provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies "
    "in no event shall <<var 1-20>> be liable to any party for direct indirect special incidental or consequential damages including lost profits arising out of the use of this software and its documentation "
    "even if <<var 1-20>> has been advised of the possibility of such damage <<var 1-20>> specifically disclaims any warranties including but not limited to the implied warranties of merchantability "
    "and fitness for a particular purpose the software provided hereunder is on an as is basis and <<var 1-20>> has no obligations to provide maintenance support updates enhancements or modifications"
)
_MPL = (
    "this source code form is subject to the terms of the mozilla public license v 2 0 "
    "if a copy of the mpl was not distributed with this file you can obtain one at <<optional>>http<<end>> <<optional>>https<<end>> mozilla org mpl 2 0"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "<<optional>>http<<end>> <<optional>>https<<end>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
)
_CC0 = "to the extent possible under law <<var 1-30>> <<optional>>has<<end>> <<optional>>have<<end>> waived all copyright and related or neighboring rights to <<var 1-1>>"


def _gnu(label: str, name: str, version: str) -> Iterator[Template]:
    later = "<<optional>>of the license<<end>> <<optional>>only<<end>> <<optional>>or at your option any later version<<end>>"
    for begin in ("licensed under <<optional>>the terms of<<end>>", "under the terms of"):
        begin += f" the gnu {name} <<optional>>gpl<<end>> <<optional>>lgpl<<end>> <<optional>>agpl<<end>> <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>>"
        yield Template(label, f"{begin} version {version} {later}")
        yield Template(label, f"{begin} v{version}")
    short = {"general": "gpl", "lesser": "lgpl", "affero": "agpl"}[name.split()[0]]
    for begin in ("licensed under", "licensed under the", "under the", "under the terms of the"):
        for said in (f"{short}v{version}", f"{short} v{version}", f"{short} version {version}"):
            yield Template(label, f"{begin} <<optional>>gnu<<end>> {said}")


#: What may stand between a version and the word license.
_PORTS = (
    "international", "unported", "generic", "public", "united states", "germany", "austria", "switzerland", "france", "spain", "italy", "netherlands", "poland", "portugal", "australia",
    "new zealand", "canada", "japan", "brazil", "igo",
)


def _creative_commons() -> Iterator[Template]:
    """Each kind by its name with a version, and in short. What follows the kind is fixed, so that none is taken for a longer one."""
    kinds = {
        "cc-by": ("by", ("",)), "cc-by-sa": ("by sa", ("sharealike", "share alike")), "cc-by-nd": ("by nd", ("noderivatives", "no derivatives", "noderivs")),
        "cc-by-nc": ("by nc", ("noncommercial", "non commercial")), "cc-by-nc-sa": ("by nc sa", ("noncommercial sharealike", "non commercial share alike")),
        "cc-by-nc-nd": ("by nc nd", ("noncommercial noderivatives", "non commercial no derivatives", "noncommercial noderivs")),
    }
    ports = " ".join(f"<<optional>>{port}<<end>>" for port in _PORTS)
    for label, (short, names) in kinds.items():
        for version in ("1 0", "2 0", "2 1", "2 5", "3 0", "4 0"):
            yield Template(label, f"licensed under <<optional>>a<<end>> <<optional>>creative commons<<end>> cc {short} {version}")
            for name in names:
                yield Template(label, f"creative commons attribution {name} <<optional>>version<<end>> {version} {ports} license")
        for name in names:
            yield Template(label, f"creative commons attribution {name} <<optional>>international<<end>> <<optional>>unported<<end>> <<optional>>generic<<end>> <<optional>>public<<end>> license")


#: The wording of public license notices.
TEMPLATES: tuple[Template, ...] = (
    *BASE,
    *(Template("mit", f"{verb} under the <<optional>>terms of the<<end>> mit license") for verb in ("released", "licensed", "distributed", "available")),
    *(Template("mit", markup) for markup in _MIT),
    Template("apache-2", "licensed under the apache license <<optional>>version<<end>> 2 <<optional>>0<<end>> <<optional>>the license<<end>>"),
    Template("apache-2", _APACHE),
    *_creative_commons(),
    Template("cc0", _CC0),
    *_gnu("gpl-2", "general public license", "2"),
    *_gnu("gpl-3", "general public license", "3"),
    *_gnu("lgpl-2.1", "lesser general public license", "2 1"),
    *_gnu("lgpl-3", "lesser general public license", "3"),
    *_gnu("agpl-3", "affero general public license", "3"),
    Template("mpl-2", _MPL),
    Template("epl-2", "made available under the terms of the eclipse public license <<optional>>version<<end>> <<optional>>v<<end>> 2 0"),
    Template("eupl-1.2", "licensed under the eupl <<optional>>version<<end>> 1 2"),
    Template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    Template("artistic-2", "under the <<optional>>terms of the<<end>> artistic license <<optional>>version<<end>> 2 0"),
    Template("boost-1", "distributed under the boost software license version 1 0"),
    Template("boost-1", _BOOST),
    Template("bsd", _BSD),
    Template("isc", _ISC),
    Template("0bsd", _0BSD),
    Template("zlib", _ZLIB),
    Template("unlicense", _UNLICENSE),
    Template("postgresql", _POSTGRESQL),
)


@dataclass
class Automaton:
    """One automaton for all templates. State s reads word w into next[s][w], and any word into any_word[s]."""

    next: list[dict[bytes, tuple[int, ...]]] = field(default_factory=list)
    any_word: list[tuple[int, ...]] = field(default_factory=list)
    free: list[tuple[int, ...]] = field(default_factory=list)
    #: Template number by accepting state.
    accepts: dict[int, int] = field(default_factory=dict)
    #: States after a template's first word.
    begins: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def _state(self) -> int:
        self.next.append({})
        self.any_word.append(())
        self.free.append(())
        return len(self.next) - 1

    def _add(self, number: int, markup: str) -> int:
        first = at = self._state()
        opened: list[int] = []
        end = 0
        for mark in [*_MARK.finditer(markup), None]:
            for word in words_of(markup[end : mark.start() if mark else None].encode()):
                to = self._state()
                self.next[at][word] = (*self.next[at].get(word, ()), to)
                at = to
            if mark is None:
                break
            end = mark.end()
            if mark[1] == "optional":
                opened.append(at)
            elif mark[1] == "end":
                to = self._state()
                self.free[at] += (to,)
                self.free[opened.pop()] += (to,)
                at = to
            else:
                least, most = int(mark[2]), int(mark[3])
                skips = []
                for k in range(most):
                    if k >= least:
                        skips.append(at)
                    to = self._state()
                    self.any_word[at] += (to,)
                    at = to
                to = self._state()
                for s in [*skips, at]:
                    self.free[s] += (to,)
                at = to
        if opened:
            raise ValueError(f"<<optional>> without <<end>>: {markup}")
        self.accepts[at] = number
        return first

    def closed(self, states: tuple[int, ...]) -> tuple[int, ...]:
        found, rest = set(states), list(states)
        while rest:
            for s in self.free[rest.pop()]:
                if s not in found:
                    found.add(s)
                    rest.append(s)
        return tuple(sorted(found))

    @classmethod
    def of(cls, templates: tuple[Template, ...]) -> Automaton:
        self = cls()
        for number, template in enumerate(templates):
            first = self.closed((self._add(number, template.markup),))
            if any(self.any_word[s] or s in self.accepts for s in first):
                raise ValueError(f"a template starts with a word of its own: {template.markup}")
            for s in first:
                for word, to in self.next[s].items():
                    self.begins[word] = (*self.begins.get(word, ()), *to)
        self.begins = {w: self.closed(s) for w, s in self.begins.items()}
        self.next = [{w: self.closed(s) for w, s in x.items()} for x in self.next]
        self.any_word = [self.closed(x) for x in self.any_word]
        return self

    def accepted(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, first word) of each place where a template is accepted."""
        begins, found = self.begins, []
        for start in [i for i, w in enumerate(words) if w in begins]:
            states: tuple[int, ...] | set[int] = begins[words[start]]
            reached = {self.accepts[s] for s in states if s in self.accepts}
            for word in _tail(words, start + 1):
                after: set[int] = set()
                for s in states:
                    if word in self.next[s]:
                        after.update(self.next[s][word])
                    after.update(self.any_word[s])
                if not after:
                    break
                states = after
                reached.update(self.accepts[s] for s in states if s in self.accepts)
            found += [(number, start) for number in sorted(reached)]
        return found


def _tail(words: list[bytes], start: int):
    for i in range(start, len(words)):
        yield words[i]


_RESULT = struct_of("n_words long,n_base long,first_word long,last_word long,base_labels string,labels string,score double")


def scan(text: bytes | None, automaton: Automaton, templates: tuple[Template, ...]) -> tuple:
    words = words_of(text)
    found = automaton.accepted(words)
    base = [start for number, start in found if templates[number].base]
    base_labels = {templates[number].label for number, _ in found if templates[number].base}
    own = {templates[number].label for number, _ in found if not templates[number].base}
    score = 1.0 if own else 0.5 if base_labels else 0.0
    return (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | own)), score)


def scanned(templates: tuple[Template, ...] = TEMPLATES):
    """The scan as an Arrow UDF on texts. The automaton is some hundred states, as many as the templates' words."""
    automaton = Automaton.of(templates)

    @F.arrow_udf(_RESULT)
    def run(texts: pa.Array) -> pa.Array:
        return struct_array(_RESULT, [scan(t, automaton, templates) for t in binaries(texts)])

    return run


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): a row for each row of docs.

    Very long texts are scanned whole, word by word; other columns are ignored. A null text is empty: no words, no labels, score 0. score is 1 where a whole template is accepted, 0.5
    where only a base phrase stands, else 0. Repeated rows are scanned each; an empty table gives none.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), scanned(templates)(F.col(text)).alias("s")).select("doc_id", "s.*")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_PORT = "((international|unported|generic|public|united states|germany|austria|switzerland|france|spain|italy|netherlands|poland|portugal|australia|new zealand|canada|japan|brazil|igo) )*"
#: What SQL takes for a notice, written for itself: short ones in full, bodies by their first and last sentences.
_NOTICES = (
    ("mit", "(released|licensed|distributed|available) under the (terms of the )?mit license"),
    ("apache-2", "licensed under the apache license (version )?2"),
    ("cc-by", "(licensed under (a )?(creative commons )?cc by [1-4] [015]|creative commons attribution (version )?[1-4] [015] " + _PORT + "license|creative commons attribution (international |unported |generic |public )?license)"),
    ("cc-by-sa", "(licensed under (a )?(creative commons )?cc by sa [1-4] [015]|creative commons attribution share ?alike (version )?[1-4] [015] " + _PORT + "license|creative commons attribution share ?alike (international |unported |generic |public )?license)"),
    ("cc-by-nc", "(licensed under (a )?(creative commons )?cc by nc [1-4] [015]|creative commons attribution non ?commercial (version )?[1-4] [015] " + _PORT + "license|creative commons attribution non ?commercial (international |unported |generic |public )?license)"),
    ("gpl-2", "(licensed under|under the terms of) (the terms of )?the gnu general public license (gpl )?(as published by the free software foundation )?(either )?(version 2|v2)"),
    ("gpl-3", "(licensed under|under the terms of) (the terms of )?the gnu general public license (gpl )?(as published by the free software foundation )?(either )?(version 3|v3)"),
    ("lgpl-3", "(licensed under|under the terms of) (the terms of )?the gnu lesser general public license (lgpl )?(as published by the free software foundation )?(either )?(version 3|v3)"),
    ("agpl-3", "(licensed under|under the terms of) (the terms of )?the gnu affero general public license (agpl )?(as published by the free software foundation )?(either )?(version 3|v3)"),
    *((f"{kind}gpl-{version}", f"(licensed under|licensed under the|under the|under the terms of the) (gnu )?{kind}gpl(v| v| version ){version.replace('.', ' ')}") for kind, version in (("", "2"), ("", "3"), ("l", "2.1"), ("l", "3"), ("a", "3"))),
    ("boost-1", "distributed under the boost software license version 1 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and .* publish distribute sub ?license and or sell .* fitness for a particular purpose and non ?infringement in no event .* or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted .* even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and (or )?distribute this software .* appear in all copies the software is .* the use or performance of this software"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation .* all subject to the following the copyright notices .* generated by a source language processor the software .* or the use or other dealings in the software"),
    ("lgpl-2.1", "(licensed under|under the terms of) (the terms of )?the gnu lesser general public license (lgpl )?(as published by the free software foundation )?(either )?(version 2 1|v2 1)"),
    ("cc-by-nd", "(licensed under (a )?(creative commons )?cc by nd [1-4] [015]|creative commons attribution (noderivatives|no derivatives|noderivs) ((version )?[1-4] [015] " + _PORT + "|international |unported |generic |public )?license)"),
    ("cc-by-nc-sa", "(licensed under (a )?(creative commons )?cc by nc sa [1-4] [015]|creative commons attribution (noncommercial sharealike|non commercial share alike) ((version )?[1-4] [015] " + _PORT + "|international |unported |generic |public )?license)"),
    ("cc-by-nc-nd", "(licensed under (a )?(creative commons )?cc by nc nd [1-4] [015]|creative commons attribution (noncommercial noderivatives|non commercial no derivatives|noncommercial noderivs) ((version )?[1-4] [015] " + _PORT + "|international |unported |generic |public )?license)"),
    ("cc0", "to the extent possible under law ([^ ]+ ){1,30}(has |have )?waived all copyright and related or neighboring rights to [^ ]+"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 .* mozilla org mpl 2 0"),
    ("epl-2", "made available under the terms of the eclipse public license (version )?(v )?2 0"),
    ("eupl-1.2", "licensed under the eupl (version )?1 2"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("artistic-2", "under the (terms of the )?artistic license (version )?2 0"),
    ("0bsd", "permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted the software is provided as is .* the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event .* this notice may not be removed or altered from any source distribution"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation .* the following two paragraphs appear in all copies in no event .* has no obligations to provide maintenance support updates enhancements or modifications"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone .* and by any means in jurisdictions .* under copyright law the software .* or the use or other dealings in the software"),
)

_PHRASES = [(t.label, "".join(f" {w} " for w in t.markup.split())) for t in BASE]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _labels_sql(pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{label}' END" for label, test in pairs) + "], lambda v: v IS NOT NULL)"


def _spaces_before(p: str, first: bool) -> str:
    head = f"left(s, strpos(s, '{p}') - 1)" if first else f"left(s, length(s) - length(list_last(string_split(s, '{p}'))) - {len(p)})"
    return f"CASE WHEN strpos(s, '{p}') > 0 THEN length({head}) - length(replace({head}, ' ', '')) END"


# s has two spaces between words, so that phrases that touch are both found; t has one.
ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
n AS (SELECT doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, '  ') || ' ' AS s, ' ' || array_to_string(ws, ' ') || ' ' AS t FROM w),
f AS (SELECT *, {_labels_sql([(label, f"strpos(s, '{p}') > 0") for label, p in _PHRASES])} AS base,
             {_labels_sql([(label, f"regexp_matches(t, ' {p} ')") for label, p in _NOTICES])} AS own FROM n)
SELECT doc_id, n_words::BIGINT AS n_words,
       ({' + '.join(f"(length(s) - length(replace(s, '{p}', ''))) // {len(p)}" for _, p in _PHRASES)})::BIGINT AS n_base,
       (least({', '.join(_spaces_before(p, True) for _, p in _PHRASES)}) // 2)::BIGINT AS first_word,
       (greatest({', '.join(_spaces_before(p, False) for _, p in _PHRASES)}) // 2)::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') AS labels,
       CASE WHEN len(own) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM f
"""
