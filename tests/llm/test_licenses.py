import re

import pytest

from pagewright.llm import licenses
from pagewright.llm.licenses import Automaton, Template

AUTOMATON = Automaton.of(licenses.TEMPLATES)


def scan(text):
    return licenses.scan(text.encode(), AUTOMATON, licenses.TEMPLATES)


@pytest.mark.parametrize(
    "text,labels,score",
    [
        ("Released under the MIT License.", "mit", 1.0),
        ("Licensed under the Apache License, Version 2.0.", "apache-2", 1.0),
        ("see APACHE license -- version 2!", "apache-2", 0.5),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc", 1.0),
        ("cc-by-nc", "cc-by-nc", 0.5),
        ("under the MIT license", "mit", 0.5),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc,cc-by-nc-sa", 1.0),
        ("Licensed under CC BY-SA 4.0.", "cc-by-sa", 1.0),
        ("Licensed under CC BY 4.0.", "cc-by", 1.0),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3", 1.0),
        ("licensed under the GNU General Public License as published by the Free Software Foundation, either version 2 of the License", "gpl-2", 1.0),
        ("licensed under the gnu general public license of version 3", "", 0.0),
        ("under the mitx license", "", 0.0),
        ("under the ümit license", "", 0.0),
        ("", "", 0.0),
    ],
)
def test_labels(text, labels, score):
    assert scan(text)[5:] == (labels, score)


def test_places():
    row = scan("under the MIT license cc by nc cc by nc under the mit license")
    assert row[:5] == (14, 4, 0, 10, "cc-by-nc,mit")
    assert scan("nothing")[:4] == (1, 0, None, None)


def test_markup():
    of = (Template("x", "grant <<optional>>all <<optional>>of<<end>><<end>> rights <<var 1-2>> end"),)
    automaton = Automaton.of(of)
    accepted = lambda text: bool(automaton.accepted(text.encode().split()))
    for text in ("grant rights a end", "grant all rights a b end", "grant all of rights a end", "x grant rights grant end y"):
        assert accepted(text)
    for text in ("grant rights end", "grant of rights a end", "grant rights a b c end", "grant rights a"):
        assert not accepted(text)
    with pytest.raises(ValueError):
        Automaton.of((Template("x", "<<var 1-2>> end"),))
    with pytest.raises(ValueError):
        Automaton.of((Template("x", "a <<optional>> b"),))


def test_words():
    text = "A\x00b-C9 é_ß𝛼'd\x7fe"
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [w.decode() for w in licenses.words_of(text.encode())] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def test_awkward_rows(spark, awkward, nothing):
    rows = licenses.license_scan(awkward).collect()
    assert len(rows) == awkward.count() and licenses.license_scan(nothing).count() == 0
    assert all((r.n_words, r.labels, r.score, r.first_word) == (0, "", 0.0, None) for r in rows if r.doc_id in (2, 3, 4))


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN
NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version {} of the License, or (at your option) any later version."""


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such,
and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all
copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable
object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
POSTGRESQL = """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby
granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.

IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING
OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.

THE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS,
OR MODIFICATIONS."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""
CC = "Creative Commons Attribution{} {} License"
WHOLE = [
    (MIT, "mit"),
    (MIT.replace("NONINFRINGEMENT", "NON-INFRINGEMENT"), "mit"),
    ("Distributed under the terms of the MIT License", "mit"),
    (APACHE, "apache-2"),
    ("Licensed under the Apache License 2.0", "apache-2"),
    (BSD.format(""), "bsd"),
    (BSD.format(THIRD), "bsd"),
    (BSD.format(THIRD).replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "bsd"),
    (ISC, "isc"),
    (ISC.replace(", provided that the above copyright notice\nand this permission notice appear in all copies", ""), "0bsd"),
    (ZLIB, "zlib"),
    (ZLIB.replace("1. ", "").replace("the authors", "Some Author and contributors"), "zlib"),
    (UNLICENSE, "unlicense"),
    (BOOST, "boost-1"),
    ("Distributed under the Boost Software License, Version 1.0", "boost-1"),
    (POSTGRESQL, "postgresql"),
    (MPL, "mpl-2"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0", "epl-2"),
    ("Licensed under the EUPL, Version 1.2", "eupl-1.2"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1", "ofl-1.1"),
    ("you may redistribute it under the terms of the Artistic License version 2.0", "artistic-2"),
    ("To the extent possible under law, The Author has waived all copyright and related or neighboring rights to This Work", "cc0"),
    (GPL.format(3), "gpl-3"),
    (GPL.format(2).replace(", either", "; either"), "gpl-2"),
    ("under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "gpl-2"),
    (GPL.format(3).replace("General", "Lesser General"), "lgpl-3"),
    (GPL.format("2.1").replace("General", "Lesser General"), "lgpl-2.1"),
    (GPL.format(3).replace("General", "Affero General"), "agpl-3"),
    ("licensed under a " + CC.format("-NonCommercial", "4.0 International"), "cc-by-nc"),
    (CC.format("-Noncommercial", "3.0 United States"), "cc-by-nc"),
    (CC.format(" Non-Commercial", ""), "cc-by-nc"),
    (CC.format("", "4.0 International"), "cc-by"),
    (CC.format("", ""), "cc-by"),
    (CC.format("-ShareAlike", "4.0 International"), "cc-by-sa"),
    (CC.format("-ShareAlike", ""), "cc-by-sa"),
    (CC.format("-NoDerivatives", "4.0 International"), "cc-by-nd"),
    ("released under the GNU GPLv3 in 2020", "gpl-3"),
    ("under the terms of the GNU GPL version 2 or later", "gpl-2"),
    ("Licensed under LGPL v2.1", "lgpl-2.1"),
    ("it is under the AGPLv3", "agpl-3"),
    (MIT.replace("sublicense", "sub-license"), "mit"),
    (CC.format("-NonCommercial-ShareAlike", "4.0 International"), "cc-by-nc-sa"),
    (CC.format("-NonCommercial-NoDerivs", "3.0 Unported"), "cc-by-nc-nd"),
]


@pytest.mark.parametrize("text,labels", WHOLE)
def test_standard_notices(text, labels):
    assert scan(text)[5:] == (labels, 1.0)
    # The wording is mandatory: without three words of a whole notice it is another text.
    words = text.split()
    assert len(words) < 45 or scan(" ".join(words[: len(words) // 4 - 3] + words[len(words) // 4 :]))[5:] in (("", 0.0), (labels, 0.5), ("apache-2", 1.0))


@pytest.mark.parametrize(
    "text",
    [
        "Creative Commons License", "Creative Commons Attribution-Sampling 1.0 License", "Creative Commons Zero 4.0 License", "under the terms of the GNU Lesser General Public License, version 4",
        "under the terms of the GNU Free Documentation License, version 3", "the Mozilla Public License, v. 2.0", "Licensed under the Apache License, Version 1.1", "Apache License 2",
        "Licensed under the EUPL, Version 1.1", "the MIT License", "waived all copyright and related or neighboring rights to this", MIT[:250], BSD[:200], ISC[:150], ZLIB[:400], UNLICENSE[:120], BOOST[:200],
        # A text that begins like a notice and goes on differently is another one.
        CC.format("", "4.0 NonCommercial"), CC.format("", "3.0 for no license"), CC.format("-ShareAlike", "4.0 but not a"), MIT.replace("NONINFRINGEMENT", "USEFULNESS"), MIT.replace("sublicense", "relicense"),
        MIT.replace(" sublicense,", ""), BOOST.replace("object code", "source code"), POSTGRESQL.split("THE UNIVERSITY")[0], UNLICENSE.split("We make")[0], "under the GNU GPLv4", "GPL version 3", "under the GNU LGPL version 2.0",
    ],
)
def test_other_licenses(text):
    assert scan(text)[5:] == ("", 0.0)


@pytest.mark.parametrize("text,labels", WHOLE)
def test_sql_labels(text, labels):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1 AS doc_id, ? AS text", [text])
    assert con.sql(licenses.ORACLE).fetchall()[0][6:] == (labels, 1.0)


def test_rows_of_the_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    df = licenses.op4_license_scan(spark, "/root/testdata/sf0.01")
    want = con.sql(licenses.ORACLE).select(", ".join(df.columns)).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and any(r[6] for r in want)
