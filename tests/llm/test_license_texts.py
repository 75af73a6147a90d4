"""Public licence texts and notices as they stand in files: on one line, wrapped, in lists and in comments."""

import textwrap

import duckdb
import pandas as pd
import pytest

from wattspan.llm import licenses, queries

WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
LIABILITY = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY.'
GNU = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
MARKS = {"numbers": "{}. ", "brackets": "({}) ", "bullets": "* ", "dashes": "- "}


def conditions(mark, *items):
    return [MARKS[mark].format(k) + x for k, x in enumerate(items, 1)]


TEXTS = {
    "MIT": ["MIT License", "Copyright (c) 2020 Somebody", f"{GRANT}, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", f"{WARRANTY} {LIABILITY}"],
    "MIT-0": ["Copyright 2021 Somebody", f"{GRANT}.", f"{WARRANTY} {LIABILITY}"],
    "Apache-2.0": ["Copyright 2019 Somebody", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "    http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "GPL-2.0-or-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", GNU],
    "GPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", GNU],
    "LGPL-2.1-or-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": ["Copyright (c) 2018 Somebody", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
BSDS = {"BSD-2-Clause": (SOURCE, BINARY), "BSD-3-Clause": (SOURCE, BINARY, ENDORSE)}


def shapes(paragraphs):
    """The same paragraphs on one line each, on one line in all, wrapped at two widths, and wrapped in comments."""
    yield "\n\n".join(paragraphs)
    yield " ".join(paragraphs)
    for width in (72, 50):
        wrapped = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in paragraphs)
        yield wrapped
        yield "\n".join(f"// {x}".rstrip() for x in wrapped.split("\n"))
        yield "\n".join(f"# {x}".rstrip() for x in wrapped.split("\n"))
        yield "/*\n" + "\n".join(f" * {x}".rstrip() for x in wrapped.split("\n")) + "\n */\nint main() {}"


def cases():
    for name, paragraphs in TEXTS.items():
        for text in shapes(paragraphs):
            yield name, text
    for name, items in BSDS.items():
        for mark in MARKS:
            for text in shapes(["Copyright (c) 2020, Somebody", BSD, *conditions(mark, *items), BSD_END]):
                yield name, text


@pytest.fixture(scope="module")
def recognised(spark):
    rows = [(k, text) for k, (_, text) in enumerate(cases())]
    return {r["doc_id"]: r for r in licenses.recognise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_texts_in_every_shape(recognised):
    wrong = [(name, recognised[k]["licenses"], text) for k, (name, text) in enumerate(cases()) if recognised[k]["licenses"] != name]
    assert not wrong, wrong[0]


def test_names_and_tags(spark):
    rows = [(f"Some words.\n{p.capitalize()} {n}.\nMore words.", name) for name, names in licenses.NAMES.items() for n in names for p in licenses.PHRASES]
    rows += [(f"// SPDX-License-Identifier: {name}\nint x;", name) for name in licenses.NAMES]
    got = licenses.recognise(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id bigint, text string")).collect()
    assert [(rows[r["doc_id"]], r["licenses"]) for r in got if r["licenses"] != rows[r["doc_id"]][1]] == []
    plain = ["The license plate was under the car.", "Permission was granted. You may not use this file.", "We walked under the bridge; nobody was liable."]
    none = licenses.recognise(spark.createDataFrame(list(enumerate(plain)), "doc_id bigint, text string")).collect()
    assert {r["licenses"] for r in none} == {""}


EXPRESSIONS = {
    "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
    "// SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
    "# SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later",
    "/* SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause) */": "BSD-2-Clause,GPL-2.0-only",
    "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note": "GPL-2.0-only",
    "SPDX-License-Identifier: LGPL-2.1-or-later AND MIT": "LGPL-2.1-or-later,MIT",
    "SPDX-License-Identifier: CC-BY-SA-4.0.": "CC-BY-SA-4.0",
    "SPDX-License-Identifier: EPL-2.0 OR GPL-3.0-or-later WITH Classpath-exception-2.0": "EPL-2.0,GPL-3.0-or-later",
    "x SPDX-License-Identifier: ISC Some words follow": "ISC",
    "SPDX-License-Identifier: MPL-2.0+": "MPL-2.0-or-later",
}
SENTENCES = {
    "Licensed under the Apache License, version 2.0 and the MIT license.": "Apache-2.0,MIT",
    "Released under the MIT license or the BSD 3-Clause License": "BSD-3-Clause,MIT",
    "This file is licensed under the GNU General Public License version 3 and/or the ISC license": "GPL-3.0-only,ISC",
    "Copyright 2020 Somebody. All rights reserved.": "",
    "It is not licensed under the MIT license.": "",
}


def test_expressions_and_several_names(spark):
    rows = [*EXPRESSIONS.items(), *SENTENCES.items()]
    got = {r["doc_id"]: r for r in licenses.recognise(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")).collect()}
    assert [(t, got[i]["licenses"]) for i, (t, want) in enumerate(rows) if got[i]["licenses"] != want] == []
    assert all(got[i]["unknown_sentences"] == 0 and got[i]["n_license_sentences"] == (1 if want else 0) for i, (_, want) in enumerate(rows))
    odd = licenses.recognise(spark.createDataFrame([(1, "SPDX-License-Identifier: Nobody-1.0 OR MIT")], "doc_id bigint, text string")).first()
    assert (odd["n_license_sentences"], odd["licenses"], odd["unknown_sentences"]) == (1, "MIT", 1)


def test_sql_finds_the_same(spark, recognised):
    texts = [t for _, t in cases()] + [*EXPRESSIONS, *SENTENCES, None, "", "SPDX-License-Identifier: Nobody-1.0"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = {r[0]: r[1:] for r in con.execute(queries.ORACLE_SQL["op7_license_sentences"]).fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.recognise(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [(texts[i], got[i], want[i]) for i in got if got[i] != want[i]] == []
