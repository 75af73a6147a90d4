"""Licence notices as they stand in files: hard-wrapped, in comments."""

from wattspan.llm import licenses

MIT = '''MIT License

Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.
'''
BSD2 = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
BSD3 = BSD2 + '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''
GPL = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
'''


def commented(text: str, mark: str) -> str:
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


def test_wrapped_notices(spark):
    want = {"MIT": (MIT, 3), "BSD-2-Clause": (BSD2, 3), "BSD-3-Clause": (BSD3, 4), "Apache-2.0": (APACHE, 4), "GPL-3.0-or-later": (GPL, 2)}
    rows = [(f"{name} {k}", form(text)) for name, (text, _) in want.items() for k, form in enumerate((str, lambda t: commented(t, "#"), lambda t: commented(t, " *"), lambda t: t.replace("\n", "\r\n")))]
    rows += [("GPL-3.0-or-later ;", GPL.replace("software:", "software;")), ("MIT short", "Foo\nLicensed under the\nMIT License\nbar")]
    rows += [(" blank", "licensed under\n\nthe MIT license"), (" prose", "it is licensed under the MIT license and more"), (" stop", "Licensed under. The MIT license"), ("MIT short", "Licensed under.| the MIT license")]
    got = licenses.recognise(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    for r in got:
        name, _, _ = r["doc_id"].partition(" ")
        assert r["licenses"] == name, r
        if name and r["doc_id"] != "MIT short":
            assert (r["n_license_sentences"], r["unknown_sentences"]) == (want[name][1], 0), r


def test_whole_sentences_have_known_identifiers():
    assert set(licenses.WHOLE.values()) <= set(licenses.SENTENCES.values())
    assert all(any(a in s for a in licenses.ANCHORS) for s in licenses.WHOLE)
