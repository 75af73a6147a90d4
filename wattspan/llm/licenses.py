"""Licence recognition by sentence rules, in DataFrame operations only.

A text is cut into sentences, at line ends and after ``.``, ``;``, ``:``, ``!`` and ``?`` before white space. A
sentence is normalised to lower-case ASCII words and mapped to the identifier of a known licence sentence.
A known sentence may also be wrapped: it then fills several whole lines, without a blank line or an end of
a sentence between them; marks of comments are no words. One of ``LONG_SENTENCE`` words or more may stand behind other
words of its line, as it does where a whole notice is one line. Of the sentences that begin at a line the longest counts.
The document's identifiers, in order, are matched against ordered rules: a rule is a sequence of
identifiers that must follow each other, and what it matches is taken out before the next rule looks, so
longer and more specific rules stand first. Identifiers that no rule takes are reported as unknown. A sentence
that names several licences ("under the A and the B license") is one sentence with an identifier for each. Tags
(``SPDX-License-Identifier:``) are read as expressions: each licence of ``AND`` and ``OR`` counts, an exception after
``WITH`` does not, ``+`` is ``-or-later``; a licence that is not known is an unknown sentence.

Only texts that hold one of ``ANCHORS`` are normalised; every known sentence holds one, so
none is missed (a test checks it). Null and empty texts have no licence. Rows that repeat, or have a null
id, are each reported. Other columns are dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers of sentences of public licence texts and notices, normalised.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-short",
    "licensed under the apache license version 2 0 the license": "apache2-licensed",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at": "apache2-copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-limits",
    "released under the mit license": "mit-short",
    "this project is licensed under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "this work is licensed under the gnu general public license version 2": "gpl2-short",
    "licensed under the gnu general public license version 3": "gpl3-short",
    "licensed under the gnu general public license version 2": "gpl2-short",
    "licensed under the gnu lesser general public license version 3": "lgpl3-short",
    "licensed under the gnu affero general public license version 3": "agpl3-short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gnu-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "licensed under the bsd 3 clause license": "bsd3-short",
    "licensed under the bsd 2 clause license": "bsd2-short",
    "licensed under the mozilla public license version 2 0": "mpl2-short",
    "licensed under cc by 4 0": "ccby4-short",
    "licensed under cc by sa 4 0": "ccbysa4-short",
    "licensed under cc by nc 4 0": "ccbync4-short",
    "licensed under cc by nd 4 0": "ccbynd4-short",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-short",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4-short",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4-short",
}
# SPDX identifiers and the names that notices use, normalised.
NAMES = {
    "0BSD": ["bsd zero clause license", "0bsd license"],
    "AFL-3.0": ["academic free license version 3 0", "academic free license 3 0"],
    "AGPL-3.0-only": ["gnu affero general public license v3 0", "agpl v3", "agplv3"],
    "Apache-1.1": ["apache software license version 1 1"],
    "Apache-2.0": ["apache license 2 0", "apache 2 0 license", "apache license version 2 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "BlueOak-1.0.0": ["blue oak model license 1 0 0"],
    "BSD-2-Clause": ["simplified bsd license", "bsd 2 clause license"],
    "BSD-3-Clause": ["new bsd license", "modified bsd license", "bsd 3 clause license"],
    "BSD-4-Clause": ["original bsd license", "bsd 4 clause license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "BUSL-1.1": ["business source license 1 1"],
    "CC-BY-SA-3.0": ["creative commons attribution sharealike 3 0 unported license"],
    "CC0-1.0": ["cc0 1 0 universal license", "creative commons zero v1 0 universal license"],
    "CDDL-1.0": ["common development and distribution license version 1 0"],
    "CECILL-2.1": ["cecill license version 2 1"],
    "CPL-1.0": ["common public license version 1 0"],
    "ECL-2.0": ["educational community license version 2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0"],
    "EUPL-1.2": ["european union public licence version 1 2", "european union public license 1 2"],
    "GPL-2.0-only": ["gnu gpl version 2", "gpl v2", "gplv2"],
    "GPL-3.0-only": ["gnu gpl version 3", "gpl v3", "gplv3"],
    "ISC": ["isc license"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "lgpl v2 1", "lgplv2 1"],
    "LGPL-3.0-only": ["gnu lgpl version 3", "lgpl v3", "lgplv3"],
    "LPPL-1.3c": ["latex project public license version 1 3c"],
    "MIT": ["mit license", "expat license"],
    "MIT-0": ["mit no attribution license", "mit 0 license"],
    "MPL-1.1": ["mozilla public license version 1 1"],
    "MPL-2.0": ["mozilla public license 2 0", "mpl 2 0"],
    "MS-PL": ["microsoft public license"],
    "MS-RL": ["microsoft reciprocal license"],
    "MulanPSL-2.0": ["mulan psl v2"],
    "NCSA": ["university of illinois ncsa open source license"],
    "ODbL-1.0": ["open database license v1 0", "open data commons open database license"],
    "OFL-1.1": ["sil open font license version 1 1"],
    "OSL-3.0": ["open software license version 3 0"],
    "PostgreSQL": ["postgresql license"],
    "PSF-2.0": ["python software foundation license version 2"],
    "Unlicense": ["unlicense"],
    "UPL-1.0": ["universal permissive license v 1 0"],
    "Vim": ["vim license"],
    "W3C": ["w3c software notice and license"],
    "WTFPL": ["wtfpl"],
    "X11": ["x11 license"],
    "Zlib": ["zlib license"],
    "ZPL-2.1": ["zope public license version 2 1"],
}
PHRASES = ("licensed under the", "released under the", "distributed under the", "this project is licensed under the", "this software is licensed under the", "this file is licensed under the")


def normal(text: str) -> str:
    """Lower-case ASCII words."""
    return " ".join(re.findall(r"[a-z0-9]+", text.lower()))


# A notice of each name by each phrase is a sentence of the identifier ``spdx:<id>``.
for _id, _names in NAMES.items():
    for _sentence in [f"{p} {n}" for n in _names for p in PHRASES]:
        SENTENCES.setdefault(_sentence, f"spdx:{_id}")

_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
# Further sentences as they stand in full in the licence texts and notices.
WHOLE = {
    f"{_MIT} subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
}
# The same for licences that no short notice above names.
TEXTS = {
    _MIT: "mit0-grant",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant-0",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "the names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-terms",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "either version 2 of the license or at your option any later version": "version2-later",
    "either version 2 1 of the license or at your option any later version": "version2.1-later",
    "either version 3 of the license or at your option any later version": "version3-later",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "distributed under the boost software license version 1 0": "spdx:BSL-1.0",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "this is free and unencumbered software released into the public domain": "unlicense-release",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "spdx:EPL-2.0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "spdx:EPL-1.0",
    "this font software is licensed under the sil open font license version 1 1": "spdx:OFL-1.1",
}
# A colon within a line ends no sentence: what it introduces is then one sentence with it.
for _sentence, _id in list(TEXTS.items()):
    if _sentence.startswith("you can redistribute it"):
        TEXTS.update({f"this {what} is free software {_sentence}": _id for what in ("program", "library", "software", "file")})
# Rules in order, each a licence and the identifiers that follow each other in its notice.
RULES = [
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache2-licensed", "apache2-compliance", "apache2-copy", "apache2-limits"]),
    ("Apache-2.0", ["apache2-licensed", "apache2-compliance", "apache2-copy"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "version3-later"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "version2.1-later"]),
    ("LGPL-2.0-or-later", ["lgpl-terms", "version2-later"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gnu-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-3.0-or-later", ["gpl-terms", "version3-later"]),
    ("GPL-2.0-or-later", ["gpl-terms", "version2-later", "gnu-warranty"]),
    ("GPL-2.0-or-later", ["gpl-terms", "version2-later"]),
    ("GPL-2.0-only", ["gpl2-terms"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant", "isc-warranty"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("Unlicense", ["unlicense-release", "unlicense-free"]),
    ("Unlicense", ["unlicense-release"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT-0", ["mit0-grant", "mit-warranty", "mit-liability"]),
    ("MIT-0", ["mit0-grant", "mit-warranty"]),
    ("Apache-2.0", ["apache2-licensed"]),
    ("Apache-2.0", ["apache2-short"]),
    ("MIT", ["mit-short"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("GPL-2.0-only", ["gpl2-short"]),
    ("LGPL-3.0-only", ["lgpl3-short"]),
    ("AGPL-3.0-only", ["agpl3-short"]),
    ("BSD-3-Clause", ["bsd3-short"]),
    ("BSD-2-Clause", ["bsd2-short"]),
    ("MPL-2.0", ["mpl2-short"]),
    ("CC-BY-4.0", ["ccby4-short"]),
    ("CC-BY-SA-4.0", ["ccbysa4-short"]),
    ("CC-BY-NC-4.0", ["ccbync4-short"]),
    ("CC-BY-ND-4.0", ["ccbynd4-short"]),
]
# Names that are spelled out in notices of several licences, beside ``NAMES``.
SPELLED = {
    "gnu general public license version 2": "GPL-2.0-only",
    "gnu general public license version 3": "GPL-3.0-only",
    "gnu lesser general public license version 3": "LGPL-3.0-only",
    "gnu affero general public license version 3": "AGPL-3.0-only",
    "mozilla public license version 2 0": "MPL-2.0",
    **{name: licence for licence, names in NAMES.items() for name in names},
}
# Families that have "only" and "or later", and other identifiers of tags beside ``NAMES``.
FAMILIES = ("AGPL-3.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0")
OTHERS = ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0")
TAGS = {x.lower(): x for x in [*NAMES, *OTHERS, *(f"{f}-{e}" for f in FAMILIES for e in ("only", "or-later"))]}
TAGS |= {f.lower(): f"{f}-only" for f in FAMILIES} | {f"{f.lower()}+": f"{f}-or-later" for f in FAMILIES} | {f"{x.lower()}+": f"{x}-or-later" for x in [*NAMES, *OTHERS] if not x.endswith("-only")}
#: What one sentence says by itself is taken out after the rules above.
SINGLE = [(k, f"spdx:{k}") for k in sorted({*NAMES, *SPELLED.values(), *TAGS.values()})]
#: A tag and its expression, in lower case.
TAG_ID = r"\(*[a-z0-9][a-z0-9.+-]*\)*"
TAG = rf"spdx-license-identifier:[ \t]*({TAG_ID}(?:[ \t]+(?:and|or|with)[ \t]+{TAG_ID})*)"
ANCHORS = ("licen", "permi", "warrant", "redistribut", "copyright", "spdx", "under the", "unencumbered", "liable", "advertising", "anyone is free", "names of its", "copy of the mpl")
#: A sentence ends here, line ends apart. White space is ASCII, so that other engines cut alike.
ENDS = r"[.;:!?](?=[\x20\x09-\x0D]|$)"
#: A list mark in brackets at the start of a line or sentence, behind marks of comments: it is no word.
LIST_MARK = r"(^|[|\n])([^a-z0-9|\n]*)\(?(?:[0-9]{1,2}|[a-z])\) "
SENTENCE_IDS = {**SENTENCES, **WHOLE, **TEXTS}
_NAME = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
#: A sentence that names several licences.
SEVERAL = f"(?:{'|'.join(sorted(PHRASES, key=len, reverse=True))}) {_NAME}(?: (?:and or|and|or) (?:the )?{_NAME})+"


#: A known sentence of so many words counts also behind words without an end of their own, as titles in reflowed texts are.
LONG_SENTENCE = 10


def known(space: str, least_words: int = 0) -> str:
    """Known sentences, the longest first, their words parted by ``space``; first those that name several licences."""
    several = [] if least_words else [SEVERAL.replace(" ", space)]
    return "|".join([*several, *(s.replace(" ", space) for s in sorted(SENTENCE_IDS, key=len, reverse=True) if s.count(" ") + 1 >= least_words)])


#: A known sentence from one end to another; its words may stand on several lines.
KNOWN = rf"(?:(?<![^|\n])(?:{known('[ \n]')})|(?<= )(?:{known('[ \n]', LONG_SENTENCE)}))(?![^|\n])"


def has_anchor(lowered: Column) -> Column:
    out = F.lit(False)
    for a in ANCHORS:
        out = out | F.contains(lowered, F.lit(a))
    return out


def normalise(lowered: Column) -> Column:
    """Words of a lower-case text; ``|`` where a sentence ends or lines are blank, a line feed at other line ends."""
    cut = F.regexp_replace(F.translate(lowered, "|", "-"), ENDS, "|")
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, LIST_MARK, "$1$2"), r"[^a-z0-9|\n]+", " "), r" ?([|\n]) ?", "$1")
    return F.regexp_replace(F.trim(lines), r"\n*\|[|\n]*|\n\n+", "|")


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def tag_ids(lowered: Column) -> Column:
    """For each tag, the identifiers of the licences that its expression names."""
    tags, names = F.regexp_extract_all(lowered, F.lit(TAG), F.lit(1)), _table(TAGS)

    def licences(tag: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(tag, r"[()]", ""), r"[ \t]+with[ \t]+[^ \t]+", ""), r"\.$", "")
        parts = F.split(bare, r"[ \t]+(?:and|or)[ \t]+")
        return F.transform(parts, lambda p: F.concat(F.lit("spdx:"), F.coalesce(F.try_element_at(names, p), F.lit("?"))))

    return F.transform(tags, licences)


def sentence_ids(text: Column) -> Column:
    """For each known sentence and tag of a text, in order (tags last), its identifiers."""
    lowered, ids, names = F.lower(text), _table(SENTENCE_IDS), _table(SPELLED)
    found = F.regexp_extract_all(normalise(F.regexp_replace(lowered, TAG, ".\n")), F.lit(KNOWN), F.lit(0))

    def of(sentence: Column) -> Column:
        s = F.replace(sentence, F.lit("\n"), F.lit(" "))
        several = F.transform(F.regexp_extract_all(s, F.lit(f"({_NAME})"), F.lit(1)), lambda n: F.concat(F.lit("spdx:"), F.try_element_at(names, n)))
        return F.when(F.try_element_at(ids, s).isNotNull(), F.array(F.try_element_at(ids, s))).otherwise(several)

    every = F.concat(F.transform(found, of), tag_ids(lowered))
    return F.when(has_anchor(lowered), every).otherwise(F.array().cast("array<array<string>>"))


def recognise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_license_sentences, licenses (sorted, joined by a comma), unknown_sentences."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(text).alias("ids"))
    # Identifiers stand between double blanks: a rule's own blanks then never overlap the next one's.
    joined = F.array_join(F.transform(F.flatten("ids"), lambda i: F.concat(i, F.lit(" "))), " ")
    out = out.select("doc_id", F.size("ids").cast("long").alias("n_license_sentences"), F.concat(F.lit(" "), joined).alias("left"), F.array().cast("array<string>").alias("found"))
    for name, ids in RULES:
        sought = " " + "  ".join(ids) + " "
        out = out.select("doc_id", "n_license_sentences", F.replace("left", F.lit(sought), F.lit("|")).alias("left"), F.when(F.contains("left", F.lit(sought)), F.array_append("found", F.lit(name))).otherwise(F.col("found")).alias("found"))
    # Identifiers of one sentence: a map from the identifier to the licence, for all of them in one pass.
    single = F.create_map(*(F.lit(x) for name, i in SINGLE for x in (i, name)))
    left = F.filter(F.split("left", r"[ |]+"), lambda x: x != "")
    out = out.select("doc_id", "n_license_sentences", "found", left.alias("left"))
    out = out.select("doc_id", "n_license_sentences", F.concat("found", F.array_compact(F.transform("left", lambda x: F.try_element_at(single, x)))).alias("found"), F.filter("left", lambda x: F.try_element_at(single, x).isNull()).alias("left"))
    rest = F.col("left")
    return out.select("doc_id", "n_license_sentences", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("licenses"), F.size(rest).cast("long").alias("unknown_sentences"))
