"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, once with line ends as ends and once with lines of
a paragraph joined. Normalised sentences are looked up among known licence
sentences; the ids found, in order, are matched against ordered rules: a rule's
ids must follow each other with no other known sentence between. At each place
the longest rule wins, and matches don't overlap. Licences of both readings count;
the evidence is that of the reading with more matches. A text without any word that
a known sentence must hold is not cut at all, which changes no result.

Normalising: lower case, `licence` as `license`, all but ASCII letters and
digits as one space; a sentence ends at . ! ? before white space, a paragraph at a
line with nothing but marks of comments. An SPDX expression is a sentence for each
of the licences that it joins by or, and, with.

Defined results: null and empty texts name no licence; repeated sentences
repeat their id; equal texts get equal results. Nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts, by an id of our own.
SENTENCES = {
    "mit-short": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "This project is licensed under the terms of the MIT license", "Licensed under the terms of the MIT license"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-conditions": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "apache-short": ["Licensed under the Apache License, Version 2.0", "This project is licensed under the Apache License, Version 2.0", "This project is licensed under the terms of the Apache License, Version 2.0", "This project is licensed under the Apache 2.0 license"],
    "apache-notice": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'],
    "apache-obtain": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-at": ["You may obtain a copy of the License at"],
    "apache-url": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-grant": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"],
    "apache-warranty": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"],
    "gpl2-short": ["Licensed under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2"],
    "gpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl3-copyleft": ["The GNU General Public License is a free, copyleft license for software and other kinds of works"],
    "gpl2-free": ["The licenses for most software are designed to take away your freedom to share and change it"],
    "agpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl3-short": ["Licensed under the GNU Affero General Public License, version 3", "This project is licensed under the GNU Affero General Public License v3.0"],
    "lgpl21-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl-warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl21-short": ["Licensed under the GNU Lesser General Public License, version 2.1"],
    "epl2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "bsl-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "bsl-short": ["Distributed under the Boost Software License, Version 1.0"],
    "cc0-short": ["Licensed under CC0 1.0", "This work is licensed under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-damages": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "lgpl-short": ["Licensed under the GNU Lesser General Public License, version 3"],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "cc-by-nc-short": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-short": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-short": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain"],
    "all-rights": ["All rights reserved"],
}
# SPDX identifiers that a line "SPDX-License-Identifier:" may name.
SPDX = "MIT ISC BSD-2-Clause BSD-3-Clause Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 Zlib Unlicense".split()
SENTENCES |= {f"spdx-{x.lower()}": [f"SPDX-License-Identifier: {x}"] for x in SPDX}
# Ordered rules of sentence ids, by SPDX identifier.
RULES = [
    (("mit-grant", "mit-notice", "mit-warranty", "mit-liability"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("mit-short",), "MIT"),
    (("isc-grant",), "ISC"),
    (("bsd-conditions", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("bsd-conditions", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("all-rights", "bsd-conditions", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("all-rights", "bsd-conditions", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("apache-notice", "apache-obtain", "apache-warranty"), "Apache-2.0"),
    (("apache-notice", "apache-at", "apache-url", "apache-warranty"), "Apache-2.0"),
    (("apache-grant",), "Apache-2.0"),
    (("apache-notice",), "Apache-2.0"),
    (("apache-short",), "Apache-2.0"),
    (("gpl3-later", "gpl-warranty"), "GPL-3.0-or-later"),
    (("gpl3-later",), "GPL-3.0-or-later"),
    (("gpl2-later", "gpl-warranty"), "GPL-2.0-or-later"),
    (("gpl2-later",), "GPL-2.0-or-later"),
    (("gpl3-short",), "GPL-3.0-only"),
    (("gpl2-short",), "GPL-2.0-only"),
    (("gpl3-copyleft",), "GPL-3.0-only"),
    (("gpl2-free",), "GPL-2.0-only"),
    (("agpl3-later", "gpl-warranty"), "AGPL-3.0-or-later"),
    (("agpl3-later",), "AGPL-3.0-or-later"),
    (("agpl3-short",), "AGPL-3.0-only"),
    (("lgpl21-later", "lgpl-warranty"), "LGPL-2.1-or-later"),
    (("lgpl21-later",), "LGPL-2.1-or-later"),
    (("lgpl21-short",), "LGPL-2.1-only"),
    (("epl2-notice",), "EPL-2.0"),
    (("bsl-grant",), "BSL-1.0"),
    (("bsl-short",), "BSL-1.0"),
    (("cc0-short",), "CC0-1.0"),
    (("zlib-warranty", "zlib-damages", "zlib-grant"), "Zlib"),
    (("zlib-grant",), "Zlib"),
    (("lgpl-short",), "LGPL-3.0-only"),
    (("mpl-notice",), "MPL-2.0"),
    (("cc-by-nc-short",), "CC-BY-NC-4.0"),
    (("cc-by-sa-short",), "CC-BY-SA-4.0"),
    (("cc-by-short",), "CC-BY-4.0"),
    (("unlicense-domain",), "Unlicense"),
    (("all-rights",), "LicenseRef-all-rights-reserved"),
] + [((f"spdx-{x.lower()}",), x) for x in SPDX]
#: Each known sentence holds one of these; lower-case text without any has none.
ANCHORS = ("licens", "licenc", "permission", "copyright", "redistribut", "warrant", "liab", "domain", "reserved")

BLANK, ENDERS, OTHER, AROUND = r"\n[ \t\r#*/;>-]*\n", r"[.!?]+(\s|\z)", r"[^a-z0-9\n]+", r" *\n *"


#: How a normalised SPDX line begins; "or later" is no joint of two licences.
NAMED, JOINTS, LATER, KEPT = "spdx license identifier ", " (or|and|with) ", " or later", " orlater"


def normal(sentence: str) -> list[str]:
    """The normalised sentences of a known text, as sentences() gives them."""
    t = re.sub(OTHER, " ", re.sub(r"[.!?]+(\s|$)", "\n", sentence.lower().replace("licence", "license")))
    found = [s.strip() for s in t.split("\n") if s.strip()]
    return [s.replace(LATER, KEPT) if s.startswith(NAMED) else s for s in found]


def known_sentences(sentences: dict[str, list[str]]) -> dict[str, str]:
    """Id by normalised sentence; each known text must be one sentence."""
    several = [t for texts in sentences.values() for t in texts if len(normal(t)) != 1]
    if several:
        raise ValueError(f"not one sentence: {several[0]!r}")
    return {normal(t)[0]: name for name, texts in sentences.items() for t in texts}


def sentences(text: Column, joined: bool) -> Column:
    """Normalised sentences in order, lines joined within paragraphs or not."""
    t = F.replace(F.lower(text), F.lit("licence"), F.lit("license"))
    if joined:
        t = F.replace(F.regexp_replace(t, BLANK, ". "), F.lit("\n"), F.lit(" "))
    found = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, ENDERS, "\n"), OTHER, " "), AROUND, "\n")), "\n")

    def named(s: Column) -> Column:
        rest = F.replace(F.substring(s, len(NAMED) + 1, 2**31 - 1), F.lit(LATER), F.lit(KEPT))
        return F.transform(F.split(rest, JOINTS), lambda x: F.concat(F.lit(NAMED), F.trim(x)))

    return F.flatten(F.transform(found, lambda s: F.when(s.startswith(NAMED), named(s)).otherwise(F.array(s))))


def scan(docs: DataFrame, *, text_col: str = "text", known: dict[str, list[str]] | None = None, rules: list[tuple[tuple[str, ...], str]] | None = None) -> DataFrame:
    """docs with licenses (of both readings: distinct, sorted, comma-joined; empty if
    none), n_rules and sentence_ids: the matches of the reading that has more (that
    with line ends as ends, if as many), and the ids found in it, in order; columns of
    these names are replaced."""
    known, rules = known or SENTENCES, rules or RULES
    names = known_sentences(known)
    if missing := [s for s in names if known is SENTENCES and not any(a in s for a in ANCHORS)]:
        raise ValueError(f"no anchor in {missing}")
    lookup = F.create_map(*[F.lit(x) for s, name in names.items() for x in (s, f"<{name}>")])
    spelled = {"".join(f"<{i}>" for i in ids): spdx for ids, spdx in rules}
    pattern = "|".join(re.escape(s) for s in sorted(spelled, key=lambda s: -s.count("<")))
    licence = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair])
    docs = docs.drop("licenses", "n_rules", "sentence_ids")
    may = F.lit(known is not SENTENCES)
    for a in ANCHORS:
        may = may | F.contains(F.lower(docs[text_col]), F.lit(a))

    def ids(joined: bool) -> Column:
        found = F.filter(F.transform(sentences(docs[text_col], joined), lambda s: F.try_element_at(lookup, s)), lambda x: x.isNotNull())
        return F.coalesce(F.when(may, F.array_join(found, "")), F.lit(""))

    def matched(c: str) -> Column:
        return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    out = docs.withColumns({"_vs_lines": ids(False), "_vs_joined": ids(True)})
    out = out.withColumns({"_vs_a": matched("_vs_lines"), "_vs_b": matched("_vs_joined")})
    more = F.size("_vs_b") > F.size("_vs_a")
    return out.withColumns({
        "licenses": F.array_join(F.array_sort(F.array_distinct(F.transform(F.concat("_vs_a", "_vs_b"), lambda s: licence[s]))), ","),
        "n_rules": F.greatest(F.size("_vs_a"), F.size("_vs_b")).cast("long"),
        "sentence_ids": F.when(more | (F.col("_vs_lines") == ""), F.col("_vs_joined")).otherwise(F.col("_vs_lines")),
    }).drop("_vs_lines", "_vs_joined", "_vs_a", "_vs_b")


def oracle_sql() -> str:
    """scan over documents in SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    names = known_sentences(SENTENCES)
    spelled = {"".join(f"<{i}>" for i in ids): spdx for ids, spdx in RULES}
    pattern = "|".join(sorted(spelled, key=lambda s: -s.count("<")))

    def cut(t: str) -> str:
        return rf"trim(regexp_replace(regexp_replace(regexp_replace({t}, '{ENDERS}', chr(10), 'g'), '{OTHER}', ' ', 'g'), '{AROUND}', chr(10), 'g'), ' ')"

    low = "replace(lower(coalesce(text, '')), 'licence', 'license')"
    paragraphs = rf"replace(regexp_replace({low}, '{BLANK}', '. ', 'g'), chr(10), ' ')"
    return f"""
WITH known(s, id) AS (VALUES {", ".join(f"({quote(s)}, {quote(f'<{n}>')})" for s, n in names.items())}),
rules(p, spdx) AS (VALUES {", ".join(f"({quote(p)}, {quote(l)})" for p, l in spelled.items())}),
parts AS (SELECT doc_id, 0 way, string_split({cut(low)}, chr(10)) s FROM documents
          UNION ALL SELECT doc_id, 1, string_split({cut(paragraphs)}, chr(10)) FROM documents),
cut AS (SELECT doc_id, way, flatten(list_transform(s, lambda x: CASE WHEN starts_with(x, {quote(NAMED)})
        THEN list_transform(string_split_regex(replace(substr(x, {len(NAMED) + 1}), {quote(LATER)}, {quote(KEPT)}), {quote(JOINTS.replace("(or", "(?:or"))}), lambda y: {quote(NAMED)} || trim(y, ' '))
        ELSE [x] END)) s FROM parts),
each AS (SELECT doc_id, way, unnest(s) s, unnest(range(len(s))) i FROM cut),
ids AS (SELECT doc_id, way, string_agg(id, '' ORDER BY i) ids FROM each JOIN known USING (s) GROUP BY doc_id, way),
hits AS (SELECT doc_id, way, unnest(regexp_extract_all(ids, {quote(pattern)})) p FROM ids),
named AS (SELECT doc_id, string_agg(DISTINCT spdx, ',' ORDER BY spdx) licenses, count(*) FILTER (way = 0) n0, count(*) FILTER (way = 1) n1 FROM hits JOIN rules USING (p) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(n1, 0) > coalesce(n0, 0) OR i.ids IS NULL THEN coalesce(j.ids, '') ELSE i.ids END sentence_ids, coalesce(n.licenses, '') licenses, CAST(greatest(coalesce(n0, 0), coalesce(n1, 0)) AS BIGINT) n_rules
FROM documents d LEFT JOIN ids i ON d.doc_id = i.doc_id AND i.way = 0 LEFT JOIN ids j ON d.doc_id = j.doc_id AND j.way = 1 LEFT JOIN named n ON d.doc_id = n.doc_id
"""
