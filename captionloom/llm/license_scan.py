"""License scans: normalised sentences become identifiers, and identifier sequences are matched by ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What public licenses print at the head of a file or as their text, and which of its sentences, from one place
#: up to another, it takes to tell the license. The others are known, but not asked for.
PUBLISHED = [
    ("MIT", 0, 2, """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT-0", 0, 1, """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."""),
    ("BSD-4-Clause", 0, 5, """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning features or use of this software must
        display the following acknowledgement: 4. Neither the name of the University nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission."""),
    ("BSD-3-Clause", 0, 4, """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors
        may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("BSD-3-Clause", 0, 4, """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. The name of the author may not be used to endorse or promote products
        derived from this software without specific prior written permission."""),
    ("BSD-2-Clause", 0, 3, """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution."""),
    ("ISC", 0, 1, """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("ISC", 0, 1, """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies."""),
    ("0BSD", 0, 1, """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""),
    ("Apache-2.0", 0, 2, """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
        may obtain a copy of the License at

        http://www.apache.org/licenses/LICENSE-2.0

        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License."""),
    ("Apache-2.0", 0, 1, """Licensed under the Apache License, Version 2.0 (the "License")."""),
    ("Apache-2.0", 0, 1, """The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License."""),
    ("MPL-2.0", 0, 1, """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MPL-1.1", 0, 1, """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in
        compliance with the License."""),
    ("EPL-1.0", 0, 1, """This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this
        distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"""),
    ("EPL-2.0", 0, 1, """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0/"""),
    ("EPL-2.0", 0, 1, """This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at
        http://www.eclipse.org/legal/epl-2.0."""),
    ("CDDL-1.0", 0, 1, """The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this
        file except in compliance with the License."""),
    ("BSL-1.0", 0, 1, """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of
        the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("BSL-1.0", 0, 1, """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
        http://www.boost.org/LICENSE_1_0.txt)"""),
    ("Zlib", 0, 1, """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software."""),
    ("Unlicense", 0, 1, """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("CC0-1.0", 0, 1, """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the
        public domain worldwide. This software is distributed without any warranty."""),
    ("WTFPL", 0, 1, """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the
        name is changed."""),
    ("Artistic-2.0", 0, 1, """The Artistic License 2.0

        Copyright (c) 2000-2006, The Perl Foundation."""),
    ("PostgreSQL", 0, 1, """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written
        agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."""),
    ("NCSA", 0, 2, """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers."""),
    ("HPND", 0, 1, """Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted,
        provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting
        documentation."""),
    ("OFL-1.1", 0, 1, """This Font Software is licensed under the SIL Open Font License, Version 1.1."""),
    ("Beerware", 0, 1, """As long as you retain this notice you can do whatever you want with this software."""),
    ("GFDL-1.3-or-later", 0, 1, """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License,
        Version 1.3 or any later version published by the Free Software Foundation;"""),
    ("GFDL-1.2-or-later", 0, 1, """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License,
        Version 1.2 or any later version published by the Free Software Foundation;"""),
    *[
        (f"{short}-{version}{later}", 1, 3 if tail[0] == ";" else 2, f"""This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {long} as published by
        the Free Software Foundation{tail}. This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""")
        for short, long, things, versions in (
            ("GPL", "General Public License", ("program",), ("1.0", "2.0", "3.0")), ("LGPL", "Lesser General Public License", ("library", "program"), ("2.1", "3.0")),
            ("LGPL", "Library General Public License", ("library",), ("2.0",)), ("AGPL", "Affero General Public License", ("program",), ("3.0",)))
        for thing in things
        for version in versions
        for number in (version.removesuffix(".0"),)
        for later, tail in (
            ("-or-later", f"; either version {number} of the License, or (at your option) any later version"),
            ("-or-later", f", either version {number} of the License, or (at your option) any later version"),
            ("", f"; version {number} of the License"), ("", f", version {number} of the License"), ("", f", version {number}"))
    ],
]
#: Families of licenses, the names they go by, and their versions.
FAMILIES = [
    ("GPL", ("gnu general public license", "gnu gpl"), ("1.0", "2.0", "3.0")),
    ("LGPL", ("gnu lesser general public license", "gnu lgpl"), ("2.0", "2.1", "3.0")),
    ("AGPL", ("gnu affero general public license", "gnu agpl"), ("1.0", "3.0")),
    ("GFDL", ("gnu free documentation license",), ("1.1", "1.2", "1.3")),
    ("MPL", ("mozilla public license",), ("1.0", "1.1", "2.0")),
    ("EPL", ("eclipse public license",), ("1.0", "2.0")),
    ("EUPL", ("european union public licence", "european union public license"), ("1.0", "1.1", "1.2")),
    ("CDDL", ("common development and distribution license",), ("1.0", "1.1")),
    ("CPL", ("common public license",), ("1.0",)),
    ("APSL", ("apple public source license",), ("1.0", "1.1", "1.2", "2.0")),
    ("OSL", ("open software license",), ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("AFL", ("academic free license",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("Artistic", ("artistic license", "perl artistic license"), ("1.0", "2.0")),
    ("Apache", ("apache license", "apache software license"), ("1.0", "1.1", "2.0")),
    ("BSL", ("boost software license", "boost license"), ("1.0",)),
    ("OFL", ("sil open font license", "open font license"), ("1.0", "1.1")),
    ("ODbL", ("open data commons open database license", "open database license"), ("1.0",)),
    ("ODC-By", ("open data commons attribution license",), ("1.0",)),
    ("PDDL", ("open data commons public domain dedication and license",), ("1.0",)),
    ("LPPL", ("latex project public license",), ("1.0", "1.1", "1.2", "1.3c")),
    ("UPL", ("universal permissive license",), ("1.0",)),
    ("ZPL", ("zope public license",), ("1.1", "2.0", "2.1")),
    ("PHP", ("php license",), ("3.0", "3.01")),
    ("QPL", ("q public license",), ("1.0",)),
    ("SPL", ("sun public license",), ("1.0",)),
    ("NPL", ("netscape public license",), ("1.0", "1.1")),
    ("CECILL", ("cecill free software license agreement",), ("1.0", "2.0", "2.1")),
    ("EFL", ("eiffel forum license",), ("1.0", "2.0")),
    ("ECL", ("educational community license",), ("1.0", "2.0")),
    ("MulanPSL", ("mulan permissive software license",), ("1.0", "2.0")),
    ("IPL", ("ibm public license",), ("1.0",)),
    ("RPL", ("reciprocal public license",), ("1.1", "1.5")),
    ("CC0", ("creative commons zero", "cc zero"), ("1.0",)),
]
#: Licenses without versions.
PLAIN = {
    "MIT": ["mit", "mit license", "mit licence", "expat license"], "MIT-0": ["mit 0", "mit no attribution"], "X11": ["x11", "x11 license"],
    "ISC": ["isc", "isc license"], "0BSD": ["0bsd", "bsd zero clause license", "zero clause bsd license"],
    "BSD-2-Clause": ["bsd 2 clause", "bsd 2 clause license", "simplified bsd license", "2 clause bsd license", "freebsd license"],
    "BSD-3-Clause": ["bsd 3 clause", "bsd 3 clause license", "new bsd license", "modified bsd license", "revised bsd license", "3 clause bsd license"],
    "BSD-4-Clause": ["bsd 4 clause", "bsd 4 clause license", "original bsd license", "4 clause bsd license"],
    "Unlicense": ["unlicense", "the unlicense"], "Zlib": ["zlib", "zlib license", "zlib libpng license"], "Libpng": ["libpng", "libpng license"],
    "CC0-1.0": ["cc0", "creative commons zero v1 0 universal"], "WTFPL": ["wtfpl", "do what the fuck you want to public license"],
    "PostgreSQL": ["postgresql", "postgresql license"], "NCSA": ["ncsa", "university of illinois ncsa open source license"], "Ruby": ["ruby", "ruby license"],
    "Vim": ["vim", "vim license"], "NTP": ["ntp", "ntp license"], "HPND": ["hpnd", "historical permission notice and disclaimer"], "MS-PL": ["ms pl", "microsoft public license"],
    "MS-RL": ["ms rl", "microsoft reciprocal license"], "Beerware": ["beerware", "beer ware license", "beerware license"], "JSON": ["json", "json license"],
    "curl": ["curl", "curl license"], "OpenSSL": ["openssl", "openssl license"], "PSF-2.0": ["psf 2 0", "psf license", "python software foundation license"],
    "Python-2.0": ["python 2 0", "python license"], "W3C": ["w3c", "w3c software notice and license"], "TCL": ["tcl", "tcl tk license"], "ICU": ["icu", "icu license"],
    "FTL": ["ftl", "freetype project license", "freetype license"], "IJG": ["ijg", "independent jpeg group license"], "Sleepycat": ["sleepycat", "sleepycat license"],
    "Intel": ["intel", "intel open source license"], "Naumen": ["naumen", "naumen public license"], "Xnet": ["xnet", "x net license"],
}
#: Parts of Creative Commons licenses, and what follows the number of their versions.
CC_PARTS = {"BY": "attribution", "NC": "noncommercial", "ND": "noderivatives", "SA": "sharealike"}
CC_KINDS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
CC_VERSIONS = {"1.0": "generic", "2.0": "generic", "2.5": "generic", "3.0": "unported", "4.0": "international"}


def _forms(short: str, names: tuple[str, ...], version: str) -> list[str]:
    """The ways to name a version of a license, normalised."""
    plain, low = version.replace(".", " "), short.lower().replace("-", " ")
    numbers = [plain, *([plain.removesuffix(" 0")] if plain.endswith(" 0") else [])]
    out = [f"{low} {plain}", f"{low} {plain} license"]
    for n in numbers:
        out += [f"{low} v{n}", f"{low}v{n}", f"{low} {n}", f"{low}{n}", f"{low} version {n}"]
        for name in names:
            out += [f"{name} version {n}", f"{name} v{n}", f"{name} {n}", f"{name} v {n}"]
            if name.endswith(" license"):
                out.append(f"{name.removesuffix(' license')} {n} license")
    return list(dict.fromkeys(out))


def _names() -> dict[str, list[str]]:
    out = {k: list(v) for k, v in PLAIN.items()}
    for short, names, versions in FAMILIES:
        for version in versions:
            forms = _forms(short, names, version)
            if short in ("GPL", "LGPL", "AGPL", "GFDL"):
                forms += [f"{short.lower()} {version.replace('.', ' ')} only"]
            out.setdefault(f"{short}-{version}", []).extend(forms)
    for kind in CC_KINDS:
        long = "creative commons " + " ".join(CC_PARTS[p] for p in kind.split("-"))
        for version, kind_of in CC_VERSIONS.items():
            n = version.replace(".", " ")
            out[f"CC-{kind}-{version}"] = [f"cc {kind.lower().replace('-', ' ')} {n}", f"cc {kind.lower().replace('-', ' ')} {n} license",
                                           f"{long} {n}", f"{long} {n} license", f"{long} {n} {kind_of}", f"{long} {n} {kind_of} license"]
    return out


#: Names by which a one-line statement may call a license, from the tables above.
NAMES = _names()
#: The same for "or later" licenses.
OR_LATER = {
    f"{short.upper()}-{version}-or-later": [f"{x} or {later}" for x in _forms(short, names, version) for later in ("later", "any later version")]
    for short, names, versions in FAMILIES if short in ("GPL", "LGPL", "AGPL") for version in versions
}
#: Every known sentence holds one of these, and so does every statement that starts with an SPDX tag.
TRIGGER = "(?i)licen[sc]e|software|copyright|spdx-|redistribut|unencumbered"
#: Every other statement holds this: the verbs of ``STATEMENT``, and between the words what normalises to a blank.
UNDER = "(?i)(released|licensed|distributed|available|published|provided)[^a-z0-9]+under"
#: A line with a copyright and a year is a sentence of its own.
NOTICE = "(?im)^(.*copyright.*[0-9]{4}.*)$"
STATEMENT = (
    "^(this (work|software|project|program|file|document|code|text|library) is )?(dual |also )?(released|licensed|distributed|available|published|"
    "made available|provided) under (the terms of )?(the |a |an )?|^spdx license identifier "
)
TAG = "(?i)(SPDX-License-Identifier):"
SENTENCE_END = "[.!?;:]+(\\s+|$)|\\n\\s*\\n"
LINE_END = "[.!?;:]+(\\s+|$)|\\n"
#: Whoever holds the rights, by any name: "neither the name of the University nor the names of its contributors may ...".
HOLDER = "^neither the names? of .* may be used to endorse or promote products"
HELD = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"


def normal(sentence: str) -> str:
    """What ``_key`` makes of a sentence, in plain Python."""
    return re.sub(HOLDER, HELD, re.sub("[^a-z0-9]+", " ", sentence.lower()).strip())


def split_published(text: str) -> list[str]:
    """The normalised sentences of a published text, cut as any text is; those of fewer than four words tell nothing and go."""
    return [s for s in map(normal, re.split(SENTENCE_END.replace("(", "(?:"), text)) if s.count(" ") >= 3]


def _tables() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """``sentence -> identifier``, and the rules: sequences of identifiers, longer ones first."""
    ids: dict[str, str] = {}
    count: dict[str, int] = {}
    rules: dict[tuple[str, ...], str] = {}
    for name, first, stop, text in PUBLISHED:
        sentences = split_published(text)
        for k, s in enumerate(sentences):
            # what a document is not looked into for is asked for only where a rule needs it, and then has a trigger
            if s not in ids and (first <= k < stop or re.search(TRIGGER, s)):
                count[name] = count.get(name, 0) + 1
                ids[s] = f"{name}.{count[name]}"
        rules.setdefault(tuple(ids[s] for s in sentences[first:stop]), name)
    order = sorted(rules.items(), key=lambda r: -len(r[0]))
    return ids, [(name, list(seq)) for seq, name in order]


#: Normalised sentences and their identifiers; and the rules in order. A rule takes its identifiers out of the sequence, so that
#: later ones don't see them.
SENTENCES, RULES = _tables()


def known(names: dict[str, list[str]] = NAMES | OR_LATER) -> dict[str, str]:
    """Normalised sentence, statement prefix cut to ``@``, to identifier."""
    return dict(SENTENCES) | {f"@{n}": f"says.{name}" for name, each in names.items() for n in each}


def _key(sentence: Column) -> tuple[Column, Column]:
    plain = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, HOLDER, HELD), F.regexp_replace(plain, STATEMENT, "@")


def identifiers(text: Column, ends: str) -> Column:
    """Identifiers of the known sentences of a text, in order; unknown sentences leave no trace."""
    sentences = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    statements = F.create_map(*[F.lit(x) for k, v in known().items() if k[0] == "@" for x in (k, v)])
    longest = max(len(k) for k in known() if k[0] == "@")

    def look(s: Column) -> Column:
        plain, statement = _key(s)
        # each table is asked only for what may stand in it
        told = F.when(F.char_length(s) >= min(map(len, SENTENCES)), F.try_element_at(sentences, plain))
        return F.coalesce(told, F.when(statement.startswith("@") & (F.char_length(statement) <= longest), F.try_element_at(statements, statement)))

    return F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(text, TAG, "$1 "), NOTICE, "$1."), ends), look), lambda x: x.isNotNull())


def _pattern(seq: list[str]) -> str:
    return "(<" + "><".join(x.replace(".", "[.]") for x in seq) + ">)"


def matched(ids: Column) -> Column:
    """Licenses of an identifier sequence, each once: by the rules in order, then those that statements name."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_pattern(seq)).alias("pattern")) for name, seq in RULES])
    start = F.struct(F.concat(F.lit("<"), F.array_join(ids, "><"), F.lit(">")).alias("seq"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        found = F.when(F.rlike(acc["seq"], rule["pattern"]), F.array_union(acc["found"], F.array(rule["name"]))).otherwise(acc["found"])
        return F.struct(F.regexp_replace(acc["seq"], rule["pattern"], F.lit("<>")).alias("seq"), found.alias("found"))

    said = F.transform(F.filter(ids, lambda x: x.startswith("says.")), lambda x: F.substr(x, F.lit(6)))
    return F.array_union(F.aggregate(rules, start, step, lambda acc: acc["found"]), said)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id_col, licenses, sentences)``, arrays of license names and sentence identifiers.

    Whole texts are read twice over: as sentences that may run over line ends (license texts), and as sentences
    that end with the line (statements after lines without a stop). Rules match each reading's sequence; the
    licenses of both are joined, in the order of the first, and likewise the identifiers. Null and empty texts, and texts that
    hold no word that all known sentences and statements have, give empty arrays. Rows are independent: no shuffle, repeated rows come out as they
    come, and other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.when(F.rlike(text_col, F.lit(f"{TRIGGER}|{UNDER}")), F.col(text_col)).alias("text"))
    rows = rows.select("id", identifiers(F.col("text"), SENTENCE_END).alias("a"), identifiers(F.col("text"), LINE_END).alias("b"))
    none = F.array().cast("array<string>")
    rows = rows.select("id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    both = lambda f: F.when((F.size("a") > 0) | (F.size("b") > 0), f).otherwise(none)
    return rows.select(
        F.col("id").alias(id_col), both(F.array_union(matched(F.col("a")), matched(F.col("b")))).alias("licenses"),
        both(F.array_union("a", "b")).alias("sentences"),
    )


def _sql() -> str:
    """The same in SQL: the tables of sentences and statements as one, and the rules as one step after another."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known().items())
    steps, last = [], "seqs"
    for i, (name, seq) in enumerate(RULES):
        pattern = quote(_pattern(seq))
        steps.append(
            f"r{i} AS (SELECT doc_id, kind, regexp_replace(seq, {pattern}, '<>', 'g') AS seq, "
            f"CASE WHEN regexp_matches(seq, {pattern}) AND NOT list_contains(found, {quote(name)}) THEN list_append(found, {quote(name)}) ELSE found END AS found FROM {last})"
        )
        last = f"r{i}"
    units = "\nUNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, unnest(string_split_regex(text, {quote(ends)})) AS s, generate_subscripts(string_split_regex(text, {quote(ends)}), 1) AS i FROM t"
        for kind, ends in (("a", SENTENCE_END.replace("(", "(?:")), ("b", LINE_END.replace("(", "(?:")))
    )
    return f"""
WITH known(k, v) AS (VALUES {pairs}),
t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{TAG}', '\\1 ', 'g'), '{NOTICE}', '\\1.', 'g') AS text FROM documents
  WHERE regexp_matches(text, '{TRIGGER}') OR regexp_matches(text, '{UNDER}')),
u AS ({units}),
n AS (SELECT doc_id, kind, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS plain FROM u),
k AS (
  SELECT n.doc_id, n.kind, n.i, coalesce(p.v, q.v) AS v, row_number() OVER (PARTITION BY doc_id, kind, coalesce(p.v, q.v) ORDER BY i) AS nth
  FROM n LEFT JOIN known p ON p.k = regexp_replace(plain, '{HOLDER}', '{HELD}') LEFT JOIN known q ON q.k = regexp_replace(plain, '{STATEMENT}', '@')
  WHERE coalesce(p.v, q.v) IS NOT NULL
),
m AS (SELECT doc_id, kind, list(v ORDER BY i) AS ids, list(v ORDER BY i) FILTER (WHERE nth = 1) AS once FROM k GROUP BY ALL),
seqs AS (SELECT doc_id, kind, '<' || array_to_string(ids, '><') || '>' AS seq, CAST([] AS VARCHAR[]) AS found FROM m),
{", ".join(steps)},
w AS (SELECT m.doc_id, m.kind, m.once, r.found, list_transform(list_filter(m.once, lambda x: starts_with(x, 'says.')), lambda x: substr(x, 6)) AS said
  FROM m JOIN {last} r ON m.doc_id = r.doc_id AND m.kind = r.kind),
e AS (SELECT doc_id, kind, once, list_concat(found, list_filter(said, lambda x: NOT list_contains(found, x))) AS found FROM w),
j AS (
  SELECT d.doc_id, coalesce(a.found, []) AS fa, coalesce(b.found, []) AS fb, coalesce(a.once, []) AS oa, coalesce(b.once, []) AS ob
  FROM documents d LEFT JOIN e a ON a.doc_id = d.doc_id AND a.kind = 'a' LEFT JOIN e b ON b.doc_id = d.doc_id AND b.kind = 'b'
)
SELECT doc_id, array_to_string(list_concat(fa, list_filter(fb, lambda x: NOT list_contains(fa, x))), ',') AS licenses,
  array_to_string(list_concat(oa, list_filter(ob, lambda x: NOT list_contains(oa, x))), ',') AS sentences
FROM j
"""


SQL = _sql()
