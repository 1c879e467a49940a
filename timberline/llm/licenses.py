"""Licence recognition by sentence rules.

A text is cut into sentences, each is normalised and mapped to the identifier
of a known licence sentence, and the sequence of identifiers is matched against
ordered rules; a rule uses up the identifiers it matches, so a longer rule that
stands first keeps a shorter one from firing on the same sentences.  Parts of
sentences that vary, as owners' names and ways to say "licensed under", are
replaced by one wording first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Version clauses of the GPL notice, with the licences they name.
GPL_VERSIONS = {
    "3-LATER": ("GPL-3.0-or-later", "either version 3 of the License, or (at your option) any later version."),
    "2-LATER": ("GPL-2.0-or-later", "either version 2 of the License, or (at your option) any later version."),
    "3-ONLY": ("GPL-3.0", "version 3 of the License."),
    "2-ONLY": ("GPL-2.0", "version 2 of the License."),
}


def _gpl_clauses() -> dict[str, list[str]]:
    """The GPL notice by its clauses, which semicolons part, and in the spellings that join some of them."""
    free = "This program is free software"
    redistribute = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    clauses = {"GPL-FREE": [free], "GPL-REDISTRIBUTE": [redistribute, f"{free}: {redistribute}"]}
    for version, (_, text) in GPL_VERSIONS.items():
        clauses[f"GPL-VERSION-{version}"] = [text]
        clauses[f"GPL-GRANT-{version}"] = [f"{free}: {redistribute}, {text}", f"{redistribute}, {text}"]
    return clauses


def _gpl_rules() -> list[tuple[str, list[str]]]:
    """Every rule asks for a version clause; the longest come first."""
    rest = ["GPL-NO-WARRANTY", "GPL-NO-IMPLIED", "GPL-SEE", "GPL-COPY"]
    rules = []
    for version, (name, _) in GPL_VERSIONS.items():
        split, joined = ["GPL-FREE", "GPL-REDISTRIBUTE", f"GPL-VERSION-{version}"], ["GPL-FREE", f"GPL-GRANT-{version}"]
        for head in (split, split[1:], joined, joined[1:]):
            rules += [(name, head + rest), (name, head)]
    return rules


#: Sentences of public licence texts and notices, with the identifiers that rules use.
SENTENCES = {
    "MIT-GRANT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "MIT-0-GRANT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'],
    "MIT-NOTICE": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."],
    "AS-IS-MIT": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "NO-LIABILITY-MIT": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "X11-NAME": ["Except as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization."],
    "APACHE-2-GRANT": ['Licensed under the Apache License, Version 2.0 (the "License");', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "APACHE-2-USE": ["You may not use this file except in compliance with the License."],
    "APACHE-2-COPY": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "APACHE-2-AS-IS": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "APACHE-2-SEE": ["See the License for the specific language governing permissions and limitations under the License."],
    **_gpl_clauses(),
    "GPL-NO-WARRANTY": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "GPL-NO-IMPLIED": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "GPL-SEE": ["See the GNU General Public License for more details."],
    "GPL-COPY": ["You should have received a copy of the GNU General Public License along with this program."],
    "BSD-GRANT": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-SOURCE": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BSD-BINARY": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-ADVERTISING": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "BSD-NO-ENDORSEMENT": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without prior written permission.",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
        "The names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-AS-IS": [
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        'THIS SOFTWARE IS PROVIDED BY THE AUTHOR "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE, ARE DISCLAIMED.',
    ],
    "BSD-LIABLE-1": ["IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;"],
    "BSD-LIABLE-2": ["LOSS OF USE, DATA, OR PROFITS;"],
    "BSD-LIABLE-3": ["OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "ISC-GRANT": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0BSD-GRANT": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "ISC-AS-IS": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "ISC-NO-LIABILITY": ["IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "ZLIB-AS-IS": ["This software is provided 'as-is', without any express or implied warranty."],
    "ZLIB-NO-LIABILITY": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "ZLIB-GRANT": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BOOST-GRANT": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "UNLICENSE-GRANT": ["This is free and unencumbered software released into the public domain."],
    "UNLICENSE-ANYONE": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "MPL-2-NOTICE": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "MPL-1.1-NOTICE": ['The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");'],
    "CDDL-NOTICE": ['The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").'],
    "EPL-2-NOTICE": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at"],
    "EPL-1-NOTICE": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"],
    "WTFPL-NAME": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "RESERVED": ["All rights reserved.", "All Rights Reserved"],
}

#: Names that notices give to licences, by the identifier that is reported.
NAMES = {
    "MIT": ["MIT License", "The MIT License", "MIT", "Expat License", "X11 License"],
    "MIT-0": ["MIT No Attribution License", "MIT-0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache Software License 2.0", "Apache-2.0 License", "Apache 2.0 License", "Apache 2.0", "Apache-2.0", "ASL 2.0"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License", "BSD-2-Clause", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause License", "BSD-3-Clause"],
    "BSD-4-Clause": ["BSD 4-Clause License", "Original BSD License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License"],
    "ISC": ["ISC License", "ISC"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License - Version 1.0", "Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Unlicense": ["The Unlicense", "Unlicense License"],
    "WTFPL": ["WTFPL License", "WTFPL"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License - v 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License - v 2.0"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "CDDL 1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "The Artistic License 2.0"],
    "PSF-2.0": ["Python Software Foundation License", "Python Software Foundation License Version 2", "PSF License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License version 2.0", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL v2", "GPL version 2", "GPL-2.0", "GPL-2.0-only"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GNU General Public License v2.0 or later", "GPLv2 or later", "GPL version 2 or later", "GPL-2.0-or-later"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License version 3.0", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL v3", "GPL version 3", "GPL-3.0", "GPL-3.0-only"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GNU General Public License v3.0 or later", "GPLv3 or later", "GPL version 3 or later", "GPL-3.0-or-later"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL v2.1", "LGPL-2.1", "LGPL-2.1-only"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License, version 2.1 or later", "LGPL-2.1-or-later"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL v3", "LGPL-3.0", "LGPL-3.0-only"],
    "LGPL-3.0-or-later": ["GNU Lesser General Public License, version 3 or later", "LGPL-3.0-or-later"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL v3", "AGPL-3.0", "AGPL-3.0-only"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License, version 3 or later", "AGPL-3.0-or-later"],
    "CC0-1.0": ["CC0 1.0 Universal License", "CC0 1.0 Universal", "CC0 1.0", "CC0", "Creative Commons Zero v1.0 Universal License"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution 3.0 License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "Creative Commons Attribution-ShareAlike 3.0 License"],
    **{
        f"CC-BY-{code}4.0": [f"CC BY{'-' + code[:-1] if code else ''} 4.0", f"CC-BY-{code}4.0", f"a Creative Commons Attribution{words} 4.0 International License", f"Creative Commons Attribution{words} 4.0 International License", f"Creative Commons Attribution{words} 4.0 International"]
        for code, words in {"": "", "SA-": "-ShareAlike", "NC-": "-NonCommercial", "ND-": "-NoDerivatives", "NC-SA-": "-NonCommercial-ShareAlike", "NC-ND-": "-NonCommercial-NoDerivatives"}.items()
    },
}


def _name_sentences() -> dict[str, list[str]]:
    """``NAME-...`` identifiers: a name alone where it calls itself a licence, licensed under it, and its SPDX line."""
    return {
        f"NAME-{licence}": [f"SPDX-License-Identifier: {licence}", *[f"SPDX-License-Identifier: {n}" for n in names if " " not in n], *[f"Licensed under {n}." for n in names], *[n for n in names if "license" in n.lower()]]
        for licence, names in NAMES.items()
    }


#: Parts of sentences that vary, as patterns over normal forms, and what stands in their place.
VARIABLE = [
    (r"\blicence", "license"),
    (r"\bneither the names? of ([a-z0-9]+ ){1,20}?nor the names of (its|their|any|other) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"\bthis software is provided by ([a-z0-9]+ ){1,20}?as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    (r"\bin no event shall ([a-z0-9]+ ){1,20}?be liable for any direct", "in no event shall the copyright holder or contributors be liable for any direct"),
    (r"\bin no event shall ([a-z0-9]+ ){1,20}?be liable for any claim", "in no event shall the authors or copyright holders be liable for any claim"),
    (r"^((this|the) )?([a-z0-9]+ ){0,3}(is|are) ((dual|free software) )?(licensed|released|distributed|made available|available|provided|published) under ", "licensed under "),
    (r"^(released|distributed|made available|available|provided|published|licensed) under (the )?(terms and conditions of |terms of )?(the |an |a )?", "licensed under "),
    (r"^licensed under (.*) (see|for details see|you can find) (the |a copy )?.*$", "licensed under $1"),
    (r"^([a-z0-9]{1,2} )+(redistributions|neither the|all advertising|the names? of)", "$2"),
]

_FIRST_RULES = [
    ("MIT", ["NAME-MIT", "MIT-GRANT", "MIT-NOTICE", "AS-IS-MIT", "NO-LIABILITY-MIT"]),
    ("X11", ["MIT-GRANT", "MIT-NOTICE", "AS-IS-MIT", "NO-LIABILITY-MIT", "X11-NAME"]),
    ("MIT", ["MIT-GRANT", "MIT-NOTICE", "AS-IS-MIT", "NO-LIABILITY-MIT"]),
    ("MIT", ["MIT-GRANT", "MIT-NOTICE"]),
    ("MIT-style", ["MIT-GRANT"]),
    ("MIT-0", ["MIT-0-GRANT", "AS-IS-MIT", "NO-LIABILITY-MIT"]),
    ("MIT-0", ["MIT-0-GRANT"]),
    ("Apache-2.0", ["NAME-Apache-2.0", "APACHE-2-GRANT", "APACHE-2-USE", "APACHE-2-COPY", "APACHE-2-AS-IS", "APACHE-2-SEE"]),
    ("Apache-2.0", ["APACHE-2-GRANT", "APACHE-2-USE", "APACHE-2-COPY", "APACHE-2-AS-IS", "APACHE-2-SEE"]),
    ("Apache-2.0", ["APACHE-2-GRANT", "APACHE-2-USE"]),
    ("Apache-2.0", ["APACHE-2-GRANT"]),
]


def _bsd_rules() -> list[tuple[str, list[str]]]:
    """The longest text first: with its own name, its disclaimer or both before without."""
    disclaimer = ["BSD-AS-IS", "BSD-LIABLE-1", "BSD-LIABLE-2", "BSD-LIABLE-3"]
    clauses = ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"]
    bodies = {"BSD-4-Clause": [*clauses, "BSD-ADVERTISING", "BSD-NO-ENDORSEMENT"], "BSD-3-Clause": [*clauses, "BSD-NO-ENDORSEMENT"], "BSD-2-Clause": clauses}
    return [(name, head + body + tail) for name, body in bodies.items() for head in ([f"NAME-{name}"], []) for tail in (disclaimer, [])]


#: (licence, identifiers that must follow each other), tried in this order.
RULES = [
    *_FIRST_RULES,
    *_gpl_rules(),
    *_bsd_rules(),
    ("ISC", ["NAME-ISC", "ISC-GRANT", "ISC-AS-IS", "ISC-NO-LIABILITY"]),
    ("ISC", ["ISC-GRANT", "ISC-AS-IS", "ISC-NO-LIABILITY"]),
    ("ISC", ["ISC-GRANT"]),
    ("0BSD", ["0BSD-GRANT", "ISC-AS-IS", "ISC-NO-LIABILITY"]),
    ("0BSD", ["0BSD-GRANT"]),
    ("Zlib", ["ZLIB-AS-IS", "ZLIB-NO-LIABILITY", "ZLIB-GRANT"]),
    ("BSL-1.0", ["BOOST-GRANT"]),
    ("Unlicense", ["UNLICENSE-GRANT", "UNLICENSE-ANYONE"]),
    ("Unlicense", ["UNLICENSE-GRANT"]),
    ("MPL-2.0", ["MPL-2-NOTICE"]),
    ("MPL-1.1", ["MPL-1.1-NOTICE"]),
    ("CDDL-1.0", ["CDDL-NOTICE"]),
    ("EPL-2.0", ["EPL-2-NOTICE"]),
    ("EPL-1.0", ["EPL-1-NOTICE"]),
    ("WTFPL", ["WTFPL-NAME"]),
    *[(licence, [f"NAME-{licence}"]) for licence in NAMES],
]

#: Every known sentence holds one of these, so a text without any has no known sentence.
ANCHORS = ["licens", "licenc", "permi", "copyright", "warrant", "liab", "redistribut", "rights reserved", "software", "under", "unlicense", "advertising", "endorse", "loss of use"]

#: Abbreviations in owners' names, whose full stop ends no sentence when the sentence goes on.
ABBREVIATED = [
    (r"\b([Ii]nc|[Ll]td|[Cc]orp|[Cc]o|[Dd]ept|[Uu]niv|[Nn]o|Jr|Sr|INC|LTD|CORP)\.([ \t\r\n]+[a-z0-9])", "$1$2"),
    (r"\b(INC|LTD|CORP|CO|DEPT|UNIV)\.([ \t\r\n]+(AND|OR|BE|AS|\"))", "$1$2"),
]

#: A sentence ends at its punctuation, at a colon that ends a line, and at an empty line.
SENTENCE_END = r"[.!?;]+[ \t\r\n]+|:[ \t\r]*\n|\n[ \t\r]*\n"


def plain(text: str) -> str:
    """The normal form of a sentence, for the fixed tables."""
    text = re.sub("[^a-z0-9]+", " ", text.lower()).strip(" ")
    for pattern, by in VARIABLE:
        text = re.sub(pattern, by.replace("$", "\\"), text)
    return text


def known_sentences() -> dict[str, str]:
    """Normal form -> identifier; sentences that the splitter cuts are listed by their parts."""
    known: dict[str, str] = {}
    for identifier, texts in {**SENTENCES, **_name_sentences()}.items():
        for text in texts:
            parts = [p for p in (plain(s) for s in re.split(SENTENCE_END, text + "\n\n")) if p]
            if len(parts) == 1:
                known.setdefault(parts[0], identifier)
            else:  # the first part names the sentence; later parts mean what they mean alone
                known.setdefault(parts[0], identifier)
                for rest in parts[1:]:
                    known.setdefault(rest, f"{identifier}+")
    missing = [s for s in known if not any(a in s for a in ANCHORS) and not known[s].endswith("+")]
    if missing:
        raise ValueError(f"no anchor in {missing}")
    return known


def _normal(text: Column) -> Column:
    out = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    for pattern, by in VARIABLE:
        out = F.regexp_replace(out, pattern, by)
    return out


def sentence_identifiers(text: Column) -> Column:
    """``array<string>``: identifiers of the known sentences of a text, in order.

    Sentences may run over lines; if a whole sentence is not known, its lines
    are looked up one by one, for notices that follow text without a full stop.
    """
    known = known_sentences()
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    is_known = lambda s: s.isin(list(known))

    def of_block(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), _normal), is_known)
        whole = F.filter(F.array(_normal(block)), is_known)
        return F.when(F.size(whole) > 0, whole).otherwise(lines)

    whole = text
    for pattern, by in ABBREVIATED:
        whole = F.regexp_replace(whole, pattern, by)
    found = F.flatten(F.transform(F.split(whole, SENTENCE_END), of_block))
    identifiers = F.transform(found, lambda s: F.element_at(names, s))
    anchored = F.lower(text).rlike("|".join(ANCHORS))
    return F.when(anchored, identifiers).otherwise(F.array().cast("array<string>"))


def match_rules(identifiers: Column) -> Column:
    """``struct<licenses array<string>, rest string>`` of an identifier sequence; rules are tried only where there is one."""
    mark = lambda names: "".join(f"<{n}>" for n in names)
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(mark(ids)).alias("ids")) for name, ids in RULES])
    text = F.array_join(F.transform(identifiers, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    start = F.struct(F.array().cast("array<string>").alias("licenses"), text.alias("rest"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["ids"])
        return F.struct(
            F.when(hit, F.array_union(acc["licenses"], F.array(rule["name"]))).otherwise(acc["licenses"]).alias("licenses"),
            F.when(hit, F.replace(acc["rest"], rule["ids"], F.lit("#"))).otherwise(acc["rest"]).alias("rest"),
        )

    return F.aggregate(F.when(F.size(identifiers) > 0, rules).otherwise(F.slice(rules, 1, 0)), start, step)


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``sentence_ids array<string>``, ``licenses array<string>`` and ``n_unmatched int``.

    Every row of ``df`` is kept, in one pass without a shuffle.  A null or empty
    text has no sentences and no licences; columns of ``df`` with the added
    names are replaced.  ``n_unmatched`` counts known sentences that no rule used.
    """
    added = ("sentence_ids", "licenses", "n_unmatched")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in added]
    source = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = df.select(*kept, sentence_identifiers(source).alias("sentence_ids"))
    matched = found.withColumn("__matched", match_rules(F.col("sentence_ids")))
    return matched.select(
        *[F.col(f"`{c}`") for c in found.columns],
        F.col("__matched.licenses").alias("licenses"),
        F.regexp_count(F.col("__matched.rest"), F.lit("<")).cast("int").alias("n_unmatched"),
    )
