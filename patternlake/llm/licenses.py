"""Licence scans by sentence-rule recognition.

A text becomes a sequence of licence-sentence identifiers, which ordered rules then match:

1. Pieces.  Lines of a paragraph are joined, as notices are usually wrapped and often behind
   comment marks.  Pieces end after ``.``, ``!``, ``?`` or ``;`` before white space, at lines
   without letters or digits, at list marks, and before a line that opens like a known sentence.
2. Identifiers.  Pieces are normalised to lower-case ASCII words and looked up whole among the
   known sentences; a piece of several lines that is unknown as a whole is looked up line by
   line.  A run of unknown ones becomes one gap, ``-``.
3. Rules.  A rule is a licence and a sequence of identifiers, between which one gap may stand.
   Rules are tried from the longest on, and what a rule has matched is spent.

``TEXTS`` holds the licences' own wording; sentences, identifiers and rules follow from it by
the same cut that texts get.  A rule is a text's first sentences, from those that suffice to
tell the licence up to all of them.

Everything is a projection over the scan in built-in expressions; nothing is shuffled.

Defined results: null and empty texts have no sentences; repeated rows are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.llm.common import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Text(NamedTuple):
    license: str
    least: int  # so many of its first sentences tell the licence
    prefix: str  # of the identifiers
    wording: str


_GNU = "This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{stop} {version}.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
_SOLD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."


def _gnu() -> list[Text]:
    """Notices of the GNU family, with the marks of either official form."""
    kinds = {"GPL": ("", ("2", "3")), "LGPL": ("Lesser ", ("2.1", "3")), "AGPL": ("Affero ", ("3",))}
    found = []
    for name, (kind, versions) in kinds.items():
        for v in versions:
            full = v if "." in v else f"{v}.0"
            for mark, stop in ((":", ","), (";", ";"), (";", ",")):
                for end, choice in (("or-later", f"either version {v} of the License, or (at your option) any later version"), ("only", f"version {v} of the License")):
                    least = {(":", ","): 1, (";", ";"): 3, (";", ","): 2}[mark, stop]
                    found.append(Text(f"{name}-{full}-{end}", least, "gnu", _GNU.format(kind=kind, mark=mark, stop=stop, version=choice)))
    return found


#: Licences in their own wording (fixed values).
TEXTS = (
    Text("Apache-2.0", 1, "apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    Text("Apache-2.0", 1, "apache", "Licensed under the Apache License, Version 2.0."),
    Text("MIT", 1, "mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    Text("MIT", 1, "mit", "Released under the MIT License."),
    Text("MIT", 1, "mit", "Licensed under the MIT License."),
    Text("MIT", 1, "mit", "This software is released under the MIT License."),
    Text("MIT", 1, "mit", "This project is licensed under the MIT License."),
    Text("BSD-3-Clause", 4, "bsd", _BSD + "\n\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _SOLD_AS_IS),
    Text("BSD-2-Clause", 3, "bsd", _BSD + "\n\n" + _SOLD_AS_IS),
    Text("BSD", 1, "bsd", _BSD),
    Text("ISC", 1, "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    *_gnu(),
    Text("GPL-3.0-only", 1, "gnu", "This work is licensed under the GNU General Public License, version 3."),
    Text("GPL-2.0-only", 1, "gnu", "This work is licensed under the GNU General Public License, version 2."),
    Text("MPL-2.0", 1, "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Text("MPL-2.0", 1, "mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Text("Unlicense", 1, "unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Text("Zlib", 2, "zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    Text("BSL-1.0", 1, "bsl", "Distributed under the Boost Software License, Version 1.0."),
    Text("CC-BY-4.0", 1, "cc", "Licensed under CC BY 4.0."),
    Text("CC-BY-SA-4.0", 1, "cc", "Licensed under CC BY-SA 4.0."),
    Text("CC-BY-NC-4.0", 1, "cc", "Licensed under CC BY-NC 4.0."),
    Text("CC-BY-4.0", 1, "cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Text("CC-BY-SA-4.0", 1, "cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Text("CC-BY-NC-4.0", 1, "cc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    Text("CC0-1.0", 1, "cc", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Text("Apache-2.0", 1, "apache", "Apache License Version 2.0, January 2004"),
    Text("MIT", 1, "mit", "MIT License"),
    Text("MIT", 1, "mit", "The MIT License (MIT)"),
    Text("GPL-3.0", 1, "gnu", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    Text("GPL-2.0", 1, "gnu", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    Text("LGPL-3.0", 1, "gnu", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    Text("LGPL-2.1", 1, "gnu", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    Text("AGPL-3.0", 1, "gnu", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    Text("all-rights-reserved", 1, "reserved", "All rights reserved."),
)

#: Steps of the cut: pattern and replacement, for Java, RE2 (``$1`` as ``\1``) and Python alike.
_NAMED = r"([|\n] ?)[a-z0-9][a-z0-9 ]{0,60} is (free software|distributed in the hope)"


def _steps(openings: list[str]) -> list[tuple[str, str]]:
    steps = [
        (r"(?:\n|[:;.][\x20\x09-\x0D])[^a-z0-9|]*[0-9a-z][.)][\x20\x09-\x0D][^a-z0-9|]*([a-z])", "|$1"),  # list marks
        (r"[.!?;][\x20\x09-\x0D]+", "|"),
        (r"[^a-z0-9|\n]+", " "),
        (r"\n ?\n", "|"),
    ]
    if openings:
        steps += [(_NAMED, "$1this program is $2"), (rf"\n( ?(?:{'|'.join(openings)}))", "|$1")]
    return steps


def _plain_pieces(text: str, openings: list[str]) -> list[str]:
    """The pieces of one of ``TEXTS``, on the driver."""
    text = f"|{text.lower()}|"
    for pattern, new in _steps(openings):
        text = re.sub(pattern, new.replace("$1", r"\1").replace("$2", r"\2"), text)
    return [p for piece in text.split("|") if (p := " ".join(piece.split()))]


def _known() -> tuple[dict[str, str], tuple[tuple[str, tuple[str, ...]], ...]]:
    ids: dict[str, str] = {}
    rules: dict[tuple[str, ...], str] = {}
    numbers: dict[str, int] = {}
    for license_, least, prefix, wording in TEXTS:
        # Addresses and bare version numbers are no sentences: where they stand, rules allow a gap.
        pieces = [p for p in _plain_pieces(wording, []) if not p.startswith("http") and any(w.isalpha() for w in p.split())]
        for p in pieces:
            if p not in ids:
                numbers[prefix] = numbers.get(prefix, 0) + 1
                ids[p] = f"{prefix}{numbers[prefix]}"
        for n in range(least, len(pieces) + 1):
            rules.setdefault(tuple(ids[p] for p in pieces[:n]), license_)
    return ids, tuple((license_, sequence) for sequence, license_ in sorted(rules.items(), key=lambda x: -len(x[0])))


#: Normalised sentences and their identifiers; the ordered rules.
SENTENCES, RULES = _known()


def _opening(sentence: str) -> str:
    """The first words of a sentence, three at least, that stand inside no known sentence, which may be wrapped there."""
    words = sentence.split()
    found = (" ".join(words[:n]) for n in range(min(3, len(words)), len(words) + 1))
    return next((o for o in found if not any(f" {o} " in f"{s} " for s in SENTENCES)), "")


OPENINGS = sorted({o for o in map(_opening, SENTENCES) if o})


def _rule_pattern(sequence: tuple[str, ...]) -> str:
    return "," + ",(?:-,)?".join(sequence) + ","


def pieces(text: Column) -> Column:
    """Normalised pieces of a text, blank ones left out; line feeds part the lines of a piece."""
    plain = F.concat(F.lit("|"), F.translate(F.translate(F.coalesce(text, F.lit("")), "|", " "), _UPPER, _LOWER), F.lit("|"))
    for pattern, new in _steps(OPENINGS):
        plain = F.regexp_replace(plain, pattern, new)
    return F.filter(F.transform(F.split(plain, r" ?\n? ?\| ?\n? ?"), lambda p: F.btrim(p, F.lit(" \n"))), lambda p: p != "")


def identifiers(found: Column) -> Column:
    """The sequence of sentence identifiers, each closed with a comma; one ``-`` for a run of others."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    longest = max(map(len, SENTENCES)) + 40

    def of(sentence: Column) -> Column:
        return F.coalesce(F.try_element_at(known, sentence), F.lit("-"))

    def one(piece: Column) -> Column:
        whole = F.when(F.length(piece) <= longest, of(F.regexp_replace(piece, r" ?\n ?", " "))).otherwise("-")
        lines = F.array_join(F.transform(F.split(piece, r" ?\n ?"), of), ",")
        return F.when((whole == "-") & F.contains(piece, F.lit("\n")), lines).otherwise(whole)

    return F.regexp_replace(F.concat_ws("", F.transform(found, lambda p: F.concat(one(p), F.lit(",")))), r"(-,)+", "-,")


def licenses(sequence: Column) -> Column:
    """The licences that the rules find in a sequence, in the order of the rules; null for none."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_rule_pattern(ids)).alias("pattern")) for name, ids in RULES])
    start = F.struct(F.concat(F.lit(","), sequence).alias("left"), F.array().cast("array<string>").alias("names"))

    def step(a: Column, rule: Column) -> Column:
        spent = F.struct(F.regexp_replace(a["left"], rule["pattern"], F.lit(",*,")).alias("left"), F.array_append(a["names"], rule["name"]).alias("names"))
        return F.when(F.regexp_like(a["left"], rule["pattern"]), spent).otherwise(a)

    names = F.aggregate(rules, start, step, lambda a: F.array_join(F.array_distinct(a["names"]), ","))
    return F.when(~sequence.isin("", "-,"), F.nullif(names, F.lit("")))


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_sentences, sequence and licenses (names in the order of the rules, null for none)."""
    rows = df.select(F.col(id_col).alias("id"), pieces(F.col(text_col)).alias("found"))
    rows = rows.select("id", F.size("found").cast("long").alias("n_sentences"), identifiers(F.col("found")).alias("sequence"))
    return rows.select(F.col("id").alias(id_col), "n_sentences", "sequence", licenses(F.col("sequence")).alias("licenses"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    plain = f"'|' || translate(translate(coalesce(text, ''), '|', ' '), '{_UPPER}', '{_LOWER}') || '|'"
    for pattern, new in _steps(OPENINGS):
        plain = f"regexp_replace({plain}, '{pattern}', '{new.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    trimmed = r"list_filter(list_transform(regexp_split_to_array(plain, ' ?\n? ?\| ?\n? ?'), lambda p: trim(p, ' ' || chr(10))), lambda p: p <> '')"
    rules = ", ".join(f"({k}, '{name}', '{_rule_pattern(ids)}')" for k, (name, ids) in enumerate(RULES))
    return f"""
WITH RECURSIVE known(sentence, id) AS (VALUES {known}),
rules(k, name, pattern) AS (VALUES {rules}),
docs AS (SELECT doc_id, row_number() OVER () AS rn, {plain} AS plain FROM documents),
cut AS (SELECT rn, unnest(found) AS piece, unnest(range(len(found))) AS place FROM (SELECT rn, {trimmed} AS found FROM docs)),
whole AS (SELECT rn, place, piece, id FROM cut LEFT JOIN known ON regexp_replace(piece, ' ?\\n ?', ' ', 'g') = sentence),
lines AS (SELECT rn, place, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT rn, place, regexp_split_to_array(piece, ' ?\\n ?') AS l FROM whole WHERE id IS NULL AND contains(piece, chr(10)))),
lined AS (SELECT rn, place, string_agg(coalesce(id, '-'), ',' ORDER BY pos) AS ids FROM lines LEFT JOIN known ON line = sentence GROUP BY rn, place),
coded AS (SELECT w.rn, count(*) AS n, regexp_replace(string_agg(coalesce(id, ids, '-') || ',', '' ORDER BY w.place), '(-,)+', '-,', 'g') AS seq FROM whole w LEFT JOIN lined l ON w.rn = l.rn AND w.place = l.place GROUP BY w.rn),
every AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(seq, '') AS sequence FROM docs d LEFT JOIN coded c ON d.rn = c.rn),
walk(sequence, k, rest, names) AS (
  SELECT DISTINCT sequence, 0, ',' || sequence, []::VARCHAR[] FROM every WHERE sequence NOT IN ('', '-,')
  UNION ALL SELECT sequence, w.k + 1, regexp_replace(rest, pattern, ',*,', 'g'), CASE WHEN regexp_matches(rest, pattern) THEN list_append(names, name) ELSE names END FROM walk w JOIN rules r ON r.k = w.k),
named AS (SELECT doc_id, n_sentences, e.sequence, coalesce(names, []) AS names FROM every e LEFT JOIN walk w ON e.sequence = w.sequence AND w.k = {len(RULES)})
SELECT doc_id, n_sentences, sequence, nullif(array_to_string(list_filter(list_transform(range(1, len(names) + 1), lambda k: CASE WHEN list_position(names, names[k]) = k THEN names[k] END), lambda x: x IS NOT NULL), ','), '') AS licenses FROM named
"""


ORACLE = _oracle()
