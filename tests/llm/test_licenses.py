from patternlake.llm.licenses import ORACLE, RULES, SENTENCES, TEXTS, scan

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""


def test_scan(spark):
    cases = [
        (1, "Some words. Released under the MIT License."),
        (2, APACHE),
        (3, "This work is licensed under the GNU General Public License, version 3.\nOther.\nLicensed under CC BY-NC 4.0."),
        (4, "released UNDER the mit, license"),
        (5, "It was not released under the MIT License."),
        (6, None),
        (7, ""),
        (8, "Éa. " * 50_000 + "\nReleased under the MIT License."),
        (8, "Released under the MIT License! Released under the MIT License."),
        (None, "All rights reserved"),
    ]
    df = spark.createDataFrame(cases, "doc_id long, text string").selectExpr("*", "1 AS found", "2 AS sequence", "3 AS licenses", "4 AS id")
    rows = scan(df).collect()
    code = {k: SENTENCES[v] for k, v in {"M": "released under the mit license", "G": "this work is licensed under the gnu general public license version 3", "C": "licensed under cc by nc 4 0", "R": "all rights reserved"}.items()}
    apache = [SENTENCES[x] for x in ("licensed under the apache license version 2 0 the license", "you may not use this file except in compliance with the license", "you may obtain a copy of the license at")]
    want = {("1", f"-,{code['M']},", "MIT"), ("3", f"{code['G']},-,{code['C']},", "GPL-3.0-only,CC-BY-NC-4.0"), ("4", f"{code['M']},", "MIT"), ("5", "-,", None), ("6", "", None), ("7", "", None), ("8", f"-,{code['M']},", "MIT"), ("8", f"{code['M']},{code['M']},", "MIT"), ("None", f"{code['R']},", "all-rights-reserved")}
    got = {(str(r.doc_id), r.sequence, r.licenses) for r in rows}
    assert {x for x in got if x[0] != "2"} == want
    ((_, sequence, found),) = [x for x in got if x[0] == "2"]
    assert found == "Apache-2.0" and sequence.startswith(",".join([*apache, "-"])) and len(sequence.split(",")) == 7
    assert {r.doc_id: r.n_sentences for r in rows}[6] == 0
    assert scan(df.filter("false")).collect() == []


def test_rules_use_known_identifiers():
    assert {i for _, seq in RULES for i in seq} - {"-"} <= set(SENTENCES.values())


GPL = """{name} is free software{a} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{b} either version {v} of the License, or (at your option) any later version.

{name} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""


BSD_NUMBERED = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""


def test_full_and_wrapped_notices(spark):
    import textwrap

    texts = {
        "GPL-3.0-or-later": GPL.format(name="This program", a=":", b=",", v=3),
        "GPL-2.0-or-later": GPL.format(name="Frob", a=";", b=";", v=2),
        "MIT": MIT,
        "BSD": BSD,
        "BSD-3-Clause": next(t.wording for t in TEXTS if t.license == "BSD-3-Clause"),
        "Zlib": next(t.wording for t in TEXTS if t.license == "Zlib"),
        "MPL-2.0": next(t.wording for t in TEXTS if t.license == "MPL-2.0"),
        "LGPL-2.1-or-later": next(t.wording for t in TEXTS if t.license == "LGPL-2.1-or-later"),
        "Apache-2.0": APACHE,
    }
    cases = []
    for name, text in texts.items():
        for width in range(38, 101, 3):
            wrapped = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
            commented = "\n".join(f"# {line}".rstrip() for line in wrapped.split("\n"))
            starred = "/*\n" + "\n".join(f" * {line}" for line in wrapped.split("\n")) + "\n */\nint main() { return 0; }\n"
            cases += [(name, t) for t in (wrapped, commented, starred, f"Head\n{wrapped}\n\nTail", wrapped.replace("\n", "\r\n"))]
        cases.append((name, text))
    cases.append(("None", "It is not free software: you can redistribute\n\nit and/or modify it."))
    cases += [("BSD-2-Clause,all-rights-reserved", BSD_NUMBERED), ("None", "2.0\n\nversion 3")]
    df = spark.createDataFrame(cases, "doc_id string, text string")
    got = scan(df).collect()
    assert [(r.doc_id, r.licenses, r.sequence) for r in got if r.doc_id != str(r.licenses)][:8] == []
    # Sequences of more than one sentence decide, and the SQL finds them as well.
    assert sum(len(r.sequence.split(",")) > 3 for r in got) > len(got) // 2
    import duckdb

    documents = df.toPandas()  # noqa: F841  DuckDB finds the table by this name
    want = duckdb.sql(ORACLE.replace("FROM documents", "FROM documents")).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
