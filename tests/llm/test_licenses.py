"""Licences: standard texts as they are shipped, against what people call them, and against the SQL."""

import re

import duckdb
import pytest

from quarrywise.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Foo Bar

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE.
"""
BSD = """Copyright (c) 2020, Foo
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of FOO nor the names of its contributors may be used to
   endorse or promote products derived from this software without specific
   prior written permission.
"""
DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES.
"""
ISC = """Copyright 2020 Foo

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE.
"""
APACHE = """ * Copyright 2020 Foo
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
"""


def gnu(mark: str, kind: str, version: str, later: bool = True) -> str:
    option = ", or\n(at your option) any later version." if later else "."
    text = f"""This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation, either version {version} of the License{option}

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this program.  If not, see the web site.
"""
    return "".join(f"{mark} {line}".rstrip() + "\n" for line in text.splitlines())


CASES = {
    MIT: ["MIT"],
    BSD + DISCLAIMER: ["BSD-2-Clause"],
    BSD + ENDORSE + DISCLAIMER: ["BSD-3-Clause"],
    re.sub("(?m)^", "// ", BSD + ENDORSE + DISCLAIMER): ["BSD-3-Clause"],
    re.sub("\n", "\r\n", BSD + DISCLAIMER): ["BSD-2-Clause"],
    ISC: ["ISC"],
    APACHE: ["Apache-2.0"],
    gnu("#", "", "3"): ["GPL-3.0-or-later"],
    gnu(" *", "", "2"): ["GPL-2.0-or-later"],
    gnu("//", "", "3", later=False): ["GPL-3.0"],
    gnu("--", "Lesser ", "2.1"): ["LGPL-2.1-or-later"],
    gnu(";", "Lesser ", "3"): ["LGPL-3.0-or-later"],
    gnu("%", "Affero ", "3"): ["AGPL-3.0-or-later"],
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy is missing, get one.": ["MPL-2.0"],
    "CC0 1.0 Universal": ["CC0-1.0"],
    "This work is licensed under the Creative Commons Attribution 4.0\nInternational License.": ["CC-BY"],
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 licence.": ["CC-BY-NC-SA"],
    "Licensed under CC BY-ND 4.0": ["CC-BY-ND"],
    "Licensed under CC BY\nNC 4.0\n": ["CC-BY-NC"],
    "Some text.\nLicensed under CC BY-NC 4.0.": ["CC-BY-NC"],
    "This is free and unencumbered software released into the public domain.": ["Unlicense"],
    "The pictures were placed in the public domain.": ["Public-Domain"],
    "Released under the MIT License.": ["MIT"],
    "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.": ["Apache-2.0", "GPL-3.0"],
    "Licensed under either of the Apache License 2.0 or the MIT license, at your option.": ["MIT", "Apache-2.0"],
    "Licensed under MIT or Apache-2.0": ["MIT", "Apache-2.0"],
    "This is not licensed under the MIT License.": [],
    "The tool was never released under the GNU General Public License version 2.": [],
    "SPDX-License-Identifier: MIT\nCopyright 2020 X\nsome text": ["MIT"],
    "# SPDX-License-Identifier: MIT-0": ["MIT-0"],
    "// SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT", "Apache-2.0"],
    "SPDX-License-Identifier: LGPL-3.0-only": ["LGPL-3.0"],
    "SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) OR BSD-3-Clause": ["GPL-2.0-or-later", "BSD-3-Clause"],
    "SPDX-License-Identifier: GPL-2.0+ AND ISC": ["GPL-2.0-or-later", "ISC"],
    "SPDX-License-Identifier: Foo-1.0": ["UNMATCHED"],
    "Copyright 2020 X. All rights reserved.": ["Proprietary"],
    "All rights reserved": ["Proprietary"],
    "A license of another kind.": ["UNMATCHED"],
    MIT + "\nA license of another kind.": ["MIT", "UNMATCHED"],
    "Boost Software License - Version 1.0": ["BSL-1.0"],
    "nothing here as is, and gpl is a word of code": [],
    "Apache 2.0 was a server.": [],
    "Released under the GPL.": ["GPL"],
    "": [],
}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("licences"))
    filler = "word and other words. " * 40
    rows = [*CASES, None, *(filler + x + "\n\n" + filler for x in CASES), *(a + "\n\n" + b for a, b in zip(CASES, reversed(CASES))), filler * 3000 + "\n\n" + MIT, *[ISC] * 3]
    spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, Licences string, sentence_ids int").write.parquet(folder + "/documents.parquet")
    return folder


def test_standard_texts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*CASES, None])], "doc_id long, text string, Licences string")
    out = licenses.recognise(df)
    got = {r["doc_id"]: r["licences"] for r in out.collect()}
    assert {t: got[i] for i, t in enumerate(CASES)} == CASES and got[len(CASES)] == []
    assert licenses.recognise(df.limit(0)).count() == 0


def test_no_sentence_of_a_standard_text_is_unknown(spark):
    whole = [t for t in CASES if len(t) > 300 and "another kind" not in t]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(whole)], "doc_id long, text string")
    for r in licenses.recognise(df).collect():
        assert licenses.UNKNOWN not in r.sentence_ids, (whole[r.doc_id], r.sentence_ids)


def test_the_sql_agrees(spark, table):
    """The SQL has no stems, so it also shows that they lose nothing."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{table}/documents.parquet/*.parquet')")
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).values.tolist()), key=repr)
    assert key(licenses.op1_license_scans(spark, table).toPandas()) == key(con.execute(licenses.OP1_SQL).df())
