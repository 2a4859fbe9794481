import hashlib
import re
import textwrap

import pytest
from fixtures import PROSE, ROWS, clashing, docs, empty

from semql.llm import license_scan as ls

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return ls.train([*PROSE, *(" ".join(f"w{(i * 7 + k) % 90}" for k in range(12)) for i in range(300)), "all the people may use this with the other version"])


def family(model, text):
    return ls.classify(model, ls.words_of(text))[0]


def families(model, text):
    """Families of all notices in a text."""
    return [f for spans, lines in ls.paragraphs(text) for _, _, f, *_ in ls.notices(model, lines)]


def test_templates_and_changes(model):
    for name, texts in ls.TEMPLATES.items():
        for t in texts:
            assert family(model, t) == name
            assert family(model, t.upper() + " and some more words") == name
    assert family(model, "This is licensed under the terms of the Foo Public Licence") == ls.UNKNOWN
    assert {family(model, t) for t in [*PROSE, "", "you may use the file"]} == {ls.NONE}


def test_in_order():
    assert ls.in_order(list("abcd"), list("xaxbxcxd")) == 1
    assert ls.in_order(list("abcd"), list("dcba")) == 0.25
    assert ls.in_order(list("ab"), []) == 0


TEXTS = {
    "MIT": """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.""",
    "GPL": """This file is part of a program with a name.

This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

You should have received a copy of the GNU General Public License along with this program.  If not, see a page.""",
    "LGPL": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.""",
    "BSD": """Copyright (c) 2011, Some One. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at a page.

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.  See the License for the
specific language governing permissions and limitations under the License.""",
    "EPL": """Copyright (c) 2001, 2009 Some Company and others.
All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public
License v1.0 which accompanies this distribution, and is available at a page""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at a page.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
}


@pytest.mark.parametrize("width", [40, 72, 80])
@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_texts(model, width, mark):
    """Standard texts, hard-wrapped and in comments, are found by their family and by no other."""
    for name, text in TEXTS.items():
        wrapped = "\n".join(mark + line for part in text.split("\n") for line in textwrap.wrap(part, width) or [""])
        found = families(model, f"{PROSE[0]}\n\n{wrapped}\n\n{PROSE[1]}")
        assert set(found) - {ls.UNKNOWN} == {name}, (name, found)
    assert families(model, "\n".join(textwrap.wrap(" ".join(PROSE), width))) == []


def test_identifiers_and_several_notices(model):
    for name, ids in ls.SPDX.items():
        for i in ids:
            assert families(model, f"// SPDX-License-Identifier: {i}") == [name], i
    assert families(model, "SPDX-License-Identifier: Foo-1.0") == [ls.UNKNOWN]
    assert families(model, "Released under the MIT License.\nLicensed under CC BY-SA 4.0.\nplain words between them\nReleased under the AGPL.") == ["MIT", "CC-BY-SA", "AGPL"]
    assert family(model, "Released under the Foo License.") == ls.UNKNOWN


def test_edges(spark, model):
    rows = [*ROWS, (50, "x\n\nReleased under the MIT License.\r\nLicensed under CC BY-NC 4.0.", "en", "a")]
    out = ls.scan(clashing(spark, rows), model)
    got = out.collect()
    assert len(got) == len(rows) and {r.part for r in got} == {"own part"}
    found = {r.doc_id: r.found for r in got if r.found}
    text = rows[-1][1]
    assert set(found) == {50} and [f.family for f in found[50]] == ["MIT", "CC-BY-NC"]
    assert [text[f.begin : f.end].strip() for f in found[50]] == [x.strip() for x in text.split("\n")[2:]]
    assert ls.scan(empty(spark), model).count() == 0 and ls.ordinary_paragraphs(empty(spark)) == []
    assert len(ls.ordinary_paragraphs(docs(spark))) > 5


def test_corpus(spark):
    """Every document with a notice, and no other, is found with its family."""
    notices = {"MIT": "MIT License", "Apache-2.0": "Apache License", "GPL": "GNU General Public License", "CC-BY-NC": "CC BY-NC"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r.families for r in ls.query(spark, DATA).collect()}
    want = {i: ",".join(sorted(f for f, n in notices.items() if re.search(n, t))) for i, t in texts.items()}
    assert got == want and sum(map(bool, want.values())) > 10


def test_query_columns(spark):
    """Paragraphs by hand, and digests from the spans that the same model finds text by text."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    model = ls.train(ls.ordinary_paragraphs(spark.read.parquet(f"{DATA}/documents.parquet")))
    for r in ls.query(spark, DATA).collect():
        found, n = [], 0
        for block in re.split(r"((?:^|\n)(?:[\W_]*(?:\n|$))+)", texts[r.doc_id]):
            n += bool(ls.words_of(block))
        for spans, lines in ls.paragraphs(texts[r.doc_id]):
            found += [(f, spans[i][0], spans[j - 1][1]) for i, j, f, *_ in ls.notices(model, lines)]
        assert (r.n_paragraphs, r.n_licence) == (n, len(found)), r.doc_id
        assert r.spans_sha256 == hashlib.sha256(",".join(f"{f}:{a}:{b}" for f, a, b in found).encode()).hexdigest()
        assert r.families == ",".join(sorted({f for f, *_ in found}))
