"""Licence scans: planted lines are found and told apart, other text is left alone."""

import pytest

from isochron.llm import licenses


@pytest.fixture(scope="module")
def model(spark, sf):
    return licenses.fit(spark.read.parquet(f"{sf}/documents.parquet"))


PLANTED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided",
    "proprietary": "Copyright 2020 Somebody. All rights reserved.",
    "unknown": "The driver needs a license to drive a car, and the office that gives the license is open on weekdays",
}


@pytest.mark.parametrize("family", PLANTED)
def test_families(model, family):
    assert model.classify(PLANTED[family])[0] == family


def test_scan(spark, model):
    rows = [(1, "intro\n" + PLANTED["mit"] + "\n\noutro", "x"), (2, None, "x"), (3, "", "x"), (4, "plain words\n" * 50_000, "x"), (5, "é " + PLANTED["gpl"], "x"), (5, "é " + PLANTED["gpl"], "x"), (None, PLANTED["bsd"], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = licenses.scan(docs, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and by[1]["families"] == ["mit"] and by[1]["n_paragraphs"] == 3 and by[None]["families"] == ["bsd"] and by[5]["families"] == ["gpl"]
    raw = rows[0][1].encode()
    assert [raw[s["start"] : s["end"]].decode() for s in by[1]["spans"]] == [PLANTED["mit"]]
    assert (by[2]["n_paragraphs"], by[3]["n_hits"], by[4]["n_hits"], by[4]["n_paragraphs"]) == (0, 0, 0, 50_000)
    assert licenses.scan(docs.limit(0), model).count() == 0


def plain_unknown(text, spans):
    at, n = 0, 0
    for line in text.split("\n"):
        end = at + len(line.encode())
        n += bool(licenses._HINT.search(line.encode())) and not any(s["start"] < end and at < s["end"] for s in spans)
        at = end + 1
    return n


def test_whole_table_equals_line_by_line(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in licenses.scan(docs, model).collect()}
    for r in docs.collect():
        lines = [x for x in (r["text"] or "").split("\n") if x.strip()]
        found = [f for f in (model.classify(x)[0] for x in lines if licenses._HINT.search(x.encode())) if f != "unknown"]
        assert got[r["doc_id"]]["families"] == sorted(set(found)) and got[r["doc_id"]]["n_hits"] == len(found)
        assert got[r["doc_id"]]["n_unknown"] == plain_unknown(r["text"] or "", got[r["doc_id"]]["spans"])


UNHINTED = {
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public",
    "proprietary": "Unauthorised copying of this file is strictly prohibited.",
}


def test_lines_without_a_hint_word_are_scored(spark, model):
    assert not any(licenses._HINT.search(x.encode()) for x in UNHINTED.values())
    docs = spark.createDataFrame([(k, f"intro\n\n{x}\n\noutro") for k, x in enumerate(UNHINTED.values())], "doc_id bigint, text string")
    assert [r["families"] for r in licenses.scan(docs, model).orderBy("doc_id").collect()] == [[f] for f in UNHINTED]


def test_whole_table_equals_every_line(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["families"] for r in licenses.scan(docs, model).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == sorted({model.classify(x)[0] for x in (r["text"] or "").split("\n")} - {"unknown"})


NOTICES = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts if f != "unknown"]


@pytest.mark.parametrize("size", [50, 500, 5_000])
def test_notices_inside_long_paragraphs(spark, sf, model, size):
    other = [w for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect() if not model.notices((r["text"] or "").encode()) for w in r["text"].split()]
    for k, (family, notice) in enumerate(NOTICES):
        around = [other[(k * 997 + i) % len(other)] for i in range(size)]
        for at in (0, size // 3, size):
            text = " ".join([*around[:at], notice, *around[at:]])
            begin = len(" ".join([*around[:at], ""]).encode())
            shared = [min(b, begin + len(notice)) - max(a, begin) for a, b, f, *_ in model.notices(text.encode()) if f == family]
            assert max(shared, default=0) >= len(notice) // 2, (notice, at)


def test_windows_equal_brute_force(model):
    text = "the words before it Released under the MIT License and all rights reserved by nobody then SPDX-License-Identifier: MIT the end of all rights of the GNU"
    words = licenses.tokens(text)
    every = []
    for label, template in model.flat:
        for i in range(len(words)):
            own = words[i : i + len(template)]
            p = model.probabilities(own)
            if licenses.similarity(own, template) >= licenses.LEAST_SIMILARITY and p.argmax() == label and p[label] >= licenses.LEAST_PROBABILITY:
                every.append((i, i + len(template), licenses.FAMILIES[label]))
    got = model.windows([w.encode() for w in words])
    assert [x[2] for x in got] == ["mit", "proprietary", "mit"] and all(any(a < y and x < b for a, b, *_ in got) for x, y, _ in every)
    for t, (_, template) in enumerate(model.flat):
        starts, counts = model.pairs.windows(model.pairs.ids([w.encode() for w in words]), t, len(template))
        want = {i: n for i in range(len(words)) if (n := licenses.similarity(words[i : i + len(template)], template)) >= licenses.LEAST_SIMILARITY}
        assert {i: c / model.pairs.sizes[t] for i, c in zip(starts.tolist(), counts.tolist())} == pytest.approx(want)


WRAPPED = {
    "mit": """MIT License

Copyright (c) 2021 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "gpl": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.""",
    "apache": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "mpl": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
}
WRAPPED |= {
    "lgpl": """/* This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version. */""",
    "agpl": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "epl": """This program and the accompanying materials are made available
under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/""",
}
WRAPPED |= {
    "boost": """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:""",
    "zlib": """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.""",
    "unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "cc0": """To the extent possible under law, the person who associated CC0 with this work has
waived all copyright and related or neighboring rights to this work.""",
    "gfdl": """Permission is granted to copy, distribute and/or modify this document
under the terms of the GNU Free Documentation License, Version 1.3
or any later version published by the Free Software Foundation;""",
}
TITLES = {"mit": "MIT License", "gpl": "GNU GENERAL PUBLIC LICENSE", "apache": "Apache License\nVersion 2.0, January 2004", "bsd": "BSD 3-Clause License", "mpl": "Mozilla Public License Version 2.0", "isc": "ISC License", "epl": "Eclipse Public License - v 2.0", "lgpl": "GNU LESSER GENERAL PUBLIC LICENSE", "agpl": "GNU AFFERO GENERAL PUBLIC LICENSE", "boost": "Boost Software License - Version 1.0 - August 17th, 2003", "busl": "Business Source License 1.1", "cc0": "CC0 1.0 Universal", "gfdl": "GNU Free Documentation License", "sspl": "Server Side Public License\nVERSION 1, OCTOBER 16, 2018", "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n        Version 2, December 2004", "artistic": "The Artistic License 2.0"}


@pytest.mark.parametrize("text", [WRAPPED, TITLES, {k: v.replace("\n", "\r\n") for k, v in WRAPPED.items()}], ids=["wrapped", "titles", "crlf"])
def test_standard_notices(spark, model, text):
    rows = [(k, f"Some words of prose\nabout a program.\n \n{t}\n\nAnd more of it.") for k, t in text.items()]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id bigint, text string"), model).collect()}
    assert {f: got[k]["families"] for k, (f, _) in enumerate(rows)} == {f: [f] for f in text}


def test_wrapped_notice_is_one_span(model):
    text = b"intro\n\n" + WRAPPED["mpl"].encode()
    (at, block), = [x for x in licenses.blocks(text) if b"Mozilla" in x[1]]
    start, end, family, *_ = model.notices(block)[0]
    assert family == "mpl" and text[at + start : at + end] == b"This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0"
    assert b"".join(t for _, t in licenses.blocks(b"a\n \nb\n\n\nc\r\n\r\nd")).split() == [b"abc", b"d"]
    assert [text[i : i + len(t)] == t for i, t in licenses.blocks(text)] == [True, True]


PROSE = ("Das Kind ging mit der Mutter mit dem Hund", "All rights of the people were taken from them", "The album was released under the new label in May", "Permission to enter is granted to any person with a ticket", "Der Vertrag mit Lizenz und Copyright (c) bleibt", "The general public license office is open on weekdays")


@pytest.mark.parametrize("text", PROSE)
def test_prose_stays_unknown(model, text):
    assert model.classify(text)[0] == "unknown" and not model.notices(f"words before it\n{text}\nwords behind it".encode())


def test_many_notices_in_a_block_take_linear_time(model):
    line = b"Released under the MIT License.\n"
    found = model.notices((line + b"plain words of prose\n") * 20_000)
    assert len(found) == 20_000 and {x[2] for x in found} == {"mit"} and found[-1][0] == 19_999 * (len(line) + 21)
