import re

import numpy as np

from pagewatch.llm import licences as li
from pagewatch.llm.queries import QUERIES
from tests.llm.frames import TEXTS, documents

FOLDER = "/root/testdata/sf0.01"
# Notices that stand in the test documents, with their families.
PLANTED = {
    "Licensed under the Apache License, Version 2.0.": "apache",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Released under the MIT License.": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
}


def plain_lines(text):
    """Line by line in Python: (line_no, line, family, confirmed)."""
    vocabulary, weights, intercepts = li.trained()
    number, out = {g: i for i, g in enumerate(vocabulary)}, []
    for no, line in enumerate(re.split(r"\n|(?<=[.!?])[ \t]+", text or "")):
        own = li.grams(re.findall(r"[^\W_]+", line.lower()))
        met = [number[g] for g in own if g in number]
        if not met:
            continue
        p = li.softmax((weights[met].sum(0) + intercepts)[None])[0]
        family = li.FAMILIES[int(np.argmax(p))]
        if family == li.OTHER:
            continue
        sure = family if p.max() >= li.CERTAIN and family != li.UNLISTED else li.OTHER
        cover = max((len({*li.grams(li.words_of(t))} & {*own}) / len({*li.grams(li.words_of(t))}) for t in li.NOTICES.get(sure, ())), default=0)
        out.append((no, line, sure, cover >= li.COVERED))
    return out


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op4_licences"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert sorted(map(tuple, r.lines)) == sorted(plain_lines(docs[r.doc_id])), r.doc_id
        planted = {PLANTED[line] for line in (docs[r.doc_id] or "").split("\n") if line in PLANTED}
        assert set(r.families) == planted, r.doc_id


def test_notices_and_other_texts(spark):
    texts = [(f, t) for f, ts in li.NOTICES.items() for t in ts] + [(li.OTHER, t) for t in li.OTHER_TEXTS]
    docs = documents(spark, [(i, f"Some words before.\n{t}\nand after", "a") for i, (_, t) in enumerate(texts)])
    got = {r.doc_id: r.families for r in li.scan_documents(docs).collect()}
    for i, (family, text) in enumerate(texts):
        assert got[i] == ([] if family == li.OTHER else [family]), text


def test_awkward_texts(spark):
    rows = [*TEXTS, (8, "x\nReleased under the MIT License.", "a"), (8, "x\nReleased under the MIT License.", "a")]
    got = li.scan_documents(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.families) for r in got), key=repr) == sorted(((d, ["mit"] if d == 8 else []) for d, _, _ in rows), key=repr)
    assert li.scan_documents(documents(spark, [])).collect() == []


HEADERS = {
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
 as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
 License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
 files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
 conditions are met: redistributions of source code must retain the above copyright notice.""",
}


def test_wrapped_headers(spark):
    """Headers wrapped at several widths, bare and in comments, alone and among other lines; each is found once."""
    import textwrap

    rows, want = [], {}
    for family, header in HEADERS.items():
        for width in (30, 40, 60, 72, 79):
            lines = textwrap.wrap(" ".join(header.split()), width)
            for text in ("\n".join(lines), "/*\n * Some file of ours.\n *\n" + "\n".join(f" * {x}" for x in lines) + "\n */\nint x;"):
                want[len(rows)] = family
                rows.append((len(rows), text, "a"))
    got = {r.doc_id: r for r in li.scan_documents(documents(spark, rows)).collect()}
    assert {i: got[i].families for i in want} == {i: [f] for i, f in want.items()}
    assert [r.lines for r in got.values() if r.n_confirmed != 1] == []


def test_runs_end_at_blank_lines(spark):
    halves = "Licensed under the Apache", "License, Version 2.0."
    rows = [(i, f"x\n{halves[0]}{gap}{halves[1]}\ny", "a") for i, gap in enumerate(("\n", "\r\n# ", "\n\n", "\n * \n"))]
    got = {r.doc_id: r.families for r in li.scan_documents(documents(spark, rows)).collect()}
    assert got[0] == got[1] == ["apache"] and "next" not in li.licence_lines(documents(spark, rows)).columns


def test_telling_words():
    for notice in (t for notices in li.NOTICES.values() for t in notices):
        every = {*li.grams(li.words_of(notice))}
        assert len([g for g in every if not {*li.telling_words()} & {*g.split()}]) < li.COVERED * len(every)


def scanned(spark, texts):
    got = {r.doc_id: r for r in li.scan_documents(documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    return [got[i] for i in range(len(texts))]


def test_several_notices_of_a_line(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0. Copyright the authors. Released under the MIT License.",
        "Licensed under the MIT License. Portions licensed under the GNU General Public License, version 3.",
        "Intro words here. This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. And so on; Released under the ISC License.",
    ]
    assert [r.families for r in scanned(spark, texts)] == [["apache", "mit"], ["gpl", "mit"], ["isc", "mpl"]]


def test_everyday_wordings(spark):
    """Wordings that are not among the notices."""
    wanted = {
        "All code is available under the terms of the MIT license.": ["mit"],
        "This project is licensed under the MIT License - see the LICENSE file": ["mit"],
        "License: Apache-2.0": ["apache"],
        "It is made available under the Apache License 2.0": ["apache"],
        "Code in this folder is distributed under the BSD 3-Clause License": ["bsd"],
        "You may use it under the terms of the GNU General Public License": ["gpl"],
    }
    assert {t: r.families for t, r in zip(wanted, scanned(spark, wanted))} == wanted


def test_unseen_licences_count_as_unknown(spark):
    texts = [
        "Distributed under the Boost Software License, Version 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
        "Licensed under the European Union Public Licence, version 1.2", "Released under the zlib License.",
    ]
    rows = scanned(spark, texts)
    assert [t for t, r in zip(texts, rows) if r.families or not r.n_unknown] == []
    clean = ["The hall is open to the public. It was released into the wild.", "We drove under the bridge of the old town.", "He is free to use the car for any trip."]
    assert [t for t, r in zip(clean, scanned(spark, clean)) if r.families or r.n_unknown] == []
