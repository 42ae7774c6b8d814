import math
import re
import textwrap

import pytest

from quadrille.llm import licences as L


def judged(words):
    """Family, probability, similarity of a unit, and the probability of `unknown`."""
    m = L.model()
    own = L._grams(words)
    z = list(m["bias"])
    for g in own & set(m["weights"]):
        z = [a + b for a, b in zip(z, m["weights"][g], strict=True)]
    e = [math.exp(v - max(z)) for v in z]
    best = max(range(len(e) - 1), key=lambda k: e[k])
    c = m["classes"][best]
    return c, e[best] / sum(e), max(len(L.grams(n) & own) / len(L.grams(n)) for n in L.NOTICES[c]), e[-1] / sum(e)


def confirmed(text):
    """Verdicts of the windows of a text that hold; every window is scored."""
    w = re.findall(L._WORD, text.lower())
    units = [w[i : i + 2 * L.REACH] for i in range(0, max(len(w) - L.REACH, 1), L.REACH)]
    return [(-s, -p, c) for c, p, s, u in map(judged, units) if u < L.PROBABLE and s >= L.CONFIRMED]


def plain(text):
    """The model applied in Python, without a gate."""
    sure, n = [], 0
    for paragraph in re.split(r"\n[ \t\r]*\n", (text or "").lower()):
        lines = [x for line in paragraph.split("\n") for x in confirmed(line)]
        joined = {}
        for x in confirmed(paragraph) if "\n" in paragraph else ():
            joined[x[2]] = min(x, joined.get(x[2], x))
        found = lines + [x for c, x in joined.items() if c not in {y[2] for y in lines}]
        hits = set(re.findall(rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, sorted(L.gate(), key=len, reverse=True)))})(?![a-z0-9])", paragraph))
        n += not found and len(hits) + len(hits & {*L.SURE}) > 1
        sure += found
    best = min(sure, default=(None, None, L.UNKNOWN))
    return [best[2], len(sure), sorted({c for _, _, c in sure}), n, *(-v for v in (best[1], best[0]) if v is not None)]


def result(df):
    return {r.doc_id: [r.family, r.n_notices, list(r.families), r.n_unconfirmed, *(v for v in (r.probability, r.similarity) if v is not None)] for r in L.scan_licences(df).collect()}


NOTICES = [(f, n) for f, ns in L.NOTICES.items() for n in ns]


def test_nothing_that_could_be_confirmed_lacks_two_words_of_the_gate():
    words = set(L.gate())
    for _, n in NOTICES:
        whole = L.grams(n)
        for one in [None, *(words - {*L.SURE})]:  # a name is scored alone
            left = {g for g in whole if not (set(g.split(" ")) & words) - {one}}
            assert len(left) < L.CONFIRMED * len(whole), n
    assert all(re.fullmatch(L._pattern(L.gate()), w) for w in words) and {*L.SURE} <= words
    assert not any(re.fullmatch(L._pattern(L.gate()), w[:-1]) for w in words if w[:-1] not in words)


def test_every_notice_is_its_family(make_docs):
    got = result(make_docs([(i, f"Some words here.\n  {n}.\nmore words") for i, (_, n) in enumerate(NOTICES)]))
    assert [got[i][0] for i in range(len(NOTICES))] == [f for f, _ in NOTICES]


@pytest.mark.parametrize("width", [72, 40, 24])
@pytest.mark.parametrize("prefix", ["", "// ", " * "])
def test_wrapped_notices_are_found(make_docs, width, prefix):
    wrap = lambda n: "\n".join(prefix + x for x in textwrap.wrap(n, width, break_on_hyphens=False, break_long_words=False))
    got = result(make_docs([(i, f"A file of ours, by the authors.\n\n{wrap('Note: ' + n + '.')}\n\nmore words here") for i, (_, n) in enumerate(NOTICES)]))
    assert [got[i][0] for i in range(len(NOTICES))] == [f for f, _ in NOTICES]


def shortened(n):
    """The notice without words at its end, and at its start, as far as it may still be confirmed."""
    w, whole = re.findall(L._WORD, n.lower()), L.grams(n)
    for cut in (lambda k: w[: len(w) - k], lambda k: w[k:]):
        k = max(k for k in range(len(w)) if len(L._grams(cut(k)) & whole) >= L.CONFIRMED * len(whole))
        yield " ".join(cut(k))


def test_shortened_notices_are_found(make_docs):
    short = [(f, x) for f, n in NOTICES for x in shortened(n)]
    got = result(make_docs([(i, x) for i, (_, x) in enumerate(short)]))
    assert [x for i, (_, x) in enumerate(short) if got[i][0] == L.UNKNOWN] == []
    # without its distinguishing words a notice may be taken for one of a related licence
    assert sum(got[i][0] == f for i, (f, _) in enumerate(short)) >= 0.85 * len(short)


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0. If a copy of the MPL was not distributed\nwith this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl"),
        ("This is free and unencumbered software released into the\npublic domain.", "cc0"),
        ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "lgpl"),
        ("and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
        ("under the AGPL version 3.0", "agpl"),
        ("Released under the Apache 2.0", "apache"),
    ],
)
def test_published_headers(make_docs, text, family):
    assert result(make_docs([(1, "x y\n\n" + text + "\n\nz")]))[1][0] == family


def test_notices_held_out_whole():
    held = L.model()["held"]
    assert held["taken"] > 0.8 and held["ordinary"] > 0.9


@pytest.mark.parametrize(
    ("line", "family"),
    [
        ("This file is licensed under the Apache License, Version 2.0; see LICENSE for details", "apache"),
        ("Code released under the MIT license, see LICENSE", "mit"),
        ("all text is licensed under cc by-nc 4.0 unless noted", "cc-by-nc"),
        ("This software is licensed under the GNU General Public License, version 3 or any later version", "gpl"),
        ("My driving license expired in Apache county", "unknown"),
        ("Ask the author for permission before the MIT lecture", "unknown"),
    ],
)
def test_lines_it_was_not_trained_on(make_docs, line, family):
    assert result(make_docs([(1, line)]))[1][0] == family


def test_columns_are_those_of_the_model_in_python(make_docs, messy):
    long = "lorem ipsum dolor " * 3000
    rows = [*messy, *((100 + i, f"{n}\nx\n{NOTICES[i - 1][1]}") for i, (_, n) in enumerate(NOTICES)), (300, long + "Licensed under the MIT License " + long), (301, "license\n" * 500), (302, "\n\nlicense"), (None, "Released under the MIT License."), *((400 + i, t) for i, t in enumerate(L.ORDINARY))]
    got = result(make_docs(rows))
    assert len(got) == len(rows)
    for i, t in rows:
        want = plain(t)
        assert got[i][:4] == want[:4] and got[i][4:] == pytest.approx(want[4:], abs=1e-4)
    assert all(got[400 + i][0] == L.UNKNOWN for i in range(len(L.ORDINARY)))
    assert result(make_docs([])) == {}
    assert L.scan_licences(make_docs([rows[0]] * 3)).count() == 3


def test_sql_gives_the_same_for_rows_of_every_kind(make_docs, messy):
    import duckdb
    import pandas as pd
    from pyspark.sql import functions as F

    texts = [t for _, t in messy] + [f"{n}\n{m}" for (_, n), (_, m) in zip(NOTICES, NOTICES[7:])] + ["\n".join(textwrap.wrap(" ".join(n for _, n in NOTICES[k : k + 4]), 50)) for k in range(0, len(NOTICES), 3)]
    texts += ["lorem " * 500 + n + " ipsum" * 100 + "\n \t\nlicense mit\n\n" + n.upper() for _, n in NOTICES[::5]]
    texts += [f"the license of {x} and the rights of others" for x in ("a shop", "a pilot", "a driver", "a school", "an angler", "a bar")]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    want = duckdb.sql(L.equivalent_sql()).fetchall()
    names = ["doc_id", "family", "probability", "similarity", "n_notices", "families", "n_unconfirmed"]
    got = L.scan_licences(make_docs(list(enumerate(texts)))).withColumn("families", F.array_join("families", ",")).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(documents) == len(want)
    assert sum(r.n_notices for r in got) > 100 and sum(r.n_unconfirmed for r in got) > 5


def test_no_python_on_the_executors(make_docs, messy):
    plan = L.scan_licences(make_docs(messy))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# Lines written apart from the notices.
APART = [
    ("mit", "MIT License"), ("mit", "License: MIT"), ("apache", "Licensed under the Apache-2.0 license"), ("gpl", "This file is licensed under the GPLv3"), ("gpl", "This software is distributed under the GPL-3.0"), ("isc", "SPDX-License-Identifier: ISC"),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY'), ("mit", "This project is MIT licensed"), ("mit", "Code is available under the terms of the MIT licence"),
    ("mit", "Distributed under the MIT license. See LICENSE for more information"), ("apache", "Copyright 2019 The Authors. Licensed under the Apache License 2.0"), ("apache", "This module uses the Apache 2 license"), ("apache", "Apache-2.0 licensed, see NOTICE"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"), ("bsd", "BSD 3-Clause License"), ("bsd", "license = BSD-3-Clause"), ("gpl", "GNU GPL version 3 or any later version"), ("gpl", "under the terms of the GPLv2"),
    ("gpl", "License: GPL-3.0-or-later"), ("lgpl", "licensed under LGPLv3 or later"), ("lgpl", "the GNU Lesser General Public License (LGPL) version 3"), ("agpl", "Released under AGPLv3"), ("agpl", "GNU Affero General Public License v3.0"), ("mpl", "Mozilla Public License Version 2.0"),
    ("mpl", "MPL-2.0 license"), ("cc-by", "Text is under CC-BY-4.0"), ("cc-by-sa", "Content is available under CC BY-SA 4.0 unless otherwise noted"), ("cc-by-sa", "Creative Commons Attribution-ShareAlike 3.0 Unported License"), ("cc-by-nc", "This dataset is licensed under CC-BY-NC-4.0"),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivatives license"), ("cc0", "Data is dedicated to the public domain (CC0)"), ("cc0", "Released under the Unlicense"), ("isc", "Licensed under the ISC license"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"), ("apache", 'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND'),
    ("gpl", "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY. See the GNU General Public License for more details."), ("bsd", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("proprietary", "Copyright 2021 Acme Corp. All rights reserved."), ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy"), ("apache", "you may not use this file except in compliance with the License"),
]
PLAIN = """The MIT campus is next to the river
She studied at MIT before she got her pilot license
The restaurant lost its liquor license under the new law
A license is required to sell fireworks in this town
The Apache warriors fought under their chief
He flew an Apache helicopter with a military license
The distributed system was released in spring
Fish and game licenses are sold at the counter
The terms of the contract are under review
Driving without a licence is a crime
Copies of the book were distributed to schools
The software company released its results
All students must obtain a copy of the form
The rights of tenants are protected by law
The warranty covers parts and labor for one year
The general public is invited to the opening
Mozilla held a conference in London
The foundation published a report on public health
A creative writing class meets in the commons
The attribution of the painting is disputed
Permission from the owner is needed to enter
Please include a notice in the window
No part of the house was damaged
The binary star system was observed in January
He redistributed the money among his workers
The version of events in the report is false
The library is free and open to all
Parents should have received a copy of the letter
Under the terms of the deal the club pays ten million
The license fee for television was raised
MIT licensed its patents to a startup
The new gpl standard was discussed
The report is confidential
The source of the river was found in 1858
The study was released under embargo
The marriage license was signed on Monday
The work was released to the public
Conditions in the mine were terrible
The software failed to start
The bar has a licence until two""".splitlines()


def test_recall_and_quiet_on_lines_written_apart(make_docs):
    written = {n for ns in L.NOTICES.values() for n in ns}
    assert not written & {x for _, x in APART if x not in ("SPDX-License-Identifier: ISC", "Licensed under the ISC license")} and not {*L.ORDINARY} & {*PLAIN}
    got = result(make_docs([(i, x) for i, (_, x) in enumerate(APART)] + [(1000 + i, x) for i, x in enumerate(PLAIN)]))
    assert [f for i, (f, _) in enumerate(APART[:7]) if got[i][0] != f] == []
    assert sum(got[i][0] == f for i, (f, _) in enumerate(APART)) >= 0.9 * len(APART)
    assert sum(got[1000 + i][0] == L.UNKNOWN for i in range(len(PLAIN))) >= 0.97 * len(PLAIN)
