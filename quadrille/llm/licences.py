"""Licence scans: a paragraph classifier in DataFrame functions alone.

A paragraph ends at a blank line. It is read line by line, and, as notices are
wrapped, once more with its lines joined; long lines and joined ones are read in
overlapping windows of words, so that any notice stands whole in one of them.
The features of such a unit are the distinct words and word pairs that the model
knows. Multinomial logistic regression over them, trained in numpy on the driver
from the notices below and from made-up ordinary lines, gives each licence
family and `unknown` a probability, calibrated by a temperature on notices that
models of their own were not trained on. Where `unknown` has less than half, the
most probable family counts if a notice of that family confirms it: enough of the
notice's words and pairs stand in the unit.

Notices are customary ones, sentences of the licences' texts, and names: a name
of one word that means nothing else confirms alone, one that does - `MIT`,
`Apache` - beside a word of licences only; whether it is a notice is then for
the model to say.

Only units that hold two of the words of gate(), or a name, are scored. These are chosen so
that the words and pairs of a notice with one of them at most are too few to
confirm it, for every notice: nothing that could be confirmed is passed over.

The model is a literal of the plan. Scoring is one projection per document,
without a shuffle, a join or Python on the executors.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
CONFIRMED = 0.6  # of a notice's words and pairs that a unit must have
PROBABLE = 0.5  # that a unit is a notice of some family
FOLDS = 4  # of notices, for the temperature

# Customary licence notices by family.
NOTICES = {
    "agpl": ["GNU Affero General Public License", "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the AGPL version 3.0", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "Apache License 2.0", "Apache License Version 2.0, January 2004", "Released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License", "Released under the BSD 2-Clause License", "This source code is licensed under the BSD-style license", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International", "SPDX-License-Identifier: CC-BY-4.0", "Licensed under the Creative Commons Attribution License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0", "Available under the Creative Commons Attribution-ShareAlike License"],
    "cc0": ["CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "This work is dedicated to the public domain under CC0 1.0", "This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: CC0-1.0", "This work is in the public domain"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GPL version 2 or later", "Released under the GNU GPL v3", "GNU General Public License version 2", "You should have received a copy of the GNU General Public License along with this program", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "This library is free software under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the GNU Lesser General Public License, version 2.1", "Licensed under the LGPL version 3", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without prior written permission", "Copyright. All rights reserved", "This document is confidential and proprietary; unauthorized copying is prohibited without written permission"],
}
# Sentences of the texts of licences.
SENTENCES = {
    "agpl": ["This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU Affero General Public License for more details", "You should have received a copy of the GNU Affero General Public License along with this program"],
    "apache": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied", "See the License for the specific language governing permissions and limitations under the License"],
    "bsd": ["This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "cc-by": ["You are free to share and adapt the material for any purpose, even commercially, under the following terms: you must give appropriate credit, provide a link to the license, and indicate if changes were made"],
    "cc-by-nc": ["You may not use the material for commercial purposes. NonCommercial: you must give appropriate credit"],
    "cc-by-nd": ["NoDerivatives: if you remix, transform, or build upon the material, you may not distribute the modified material"],
    "cc-by-sa": ["ShareAlike: if you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original"],
    "cc0": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "gpl": ["This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "lgpl": ["This library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU Lesser General Public License for more details", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "mit": ["The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "mpl": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
}
# How licences are called, in one word that means nothing else.
NAMES = {
    "agpl": "agpl agplv3 agpl-3.0 agpl-3.0-only agpl-3.0-or-later", "apache": "apache-2.0 apache2 apache2.0 asl2", "bsd": "bsd-2-clause bsd-3-clause bsd-style bsd3 bsd2 0bsd", "cc-by": "cc-by cc-by-4.0 cc-by-3.0", "cc-by-nc": "cc-by-nc cc-by-nc-4.0 cc-by-nc-sa cc-by-nc-sa-4.0",
    "cc-by-nd": "cc-by-nd cc-by-nd-4.0", "cc-by-sa": "cc-by-sa cc-by-sa-4.0 cc-by-sa-3.0", "cc0": "cc0 cc0-1.0 unlicense", "gpl": "gplv2 gplv3 gpl-2.0 gpl-3.0 gpl2 gpl3 gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later",
    "lgpl": "lgpl lgplv2.1 lgplv3 lgpl-2.1 lgpl-3.0 lgpl-2.1-or-later lgpl-3.0-or-later", "mit": "mit-licensed mit-style", "mpl": "mpl-2.0 mplv2",
}
SURE = sorted({w for names in NAMES.values() for w in names.split()})
# Names of several words, and notices of their own. After "=" only the pairs of neighbours count, as the words mean other things too.
LONGER = {
    "agpl": ["GNU AGPL v3"], "apache": ["=Apache License", "=Apache Software License", "=Apache 2.0", "=Apache 2"], "bsd": ["BSD 3-Clause", "BSD 2-Clause", "=BSD License", "=BSD licensed"], "cc-by": ["Creative Commons Attribution", "=CC BY 4.0"], "cc-by-nc": ["Creative Commons Attribution-NonCommercial", "CC BY-NC"],
    "cc-by-nd": ["Creative Commons Attribution-NoDerivatives", "CC BY-ND"], "cc-by-sa": ["Creative Commons Attribution-ShareAlike", "CC BY-SA"], "cc0": ["Creative Commons Zero", "Public Domain Dedication", "dedicated to the public domain"], "gpl": ["GNU General Public License", "GNU GPL", "=GPL license", "=license GPL", "GPL v2", "GPL v3", "GPL version 3"],
    "isc": ["=ISC License", "Licensed under the ISC License", "SPDX-License-Identifier: ISC"], "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPL v3"], "mit": ["=MIT License", "=MIT Licence", "=license MIT", "=MIT licensed"], "mpl": ["Mozilla Public License", "=MPL 2.0"],
}
# What stands before a name.
BEFORE = ["", "note", "this file", "copyright 2020 someone", "the author says", "code and data", "license", "licensed under the", "is licensed under", "distributed under the", "released under the", "under the terms of the", "spdx-license-identifier"]
# Ordinary lines near the subject.
ORDINARY = [
    "He lost his driving licence last year", "The board renewed the licence of the restaurant", "You need permission from your parents to go", "The warranty of the car has run out", "A fishing license costs ten dollars",
    "The copyright debate went on in parliament", "She asked for permission to leave the room", "Poetic license is permitted in this form of verse", "The students at MIT built a small robot", "The Apache people lived in the southwest",
    "Please read the terms and conditions of the contract", "The gnu is a large antelope that lives on the plains", "Public health and public schools are paid by taxes", "This program is about free time and general health", "The version of the story that the foundation published is short",
    "Working without a license is a crime under state law", "The license plate of the other car was not found", "The bartender had a license under the old law", "A new version of the work will be released in January", "The mozilla team released a new version of the program",
    "Source and binary are words with many meanings", "The rights of workers are reserved in this law", "Creative people have attributes in common", "We distribute copies of the notice to all persons", "The commons is a meadow in public use",
]
# Words frequent in any English text.
FREQUENT = "a about above all along also an and any are as at available be been but by can could following for from has have he his if in included including into is it its list may met more must no not of on one or other our out part prior provided received released shall should than that the their them there this to under was we were when which who will with work would written you your file document copy people 1.0 2 3 state general public code".split()
_WORD = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
_BLANK = "\n[ \\t\\r]*\n"


def _grams(w: list[str]) -> set[str]:
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


def grams(line: str) -> set[str]:
    """Words and word pairs of a line, as the executors see them; of a notice that begins with "=", pairs alone."""
    found = _grams(re.findall(_WORD, line.lower()))
    return {g for g in found if " " in g} if line.startswith("=") else found


def _with_short_forms() -> dict[str, list[str]]:
    """The notices, sentences of the licences' texts, and names."""
    return {f: list(dict.fromkeys([*NOTICES.get(f, []), *SENTENCES.get(f, []), *LONGER.get(f, []), *NAMES.get(f, "").split()])) for f in sorted({*NOTICES, *LONGER})}


NOTICES = _with_short_forms()

#: Words of the longest notice: of windows of twice as many words, one every REACH, one holds any notice whole.
REACH = max(len(re.findall(_WORD, n.lower())) for ns in NOTICES.values() for n in ns)


def _most(notice: set[str], words: set[str]) -> int:
    """How many words and pairs of a notice a unit may have that has one of the words at most, and no name."""
    own = {w for g in notice for w in g.split(" ")} & words
    return max(sum(not (set(g.split(" ")) & own) - {w} for g in notice) for w in [None, *(own - {*SURE})])


@functools.cache
def gate() -> list[str]:
    """Words two of which, or a name, every unit has that a notice may confirm; those not frequent in any text, rare in ordinary lines, and in most notices, come first."""
    ordinary = Counter(w for n in ORDINARY for w in re.findall(_WORD, n.lower()))
    live, chosen = [grams(n) for ns in NOTICES.values() for n in ns], {*SURE}
    while live := [x for x in live if _most(x, chosen) >= CONFIRMED * len(x)]:  # a word more never lets a notice in again
        held = Counter(w for x in live for w in {v for g in x for v in g.split(" ")} if w not in chosen)
        chosen.add(min(held, key=lambda w: (w in FREQUENT, ordinary[w], -held[w], w)))
    return sorted(chosen)


def _pattern(words: list[str]) -> str:
    """One of the words, each shared beginning once: a choice by the next character, not by every word; many choices by a few classes of characters first."""
    after: dict[str, list[str]] = {}
    for w in words:
        if w:
            after.setdefault(w[0], []).append(w[1:])
    each = {c: re.escape(c) + _pattern(rest) for c, rest in sorted(after.items())}
    if len(each) > 6:
        parts = [list(each)[k : k + 5] for k in range(0, len(each), 5)]
        choices = "|".join(f"(?=[{''.join(map(re.escape, part))}])(?:{'|'.join(each[c] for c in part)})" for part in parts)
    else:
        choices = "|".join(each.values())
    return f"(?:{choices}){'?' if '' in words else ''}" if choices else ""


def _weight(words):
    """Of different words of the gate: how many, names counted twice. Above 1, they may be a notice's."""
    return F.size(words) + F.size(F.array_intersect(words, _literal(SURE, "array<string>")))


def _hits(text):
    """The weight of the words of the gate in a text."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?<![a-z0-9]){_pattern(gate())}(?![a-z0-9])"), F.lit(0)))
    return F.transform(F.array(found), _weight)[0]  # found once


def _shortest(line: str) -> list[set[str]]:
    """Features of a notice without words at its start, or at its end, as far as it may still be confirmed."""
    w = re.findall(_WORD, line.lower())
    whole = _grams(w)
    return [_grams(next(x for x in cuts if len(_grams(x) & whole) >= CONFIRMED * len(whole))) for cuts in ([w[:k] for k in range(1, len(w) + 1)], [w[len(w) - k :] for k in range(1, len(w) + 1)])]


def _varied(line: str, r: np.random.Generator) -> set[str]:
    """Features of a notice as it may stand among other words, with words lost at its ends or anywhere, and confirmed still."""
    w = re.findall(_WORD, line.lower())
    whole, kind = grams(line), r.integers(3)
    at = r.integers(0, len(w))
    own = w if kind == 0 else [x for x in w if r.random() > 0.15] if kind == 1 else w[at:] if r.random() < 0.5 else w[: len(w) - at]
    if len(_grams(own) & whole) < CONFIRMED * len(whole):
        own = w
    around = [str(x) for n in r.choice(ORDINARY, r.integers(0, 4)) for x in re.findall(_WORD, n.lower())]
    at = r.integers(0, len(around) + 1)
    lead = str(r.choice(BEFORE if len(w) < 4 else BEFORE[:6])).split()
    return _grams([*around[:at], *lead, *own, *str(r.choice(["", "see file", "for details", "and others"])).split(), *around[at:]])


def _fitted(notices: dict[str, list[str]], classes: list[str], at: dict[str, int], r: np.random.Generator, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the regression on variants of notices and of ordinary lines."""
    short = lambda n: n.startswith("=") or " " not in n
    lines = [(_varied(n, r), classes.index(c)) for c, ns in notices.items() for n in ns for _ in range(8)]
    lines += [(x, classes.index(c)) for c, ns in notices.items() for n in ns if not short(n) for x in _shortest(n) for _ in range(2)]
    lines += _ordinary(classes, at, r, 9)
    x, y = _matrix(lines, at)
    x = x.astype(np.float32)
    target = np.eye(len(classes), dtype=np.float32)[y]
    weight, bias = np.zeros((len(at), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    moved, shifted = np.zeros_like(weight), np.zeros_like(bias)
    share = (1 / np.maximum(np.bincount(y, minlength=len(classes)), 1)[y] / len(classes)).astype(np.float32)
    for _ in range(rounds):  # with momentum
        z = x @ weight + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - target) * share[:, None]
        moved, shifted = 0.9 * moved - 2.0 * (x.T @ d + 1e-4 * weight), 0.9 * shifted - 2.0 * d.sum(axis=0)
        weight, bias = weight + moved, bias + shifted
    return weight.astype(np.float64), bias.astype(np.float64)


def _ordinary(classes: list[str], at: dict[str, int], r: np.random.Generator, rounds: int) -> list[tuple[set[str], int]]:
    words = [g for g in at if " " not in g and g not in SURE]
    lines = [re.findall(_WORD, " ".join(r.choice(ORDINARY, r.integers(1, 4))).lower()) for _ in range(rounds * len(ORDINARY))]
    lines += [r.choice(words, r.integers(1, 25)).tolist() for _ in range(rounds * 40)]
    return [(_grams(w), len(classes) - 1) for w in lines]


def _matrix(lines: list[tuple[set[str], int]], at: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(lines), len(at)))
    for k, (found, _) in enumerate(lines):
        x[k, [at[g] for g in found if g in at]] = 1
    return x, np.array([y for _, y in lines])


def _probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@functools.cache
def model(seed: int = 0) -> dict:
    """classes, weights of known features, bias, and how notices fared that were held out. The same whatever the input.

    Notices are held out whole, a fold at a time; what models without them give
    for them, and for ordinary lines, sets the temperature. The model itself is
    then trained on all.
    """
    r = np.random.default_rng(seed)
    classes = [*sorted(NOTICES), UNKNOWN]
    at = {g: i for i, g in enumerate(sorted(set().union(*(grams(n) for ns in NOTICES.values() for n in ns))))}
    logits, truth, is_notice = [], [], []
    for fold in range(FOLDS):
        kept = {c: [n for k, n in enumerate(ns) if k % FOLDS != fold] for c, ns in NOTICES.items()}
        held = [(_varied(n, r), classes.index(c)) for c, ns in NOTICES.items() for k, n in enumerate(ns) if k % FOLDS == fold and kept[c] for _ in range(2)]
        known = {g: i for i, g in enumerate(sorted(set().union(*(grams(n) for ns in kept.values() for n in ns))))}
        weight, bias = _fitted({c: ns for c, ns in kept.items() if ns}, classes, known, r, 100)
        x, y = _matrix(held + _ordinary(classes, known, r, 1)[: len(held)], known)
        logits.append(x @ weight + bias)
        truth.append(y)
        is_notice.append(np.arange(len(y)) < len(held))
    z, y, notice = np.concatenate(logits), np.concatenate(truth), np.concatenate(is_notice)

    def loss(t):
        return -np.log(np.maximum(_probabilities(z / t)[np.arange(len(y)), y], 1e-12)).mean()

    temperature = min(np.geomspace(0.2, 20, 90), key=loss)
    p = _probabilities(z / temperature)
    held = {"right": float((p.argmax(axis=1) == y)[notice].mean()), "taken": float((p[notice, -1] < PROBABLE).mean()), "ordinary": float((p[~notice, -1] > PROBABLE).mean()), "temperature": float(temperature)}
    weight, bias = _fitted(NOTICES, classes, at, r, 300)
    return {"classes": classes, "weights": {g: [round(float(v), 6) for v in weight[i] / temperature] for g, i in at.items()}, "bias": [round(float(v), 6) for v in bias / temperature], "held": held}


def _literal(value, kind: str):
    return F.from_json(F.lit(json.dumps({"x": value})), f"struct<x:{kind}>")["x"]


def _scored(words):
    """family, probability and similarity of a unit, an array of words, and the probability of `unknown`."""
    m = model()
    classes = m["classes"]
    weights, bias = _literal(m["weights"], "map<string,array<double>>"), _literal(m["bias"], "array<double>")
    known = _literal(sorted(m["weights"]), "array<string>")
    notices = _literal([[sorted(grams(n)) for n in NOTICES.get(c, [])] for c in classes], "array<array<array<string>>>")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    found = F.array_intersect(known, F.concat(words, pairs))

    def scores(own):
        total = F.aggregate(own, bias, lambda t, g: F.zip_with(t, F.element_at(weights, g), lambda a, b: a + b))
        return F.transform(F.array(total), lambda z: F.transform(F.array(F.transform(z, lambda v: F.exp(v - F.array_max(z)))), lambda e: F.struct(own.alias("own"), F.aggregate(e, F.lit(0.0), lambda a, b: a + b).alias("sum"), e.alias("e")))[0])[0]

    def verdict(s):
        families = F.slice(s["e"], 1, len(classes) - 1)
        best = F.array_position(families, F.array_max(families)).cast("int")
        similar = F.array_max(F.transform(F.element_at(notices, best), lambda n: F.size(F.array_intersect(n, s["own"])) / F.size(n)))
        return F.struct(F.element_at(F.array(*[F.lit(c) for c in classes]), best).alias("family"), (F.array_max(families) / s["sum"]).alias("probability"), F.coalesce(similar, F.lit(0.0)).alias("similarity"), (F.element_at(s["e"], -1) / s["sum"]).alias("unknown"))

    # each step stands once: arrays of one element carry it to the next
    return F.transform(F.transform(F.array(found), scores), verdict)[0]


def _windows(text):
    """The words of a text in windows of 2 * REACH, one every REACH, the last one shorter."""

    def cut(words):
        n = F.greatest(F.ceil((F.size(words) - 2 * REACH) / F.lit(REACH)), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(words, i * REACH + 1, F.lit(2 * REACH)))

    # as the one element of an array the words are found once, not for each window
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))), cut)[0]


def _confirmed(units):
    """The verdicts of the units, arrays of words, that a notice confirms; those without two words of the gate are not scored."""
    words = _literal(gate(), "array<string>")
    scored = F.transform(F.filter(units, lambda u: _weight(F.array_intersect(u, words)) > 1), _scored)
    return F.filter(scored, lambda x: (x["unknown"] < PROBABLE) & (x["similarity"] >= CONFIRMED))


def _paragraph(p):
    """lines: verdicts of confirmed lines; joined: of windows of the joined lines, for families that no line has, the best of each."""
    lines = F.flatten(F.transform(F.filter(F.split(p, "\n"), lambda x: _hits(x) > 1), _windows))
    joined = F.when(F.contains(p, F.lit("\n")), _windows(p)).otherwise(F.array().cast("array<array<string>>"))

    def both(own):
        families = F.transform(own, lambda x: x["family"])
        rest = F.filter(_confirmed(joined), lambda x: ~F.array_contains(families, x["family"]))
        ordered = F.array_sort(F.transform(rest, lambda x: F.struct(x["family"].alias("family"), (-x["probability"]).alias("p"), (-x["similarity"]).alias("s"))))
        one = F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["family"] != x["family"]))
        lined = F.transform(own, lambda x: F.struct(x["family"].alias("family"), (-x["probability"]).alias("p"), (-x["similarity"]).alias("s")))
        return F.concat(lined, one)

    return F.transform(F.array(_confirmed(lines)), both)[0]


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, family, probability, similarity, n_notices, families, n_unconfirmed for each row of docs.

    family, probability and similarity are those of the confirmed unit with the
    highest similarity (then probability, then name); `unknown`, null and null
    without one. n_notices counts confirmed lines (windows of long ones), and one
    for each family that only joined lines of a paragraph have. families holds
    all confirmed, in order; n_unconfirmed counts paragraphs with two words of the
    gate, or a name, and no confirmed notice. Null and empty texts have no paragraphs; repeated
    rows and null ids come through; no rows give none; other columns are not read.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.lower(F.col(text).cast("string")).alias("text"))
    paragraphs = F.filter(F.split("text", _BLANK), lambda p: _hits(p) > 1)
    gated = narrow.select("doc_id", F.when(_hits(F.col("text")) > 1, F.transform(paragraphs, _paragraph)).alias("found"))
    none = F.array().cast("array<struct<family:string,p:double,s:double>>")
    counted = gated.select("doc_id", F.coalesce(F.size(F.filter("found", lambda x: F.size(x) == 0)), F.lit(0)).alias("n"), F.coalesce(F.flatten("found"), none).alias("sure"))
    best = F.element_at(F.array_sort(F.transform("sure", lambda x: F.struct(x["s"].alias("s"), x["p"].alias("p"), x["family"].alias("family")))), 1)
    top = counted.select("doc_id", "n", "sure", F.when(F.size("sure") > 0, best).alias("best"))
    return top.select(
        "doc_id",
        F.coalesce(F.col("best.family"), F.lit(UNKNOWN)).alias("family"),
        F.round(-F.col("best.p"), 4).alias("probability"),
        F.round(-F.col("best.s"), 4).alias("similarity"),
        F.size("sure").cast("long").alias("n_notices"),
        F.array_sort(F.array_distinct(F.transform("sure", lambda x: x["family"]))).alias("families"),
        F.greatest(F.col("n"), F.lit(0)).cast("long").alias("n_unconfirmed"),
    )


def equivalent_sql() -> str:
    """The same over documents as SQL of DuckDB, with the model's numbers in it and families joined by commas; every step is a join or a list function instead of a projection."""
    m = model()
    text = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(xs) + "]"
    weights = ", ".join(f"({text(g)}, {listed(f'{v!r}::DOUBLE' for v in w)})" for g, w in m["weights"].items())
    notices = ", ".join(f"({m['classes'].index(c) + 1}, {listed(map(text, sorted(grams(n))))})" for c, ns in NOTICES.items() for n in ns)
    sums = listed(f"sum(v[{i + 1}]) + {b!r}::DOUBLE" for i, b in enumerate(m["bias"]))
    # there is no looking behind: what parts words is doubled, so that a match may use it up on both sides
    doubled = "|".join(re.sub(r"([^a-z0-9])", r"\\\1\\\1", w) for w in sorted(gate(), key=lambda w: (-len(w), w)))
    sure = listed(text(w) for w in SURE)
    twice = listed(text(re.sub(r"([^a-z0-9])", r"\1\1", w)) for w in SURE)
    found = lambda x: f"list_distinct(regexp_extract_all(regexp_replace({x}, '([^a-z0-9])', '\\1\\1', 'g'), '(?:^|[^a-z0-9])({doubled})(?:[^a-z0-9]|$)', 1))"
    hits = lambda x: f"len({found(x)}) + len(list_intersect({found(x)}, {twice}))"
    words = lambda x: f"regexp_extract_all({x}, '{_WORD}')"
    return f"""
        WITH w AS (SELECT * FROM (VALUES {weights}) AS t(g, v)), notice AS (SELECT * FROM (VALUES {notices}) AS t(c, ng)),
        d AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
        p AS (SELECT d, unnest(string_split_regex(lower(text), '\n[ \t\r]*\n')) AS para FROM d),
        q AS (SELECT row_number() OVER () AS q, d, para FROM p WHERE {hits("para")} > 1),
        line AS (SELECT q, unnest(string_split(para, chr(10))) AS line FROM q),
        r AS (SELECT q, 0 AS joined, {words("line")} AS ws FROM line WHERE {hits("line")} > 1
              UNION ALL SELECT q, 1, {words("para")} FROM q WHERE contains(para, chr(10))),
        cut AS (SELECT q, joined, ws, unnest(range(0, greatest(ceil((len(ws) - {2 * REACH}) / {REACH}.0), 0)::BIGINT + 1)) AS i FROM r),
        u AS (SELECT row_number() OVER () AS u, q, joined, ws[i * {REACH} + 1 : i * {REACH} + {2 * REACH}] AS ws FROM cut),
        g AS (SELECT u, q, joined, list_distinct(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]))) AS gs
              FROM u WHERE len(list_filter({listed(map(text, gate()))}, lambda x: list_contains(ws, x))) + len(list_filter({sure}, lambda x: list_contains(ws, x))) > 1),
        z AS (SELECT u, {sums} AS z FROM (SELECT u, unnest(gs) AS g FROM g) JOIN w USING (g) GROUP BY u),
        e AS (SELECT u, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z),
        b AS (SELECT u, e, list_position(e[:{len(NOTICES)}], list_max(e[:{len(NOTICES)}])) AS c FROM e),
        s AS (SELECT u, max(len(list_intersect(ng, gs))::DOUBLE / len(ng)) AS s FROM b JOIN g USING (u) JOIN notice USING (c) GROUP BY u),
        sure AS (SELECT q, joined, ({listed(map(text, m["classes"]))})[c] AS family, e[c] / list_sum(e) AS p, s
                 FROM b JOIN s USING (u) JOIN g USING (u) WHERE e[{len(m["classes"])}] / list_sum(e) < {PROBABLE} AND s >= {CONFIRMED}),
        kept AS (SELECT q, family, p, s FROM sure WHERE joined = 0
                 UNION ALL SELECT q, family, p, s FROM sure x WHERE joined = 1 AND NOT EXISTS (FROM sure y WHERE y.q = x.q AND y.joined = 0 AND y.family = x.family)
                 QUALIFY row_number() OVER (PARTITION BY q, family ORDER BY p DESC, s DESC) = 1),
        found AS (SELECT d, count(*) AS n, list_sort(list_distinct(list(family))) AS families, min((-s, -p, family)) AS best FROM kept JOIN q USING (q) GROUP BY d),
        missed AS (SELECT d, count(*) AS n FROM q ANTI JOIN kept USING (q) GROUP BY d)
        SELECT doc_id, coalesce(best[3], '{UNKNOWN}') AS family, round(-best[2], 4) AS probability, round(-best[1], 4) AS similarity,
               coalesce(found.n, 0) AS n_notices, coalesce(array_to_string(families, ','), '') AS families, coalesce(missed.n, 0) AS n_unconfirmed
        FROM d LEFT JOIN found USING (d) LEFT JOIN missed USING (d)"""
