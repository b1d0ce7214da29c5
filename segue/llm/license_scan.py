"""Licence statements, by a trained paragraph classifier that template comparison confirms.

Only what a template can confirm is classified, which loses nothing: a paragraph is a stretch of a block (blank lines part
blocks, whatever comment marks or line ends are within) in which word pairs of the templates lie at most ``GAP`` words apart.
Multinomial logistic regression over sparse word n-grams (one to three words, digits unified) gives each licence family and an
unknown class a probability. A family is reported if its probability reaches ``least`` and the paragraph's word pairs agree with
one of its templates: it holds the share ``agreed`` of the template's pairs, or that share of its own ``OWN`` or more pairs stand
in the template. If lines of a paragraph that each hold a whole template are of different families, each is a finding; else
a paragraph is one, and findings of one family that follow on each other are one too.

Training data are variants of the templates (years, holders, cuts, comment marks, line ends) and, for the unknown class, ordinary
sentences about the same words and such paragraphs of a bounded sample of documents (``sample_docs``, taken by a hash) as agree with
no template. A temperature calibrates the probabilities: it is fitted on variants of templates and sentences that a first model
has not seen, and the model of all of them takes it over.

A null or empty text has no findings; rows are independent, so repeated rows and ties need no rule; an empty table gives an
empty result.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from segue.llm.common import id_text, mapped, sample

UNKNOWN = "unknown"
#: Short public notices of each family, as texts to compare with.
TEMPLATES = {
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "apache": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0.", "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD 3-Clause License.", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.", "SPDX-License-Identifier: BSD-3-Clause"),
    "boost": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Licensed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "You may use this text under the terms of the Creative Commons Attribution-ShareAlike 3.0 Unported License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under the CC0 1.0 Universal dedication.", "SPDX-License-Identifier: CC0-1.0"),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution.", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "gpl": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL v3.", "SPDX-License-Identifier: GPL-2.0-only"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "Released under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "reserved": ("All rights reserved.", "Copyright (c) 2020 The Company. All rights reserved.", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, without the prior written permission of the publisher."),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "Released under the zlib License.", "SPDX-License-Identifier: Zlib"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"),
}
#: Ordinary sentences about the same words, for the unknown class.
ORDINARY = (
    "I lost my driving licence on the train yesterday and had to pay for a new one.", "The bar lost its license to serve alcohol after the inspection.", "The warranty on the phone is void if it gets wet.", "Copyright law is taught in the second year of the course.",
    "She asked for permission to use the kitchen and to copy the recipe.", "The public library is open and free of charge to any person in the town.", "The Apache helicopter landed near the river.", "He studied at MIT and later worked for a software company.",
    "The rights of workers were reserved for a later meeting.", "The committee may modify the terms of the contract without notice.", "Licensed plumbers are hard to find in this city.", "The general public was not allowed to enter the building.", "Fishing requires a license in most states.", "The new version of the software was released in March.",
    "A copy of the file was distributed to all members.", "The artist made a creative contribution to the commons.", "The foundation published a free report about software.", "Redistribution of wealth is a common topic in politics.",
    "The license of the software must be renewed before the end of the year.", "Which license should we use for this project?", "The General Public License is discussed in chapter four of the book.", "Contributors must sign a license agreement before their first change is accepted.", "The terms of the lease are subject to the approval of the owner.",
    "This file contains the names of all licensed drivers in the county.", "The company does not warrant that the service will be free of errors.", "All rights of the tenants were respected by the court.", "Use of this road is governed by local traffic rules.", "The source code of the game was never published.",
    "You may obtain a copy of the report at the front desk.", "The above copyright notice was discussed at the meeting.", "No part of this machine may be opened without the help of a technician.", "The public domain is a legal term that few people understand.", "Anyone is free to use the garden for any purpose between nine and five.",
)
#: Words that make no pair with each other.
STOP = frozenset("a an and any as at be been by for from has have in is it its no not of on or that the their this to was were which will with you".split())
WORD = re.compile(r"[^\W_]+")
LINES = re.compile(r"[^\n]+")
GAP, OWN = 8, 6


def plain(word: str) -> str:
    return re.sub(r"\d", "0", word.lower())


def words(text: str) -> list[str]:
    return [plain(w) for w in WORD.findall(text)]


def grams(found: list[str]) -> set[str]:
    return {" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)}


def pairs(found: list[str]) -> set[tuple[str, str]]:
    """Neighbouring words, but for two of ``STOP``."""
    return {p for p in zip(found, found[1:], strict=False) if p[0] not in STOP or p[1] not in STOP}


class Templates:
    """The templates' word pairs, and where a text has some."""

    def __init__(self) -> None:
        self.pairs = {f: [pairs(words(t)) for t in ts] for f, ts in TEMPLATES.items()}
        every = set().union(*(p for ps in self.pairs.values() for p in ps))
        self.known = {w: i + 1 for i, w in enumerate(sorted({w for p in every for w in p}))}
        self.table = np.zeros((len(self.known) + 1, len(self.known) + 1), bool)
        for x, y in every:
            self.table[self.known[x], self.known[y]] = True
        self.seen: dict[str, int] = {}

    def _number(self, word: str) -> int:
        n = self.seen.get(word)
        if n is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            n = self.seen[word] = self.known.get(plain(word), 0)
        return n

    def paragraphs(self, text: str) -> Iterator[tuple[int, int]]:
        """Starts and ends (code points) of the stretches that may agree with a template."""
        numbers = np.array([self._number(w) for w in WORD.findall(text)], np.int64)
        if len(numbers) < 2 or self.table[numbers[:-1], numbers[1:]].sum() < 2:
            return
        places = [m.span() for m in WORD.finditer(text)]
        hits = np.flatnonzero(self.table[numbers[:-1], numbers[1:]])
        parted = np.array([len(text[places[i][1] : places[j][0]].split("\n")) > 2 and re.search(r"\n[^\w\n]*\n", text[places[i][1] : places[j][0]]) is not None for i, j in zip(hits[:-1], hits[1:], strict=True)], bool)
        cuts = np.flatnonzero((np.diff(hits) > GAP) | parted) + 1
        for group in np.split(hits, cuts):
            if len(group) >= 2:
                a, b = places[group[0]][0], places[group[-1] + 1][1]
                while a and not text[a - 1].isspace():
                    a -= 1
                while b < len(text) and not text[b].isspace():
                    b += 1
                yield a, b

    def agreement(self, own: set[tuple[str, str]], family: str) -> tuple[float, float]:
        """The greatest share of a template's pairs that is in ``own``, and of ``own``'s pairs in a template (0 if there are few)."""
        most = max((len(own & t) / len(t) for t in self.pairs.get(family, ())), default=0.0)
        inside = max((len(own & t) / len(own) for t in self.pairs.get(family, ())), default=0.0) if len(own) >= OWN else 0.0
        return most, inside


class LicenceModel:
    """Weights of n-grams that training met, with classes in ``families`` (the unknown class last)."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, bias: np.ndarray, families: list[str], temperature: float = 1.0) -> None:
        self.index, self.weights, self.bias, self.families, self.temperature = index, weights, bias, families, temperature

    def scores(self, paragraph: str) -> np.ndarray:
        at = [i for g in grams(words(paragraph)) if (i := self.index.get(g)) is not None]
        return (self.weights[at].sum(axis=0) + self.bias) / max(1.0, len(at)) ** 0.5

    def probabilities(self, paragraph: str) -> np.ndarray:
        z = self.scores(paragraph) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def judge(self, paragraph: str, templates: Templates, least: float, agreed: float, whole: bool = False) -> str | None:
        """The family of a paragraph, or none; with ``whole``, only if it holds a template's pairs itself."""
        p = self.probabilities(paragraph)
        family = self.families[int(p.argmax())]
        if family == UNKNOWN or p.max() < least:
            return None
        most, inside = templates.agreement(pairs(words(paragraph)), family)
        return family if most >= agreed or (inside >= agreed and not whole) else None


def findings(text: str, model: LicenceModel, templates: Templates, least: float, agreed: float, known: dict) -> list[tuple[int, int, str]]:
    """``start, end, family`` of a text's licence statements; ``known`` remembers judgements."""

    def judged(a: int, b: int, whole: bool = False) -> str | None:
        key = (text[a:b], whole)
        if key not in known:
            if len(known) > 50_000:
                known.clear()
            known[key] = model.judge(key[0], templates, least, agreed, whole)
        return known[key]

    out: list[tuple[int, int, str]] = []
    for a, b in templates.paragraphs(text):
        lines = [(m.start() + a, m.end() + a) for m in LINES.finditer(text[a:b])]
        alone = [(x, y, f) for x, y in lines if (f := judged(x, y, True))] if len(lines) > 1 else []
        if len({f for *_, f in alone}) < 2:
            alone = [(a, b, f)] if (f := judged(a, b)) else []
        for x, y, f in alone:
            if out and out[-1][2] == f and len(WORD.findall(text[out[-1][1] : x])) <= GAP:
                out[-1] = (out[-1][0], y, f)
            else:
                out.append((x, y, f))
    return out


def variant(r: random.Random, text: str) -> str:
    """A text as it might stand in a file: other years and holders, cut short, wrapped, behind comment marks, in capitals."""
    found = text.split(" ")
    if len(found) > 15 and r.random() < 0.4:
        found = found[: r.randint(len(found) * 2 // 3, len(found))]
    out = re.sub(r"\b(19|20)\d\d\b", lambda _: str(r.randint(1985, 2030)), " ".join(found)).replace("The Company", " ".join(r.choice(("Acme", "North", "Ltd", "Example", "Group", "Jane", "Doe")) for _ in range(r.randint(1, 3))))
    mark = r.choice(("", "", "# ", "// ", " * ", "-- "))
    if r.random() < 0.5:
        parts, width = out.split(" "), r.randint(6, 14)
        out = f"\n{mark}".join(" ".join(parts[i : i + width]) for i in range(0, len(parts), width))
    return mark + r.choice((out, out, out.upper(), out.rstrip(".")))


def fit(samples: list[tuple[str, str]], temperature: float = 1.0, steps: int = 200, rate: float = 0.3, decay: float = 1e-5) -> LicenceModel:
    """Multinomial logistic regression by Adagrad; classes weigh the same."""
    families = [*sorted(TEMPLATES), UNKNOWN]
    index = {g: i for i, g in enumerate(sorted({g for t, _ in samples for g in grams(words(t))}))}
    model = LicenceModel(index, np.zeros((len(index), len(families))), np.zeros(len(families)), families, temperature)
    bags = [np.array([index[g] for g in grams(words(t))], np.int64) for t, _ in samples]
    rows, flat = np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.concatenate(bags)
    norm = np.maximum(1.0, np.bincount(rows, minlength=len(bags))) ** 0.5
    y = np.eye(len(families))[[families.index(f) for _, f in samples]]
    weight = 1 / y.sum(axis=0)[y.argmax(axis=1)]
    weight /= weight.sum()
    gw, gb = np.full_like(model.weights, 1e-8), np.full_like(model.bias, 1e-8)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    some = rows[starts]
    order = np.argsort(flat, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
    for _ in range(steps):
        z = np.tile(model.bias, (len(bags), 1))
        z[some] += np.add.reduceat(model.weights[flat], starts, axis=0)
        z /= norm[:, None]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = (e / e.sum(axis=1, keepdims=True) - y) * (weight / norm)[:, None]
        dw = np.add.reduceat(d[rows[order]], heads, axis=0) + decay * model.weights
        gw += dw**2
        gb += d.sum(axis=0) ** 2
        model.weights -= rate * dw / np.sqrt(gw)
        model.bias -= rate * d.sum(axis=0) / np.sqrt(gb)
    return model


def calibrated(samples: list[tuple[str, str]], held_out: list[tuple[str, str]]) -> float:
    """The temperature at which a model of ``samples`` gives ``held_out`` the highest likelihood, classes weighing the same."""
    model = fit(samples)
    sizes = Counter(f for _, f in held_out)
    scored = [(model.scores(t), model.families.index(f), 1 / sizes[f]) for t, f in held_out]

    def loss(temperature: float) -> float:
        out = 0.0
        for z, k, w in scored:
            z = z / temperature
            out -= w * (z[k] - z.max() - np.log(np.exp(z - z.max()).sum()))
        return out

    return min((2.0 ** (i / 2) for i in range(-10, 9)), key=loss) if held_out else 1.0


def train(docs: DataFrame, sample_docs: int = 300, variants: int = 20, seed: int = 1) -> LicenceModel:
    """A model from template variants, ordinary sentences and paragraphs of at most ``sample_docs`` documents, whole ones, drawn by a hash."""
    templates = Templates()

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for _, text in source:
            for a, b in templates.paragraphs(text):
                own = pairs(words(text[a:b]))
                if max(max(templates.agreement(own, f)) for f in TEMPLATES) < 0.5:
                    yield (text[a:b],)

    near = mapped(sample(id_text(docs), sample_docs), rows, "paragraph string").distinct().orderBy("paragraph").limit(10 * sample_docs)
    r = random.Random(seed)
    known, held = [], []
    for family, texts in TEMPLATES.items():
        for i, t in enumerate(texts):
            (held if len(texts) > 2 and i == len(texts) - 2 else known).extend((variant(r, t), family) for _ in range(variants))
    for i, t in enumerate(ORDINARY):
        (known if i % 3 else held).extend((variant(r, t), UNKNOWN) for _ in range(variants // 2))
    for i, x in enumerate(near.collect()):  # ten paragraphs a sampled document at most
        (known if i % 3 else held).append((x["paragraph"], UNKNOWN))
    return fit([*known, *held], calibrated(known, held))


def scan(docs: DataFrame, model: LicenceModel, least: float = 0.5, agreed: float = 0.6) -> DataFrame:
    """``doc_id, n_found, families, spans`` for each row: the families found, and ``family:start:end`` by start (code points, end exclusive)."""

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        templates, known = Templates(), {}
        for doc_id, text in source:
            found = findings(text, model, templates, least, agreed, known)
            yield doc_id, len(found), ",".join(sorted({f for *_, f in found})), ",".join(f"{f}:{a}:{b}" for a, b, f in found)

    return mapped(id_text(docs), rows, "doc_id long, n_found long, families string, spans string")
