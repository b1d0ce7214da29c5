"""Licence notices as they stand in files, near-misses, the classifier against plain sums, and calibration."""

import math
import random

import pytest

from segue.llm import common, license_scan as L

NOTICES = [("lgpl","""  This library is free software; you can redistribute it and/or
  modify it under the terms of the GNU Lesser General Public
  License as published by the Free Software Foundation; either
  version 2.1 of the License, or (at your option) any later version.

  This library is distributed in the hope that it will be useful,
  but WITHOUT ANY WARRANTY; without even the implied warranty of
  MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""),("gpl","""# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <http://www.gnu.org/licenses/>."""),
("agpl","""// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU Affero General Public License as
// published by the Free Software Foundation, either version 3 of the
// License, or (at your option) any later version."""),
("apache","""/*
 * Copyright 2015 Example Inc.
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 */"""),
("boost","""//          Copyright Joe Coder 2004 - 2006.
// Distributed under the Boost Software License, Version 1.0.
//    (See accompanying file LICENSE_1_0.txt or copy at
//          https://www.boost.org/LICENSE_1_0.txt)"""),
("zlib","""  This software is provided 'as-is', without any express or implied
  warranty.  In no event will the authors be held liable for any damages
  arising from the use of this software."""),
("mit","""Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""),
("bsd","""Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:
1. Redistributions of source code must retain the above copyright"""),
("bsd","""THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""),
("epl","""This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""),
("cc0","To the extent possible under law, Jane Doe has waived\nall copyright and related or neighboring rights to this work."),
("cc-by-sa","Permission is granted to copy this document under the terms of the\nCreative Commons Attribution-ShareAlike 3.0 Unported License."),
("isc","""Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
("mpl","""/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""),
("unlicense","This is free and unencumbered software released into the public domain."),
("","The general public license of the shop to sell goods was renewed, and a copy of it hangs at the door."),
("","You may not use this file cabinet except on weekdays, in compliance with the house rules of the library."),
("","Permission is hereby given to the pupils of the school to leave early on Friday, provided that a parent agrees."),
("","We compared the MIT License and the Apache License in our survey of one hundred projects."),
("","All rights in the estate were passed to the eldest son, and the house was sold."),
("apache,mit","Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
]


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_wrapped_notices_and_near_misses(model):
    templates, right, found, wanted = L.Templates(), 0, 0, 0
    for want, text in NOTICES:
        got = {f for *_, f in L.findings(text, model, templates, 0.5, 0.6, {})}
        want = set(filter(None, want.split(",")))
        right, found, wanted = right + len(got & want), found + len(got), wanted + len(want)
    assert right >= 0.9 * wanted and right >= 0.9 * found


def test_one_finding_per_notice(model):
    text = NOTICES[0][1]
    (a, b, family), = L.findings(text, model, L.Templates(), 0.5, 0.6, {})
    assert family == "lgpl" and text[a:b].startswith("This library") and "any later version." in text[a:b]
    lines = "Released under the MIT License.\n\n" * 3
    assert len(L.findings(lines, model, L.Templates(), 0.5, 0.6, {})) == 1


def test_probabilities_are_plain_sums(model):
    for _, text in NOTICES[:6]:
        found = L.words(text)
        known = [model.index[g] for g in {" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)} if g in model.index]
        z = [(sum(float(model.weights[g, k]) for g in known) + float(model.bias[k])) / math.sqrt(max(1, len(known))) / model.temperature for k in range(len(model.families))]
        e = [math.exp(x - max(z)) for x in z]
        assert all(abs(x / sum(e) - y) < 1e-9 for x, y in zip(e, model.probabilities(text), strict=True))


def test_nothing_that_could_be_confirmed_is_passed_over(model):
    """Every paragraph that a template confirms is among those that are classified."""
    templates, r = L.Templates(), random.Random(4)
    filler = [f"zq{i}" for i in range(50)]
    for family, texts in L.TEMPLATES.items():
        for t in texts:
            text = " ".join(r.choice(filler) for _ in range(40)) + " " + t + " " + " ".join(r.choice(filler) for _ in range(40))
            assert any(max(templates.agreement(L.pairs(L.words(text[a:b])), family)) >= 0.6 for a, b in templates.paragraphs(text)), t


def test_calibration(model):
    """On variants that training did not see, what is given a probability of one half or more is right nearly always, and half of it is not sure."""
    r = random.Random(99)
    held = [(L.variant(r, t), f) for f, ts in L.TEMPLATES.items() for t in ts for _ in range(5)]
    sure = [(model.probabilities(t), f) for t, f in held]
    assert 0.2 < model.temperature < 16
    right = [model.families[int(p.argmax())] == f for p, f in sure if p.max() >= 0.5]
    assert len(right) > 0.5 * len(held) and sum(right) >= 0.95 * len(right)


def test_repeated_rows_ties_and_long_texts(spark, model):
    notice = "Licensed under CC BY 4.0."
    docs = [(1, notice), (1, notice), (2, None), (3, ""), (None, notice), (4, "word " * 30_000 + notice + " end" * 20_000)]
    got = [tuple(x) for x in L.scan(spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n_found int"), model).collect()]
    assert len(got) == 6 and sum(x[2] == "cc-by" for x in got) == 4 and got.count((1, 1, "cc-by", "cc-by:0:25")) == 2


def test_samples_never_empty(spark):
    assert common.hash_bound(300, 1000) is None
    for n in (4 * 10**8, 3 * 10**9, 10**13):
        share = (common.hash_bound(300, n) + 2**63) / 2**64
        assert 1199 < share * n < 1201
    docs = spark.createDataFrame([(None, "same")] * 50 + [(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    assert common.sample(docs, 5).count() == 5 and common.sample(docs, 500).count() == 100
    assert {tuple(x) for x in common.sample(docs, 60).collect()} == {tuple(x) for x in common.sample(docs.repartition(7), 60).collect()}


def test_no_shared_folder_on_a_cluster_is_told(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://x:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Session)
    assert "segue-" in common.scratch_dir(spark)
