"""Licence recognition on genuine wording: headers, hard-wrapped blocks and full texts."""

import os
import textwrap

import pytest

from tracemill.llm import licenses

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS."""
ASF = """The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

   http://www.apache.org/licenses/LICENSE-2.0"""
MIT = """MIT License

Copyright (c) 2024 A. Person

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
BSD2 = """Copyright (c) 2020, Some Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = (
    BSD2
    + """
3. Neither the name of Example Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"."""
)
_FREE = """This {what} is free software{sign} you can redistribute it and/or modify
it under the terms of the GNU {kind} as published by
the Free Software Foundation{comma} either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful."""
GPL3 = _FREE.format(what="program", sign=":", kind="General Public License", comma=",", version=3)
GPL2 = _FREE.format(what="program", sign=";", kind="General Public License", comma=";", version=2)
LGPL3 = _FREE.format(what="library", sign=":", kind="Lesser General Public License", comma=",", version=3)
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
CC0 = """To the extent possible under law, Jane Q. Person has waived all copyright and related or neighboring rights to Some Work."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."""
CASES = {
    "Apache-2.0": (APACHE, ASF, " ".join(APACHE.split()), "Licensed under the Apache License, Version 2.0."),
    "MIT": (MIT, "This project is licensed under the MIT License."),
    "BSD-2-Clause": (BSD2,),
    "BSD-3-Clause": (BSD3,),
    "GPL-3.0": (GPL3, "This work is licensed under the GNU General Public License, version 3."),
    "GPL-2.0": (GPL2,),
    "LGPL-3.0": (LGPL3,),
    "GPL-unversioned": ("This program is free software; you can redistribute it and/or modify it\nunder the terms of the GNU General Public License.",),
    "MPL-2.0": (MPL,),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0\nInternational License.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.",),
    "CC0-1.0": (CC0,),
    "Unlicense": (UNLICENSE,),
    "proprietary": ("Copyright (c) 2020 Example Corp. All rights reserved.", "Copyright 2020 Example All Rights Reserved"),
}


def found_in(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.licenses for r in licenses.recognise(docs).collect()}
    return [found.get(i) for i in range(len(texts))]


def test_genuine_wording_in_any_wrapping(spark):
    cases, wanted = [], []
    for name, texts in CASES.items():
        for t in texts:
            commented = "\n".join(" * " + line for line in t.split("\n"))
            narrow = "\n\n".join(textwrap.fill(p, 43) for p in t.split("\n\n"))
            for shape in (t, commented, narrow, "# " + narrow.replace("\n", "\n# "), t.replace("\n", "\r\n"), "Some words before.\n\n" + t + "\n\nAnd some after."):
                cases.append(shape)
                wanted.append(name)
    found = found_in(spark, cases)
    assert [(w, f, c) for w, f, c in zip(wanted, found, cases) if w != f] == []


def test_every_rule_has_a_case():
    assert {name for name, _ in licenses.RULES} <= set(CASES)


def test_unlike_texts_have_no_licence(spark):
    near = ["Permission is hereby granted to park here.", "we may not use this file except in compliance with the license", "Neither the name of the firm nor the names of its owners may be told.", "It is free software.", "x " * 5000, None, "", "|", "1. a|b"]
    assert found_in(spark, near) == [None] * len(near)


def test_punctuation_can_not_hide_a_sentence(spark):
    assert found_in(spark, ["All" + " ." * 500 + " rights reserved.", "*" * 5000 + " All rights reserved."]) == ["proprietary"] * 2


@pytest.mark.parametrize("file, name", [("Apache-2.0", "Apache-2.0"), ("BSD", "BSD-3-Clause"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-3", "LGPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_full_texts(spark, file, name):
    path = f"/usr/share/common-licenses/{file}"
    if not os.path.exists(path):
        pytest.skip("no full texts on this machine")
    assert name in found_in(spark, [open(path).read()])[0].split(",")


@pytest.mark.parametrize("copies", [2, 3, 7])
def test_a_licence_that_is_repeated(spark, copies):
    cases = [(name, between.join([text] * copies)) for name, texts in CASES.items() for text in texts for between in ("\n", "\n\n", "\n\nSome words.\n\n")]
    found = found_in(spark, [text for _, text in cases])
    assert [(w, f) for (w, _), f in zip(cases, found) if w != f] == []


def test_two_licences_side_by_side(spark):
    pairs = [(a, b) for a in ("MIT", "BSD-3-Clause", "GPL-2.0", "Unlicense") for b in ("MPL-2.0", "BSD-2-Clause", "CC0-1.0")]
    found = found_in(spark, [CASES[a][0] + "\n" + CASES[b][0] + "\n" + CASES[a][0] for a, b in pairs])
    assert [set(f.split(",")) for f in found] == [{a, b} for a, b in pairs]


def test_a_match_is_no_bridge(spark):
    """b is taken by the first rule; what stood on both sides of it isn't a sequence."""
    docs = spark.createDataFrame([(0, "one\ntwo\nthree"), (1, "one\nthree")], "doc_id long, text string")
    found = licenses.recognise(docs, {"a": "one", "b": "two", "c": "three"}, (("B", ("b",)), ("AC", ("a", "c"))))
    assert sorted((r.doc_id, r.licenses) for r in found.collect()) == [(0, "B"), (1, "AC")]
