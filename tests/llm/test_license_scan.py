"""Notices as they are laid out in files, several at once, and in long lines."""

import random
import textwrap

import pyarrow as pa
import pytest

from cairnfold.llm import license_scan
from cairnfold.llm.license_scan import TEMPLATES

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def found(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    out = [set() for _ in texts]
    for rows in license_scan._scanned(iter([batch])):
        for r in rows.to_pylist():
            assert texts[r["id"]][r["start"] : r["start"] + r["length"]] == r["notice"] and r["confirmed"] == (r["license"] is not None)
            out[r["id"]].add(r["license"])
    return out


@pytest.mark.parametrize("sign", ["", "# ", " * ", "    "])
@pytest.mark.parametrize("width", [60, 72, 76, 79])
def test_wrapped_notices(width, sign):
    before = ["", "Some words that stand before it. ", "Some words that stand before it and more. "]
    texts = [textwrap.fill(b + t, width, initial_indent=sign, subsequent_indent=sign) for _, t in TEMPLATES for b in before]
    assert found(["int a;\n\n" + t + "\n\nint b;\n" for t in texts]) == [{n} for n, _ in TEMPLATES for _ in before]


def test_standard_layout():
    assert "MIT" in found([MIT])[0]


def test_several_notices():
    bsd = "Released under the BSD 3-Clause License."
    texts = ["Licensed under the MIT license.\n" + bsd, "All rights reserved.\n" + bsd, "x " * 900 + "Licensed under the MIT license. All rights reserved. " + bsd + " x" * 900]
    assert found(texts) == [{"MIT", "BSD-3-Clause"}, {"proprietary", "BSD-3-Clause"}, {"MIT", "proprietary", "BSD-3-Clause"}]
    pairs = [(a, b) for a in TEMPLATES for b in TEMPLATES]
    assert found([f"{a[1]}\n{b[1]}" for a, b in pairs]) == [{a[0], b[0]} for a, b in pairs]


def test_short_notices_in_long_lines():
    rng = random.Random(3)
    prose = " ".join(t for n, t in TEMPLATES if len(t) > 200)
    vocab = sorted({w for w in license_scan.words(prose)} - {"all", "rights", "reserved"})
    texts = []
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(1200)]
        texts.append(" ".join(w[:600] + ["All rights reserved."] + w[600:]))
    assert all("proprietary" in x for x in found(texts))


GNU = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version.\n"


@pytest.mark.parametrize(
    "text, names",
    [
        (GNU.format("", "3"), {"GPL-3.0-or-later"}),
        (GNU.format("Lesser ", "3"), {"LGPL-3.0-or-later"}),
        (GNU.format("Lesser ", "3").replace("program", "library"), {"LGPL-3.0-or-later"}),
        (GNU.format("Affero ", "3"), {"AGPL-3.0-or-later"}),
        (GNU.format("Lesser ", "2.1").replace("program", "library"), {"LGPL-2.1-or-later"}),
        (GNU.format("Library ", "2").replace("program", "library"), {"LGPL-2.0-or-later"}),
        (GNU.format("", "3").replace("program", "library"), {"GPL-3.0-or-later"}),
        (GNU.format("", "2").replace("software:", "software;"), {"GPL-2.0-or-later"}),
        (GNU.format("", "4"), {None}),
        ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
        ("This work is licensed under the GNU General Public License, version 3, or any later version.", {"GPL-3.0-or-later"}),
        ("This work is licensed under the GNU General Public License, version 3 or (at your option) any later version.", {"GPL-3.0-or-later"}),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"CC-BY-4.0"}),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", {"CC-BY-NC-SA-4.0"}),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", {"CC-BY-NC-ND-4.0"}),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.", {None}),
        ("Licensed under CC BY 3.0.", {None}),
        ("Released under the BSD 4-Clause License.", {None}),
        ("Released under the MIT-0 License.", {None}),
        ("Licensed under the Apache License, Version 1.1.", {None}),
        ("Licensed under the MIT license\nand under the Apache License, Version 2.0", {"MIT", None}),
        ("Licensed under the MIT license.\nLicensed under the Apache License, Version 2.0.", {"MIT", "Apache-2.0"}),
        ("SPDX-License-Identifier: GPL-2.0-only", {None}),
    ],
)
def test_look_alikes(text, names):
    got = found([text])[0]
    assert got == names or got == names - {None}, got


def test_copyright_years_between_the_words_do_no_harm():
    assert found([MIT.replace("subject to the following conditions:\n\nThe", "subject to the following conditions:\n\nCopyright 2021 Someone Else\n\nThe")])[0] >= {"MIT"}


def test_ties_long_blocks_and_repeats():
    longest = "All rights reserved. " * 2000
    assert found([longest, longest])[0] == {"proprietary"}
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1], pa.int64()), pa.array([longest] * 2)], ["id", "text"])
    rows = [r for b in license_scan._scanned(iter([batch])) for r in b.to_pylist()]
    assert len(rows) == 4000 and len({(r["start"], r["length"]) for r in rows}) == 2000
    across = "x " * 2900 + MIT.replace("\n", " ") + " y" * 4000 + " " + MIT.replace("\n", " ")
    assert found([across])[0] >= {"MIT"}
