"""The rules, their priority and the suppression of contained detections, against brute force on lists of intervals."""

import random

import pytest
import regex

from quadrille.llm import licenses

TEXTS = {
    "Licensed under the GPLv2": "gpl-2",
    "License: LGPLv2.1+": "lgpl-2",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2,mit",
    "SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause) OR ISC": "bsd-3,gpl-2,isc",
    "MIT license and the Apache License 2.0": "apache-2,mit",
    "a commercial license is not needed": "",
    "sie kamen mit lizenzen": "",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "bsd-0",
    "distributed under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "gpl-2",
    "under the GNU Lesser General Public License v3": "lgpl-3",
    "GNU General Public License and GNU Affero General Public License, version 3": "agpl-3,gpl",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "no word of it": "",
}


def brute(text):
    """Labels and best priority by all matches and all pairs of them."""
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    norm, found = f" {' '.join(words)} ", []
    for number, (priority, label, keyword, pattern) in enumerate(licenses.rules()):
        if f" {keyword}" in norm:
            found += [(m.start(), m.end(), priority, number, label) for m in regex.finditer(pattern, norm)]

    def covered(a):
        return any(b[0] <= a[0] and b[1] >= a[1] and (b[2], b[0] - b[1], b[3]) < (a[2], a[0] - a[1], a[3]) for b in found if b != a)

    kept = [a for a in found if not covered(a)]
    return {a[4] for a in kept}, min((a[2] for a in kept), default=None)


@pytest.fixture(scope="module")
def texts():
    random.seed(7)
    parts = [*TEXTS, "released under the MIT License", "Apache License, Version 2.0", "CC BY-NC 4.0", "lorem ipsum dolor", "und", "gnu gpl", "the BSD 3-clause license", "either version 3 of the License"]
    made = [random.choice([" ", ". ", " or ", " and ", "\n"]).join(random.choices(parts, k=random.randint(1, 6))) for _ in range(150)]
    return [*TEXTS, *made, None, "", " ".join(["released under the mit license", "gplv3"] * 100)]


def test_against_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in licenses.scan(df, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        labels, best = brute(t)
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert got[i]["labels"] == ",".join(sorted(labels | base)), t
        assert got[i]["score"] == (1.0 if base else licenses.CONFIDENCE[best - 1] if best else 0.0)
        if t in TEXTS:
            assert got[i]["labels"] == TEXTS[t]


def test_priority_decides(spark):
    """The same interval by two rules: the smaller priority, then the earlier rule; a longer one of lower priority suppresses nothing."""
    def labels(source):
        df = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
        return licenses.scan(df, ["doc_id"], source).first()["labels"]

    assert labels("2 | low | two | two three\n1 | high | two | two three") == "high"
    assert labels("2 | first | two | two three\n2 | second | two | two three") == "first"
    assert labels("1 | inner | two | two\n3 | outer | one | one two three") == "inner,outer"
    assert labels("3 | inner | two | two\n1 | outer | one | one two three") == "outer"
    assert labels("1 | left | one | one two\n2 | right | two | two three") == "left,right"  # overlap only
    assert labels("1 | unseen | five | two three\n4 | seen | one | two three") == "seen"  # the keyword decides


def test_rules_are_well_formed():
    made = licenses.rules()
    assert len(made) > 200 and {p for p, *_ in made} == {1, 2, 3, 4}
    assert all(r[1] and r[2] and regex.compile(r[3]) for r in made)
