"""Licence scans: cosines by brute force, whole licence texts, headers, and directories."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from plotwise.llm import licences

SCHEMA = "doc_id long, path string, text string"
TEXTS = dict(licences.licence_texts())
FREQUENCIES = {"": 1000, "the": 700, "of": 650, "and": 600, "license": 20, "public": 90, "general": 70}


def brute(text, named):
    """(name, cosine) of the best of the templates, every word by itself."""
    known = licences.template_words()
    idf = lambda w: math.log(1001 / (1 + FREQUENCIES.get(w, 0))) + 1 if w in known else math.log(1001 / 2) + 1
    vector = lambda t: {w: n * idf(w) for w, n in Counter(re.findall(r"\w+", t.lower())).items()}
    a, best = vector(text), (None, 0.0)
    for name, template in named:
        b = vector(template)
        dot = sum(x * b.get(w, 0) for w, x in a.items())
        cosine = round(dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 9) if dot else 0.0
        if cosine > best[1]:
            best = name, cosine
    return best


def test_cosines_are_those_of_brute_force():
    rng = random.Random(2)
    matcher = licences.Matcher(FREQUENCIES)
    pool = sorted(licences.template_words())[::7] + [f"w{k}" for k in range(60)]
    lines = [t for _, t in licences.HEADERS] + [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    lines += [" ".join(rng.sample(t.split(), max(1, len(t.split()) * 3 // 4)) + rng.sample(pool, rng.randint(0, 5))) for _, t in licences.HEADERS * 6]
    lines = [x for x in lines if "spdx" not in x.lower()]
    for line in lines:
        name, cosine = brute(line, licences.HEADERS)
        assert matcher.headers.best(licences.terms(line)) == (name, cosine)
        own, _, headers, whole = matcher.scan(line)
        assert (own, headers) == ((name, 1) if cosine >= licences.HEADER else (None, 0))  # the words passed over lose nothing
        name, cosine = brute(line, [*TEXTS.items(), *licences.HEADERS])
        assert whole == (name if cosine >= licences.WHOLE else None)


def test_whole_licence_texts():
    """Each text is found with another owner, other line breaks, capitals and words before and after it."""
    matcher = licences.Matcher(FREQUENCIES)
    for name, text in TEXTS.items():
        changed = "Copyright (c) 2031 Jane Doe\n" + re.sub(r"\s+", " ", text).upper() + "\nThat is all."
        assert matcher.scan(text)[3] == matcher.scan(changed)[3] == name
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    assert matcher.scan(mit + ' (the "Software"), to deal in the Software without restriction')[0] == "MIT"
    assert matcher.scan("it under the terms of the GNU General Public License as published by")[0] == "GPL"
    assert matcher.scan("// SPDX-License-Identifier: Apache-2.0")[0] == "Apache-2.0" and matcher.scan("# SPDX-License-Identifier: GPL-2.0-only")[0] == "GPL-2.0"
    assert matcher.scan("SPDX-License-Identifier: LicenseRef-Mine")[0] is None
    for text in ("We were granted leave to use the software of the library under no condition.", "the general public and the license of a dog", "", None, "word " * 200_000):
        assert matcher.scan(text)[0] is None and matcher.scan(text)[3] is None


def test_long_texts_are_licence_files():
    """However many distinct words a text has, its cosine as a whole decides."""
    matcher = licences.Matcher(FREQUENCIES)
    assert matcher.scan(TEXTS["GPL-3.0"] + "\n".join(f"word{k}" for k in range(400)))[3] == "GPL-3.0"
    assert matcher.scan("Licensed under the Apache License, Version 2.0\n" + "\n".join(f"word{k}" for k in range(400)))[3] is None


def test_directories(spark):
    files = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0"), (2, "a/b/c/x.py", "code"), (3, "a/b/y.py", "# Released under the MIT License\nmore"), (4, "z/q.py", None), (5, None, ""),
        (6, "a/b/c/x.py", "code"), (7, "a/b/COPYING", "x\nThis work is licensed under the GNU General Public License, version 3.\n" + "word " * 900), (8, "p/doc.txt", TEXTS["MIT"]), (9, "p/q/r.py", ""), (10, "a", "no folder"),
    ]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).withColumns({"folder": F.lit("clash"), "whole": F.lit(1), "n": F.lit(2), "start": F.lit(3)})
    got = {r.doc_id: (r.own, r.licence, r.inherited_from) for r in licences.scan_files(frame(files)).collect()}
    assert got == {
        1: ("Apache-2.0", "Apache-2.0", None), 2: (None, "GPL-3.0", "a/b"), 3: ("MIT", "MIT", None), 4: (None, None, None), 5: (None, None, None), 6: (None, "GPL-3.0", "a/b"),
        7: ("GPL-3.0", "GPL-3.0", None), 8: ("MIT", "MIT", None), 9: (None, "MIT", "p"), 10: (None, None, None),
    }
    root = [(1, "LICENSE", TEXTS["ISC"]), (2, "src/a.py", "x"), (3, "b.py", "y"), (4, "/abs/c.py", "z"), (5, None, "w")]
    assert {r.doc_id: (r.licence, r.inherited_from) for r in licences.scan_files(frame(root)).collect()} == {1: ("ISC", None), 2: ("ISC", ""), 3: ("ISC", ""), 4: ("ISC", ""), 5: (None, None)}


def test_ties(spark):
    several = [(1, "d/a.txt", TEXTS["MIT"]), (2, "d/b.txt", TEXTS["ISC"]), (3, "d/x.py", ""), (4, "e/a.txt", TEXTS["MIT"]), (5, "e/b.txt", TEXTS["ISC"]), (6, "e/c.txt", TEXTS["MIT"]), (7, "e/x.py", "")]
    got = {r.doc_id: r.licence for r in licences.scan_files(spark.createDataFrame(several, SCHEMA)).collect()}
    assert got[3] == "ISC" and got[7] == "MIT"
