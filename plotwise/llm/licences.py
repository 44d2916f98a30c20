"""Operator 8: licence scans.

Two kinds of text are compared, as sparse TF-IDF vectors, by cosine: lines with header templates (the short forms in which
licences are named and granted), and whole texts, of any length, with the texts of the licences themselves, which lie in
``licence_texts``, and with the headers.  A line that gives an SPDX identifier is compared by what follows it with the
identifiers alone.  Document frequencies of the templates' words are counted over all documents; a word in no template
weighs as one that occurs once.  A line needs one of the words that make up most of a header's weight: without them it
cannot reach the threshold, so that most lines are passed over unread and none is lost.

A file without a licence of its own inherits from the nearest directory above it, the root included, that holds a
licence file: a text that is a licence as a whole, or one named like a licence file that has a header.  The distinct
directories are joined with their ancestors, and the files with their directory.

Defined cases: null and empty texts have no licence of their own and inherit; ties go to the template listed first;
several licence files in a directory give its most frequent licence, ties the first by name; repeated rows each get
their row; a null path has no directory, and inherits nothing; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, table

HEADER, WHOLE = 0.6, 0.6
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
# Short forms in which public licences are named and granted.
HEADERS = (
    ("MIT", "Released under the MIT License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted, BSD 3-Clause License"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "zlib License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
)
# SPDX identifiers that stand for themselves.
IDENTIFIERS = (
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MPL-2.0", "EPL-2.0", "Unlicense",
    "Zlib", "BSL-1.0", "Artistic-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
_SPDX = re.compile(r"spdx-license-identifier\s*:?\s*([^\n]*)")
_WORD = re.compile(r"\w+")


@lru_cache(1)
def licence_texts() -> tuple[tuple[str, str], ...]:
    """(name, text) of the licences that come with this package, by name."""
    found = (f for f in files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt"))
    return tuple(sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in found))


def terms(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def document_frequencies(docs: DataFrame, words: Iterable[str]) -> dict[str, int]:
    """Over all documents; the result has a row for each word of the templates and one for the number of documents."""
    wanted = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(wanted.intersection(_WORD.findall((text or "").lower())))
                found[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    counts = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in counts.collect()}  # a row a word of the templates


class Templates:
    """Unit vectors of some templates, as rows of words, and the words without which none reaches a threshold."""

    def __init__(self, named: Iterable[tuple[str, str]], weight: dict[str, float], rare: float):
        self.names = [name for name, _ in named]
        counts = [terms(text) for _, text in named]
        self.row = {w: k for k, w in enumerate(sorted({w for c in counts for w in c}))}
        self.weight, self.rare = weight, rare
        self.unit = np.zeros((len(self.row), len(counts)))
        for k, c in enumerate(counts):
            for w, n in c.items():
                self.unit[self.row[w], k] = n * weight[w]
        self.unit /= np.linalg.norm(self.unit, axis=0)

    def needed(self, threshold: float) -> set[str]:
        words, out = list(self.row), set()
        for column in self.unit.T:
            rest = 1.0
            for k in np.argsort(-column, kind="stable"):
                if rest < threshold * threshold - 1e-9:
                    break
                out.add(words[k])
                rest -= column[k] ** 2
        return out

    def best(self, counts: Counter) -> tuple[str | None, float]:
        """The template of the highest cosine, the first of equal ones."""
        known, values, square = [], [], 0.0
        for w, n in counts.items():
            x = n * self.weight.get(w, self.rare)
            square += x * x
            if (k := self.row.get(w)) is not None:
                known.append(k)
                values.append(x)
        if not known:
            return None, 0.0
        cosine = np.round(np.array(values) @ self.unit[known] / math.sqrt(square), 9)
        at = int(cosine.argmax())
        return self.names[at], float(cosine[at])


class Matcher:
    def __init__(self, frequencies: dict[str, int], headers=HEADERS, texts=None, identifiers=IDENTIFIERS):
        texts = licence_texts() if texts is None else texts
        total = frequencies.get("", 0)
        rare = math.log((1 + total) / 2) + 1
        weight = {w: math.log((1 + total) / (1 + frequencies.get(w, 0))) + 1 for w in template_words(headers, texts, identifiers)}
        self.headers = Templates(headers, weight, rare)
        self.texts = Templates([*texts, *headers], weight, rare)
        self.identifiers = Templates([(x, x) for x in identifiers], weight, rare)
        words = sorted(self.headers.needed(HEADER) | {"spdx"})
        self.needed = re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b")

    def line(self, line: str) -> tuple[str | None, float]:
        """The licence that a lower-cased line names, and its cosine."""
        if found := _SPDX.search(line):
            return self.identifiers.best(terms(found[1]))
        return self.headers.best(terms(line))

    def scan(self, text: str | None) -> tuple[str | None, float, int, str | None]:
        """Licence of the best header, its cosine, the number of headers, and the licence of the text as a whole."""
        lowered = (text or "").lower()
        own, score, headers, last = None, 0.0, 0, -1
        for m in self.needed.finditer(lowered):
            if m.start() < last:
                continue
            start = lowered.rfind("\n", 0, m.start()) + 1
            last = end if (end := lowered.find("\n", m.start())) >= 0 else len(lowered)
            name, cosine = self.line(lowered[start:last])
            if name and cosine >= HEADER:
                headers += 1
                if cosine > score:
                    own, score = name, cosine
        whole, cosine = self.texts.best(terms(lowered))
        return own, round(score, 6), headers, whole if cosine >= WHOLE else None


def template_words(headers=HEADERS, texts=None, identifiers=IDENTIFIERS) -> set[str]:
    texts = licence_texts() if texts is None else texts
    return {w for t in [*(t for _, t in [*headers, *texts]), *identifiers] for w in terms(t)}


def scan_files(documents: DataFrame) -> DataFrame:
    """From (doc_id, path, text): doc_id, path, own, score, n_headers, licence, inherited_from."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(Matcher(document_frequencies(documents, template_words())))  # the templates: bounded

    def row(doc_id, path, text):
        return doc_id, path, *shared.value.scan(text)

    scanned = arrow_map(documents.select("doc_id", "path", "text"), "doc_id long, path string, own string, score double, n_headers long, whole string", row)
    name = F.element_at(F.split("path", "/"), -1)
    named = F.when(name.rlike(FILE_NAME), F.col("own"))
    scanned = cut(scanned.withColumns({"folder": F.regexp_replace("path", "/?[^/]*$", ""), "licence_of_file": F.coalesce("whole", named)}))
    return inherited(scanned)


def inherited(scanned: DataFrame) -> DataFrame:
    """Gives files without a licence that of the nearest directory with a licence file; the root is the empty path."""
    held = scanned.where("licence_of_file is not null and folder is not null").groupBy("folder", "licence_of_file").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("folder").agg(F.min_by("licence_of_file", F.struct(-F.col("n"), F.col("licence_of_file"))).alias("inherited"))
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    reach = (
        scanned.select("folder").where("folder is not null").distinct()
        .select(F.col("folder").alias("start"), F.explode(F.array_distinct(above)).alias("folder"))
        .join(held, "folder")
        .groupBy("start")
        .agg(F.max_by(F.struct("inherited", F.col("folder").alias("inherited_from")), F.length("folder")).alias("found"))
        .select(F.concat("start", F.lit("")).alias("folder"), "found.inherited", "found.inherited_from")
    )
    out = scanned.join(reach, "folder", "left")
    own = F.coalesce("own", "whole")
    return out.select("doc_id", "path", "own", "score", "n_headers", F.coalesce(own, "inherited").alias("licence"), F.when(own.isNull(), F.col("inherited_from")).alias("inherited_from"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = F.floor(F.col("doc_id") / 1000).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_files(docs.select("doc_id", path.alias("path"), "text"))
