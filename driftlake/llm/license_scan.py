"""Operator 7: license scans by TF-IDF cosine and inheritance along paths.

Candidates of a text are its lines, its paragraphs (lines joined up to a blank
one) and the sentences of both; a license file (LICENSE, COPYING, ...) is one as a
whole too. They and the templates - short notices and standard headers for
candidates, full license texts for whole files - are sparse TF-IDF vectors, with
document frequencies of the templates' words counted over all texts (other words
weigh as words of one text). The best cosine of at least `least` names the text's
own license. License files give theirs to their directory, and a file without one
of its own takes that of the nearest directory above it, by a join on path
prefixes.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, release, trim

_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_CC = "This work is licensed under the Creative Commons {name} 4.0 International License."
# Public names of licenses, their usual short notices and standard headers.
HEADERS = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format(what="program", name="Affero General Public License", version="3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Artistic-1.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", _CC.format(name="Attribution")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", _CC.format(name="Attribution-NonCommercial")),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", _CC.format(name="Attribution-NoDerivatives")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", _CC.format(name="Attribution-ShareAlike")),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format(what="program", name="General Public License", version="2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(what="program", name="General Public License", version="3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _GNU.format(what="library", name="Lesser General Public License", version="2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format(what="library", name="Lesser General Public License", version="3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)


def full_texts() -> tuple[tuple[str, str], ...]:
    """Public license texts, by name."""
    return tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt")))


LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"
SENTENCE = re.compile(r"(?<=[.!?])\s+")
TERM = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
RESULT = "license string, similarity double, evidence string"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Matcher:
    """The template that is most like a text."""

    def __init__(self, templates: tuple[tuple[str, str], ...], df: dict[str, int], n: int, least: float):
        self.least, self.names = least, [t[0] for t in templates]
        known = {w for _, text in templates for w in terms(text)}
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in known}
        self.other = math.log((1 + n) / 2) + 1
        self.weights: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, (_, text) in enumerate(templates):
            tf = Counter(terms(text))
            norm = math.sqrt(sum((c * self.idf[w]) ** 2 for w, c in tf.items()))
            for w, c in tf.items():
                self.weights[w].append((k, c * self.idf[w] / norm))
        # a cosine of `least` needs one of these words: all others of a template weigh too little
        self.anchors = self._anchors()

    def _anchors(self) -> frozenset[str]:
        """A set of words such that a text with none of them stays below `least`."""
        own: dict[int, list[tuple[float, str]]] = defaultdict(list)
        for w, pairs in self.weights.items():
            for k, x in pairs:
                own[k].append((x, w))
        out: set[str] = set()
        for pairs in own.values():
            # long words first: short ones occur in many others
            rest = 1.0
            for x, w in sorted(pairs, key=lambda p: (-min(len(p[1]), 6), -p[0], p[1])):
                if rest < (self.least - 1e-6) ** 2:  # by Cauchy and Schwarz
                    break
                rest -= x * x
                out.add(w)
        return frozenset(out)

    def cosine(self, tf: Counter) -> tuple[float, str | None]:
        """Of a text's terms; of equal ones the first template. Below `least` it may be 0, if no anchor is there."""
        if self.anchors.isdisjoint(tf):
            return 0.0, None
        dots: dict[int, float] = defaultdict(float)
        norm = 0.0
        for w, c in tf.items():
            x = c * self.idf.get(w, self.other)
            norm += x * x
            for k, y in self.weights.get(w, ()):
                dots[k] += x * y
        k = max(dots, key=lambda k: (dots[k], -k))
        return dots[k] / math.sqrt(norm), self.names[k]


def candidates(text: str, anchored) -> Iterator[str]:
    """Lines, their sentences, paragraphs and theirs, of lines and paragraphs that have an anchor."""
    held: list[str] = []
    for line in [*text.split("\n"), ""]:
        if line and TERM.search(line.lower()):
            held.append(line)
            continue
        if held and anchored(whole := " ".join(held)):
            for own in held if len(held) == 1 else [*held, whole]:
                if anchored(own):
                    yield own
                    parts = SENTENCE.split(own)
                    if len(parts) > 1:
                        yield from parts
        held = []


class Scanner:
    """Matchers of headers and of whole license files."""

    def __init__(self, headers: Matcher, texts: Matcher):
        self.headers, self.texts, self.words = headers, texts, None

    def anchored(self, text: str) -> bool:
        """Does an anchor occur, as a word or in one?"""
        if self.words is None:
            import ahocorasick

            self.words = ahocorasick.Automaton()
            for w in self.headers.anchors:
                self.words.add_word(w, w)
            self.words.make_automaton()
        return next(self.words.iter(text.lower()), None) is not None

    def __call__(self, text: str, is_file: bool) -> tuple[str | None, float | None, str | None]:
        best: tuple[float, str | None, str | None] = (0.0, None, None)
        if self.anchored(text):
            for part in candidates(text, self.anchored):
                score, name = self.headers.cosine(Counter(terms(part)))
                if name and score > best[0] + 1e-12:
                    best = (score, name, part.strip())
        if is_file:
            score, name = self.texts.cosine(Counter(terms(text)))
            # a file that is a license is told by all of it
            if name and score >= self.texts.least:
                best = (score, name, f"the text of {name}")
        return (best[1], best[0], best[2]) if best[0] >= self.headers.least else (None, None, None)


def document_frequencies(docs: DataFrame, templates, text: str) -> tuple[dict[str, int], int]:
    """How many texts hold each word of the templates (as many rows as those words), and the number of texts.

    A null text counts as empty, repeated rows count each; an empty table gives none and 0.
    """
    known = frozenset(w for _, t in templates for w in terms(t))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        found: Counter = Counter()
        for batch in batches:
            for x in batch["text"]:
                found.update(known.intersection(TERM.findall(x.lower())))
                found[""] += 1
        yield pd.DataFrame(list(found.items()), columns=["term", "n"])
        trim()

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r["term"]: r["n"] for r in rows}
    return df, df.pop("", 0)


def scan(docs: DataFrame, path: str = "path", text: str = "text", headers=HEADERS, texts=None, least: float = 0.75, least_whole: float = 0.85, columns: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those named) with a struct __license: license (null: none), how (header, file, inherited, none), similarity (of an own license), evidence, directory (of the inherited one).

    A null text counts as empty; a null path has no directory, so such rows
    inherit nothing. Where a directory has several license files, the license
    of the one with the smallest name, then the smallest license, holds.
    Repeated rows each get a result; an empty table gives none. Texts are read
    whole.
    """
    texts = full_texts() if texts is None else texts
    df, n = document_frequencies(docs, (*headers, *texts), text)
    kept = docs.sparkSession.sparkContext.broadcast(Scanner(Matcher(headers, df, n, least), Matcher(texts, df, n, least_whole)))

    @F.pandas_udf(RESULT)
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        release()
        for own, files in batches:
            yield pd.DataFrame([kept.value(x, f) for x, f in zip(own, files, strict=True)], columns=["license", "similarity", "evidence"]).astype({"similarity": "float64"})
        trim()

    directory = F.regexp_replace(F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1), "/+$", "")
    base = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    columns = [c for c in (columns or docs.columns) if c != "__license"]
    is_file = F.coalesce(base.rlike(LICENSE_FILE), F.lit(False))
    result = F.struct(match(F.coalesce(F.col(text), F.lit("")), is_file).alias("own"), F.when(F.col(path).isNotNull(), directory).alias("dir"), base.alias("base"), is_file.alias("file"))
    # in one struct of a name that no column has
    hidden = "__scan"
    while hidden in columns:
        hidden += "_"
    own = Scratch(docs.sparkSession, "license").write(docs.withColumn(hidden, result).select(*[F.col(f"`{c}`") for c in columns], hidden))
    mine, where = F.col(f"{hidden}.own.license"), F.col(f"{hidden}.dir")
    given = own.where(F.col(f"{hidden}.file") & mine.isNotNull() & where.isNotNull()).groupBy(where.alias("top")).agg(F.min(F.struct(F.col(f"{hidden}.base"), mine.alias("license"))).alias("f")).select("top", F.col("f.license").alias("given"))
    # every directory once, with the prefixes of its path; the root is above all, so it is no key
    dirs = own.where(mine.isNull() & where.isNotNull()).select(where.alias("d")).distinct()
    names = F.split("d", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(names, 1, k), "/").alias("top")))
    above = dirs.select("d", F.inline(F.filter(prefixes, lambda p: p["top"] != "")))
    nearest = above.join(given.where("top <> ''"), "top").groupBy("d").agg(F.max_by(F.struct("given", "top"), "depth").alias("near"))
    root = given.where("top = ''").agg(F.max(F.struct("given", "top")).alias("root"))  # one row
    found = dirs.join(nearest, "d", "left").crossJoin(F.broadcast(root)).select("d", F.coalesce("near", "root").alias("near"))
    found = found.select(F.struct("d", "near.given", "near.top").alias("__above"))
    both = own.join(found, (where == F.col("__above")["d"]) & mine.isNull(), "left")
    above = F.col("__above")
    how = F.when(mine.isNotNull(), F.when(F.col(f"{hidden}.file"), "file").otherwise("header")).when(above["given"].isNotNull(), "inherited").otherwise("none")
    out = F.struct(F.coalesce(mine, above["given"]).alias("license"), how.alias("how"), F.col(f"{hidden}.own.similarity").alias("similarity"), F.col(f"{hidden}.own.evidence").alias("evidence"), F.when(mine.isNull(), above["top"]).alias("directory"))
    return both.withColumn("__license", out).select(*[F.col(f"`{c}`") for c in columns], "__license")


def license_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **args) -> DataFrame:
    """doc_id, path, license, how, similarity, evidence, directory of every document.

    `documents` has no paths, so ids give them: source/thousands/fifties/id.txt,
    where every fiftieth document is its directory's LICENSE. A null source is
    the directory `none`; a null id has no path.
    """
    file = F.when(F.col(doc_id) % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col(doc_id).cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce(F.col(source), F.lit("none")), F.floor(F.col(doc_id) / 1000).cast("string"), F.floor(F.col(doc_id) / 50).cast("string"), file)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.when(F.col(doc_id).isNotNull(), path).alias("path"), F.col(text).alias("text"))
    return scan(slim, columns=["doc_id", "path"], **args).select("doc_id", "path", "__license.*")
