"""License scan: a positional rare-token index over license notices.

Templates are notices of known licenses, short references, permission texts and machine-readable tags, each with key phrases that a file must contain. Their words form the
index: word -> (template, position). One pass over all documents counts in how many each index word occurs, and gives
its IDF. The second pass looks up each template whose key phrases a document holds: around every place of its first key
phrase, words are intersected by relative position, a place at word p of the document and q of the template voting for the
template starting at word p - q. Of each start the `rare` words with the highest IDF that the template shares with the
notice's span there are looked up; with votes for at least `share` of their IDF mass the start is a candidate, and is a
finding if all key phrases stand within the span; its score is the share of the template's whole IDF mass whose words stand in their places. What else the document holds takes no template's vote.

Base labels come from exact phrases: places where the words of a phrase stand consecutively. Both passes are maps over
Arrow batches of whole texts; what is gathered are counts of the index words, whose number the templates bound.

Defined results: null and empty texts have no words, places or labels, and score 0; repeated rows each have a result; very long texts are read whole;
of templates of one label the best score counts; a phrase without words matches nowhere; empty tables give empty tables. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import arrow_limits, spread, table
from ._vec import ALNUM, LOWER, Words, buffers, hash_word, slabs

#: phrase -> label
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Name -> (notice, key phrases). The label is what stands before the slash. Notices are those by which works state their licence: short references, the licences'
#: own permission texts (whole, or their first paragraphs) and machine-readable tags; words only, as the index reads them.
TEMPLATES = {
    "mit": ("released under the mit license", ("mit license",)),
    "mit/permission": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        ("permission is hereby granted free of charge", "without restriction", "sublicense"),
    ),
    "apache-2": ("licensed under the apache license version 2 0", ("apache license", "version 2")),
    "apache-2/header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ("you may not use this file except in compliance with the license", "apache org licenses license 2 0"),
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "with or without modification")),
    "bsd/conditions": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistributions of source code must retain", "redistributions in binary form must reproduce"),
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted", "appear in all copies")),
    "gpl": ("this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    "gpl/header": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("this program is free software", "gnu general public license"),
    ),
    "lgpl": ("this library is licensed under the gnu lesser general public license version 2 1", ("lesser general public license",)),
    "agpl": ("licensed under the gnu affero general public license version 3", ("affero general public license",)),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "epl-2": ("made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons", "sharealike")),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc0": ("to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under cc0", ("dedicated all copyright", "public domain")),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable", "arising from the use of this software")),
}
#: Machine-readable identifiers and their labels.
TAGS = {
    "MIT": "mit", "Apache-2.0": "apache-2", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "ISC": "isc", "GPL-2.0": "gpl", "GPL-3.0": "gpl", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "MPL-2.0": "mpl-2", "EPL-2.0": "epl-2",
    "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc", "CC0-1.0": "cc0", "Unlicense": "unlicense", "Zlib": "zlib",
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _tagged(tags: dict[str, str]) -> dict[str, tuple[str, tuple[str, ...]]]:
    """A template for each identifier: the tag with its words, all of them a key phrase."""
    return {f"{label}/{tag}": (f"spdx license identifier {tag}", (f"spdx license identifier {tag}",)) for tag, label in tags.items()}


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


class Index:
    """Postings of the templates' words, and phrases as hash sequences."""

    def __init__(self, templates: dict = TEMPLATES, base: dict = BASE, tags: dict = TAGS):
        templates = templates | _tagged(tags)
        self.names = sorted(templates)
        self.labels = [n.partition("/")[0] for n in self.names]
        texts = [words_of(templates[n][0]) for n in self.names]
        self.lengths = [len(t) for t in texts]
        vocabulary = sorted({w for t in texts for w in t}, key=hash_word)
        self.words = vocabulary
        self.keys = np.array([hash_word(w) for w in vocabulary], np.uint64)
        at = {w: i for i, w in enumerate(vocabulary)}
        self.postings = [[] for _ in vocabulary]
        for t, words in enumerate(texts):
            for q, w in enumerate(words):
                self.postings[at[w]].append((t, q))
        seq = lambda phrase: np.array([hash_word(w) for w in words_of(phrase)], np.uint64)
        self.own = [np.array([at[w] for w in words], np.int64) for words in texts]
        self.musts = [[seq(k) for k in templates[n][1]] for n in self.names]
        self.base = [(seq(phrase), label) for phrase, label in base.items()]

    def known(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, or -1."""
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, i, -1)


def places(h: np.ndarray, phrase: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Word numbers at which the phrase stands within one row."""
    if not len(phrase) or len(h) < len(phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[: len(h) - len(phrase) + 1] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[h[at + k] == phrase[k]]
    return at[row[at] == row[at + len(phrase) - 1]]


def document_counts(docs: DataFrame, index: Index, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each index word occurs, and how many documents there are."""
    arrow_limits(docs.sparkSession)
    keys = index.keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(keys), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, part, at in slabs(*buffers(batch.column(0))):
                w = Words(LOWER[part], at, ALNUM)
                i = index.known(w.hashes())
                there = np.unique(w.row[i >= 0] * len(keys) + i[i >= 0])
                total += np.bincount(there % len(keys), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(keys)), -1]), pa.array([*total.tolist(), n])], ["i", "n"])

    rows = spread(docs.select(text)).mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    found = {r.i: r.n for r in rows}
    return np.array([found.get(i, 0) for i in range(len(keys))], np.int64), int(found.get(-1, 0))


def idf(counts: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1) / (counts + 1)) + 1


def judge(h: np.ndarray, known: np.ndarray, index: Index, weight: np.ndarray, rare: int, share: float) -> dict[str, float]:
    """label -> share of IDF mass, for one document's word hashes and the vocabulary numbers of its words."""
    out: dict[str, float] = {}
    none = np.zeros(len(h), np.int8)
    for t, (own, length) in enumerate(zip(index.own, index.lengths, strict=True)):
        at = [places(h, must, none) for must in index.musts[t]]
        if not all(map(len, at)):
            continue
        span = length + 2
        kinds, times = np.unique(own, return_counts=True)
        order = np.lexsort((kinds, -weight[kinds]))
        kinds, times = kinds[order], times[order]
        total = float((weight[kinds] * times).sum())
        padded = np.concatenate([np.full(length, -1), known, np.full(span, -1)])
        # as many places at once as fit a few million comparisons
        for first in np.array_split(at[0], len(at[0]) // max(1, 4_000_000 // (span * span * len(kinds))) + 1):
            start = np.unique(np.concatenate([(first[:, None] - np.arange(span)).ravel(), np.arange(1 - length, 0)]))
            start = start[start > -length]
            here = np.maximum(start, 0)
            there = (padded[here[:, None] + length + np.arange(span)][:, :, None] == kinds).any(1)
            looked = there & (np.cumsum(there, 1) <= rare)
            full = (looked * (weight[kinds] * times)).sum(1)
            votes = padded[start[:, None] + length + np.arange(length)] == own
            mass = (votes * looked[:, np.argsort(kinds)[np.searchsorted(np.sort(kinds), own)]] * weight[own]).sum(1)
            for i in np.flatnonzero((mass > 0) & (mass >= share * full)).tolist():
                a, b = int(here[i]), int(here[i]) + span
                score = min(1.0, float(weight[own[votes[i]]].sum()) / total)
                if score > out.get(index.labels[t], 0.0) and all(((p >= a) & (p + len(must) <= b)).any() for p, must in zip(at, index.musts[t], strict=True)):
                    out[index.labels[t]] = score
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict = TEMPLATES, base: dict = BASE, tags: dict = TAGS, rare: int = 12, share: float = 0.6) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels (array), labels (array), score."""
    index = Index(templates, base, tags)
    counts, n = document_counts(docs, index, text)
    weight = idf(counts, n)
    # a document that lacks a word of a template's key phrases can't pass it, whatever its other words
    needed = [np.unique(index.known(np.concatenate(musts))) for musts in index.musts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n_words, n_base, first, last = (np.zeros(rows, np.int64) for _ in range(4))
            own: list[set] = [set() for _ in range(rows)]
            found: list[dict] = [{} for _ in range(rows)]
            for r0, part, at in slabs(*buffers(batch.column(1))):
                w = Words(LOWER[part], at, ALNUM)
                h, row = w.hashes(), w.row
                here = slice(r0, r0 + len(at) - 1)
                n_words[here] = np.diff(w.at)
                first[here] = np.iinfo(np.int64).max
                last[here] = -1
                for phrase, label in index.base:
                    p = places(h, phrase, row)
                    np.add.at(n_base, row[p] + r0, 1)
                    np.minimum.at(first, row[p] + r0, p - w.at[row[p]])
                    np.maximum.at(last, row[p] + r0, p - w.at[row[p]])
                    for r in np.unique(row[p]).tolist():
                        own[r0 + r].add(label)
                known = index.known(h)
                there = np.zeros((len(at) - 1, len(index.keys)), bool)
                there[row[known >= 0], known[known >= 0]] = True
                likely = np.any([there[:, words].all(1) for words in needed], axis=0)
                for r in np.flatnonzero(likely).tolist():
                    s = slice(w.at[r], w.at[r + 1])
                    found[r0 + r] = judge(h[s], known[s], index, weight, rare, share)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([sorted(x) for x in own], pa.list_(pa.string())), pa.array([sorted(x | set(f)) for x, f in zip(own, found, strict=True)], pa.list_(pa.string())),
                    pa.array([1.0 if x else max(f.values(), default=0.0) for x, f in zip(own, found, strict=True)], pa.float64()),
                ],
                ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double"
    return spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")


