import math

import pytest

from tessarine.llm import licenses
from tests.llm.fixtures import frame, odd_documents, prose, with_clashes


def plain(text):
    words = licenses.words_of(text or "")
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = licenses.words_of(phrase)
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def cases():
    return odd_documents() + [
        (30, "Released under the MIT-License. " * 3), (31, f"{prose(1, 9000)} Licensed under the Apache License, Version 2.0. {prose(2, 50)} CC BY-NC 4.0"), (32, "under the mit"), (32, "license"),
        (33, "This work is licensed under the GNU General Public License, version 3."), (34, "A general public library about version control and licenses"), (35, "Underthe mit license under the mité license"),
        (36, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"), (37, "cc by nc cc by nc"),
    ]


def test_every_column_against_plain_loops(spark):
    got = sorted(((r.key, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(with_clashes(frame(spark, cases()))).collect()), key=str)
    assert got == sorted(((k, *plain(t)) for k, t in cases()), key=str)


def test_labels_of_the_method(spark):
    got = {r.key: (r.labels, r.score) for r in licenses.scan(frame(spark, cases())).collect() if r.key and r.key >= 30}
    assert got[33][0] == ["gpl"] and got[36][0] == ["bsd"] and got[33][1] > 0.8
    assert got[30] == (["mit"], 1.0) and got[31][0] == ["apache-2", "cc-by-nc"] and got[34] == ([], 0.0) and got[35] == ([], 0.0)
    assert all(set(x) >= set(plain(t)[4]) for k, t in cases() if k and k >= 30 for x in [got[k][0]] if k != 32)


def test_counts_cover_all_documents(spark):
    index = licenses.Index()
    counts, n = licenses.document_counts(frame(spark, cases()), index)
    assert n == len(cases())
    want = [sum(w in licenses.words_of(t or "") for _, t in cases()) for w in index.words]
    assert counts.tolist() == want


def test_empty_table(spark):
    assert licenses.scan(frame(spark, [])).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_whole_table(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    for r in licenses.op9_licenses(spark, f"/root/testdata/{sf}").collect():
        n, m, a, b, labels = plain(rows[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, m, a, b, ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1

def test_notices_of_long_files_keep_their_votes(spark):
    """A file of all notices, and one of a notice among rarer index words, keep the labels that each notice earns alone."""
    notices = {name: notice for name, (notice, _) in licenses.TEMPLATES.items()}
    label_of = lambda name: name.partition("/")[0]
    rare = "forms domain form binary attribution creative commons free international lesser into code"
    rows = [(i, notice) for i, notice in enumerate(notices.values())]
    rows += [(100, f" {prose(4, 20)} ".join(notices.values())), (101, f"{rare} {prose(5, 40)} {notices['gpl']} {prose(6, 40)}")]
    rows += [(200 + i, "a gnu with the general public") for i in range(80)] + [(300, " ".join([notices["bsd"]] * 700))]
    got = {r.key: r.labels for r in licenses.scan(frame(spark, rows)).collect()}
    assert all(label_of(name) in got[i] for i, name in enumerate(notices))
    assert got[100] == sorted({label_of(name) for name in notices}) and got[101] == ["gpl"] and got[200] == [] and got[300] == ["bsd"]


def test_permission_texts_and_tags(spark):
    """The licences' own texts as they are printed, and tags in source files; texts that only speak of such things have no label."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software and associated documentation files (the \"Software\"), to deal\n in the Software without restriction, including without limitation the rights\n to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    rows = [(1, mit), (2, isc), (3, gpl)] + [(10 + i, f"// SPDX-License-Identifier: {tag}\nint main() {{}}") for i, tag in enumerate(licenses.TAGS)]
    rows += [(50, "Permission to enter is hereby granted free of charge to any person."), (51, "The SPDX license identifier list names many licenses."), (52, f"{prose(1, 5000)} {mit} {prose(2, 5000)} SPDX-License-Identifier: ISC")]
    got = {r.key: r.labels for r in licenses.scan(frame(spark, rows)).collect()}
    assert (got[1], got[2], got[3]) == (["mit"], ["isc"], ["gpl"])
    assert [got[10 + i] for i in range(len(licenses.TAGS))] == [[label] for label in licenses.TAGS.values()]
    assert got[50] == got[51] == [] and got[52] == ["isc", "mit"]


def test_plain_votes(spark):
    """labels and scores against loops: for each template whose key phrases stand in the text, the best share of its words' IDF at one offset."""
    rows = cases() + [(60 + i, f"{prose(i, 10)} {notice} {prose(i + 9, 10)}") for i, (notice, _) in enumerate(licenses.TEMPLATES.values())]
    docs = [licenses.words_of(t or "") for _, t in rows]
    weight = lambda w: math.log((len(docs) + 1) / (sum(w in d for d in docs) + 1)) + 1
    for r in licenses.scan(frame(spark, rows)).where("key >= 60").collect():
        words = licenses.words_of(dict(rows)[r.key])
        best = {}
        for name, (notice, keys) in licenses.TEMPLATES.items():
            t = licenses.words_of(notice)
            if all(f" {' '.join(licenses.words_of(k))} " in f" {' '.join(words)} " for k in keys):
                for start in range(len(words)):
                    own = sum(weight(w) for q, w in enumerate(t) if start + q < len(words) and words[start + q] == w)
                    label = name.partition("/")[0]
                    best[label] = max(best.get(label, 0), own / sum(map(weight, t)))
        full = {label for label, share in best.items() if share > 0.999}
        assert full <= set(r.labels) and all(best.get(label, 0) > 0 for label in r.labels)
        assert r.score == 1.0 or abs(r.score - max(best.values())) < 1e-9
