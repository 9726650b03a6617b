"""Operators 3, 5 and 7: license scan, toxicity, language of pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import common, langid, license_scan, queries, toxicity

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------ licenses
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."


@pytest.mark.parametrize("text, want", [
    ("foo bar\n" + APACHE + "\nmore", ["Apache-2.0"]), ("RELEASED UNDER THE MIT LICENSE!!", ["MIT"]),
    ("# Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY 4.0", ["CC-BY-4.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"]),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["CC-BY-NC-4.0"]),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", ["CC-BY-4.0"]), ("Licensed under CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"]),
    ("GNU Lesser General Public License, version 3 and the GNU Affero General Public License, version 3: this program is licensed under the", []),
    ("// SPDX-License-Identifier: MIT\n", ["MIT"]), ("# SPDX-License-Identifier: LGPL-2.1-or-later", ["LGPL-2.1"]), ("License: GPL v3", ["GPL-3.0"]), ("Licensed under GPLv2.", ["GPL-2.0"]),
    ("License :: OSI Approved :: BSD License", ["BSD"]), ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["EPL-2.0"]),
    ("a license to kill and a driving license", []), ("Licensed under the Apache License, Version 1.1", []),
])
def test_licenses(text, want):
    assert [hit[0] for lo, hi in license_scan.blocks(text) for hit in license_scan.judge(text[lo:hi])] == want


MIT = """Copyright (c) 2020 Jo Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Copyright (c) 2020, Jo Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD_3 = BSD + """

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
GPL = """Copyright (C) 2020  Jo Doe

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "        "])
@pytest.mark.parametrize("notice, name", [(MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD_3, "BSD-3-Clause"), (GPL, "GPL-3.0"), (LGPL, "LGPL-2.1"), (AGPL, "AGPL-3.0"), (ISC, "ISC"), (APACHE.replace(", ", ",\n").replace(" may", "\nmay"), "Apache-2.0")])
def test_wrapped_notices(notice, name, mark):
    text = "import os\n" * 300 + "".join(mark + line + "\n" for line in notice.split("\n")) + "x = 1\n" * 300
    assert {hit[0] for lo, hi in license_scan.blocks(text) for hit in license_scan.judge(text[lo:hi])} == {name}


def plain_judge(text):
    """All templates at all places: the licenses whose whole wording stands there, word by word, longest first, each word used once."""
    own, used, out = license_scan.words(text), set(), []
    spots = sorted(((len(w), i, at) for i, (_, _, t) in enumerate(license_scan.TEMPLATES) for w in [license_scan.words(t)]
                    for at in range(len(own) - len(w) + 1) if own[at:at + len(w)] == w), key=lambda x: (-x[0], x[2]))
    for size, i, at in spots:
        if not used.intersection(range(at, at + size)):
            used.update(range(at, at + size))
            out.append((at, license_scan.TEMPLATES[i][0]))
    return [name for _, name in sorted(out)]


def test_every_template_is_found_as_by_a_pass_over_all_templates():
    r = np.random.default_rng(3)
    filler = ["the code is ours", "see the license file", "all rights reserved", "copyright 2020", "and other words"]
    for name, _, text in license_scan.TEMPLATES:
        assert [hit[0] for hit in license_scan.judge(text)] == [name], text
    for _ in range(60):
        some = [license_scan.TEMPLATES[i][2] for i in r.integers(len(license_scan.TEMPLATES), size=3)]
        text = ". ".join(x for t in some for x in (t, " ".join(r.choice(filler, 4)))) + "."
        assert [hit[0] for hit in license_scan.judge(text)] == plain_judge(text), text


SEVEN = ["Licensed under the Apache License, Version 2.0", "Released under the MIT License", "This work is licensed under the GNU General Public License, version 3", "Licensed under CC BY-SA 4.0",
         "Licensed under the BSD 3-Clause License", "This library is licensed under the GNU Lesser General Public License, version 3", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"]
NAMES = ["Apache-2.0", "MIT", "GPL-3.0", "CC-BY-SA-4.0", "BSD-3-Clause", "LGPL-3.0", "MPL-2.0"]


@pytest.mark.parametrize("between", [". ", ".\n", " some other words that stand between two notices "])
def test_every_license_of_a_block(between):
    for order in (range(7), range(6, -1, -1), [3, 1, 0, 1, 6, 2, 2, 5, 4, 0]):
        text = between.join(SEVEN[i] for i in order) + between
        hits = [(text[lo + a:lo + b], name) for lo, hi in license_scan.blocks(text) for a, b, name, *_ in license_scan.places(text[lo:hi])]
        assert hits == [(SEVEN[i], NAMES[i]) for i in order]


def test_many_notices_without_a_break():
    assert len(license_scan.judge("Released under the MIT License. " * 3000)) == 3000


def test_license_rows(spark):
    long = "word " * 200_000 + "Released under the MIT License." + " word" * 1000
    df = spark.createDataFrame([(1, None), (2, ""), (3, long), (3, long), (4, "nothing")], "doc_id long, text string").withColumn("license", F.lit("x"))
    rows = license_scan.scan(df).collect()
    assert [(r.doc_id, r.license) for r in rows] == [(3, "MIT")] * 2
    assert "Released under the MIT License" in long[rows[0].start:rows[0].end]
    assert license_scan.scan(df.limit(0)).count() == 0


def test_every_license_line_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.lower("text").contains("released under the mit license")).select("doc_id")
    found = queries.op3_license_scan(spark, SF).filter("license = 'MIT'").select("doc_id")
    assert docs.exceptAll(found.distinct()).count() == 0 == found.distinct().exceptAll(docs).count()


# ------------------------------------------------------------ toxicity
def test_held_out_accuracy_and_labels_unread(spark):
    rows = {r.doc_id: r for r in queries.op5_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.predicted, labels[i]) for i, r in rows.items() if r.held_out and i in labels]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())


def texts(spark, n=400):
    r = np.random.default_rng(0)
    rows = []
    for i in range(n):
        words = list(r.choice(["sun", "tree", "rain", "stone", "bird", "cloud"], 40))
        if i % 3 == 0:
            words[int(r.integers(40))] = "Scoundrel!"
        rows.append((" ".join(words), int(i % 3 == 0), "en" if i % 2 else "fr"))
    return spark.createDataFrame(rows, "text string, label int, lang string")


def test_a_word_is_learnt_and_edges_score(spark):
    net = toxicity.train(texts(spark))
    edge = spark.createDataFrame([("a", "you scoundrel", "en"), ("b", "the sun and rain", None), ("c", None, "xx"), ("d", "", "fr"), ("e", "tree " * 300_000 + "scoundrel", "fr"), ("a", "you scoundrel", "en")],
                                 "id string, text string, lang string").withColumn("threshold", F.lit("x"))
    out = toxicity.score(edge, net).collect()
    assert len(out) == 6 and {r.id: r.toxic for r in out} == {"a": True, "b": False, "c": False, "d": False, "e": True}
    assert out[2].score == out[3].score and out[0].score == out[5].score
    assert toxicity.score(edge.limit(0), net).count() == 0


def test_without_both_labels_the_score_is_constant(spark):
    df = texts(spark, 9)
    assert {r.score for r in toxicity.score(df, toxicity.train(df.limit(0))).collect()} == {0.0}
    assert {r.score for r in toxicity.score(df, toxicity.train(df.withColumn("label", F.lit(1)))).collect()} == {1.0}


def test_a_word_of_a_small_language_is_learnt(spark):
    r = np.random.default_rng(1)
    clean = {"en": ["sun", "tree", "rain", "stone", "bird", "cloud"], "es": ["sol", "lluvia", "piedra", "nube", "campo"]}
    rows = []
    for i in range(4000):
        lang = "es" if i % 33 == 0 else "en"
        toxic = i % 10 == 3 if lang == "en" else i % 330 == 0
        rows.append((" ".join([*r.choice(clean[lang], 12), *(["scoundrel" if lang == "en" else "canalla"] if toxic else []), f"n{i}"]), int(toxic), lang))
    net = toxicity.train(spark.createDataFrame(rows, "text string, label int, lang string"))
    low, high = net.scores([b"sol lluvia piedra", b"sol canalla piedra"])
    assert low < 0.5 <= high


def test_recall_by_language_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    held = docs.filter(queries.held_out(F.col("doc_id"))).select("text", "lang", "label")
    rows = toxicity.score(held, queries.toxicity_net(spark, sf)).collect()
    for lang in ("en", "fr", "de", "es"):
        own = [(r.score >= 0.5, r.label) for r in rows if r.lang == lang]
        assert np.mean([p for p, y in own if y]) >= 0.5, lang
        assert np.mean([p for p, y in own if not y]) <= 0.02, lang


# ------------------------------------------------------------ languages
TEXT = {"en": "the house and the garden where they would think with this", "fr": "la maison et le jardin où ils sont avec une autre pensée",
        "de": "das Haus und der Garten wo sie nicht mit einer anderen denken"}


@pytest.fixture(scope="module")
def model(spark):
    return langid.Model.fit(spark.createDataFrame([(t, l) for l, t in TEXT.items() for _ in range(5)] + [(None, "en"), ("x", None)], "text string, lang string"))


def test_evidence_is_fused(spark, model):
    page = lambda lang, text: f'<!DOCTYPE html><html lang="{lang}"><script>the the the</script><body><p>{text}</p></body></html>'
    rows = [(f"http://a.{s}/x", page(l, TEXT[l])) for l, s in (("en", "com"), ("fr", "fr"), ("de", "de")) for _ in range(30)]
    rows += [("http://a.fr/y", page("fr", "")), ("http://a.de/y", ""), ("http://b.com/z", page("fr", TEXT["en"])), (None, None), ("nothing", page("de", TEXT["de"]))]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id int, url string, html string").withColumn("lid_ll", F.lit(1)).withColumn("language", F.lit("?"))
    got = {r.page_id: r for r in langid.identify(pages, model).collect()}
    assert len(got) == len(rows) and "lid_ll" in pages.columns
    assert [got[i].language for i in range(90)] == ["en"] * 30 + ["fr"] * 30 + ["de"] * 30
    assert [got[90 + i].language for i in range(3)] == ["fr", "de", "en"] and got[94].language == "de"
    assert got[93].language in TEXT and all(0 < r.confidence <= 1 for r in got.values())
    assert langid.identify(pages.limit(0), model).count() == 0


def test_rare_languages_and_copies_in_the_sample(spark):
    rows = [(f"{TEXT['en']} {i}", "en") for i in range(600)] + [(TEXT["fr"], "fr")] * 600 + [(f"{TEXT['de']} {i}", "de") for i in range(2)]
    small = langid.Model.fit(spark.createDataFrame(rows, "text string, lang string"), sample=30)
    assert small.languages == ["de", "en", "fr"]
    assert [small.languages[k] for k in small.likelihoods([TEXT[l].encode() for l in ("de", "en", "fr")]).argmax(axis=1)] == ["de", "en", "fr"]


def test_shares(spark):
    rows = [("a", f"x{i}") for i in range(500)] + [("b", "same")] * 500 + [("c", f"y{i}") for i in range(50)] + [("d", "z")]
    some, sizes = common.shares(spark.createDataFrame(rows, "g string, v string"), "g", "v", 62)
    got = [tuple(r) for r in some.collect()]
    assert sizes == {"a": 500, "b": 1, "c": 50, "d": 1} and len(got) == len(set(got)) and set(got) <= set(rows)
    assert {g: sum(x == g for x, _ in got) for g in sizes} == {"a": 30, "b": 1, "c": 30, "d": 1}
    assert common.shares(spark.createDataFrame(rows, "g string, v string"), "g", "v", 2)[0].count() == 4


def test_without_labelled_texts_the_language_is_null(spark):
    pages = spark.createDataFrame([(1, "http://a.com", "<p>x</p>")], "page_id int, url string, html string")
    empty = langid.Model.fit(spark.createDataFrame([], "text string, lang string"))
    assert langid.identify(pages, empty).first().language is None


def test_pages_agree_with_their_documents_language(spark):
    rows = queries.op7_langid(spark, SF).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert np.mean([f'lang="{r.language}"' in html[r.page_id] for r in rows]) > 0.97


def test_every_label_counts(spark, monkeypatch):
    """A word that one text in 130 holds, in more texts than a task holds at a time: its weight comes from all of them."""
    monkeypatch.setattr(toxicity, "HELD", 640)
    words = F.array(*[F.lit(w) for w in "sun rain tree stone river cloud".split()])
    plain = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.element_at(words, (F.pmod(F.xxhash64("id", i), F.lit(6)) + 1).cast("int"))), " ")
    docs = spark.range(7800).select("id", F.concat(plain, F.when(F.col("id") % 130 == 7, " scoundrel").otherwise(""), F.lit(" n"), "id").alias("text"),
                                    (F.col("id") % 130 == 7).cast("int").alias("label"), F.lit("en").alias("lang"))
    counts = {r.bucket: r for r in toxicity.word_counts(docs.select(F.col("text").cast("binary").alias("text"), "label", "lang")).collect()}
    word = int(toxicity.buckets([b"scoundrel"])[0][0])
    assert (counts[0].texts, counts[0].positive, counts[word].texts, counts[word].positive) == (7800, 60, 60, 60)
    low, high = toxicity.train(docs).scores([b"sun stone tree", b"sun scoundrel tree"])
    assert low < 0.5 <= high


def test_best_cut_counts_every_row():
    bins, labels, rows = np.array([1000, 3000, 6000, 9000]), np.array([0, 1, 0, 1]), np.array([500, 40, 10, 30])
    cut = toxicity.best_cut(bins, labels, rows)
    assert 1000 < cut * toxicity.BINS <= 3000
    assert toxicity.best_cut(bins[:1], labels[:1], rows[:1]) == 0.5
