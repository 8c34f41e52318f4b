"""Language, quality and licences: accuracy on rows no model saw, and defined edge cases."""

import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardflow.llm import language, licence, quality

DATA = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "123 456 !?"), (4, "the of and " * 20000), (4, "the of and " * 20000), (None, "The that with")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1.5, "x") for i, t in ODD], "doc_id long, text string, score double, lang_pred string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_language(docs, odd, empty):
    got = language.language_report(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    own = got.filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert own > 0.97
    network = language.train(docs)
    rows = language.identify(odd, network)
    assert rows.columns == ["doc_id", "text", "lang_pred", "score"] and rows.count() == len(ODD)
    by = {(r.doc_id, r.lang_pred, r.score > 0.5) for r in rows.collect()}
    assert by == {(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (None, "en", True)}
    kept = language.in_known_languages(odd, network)
    assert kept.columns == odd.columns and kept.count() == 3
    assert language.train(empty) is None and language.language_report(empty).count() == 0
    nothing = language.language_report(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in nothing.select("lang_pred", "score").distinct().collect()} == {("und", 0.0)}


def test_gradient():
    """The network's gradient against differences."""
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"])
    x, y = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8), rng.integers(0, 3, 5)

    def loss():
        net.pairs = None
        return -np.log(net.probabilities(x)[np.arange(5), y]).mean()

    grad = net._gradient(x, y)
    for name in ("bias", "out", "b3", "w2", "w4", "vector"):
        flat = net.p[name].reshape(-1)
        k = int(np.abs(grad[name]).argmax())
        before = flat[k]
        flat[k] = before + 1e-3
        up = loss()
        flat[k] = before - 1e-3
        down = loss()
        flat[k] = before
        assert abs((up - down) / 2e-3 - grad[name].reshape(-1)[k]) < 0.05 * abs(grad[name]).max() + 1e-3


def test_windows_cover_the_text():
    for n in (0, 1, 255, 256, 257, 1000):
        x, size = language.cut(np.arange(n).astype(np.uint8))
        assert size.sum() == n and x.reshape(-1)[:n].tolist() == np.arange(n).astype(np.uint8).tolist()


def test_quality(spark, docs, labels, odd, empty):
    got = quality.quality_report(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    own = got.filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in own]) > 0.95 and all(0 <= r.score <= 1 for r in own)
    trees = quality.train(docs, labels)
    rows = quality.score(odd, trees)
    assert rows.columns == ["doc_id", "text", "lang_pred", "score", "predicted"] and rows.count() == len(ODD)
    assert quality.of_good_quality(odd, trees).columns == odd.columns
    none = labels.limit(0)
    assert quality.train(docs, none) is None and quality.of_good_quality(docs, None) is docs
    assert {r.score for r in quality.quality_report(docs, none).select("score").distinct().collect()} == {0.5}
    ones = quality.quality_report(docs, labels.filter("quality = 1")).agg(F.min("score")).first()[0]
    assert ones > 0.99
    assert quality.quality_report(empty, labels).count() == 0


def test_tree_arrays_follow_the_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.fit(x[:2000], y[:2000])
    p = trees.score(x)
    assert ((p[2000:] > 0.5) == y[2000:]).mean() > 0.95
    for i in range(0, 3000, 500):  # one row at a time
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if x[i, trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert abs(1 / (1 + np.exp(-total)) - p[i]) < 1e-12


def test_licences(spark, docs, odd, empty):
    planted = {"MIT": "Released under the MIT License.", "Apache": "Licensed under the Apache License, Version 2.0.",
               "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
               "Proprietary": "All rights reserved."}
    model = licence.train(docs)
    got = licence.find_notices(docs, model).select("doc_id", "family").distinct().collect()
    rows = docs.select("doc_id", "text").collect()
    assert {(r.doc_id, r.family) for r in got} == {(r.doc_id, f) for r in rows for f, t in planted.items() if t in (r.text or "")}
    say = lambda t: (model.predict(licence.tokens(t), 0.5, 0.7) or [None])[0]
    for family, texts in licence.TEMPLATES.items():
        assert all(say(t) == family for t in texts)
    for text in ("the general public version of the work is licensed", "license", "", "copyright and permission of the state", "a free copy of the software"):
        assert say(text) is None
    long = spark.createDataFrame([(1, "word " * 500 + "Released under the MIT License. " + "word " * 500), (2, "x\nAll rights reserved.\ny\nAll rights reserved.")],
                                 "doc_id long, text string")
    assert sorted((r.doc_id, r.family, r.notices) for r in licence.find_notices(long, model).groupBy("doc_id", "family").agg(F.count("*").alias("notices")).collect()) == [
        (1, "MIT", 1), (2, "Proprietary", 2)]
    assert licence.find_notices(odd, model).count() == 0 and licence.licence_report(empty).count() == 0


def _families(spark, docs, texts):
    found = licence.find_notices(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licence.train(docs)).collect()
    return [sorted(r.family for r in found if r.doc_id == i) for i in range(len(texts))], found


def test_several_notices_close_together(spark, docs):
    texts = ["All rights reserved. Licensed under the Apache License, Version 2.0",
             "Released under the MIT License or, at your choice, released under the Apache 2.0 license.",
             "word " * 70 + "Released under the MIT License. " + "word " * 20 + "Released under the MIT License. " + "word " * 100,
             "licensed under the GNU Lesser General Public License", "Licensed under the MIT License. Permission is hereby granted, free of charge, "
             "to any person obtaining a copy of this software and associated documentation files"]
    got, _ = _families(spark, docs, texts)
    assert got == [["Apache", "Proprietary"], ["Apache", "MIT"], ["MIT", "MIT"], ["LGPL"], ["MIT"]]


def test_wrapped_notices(spark, docs):
    wrap = lambda t, mark: "\n".join(mark + line for line in textwrap.wrap(t, 50))
    bsd, isc, gpl = licence.TEMPLATES["BSD"][0], licence.TEMPLATES["ISC"][0], licence.TEMPLATES["GPL"][1]
    got, rows = _families(spark, docs, ["a\nb\n\n" + wrap(bsd, " * "), wrap(isc, "# ") + "\n\nx", "some words\n" + wrap(gpl, "// ")])
    assert got == [["BSD"], ["ISC"], ["GPL"]]
    assert {(r.doc_id, r.line, r.word) for r in rows} == {(0, 3, 0), (1, 0, 0), (2, 1, 0)}


def test_names_and_choices(spark, docs):
    texts = {"The MIT License (MIT) Copyright (c) 2020 Someone": ["MIT"], "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": ["GPL"],
             "under the Apache License 2.0": ["Apache"], "Dual licensed under MIT or Apache 2.0": ["Apache", "MIT"],
             "This program is free software: you can redistribute it under the GNU GPL, either version 3 or any later version": ["GPL"],
             "SPDX-License-Identifier: MIT": ["MIT"], "// SPDX-License-Identifier: GPL-2.0-or-later": ["GPL"], "licensed under the MPL 2.0 or GPL-2.0": ["GPL", "MPL"],
             "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": ["CC-BY-NC"],
             "She studied at MIT and later at Harvard": [], "the new BSD operating system": [], "an apache helicopter": [], "released under the old bridge": []}
    got, _ = _families(spark, docs, list(texts))
    assert got == list(texts.values())


def test_paragraphs_are_classified_first(spark, docs):
    model = licence.train(docs)
    words = licence.tokens("Released under the MIT License.")
    assert model.notices(words, 0.5, 0.7) and not model.notices(words, 1.1, 0.7)
    model.weights = model.weights * 0  # a classifier that knows nothing finds nothing, whatever the templates say
    model.bias = np.where(np.arange(len(model.bias)) == model.unknown, 5.0, -5.0)
    assert not model.notices(words, 0.5, 0.7)


def test_scan_against_a_slow_one(spark, docs):
    """Every paragraph with all its n-grams, every template at every place, in plain loops."""
    model, rng = licence.train(docs), np.random.default_rng(5)
    plain = licence.tokens(" ".join(r.text for r in docs.filter("text IS NOT NULL").orderBy("doc_id").limit(20).collect()))
    distinct = [(f, t) for f in ("MIT", "BSD", "ISC", "MPL", "Unlicense", "Proprietary") for t in licence.TEMPLATES[f]]
    for _ in range(25):
        words = []
        for _ in range(rng.integers(0, 5)):
            words += rng.choice(plain, rng.integers(0, 150)).tolist() + licence.tokens(distinct[rng.integers(len(distinct))][1])
        words += rng.choice(plain, rng.integers(0, 200)).tolist()
        paragraphs, s = [], 0
        while True:
            paragraphs.append((s, words[s:s + licence.WORDS]))
            if s + licence.WORDS >= len(words):
                break
            s += licence.STEP
        assert [s for s, _ in paragraphs] == list(licence.starts(len(words)))
        slow, covered = set(), {}
        for s, part in paragraphs:
            columns = [model.index[g] for g in licence.grams(part) if g in model.index]
            p = model.probabilities(columns)
            for k, f in enumerate(model.families):
                if columns and f != licence.UNKNOWN and p[k] >= 0.5 and p[k] >= p[model.unknown]:
                    covered.setdefault(f, set()).update(range(s, s + len(part)))
        for f, at in covered.items():
            for template in licence.templates(f):
                want = licence.pairs(template)
                for i in at:
                    own = [w if i + j in at else None for j, w in enumerate(words[i:i + licence.WORDS])]
                    if len(want & set(zip(own, own[1:]))) >= 0.7 * len(want) - 1e-9:
                        slow.add(f)
        assert {f for _, _, f, _, _ in model.notices(words, 0.5, 0.7)} == slow


def test_licences_in_repeated_and_long_rows(spark, docs):
    long = "word " * 300_000 + "Released under the MIT License. " + "word " * 300_000
    rows = [(1, "x. All rights reserved."), (1, "x. All rights reserved."), (None, "Licensed under CC BY 4.0."), (3, long), (4, None), (5, "")]
    got = licence.find_notices(spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("mine")), licence.train(docs))
    assert sorted(((r.doc_id or 0), r.family, r.line) for r in got.collect()) == [(0, "CC-BY", 0), (1, "Proprietary", 0), (1, "Proprietary", 0), (3, "MIT", 0)]
