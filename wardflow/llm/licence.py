"""Licence notices in documents, by a trained paragraph classifier.

A text is read as one run of words, across line breaks and comment marks, in paragraphs of WORDS
words that begin every STEP words, so a notice of up to STEP words lies whole in one of them. Every
paragraph of every text is classified: word n-grams (one to three words) of the licences' texts and
names are the features of logistic regressions with an L1 penalty, one per family and one for
`unknown`, trained here by proximal gradient steps on paragraphs that hold no notice, one or several. So a paragraph
can have several families. `unknown` is learned from paragraphs of the corpus, from near misses
made of the licences' own words and from names of licences outside any notice. Logistic curves
fitted to examples kept aside turn the scores into probabilities; a family is predicted where its
probability passes and is not below that of `unknown`.

Within the paragraphs predicted for a family, its templates are compared: the prediction
is confirmed, and the notice placed, where enough of a template's word pairs stand within WORDS words. Of places
of different families, one that lies inside another with more matched pairs goes (the text of one
licence that quotes most of another's). Places of one family that overlap, or that follow
each other within STEP words and are of different templates, are one notice.

The features that count are few, and each holds a word that few paragraphs of the corpus hold. A
paragraph with none of them is unknown by definition; a text with none of these words is settled by that.

What is learned from: the templates below, and at most `paragraphs` paragraphs (chosen by a hash) of at most
`sample` documents (chosen by a hash), without those in which a template is found.

Defined results: null, empty and wordless texts have no notices; repeated rows are each reported; a
notice that occurs twice in a text counts twice; a null doc_id is kept; an empty table gives an
empty frame; other columns are ignored.
"""

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wardflow.llm import pieces
from wardflow.llm.common import ship, slices, staged

WORDS, STEP = 120, 60

# Opening words of public licences and the usual notices.
TEMPLATES = {
    "AGPL": ["licensed under the GNU Affero General Public License", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "released under the AGPL-3.0 license"],
    "Apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "released under the Apache 2.0 license"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License", "licensed under the BSD 3-Clause License", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0": ["Released under CC0 1.0", "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "released under the GPL-3.0 license"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License"],
    "LGPL": ["licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "released under the LGPL-2.1 license"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0"],
    "Proprietary": ["All rights reserved", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "released under the Unlicense"],
}
# Names and identifiers of the licences, and the words that notices put around a name.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "GNU AGPL", "AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "Apache": ["Apache License", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0", "Apache-2.0"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD", "BSD-3-Clause", "BSD-2-Clause"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC0": ["CC0 1.0 Universal", "CC0 1.0", "CC0-1.0", "CC0"],
    "GPL": ["GNU General Public License", "GNU General Public License version 3", "GNU General Public License version 2", "GNU GPL", "GPL", "GPLv3", "GPLv2",
            "GPL-3.0", "GPL-2.0", "GPL-3.0-only", "GPL-2.0-only", "GPL-3.0-or-later", "GPL-2.0-or-later"],
    "ISC": ["ISC License", "ISC"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "LGPL", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-only", "LGPL-3.0-or-later"],
    "MIT": ["MIT License", "Expat License", "MIT"],
    "MPL": ["Mozilla Public License", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense"],
}
FORMS = ["licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "under the terms of the {}",
         "available under the {}", "SPDX-License-Identifier: {}", "License: {}"]
CHOICES = ["or {}", "and {}"]  # the second name of a notice with several
LONGER = ["GNU GPL, either version 3 or any later version", "GNU AGPL, either version 3 or any later version", "GNU LGPL, either version 3 or any later version"]
UNKNOWN = "unknown"
TOKEN = re.compile(r"[a-z0-9][a-z0-9.+-]*")


def tokens(text):
    return [w.rstrip(".+-") for w in TOKEN.findall(text.lower())]


def grams(words, most=3):
    return {" ".join(words[i:i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)}


def pairs(words):
    return {(a, b) for a, b in zip(words, words[1:])} or {(w, "") for w in words}


def whole_names(family):
    """Names that are notices by themselves: those that say what they are."""
    return [n for n in NAMES.get(family, ()) if " License" in n]


def templates(family):
    """Word lists that confirm a family: its texts, its names in notices, and names that say `License`."""
    forms = [form.format(n) for n in NAMES.get(family, ()) for form in FORMS + CHOICES]
    longer = [t for t in LONGER if t.split(",")[0] in NAMES.get(family, ())]
    unique = dict.fromkeys(tuple(tokens(t)) for t in [*TEMPLATES[family], *whole_names(family), *longer, *forms])
    return [list(t) for t in unique]


def places(hits, need, size):
    """(first word, word after the last, distinct pairs) of disjoint places with `need` distinct pairs.

    `hits`: (position, pair) in order, of one template of `size` words. A place is the shortest stretch
    that has enough, and the template's other pairs that follow within its size.
    """
    count, left, i = {}, 0, 0
    while i < len(hits):
        at, pair = hits[i]
        count[pair] = count.get(pair, 0) + 1
        i += 1
        while count[hits[left][1]] > 1 or at - hits[left][0] > WORDS - 2:
            old = hits[left][1]
            count[old] -= 1
            if not count[old]:
                del count[old]
            left += 1
        if len(count) >= need:
            while i < len(hits) and hits[i][1] not in count and hits[i][0] <= hits[left][0] + size - 2:
                at, pair = hits[i]
                count[pair] = 1
                i += 1
            yield hits[left][0], at + 2, len(count)
            count, left = {}, i


def starts(n):
    """First words of the paragraphs of a text of `n` words."""
    return range(0, max(0, -(-(n - WORDS) // STEP)) * STEP + 1, STEP)


def one_notice_each(found):
    """Places (first word, word after the last, template, family, probability, share, pairs) joined to notices."""
    # Inside a place of another family that matches more pairs: the words are that family's.
    inner = [p for p in found if any(q[3] != p[3] and q[0] <= p[0] and p[1] <= q[1] and q[6] > p[6] for q in near(found, p))]
    out, last = [], {}
    for a, z, t, family, p, share, _ in sorted(set(found) - set(inner)):
        held = last.get(family)
        if held and (a < held["end"] or a - held["end"] <= STEP and t not in held["of"]):
            held["end"], held["p"], held["share"] = max(z, held["end"]), max(p, held["p"]), max(share, held["share"])
            held["of"].add(t)
        else:
            last[family] = {"begin": a, "end": z, "p": p, "share": share, "of": {t}, "family": family}
            out.append(last[family])
    return [(h["begin"], h["end"], h["family"], h["p"], h["share"]) for h in out]


def near(found, place):
    """Places of the sorted list `found` that begin at most WORDS before `place` (a place is no longer than that) and not after."""
    return found[bisect_right(found, (place[0] - WORDS,)):bisect_right(found, (place[0] + 1,))]


class Model:
    def __init__(self, families, index, weights, bias, slope, shift, rare):
        self.families, self.index, self.weights, self.bias = families, index, weights, bias
        self.slope, self.shift = slope, shift
        self.unknown = families.index(UNKNOWN)
        # Per family: template number -> (distinct pairs, words); word pair -> template numbers.
        self.forms, self.known, self.of = [], {}, {}
        for k, f in enumerate(families):
            for words in templates(f) if f != UNKNOWN else ():
                for p in pairs(words):
                    self.known.setdefault(p, []).append(len(self.forms))
                self.forms.append((k, len(pairs(words)), len(words)))
        # The rarest word of every n-gram with a weight, and the n-grams (word number in it, words) found by it.
        self.anchors = {}
        for g in index:
            words = g.split(" ")
            at = min(range(len(words)), key=lambda i: (rare.get(words[i], 0), words[i]))
            self.anchors.setdefault(words[at], []).append((at, tuple(words), index[g]))

    def evidence(self, words):
        """(first word, word after the last, column) of the n-grams with a weight, in order."""
        return sorted((i - at, i - at + len(g), col) for i, w in enumerate(words) if w in self.anchors
                      for at, g, col in self.anchors[w] if i >= at and tuple(words[i - at:i - at + len(g)]) == g)

    def probabilities(self, columns):
        """Of every class, for paragraphs that hold the n-grams of these columns."""
        z = self.weights[columns].sum(0) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))

    def families_of(self, columns, at_least):
        """{class number: probability} of the families predicted for a paragraph."""
        if not columns:
            return {}
        p = self.probabilities(columns)
        return {int(k): float(p[k]) for k in np.flatnonzero((p >= at_least) & (p >= p[self.unknown])) if k != self.unknown}

    def paragraphs(self, words, at_least):
        """[(first word, word after the last, {class: probability})] of the paragraphs with a family."""
        held = {}
        for a, z, col in self.evidence(words):
            # The paragraphs s <= a, z <= s + WORDS; s is a multiple of STEP up to the last start.
            for s in range(max(0, -(-(z - WORDS) // STEP)) * STEP, min(a // STEP * STEP, starts(len(words))[-1]) + 1, STEP):
                held.setdefault(s, set()).add(col)
        out = [(s, min(s + WORDS, len(words)), self.families_of(sorted(c), at_least)) for s, c in sorted(held.items())]
        return [x for x in out if x[2]]

    def notices(self, words, at_least, overlap):
        """(first word, word after the last, family, probability, share of a template's pairs) of all notices."""
        stretches = {}
        for a, z, predicted in self.paragraphs(words, at_least):
            for k, p in predicted.items():
                last = stretches.setdefault(k, [])
                if last and a <= last[-1][1]:
                    last[-1][1], last[-1][2] = z, max(p, last[-1][2])
                else:
                    last.append([a, z, p])
        found = []
        for k, list_ in stretches.items():
            for a, z, p in list_:
                hits = {}
                for i, pair in enumerate(zip(words[a:z], words[a + 1:z]), a):
                    for t in self.known.get(pair, ()):
                        if self.forms[t][0] == k:
                            hits.setdefault(t, []).append((i, pair))
                for t, at in hits.items():
                    _, distinct, size = self.forms[t]
                    need = int(np.ceil(overlap * distinct - 1e-9))
                    for begin, end, n in places(at, need, size) if len(at) >= need else ():
                        found.append((begin, end, t, self.families[k], p, n / distinct, n))
        return one_notice_each(sorted(found))

    def predict(self, words, at_least, overlap):
        """(family, probability, share) of the likeliest confirmed notice, or None."""
        got = self.notices(words, at_least, overlap)
        return max(((f, p, s) for _, _, f, p, s in got), key=lambda x: (x[1], x[2], x[0]), default=None)


def _examples(families, unknown, rng):
    """(paragraph, its classes) made of notices and of words around them."""
    filler = np.array([w for p in unknown for w in p] or ["text"])
    around = lambda n: rng.choice(filler, n).tolist()
    out = [([], set())]
    sure = [(k, words) for k, f in enumerate(families[:-1]) for words in
            [tokens(t) for t in TEMPLATES[f]] + [tokens(n) for n in whole_names(f)] + [tokens(t) for t in LONGER if t.split(",")[0] in NAMES.get(f, ())]]
    named = [(k, tokens(form.format(n))) for k, f in enumerate(families[:-1]) for n in NAMES.get(f, ()) for form in FORMS]
    lost = lambda words: [w for w in words if len(words) < 6 or rng.random() > 0.06]
    for k, words in sure * 8 + named * 4:
        long = rng.random() < 0.7
        out.append((around(rng.integers(0, 50) * long) + lost(words) + around(rng.integers(0, 50) * long), {k}))
    for _ in range(len(sure) * 4):  # several notices in a paragraph
        paragraph, classes = around(rng.integers(0, 20)), set()
        for k, words in (sure[i] for i in rng.integers(0, len(sure), rng.integers(2, 4))):
            paragraph += lost(words) + around(rng.integers(0, 12))
            classes.add(k)
        out.append((paragraph, classes))
    several = [k for k, f in enumerate(families[:-1]) if f in NAMES]
    for _ in range(len(sure) * 4):  # a choice of names
        a, b = (int(k) for k in rng.choice(several, 2, replace=False))
        first, second = (rng.choice(NAMES[families[k]]) for k in (a, b))
        words = tokens(f"{rng.choice(FORMS).format(first)} {rng.choice(CHOICES).format(second)}")
        out.append((around(rng.integers(0, 40)) + words + around(rng.integers(0, 40)), {a, b}))
    # No notices: the corpus, the licences' words in no order, forms without a name, names without a form.
    pool = np.array([w for _, words in sure for w in words])
    other = [(list(p), set()) for p in unknown]
    for _ in range(len(sure) * 6):
        other.append((rng.choice(pool, rng.integers(2, 12)).tolist() + around(rng.integers(0, 60)), set()))
    for form in FORMS * 6:
        other.append((around(rng.integers(0, 40)) + tokens(form.format(" ".join(around(2)))) + around(rng.integers(1, 40)), set()))
    for name in [n for f in families[:-1] for n in NAMES.get(f, ()) if " License" not in n] * 4:
        other.append((around(rng.integers(0, 40)) + tokens(name) + around(rng.integers(1, 40)), set()))
    return out + other


def fit(unknown, seed=3, penalty=1e-4, steps=400, common=0.02):
    """A model from the licences' texts and paragraphs (lists of words) that hold none.

    An n-gram counts only if one of its words is in less than `common` of those paragraphs.
    """
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES) + [UNKNOWN]
    rare = {}
    for p in unknown:
        for w in set(p):
            rare[w] = rare.get(w, 0) + 1
    usual = {w for w, n in rare.items() if n >= common * len(unknown)}
    index = {}
    for f in families[:-1]:
        for words in templates(f):
            for g in sorted(grams(words)):
                if not usual.issuperset(g.split(" ")):
                    index.setdefault(g, len(index))
    examples = _examples(families, unknown, rng)
    x = np.zeros((len(examples), len(index)), np.float32)
    y = np.zeros((len(examples), len(families)), np.float32)
    for i, (words, classes) in enumerate(examples):
        x[i, [index[g] for g in grams(words) if g in index]] = 1
        y[i, sorted(classes) or [len(families) - 1]] = 1
    aside = rng.random(len(examples)) < 0.2

    def balance(goal):  # both sides of a class weigh the same
        return (goal * (0.5 / np.maximum(goal.sum(0), 1)) + (1 - goal) * (0.5 / np.maximum((1 - goal).sum(0), 1))).astype(np.float32)

    a, goal = x[~aside], y[~aside]
    weight = balance(goal)
    # Step width: the largest curvature of the loss over all classes, by power iterations.
    v = rng.random((len(index), len(families))).astype(np.float32)
    for _ in range(20):
        v /= np.maximum(np.linalg.norm(v, axis=0), 1e-9)
        v = a.T @ (weight * (a @ v))
    rate = np.float32(1 / (0.25 * float(np.linalg.norm(v, axis=0).max()) + 1e-9))
    weights, bias = np.zeros_like(v), np.zeros(len(families), np.float32)
    ahead, last, momentum = weights, weights, 1.0
    for _ in range(steps):
        d = (1 / (1 + np.exp(-np.clip(a @ ahead + bias, -30, 30))) - goal) * weight
        weights = ahead - rate * (a.T @ d)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * np.float32(penalty), 0)
        bias = bias - 2 * d.sum(0)
        after = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead, last, momentum = weights + np.float32((momentum - 1) / after) * (weights - last), weights, after
    # Calibration on the examples kept aside: a logistic curve over each class's score.
    z, t = (x[aside] @ weights + bias).astype(float), y[aside]
    slope, shift, side = np.ones(len(families)), np.zeros(len(families)), balance(t)
    for _ in range(300):
        d = (1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30))) - t) * side
        slope = np.maximum(slope - 0.1 * ((d * z).sum(0) + 1e-2 * (slope - 1)), 0.1)
        shift = shift - 0.5 * d.sum(0)
    keep = {g: i for g, i in index.items() if np.abs(weights[i]).sum() > 0}
    return Model(families, {g: k for k, g in enumerate(keep)}, weights[list(keep.values())].astype(float), bias.astype(float), slope, shift, rare)


def train(docs, sample=400, paragraphs=6):
    """A model whose `unknown` class knows `paragraphs` paragraphs of each of `sample` documents, at most."""
    ship(docs.sparkSession)
    rows = docs.select(F.xxhash64("doc_id", "text", F.lit(47)).alias("key"), "text").filter("text IS NOT NULL")
    # Numbers alone are ordered; texts are fetched for the chosen ones, of equal rows one.
    chosen = staged(rows.select("key").distinct().orderBy("key").limit(sample), "sample")
    parts = F.expr(f"""transform(sequence(0, greatest(0, cast(ceil((size(words) - {WORDS}) / {STEP}) as int))),
                                 i -> array_join(slice(words, i * {STEP} + 1, {WORDS}), ' '))""")
    picked = F.expr(f"slice(array_sort(transform(parts, x -> struct(xxhash64(x) AS key, x AS text))), 1, {int(paragraphs)}).text")
    chosen = (rows.join(chosen, "key").withColumn("words", F.split("text", r"\s+")).select("key", parts.alias("parts"))
              .select("key", picked.alias("parts")).groupBy("key").agg(F.min("parts").alias("parts")))
    known = [pairs(words) for f in TEMPLATES for words in templates(f)]
    out = []
    for r in chosen.collect():
        for part in r["parts"]:
            words = tokens(part)
            own = pairs(words)
            if words and all(len(t & own) < 0.7 * len(t) for t in known):  # not itself a notice
                out.append(words)
    return fit(sorted(out))


def find_notices(docs, model, at_least=0.5, overlap=0.7):
    """doc_id, line, word (of the line, where the notice begins), family, probability, overlap, text of each notice."""
    ship(docs.sparkSession)
    schema = "doc_id long, line int, word int, family string, probability double, overlap double, text string"

    def run(batches):
        quick = [a.encode() for a in model.anchors]
        plain = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c in b"\n" else 32 for c in range(256))
        parts = frozenset(p for a in quick for p in re.findall(rb"[a-z0-9]+", a)[:1])
        for batch in batches:
            for part in slices(batch, "text", limit=4 << 20):
                buf, offsets = pieces.texts(part.column("text"))
                simple, rows = buf.translate(plain), []
                for i, (a, z) in enumerate(zip(offsets, offsets[1:])):
                    if parts.isdisjoint(simple[a:z].split()):
                        continue
                    words, first = [], []
                    for line in buf[a:z].split(b"\n"):
                        first.append(len(words))
                        words += tokens(line.decode("utf-8", "replace"))
                    for begin, end, *got in model.notices(words, at_least, overlap):
                        k = bisect_right(first, begin) - 1
                        rows.append((i, k, begin - first[k], *got, " ".join(words[begin:end])))
                if rows:
                    i, *columns = zip(*rows)
                    kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(i)), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                                                     names=["doc_id", "line", "word", "family", "probability", "overlap", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def licence_report(docs):
    """doc_id, family, number of notices and the least certain of them, per document and family found."""
    found = find_notices(docs, train(docs))
    return found.groupBy("doc_id", "family").agg(F.count("*").alias("notices"), F.min("probability").alias("least_probability"),
                                                 F.min("overlap").alias("least_overlap"))
