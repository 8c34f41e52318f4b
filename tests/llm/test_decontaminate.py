"""Benchmark passages: planted ones, edits, clean texts."""

import random

import numpy as np
import pytest

from wardflow.llm import decontaminate as D


@pytest.fixture(scope="module")
def made():
    rnd = random.Random(9)
    vocabulary = ["w%d" % i for i in range(4000)] + ["the", "of", "and"] * 300
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = {i: text(n) for i, n in enumerate([3, 6, 12, 17, 20, 26, 33, 40, 48, 60])}
    docs, want = [], set()
    for k in range(120):
        body = text(rnd.randrange(5, 400))
        if k % 3 == 0:
            item = k // 3 % len(items)
            passage = list(items[item])
            for _ in range(rnd.randrange(0, int(0.1 * len(passage)) + 1)):
                passage[rnd.randrange(len(passage))] = "edited"
            at = rnd.randrange(len(body) + 1)
            body = body[:at] + passage + body[at:]
            want.add((k, item))
        docs.append((k, " ".join(body) if k % 2 else ", ".join(body).upper()))
    return items, docs, want


def brute(items, docs, rate=0.2):
    out = set()
    for k, text in docs:
        words = D.words((text or "").encode())
        for i, item in items.items():
            item = [w.encode() for w in item]
            number = {w: n for n, w in enumerate(dict.fromkeys(item), 1)}
            seg = np.array([number.get(w, 0) for w in words])
            if len(seg) and D.edit_distance(np.array([number[w] for w in item]), seg)[0] <= int(rate * len(item) + 1e-9):
                out.add((k, i))
    return out


def test_against_brute_force(spark, made):
    items, docs, planted = made
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()] + [(90, None), (91, ""), (92, "!!")], "item_id long, text string")
    got = D.find_passages(df, bench).collect()
    found, all_ = {(r.doc_id, r.item_id) for r in got}, brute(items, docs)
    assert planted <= found and found <= all_ and len(found) >= 0.95 * len(all_)
    texts = dict(docs)
    for r in got:
        assert 0 <= r.start < r.end <= len(texts[r.doc_id].encode()) and r.edits <= 0.2 * len(items[r.item_id])
    clean = D.without_passages(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == set(texts) - {d for d, _ in found}
    parts = D.find_passages(df, bench, portion=200).collect()  # several portions of the benchmark
    assert planted <= {(r.doc_id, r.item_id) for r in parts}


def test_edges(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (3, "one")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "alpha beta gamma delta epsilon zeta"), (3, "alpha beta gamma delta epsilon zeta"), (4, "Alpha; BETA gamma\ndelta epsilon."),
            (5, "x " * 30000 + "alpha beta gamma delta epsilon zeta"), (None, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in D.find_passages(df, bench).collect()), key=repr)
    assert got == sorted([(3, 1), (3, 2), (3, 1), (3, 2), (4, 1), (4, 2), (5, 1), (5, 2), (None, 3)], key=repr)
    none = bench.limit(0)
    assert D.find_passages(df, none).count() == 0 and D.without_passages(df, none).count() == len(rows)
    assert D.find_passages(df.limit(0), bench).count() == 0


def test_edit_distance():
    a = np.array([1, 2, 3, 4, 5])
    assert D.edit_distance(a, np.array([9, 9, 1, 2, 3, 4, 5, 9])) == (0, 7)
    assert D.edit_distance(a, np.array([1, 2, 4, 5]))[0] == 1
    assert D.edit_distance(a, np.array([1, 2, 9, 3, 4, 5]))[0] == 1
    assert D.edit_distance(a, np.array([7]))[0] == 5


def test_recall_is_reached():
    rnd = random.Random(2)
    bench = D.Benchmark([(i, " ".join("w%d" % rnd.randrange(900) for _ in range(20 + i % 30))) for i in range(60)])
    assert bench._recall() >= 0.95


def test_long_items_with_all_edits_are_found(spark):
    """Every length class reaches the target: items of 500 words with 100 edits, beside many short ones."""
    rnd = random.Random(4)
    text = lambda n: ["w%d" % rnd.randrange(3000) for _ in range(n)]
    items = {i: text(12) for i in range(450)} | {1000 + i: text(500) for i in range(6)}
    docs = []
    for i in range(1000, 1006):
        passage = list(items[i])
        for _ in range(100):
            at = rnd.randrange(len(passage))
            kind = rnd.randrange(3)
            passage[at:at + (kind < 2)] = ["edited"] * (kind != 1)
        docs.append((i, " ".join(text(40) + passage + text(40) + passage + text(30))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in D.find_passages(df, bench).collect() if r.item_id >= 1000]
    assert sorted(got) == [(i, i) for i in range(1000, 1006) for _ in range(2)]
