"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from wardflow.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, row long, term string, score long"
ITEMS = "item_id long, text string, rank int, n long"


def fold(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(d, Counter(fold(t))) for d, t in docs if fold(t)]
    count, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * count) // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
                    for t in set(fold(text)) if t in bag)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def made(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Über", "naïve", "日本語", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda m: rnd.choice([" ", ", ", "\n", "-"]).join(rnd.choices(words, weights, k=m))
    docs = [(i, text(rnd.randrange(1, 80))) for i in range(n)]
    items = [(i, text(rnd.randrange(1, 30))) for i in range(25)]
    return docs, items


def odd():
    docs, items = made(3, 300)
    docs += [(1000 + i, docs[7][1]) for i in range(400)]  # copies: many equal scores
    docs += [(5, docs[5][1]), (5, "w3 w9 again"), (None, docs[6][1]), (None, docs[6][1]), (2000, None), (2001, ""), (2002, "--- !"),
             (2003, "w1 " * 60_000 + "rare"), (2004, "\u0085w1\u0085 W1w2")]
    items += [(3, docs[7][1]), (3, docs[7][1]), (None, "rare w5"), (100, None), (101, ""), (102, "never met anywhere"), (103, docs[6][1])]
    return docs, items


@pytest.mark.parametrize("data,shipped,block", [(made(1, 2000), 1 << 20, 1 << 20), (made(2, 40), 400, 100), (odd(), 1 << 20, 3000), (odd(), 1000, 500)])
def test_against_all_scores(spark, data, shipped, block):
    docs, items = data
    df = spark.createDataFrame([(*r, 9, "mine", 7) for r in docs], DOCS).repartition(5)
    bench = spark.createDataFrame([(*r, 0, 0) for r in items], ITEMS)
    got = ranked_search.search(df, bench, shipped=shipped, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, "a"), (2, "a")], [(1, "a")])])
def test_empty(spark, docs, items):
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(docs, items)


def test_terms():
    assert ranked_search.terms("Ab-c1_É\u00a0x y\u0085Z{".encode()) == ["ab".encode(), b"c1", "É\u00a0x".encode(), "y\u0085z".encode()]
