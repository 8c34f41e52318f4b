"""The Jaccard join against all pairs."""

import os
import random
import threading

import numpy as np
import pyarrow as pa
import pytest

from wardflow.llm import ngram_join
from wardflow.llm.ngram_join import Bands, signatures


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, num, den):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    word = lambda: "w%d" % rnd.randrange(3000)
    line = "this very common line is in a third of all texts and means nothing at all here"
    out = []
    for n in (1, 2, 3, 4, 5, 8, 12, 30, 90, 400):
        for _ in range(6):
            base = [word() for _ in range(n)] + (line.split() if rnd.random() < 0.4 else [])
            out.append(" ".join(base))
            for edits in (0, 1, max(1, n // 60), max(1, n // 25), max(1, n // 12)):
                copy = list(base)
                for _ in range(edits):
                    copy[rnd.randrange(len(copy))] = word()
                out.append(" \t".join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
    out += ["", None, " \n\t", "Été à la", "Été à La", "x " * 5000, line]
    return list(enumerate(out)) + [(2000 + i, out[40]) for i in range(60)] + [(None, out[40]), (7, out[7])]


@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (5, 80, 100)])
def test_groups(spark, rows, size, num, den):
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, component_id string").repartition(4)
    got = ngram_join.similar_groups(df, size, num, den).collect()
    assert len(got) == len(rows)
    want = brute(rows, size, num, den)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    kept = ngram_join.one_of_each_group(df, size=size, num=num, den=den)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert sorted(set(ids)) == sorted(i for i, (_, c) in want.items() if i == c)


def test_blocks_give_the_same(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    want = {(r.doc_id, r.component_id) for r in ngram_join.similar_groups(df).collect()}
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 3)
    assert {(r.doc_id, r.component_id) for r in ngram_join.similar_groups(df).collect()} == want


def test_empty(spark):
    assert ngram_join.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_within_the_bound_share_a_signature():
    """Whatever v the probe chooses: an indexed and a probing signature meet."""
    rng = np.random.default_rng(2)
    bands = Bands(85, 100)
    for n in (7, 9, 13, 20, 40, 110, 600, 3000):
        for _ in range(30):
            s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            differ = bands.differ(len(s), len(s))
            lose = int(rng.integers(0, differ + 1))
            other = np.unique(np.concatenate((s[lose // 2 + lose % 2:], rng.integers(0, 1 << 63, lose // 2, dtype=np.uint64))))
            both = len(np.intersect1d(s, other))
            if 100 * both < 85 * (len(s) + len(other) - both) or np.array_equal(s, other):
                continue
            small, large = sorted((s, other), key=len)
            cost = lambda x: rng.random(len(x)) * (rng.random(len(x)) < 0.3)
            a, fa = signatures(small, bands, cost(small))
            b, fb = signatures(large, bands, cost(large))
            assert set(a[fa & ngram_join.PROBE > 0].tolist()) & set(b[fb & ngram_join.INDEX > 0].tolist())


def edited(groups, copies, words, every):
    """Groups of near copies, all with edits of their own."""
    rnd, out = random.Random(3), []
    for _ in range(groups):
        base = ["w%d" % rnd.randrange(50_000) for _ in range(words)]
        out += [" ".join("x%d" % rnd.randrange(1 << 30) if rnd.random() < 1 / every else w for w in base) for _ in range(copies)]
    return list(enumerate(out))


def test_disk_of_exchanges_with_many_near_copies(spark):
    """A text is sent in few groups, signatures are packed and exchanges are freed (3.3 times the texts before, 1.05 now)."""
    rows = edited(40, 16, 300, 150)
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [str(d) for d in files.localDirs()]

    def on_disk():
        total = 0
        for top in folders:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.startswith("shuffle_") and name.endswith(".data"):
                        try:
                            total += os.path.getsize(f"{folder}/{name}")
                        except OSError:
                            pass
        return total

    spark._jvm.System.gc()
    before, most, done = on_disk(), 0, threading.Event()

    def watch():
        nonlocal most
        while not done.wait(0.05):
            most = max(most, on_disk() - before)

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 80, 100).collect()
    finally:
        done.set()
        thread.join()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 5, 80, 100)
    assert most < 2 * sum(len(t) for _, t in rows), most / sum(len(t) for _, t in rows)


def test_packed_signatures():
    rng = np.random.default_rng(1)
    for n, ids in ((1, 5), (1000, 300), (1000, 10 ** 6), (3000, 1 << 62)):
        sig, flag = rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(1, 4, n).astype(np.int8)
        doc = np.sort(rng.integers(-ids, ids, n))
        got = ngram_join.unpack(ngram_join.pack(sig, doc, flag))
        assert all(np.array_equal(*x) for x in zip(got, (sig & ngram_join.CODE, doc, flag)))
    ends = np.array([-1 << 63, 0, (1 << 63) - 1])
    assert ngram_join.unpack(ngram_join.pack(sig[:3], ends, flag[:3]))[1].tolist() == ends.tolist()


@pytest.mark.parametrize("held", [1 << 22, 100])
def test_buckets_reduced_as_they_come_lose_no_pair(rows, monkeypatch, held):
    monkeypatch.setattr(ngram_join, "FLUSH", 500)
    monkeypatch.setattr(ngram_join, "HELD", held)
    given = [r for r in rows if r[0] is not None and r[0] < 200]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in given]), "text": pa.array([r[1] for r in given])})
    emitted = pa.Table.from_batches(ngram_join._emit_rows(4, 85, 100, 4)(iter([batch]))).sort_by("bucket")
    met = {}
    for bucket, data in zip(emitted["bucket"].to_pylist(), emitted["data"].to_pylist()):
        for sig, doc, flag in zip(*ngram_join.unpack(data)) if data else ():
            met.setdefault((bucket, sig), []).append((int(doc), int(flag)))
    out = pa.Table.from_batches(list(ngram_join._reduce_rows(iter(emitted.to_batches(max_chunksize=7))))).to_pylist()
    assert sum(r["flag"] < 0 for r in out) == len(given)
    under = {}
    for r in out:
        if r["flag"] > 0:
            under.setdefault(r["sig"], {r["sig"]}).add(r["doc"])
    wanted = [{d for d, _ in found} for found in met.values() if {f for _, f in found} & {3} or {f for _, f in found} >= {1, 2}]
    wanted = [x for x in wanted if len(x) > 1]
    assert wanted and all(any(x <= under.get(lead, set()) for lead in x) for x in wanted)
