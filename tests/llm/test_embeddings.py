"""Embedding near-duplicates against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from wardflow.llm import embedding_dedup
from wardflow.llm.hnsw import Graph


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    centre = rng.normal(size=16)
    near = centre + rng.normal(size=(200, 16)) * 0.12 * np.linalg.norm(centre) / 4
    copies = np.repeat(rng.normal(size=(1, 16)), 80, 0) * rng.uniform(0.5, 2, (80, 1))
    all_ = np.concatenate((x, near, copies))
    out = [(i, v.tolist()) for i, v in enumerate(all_[rng.permutation(len(all_))])]
    return out + [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [1.0] * 15 + [None]), (1004, [1.0] * 15 + [float("nan")]),
                  (1005, [1.0] * 15 + [float("inf")]), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [1e300, 2e300]), (5, out[5][1]), (None, out[5][1])]


def brute(rows, least=0.95):
    v = {i: np.array(e, float) for i, e in rows if i is not None and e and None not in e and np.isfinite(e).all() and np.any(e)}
    ids = sorted({i for i, _ in rows if i is not None})
    links = {i: set() for i in ids}
    for a in v:
        for b in v:
            if a < b and len(v[a]) == len(v[b]):
                x, y = v[a] / np.abs(v[a]).max(), v[b] / np.abs(v[b]).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].add(b)
                    links[b].add(a)
    root = {}
    for i in ids:
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += links[k]
    return {i: (len(links[i]), root[i], root[i] == i) for i in ids}


def test_against_all_pairs(spark, rows):
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, kept string").repartition(3)
    got = embedding_dedup.near_duplicates(df, shards=3).collect()
    want = brute(rows)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    assert len(got) == len(want) + 1 and found == want


def test_widening(spark, rows):
    """A beam of one finds little at first; the audits widen it."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    got = embedding_dedup.near_duplicates(df, shards=2, beam=1).filter("vec_id IS NOT NULL").collect()
    assert sum(r.n_links for r in got) >= 0.98 * sum(n for n, _, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got)


def test_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x)
    best = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    found, _ = graph.search(x[:200], 64)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best.tolist(), found.tolist())])
    assert recall > 0.9
    for links, width in zip(graph.links, [32, 16, 16]):
        assert links.shape[1] == width and links.max() < len(x)


def test_rare_pairs_are_audited(spark):
    """Three pairs that a sample of 256 vectors does not meet, and a beam that is too narrow for any."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 48))
    x[1:4] = x[4:7] + rng.normal(size=(3, 48)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id for r in embedding_dedup.near_duplicates(df, shards=1, beam=1).filter("n_links > 0").collect()}
    assert got == {1, 2, 3, 4, 5, 6}


def test_large_group_does_not_outvote_pairs(monkeypatch):
    """Searches that lose all pairs until the beam is 64 wide, beside a group with nearly all links."""
    class Weak(Graph):
        def search(self, q, ef, lowest=0):
            ids, sims = super().search(q, ef, lowest)
            return ids, np.where((ids < 120) & (ef < 64), -2, sims) if lowest == 0 and built else sims

    built = []
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1000, 48))
    x[:60] = x[60:120] + rng.normal(size=(60, 48)) * 0.1
    x = np.concatenate((x, rng.normal(size=48) + rng.normal(size=(600, 48)) * 0.05))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(embedding_dedup, "Graph", lambda v: (Weak(v), built.append(1))[0])
    n = len(x)
    batch = pa.RecordBatch.from_pydict({"dim": pa.array([48] * n, pa.int32()), "shard": pa.array([0] * n, pa.int32()), "own": [True] * n,
                                        "id": pa.array(range(n), pa.int64()), "weight": pa.array([1] * n, pa.int64()),
                                        "unit": pa.array([v.tobytes() for v in x], pa.binary())})
    rows = pa.Table.from_batches(list(embedding_dedup._build(0.95, 0.99, 16, 256)([batch])))
    assert rows.column("beam")[0].as_py() >= 64
    assert rows.column("label").to_pylist()[60:120] == list(range(60))
