"""Near-duplicate embeddings by small-world graphs per shard.

* Equal directions are one vector with a weight: a third of all rows may be copies.
* Vectors are dealt to shards by hash; each shard gets a graph (see `hnsw`), built in one task and
  written to the shared folder, a row per node. The number of shards follows the number of vectors
  (`shard_rows` each at most, on average), so a shard's memory is bounded.
* After building, a shard searches for all its vectors and joins what is linked into local groups. An
  audit compares the links found for queries with all pairs; while recall is short of `recall`, the
  beam is widened and the audit repeated. Queries are vectors of the shard and, as many, vectors of
  others (each vector is a query in one other shard too), `audits` at a time by a hash until `linked`
  of each kind have links to few vectors, or all were taken. A query counts once, however many links
  it has, and own and foreign queries with few and with many links must each reach `recall`. The beam
  that passed is kept with the shard; one as wide as the shard is a comparison with all its vectors.
* Every vector queries every shard. Where its beam meets a linked vector it is widened to that
  vector's whole local group, whose cosines are verified in double precision. So a group of
  thousands costs matrix products, and no pairs are handed out: a query returns, per local group, how
  many of its members it is linked to.
* Queries and groups linked that way are united to components.

Defined results: a vector that is null, empty, zero or holds nulls or non-finite values has no links
and is its own component; vectors of different lengths are never linked; rows with one vec_id are one
vector (the smallest that is valid); rows with a null vec_id come back as they are, with null component
and kept null; an empty table gives an empty frame; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wardflow.llm.common import components, ship, staged
from wardflow.llm.hnsw import M, WIDE, Graph
from wardflow.llm.shingles import mix

FEW = 8  # linked vectors of a query that belongs to a small group
NODE = "dim int, shard int, part int, kind int, pos int, id long, weight long, unit binary, links binary, level int, label long, beam int"
KINDS = [("dim", pa.int32()), ("shard", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("pos", pa.int32()),
         ("id", pa.int64()), ("weight", pa.int64()), ("unit", pa.binary()), ("links", pa.binary()), ("level", pa.int32()),
         ("label", pa.int64()), ("beam", pa.int32())]


def _units(batches):
    """(vec_id, unit vector as float64 bytes, or null)."""
    for batch in batches:
        out = []
        for v in batch.column("embedding"):
            data = None
            if v.is_valid and len(v.values) and v.values.null_count == 0:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top
                    data = ((x / np.sqrt((x * x).sum())) + 0.0).tobytes()
            out.append(data)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "unit"])


def _matrix(column):
    data = [b.as_buffer() for b in column]
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _linked(q, x, a, b, least):
    """Which pairs (row a of q, row b of x) are linked, in double precision and bounded memory."""
    out, step = np.zeros(len(a), bool), max(1, (4 << 20) // q.shape[1])
    for i in range(0, len(a), step):
        out[i:i + step] = np.einsum("nd,nd->n", q[a[i:i + step]], x[b[i:i + step]]) >= least
    return out


def _close(graph, q, beam, least):
    """(query, node) of what a beam meets that may be linked; all there are if it is as wide as the shard."""
    if beam >= len(graph.x):
        return np.nonzero(q.astype(np.float32) @ graph.x.T >= least - 1e-4)
    found, sims = graph.search(q, beam)
    rows, cols = np.nonzero(sims >= least - 1e-4)
    return rows, found[rows, cols]


def link_counts(graph, x, ids, weights, label, members, q, q_ids, beam, least):
    """Arrays (query, local group, linked weight) of a batch of queries; a query never counts itself."""
    rows, nodes = _close(graph, q, beam, least)
    pairs = np.unique(np.stack((label[nodes], rows)), axis=1)
    out = []
    for g, a, z in zip(*np.unique(pairs[0], return_index=True), np.append(np.unique(pairs[0], return_index=True)[1][1:], pairs.shape[1])):
        query = pairs[1, a:z]
        group = members[g]
        linked = q[query] @ x[group].T >= least
        linked &= q_ids[query][:, None] != ids[group]
        total = linked @ weights[group]
        hit = total > 0
        out.append((query[hit], np.full(int(hit.sum()), g), total[hit]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _groups(label):
    order = np.argsort(label, kind="stable")
    return dict(zip(*(lambda u, i: (u.tolist(), np.split(order, i[1:])))(*np.unique(label[order], return_index=True))))


def _local_labels(graph, x, beam, least, batch=256):
    """Smallest position each vector reaches by links found in its own shard."""
    label = np.arange(len(x))
    edges = []
    for a in range(0, len(x), batch):
        rows, nodes = _close(graph, x[a:a + batch], beam, least)
        rows = rows + a
        keep = rows != nodes
        keep[keep] = _linked(x, x, rows[keep], nodes[keep], least)
        edges.append(np.stack((rows[keep], nodes[keep])))
    a, b = np.concatenate(edges, 1)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _audit_queries(graph, x, ids, weights, q, q_ids, least, audits, linked):
    """(positions of queries with links, linked weight, whether the links are few), by all pairs.

    `audits` queries at a time until `linked` of them have few links, or all were taken.
    """
    at, wanted, few = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    order = np.argsort(mix(q_ids.astype(np.uint64) ^ np.uint64(0x5DEECE66D)), kind="stable")
    for a in range(0, len(q), audits):
        part = order[a:a + audits]
        rows, nodes = _close(graph, q[part], len(x), least)
        ok = ids[nodes] != q_ids[part][rows]
        ok[ok] = _linked(q, x, part[rows[ok]], nodes[ok], least)
        rows, nodes = rows[ok], nodes[ok]
        count = np.bincount(rows, minlength=len(part))
        some = count > 0
        at.append(part[some])
        wanted.append(np.bincount(rows, weights[nodes], len(part))[some])
        few.append(count[some] <= FEW)
        if sum(int(f.sum()) for f in few) >= linked:
            break
    return np.concatenate(at), np.concatenate(wanted), np.concatenate(few)


def _passes(graph, x, ids, weights, label, audit, beam, least, recall):
    """Whether queries with few links and with many each have `recall` of them on average."""
    q, q_ids, wanted, few = audit
    members, got = _groups(label), np.zeros(len(q))
    for a in range(0, len(q), 256):
        query, _, total = link_counts(graph, x, ids, weights, label, members, q[a:a + 256], q_ids[a:a + 256], beam, least)
        got[a:a + 256] = np.bincount(query, total, len(q[a:a + 256]))
    share = np.minimum(got, wanted) / wanted
    return all(share[kind].mean() >= recall for kind in (few, ~few) if kind.any())


def _build(least, recall, first_beam, audits, linked=64):
    def node_rows(dim, shard, ids, weights, x, other_ids, others):
        graph, beam = Graph(x), first_beam
        kinds = []
        for q, q_ids in ((x, ids), (others, other_ids)):
            at, wanted, few = _audit_queries(graph, x, ids, weights, q, q_ids, least, audits, linked)
            kinds.append((q[at], q_ids[at], wanted, few))
        while True:
            label = _local_labels(graph, x, beam, least)
            if beam >= len(x) or all(_passes(graph, x, ids, weights, label, k, beam, least, recall) for k in kinds):
                break
            beam *= 2
        smallest = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(smallest, label, ids)
        for a in range(0, len(x), 2048):
            n = min(2048, len(x) - a)
            links = [b"".join(graph.links[l][i].tobytes() for l in range(graph.levels[i] + 1)) for i in range(a, a + n)]
            full = lambda v: pa.array(np.full(n, v), pa.int32())
            yield pa.RecordBatch.from_arrays([
                full(dim), full(shard), full(0), full(0), pa.array(np.arange(a, a + n), pa.int32()), pa.array(ids[a:a + n]),
                pa.array(weights[a:a + n]), pa.array([r.tobytes() for r in x[a:a + n]], pa.binary()), pa.array(links, pa.binary()),
                pa.array(graph.levels[a:a + n], pa.int32()), pa.array(smallest[label[a:a + n]]), full(beam)], names=[k for k, _ in KINDS])

    def run(batches):
        for (dim, shard), rows in _runs(batches, ("dim", "shard")):
            own = rows.column("own").to_numpy(zero_copy_only=False)
            ids, weights = rows.column("id").to_numpy(), rows.column("weight").to_numpy()
            x = _matrix(rows.column("unit").combine_chunks())
            if own.any():
                yield from node_rows(dim, shard, ids[own], weights[own], x[own], ids[~own], x[~own])
    return run


def _runs(batches, keys):
    """((key, ...), table) of each run of rows with one key in sorted batches."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1
        for a, z in zip([0, *cuts], [*cuts, batch.num_rows]):
            here = tuple(int(c) for c in codes[:, a])
            if here != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held = here, []
            held.append(batch.slice(a, z - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _load(rows):
    """Graph and arrays from the node rows of a shard."""
    rows = rows.sort_by("pos")
    x = _matrix(rows.column("unit").combine_chunks())
    levels = rows.column("level").to_numpy().astype(np.int64)
    links = [np.full((len(x), WIDE if l == 0 else M), -1, np.int32) for l in range(int(levels.max()) + 1)]
    for i, data in enumerate(rows.column("links").to_pylist()):
        flat = np.frombuffer(data, np.int32)
        links[0][i] = flat[:WIDE]
        for l in range(1, int(levels[i]) + 1):
            links[l][i] = flat[WIDE + (l - 1) * M:WIDE + l * M]
    label = rows.column("label").to_numpy()
    return (Graph(x, links, levels), x, rows.column("id").to_numpy(), rows.column("weight").to_numpy(), label, _groups(label)), int(rows.column("beam")[0].as_py())


def _search(least, size=256):
    def answers(shard, beam, rows):
        for a in range(0, rows.num_rows, size):
            part = rows.slice(a, size)
            ids = part.column("id").to_numpy()
            query, group, total = link_counts(*shard, _matrix(part.column("unit")), ids, beam, least)
            if len(query):
                yield pa.RecordBatch.from_pydict({"rep": pa.array(ids[query]), "root": pa.array(group.astype(np.int64)),
                                                  "links": pa.array(total.astype(np.int64))})

    def run(batches):
        key, nodes, shard, beam = None, [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("dim", "shard", "part", "kind")])
            cuts = np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1
            for a, z in zip([0, *cuts], [*cuts, batch.num_rows]):
                here, kind = tuple(codes[:3, a]), codes[3, a]
                if here != key:
                    key, nodes, shard = here, [], None
                if kind == 0:
                    nodes.append(batch.slice(a, z - a))
                    continue
                if shard is None and nodes:
                    (shard, beam), nodes = _load(pa.Table.from_batches(nodes)), []
                if shard is not None:
                    yield from answers(shard, beam, batch.slice(a, z - a))
    return run


def near_duplicates(embeddings, least=0.95, shard_rows=50_000, shards=6, recall=0.99, beam=16, audits=256, linked=64):
    """vec_id, n_links, component_id and kept of every vector of (vec_id, embedding)."""
    spark = embeddings.sparkSession
    ship(spark)
    units = embeddings.select("vec_id", "embedding").mapInArrow(_units, "vec_id long, unit binary")
    base = staged(units.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("unit").alias("unit"))
                  .unionByName(units.filter("vec_id IS NULL")), "units")
    reps = staged(base.filter("vec_id IS NOT NULL AND unit IS NOT NULL").groupBy("unit").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("weight")), "vectors")
    n = reps.count()
    shards = max(shards, -(-n // shard_rows))
    parts = max(1, -(-n // shard_rows))
    dim = (F.octet_length("unit") / 8).cast("int")
    home = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    dealt = reps.select(dim.alias("dim"), home.alias("shard"), F.lit(True).alias("own"), "id", "weight", "unit")
    if shards > 1:
        away = F.pmod(home + 1 + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(shards - 1)), F.lit(shards)).cast("int")
        dealt = dealt.unionByName(reps.select(dim.alias("dim"), away.alias("shard"), F.lit(False).alias("own"), "id", "weight", "unit"))
    index = staged(dealt.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "id")
                   .mapInArrow(_build(least, recall, beam, audits, linked), NODE), "graphs")

    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    nodes = index.drop("part").withColumn("part", each(parts)).select(*[k for k, _ in KINDS])
    blank = {"kind": F.lit(1), "pos": F.lit(0), "links": F.lit(None).cast("binary"), "level": F.lit(0), "label": F.lit(0).cast("long"), "beam": F.lit(0)}
    queries = reps.withColumn("dim", dim).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")).withColumn(
        "shard", each(shards)).withColumns(blank).select(*[k for k, _ in KINDS])
    met = nodes.unionByName(queries).repartition(max(shards * parts, spark.sparkContext.defaultParallelism), "dim", "shard", "part")
    met = staged(met.sortWithinPartitions("dim", "shard", "part", "kind").mapInArrow(
        _search(least), "rep long, root long, links long"), "links")

    found = staged(components(met.select(F.col("rep").alias("a"), F.col("root").alias("b"))
                              .unionByName(index.select(F.col("id").alias("a"), F.col("label").alias("b")))), "components")
    counts = met.groupBy("rep").agg(F.sum("links").alias("linked"))
    named = reps.join(counts, F.col("id") == F.col("rep"), "left").join(found, F.col("id") == F.col("node"), "left").select(
        F.col("unit").alias("_unit"), (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "id").alias("root"))
    out = base.join(named, F.col("unit") == F.col("_unit"), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"))
