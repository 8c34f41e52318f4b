"""Exact Jaccard join of word n-gram sets by partition of the universe and the pigeonhole principle.

Sets r and s with |r| <= |s| and similarity of at least t differ in at most H = (1-t)/(1+t) (|r|+|s|)
elements. Hash the universe into m segments; let d_i be how many elements of r and s in segment i
differ. If every segment gets a number v_i of 0, 1 or 2 and they add up to more than H, some segment
has d_i < v_i: equal parts where v_i is 1, parts that differ in one element at most where it is 2.

* Sizes fall into bands, so that m follows the size. A set is indexed under its own band and probes
  that and the next one (partners are never smaller than the probe).
* The index side gives every segment, and for a fixed tenth of the segments (all, for small sets)
  also the one-deletion neighbourhood. The probe side alone chooses v, which is sound whatever it
  chooses: segments are ranked by the frequency of their rarest shingle, as counted so far in the
  task; the costliest (empty ones, shared lines) get 0, and where the sum asks for it cheap
  segments with indexed neighbourhoods get 2.
* Signatures are dealt out packed, seven bytes each, by buckets of their hash. Documents that share
  one are gathered under one of them (its leader, mostly the smallest); every candidate pair is then
  found among the documents of some leader. Two signatures of a bucket count as one if 46 more bits
  agree: that may add candidates, never lose one.
* These groups are verified in blocks of bounded size: a task holds two blocks, counts exact
  intersections and returns a spanning forest of the links, never the pairs. A document goes with its
  smallest leader first. What is left are the groups that this neither compared in full nor joined in
  one component; only these are compared in a second round.

Exact copies are one set: they are joined by a fingerprint of the set, and a task emits signatures of
a set once. Sets are of 64-bit hashes of the shingles; texts travel, their sets do not, which take
more than twice the room.

Defined results: a null text or one without words has an empty set (n = 0) and is linked with
nothing; with fewer words than the shingle size the whole sequence is one shingle; repeated rows with
one doc_id count as one node; rows with a null doc_id are returned with a null component and take no
part; an empty table gives an empty frame; other columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from wardflow.llm import pieces
from wardflow.llm.common import components, free_names, ship, slices, staged, tidy
from wardflow.llm.shingles import mix, shingle_set

SKETCH = 1 << 18
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 20


class Bands:
    """Sizes 1, 2, ... in bands whose ends grow by 1/t; per band the segments and how they are used."""

    def __init__(self, num, den):
        self.num, self.den, self.known = num, den, {}

    def of(self, size):
        return int(math.log(size) / math.log(self.den / self.num) + 1e-9)

    def top(self, band):
        """No size of the band is above this."""
        return int((self.den / self.num) ** (band + 1) + 1e-6) + 1

    def differ(self, a, b):
        """Most elements in which sets of these sizes may differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def layout(self, band):
        """(segments, of which the first so many have their neighbourhoods indexed)."""
        if band not in self.known:
            most = self.differ(self.top(band), self.top(band))
            if most == 0:
                self.known[band] = (1, 0)
            elif most < 8:
                self.known[band] = (-(-(most + 1) // 2),) * 2
            else:
                two = max(2, (most + 1) // 40)
                self.known[band] = (most + 1 - two, 2 * two)
        return self.known[band]


def _segments(s, m, seed):
    """Order of the elements by segment, where segments begin, and a sum of element hashes by segment."""
    seg = (mix(s + np.uint64(seed)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    begin = np.searchsorted(seg[order], np.arange(m + 1))
    value = mix(s ^ np.uint64(0x5851F42D4C957F2D))[order]
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    return order, begin, value, running[begin[1:]] - running[begin[:-1]]


def _sign(total, count, segment, band, kind):
    """Signature of a part (sum and number of its elements) in a segment of a band."""
    place = (np.asarray(segment).astype(np.uint64) * np.uint64(4) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(mix(total + mix(place + np.uint64(band))) + np.asarray(count).astype(np.uint64))


EXACT, SHORTER = 0, 1
INDEX, PROBE = 1, 2


def signatures(s, bands, cost):
    """(signature, flags) of one set. `cost`: estimated frequency of each element, for the choice of v."""
    out, n, own = [], len(s), bands.of(len(s))
    limit = n * bands.den // bands.num  # largest partner
    for band in (own, own + 1):
        if band > own and limit < (bands.den / bands.num) ** band - 1:
            continue
        m, deep = bands.layout(band)
        if bands.differ(n, min(limit, bands.top(band))) == 0:
            continue  # only equal sets, which the fingerprint joins
        order, begin, value, total = _segments(s, m, band)
        count = np.diff(begin)
        segment = np.arange(m)
        exact = _sign(total, count, segment, band, EXACT)
        price = np.full(m, 4.0)  # an empty part: as many as the band has sets
        full = np.flatnonzero(count)
        price[full] = np.minimum.reduceat(cost[order], begin[full])
        if price.size:
            price += 1e-6 * (segment % 97)
        need = bands.differ(n, min(limit, bands.top(band))) + 1
        v = np.zeros(m, np.int64)
        rank = np.argsort(price, kind="stable")
        v[rank[:min(need, m)]] = 1
        lacking = need - int(v.sum())
        # Part with the costliest probes in exchange for neighbourhoods of cheap, indexed segments.
        usable = [i for i in rank.tolist() if i < deep and count[i] >= 2]
        for i in usable:
            if lacking > 0 and v[i] < 2:
                v[i] += 1
                lacking -= 1
        for i in range(deep):  # parts of one element or none, only where nothing else is left
            if lacking > 0 and v[i] < 2:
                v[i] += 1
                lacking -= 1
        hot = [i for i in rank[::-1].tolist() if v[i] == 1 and price[i] >= 0.05]
        for i in usable:
            if hot and v[i] == 1 and price[i] < 0.05:
                v[hot.pop(0)] = 0
                v[i] = 2
        if v.sum() < need:
            raise AssertionError("segments too few for the bound")
        probe = v > 0
        if band == own:
            out.append((exact, np.where(probe, INDEX | PROBE, INDEX).astype(np.int8)))
        else:
            out.append((exact[probe], np.full(int(probe.sum()), PROBE, np.int8)))
        # Shorter parts: of the index side, met by exact probes with v = 2 (as SHORTER);
        # of the probe side, met by exact index parts.
        at = np.repeat(segment, count)
        less, fewer = total[at] - value, count[at] - 1
        if band == own and deep:
            pick = at < deep
            out.append((_sign(less[pick], fewer[pick], at[pick], band, SHORTER), np.full(int(pick.sum()), INDEX, np.int8)))
        two = v == 2
        if two.any():
            out.append((_sign(total[two], count[two], segment[two], band, SHORTER), np.full(int(two.sum()), PROBE, np.int8)))
            pick = two[at]
            out.append((_sign(less[pick], fewer[pick], at[pick], band, EXACT), np.full(int(pick.sum()), PROBE, np.int8)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def fingerprint(s):
    """Two 64-bit values of a set."""
    if not len(s):
        return 0, 0
    a = mix(s).sum(dtype=np.uint64)
    b = mix(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sets(part, size):
    buf, offsets = pieces.texts(part.column("text"))
    return [shingle_set(buf[a:z], size) for a, z in zip(offsets, offsets[1:])]


FIRST, COPY = 1, 2  # document rows have flag -(4 * n + FIRST or COPY)
ROWS = "sig long, other long, doc long, flag int"
PACKED = "bucket int, data binary, " + ROWS
FLUSH, HELD = 1 << 19, 1 << 22  # signatures a task puts together before it deals them out, and takes in before it reduces them
CODE = np.uint64((1 << 46) - 1)


def pack(sig, doc, flag):
    """Signatures (46 bits and two of flags) in six bytes each, documents in ascending order by steps of one byte."""
    code = ((sig & CODE) << np.uint64(2) | flag.astype(np.uint64)).astype("<u8")
    step = np.diff(doc, prepend=0)
    far = (step < 0) | (step >= 255)
    return b"".join((np.array([len(sig), far.sum()], "<i8").tobytes(), code.view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),
                     np.where(far, 255, step).astype(np.uint8).tobytes(), doc[far].astype("<i8").tobytes()))


def unpack(data):
    n, _ = np.frombuffer(data, "<i8", 2).tolist()
    code = np.zeros((n, 8), np.uint8)
    code[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 16).reshape(n, 6)
    code = code.reshape(-1).view("<u8")
    step = np.frombuffer(data, np.uint8, n, 16 + 6 * n).astype(np.int64)
    far, given = np.flatnonzero(step == 255), np.frombuffer(data, "<i8", -1, 16 + 7 * n)
    step[far] = 0
    doc = np.cumsum(step)
    if len(far):  # from each of them on, what it says takes the place of the sum so far
        doc += np.repeat(np.concatenate(([0], given - doc[far])), np.diff(np.concatenate(([0], far, [n]))))
    return code >> np.uint64(2), doc, (code & np.uint64(3)).astype(np.int8)


def _packed(found, buckets):
    """Rows of PACKED, a bucket each, for (doc, signatures, flags) of some documents."""
    found.sort(key=lambda x: x[0])
    doc = np.repeat(np.array([x[0] for x in found], np.int64), [len(x[1]) for x in found])
    sig, flag = (np.concatenate(x) for x in list(zip(*found))[1:])
    bucket = (sig >> np.uint64(48)) % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    sig, doc, flag, bucket = sig[order], doc[order], flag[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=buckets)).tolist() + [len(sig)]
    rows = [pack(sig[a:z], doc[a:z], flag[a:z]) for a, z in zip(cut, cut[1:])]
    none = pa.nulls(len(rows), pa.int64())
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cut[:-1]].astype(np.int32)), "data": pa.array(rows, pa.binary()),
                                       "sig": none, "other": none, "doc": none, "flag": pa.nulls(len(rows), pa.int32())})


def _emit_rows(size, num, den, buckets):
    """One pass over the texts. Signatures, packed by bucket. Document rows: of sets new to the task
    sig and other are the fingerprint, else other is the task's document with the same set."""
    def run(batches):
        bands, seen = Bands(num, den), {}
        sketch, docs, found, waiting = np.zeros(SKETCH, np.int64), 0, [], 0
        for batch in batches:
            for part in slices(batch, "text", limit=1 << 20):
                sets, ids = _sets(part, size), part.column("doc_id").to_pylist()
                for s in sets:
                    sketch[(s & np.uint64(SKETCH - 1)).astype(np.int64)] += 1
                docs += len(sets)
                noise = 1.5 * sketch.sum() / SKETCH
                rows = []
                for s, i in zip(sets, ids):
                    prints = fingerprint(s)
                    first = seen.setdefault(prints, i) if len(s) and i is not None else i
                    if not len(s) or i is None or prints in seen and first != i:
                        rows.append((None, first, i, -(4 * len(s) + COPY)))
                        continue
                    rows.append((*prints, i, -(4 * len(s) + FIRST)))
                    cost = np.maximum(sketch[(s & np.uint64(SKETCH - 1)).astype(np.int64)] - noise, 0) / max(docs, 200)
                    sig, flag = signatures(s, bands, cost)
                    found.append((i, sig, flag))
                    waiting += len(sig)
                    if waiting >= FLUSH:
                        yield _packed(found, buckets)
                        found, waiting = [], 0
                columns = {c: pa.array([r[k] for r in rows], pa.int32() if c == "flag" else pa.int64())
                           for k, c in enumerate(("sig", "other", "doc", "flag"))}
                yield pa.RecordBatch.from_pydict({"bucket": pa.array((docs + np.arange(len(rows))) % buckets, pa.int32()),
                                                  "data": pa.nulls(len(rows), pa.binary()), **columns})
        if waiting:
            yield _packed(found, buckets)
    return run


LEAD = 4  # flag of a row that has led its signature before


def _led(sig, doc, flag, last):
    """((leader, document) of what shares a signature, the leaders' rows unless this is the last call)."""
    order = np.lexsort((doc, flag < LEAD, sig))
    sig, doc, flag = sig[order], doc[order], flag[order]
    begin = np.flatnonzero(np.diff(sig, prepend=~sig[:1]))
    lead = np.repeat(doc[begin], np.diff(np.append(begin, len(sig))))
    met = np.bitwise_or.reduceat(flag, begin)
    # Of a bucket in one piece, signatures count that are indexed by one and probed by one at least.
    counts = np.repeat((met >= 3) if last else np.ones(len(begin), bool), np.diff(np.append(begin, len(sig))))
    pick = counts & (lead != doc)
    rest = None if last else (sig[begin], doc[begin], met | np.int8(LEAD))
    return np.stack((lead[pick], doc[pick])), rest


def _pairs(found):
    lead, doc = np.concatenate(found, axis=1)
    order = np.lexsort((doc, lead))
    lead, doc = lead[order], doc[order]
    new = np.ones(len(lead), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (doc[1:] != doc[:-1])
    lead, doc = lead[new], doc[new]
    for a in range(0, len(lead), 1 << 17):
        n = len(lead[a:a + (1 << 17)])
        yield pa.RecordBatch.from_pydict({"sig": pa.array(lead[a:a + n]), "other": pa.nulls(n, pa.int64()),
                                          "doc": pa.array(doc[a:a + n]), "flag": pa.array(np.ones(n, np.int32))})


def _reduce_rows(batches):
    """Packed rows sorted by bucket -> (leader, document) as sig and doc with flag 1, and the document rows as they are.

    A bucket of more than HELD signatures is reduced as it comes: every signature keeps its first leader."""
    key, parts, held, found, many = None, [], 0, [], 0

    def reduced(last):
        nonlocal parts, held, many
        pairs, rest = _led(*(np.concatenate(x) for x in zip(*parts)), last)
        parts, held = ([], 0) if last else ([rest], 0)
        if pairs.size:
            found.append(pairs)
            many += pairs.shape[1]

    for batch in batches:
        documents = batch.filter(pc.is_valid(batch.column("flag")))
        if documents.num_rows:
            yield documents.select(["sig", "other", "doc", "flag"])
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data")):
            if not data.is_valid:
                continue
            if bucket != key and parts:
                reduced(True)
            key = bucket
            parts.append(unpack(data.as_buffer()))
            held += len(parts[-1][0])
            if held >= HELD:
                reduced(False)
            if many >= 1 << 20:
                yield from _pairs(found)
                found, many = [], 0
    if parts:
        reduced(True)
    if found:
        yield from _pairs(found)


def common_elements(sets, columns=4096):
    """Matrix of the sizes of all intersections."""
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, name, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1  # elements of one set only meet nothing
    shared = count[name] > 1
    at, name = at[shared], place[name[shared]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(name, kind="stable")
    at, name = at[order], name[order]
    for first in range(0, int(name[-1]) + 1 if len(name) else 0, columns):
        a, z = np.searchsorted(name, (first, first + columns))
        m = np.zeros((len(sets), columns), np.float32)
        m[at[a:z], name[a:z] - first] = 1
        out += m @ m.T
    return out.astype(np.int64)


def forest(linked):
    """(index, smallest index it reaches) of every row of a symmetric matrix that reaches another."""
    out, open_ = [], np.ones(len(linked), bool)
    for i in range(len(linked)):
        if open_[i]:
            reached = np.zeros(len(linked), bool)
            edge = reached.copy()
            edge[i] = True
            while edge.any():
                reached |= edge
                edge = linked[edge].any(0) & ~reached
            open_ &= ~reached
            out += [(j, i) for j in np.flatnonzero(reached).tolist() if j != i]
    return out


def _verify(size, num, den):
    """Texts sorted by (lead, a, b) -> links of every such unit."""
    def links(rows):
        ids = np.array([r[0] for r in rows])
        order = np.argsort(ids, kind="stable")
        ids, own = ids[order], np.array([rows[k][1] for k in order])
        sets = [rows[k][2] for k in order]
        size = np.array([len(s) for s in sets])
        if len(sets) == 2:
            both = np.zeros((2, 2), np.int64)
            both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        else:
            both = common_elements(sets)
        linked = den * both >= num * (size[:, None] + size - both)
        if own.min() != own.max():
            linked &= own[:, None] != own
        np.fill_diagonal(linked, False)
        return [(int(ids[a]), int(ids[b])) for a, b in forest(linked)]

    def run(batches):
        key, rows = None, []

        def flush():
            found = links(rows) if len(rows) > 1 else []
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()),
                                                  "b": pa.array([f[1] for f in found], pa.int64())})

        for batch in batches:
            for part in slices(batch, "text", limit=1 << 20):
                columns = [part.column(c).to_pylist() for c in ("lead", "a", "b", "own", "doc")]
                for lead, a, b, own, doc, s in zip(*columns, _sets(part, size)):
                    if (lead, a, b) != key:
                        yield from flush()
                        key, rows = (lead, a, b), []
                    rows.append((doc, own, s))
        yield from flush()
    return run


def _verified(star, texts, size, num, den):
    """Links among the documents of each leader, the leader included, of rows (lead, rep, n)."""
    blocks = star.groupBy("lead").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocks = staged(blocks, "blocks")  # a table, so that the join with a leader of many documents may be split
    members = star.select("lead", "rep").unionByName(star.select("lead", F.col("lead").alias("rep")).distinct())
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    units = members.hint("merge").join(blocks, "lead").withColumn("own", own).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.groupBy("rep").agg(F.collect_list(F.struct(
        "lead", F.least("own", "j").alias("a"), F.greatest("own", "j").alias("b"), "own")).alias("units"))
    # The documents in play grow with the corpus and have no proven bound: never a broadcast.
    involved = units.hint("merge").join(texts, F.col("rep") == F.col("doc_id"))
    sent = involved.select(F.explode("units").alias("unit"), F.col("rep").alias("doc"), "text").select("unit.*", "doc", "text")
    return sent.repartition("lead", "a", "b").sortWithinPartitions("lead", "a", "b").mapInArrow(
        tidy(_verify(size, num, den)), "a long, b long")


def _open_groups(star, first, found):
    """Rows of `star` whose leader's group has documents that neither one group of the first round compared
    nor one component has. `first`: (rep, lead) of that round; two of one leader in it have been compared."""
    round_ = first.select(F.col("rep").alias("node"), F.col("lead").alias("with"))
    names = found.select("node", "root").join(round_.hint("merge"), "node", "full")
    ends = star.select("lead", "rep").unionByName(star.select("lead", F.col("lead").alias("rep")).distinct())
    ends = ends.hint("merge").join(names, F.col("rep") == F.col("node"), "left").select(
        "lead", F.coalesce("root", "rep").alias("root"), F.coalesce("with", "rep").alias("with"), (F.col("with") == F.col("lead")).alias("here"))
    groups = ends.groupBy("lead").agg(*(f(c).alias(f"{k}_{c}") for c in ("root", "with") for k, f in (("low", F.min), ("high", F.max))),
                                      F.count("*").alias("all"), F.count_if("here").alias("compared"))
    groups = groups.filter("low_root <> high_root AND low_with <> high_with AND all - 1 > compared").select("lead")
    return star.hint("merge").join(staged(groups, "open"), "lead", "left_semi")


def similar_groups(docs, size=4, num=85, den=100):
    """Components of documents whose shingle sets have |r & s| / |r | s| >= num / den.

    doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("doc_id", "text")
    buckets = min(1 << 16, 1 << (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    rows = texts.mapInArrow(tidy(_emit_rows(size, num, den, buckets)), PACKED)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_reduce_rows), ROWS)
    rows = staged(rows, "signatures")

    kind, n = F.pmod(-F.col("flag"), F.lit(4)), F.floor(-F.col("flag") / 4)
    firsts = rows.filter("flag < 0").filter(kind == FIRST).select("sig", "other", "doc", n.cast("long").alias("n"))
    copies = rows.filter("flag < 0").filter(kind == COPY).select("doc", n.cast("long").alias("n"), F.col("other").alias("of"))
    reps = firsts.groupBy("sig", "other").agg(F.min("doc").alias("rep"))
    firsts = staged(firsts.hint("merge").join(reps, ["sig", "other"]).select("doc", "n", "rep"), "firsts")
    one_each = staged(firsts.groupBy("doc").agg(F.min("rep").alias("rep"), F.max("n").alias("n")), "sets")

    # Documents under their leaders, both by their set (its smallest document).
    star = rows.filter("flag > 0").select(F.col("sig").alias("lead"), "doc").repartition("doc").distinct()
    star = star.join(one_each.hint("merge"), "doc").select("lead", "rep", "n").distinct()
    leads = one_each.select(F.col("doc").alias("lead"), F.col("rep").alias("to"))
    star = star.join(leads.hint("merge"), "lead").filter("to <> rep").select(F.col("to").alias("lead"), "rep", "n")
    star = staged(star.groupBy("lead", "rep").agg(F.max("n").alias("n")), "leaders")

    first = staged(star.groupBy("rep").agg(F.min("lead").alias("lead"), F.max("n").alias("n")), "first")
    links = _verified(first, texts, size, num, den)
    # Copies: the task's first document to the smallest first one, and to the smallest copy in its task.
    links = links.unionByName(firsts.filter("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))).unionByName(
        copies.groupBy("of").agg(F.min("doc").alias("b")).filter("of <> b").select(F.col("of").alias("a"), "b"))
    found = staged(components(links), "components")
    rest = staged(_open_groups(star, first, found), "rest")
    if not rest.isEmpty():
        links = _verified(rest, texts, size, num, den).unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        found = staged(components(links), "components")

    known = firsts.select("doc", "n", F.col("doc").alias("of")).unionByName(copies)
    known = known.join(found, F.col("of") == F.col("node"), "left")
    return known.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.when(F.col("doc").isNotNull(), F.coalesce("root", "of")).alias("component_id"))


def one_of_each_group(docs, **how):
    """The documents with the smallest doc_id of their group; rows with a null doc_id stay."""
    groups = similar_groups(docs, **how)
    name, = free_names(docs, "_gone")
    gone = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col(name), "left_anti")
