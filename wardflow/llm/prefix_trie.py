"""Prefix trie of rebuilt conversations, rolled up in bands of depth.

Every conversation c is rebuilt: the first h turns of conversation c - c % 100, then its own turns after
its first h, with h = crc32(decimal c) % 6. A node of the trie is a distinct sequence of first d rebuilt
turns; its members are the conversations that start with it.

Depths are cut into bands of `height`. A node's totals first go to its ancestors within its band only
(at most `height` rows a node); the tops of the bands form a trie of their own, `height` times less deep,
that is rolled up in the same way; then the completed total of each band's top goes to the ancestors in
the band above. Rounds grow with the logarithm of the depth, explosion is at most `height` a round. The
names of the nodes are built over the same bands, so no conversation is ever gathered in one row or task:

* only a digest and a length of each turn are shuffled, never its text;
* turns are numbered by ranges of (conversation, turn), so a conversation of any length is split;
* sums and counts are partial aggregates; ids of conversations that end in a node are joined to text in
  blocks of 1,024 ids and hashed as a stream.

Defined results: a null role or text counts as empty; turns that are null come first; turns with one
number are ordered by the digest of (role, text), so repeated rows are repeated turns; rows without a
conv_id belong to no conversation; an empty table has no nodes, not even a root; other columns are not read.
Two sequences are one node where 128 bits of SHA-256 over their turns agree.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardflow.llm.common import ship, staged

HEIGHT = 8
MOST_SHARED = 5  # h is a remainder of 6
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _root():
    return F.unhex(F.lit("00" * 16))


def _digest(value):
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def _numbered(conversations):
    """(turns, conversations): turns with conv_id, part, last (number of the last of n equal rows), n, item
    and len; one row per conversation and part with before (turns in earlier parts) and own (all its turns)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("item"),
        F.length(text).cast("long").alias("len"))
    turns = staged(turns.groupBy("conv_id", "turn", "item", "len").agg(F.count("*").alias("n")), "turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "item"]
    turns = staged(turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turn-ranges")
    parts = turns.groupBy("conv_id", "part").agg(F.sum("n").alias("here"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"),
                         F.sum("here").over(whole).alias("own"))
    numbered = turns.withColumn("last", F.sum("n").over(
        Window.partitionBy("conv_id", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)))
    return numbered, staged(parts, "turn-parts")


def rebuilt(conversations):
    """(steps, conversations): conv_id, depth (from 1), item, len and ends (the last turn) of every rebuilt
    turn; conv_id and turnless of every conversation."""
    turns, parts = _numbered(conversations)
    heads = parts.filter("before = 0").select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h"),
                                              (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    lengths = heads.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    heads = staged(heads.join(lengths, "base", "left").withColumn(
        "shared", F.least("h", F.coalesce("base_own", F.lit(0)))).drop("base_own"), "conversations")

    known = parts.join(heads.select("conv_id", "h", "shared"), "conv_id")
    turns = staged(turns.join(known, ["conv_id", "part"]).withColumn("number", F.explode(F.sequence(
        F.col("before") + F.col("last") - F.col("n") + 1, F.col("before") + F.col("last")))), "numbered")
    own = turns.filter("number > h").select(
        "conv_id", (F.col("shared") + F.col("number") - F.col("h")).alias("depth"), "item", "len",
        (F.col("number") == F.col("own")).alias("ends"))
    first = turns.filter((F.col("number") <= MOST_SHARED) & (F.col("conv_id") % 100 == 0)).select(
        F.col("conv_id").alias("base"), "number", "item", "len")
    copied = heads.filter("shared > 0").join(first, "base").filter("number <= shared").select(
        "conv_id", F.col("number").alias("depth"), "item", "len",
        ((F.col("number") == F.col("shared")) & (F.col("own") <= F.col("h"))).alias("ends"))
    return own.unionByName(copied), heads.select(
        "conv_id", ((F.col("shared") == 0) & (F.col("own") <= F.col("h"))).alias("turnless"))


def _levels(steps, height):
    """Names of the nodes, band by band: a list with one table per level of bands.

    Level 0 has a row per conversation and depth: key, parent, path (keys from the top of the band down to the
    node), above (for the top of a band: keys of the band above, without its top; else null) and the
    columns of steps. In level i + 1 the tops of level i's bands are the nodes.
    """
    deepest = steps.agg(F.max("depth")).first()[0] or 0
    rest = [c for c in steps.columns if c not in ("conv_id", "depth", "item")]
    runs = steps.groupBy("conv_id", F.floor((F.col("depth") - 1) / height).alias("band")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "item", *rest))).alias("run"))  # at most `height` entries
    runs = runs.withColumn("names", F.transform(F.sequence(F.lit(1), F.size("run")), lambda i: _digest(
        F.array_join(F.transform(F.slice("run", 1, i), lambda s: F.hex(s["item"])), "").cast("binary"))))
    if deepest >= height:  # some node is the top of a band below the first: name these first
        runs = staged(runs, "bands")
        full = (F.size("run") == height) & F.element_at("run", -1)["item"].isNotNull()
        upper = runs.select("conv_id", (F.col("band") + 1).alias("depth"), F.when(full, F.element_at("names", -1)).alias("item"))
        higher = _levels(upper, height)
        tops = higher[0].select("conv_id", (F.col("depth") - 1).alias("band"), F.col("parent").alias("top"), F.col("key").alias("next"))
        runs = runs.join(tops, ["conv_id", "band"])
    else:
        higher = []
        runs = runs.withColumn("top", _root()).withColumn("next", F.lit(None).cast("binary"))
    keys = F.transform("names", lambda x, i: F.when(i + 1 == height, F.col("next")).otherwise(_digest(F.concat(F.col("top"), x))))
    runs = runs.withColumn("keys", F.concat(F.array("top"), keys))
    nodes = runs.select("conv_id", "keys", F.posexplode("run").alias("at", "step")).select(
        "conv_id", "step.*", F.element_at("keys", F.col("at") + 2).alias("key"), F.element_at("keys", F.col("at") + 1).alias("parent"),
        F.when(F.col("at") + 1 == height, F.array(F.element_at("keys", F.col("at") + 2)))
        .otherwise(F.slice("keys", F.lit(1), F.col("at") + 2)).alias("path"),
        F.when(F.col("at") + 1 == height, F.slice("keys", 2, height - 1)).alias("above"))
    return [staged(nodes, "names")] + higher


def _rollup(nodes, levels, sums):
    """Sums over every node's subtree. `nodes`: key, path, above and the summed columns, one row per node;
    `levels`: key, path and above of the levels over them."""
    added = [F.sum(c).cast("long").alias(c) for c in sums]
    within = staged(nodes.select(F.posexplode("path").alias("at", "key"), *sums)
                    .groupBy("key", (F.col("at") == 0).alias("top")).agg(*added), "in-band")
    tops = within.filter("top").drop("top")
    if not levels:
        return within.drop("top")
    done = staged(_rollup(levels[0].join(tops, "key"), levels[1:], sums), "band-tops")
    crossed = nodes.filter("above IS NOT NULL").select("key", "above").join(done, "key").select(F.explode("above").alias("key"), *sums)
    return within.filter("NOT top").drop("top").unionByName(crossed).groupBy("key").agg(*added).unionByName(done)


def _hash_ends(batches):
    """SHA-256 of each key's blocks joined by commas; rows come sorted by key and block."""
    now, state = None, None
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = []
        for key, text in zip(keys, texts):
            if key != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string()))], ["key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def _ends(ended):
    """key, ends_sha256 of (key, conv_id): the ids in ascending order, joined by commas, hashed."""
    blocks = ended.groupBy("key", F.shiftright("conv_id", 10).alias("block")).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text"))  # at most 1,024 ids
    return (blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "text")
            .mapInArrow(_hash_ends, "key binary, ends_sha256 string"))


def prefix_trie(conversations, height=HEIGHT):
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    if height < 2:
        raise ValueError("a band is at least 2 high")
    ship(conversations.sparkSession)
    steps, heads = rebuilt(conversations)
    levels = _levels(staged(steps, "steps"), height)
    members = levels[0].select("key", "parent", "depth", "len", "path", "above", "conv_id", "ends").unionByName(heads.select(
        _root().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("len"), F.array(_root()).alias("path"), F.lit(None).cast("array<binary>").alias("above"),
        "conv_id", F.col("turnless").alias("ends")))
    # All but conv_id follow from the key; as grouping columns they need no buffer of changing size.
    nodes = members.groupBy("key", "parent", "depth", "len", "path", "above").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = staged(nodes, "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")
    higher = [staged(t.filter("item IS NOT NULL").select("key", "path", "above").distinct().unionByName(
        nodes.filter("depth = 0").select("key", "path", "above")), "tops") for t in levels[1:]]
    sums = _rollup(nodes.select("key", "path", "above", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                                ((F.col("n_convs") - 1) * F.col("len")).alias("saved_tokens")), higher, ["n_leaves", "saved_tokens"])
    found = nodes.join(sums, "key").join(_ends(members.filter("ends").select("key", "conv_id")), "key", "left")
    # Children of one node may be many: this join is the last step, so that it may be split.
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return found.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
