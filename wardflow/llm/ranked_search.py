"""The k best documents for each item by a lexical score, found by NRA (no random access).

Documents are dealt in blocks, as the shards of an index. Within a block every term of an item has a list of
postings sorted by impact, the summand that it adds to the score, highest first. The lists are only read from the
top: each round reads all lists of an item down to one lower impact. For each document met this gives an interval:
the lower end is the sum of the impacts read, the upper end adds, for each list in which the document was not met,
the highest impact not yet read there. A document that was not met at all has the sum of these as its upper end.
With the k-th highest lower end as bar,

* documents whose upper end is below the bar leave;
* an item is done when the unmet are below the bar and every document left has one number for an interval, so that
  members, ties and scores are certain. At the end of all lists every interval is a number.

The bar of an item is carried from block to block of a task, so later blocks stop sooner. A block gives its k best
per item (all that tie with the k-th are considered, smallest doc_id first), and the best of these are the result:
nothing but k rows per item and block is shuffled. Blocks have at most `block` postings (2 million), one document
at least.

Scores are those of the contract: terms are maximal runs of ASCII letters and digits and of all characters
beyond ASCII, only A-Z lower-cased; weights w are floor(1000 ln((2N + 2) / (2 df + 1))); the rest is integer.

Defined results: a null or empty text has no terms, is not counted and never found; a row is a document, so
rows with one doc_id are found each by itself; a null doc_id stands last among equal scores; a benchmark
row is an item, also where ids repeat or are null; items without terms, or whose terms have no weight,
have no rows; other columns are not read. Where the distinct terms of the items hold `shipped` bytes at most
(16 MB) they go to the tasks as a filter; beyond that terms are counted unfiltered, and the items are worked on in
portions of that size, which tasks read from the shared folder.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardflow.llm.common import filesystem, ship, slices, staged, tidy

STEPS = (64, 16, 4, 1)  # shares of an item's postings that its rounds read to
SHIPPED = 16 << 20
BLOCK = 2 << 20

_kept = [*range(48, 58), *range(97, 123), *range(128, 256)]
FOLD = bytes(c if c in _kept else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(data):
    """The terms of a text in UTF-8, in order, repeats included."""
    return data.translate(FOLD).split()


def _counts(key, keep):
    """Per text with a term: its key, number of terms, and the distinct terms (those in `keep`) with counts."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys, sizes, bounds, names, counts = [], [], [0], [], []
                for k, text in zip(part.column(key).to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    words = terms(text or b"")
                    if words:
                        found = Counter(words)
                        chosen = list(found) if keep is None else [t for t in found if t in keep]
                        keys.append(k)
                        sizes.append(len(words))
                        names += chosen
                        counts += [found[t] for t in chosen]
                        bounds.append(len(names))
                bounds = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_pydict({
                    key: pa.array(keys, part.column(key).type), "n": pa.array(sizes, pa.int64()),
                    "terms": pa.ListArray.from_arrays(bounds, pa.array(names, pa.binary())),
                    "counts": pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int64()))})
    return tidy(run)


def counted(df, key, keep=None):
    """`key`, n, terms and counts of the rows of `df` whose text has a term."""
    kind = df.schema[key].dataType.simpleString()
    return staged(df.select(key, "text").mapInArrow(
        _counts(key, keep), f"{key} {kind}, n long, terms array<binary>, counts array<long>"), "terms")


class Lists:
    """The impact-sorted lists of a block: documents and impacts of term t at bounds[t]:bounds[t + 1]."""

    def __init__(self, term, doc, impact, n_terms, n_docs):
        order = np.lexsort((-impact, term))
        self.docs, self.impacts = doc[order], impact[order]
        self.bounds = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.n_docs = n_docs

    def best(self, terms, k, bar):
        """(documents, scores) that may be among the k best of all: the k best here with all their ties, where
        they reach `bar`; and the bar after it."""
        spans = [(a, z) for a, z in zip(self.bounds[terms], self.bounds[terms + 1]) if a < z]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), bar
        every = np.concatenate([self.impacts[a:z] for a, z in spans])
        low = np.zeros(self.n_docs, np.int64)
        read = [a for a, _ in spans]
        for share in STEPS:
            at = len(every) - 1 - len(every) // share
            least = np.partition(every, at)[at] if share > 1 else 0
            unread = []
            for i, (a, z) in enumerate(spans):
                upto = a + int(np.searchsorted(-self.impacts[a:z], -least, "right"))
                low[self.docs[read[i]:upto]] += self.impacts[read[i]:upto]
                read[i] = upto
                unread.append(int(self.impacts[upto]) if upto < z else 0)
            if self.n_docs >= k:
                bar = max(bar, int(np.partition(low, -k)[-k]))
            unmet = sum(unread)
            if unmet >= bar:
                continue  # a document not met yet could still belong
            high = low + unmet
            for (a, _), upto, rest in zip(spans, read, unread):
                high[self.docs[a:upto]] -= rest
            left = np.flatnonzero((high >= bar) & (low > 0))
            if (low[left] == high[left]).all():
                break  # at the latest with the last share, where nothing is unread
        return left, low[left], bar


def _items(path):
    """(item numbers, their term numbers as arrays, terms, weights) of a portion of items."""
    fs, at = filesystem(path)
    rows = ds.dataset(at, filesystem=fs, format="parquet").to_table().sort_by([("item", "ascending"), ("term", "ascending")])
    terms = pc.unique(rows.column("term").combine_chunks())
    number = pc.index_in(rows.column("term").combine_chunks(), terms).to_numpy(zero_copy_only=False)
    weights = np.zeros(len(terms), np.int64)
    weights[number] = rows.column("w").to_numpy()
    items, first = np.unique(rows.column("item").to_numpy(), return_index=True)
    return items.tolist(), np.split(number.astype(np.int64), first[1:])[:len(items)], terms, weights


def _best(path, n_docs, n_terms, k, block):
    def run(batches):
        portion, bars = None, None

        def found(parts):
            ids, sizes, counts = (pa.concat_arrays([p[i] for p in parts]) for i in range(3))
            cells = pa.concat_arrays([p[3] for p in parts])
            term = pc.index_in(cells.field(0), portion[2])
            keep = term.is_valid().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(ids)), counts.to_numpy())[keep]
            term = term.drop_null().to_numpy().astype(np.int64)
            tf = cells.field(1).to_numpy(zero_copy_only=False)[keep]
            m = (100 - 90 + 90 * sizes.to_numpy() * n_docs // n_terms)[doc]
            impact = portion[3][term] * (1000000000 * tf // (1000 * tf + 8 * m))
            some = impact > 0
            lists = Lists(term[some], doc[some], impact[some], len(portion[2]), len(ids))
            null = ids.is_null().to_numpy(zero_copy_only=False)
            names = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            out = []
            for i, terms in enumerate(portion[1]):
                left, score, bars[i] = lists.best(terms, k, bars[i])
                order = np.lexsort((names[left], null[left], -score))[:k]
                out += [(portion[0][i], None if null[d] else int(names[d]), int(s)) for d, s in zip(left[order], score[order])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["item", "doc_id", "score"])

        parts, held = [], 0
        for batch in batches:
            if portion is None:
                portion = _items(path)
                bars = [1] * len(portion[0])
            counts = pc.list_value_length(batch.column("terms"))
            ends = np.cumsum(counts.to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, before + block - held, "right")))
                if parts and upto == at + 1 and ends[at] - before > block - held:
                    upto = at
                if upto > at:
                    piece = batch.slice(at, upto - at)
                    cells = pa.StructArray.from_arrays([piece.column("terms").flatten(), piece.column("counts").flatten()], ["term", "tf"])
                    parts.append((piece.column("doc_id").cast(pa.int64()), piece.column("n"), counts.slice(at, upto - at), cells))
                    held += len(cells)
                at = upto
                if at < batch.num_rows or held >= block:
                    yield from found(parts)
                    parts, held = [], 0
        if parts:
            yield from found(parts)
    return tidy(run)


def search(documents, items, k=10, shipped=SHIPPED, block=BLOCK):
    """item_id, rank (from 1), doc_id and score of the k best documents with a score above 0."""
    spark = documents.sparkSession
    ship(spark)
    queries = counted(items, "item_id").withColumn("item", F.monotonically_increasing_id())
    queries = staged(queries.select("item", "item_id", F.explode("terms").alias("term")), "items")
    wanted = staged(queries.select("term").distinct(), "wanted")
    size, number = wanted.agg(F.coalesce(F.sum(F.length("term") + 8), F.lit(0)), F.count("*")).first()
    keep = {bytes(r.term) for r in wanted.collect()} if size <= shipped else None
    docs = counted(documents, "doc_id", keep)
    n_docs, n_terms = docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = docs.select(F.explode("terms").alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(
        F.count("*").alias("df")).select("term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).alias("w"))
    cells = staged(queries.join(weights.filter("w > 0"), "term"), "cells")
    held = cells.agg(F.coalesce(F.sum(F.length("term") + 16), F.lit(0))).first()[0]
    portions = 1 if size <= shipped else -(-held // max(1, shipped))
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for i in range(portions):
        portion = cells if portions == 1 else staged(cells.filter(F.pmod(F.xxhash64("item"), F.lit(portions)) == i), "portion")
        path = portion.inputFiles()[0].rsplit("/", 1)[0] if portion.inputFiles() else None
        if path:
            found = found.unionByName(docs.mapInArrow(_best(path, n_docs, n_terms, k, block), found.schema))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.join(queries.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")
