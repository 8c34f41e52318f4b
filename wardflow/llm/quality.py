"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every statistic comes from the whole text: shares of kinds of characters, of words and of lines, how
often they repeat, their lengths. Each is put into at most 64 bins by quantiles of the sample; trees
grow leaf by leaf on histograms of the bins' gradients. A trained model is a few arrays over the nodes
of all trees, and scoring moves a matrix (documents x trees) of node numbers down a level at a time.

Training takes at most `sample` labelled documents, chosen by a hash of doc_id; they are fetched as
statistics, not as texts. Neither labels nor lang, source or doc_id are inputs of a score.

Defined results: a null or empty text has statistics of zero and the score learned for them; repeated
rows get equal results; a label whose quality or doc_id is null is no label, and of several for a
document the largest counts; an empty table gives an empty frame; with labels of one kind every score is
their share, without labels there are no trees (None), every score is 0.5 and no row is filtered; other
columns pass through, and columns named like the new ones are replaced.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm import pieces
from wardflow.llm.common import free_names, held_out, ship, slices, staged, tidy

STATISTICS = ("bytes", "words", "lines", "word_length", "line_length", "upper", "lower", "digit", "space", "beyond_ascii", "stop",
              "mark", "entropy", "distinct_words", "top_word", "distinct_lines", "repeated_line_bytes", "marked_words",
              "upper_words", "one_letter_words", "long_words", "top_mark", "distinct_pairs", "digit_words")

_KIND = np.zeros(256, np.int64)  # other marks 0, upper 1, lower 2, digit 3, space 4, beyond ASCII 5, sentence ends 6
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 5 if _b >= 128 else 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 4 if _c.isspace() else 6 if _c in ".,;:?" else 0


def statistics(text):
    """The statistics of one text in bytes."""
    n = len(text)
    if n == 0:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kind = np.bincount(_KIND, count, 7) / n
    p = count[count > 0] / n
    words = text.split()
    w = len(words) or 1
    often = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    rows = len(lines) or 1
    line_often = Counter(lines)
    repeated = sum(len(x) * (k - 1) for x, k in line_often.items() if k > 1)
    marks = np.where(_KIND == 0, count, 0)
    distinct = len(often)
    marked = upper = single = long = digits = 0
    for x, k in often.items():
        marked += k * (x[-1] < 65 and x[-1] not in b".,;:?" or 0x5A < x[-1] < 0x61 or 0x7A < x[-1] < 0x80)
        upper += k * x.isupper()
        single += k * (len(x) == 1)
        long += k * (len(x) > 15)
        digits += k * x.isdigit()
    return [math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), (n - count[32]) / w, n / rows, kind[1], kind[2], kind[3],
            kind[4], kind[5], kind[6], kind[0], float(-(p * np.log2(p)).sum()), distinct / w, max(often.values(), default=0) / w,
            len(line_often) / rows, repeated / n, marked / w, upper / w, single / w, long / w, float(marks.max()) / n,
            len(set(zip(words, words[1:]))) / max(1, len(words) - 1), digits / w]


def matrix(column):
    buf, offsets = pieces.texts(column)
    return np.array([statistics(buf[a:z]) for a, z in zip(offsets, offsets[1:])], np.float64).reshape(-1, len(STATISTICS))


class Trees:
    """Boosted trees as flat arrays: feature, threshold, left, right, value by node; the trees' roots."""

    def __init__(self, feature, threshold, left, right, value, roots, depth, base):
        self.feature, self.threshold, self.left, self.right = feature, threshold, left, right
        self.value, self.roots, self.depth, self.base = value, roots, depth, base

    def score(self, x):
        """Probability of label 1 for rows of statistics; a leaf is its own child."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[node].sum(1), -30, 30)))


def fit(x, y, rounds=60, leaves=16, rate=0.15, bins=64, least=20, ridge=1.0):
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    flat = binned + np.arange(x.shape[1]) * bins
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(y), base)
    feature, threshold, left, right, value, roots, depth = [], [], [], [], [], [], 1

    def node():
        k = len(feature)
        for a, v in ((feature, 0), (threshold, 0.0), (left, k), (right, k), (value, 0.0)):
            a.append(v)
        return k

    def histogram(rows, g, h):
        size = x.shape[1] * bins
        at = flat[rows].ravel()
        rep = x.shape[1]
        return np.stack([np.bincount(at, np.repeat(v[rows], rep), size) for v in (g, h)] + [np.bincount(at, minlength=size)]).reshape(3, rep, bins)

    def best(hist):
        run = hist.cumsum(2)
        total = run[:, :, -1:]
        rest = total - run
        gain = run[0] ** 2 / (run[1] + ridge) + rest[0] ** 2 / (rest[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
        gain[(run[2] < least) | (rest[2] < least)] = -1
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        return float(gain[f, b]), int(f), int(b)

    for _ in range(rounds if y.min() < y.max() else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        hist = histogram(np.arange(len(y)), g, h)
        open_ = [(best(hist), root, np.arange(len(y)), hist, 0)]
        done = []
        while open_ and len(open_) + len(done) < leaves:
            k = max(range(len(open_)), key=lambda i: open_[i][0][0])
            (gain, f, b), at, rows, hist, level = open_.pop(k)
            if gain <= 1e-6 or b >= len(edges[f]):
                done.append((at, rows))
                continue
            low = binned[rows, f] <= b
            small = rows[low] if low.sum() * 2 <= len(rows) else rows[~low]
            part = histogram(small, g, h)
            parts = (part, hist - part) if low.sum() * 2 <= len(rows) else (hist - part, part)
            a, z = node(), node()
            feature[at], threshold[at], left[at], right[at] = f, float(edges[f][b]), a, z
            depth = max(depth, level + 1)
            for child, own, its in ((a, rows[low], parts[0]), (z, rows[~low], parts[1])):
                open_.append((best(its), child, own, its, level + 1))
        for at, rows in done + [(o[1], o[2]) for o in open_]:
            value[at] = float(-rate * g[rows].sum() / (h[rows].sum() + ridge))
            raw[rows] += value[at]
    return Trees(*(np.array(a) for a in (feature, threshold, left, right, value, roots)), depth, base)


def train(docs, labels, sample=20_000):
    """Trees learned from labelled documents that are not held out; None where there are none."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # At most `sample` rows of 12 bytes, written: Spark knows their size and need not shuffle the texts to meet them.
    chosen = staged(known.orderBy(F.xxhash64("doc_id", F.lit(43)), "doc_id").limit(sample), "sample")
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "quality", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", limit=1 << 20):
                x = matrix(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())],
                                                 names=["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, "doc_id long, quality int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    y = (got["quality"].to_numpy() == 1).astype(float)
    if y.size == 0:
        return None
    return fit(np.frombuffer(b"".join(got["x"].to_pylist()), np.float64).reshape(len(y), -1), y)


NEW = ("score", "predicted")


def score(df, trees, text="text", keep=None, at_least=0.7, new=NEW):
    """`df` (columns `keep`, default all) with score and predicted (1 where score >= at_least), named `new`."""
    ship(df.sparkSession)
    keep = [c for c in (keep or df.columns) if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.IntegerType())])

    if trees is None:
        return df.select(*keep, F.lit(0.5).alias(new[0]), F.lit(int(at_least <= 0.5)).alias(new[1]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, limit=1 << 20):
                p = trees.score(matrix(part.column(text)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(p), pa.array((p >= at_least).astype(np.int32))], names=[*keep, *new])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run), schema)


def of_good_quality(docs, trees, at_least=0.7):
    """The rows whose text is predicted to be of good quality."""
    if trees is None:
        return docs
    new = free_names(docs, "_quality", "_good")
    return score(docs, trees, at_least=at_least, new=new).filter(F.col(new[1]) == 1).select(docs.columns)


def quality_report(docs, labels):
    """doc_id, held_out, score and predicted of every document."""
    return score(docs.select("doc_id", "text"), train(docs, labels), keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
