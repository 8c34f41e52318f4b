"""Language identification with a byte convolutional network trained in numpy.

A text's UTF-8 bytes are cut into windows of `WINDOW` bytes that cover all of it. In a window every
byte has a learned vector; filters two, three and four bytes wide run over it, each filter's largest
answer is kept, and a softmax over these gives the window's language. A text's probabilities are the
mean of its windows', weighted by their bytes.

A filter's answer is a sum over its bytes, so it is looked up: the tables of two neighbouring bytes
(65,536 rows) are made once per task, and a convolution is a few gathers for a whole batch of windows.

Training takes a sample of labelled texts, bounded by `per_language` documents (chosen by a hash of
doc_id) and `windows` windows of each; only those windows reach the driver.

Defined results: a null, empty or letterless text is `und` with score 0; repeated rows get equal
results; an empty table gives an empty frame; without any labelled row there is no network (None), every
text is `und` with score 0, and no row is filtered; other columns pass through, and columns named like
the new ones are replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm import pieces
from wardflow.llm.common import free_names, held_out, ship, slices, tidy

WINDOW, VECTOR, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)


def cut(data, window=WINDOW):
    """(n, window) bytes of a text, the last row padded with zeros, and each row's own length."""
    n = max(1, -(-len(data) // window))
    out = np.zeros(n * window, np.uint8)
    out[:len(data)] = data
    size = np.full(n, window)
    size[-1] = len(data) - (n - 1) * window
    return out.reshape(n, window), size


class Network:
    def __init__(self, names, seed=7):
        rng = np.random.default_rng(seed)
        self.names = list(names)
        self.p = {"vector": rng.normal(0, 0.5, (256, VECTOR)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))),
                  "bias": np.zeros(len(names))}
        for k in WIDTHS:
            self.p[f"w{k}"] = rng.normal(0, 0.3, (k, VECTOR, FILTERS))
            self.p[f"b{k}"] = np.zeros(FILTERS)
        self.pairs = None

    def tables(self, k):
        return [(self.p["vector"] @ self.p[f"w{k}"][j]).astype(np.float32) for j in range(k)]

    def prepare(self):
        """Tables for two bytes at once."""
        self.pairs = {}
        for k in WIDTHS:
            t = self.tables(k)
            two = lambda a, b: (a[:, None] + b[None, :]).reshape(65536, FILTERS)
            self.pairs[k] = [two(t[j], t[j + 1]) for j in range(0, k - 1, 2)] + ([t[-1]] if k % 2 else [])

    def pooled(self, x):
        """(n, filters) largest answers of each filter over each window."""
        if self.pairs is None:
            self.prepare()
        two = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        out = []
        for k in WIDTHS:
            n = WINDOW - k + 1
            total = None
            for j, table in enumerate(self.pairs[k]):
                part = np.take(table, (two if len(table) > 256 else x)[:, 2 * j:2 * j + n], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            out.append(total.max(1) + self.p[f"b{k}"].astype(np.float32))
        return np.maximum(np.concatenate(out, 1), 0)

    def probabilities(self, x):
        z = self.pooled(x) @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x, y, epochs=4, batch=128, rate=0.01, seed=11):
        """Adam on cross-entropy; only the places that won the pooling get a gradient."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a:a + batch]
                grad = self._gradient(x[rows], y[rows])
                step += 1
                for k, g in grad.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    m, s = mean[k] / (1 - 0.9 ** step), square[k] / (1 - 0.999 ** step)
                    self.p[k] = self.p[k] - rate / (1 + epoch) * m / (np.sqrt(s) + 1e-8)
        self.pairs = None
        return self

    def _gradient(self, x, y):
        pooled, winner = [], []
        for k in WIDTHS:
            n = WINDOW - k + 1
            total = sum(np.take(t, x[:, j:j + n], axis=0) for j, t in enumerate(self.tables(k)))
            best = total.argmax(1)
            winner.append(best)
            pooled.append(np.take_along_axis(total, best[:, None, :], 1)[:, 0] + self.p[f"b{k}"])
        a = np.concatenate(pooled, 1)
        h = np.maximum(a, 0)
        z = h @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        dz = z / z.sum(1, keepdims=True)
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        grad = {"out": h.T @ dz + 1e-4 * self.p["out"], "bias": dz.sum(0), "vector": np.zeros_like(self.p["vector"])}
        da = dz @ self.p["out"].T * (a > 0)
        for i, k in enumerate(WIDTHS):
            d = da[:, i * FILTERS:(i + 1) * FILTERS]
            w = self.p[f"w{k}"]
            grad[f"b{k}"], grad[f"w{k}"] = d.sum(0), np.zeros_like(w)
            for j in range(k):
                dt = np.zeros((256, FILTERS))
                byte = np.take_along_axis(x, winner[i] + j, 1)
                np.add.at(dt, (byte, np.arange(FILTERS)[None, :]), d)
                grad[f"w{k}"][j] = self.p["vector"].T @ dt
                grad["vector"] += dt @ w[j].T
        return grad


def sample_windows(docs, counts, per_language, windows):
    """Rows (lang, bytes): some windows of the sampled documents, at places that a hash chooses."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1_000_003)) / 1_000_003
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))) for name, n in counts], F.lit(0.0))
    chosen = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).filter(part < share)

    def run(batches):
        for batch in batches:
            langs, out = [], []
            for lang, text, i in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()):
                x, size = cut(np.frombuffer(text.encode(), np.uint8))
                rng = np.random.default_rng(abs(i or 0))
                for k in rng.permutation(len(x))[:windows].tolist():
                    if size[k] >= 16:
                        langs.append(lang)
                        out.append(x[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "bytes"])

    return chosen.select("doc_id", "lang", "text").mapInArrow(run, "lang string, bytes binary")


def train(docs, per_language=1500, windows=3):
    """A network learned from (doc_id, lang, text), held-out rows left aside; None without such rows."""
    ship(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = sorted((r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not counts:
        return None
    rows = sample_windows(docs, counts, per_language, windows).toArrow().sort_by([("lang", "ascending"), ("bytes", "ascending")])
    names = [c[0] for c in counts]
    x = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    y = np.array([names.index(v) for v in rows["lang"].to_pylist()], np.int64)
    return Network(names).fit(x, y)


NEW = ("lang_pred", "score")


def identify(df, network, text="text", keep=None, new=NEW):
    """`df` (columns `keep`, default all) with the language of its text and its score, named `new`."""
    ship(df.sparkSession)
    keep = [c for c in (keep or df.columns) if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType())])
    if network is None:
        return df.select(*keep, F.lit("und").alias(new[0]), F.lit(0.0).alias(new[1]))
    network.pairs = None
    names, at_once = network.names, 1024

    def answers(part):
        buf, offsets = pieces.texts(part.column(text))
        whole = np.frombuffer(buf, np.uint8)
        # A text without a letter: no ASCII letter, and no letter beyond ASCII.
        letter = [any(c.isalpha() for c in buf[a:z].decode("utf-8", "replace")) for a, z in zip(offsets, offsets[1:])]
        total, weight = np.zeros((len(letter), len(names))), np.zeros(len(letter))
        held, owner, sizes = [], [], []

        def flush():
            p = network.probabilities(np.concatenate(held))
            o, w = np.concatenate(owner), np.concatenate(sizes)
            np.add.at(total, o, p * w[:, None])
            np.add.at(weight, o, w)
            held.clear(), owner.clear(), sizes.clear()

        count = 0
        for i, (a, z) in enumerate(zip(offsets, offsets[1:])):
            for b in range(a, z, WINDOW * at_once) if letter[i] else ():
                x, size = cut(whole[b:min(z, b + WINDOW * at_once)])
                held.append(x)
                owner.append(np.full(len(x), i))
                sizes.append(size)
                count += len(x)
                if count >= at_once:
                    flush()
                    count = 0
        if held:
            flush()
        mean = total / np.maximum(weight, 1)[:, None]
        best = mean.argmax(1)
        return ([names[b] if ok else "und" for b, ok in zip(best, letter)],
                np.where(letter, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, limit=1 << 20):
                lang, score = answers(part)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score)],
                                                 names=[*keep, *new])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run), schema)


def in_known_languages(docs, network, least=0.3):
    """The rows whose text has letters and a language with a score of at least `least`."""
    if network is None:
        return docs
    lang, sure = free_names(docs, "_language", "_language_score")
    found = identify(docs, network, new=(lang, sure))
    return found.filter((F.col(lang) != "und") & (F.col(sure) >= least)).select(docs.columns)


def language_report(docs):
    """doc_id, held_out, lang_pred and score of every document, by a network learned from the rest."""
    network = train(docs)
    return identify(docs.select("doc_id", "text"), network, keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
