"""Benchmark passages in documents, by CGK embedding and bit sampling.

Texts are sequences of words (A-Z in lower case, ASCII punctuation as space). The CGK embedding walks
over a sequence with a pointer: in step t it writes the word under the pointer and moves on if a random
bit of (t, word) is set. Walks over two sequences run apart at an edit and soon fall in step again, so
few edits leave few places where the outputs differ: edit distance becomes Hamming distance. A key is
the words written in a few sampled steps; the number of random walks is raised for every class of
lengths by itself, until items of the class (chosen by a hash) with as many random edits as allowed are
found as often as `target` asks. There is no fixed end: a class goes on while eight more walks take away
a third of what was missed. One that stops gaining is searched exactly, by a count that loses none.

* Items are cut to windows of the largest class length that fits (lengths grow by a quarter); all
  such windows of an item are keyed.
* In the documents every window of every class length is considered. One within the allowed edits of
  an item has at most that many words that occur in no item, counted for all windows at once by a
  running sum; only windows that pass walk. The bound loses none.
* A class searched exactly: a stretch within the allowed edits of an item holds all its words but that
  many, so stretches with fewer words that occur in the item are passed over, the rest are verified.
* Windows that share a key with an item are verified: the item's exact edit distance, in words, to
  the best stretch around the window must be at most floor(rate * words of the item).

The benchmark is taken in portions of at most `portion` bytes, the only data sent to all tasks.

Defined results: null or wordless texts and items match nothing; items below 1 / rate words match
only exactly; repeated documents are each reported, and so are items with equal text; empty tables
give an empty frame; other columns are ignored.
"""

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wardflow.llm import pieces
from wardflow.llm.common import ship, slices, tidy
from wardflow.llm.shingles import mix

PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
WORD = re.compile(rb"\S+")
SAMPLED = 4


def words(text):
    return text.translate(PLAIN).split()


def classes(most):
    """Window lengths 1, 2, ... that grow by a quarter."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


class Walk:
    """One random walk for windows of `n` words, and the steps sampled from it.

    The first sampled step is an early one, so that windows which can share no key stop soon.
    """

    def __init__(self, n, repeat):
        self.n = n
        steps = mix(np.arange(SAMPLED, dtype=np.uint64) + np.uint64(1000 * repeat + 17)) % np.uint64(max(1, 2 * n - 1))
        steps[0] %= np.uint64(6)
        self.sampled = np.unique(steps).astype(np.int64).tolist()
        self.seed = np.uint64(repeat * 7919 + 1)

    def keys(self, symbols, starts, wanted=None):
        """(windows, keys): those of the windows at `starts` that are still in play, and their keys.

        `wanted`: after each sampled step, the sorted partial keys of the items. Returned as `seen` too.
        """
        index, at = np.arange(len(starts)), np.zeros(len(starts), np.int64)
        starts = np.asarray(starts)
        key, seen = np.full(len(starts), self.seed ^ np.uint64(self.n)), []
        for t in range(self.sampled[-1] + 1):
            here = symbols[np.minimum(starts + at, len(symbols) - 1)].astype(np.uint64)
            here[at >= self.n] = self.n + (1 << 40)
            if t in self.sampled:
                key = mix(key ^ (here + np.uint64(t)))
                if wanted is None:
                    seen.append(np.unique(key))
                else:
                    goal = wanted[len(seen)]
                    seen.append(None)
                    ok = goal[np.minimum(np.searchsorted(goal, key), len(goal) - 1)] == key
                    index, at, starts, key, here = index[ok], at[ok], starts[ok], key[ok], here[ok]
                    if not len(index):
                        break
            coin = np.uint64((t + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) ^ self.seed
            at += (mix(here ^ coin) & np.uint64(1)).astype(np.int64)
        return index, key, seen


def edit_distance(item, segment):
    """(least edits between the item and a stretch of the segment, end of that stretch)."""
    j = np.arange(len(segment) + 1)
    row = np.zeros(len(segment) + 1, np.int64)
    for i, w in enumerate(item):
        step = np.concatenate(([i + 1], np.minimum(row[1:] + 1, row[:-1] + (segment != w))))
        row = np.minimum.accumulate(step - j) + j
    end = int(row.argmin())
    return int(row[end]), end


class Benchmark:
    """Keys of all items' windows. `rate`: edits allowed per word of an item."""

    def __init__(self, items, rate=0.2, target=0.95):
        self.rate, self.names, self.items, self.vocabulary = rate, [], [], {}
        for name, text in items:
            found = words((text or "").encode())
            if found:
                self.names.append(name)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]))
        self.distinct = [frozenset(item.tolist()) for item in self.items]
        longest = max(map(len, self.items), default=0)
        lengths = np.array(classes(longest) if longest else [], np.int64)
        self.by_class = {}
        for k, item in enumerate(self.items):
            self.by_class.setdefault(int(lengths[np.searchsorted(lengths, len(item), "right") - 1]), []).append(k)
        # Fewest words of the vocabulary in a window worth a walk.
        self.enough = {n: n - max(self.allowed(len(self.items[k])) for k in ks) for n, ks in self.by_class.items()}
        self.gap, self.walks, self.exact = longest + 1, {}, []
        for n in self.by_class:
            missed = [1.0]  # before each step of two walks
            while missed[-1] > 1 - target:
                if len(missed) > 4 and missed[-1] > missed[-5] * 2 / 3:
                    self.exact.append(n)
                    del self.walks[n]
                    break
                self._key(n, 2 * len(missed))
                missed.append(1 - self._recall(n))

    def allowed(self, size):
        return int(self.rate * size + 1e-9)

    def _key(self, n, repeats):
        ks = self.by_class[n]
        for r in range(len(self.walks.setdefault(n, [])), repeats):
            walk = Walk(n, r)
            gap = np.zeros(n, np.int64)
            text = np.concatenate([x for k in ks for x in (self.items[k], gap)])
            first = np.cumsum([0] + [len(self.items[k]) + n for k in ks])
            starts = np.concatenate([f + np.arange(len(self.items[k]) - n + 1) for f, k in zip(first, ks)])
            owner = np.concatenate([np.full(len(self.items[k]) - n + 1, k) for k in ks])
            _, key, seen = walk.keys(text, starts)
            order = np.argsort(key, kind="stable")
            self.walks[n].append((walk, seen, key[order], owner[order]))

    def _recall(self, only=None, trials=400):
        """Share of items found after as many random edits as allowed, inside other words.

        `only`: of one class; otherwise the least of all classes.
        """
        if only is None:
            return min((self._recall(n, trials) for n in self.by_class), default=1.0)
        rng = np.random.default_rng(5)
        ks = np.array(self.by_class[only])
        ks = ks[np.argsort(mix(ks.astype(np.uint64) + np.uint64(99)), kind="stable")].tolist()
        texts, size = [], 0
        place = []
        for t in range(trials):
            text = self.items[ks[t % len(ks)]].tolist()
            for _ in range(self.allowed(len(text))):
                at, kind = int(rng.integers(len(text))), int(rng.integers(3))
                if kind == 0:
                    text[at] = 0
                elif kind == 1 and len(text) > 1:
                    del text[at]
                else:
                    text.insert(at, 0)
            text = [0] * self.gap + text
            place.append(size)
            size += len(text)
            texts += text
        pairs = self.candidates(np.array(texts + [0] * self.gap), only)
        found = {(int(np.searchsorted(place, s, "right")) - 1, k) for k, s in pairs}
        return sum((t, ks[t % len(ks)]) in found for t in range(trials)) / trials

    def _stretches(self, symbols, k):
        """Places near which every stretch that may be within the allowed edits of an item begins."""
        item, allowed = self.items[k], self.allowed(len(self.items[k]))
        inside = np.zeros(len(self.vocabulary) + 1, bool)
        inside[item] = True
        count = np.concatenate(([0], np.cumsum(inside[symbols])))
        end = np.minimum(np.arange(len(symbols)) + len(item) + allowed, len(symbols))
        at = np.flatnonzero(count[end] - count[:-1] >= len(item) - allowed)
        step = len(item) // 4 + allowed + 1  # as far back as `matches` looks
        return np.unique(-(-at // step) * step).tolist()

    def candidates(self, symbols, only=None):
        """(item, first word of a window) of all windows that share a key with an item, or may match it
        where its class is searched exactly.

        `symbols`: words of texts, each followed by `gap` zeros. `only`: of one class.
        """
        known = np.concatenate(([0], np.cumsum(symbols > 0)))
        out = set()
        for n in self.exact:
            if only in (None, n):
                out.update((k, s) for k in self.by_class[n] for s in self._stretches(symbols, k))
        for n, walks in self.walks.items():
            if only not in (None, n):
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] >= self.enough[n]) if len(symbols) >= n else []
            if not len(starts):
                continue
            for walk, seen, keys, owners in walks:
                index, key, _ = walk.keys(symbols, starts, seen)
                a, z = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                for s, i, j in zip(starts[index].tolist(), a.tolist(), z.tolist()):
                    out.update((k, s) for k in owners[i:j].tolist())
        return sorted(out)

    def matches(self, symbols):
        """(item, first word, word after the last, edits) of verified passages, each stretch once."""
        item, last = None, -1
        for k, s in self.candidates(symbols):
            if k != item:
                item, last = k, -1
            words_ = self.items[k]
            n, edits_allowed = len(words_), self.allowed(len(words_))
            if s < last:
                continue  # within the passage found before
            a, z = max(0, last, s - n // 4 - 1 - edits_allowed), min(len(symbols), s + n + edits_allowed + 1)
            if len(self.distinct[k].difference(symbols[a:z].tolist())) > edits_allowed:
                continue  # an edit takes away one word at most
            edits, end = edit_distance(words_, symbols[a:z])
            if edits <= edits_allowed:
                begin = edit_distance(words_[::-1], symbols[a:a + end][::-1])[1]
                last = a + end - n // 2
                yield k, a + end - begin, a + end, edits


def _portions(benchmark, rate, target, portion):
    """Keys of the benchmark, in portions of at most about `portion` bytes."""
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    portions = max(1, -(-size // portion))
    for p in range(portions):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == p).collect()
        yield Benchmark(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x)), rate, target)


def find_passages(docs, benchmark, rate=0.2, target=0.95, portion=32 << 20):
    """doc_id, item_id, start, end (bytes of the text) and edits of every benchmark passage found."""
    ship(docs.sparkSession)
    out = None
    for known in _portions(benchmark, rate, target, portion):
        found = docs.select("doc_id", "text").mapInArrow(tidy(_finder(known)), "doc_id long, item_id long, start long, end long, edits int")
        out = found if out is None else out.unionByName(found)
    return out


def without_passages(docs, benchmark, rate=0.2, target=0.95, portion=32 << 20):
    """The rows in whose text no benchmark passage is found; nothing is shuffled."""
    ship(docs.sparkSession)
    for known in _portions(benchmark, rate, target, portion):
        docs = docs.mapInArrow(tidy(_cleaner(known)), docs.schema)
    return docs


def _found(known, part):
    """(row, item, start, end, edits) of the passages in an Arrow batch."""
    symbol = known.vocabulary.get
    gap = np.zeros(getattr(known, "gap", 1), np.int64)
    buf, offsets = pieces.texts(part.column("text"))
    plain, parts, rows, place = buf.translate(PLAIN), [], [], {}
    for a, z in zip(offsets, offsets[1:]):
        found = plain[a:z].split()
        parts += (np.fromiter(map(symbol, found, repeat(0)), np.int64, len(found)), gap)
    if not parts or not known.items:
        return rows
    first = np.cumsum([0] + [len(parts[k]) + len(gap) for k in range(0, len(parts), 2)])
    for i, s, e, edits in known.matches(np.concatenate(parts)):
        k = int(np.searchsorted(first, s, "right")) - 1
        if k not in place:
            place[k] = [m.span() for m in WORD.finditer(plain, int(offsets[k]), int(offsets[k + 1]))]
        s, e = s - int(first[k]), min(e - int(first[k]), len(place[k]))
        rows.append((k, known.names[i], place[k][s][0] - int(offsets[k]), place[k][e - 1][1] - int(offsets[k]), edits))
    return rows


def _finder(known):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", limit=4 << 20):
                if rows := _found(known, part):
                    at, item, start, end, edits = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(at)), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                         pa.array(edits, pa.int32())], names=["doc_id", "item_id", "start", "end", "edits"])
    return run


def _cleaner(known):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", limit=4 << 20):
                keep = np.ones(part.num_rows, bool)
                keep[[r[0] for r in _found(known, part)]] = False
                yield part.filter(pa.array(keep))
    return run
