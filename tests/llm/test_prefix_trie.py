"""Prefix tries against a plain walk over all prefixes."""

import hashlib
import random
import zlib

import pytest

from wardflow.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth long"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            item = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own.setdefault(c, []).append(((turn is not None, turn or 0), item, (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if whole[c] == k)
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children[k], leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed, convs, turns, words):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(words)) for c in convs for t in range(rnd.randrange(1, turns))]


CASES = {
    "shared": rows_of(1, range(0, 330), 9, ["a", "bb", "", "ein längerer Text 😀"]),
    "long": rows_of(2, [0, 1, 2, 100, 150, 205], 90, ["x", "yy"]) + [(7, t, "u", "x") for t in range(700)],
    "copies": [(c, t, "user", f"same {t}") for c in range(0, 3000) for t in range(3)],
    "odd": [(None, 0, "user", "no conversation"), (5, None, None, None), (5, None, "user", None), (5, 1, "user", "tie"),
            (5, 1, "assistant", "tie"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (-205, 2, "u", "n"), (-200, 1, "u", "m"),
            (-200, 2, "u", "m"), (9, 3, "1:", "u"), (109, 3, "", "1:u"), (10, 0, "u", "z" * 300_000), (11, 0, "", ""),
            (2 ** 62, 0, "u", "far"), (-2 ** 62, 0, "u", "far")],
    "none": [],
}


@pytest.mark.parametrize("name,height", [("shared", 8), ("shared", 2), ("long", 3), ("copies", 8), ("odd", 2), ("none", 8)])
def test_against_all_prefixes(spark, name, height):
    rows = CASES[name]
    df = spark.createDataFrame([(*r, "mine", 99) for r in rows], SCHEMA).repartition(4)
    got = [tuple(r[c] for c in OUT) for r in prefix_trie(df, height).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_a_band_has_two_depths_at_least(spark):
    with pytest.raises(ValueError):
        prefix_trie(spark.createDataFrame([], SCHEMA), 1)
