"""Word shingle sets as sorted 64-bit hashes."""

import numpy as np
import xxhash

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                        0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _Words(dict):
    """Word -> 64-bit hash in bytes; remembers at most `room` words."""

    room = 150_000

    def __missing__(self, word):
        found = xxhash.xxh3_64_digest(word)
        if len(self) < self.room:
            self[word] = found
        return found


_words = _Words()


def mix(x):
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text):
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text in bytes, A-Z in lower case."""
    return np.frombuffer(b"".join(map(_words.__getitem__, text.lower().split())), ">u8").astype(np.uint64)


def shingle_set(text, size=4):
    """Distinct `size`-word shingles as a sorted array; fewer words make one shingle, none an empty set."""
    w = word_hashes(text)
    if len(w) == 0:
        return w
    if len(w) < size:
        return mix((w * MULTIPLIERS[:len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))
    total = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        total += w[k:len(w) - size + 1 + k] * MULTIPLIERS[k]
    found = mix(total)
    found.sort()
    return found[np.concatenate(([True], found[1:] != found[:-1]))]
