"""Cuts of a text at places no token can span, and encoding of the pieces between them.

A merge joins two neighbouring tokens, so a token covers a byte pair (x, y) only if some vocabulary
token contains it. A pair that occurs inside no token is a certain cut: both sides can be encoded
alone and their ids concatenated. The text is first divided by the vocabulary's pattern, so of those
pairs only the ones are used where that division is the same with and without the cut:

* y starts a character, x ends one that is certainly no white space (a run of white space is divided
  by looking at what follows it);
* neither is an apostrophe, unless y is white space after another character (contractions);
* the pair occurs in no special token, whose string is looked for before anything else.
"""

import json
import os
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPACES = np.array([9, 10, 11, 12, 13, 32])
WHITE = bytes(SPACES.tolist())
# Last two bytes of white space beyond ASCII in UTF-8 (U+0085, 00A0, 1680, 180E,
# 2000-200A, 2028, 2029, 202F, 205F, 3000).
WIDE_BEFORE = np.array([0xC2, 0x9A, 0xA0, 0x80, 0x81])
WIDE_LAST = np.array([0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8E, 0x9F, 0xA0, 0xA8,
                      0xA9, 0xAF])


def alphabet():
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return table


def token_bytes(spec):
    """id -> bytes of every token of a byte-level vocabulary file, special tokens included."""
    back = {c: b for b, c in alphabet().items()}
    out = {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    out.update({t["id"]: t["content"].encode() for t in spec["added_tokens"]})
    return out


def forced_pairs(spec):
    """256 x 256 flags: a byte-level vocabulary is certainly cut between these two bytes."""
    inside = np.zeros((256, 256), bool)
    for token in token_bytes(spec).values():
        b = np.frombuffer(token, np.uint8)
        inside[b[:-1], b[1:]] = True
    cut = ~inside
    space = np.isin(np.arange(256), SPACES)
    first = (np.arange(256) < 0x80) | (np.arange(256) >= 0xC2)
    last = ((np.arange(256) > 0x20) & (np.arange(256) < 0x7F)) | ((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0))
    cut &= last[:, None] & first[None, :]
    cut[0x27, :] = cut[:, 0x27] = False
    # A control character is neither letter nor certain white space everywhere: no cut before it.
    cut[:, (np.arange(256) < 0x20) & ~space] = False
    return cut


def space_pairs():
    """256 x 256 flags for vocabularies that drop white space: cut where a run of it begins.

    Letters and marks are matched apart, so a cut between them is certain too; left out are the
    apostrophe (contractions) and what special tokens are written with.
    """
    space = np.isin(np.arange(256), SPACES)
    cut = ~space[:, None] & space[None, :]
    letter = np.array([b < 0x80 and chr(b).isalpha() for b in range(256)])
    mark = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;=?@[]^_{}~"))
    return cut | (letter[:, None] & mark[None, :])


class Pieces:
    """Encodes by pieces with one vocabulary file; pieces seen before are not encoded again.

    `room` bounds the remembered pieces by number; when full, memory starts afresh (ids don't change).
    """

    def __init__(self, path, room=300_000):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.by_byte = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer")
        self.cut = forced_pairs(spec).ravel() if self.by_byte else space_pairs().ravel()
        self.before, self.last = np.zeros(256, bool), np.zeros(256, bool)
        if self.by_byte:
            self.before[WIDE_BEFORE] = self.last[WIDE_LAST] = True
            self.names = token_bytes(spec)
        self.letters = str.maketrans({chr(b): c for b, c in alphabet().items()})
        self.space = alphabet()[32]
        self.known, self.room = {}, room if self.by_byte else 2 * room

    def cuts(self, b):
        """Flags by position of a byte array: a text may be cut before this byte."""
        at = np.zeros(len(b), bool)
        if len(b) > 1:
            np.take(self.cut, (b[:-1].astype(np.uint16) << 8) | b[1:], out=at[1:])
            if self.by_byte:
                at[2:] &= ~(self.last[b[1:-1]] & self.before[b[:-2]])
        return at

    def _encode(self, missing, batch=1 << 18):
        """{piece: ids as bytes}, encoded in batches of about as many bytes each."""
        out, todo, size = {}, [], 0
        for piece in (*missing, None):
            if piece is not None:
                word = self._word(piece)
                if word:  # one word of letters: straight to the library's merges
                    out[piece] = array("I", [t.id for t in self.lib.model.tokenize(word)]).tobytes()
                    continue
                todo.append(piece)
                size += len(piece)
            if todo and (piece is None or size >= batch):
                found = self.lib.encode_batch_fast([p.decode("utf-8", "replace") for p in todo],
                                                   add_special_tokens=False)
                out.update((p, array("I", e.ids).tobytes()) for p, e in zip(todo, found))
                todo, size = [], 0
        return out

    def _word(self, piece):
        """The one pattern match a piece of Latin letters consists of, in the vocabulary's characters."""
        core = piece[1:] if piece[:1] == b" " else piece
        if core.isalpha():  # ASCII letters only
            return core.decode().lower() if not self.by_byte else piece.decode().replace(" ", self.space)
        if core.isascii():
            return None
        text, core = piece.decode("utf-8", "replace"), core.decode("utf-8", "replace")
        if not core.isalpha() or max(core) >= "\u0250":
            return None
        if not self.by_byte:
            text = core.lower()
            if not text.isalpha():  # a letter whose lower case has a mark
                return None
        return text.encode().decode("latin-1").translate(self.letters)

    def _found(self, buf, offsets, window):
        """Windows of about `window` bytes, ending at a cut: each piece's ids, and the texts' share."""
        for frags, ends in self._windows(np.frombuffer(buf, np.uint8), np.asarray(offsets), window):
            found = list(map(self.known.get, frags))
            if None in found:
                new = self._encode({f for f, v in zip(frags, found) if v is None})
                found = [new[f] if v is None else v for f, v in zip(frags, found)]
                if len(self.known) + len(new) > self.room:
                    self.known.clear()
                self.known.update(new)
            yield found, ends

    def _lengths(self, found, ends, total):
        at = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) >> 2
        for text, first, end in ends:
            total[text] += at[end - 1] - (at[first - 1] if first else 0)

    def encode(self, buf, offsets, window=4 << 20):
        """ids (uint32) of the texts buf[offsets[i]:offsets[i+1]] and the ids' offsets by text."""
        parts, total = [], np.zeros(len(offsets) - 1, np.int64)
        for found, ends in self._found(buf, offsets, window):
            parts.append(np.frombuffer(b"".join(found), "<u4"))
            self._lengths(found, ends, total)
        return (np.concatenate(parts) if parts else np.zeros(0, "<u4")), np.concatenate(([0], np.cumsum(total)))

    def count(self, buf, offsets, window=4 << 20):
        """Number of ids of each text."""
        total = np.zeros(len(offsets) - 1, np.int64)
        for found, ends in self._found(buf, offsets, window):
            self._lengths(found, ends, total)
        return total

    def _windows(self, whole, offsets, window):
        """(pieces, [(text, first piece, end piece)]) for runs of texts, or for parts of a long one."""
        text, at, end = 0, int(offsets[0]), int(offsets[-1])
        while at < end:
            stop, step = min(end, at + window), window
            while True:  # ends at a text's end or else at a cut; where there is none, a longer window
                flags = self.cuts(whole[at:stop])
                starts = offsets[np.searchsorted(offsets, at, "right"):np.searchsorted(offsets, stop, "left")]
                flags[starts - at] = True
                if stop == end or (stop == offsets[np.searchsorted(offsets, stop)]):
                    break
                if flags.any():
                    stop = at + int(np.flatnonzero(flags)[-1])
                    flags = flags[:stop - at]
                    break
                step *= 2
                stop = min(end, at + step)
            places = np.flatnonzero(flags)
            # 0xFF is in no UTF-8 text: put it at the cuts and split there.
            frags = np.insert(whole[at:stop], places, 0xFF).tobytes()
            if not self.by_byte and b"<|" not in frags:
                # White space is dropped and case is folded: fewer different pieces to encode.
                frags = frags.lower().translate(None, WHITE)
            frags = frags.split(b"\xff")
            ends = []
            while text < len(offsets) - 1 and offsets[text] < stop:
                a, z = max(at, int(offsets[text])), min(stop, int(offsets[text + 1]))
                if z > a:
                    ends.append((text, int(np.searchsorted(places, a - at, "right")),
                                 int(np.searchsorted(places, z - at, "left")) + 1))
                if offsets[text + 1] > stop:
                    break
                text += 1
            yield frags, ends
            at = stop


_loaded = {}


def pieces(path):
    """The encoder of a vocabulary file, kept by the Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def texts(column):
    """(bytes, offsets) of an Arrow text column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None else b""
    return body, offsets - offsets[0]
