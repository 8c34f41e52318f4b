"""Cutting at forced boundaries against the library on whole texts."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardflow.llm import elias_fano
from wardflow.llm.pieces import Pieces, forced_pairs, token_bytes

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", "a <|endoftext|> b<|endoftext|>c  <|startoftext|>", "It's  we'll \n\n x!'s  a  b　  c\t\td'",
       "日本語テキスト。漢字カナ 交じり", "x" * 9000, "é é è à à    y", "\x1c \x1f a\x85 b", " " * 300 + "a", "a\r\n b​ c ÉCOLE Σας ς",
       "'ll'S'd can't 'twas x'é", "é ́a", "ÀÉÎ straße ŒUVRE İstanbul ﬁ ǅ", "<|ENDOFTEXT|> <| endoftext|>", "…—“q”  123 4,5.6 %"]


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    path = public_tokenizers.path(request.param)
    return Pieces(path), Tokenizer.from_file(path)


def ids_of(encoder, texts, window):
    raw = [t.encode() for t in texts]
    found, at = encoder.encode(b"".join(raw), np.cumsum([0] + [len(r) for r in raw]), window)
    return [found[a:z].tolist() for a, z in zip(at, at[1:])]


@pytest.mark.parametrize("window", [1 << 20, 64, 7])
def test_odd_texts(both, window):
    encoder, lib = both
    want = [e.ids for e in lib.encode_batch(ODD, add_special_tokens=False)]
    assert ids_of(encoder, ODD, window) == want
    raw = [t.encode() for t in ODD]
    assert encoder.count(b"".join(raw), np.cumsum([0] + [len(r) for r in raw]), window).tolist() == [len(w) for w in want]


@given(st.lists(st.text(alphabet=st.sampled_from("ab cé'st\n\t!.,<|>x1  　語Σİ-"), max_size=40), max_size=5), st.sampled_from([5, 50]))
@settings(max_examples=150, deadline=None)
def test_random_texts(texts, window):
    for name in NAMES:
        encoder, lib = _both(name)
        assert ids_of(encoder, texts, window) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


_kept = {}


def _both(name):
    if name not in _kept:
        path = public_tokenizers.path(name)
        _kept[name] = Pieces(path), Tokenizer.from_file(path)
    return _kept[name]


def test_small_memory_changes_nothing():
    path = public_tokenizers.path(NAMES[0])
    assert ids_of(Pieces(path, room=3), ODD, 64) == ids_of(Pieces(path), ODD, 64)


def test_forced_pairs_occur_in_no_token():
    import json
    with open(public_tokenizers.path(NAMES[0])) as f:
        spec = json.load(f)
    cut = forced_pairs(spec)
    assert cut.any()
    for token in token_bytes(spec).values():
        b = np.frombuffer(token, np.uint8)
        assert not cut[b[:-1], b[1:]].any()


@given(st.lists(st.integers(0, 1 << 40), min_size=0, max_size=900), st.data())
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, data):
    values = sorted(values)
    head, low, high, samples = elias_fano.encode(values)
    a = data.draw(st.integers(0, len(values)))
    z = data.draw(st.integers(a, len(values)))
    part = lambda b: lambda i, j: b[i:j]
    assert elias_fano.select(head, part(low), part(high), part(samples), a, z).tolist() == values[a:z]


def test_elias_fano_is_small_and_refuses_disorder():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 50_000))
    _, low, high, samples = elias_fano.encode(values)
    assert (len(low) + len(high) + len(samples)) * 8 < 13 * len(values)
    with pytest.raises(ValueError):
        elias_fano.encode([3, 2])
