"""Encoding, counting and token files as Spark jobs."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardflow.llm import bpe, token_count, token_file

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [(3, "The cat sat."), (1, None), (2, ""), (5, "word " * 3000), (4, "Élan vital <|endoftext|> x"), (4, "Élan vital <|endoftext|> x"),
         (None, "no id"), (7, "tie"), (9, "y" * 20000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra", [1]) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids array<int>").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_encode_and_decode(docs, empty):
    lib = Tokenizer.from_file(BYTE)
    rows = bpe.decode(bpe.encode(docs, BYTE), BYTE)
    assert rows.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    got = rows.collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.ids == lib.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "") and r.n_tokens == "extra"
    for r in bpe.digests(docs, BYTE).collect():
        text = dict(TEXTS)[r.doc_id] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.digests(empty, BYTE).count() == 0


def test_counts(docs, empty):
    lib = Tokenizer.from_file(BYTE)
    got = token_count.count_tokens(docs, BYTE, batch_bytes=512)
    assert got.columns == ["doc_id", "text", "ids", "n_bytes", "n_tokens"]
    for r in got.collect():
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids))
    assert {r.doc_id for r in token_count.token_report(docs, BYTE).filter("over_limit").collect()} == {5, 9}
    import sentencepiece
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in token_count.count_tokens(docs, model).collect():
        assert r.n_tokens == len(sp.encode(r.text or ""))
    assert token_count.token_report(empty, BYTE).count() == 0


@pytest.mark.parametrize("vocab", [BYTE, WORD])
def test_token_file(docs, empty, vocab):
    lib = Tokenizer.from_file(vocab)
    manifest = token_file.write(docs, vocab)
    got = token_file.read(manifest, docs=2).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        want = lib.encode(dict(TEXTS)[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.ids, r.start, r.n_tokens) == (want, at, len(want)) and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    one = max(manifest.collect(), key=lambda r: r.docs)
    file = token_file.Reader(one.path)
    for k in (0, one.docs - 1):
        assert file.document(k).tolist() == lib.encode(dict(TEXTS)[file.doc_ids(k, k + 1)[0]] or "", add_special_tokens=False).ids + [2]
    assert token_file.read(token_file.write(empty, vocab)).count() == 0


def test_blocks_are_read_by_many_tasks(spark):
    rows = spark.range(600).selectExpr("id AS doc_id", "repeat('word ', 50) AS text").coalesce(1)
    manifest = token_file.write(rows, BYTE)
    got = token_file.read(manifest, docs=20).selectExpr("spark_partition_id() AS task", "doc_id")
    assert got.select("task").distinct().count() >= 8 and got.select("doc_id").distinct().count() == 600
