"""Token counts: texts are cut at safe boundaries and batch-encoded in Arrow functions that return
lengths only.

Batches hold about as many bytes each: rows are grouped by their texts' bytes, a text longer than a
batch is cut at certain boundaries (see `pieces`) and its parts' lengths summed. No ids leave Python.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; an
empty table gives an empty frame; other columns pass through, and columns named like the new ones
are replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm import pieces
from wardflow.llm.common import ship, slices

NEW = ("n_bytes", "n_tokens")


def count_tokens(df, vocab, text="text", batch_bytes=2 << 20, keep=None):
    """`df` (columns `keep`, default all) with n_bytes (UTF-8) and n_tokens of its text column.

    A .json vocabulary is counted with tokenizers, a .model one with sentencepiece.
    """
    ship(df.sparkSession)
    keep = [c for c in (keep or df.columns) if c not in NEW]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T.LongType()) for n in NEW])

    def lengths(part):
        buf, offsets = pieces.texts(part)
        if vocab.endswith(".model"):
            found = _piece_lengths(vocab, buf, offsets)
        else:
            found = pieces.pieces(vocab).count(buf, offsets, batch_bytes)
        return np.diff(offsets), found

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, limit=batch_bytes):
                size, found = lengths(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(size), pa.array(found)],
                                                 names=[*keep, *NEW])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _piece_lengths(vocab, buf, offsets):
    """sentencepiece merges across words only from a word's start on, but trims and joins white space:
    whole texts are encoded, in batches."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=vocab)
    rows = [buf[a:z].decode() for a, z in zip(offsets, offsets[1:])]
    return np.array([len(x) for x in model.encode(rows, num_threads=1)] if rows else [], np.int64)


def token_report(df, vocab, limit=1024):
    """doc_id, n_bytes, n_tokens and whether a text is over `limit` tokens."""
    return count_tokens(df.select("doc_id", "text"), vocab, keep=["doc_id"]).withColumn(
        "over_limit", F.col("n_tokens") > limit)
