"""BPE encoding and decoding by forced boundaries (see `pieces`).

`encode` and `decode` add an `ids` column (array<int>) or a decoded text to any frame. Every text is
cut at byte pairs that occur inside no vocabulary token, the fragments are encoded alone and their
ids concatenated; a long text is worked through in windows that end at such a cut. Nothing is
shuffled; tasks are as even as the scan's byte ranges.

Defined results: a null or empty text has no ids and decodes to ''; equal rows have equal results;
an empty table gives an empty frame; other columns pass through, except that a column with the name
of the new one is replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm import pieces
from wardflow.llm.common import ship, slices, tidy


def _put(batch, name, column):
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), column], names=[*keep, name])


def _schema(df, name, kind):
    return T.StructType([f for f in df.schema if f.name != name] + [T.StructField(name, kind)])


def encode(df, vocab, text="text", ids="ids"):
    """`df` with the ids of its text column, as the library gives them without added special tokens."""
    ship(df.sparkSession)

    def run(batches):
        encoder = pieces.pieces(vocab)
        for batch in batches:
            for part in slices(batch, text, limit=2 << 20):
                found, offsets = encoder.encode(*pieces.texts(part.column(text)))
                column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.view(np.int32)))
                yield _put(part, ids, column)
        encoder.known.clear()  # the next task may belong to another operator

    return df.mapInArrow(tidy(run), _schema(df, ids, T.ArrayType(T.IntegerType())))


def decode(df, vocab, ids="ids", text="decoded"):
    """`df` with the text its ids stand for; special tokens give their own string."""
    ship(df.sparkSession)

    def run(batches):
        names = pieces.pieces(vocab).names
        table = np.empty(max(names) + 1, object)
        table[:] = b""
        for i, b in names.items():
            table[i] = b
        for batch in batches:
            column = batch.column(ids)
            rows = [b"".join(table[column[i].values.to_numpy(zero_copy_only=False)].tolist()).decode("utf-8", "replace")
                    if column[i].is_valid else "" for i in range(len(column))]
            yield _put(batch, text, pa.array(rows, pa.string()))

    return df.mapInArrow(tidy(run), _schema(df, text, T.StringType()))


def digests(df, vocab, text="text"):
    """doc_id, number and hash of the ids, hash of the decoded text."""
    rows = decode(encode(df.select("doc_id", text), vocab, text).drop(text), vocab)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
