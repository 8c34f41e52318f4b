"""Token ids in binary files with Elias-Fano document boundaries.

One file holds a run of documents in ascending doc_id order:

    magic | ids, 16 or 32 bits each | boundaries: low, high, samples | doc_ids: low, high, samples
    | footer (JSON) | footer length, 32 bits | magic

The boundaries (0, end of document 1, ...) and the doc_ids less their smallest are Elias-Fano coded
(see `elias_fano`); select gives any document's offset without a table of 64-bit offsets. Files are
written by range of doc_id, in partition order, so all documents before one are those of the files
before and those before it in its file. Each attempt of a task writes a file of its own and only the
files named in the manifest (a table of the shared folder) count, so a lost executor or a repeated
task leaves no half file behind.

Defined results: a null or empty text has only the end id; rows with a null doc_id come first and are
read back with null; of rows with one doc_id, the order is that of a hash of the text, and each keeps
its ids; an empty table gives no files and an empty result; other columns are not stored.
"""

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardflow.llm import elias_fano, pieces
from wardflow.llm.common import filesystem, shared_dir, ship, slices, spread, staged

MAGIC = b"WFTOKEN1"
MANIFEST = "part int, path string, docs long, ids long"


def _part_writer(vocab, folder, end_id):
    def run(batches):
        from pyspark import TaskContext
        encoder = pieces.pieces(vocab)
        wide = encoder.lib.get_vocab_size(with_added_tokens=True) > 1 << 16
        out, doc_ids, lengths, nulls = None, [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                if out is None:
                    part_no = TaskContext.get().partitionId()
                    path = f"{folder}/part-{part_no:06d}-{uuid.uuid4().hex}.ids"
                    fs, at = filesystem(path)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                    out.write(MAGIC)
                ids, offsets = encoder.encode(*pieces.texts(part.column("text")))
                ids = np.insert(ids, offsets[1:], end_id)
                out.write(ids.astype("<u4" if wide else "<u2").tobytes())
                lengths.append(np.diff(offsets) + 1)
                column = part.column("doc_id")
                nulls += column.null_count
                doc_ids.append(column.drop_null().to_numpy(zero_copy_only=False))
        if out is None:
            return
        bounds = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
        doc_ids = np.concatenate(doc_ids)
        base = int(doc_ids[0]) if len(doc_ids) else 0
        footer = {"docs": len(bounds) - 1, "ids": int(bounds[-1]), "bytes": 4 if wide else 2, "nulls": nulls, "base": base}
        place = len(MAGIC) + footer["ids"] * footer["bytes"]
        for name, values in (("bounds", bounds), ("doc_ids", doc_ids - base)):
            footer[name], *sections = elias_fano.encode(values)
            for key, data in zip(("low", "high", "samples"), sections):
                footer[name][key] = [place, len(data)]
                out.write(data)
                place += len(data)
        text = json.dumps(footer).encode()
        out.write(text + len(text).to_bytes(4, "little") + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part_no], pa.int32()), "path": [path], "docs": [footer["docs"]], "ids": [footer["ids"]]})

    return run


def write(df, vocab, folder=None, end_id=2):
    """Encodes (doc_id, text) into files under `folder`; the manifest: part, path, docs, ids."""
    ship(df.sparkSession)
    folder = folder or shared_dir(df.sparkSession, "token-files")
    order = ["doc_id", F.xxhash64("text")]
    rows = df.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(rows.mapInArrow(_part_writer(vocab, folder, end_id), MANIFEST), "manifest")


class Reader:
    """One token file; reads only the bytes asked for."""

    def __init__(self, path):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        n = int.from_bytes(tail[:4], "little")
        self.footer = json.loads(self.file.read_at(n, size - 12 - n))

    def _select(self, name, begin, end):
        head = self.footer[name]

        def section(key):
            place, size = head.get(key, (0, 0))
            return lambda a, z: self.file.read_at((size if z is None else min(z, size)) - a, place + a)
        return elias_fano.select(head, section("low"), section("high"), section("samples"), begin, end)

    def bounds(self, begin, end):
        """Offsets, counted in ids, where documents begin..end-1 start, and where the last ends."""
        return self._select("bounds", begin, end + 1)

    def doc_ids(self, begin, end):
        nulls = self.footer["nulls"]
        found = self._select("doc_ids", max(0, begin - nulls), max(0, end - nulls)) + self.footer["base"]
        return [None] * max(0, min(end, nulls) - begin) + found.tolist()

    def ids(self, begin, end):
        """ids begin..end-1 of the file, in 32 bits."""
        n = self.footer["bytes"]
        return np.frombuffer(self.file.read_at((end - begin) * n, len(MAGIC) + begin * n), f"<u{n}").astype("<u4")

    def document(self, index):
        return self.ids(*map(int, self.bounds(index, index + 1)))


def read(manifest, docs=4096, with_ids=True):
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids.

    Read in blocks of `docs` documents found by select, so one large file is read by many tasks.
    """
    ship(manifest.sparkSession)
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = manifest.withColumn("before", before).select(
        "path", "before", "docs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(docs).cast("long"))).alias("first"))
    blocks = blocks.select("path", "before", "first", F.least(F.col("first") + docs, "docs").alias("last"))
    blocks = spread(blocks, manifest.agg(F.sum(F.ceil(F.col("docs") / docs))).first()[0])

    def run(batches):
        for batch in batches:
            for path, base, first, last in zip(*(batch.column(i).to_pylist() for i in range(4))):
                file = Reader(path)
                bounds, names = file.bounds(first, last), file.doc_ids(first, last)
                i = 0
                while i < len(names):  # documents of about 4 million ids at a time, one at least
                    j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + (4 << 20), "right")) - 1)
                    ids, at = file.ids(int(bounds[i]), int(bounds[j])), bounds[i:j + 1] - bounds[i]
                    out = {"doc_id": pa.array(names[i:j], pa.int64()), "start": pa.array(bounds[i:j] + base),
                           "n_tokens": pa.array(np.diff(at)),
                           "ids_crc32": pa.array([zlib.crc32(ids[a:z]) for a, z in zip(at, at[1:])], pa.int64())}
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
                    yield pa.RecordBatch.from_pydict(out)
                    i = j

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return blocks.mapInArrow(run, schema)
