"""WARC archives: a writer and a splittable reader.

`write` makes one gzip member per record, as the format recommends. Of records with equal payloads of
at least `least` bytes the one with the smallest page_id is a response and the others are revisits,
which name it and leave the payload out. The choice is made on (page_id, digest, length) alone, with
the minimum by digest as a partial aggregate, and joined to the pages by a hash of page_id and digest,
which no hot payload makes uneven.

`read` cuts every file into byte ranges. A task looks for gzip magic in its range, validates each
candidate by decoding a member's start to a WARC header, and owns the records that start inside,
reading beyond the range's end where the last one needs it. So no index is wanted and one huge
archive is read by many tasks.

Each attempt of a writing task makes a file of its own and only those in the manifest count.

Defined results: null html is an empty payload; null url leaves the target out; a null page_id is kept
as null and comes after all others when the smallest is chosen, so equal payloads of null pages alone
are all responses; repeated rows (equal page_id and payload) are one response and revisits to it; an
empty table gives no archives and an empty result; other columns are not stored.

Archives of other writers: a record is a member that decodes to its end with its checksum, whatever follows
it; other bytes between members are passed over. A member that begins with a WARC header and does not decode (damaged
or cut off), is shorter than its Content-Length or does not have its payload digest is a row whose `error`
says so; the other columns hold what is known. Records of any type are returned; what a record does not have is null.
Digests in sha256, sha1 and md5, in hexadecimal or base32, are checked (not over transfer-encoded bodies);
sha256 is returned as bare hexadecimal, others with their name. A WARC archive that is itself stored without
compression in a record may be taken for records by a range that begins inside it. `archived_pages` raises where
records are damaged or their number is not that of the manifest.
"""

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from wardflow.llm.common import filesystem, shared_dir, ship, spread, staged

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
          "path string, at long, error string")


def _record_id(page_id):
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def member(page_id, url, payload, digest, refers_to, date, level):
    """The gzip member of one record."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_record_id(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write(pages, folder=None, least=100, date="1970-01-01T00:00:00Z", level=6):
    """Archives of (page_id, url, html) under `folder`; the manifest: path, size, records."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or shared_dir(spark, "warc")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    short = rows.filter(F.octet_length("html") >= least).select("page_id", "digest")
    first = short.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = short.join(first, "digest").groupBy("page_id", "digest").agg(F.min("first").alias("first"))
    later = later.filter("first IS NOT NULL").select(
        F.xxhash64("page_id", "digest").alias("key"), F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first")
    # One exchange of the pages: rows with equal page_id and digest meet in one task, side by side.
    rows = rows.withColumn("key", F.xxhash64("page_id", "digest")).repartition("key").join(later, "key", "left")
    same = F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d"))
    rows = rows.select("page_id", "url", "html", "digest", F.when(same, F.col("first")).alias("first")).sortWithinPartitions(
        F.asc_nulls_last("page_id"), "digest", F.asc_nulls_first("url"))

    def run(batches):
        out, records, size, last = None, 0, 0, None
        for batch in batches:
            for page, url, html, digest, first in zip(*(batch.column(i) for i in range(5))):
                page, url, digest, first = page.as_py(), url.as_py(), digest.as_py(), first.as_py()
                repeat = first == page and page is not None and (page, digest) == last
                refers_to = first if first is not None and (first != page or repeat) else None
                last = (page, digest)
                data = member(page, url, html.as_buffer().to_pybytes(), digest, refers_to, date, level)
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, at = filesystem(path)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                out.write(data)
                records += 1
                size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "records": [records]})

    return staged(rows.mapInArrow(run, "path string, size long, records long"), "manifest")


class _Window:
    """A file read forward in blocks; gives any range near the place last asked for."""

    def __init__(self, path, block=1 << 20):
        fs, at = filesystem(path)
        self.file, self.block = fs.open_input_file(at), block
        self.size, self.begin, self.data = self.file.size(), 0, b""

    def upto(self, at, end):
        """Bytes from `at` to `end` (or the file's end) at least."""
        if at < self.begin or at > self.begin + len(self.data):
            self.begin, self.data = at, b""
        elif at > self.begin + self.block:
            self.data, self.begin = self.data[at - self.begin:], at
        have = self.begin + len(self.data)
        if have < min(end, self.size):
            self.data += self.file.read_at(min(max(self.block, end - have), self.size - have), have)
        return self.data, at - self.begin


def parse(raw):
    """(header fields in lower case, block, error) of one decoded record, or None where it is none."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = _number(fields.get("content-length"))
    return fields, rest if size is None else rest[:size], "shorter than its Content-Length" if size is not None and size > len(rest) else None


def _number(text):
    return int(text) if text is not None and text.isascii() and text.lstrip("-").isdigit() and len(text) < 19 else None


def _header_ok(data):
    """A candidate's first bytes decode to the start of a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(data, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def records(path, begin, end):
    """(offset, fields, block, error) of the records that start in [begin, end)."""
    window, at = _Window(path), begin
    while at < min(end, window.size):
        data, i = window.upto(at, at + window.block)
        j = data.find(MAGIC, i)
        if j < 0:  # magic may lie across the edge of what has been read
            if window.begin + len(data) >= window.size:
                return
            at = window.begin + len(data) - 2
            continue
        at = window.begin + j
        if at >= end:
            return
        data, i = window.upto(at, at + 4096)
        if not _header_ok(data[i:i + 4096]):
            at += 1
            continue
        unpack, raw, place, error = zlib.decompressobj(31), [], at, None
        try:
            while not unpack.eof:
                data, i = window.upto(place, place + 1)
                if i >= len(data):
                    error = "cut off"
                    break
                raw.append(unpack.decompress(data[i:]))
                place += len(data) - i
            place -= len(unpack.unused_data)
        except zlib.error as e:
            error = f"damaged: {e}"
        if error and not raw:
            data, i = window.upto(at, at + 4096)
            raw = [zlib.decompressobj(31).decompress(data[i:i + 4096], 512)]
        found = parse(b"".join(raw))
        if error:  # where it ends is not known: whatever follows is looked for from here
            yield (at, *(found or ({}, b""))[:2], error)
            at += 1
            continue
        if found is None:
            at += 1  # bytes that looked like a record
            continue
        yield at, *found
        at = place


def _digest_error(named, body):
    """Whether a digest (algorithm:value) is that of the body; None where it is or cannot be told."""
    kind, _, value = named.partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("sha256", "sha1", "md5"):
        return None
    made = hashlib.new(kind, body, usedforsecurity=False).digest()
    known = (made.hex(), base64.b32encode(made).decode().rstrip("=").lower())
    return None if value.rstrip("=").lower() in known else "payload does not have its digest"


def _row(path, at, fields, block, error):
    """The columns of RECORD and the payload of a record that has one."""
    kind, http = fields.get("warc-type"), fields.get("content-type", "").lower().startswith("application/http")
    head, mark, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    lines = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n"))}
    if http and not mark:
        head, body = block, b""
    named = fields.get("warc-payload-digest")
    if kind == "revisit":
        size, body = _number(lines.get(b"content-length", b"").decode("latin-1")), None
    else:
        size = len(body)
        if not error and named and b"transfer-encoding" not in lines:
            error = _digest_error(named, body)
    if named and named.lower().startswith("sha256:") and len(named) == 71:
        named = named[7:].lower()
    return (_number(fields.get("x-page-id")), fields.get("warc-target-uri"), kind, None if error else size, named,
            _number(fields.get("x-refers-to-page")), path, at, error, None if error else body)


def read(manifest, split=8 << 20, payload=False):
    """The records of the archives in `manifest` (path, size), one row each; payloads if asked for."""
    ship(manifest.sparkSession)
    files = manifest.filter("size > 0")
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("begin"))
    ranges = spread(ranges.select("path", "begin", F.least(F.col("begin") + split, "size").alias("end")),
                    files.agg(F.sum(F.ceil(F.col("size") / split))).first()[0])
    schema = RECORD + (", payload binary" if payload else "")

    def run(batches):
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        shape = pa.schema([(n, kinds[k]) for n, k in map(str.split, schema.split(", "))])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

        for batch in batches:
            for path, begin, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held, size = [], 0
                for at, fields, block, error in records(path, begin, end):
                    held.append(_row(path, at, fields, block, error)[:len(shape)])
                    size += len(block) * payload + 500
                    if size > 4 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    return ranges.mapInArrow(run, schema)


def archived_pages(pages):
    """Writes all pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Raises where a record is damaged or the number of records is not the one written."""
    manifest = write(pages)
    found = staged(read(manifest), "records")
    damaged, read_back = found.agg(F.min(F.when(F.col("error").isNotNull(), F.concat_ws(" ", "path", "at", "error"))), F.count("*")).first()
    written = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if damaged or read_back != written:
        raise ValueError(f"{read_back} of {written} records read; {damaged or 'none damaged'}")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
