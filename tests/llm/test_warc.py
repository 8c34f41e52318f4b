"""Archives: writing, range reading, revisits."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wardflow.llm import warc
from wardflow.llm.common import staged


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(1)
    body = lambda: "".join(rnd.choices("<p>äbc ", k=rnd.randrange(100, 3000)))
    hot = body()
    rows = [(i, f"http://x/{i}", body()) for i in range(40)] + [(100 + i, "http://hot", hot) for i in range(30)]
    rows += [(200, None, None), (201, "u\r\nX: y", ""), (202, "u", "short"), (203, "u", "short"), (204, "big", "z" * 400_000)]
    rows += [(300, "twice", hot), (300, "twice", hot), (None, "n", hot), (None, "m", "only null pages " * 20), (None, "k", "only null pages " * 20)]
    return spark.createDataFrame([(*r, r[1]) for r in rows], "page_id long, url string, html string, record_type string").repartition(5), rows


def wanted(rows):
    out, first = [], {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    seen = set()
    for i, _, html in rows:
        data = (html or "").encode()
        ref = first.get(html)
        if ref == i and (i, html) not in seen:
            seen.add((i, html))
            ref = None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [8 << 20, 700])
def test_round_trip(pages, split):
    df, rows = pages
    manifest = warc.write(df)
    got = warc.read(manifest, split=split, payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == wanted(rows)
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    assert {r.url for r in got if r.page_id == 201} == {"u%0D%0AX: y"} and {r.url for r in got if r.page_id == 200} == {None}
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)


def test_empty(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def cut(path, size):
    return [[0, size], [0, 5, 200, size], list(range(0, size, 11)) + [size]]


def one(i, body=b"p" * 50):
    return warc.member(i, "u", body, hashlib.sha256(body).hexdigest(), None, "d", 6)


@pytest.mark.parametrize("between", [b"", b"\0" * 16, warc.MAGIC + b"junk", gzip.compress(b"no record"), warc.MAGIC * 3, b"\x1f\x8b"])
def test_bytes_between_members(tmp_path, between):
    """Padding, gzip magic in other data and a member that is no record are passed over, at every split."""
    path = tmp_path / "a.warc.gz"
    path.write_bytes(between + one(1) + between + one(2) + between)
    for cuts in cut(path, path.stat().st_size):
        found = [(f["x-page-id"], e) for a, z in zip(cuts, cuts[1:]) for _, f, _, e in warc.records(str(path), a, z)]
        assert found == [("1", None), ("2", None)]


def test_damaged_records_are_reported(tmp_path):
    """A record whose body fails is a row with an error, at every split; its neighbours are read."""
    path, noise = tmp_path / "a.warc.gz", random.Random(3).randbytes(3000)
    hurt = bytearray(one(2, noise))
    hurt[len(hurt) // 2] ^= 0xFF
    wrong = warc.member(3, "u", b"other", hashlib.sha256(b"payload").hexdigest(), None, "d", 6)
    last = one(5, noise)
    path.write_bytes(one(1) + bytes(hurt) + wrong + one(4) + last[:-500])
    for cuts in cut(path, path.stat().st_size):
        rows = [warc._row("f", *r) for a, z in zip(cuts, cuts[1:]) for r in warc.records(str(path), a, z)]
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        assert [(r[8] or "").split(":")[0] for r in rows] == ["", "damaged", "payload does not have its digest", "", "cut off"]
    short = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 99\r\n\r\nabc\r\n\r\n")
    path.write_bytes(short)
    assert [e for *_, e in warc.records(str(path), 0, 9)] == ["shorter than its Content-Length"]


def foreign(kind, block, *more, content="application/http; msgtype=response"):
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"Content-Type: {content}", *more]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block)


def test_archives_of_other_writers(spark, tmp_path):
    body = b"<p>text"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    parts = [foreign("warcinfo", b"software: x\r\n", content="application/warc-fields"),
             foreign("request", b"GET / HTTP/1.1\r\n\r\n", "X-Page-Id: none", content="application/http; msgtype=request"),
             foreign("response", http + body, f"WARC-Payload-Digest: sha1:{sha1}", f"Content-Length: {len(http + body)}"),
             foreign("response", http + body + b"!", f"WARC-Payload-Digest: sha1:{sha1}"),
             foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n7\r\n" + body, f"WARC-Payload-Digest: sha1:{sha1}"),
             foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", "WARC-Payload-Digest: blake:xyz"),
             foreign("metadata", b"", content="text/plain"), foreign("response", b"no header end")]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts))
    manifest = spark.createDataFrame([(str(path), path.stat().st_size, 8)], "path string, size long, records long")
    rows = sorted(warc.read(manifest, split=100, payload=True).collect(), key=lambda r: r["at"])
    assert [(r.record_type, r.payload_bytes, r.error) for r in rows] == [
        ("warcinfo", 13, None), ("request", 0, None), ("response", 7, None), ("response", None, "payload does not have its digest"),
        ("response", 10, None), ("revisit", None, None), ("metadata", 0, None), ("response", 0, None)]
    assert rows[2].payload_digest == f"sha1:{sha1}" and bytes(rows[2].payload) == body and rows[0].payload_digest is None
    assert all(r.page_id is None and r.refers_to is None for r in rows)


def test_ranges_are_read_by_many_tasks(spark, pages):
    manifest = warc.write(pages[0].coalesce(1))
    busy = warc.read(manifest, split=2000).select(F.spark_partition_id()).distinct().count()
    assert busy >= 8


def test_a_lost_record_is_noticed(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "staged", lambda df, name: staged(df if name == "manifest" else df.filter("page_id <> 3"), name))
    with pytest.raises(ValueError, match="records read"):
        warc.archived_pages(pages[0])
