"""WARC archives: round trip of pages against plain Python, foreign and damaged streams, the index."""

import base64
import gzip
import hashlib
import io
import os
import zlib

import pytest

from codeloom.llm import warc as W

PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "http://a/x\r\nWARC-Type: x y", "é日\U0001f389"),
         (-7, "http://a/neg", "<p>one</p>"), (2 ** 63 - 1, "u", "big"), (-2 ** 63, "u", "big"), (None, "no id", "<p>one</p>"), (None, "no id", "only here"),
         (9, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n"), (10, "u", "x" * 3_000_000), (11, "u", "x" * 3_000_000),
         (12, "u", "\r\n\r\n"), (2, "http://a/2", "<p>one</p>"), (-7, "http://a/neg", "<p>one</p>")] + [(100 + i, "hot", "same") for i in range(500)]


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(pages, least=0):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in pages:
        b, to = (html or "").encode(), first.get(html or "")
        again = len(b) >= least and to is not None and i != to
        out.append((i, len(b), digest(b), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def frame(spark, pages):
    return spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, payload string, first int")


@pytest.mark.parametrize("least", [0, 11])
def test_round_trip(spark, scratch, least):
    got = W.round_trip(frame(spark, PAGES).repartition(3), scratch, min_bytes=least, archive_bytes=2_000_000).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(PAGES, least)
    assert all(r.digest_ok is (True if r.record_type == "response" else None) for r in got)


def test_payloads_and_uris(spark, scratch):
    got = W.round_trip(frame(spark, PAGES[:7]), scratch, keep_payload=True).collect()
    want = {i: html or "" for i, _, html in PAGES[:7]}
    for r in got:
        if r.record_type == "response":
            assert bytes(r.payload).decode() == want[r.page_id]
    assert {r.page_id: r.target_uri for r in got}[5] == "http://a/x%0D%0AWARC-Type:%20x%20y"


def test_empty_table(spark, scratch):
    assert W.round_trip(frame(spark, PAGES).limit(0), scratch).count() == 0


def test_ids():
    for i in (0, 1, -1, 2 ** 63 - 1, -2 ** 63, 65535, 65536, 1 << 40, None):
        assert W.page_of(W.record_id(i)) == i
    assert W.page_of("<urn:uuid:6ba7b810-9dad-11d1-80b4-00c04fd430c8>") is None and W.page_of(None) is None


def test_every_member_stands_alone(spark, scratch):
    files = W.write_archives(frame(spark, PAGES[:16]).coalesce(1), scratch + "/s")
    (path, records, _), = files.collect()
    assert zlib.decompressobj(31).decompress(open(path, "rb").read()).count(b"WARC-Record-ID") == records + 1     # one member
    (r,) = W.normalise(files, scratch + "/n").collect()
    data = open(r.normalised, "rb").read()
    lines = [x.split("\t") for x in open(r.sidecar).read().splitlines()]
    assert len(data) == r.bytes and len(lines) == r.records == records + 1 and r.error is None
    whole = b""
    for offset, length, kind, rid in lines:
        one = gzip.decompress(data[int(offset):int(offset) + int(length)])
        assert one.startswith(b"WARC/1.1\r\n") and f"WARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n".encode() in one
        whole += one
    assert whole == gzip.decompress(open(path, "rb").read()) == gzip.decompress(data)


def streams():
    """Records, and files of them in the shapes that are met: one stream, a member each, mixed, padded, cut, foreign."""
    recs = [W.page_record(i, f"http://h/{i}", (f"page {i} " * i).encode(), None) for i in range(1, 9)]
    whole = gzip.compress(b"".join(recs))
    return recs, {"whole": whole, "single": b"".join(map(gzip.compress, recs)), "mixed": gzip.compress(b"".join(recs[:5])) + gzip.compress(b"".join(recs[5:])),
                  "padded": whole + b"\0" * 700, "cut": whole[:-40], "tail": gzip.compress(b"".join(recs)[:-100]), "empty": b"", "none": gzip.compress(b""),
                  "plain": b"".join(recs), "foreign": gzip.compress(b"GET / HTTP/1.0\r\n\r\n"), "split": gzip.compress(b"".join(recs)[:333]) + gzip.compress(b"".join(recs)[333:])}


def test_streams_of_every_shape(spark, scratch, monkeypatch):
    monkeypatch.setattr(W, "STEP", 64)                   # pieces end anywhere
    recs, files = streams()
    for name, raw in files.items():
        got, error = [], None
        try:
            for member, _, _ in W.members(io.BytesIO(raw).read):
                got.append(gzip.decompress(member))
        except W.Damaged as e:
            error = str(e)
        if name in ("empty", "none"):
            assert got == [] and error is None
        elif name in ("plain", "foreign"):
            assert got == [] and error
        elif name in ("cut", "tail"):
            assert got == recs[:len(got)] and error and len(got) >= 5, (name, len(got))
        else:
            assert got == recs and error is None, name


def test_damage_is_reported(spark, scratch):
    _, files = streams()
    for name, raw in files.items():
        open(os.path.join(scratch, name), "wb").write(raw)
    listed = spark.createDataFrame([(os.path.join(scratch, n),) for n in files] + [(None,)], "path string")
    done = W.normalise(listed, scratch + "/n")
    rows = {os.path.basename(r.path): r for r in done.collect()}
    assert len(rows) == len(files) and {n for n, r in rows.items() if r.error} == {"cut", "tail", "plain", "foreign"}
    assert W.read_records(done).count() == sum(r.records for r in rows.values())


def test_index_reads_a_part(spark, scratch, monkeypatch):
    pages = frame(spark, [(i, "u", f"{i}" * 50) for i in range(300)]).coalesce(1)
    done = W.normalise(W.write_archives(pages, scratch + "/s"), scratch + "/n")
    monkeypatch.setattr(W, "SLAB", 2000)
    monkeypatch.setattr(W, "READ_AHEAD", 500)
    got = W.read_records(done)
    assert got.rdd.getNumPartitions() > 10
    assert sorted(bytes(r.payload).decode() for r in got.collect()) == sorted(f"{i}" * 50 for i in range(300))
    assert W.read_records(done, types=("warcinfo",)).count() == 1
