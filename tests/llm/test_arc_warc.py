from __future__ import annotations

import base64
import hashlib
import io

import pytest

from stockbook.llm import arc_warc as A
from stockbook.session import scratch_path
from tests.llm import corpus  # noqa: F401 - same fixtures folder

PAGES = [(1, "http://a.example.com/x", "<p>one</p>"), (2, "http://b.example.com/", "<p>one</p>"),
         (3, None, None), (4, "http://c.example.com/ä b", ""), (5, "http://d.example.com/", "é漢🙂\r\n\r\nWARC/1.1\n"),
         (6, "http://e.example.com/", "x" * 300_000), (7, "http://e.example.com/", "x" * 300_000),
         (7, "http://e.example.com/", "x" * 300_000), (None, "http://f.example.com/", "<p>one</p>"),
         (-9, "http://g.example.com/", "HTTP/1.1 200 OK\r\n\r\nnested")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash") for r in rows],
                                 "page_id bigint, url string, html string, digest string")


def brute(rows):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", -2**63), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = top.get(h or "", i)
        revisit = first is not None and (i is None or i < first)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark):
    out = A.round_trip(A.arc_of_pages(pages(spark), records=3)).collect()
    assert sorted(map(tuple, out), key=str) == brute(PAGES)


@pytest.mark.parametrize("version", [1, 2])
def test_both_versions_are_parsed(version):
    data = A._arc("t.arc", version, [(1, "http://a/", "<p>x</p>\n\n".encode()), (2, "http://b/", b"")])
    got = list(A.parse_arc(data))
    assert [r["URL"] for r in got] == ["http://a/", "http://b/"]
    assert A.split_http(got[0]["body"])[1] == b"<p>x</p>\n\n"
    assert ("Result-code" in got[0]) == (version == 2)


def test_damaged_archives_are_errors():
    data = A._arc("t.arc", 1, [(1, "http://a/", b"<p>x</p>")])
    with pytest.raises(ValueError):
        list(A.parse_arc(data[:-6]))
    with pytest.raises(ValueError):
        list(A.parse_arc(b"no archive 0 0 0\n"))


def test_records_are_members_of_their_own(spark):
    path = scratch_path(spark, "warc")
    manifest = A.write_warc(A.assign_types(A.convert(A.arc_of_pages(pages(spark)))), path)
    fs, base = A.file_system(path)
    seen = []
    for r in manifest.collect():
        with fs.open_input_stream(f"{base}/{r.file}", compression=None) as src:
            records = list(A.parse_warc(src))
        assert records[0][0]["WARC-Type"] == "warcinfo" and len(records) == r.records + 1
        seen += records[1:]
    assert len(seen) == len(PAGES)
    for fields, block in seen:
        assert fields["WARC-Date"].endswith("Z") and fields["Content-Type"].startswith("application/http")
        if fields["WARC-Type"] == "revisit":
            assert A.split_http(block)[1] == b"" and "WARC-Refers-To" in fields


def test_record_ids_hold_the_page():
    for page in (0, 1, -1, 2**63 - 1, -2**63, None):
        urn = A.record_id(page, "http://a/", "20010101000000")
        assert A.page_of(urn) == page and urn.startswith("urn:uuid:")
    assert A.record_id(1, "a", "1") != A.record_id(1, "b", "1")


def test_a_cut_file_is_noticed():
    member = A._member(A.warc_record([("WARC-Type", "warcinfo")], b"x"))
    assert len(list(A.parse_warc(io.BytesIO(member * 2)))) == 2
    with pytest.raises(ValueError):
        list(A.parse_warc(io.BytesIO(member[:-9])))


def test_empty_table(spark):
    assert A.round_trip(A.arc_of_pages(pages(spark, []))).count() == 0


def foreign_arc(records):
    """A version 1 archive of another crawler: no page ids, no HTTP lengths."""
    head = b"1 0 Elsewhere\nURL IP-address Archive-date Content-type Archive-length\n\n"
    out = b"filedesc://other.arc 0.0.0.0 20010101000000 text/plain %d\n" % len(head) + head
    for url, date, payload in records:
        body = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" + payload
        out += f"{url} 10.0.0.1 {date} text/html {len(body)}\n".encode() + body + b"\n"
    return out


def test_archives_of_others_get_revisits(spark):
    same = b"<p>an equal payload</p>" * 40
    records = [("http://a.org/", "20010203040506", same), ("http://b.org/", "20020203040506", same),
               ("http://c.org/", "20020203040506", same), ("http://d.org/", "20030203040506", b"own"),
               ("http://c.org/", "20020203040506", same)]
    arcs = spark.createDataFrame([("other.arc", bytearray(foreign_arc(records)))], "name string, arc binary")
    path = scratch_path(spark, "warc-foreign")
    manifest = A.write_warc(A.assign_types(A.convert(arcs)), path)
    out = sorted((r.record_type, r.payload_bytes, r.page_id, r.refers_to) for r in A.read_warc(manifest, path).collect())
    n = len(same)
    # the latest by date, then by URL, is the response (and what repeats it); lengths are of the full payload
    assert out == [("response", 3, None, None), ("response", n, None, None), ("response", n, None, None),
                   ("revisit", n, None, None), ("revisit", n, None, None)]
    named = []
    fs, base = A.file_system(path)
    for r in manifest.collect():
        with fs.open_input_stream(f"{base}/{r.file}", compression=None) as src:
            named += [f["WARC-Refers-To-Target-URI"] for f, _ in A.parse_warc(src) if f["WARC-Type"] == "revisit"]
    assert named == ["http://c.org/"] * 2
