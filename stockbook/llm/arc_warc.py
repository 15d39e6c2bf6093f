"""Operator 3, legacy archives: ARC records converted to WARC files.

``convert`` parses ARC archives (version 1 and version 2 header lines; the
field names come from the archive's own definition line) by their declared
lengths. ``write_warc`` synthesises the WARC fields an ARC lacks: record ids,
ISO timestamps, record types and SHA-1 digests. Of the records with equal
payloads the one with the largest page_id is the ``response`` (in archives
without page ids the latest by date, then by URL), the others are ``revisit``
records that name it and keep the length of the full payload in a field. Files have one gzip member per record, so a
reader can start at any record. ``read_warc`` parses the files back by
Content-Length.

A record id is a version-8 UUID that holds the page_id and a hash of the
target and date, so a revisit's reference can be resolved without an index.

Tasks write files under names of their own and list them in a manifest; a file
that is not listed (of a lost or repeated task) is ignored.

Defined results: null html is an empty payload; a null url is ``urn:unknown``;
a null page_id counts as smallest; records that repeat the response's page_id
(or, without one, its date and URL) are all responses; a declared length beyond the archive's end is an
error; other columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import hot_join, stored
from stockbook.llm.token_store import file_system
from stockbook.session import scratch_path

MIN_PAYLOAD = 0  # smaller payloads are never revisits
GZIP_LEVEL = 3
#: Extension field of revisits: bytes of the payload that is not repeated.
FULL_LENGTH = "X-Full-Payload-Length"
RECORDS = ("page_id bigint, url string, ip string, date string, mime string, http binary, "
           "payload binary, digest string")
# The definition lines of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
       "Archive-length",
}


# ---- stand-in input ----------------------------------------------------------

def arc_of_pages(pages: DataFrame, records: int = 200) -> DataFrame:
    """(name, arc): ``pages`` (page_id, url, html) as small ARC archives of both versions."""
    def run(batches):
        for b in batches:
            ids, urls, html = (c.to_pylist() for c in b.columns)
            for at in range(0, len(ids), records):
                name = f"{uuid.uuid4().hex}.arc"
                part = zip(ids[at:at + records], urls[at:at + records], html[at:at + records], strict=True)
                yield pa.RecordBatch.from_pydict({
                    "name": [name], "arc": pa.array([_arc(name, 1 + at // records % 2, part)], pa.binary())})

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"),
                        F.col("url").cast("string").alias("url"),
                        F.col("html").cast("binary").alias("html")).mapInArrow(
                            run, "name string, arc binary")


def _arc(name: str, version: int, pages) -> bytes:
    head = f"{version} 0 crawler\n{FIELDS[version]}\n\n".encode()
    more = "" if version == 1 else "200 - - 0 - "
    out = [f"filedesc://{name} 0.0.0.0 20010101000000 text/plain {more}{len(head)}\n".encode() + head, b"\n"]
    for page_id, url, html in pages:
        payload = html or b""
        number = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        body = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}"
                f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload
        target = "urn:unknown" if url is None else _quoted(url)
        second = (page_id or 0) % 86400
        date = f"20010101{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}"
        out += [f"{target} 0.0.0.0 {date} text/html {more}{len(body)}\n".encode(), body, b"\n"]
    return b"".join(out)


def _quoted(url: str) -> str:
    """A header line is split at blanks: white space and controls are percent-encoded."""
    if url.isprintable() and " " not in url:
        return url or "urn:unknown"
    return "".join(c if c.isprintable() and not c.isspace() else
                   "".join(f"%{b:02X}" for b in c.encode()) for c in url)


# ---- ARC to records ----------------------------------------------------------

def parse_arc(data: bytes) -> Iterator[dict]:
    """The records behind the version block of one ARC archive."""
    def line(at: int) -> tuple[bytes, int]:
        end = data.index(b"\n", at)
        return data[at:end].rstrip(b"\r"), end + 1

    def body(at: int, length: int) -> bytes:
        if at + length > len(data):
            raise ValueError("the declared length goes beyond the archive")
        return data[at:at + length]

    first, at = line(0)
    length = int(first.rsplit(b" ", 1)[1])
    if not first.startswith(b"filedesc://"):
        raise ValueError("not an ARC archive")
    block = body(at, length).split(b"\n")
    version = int(block[0].split(b" ", 1)[0])
    if version not in FIELDS:
        raise ValueError(f"ARC version {version}")
    names = block[1].decode().strip().split(" ")
    at += length
    while True:
        while data[at:at + 1] in (b"\n", b"\r"):  # separators between records
            at += 1
        if at >= len(data):
            return
        header, at = line(at)
        values = header.decode("utf-8", "replace").split(" ")
        if len(values) != len(names):
            raise ValueError(f"{len(values)} fields where version {version} has {len(names)}")
        record = dict(zip(names, values, strict=True))
        length = int(record["Archive-length"])
        record["body"] = body(at, length)
        at += length
        yield record


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with their empty line, payload)."""
    if body.startswith(b"HTTP/"):
        end = body.find(b"\r\n\r\n")
        if end >= 0:
            return body[:end + 4], body[end + 4:]
    return b"", body


def http_field(head: bytes, name: bytes) -> str | None:
    for row in head.split(b"\r\n")[1:]:
        key, _, value = row.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode("latin-1")
    return None


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def convert(arcs: DataFrame) -> DataFrame:
    """Records of (name, arc) rows; see RECORDS."""
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = []
                for r in parse_arc(data or b""):
                    http, payload = split_http(r["body"])
                    page = http_field(http, b"x-page-id")
                    rows.append((int(page) if page else None, r["URL"], r["IP-address"], r["Archive-date"],
                                 r["Content-type"], http, payload, sha1_base32(payload)))
                if rows:
                    kinds = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=names)

    return arcs.where(F.col("arc").isNotNull()).select("arc").mapInArrow(run, RECORDS)


# ---- WARC --------------------------------------------------------------------

def record_id(page_id: int | None, url: str, date: str) -> str:
    """A version-8 UUID of (null flag, 64 bits of page_id, 57 bits of hash)."""
    h = int.from_bytes(hashlib.sha1(f"{url} {date}".encode()).digest()[:8], "big") >> 7
    n = (int(page_id is None) << 121) | (((page_id or 0) & (2**64 - 1)) << 57) | h
    a, b, c = n >> 74, n >> 62 & 0xFFF, n & (2**62 - 1)
    return f"urn:uuid:{uuid.UUID(int=a << 80 | 8 << 76 | b << 64 | 2 << 62 | c)}"


def page_of(urn: str) -> int | None:
    u = uuid.UUID(urn.removeprefix("urn:uuid:")).int
    n = (u >> 80) << 74 | (u >> 64 & 0xFFF) << 62 | (u & (2**62 - 1))
    if n >> 121:
        return None
    page = n >> 57 & (2**64 - 1)
    return page - 2**64 if page >> 63 else page


def iso(date: str) -> str:
    d = (date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def assign_types(records: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``records`` with is_revisit, refers_to, refers_url, refers_date (for revisits only).

    Of equal payloads the response is the record with the largest page id; where
    no record has one (archives of others), the latest by date, then by URL.
    """
    big = F.octet_length("payload") >= min_payload
    groups = stored(records.where(big).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("page_id", "date", "url")).alias("r")).where(F.col("n") > 1)
        .select("digest", "n", F.col("r.page_id").alias("refers_to"), F.col("r.url").alias("refers_url"),
                F.col("r.date").alias("refers_date")), "warc-payload")
    joined = hot_join(records, groups, ["digest"], rows="n", how="left")
    none = F.lit(-2**63)
    earlier = F.struct("date", "url") < F.struct("refers_date", "refers_url")
    older = (F.coalesce("page_id", none) < F.coalesce("refers_to", none)) | (
        F.col("page_id").isNull() & F.col("refers_to").isNull() & earlier)
    revisit = F.coalesce(big & F.col("refers_date").isNotNull() & older, F.lit(False))
    return joined.withColumns({"is_revisit": revisit} | {
        c: F.when(revisit, F.col(c)) for c in ("refers_to", "refers_url", "refers_date")})


def write_warc(typed: DataFrame, path: str) -> DataFrame:
    """Write the records as .warc.gz files below ``path``; the manifest (file, records)."""
    columns = ["page_id", "url", "ip", "date", "http", "payload", "digest", "is_revisit", "refers_to",
               "refers_url", "refers_date"]

    def run(batches):
        out, n = None, 0
        for b in batches:
            for page, url, ip, date, http, payload, digest, again, ref, ref_url, ref_date in zip(
                    *(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs, base = file_system(path)
                    fs.create_dir(base, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(_member(warc_record([
                        ("WARC-Type", "warcinfo"), ("WARC-Date", iso(date)),
                        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Filename", name),
                        ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                fields = [
                    ("WARC-Type", "revisit" if again else "response"),
                    ("WARC-Record-ID", f"<{record_id(page, url, date)}>"),
                    ("WARC-Target-URI", url), ("WARC-Date", iso(date)), ("WARC-IP-Address", ip),
                    ("WARC-Payload-Digest", f"sha1:{digest}")]
                block = http
                if not again:
                    block = http + payload
                    fields.append(("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"))
                else:
                    fields += [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", f"<{record_id(ref, ref_url, ref_date)}>"),
                        ("WARC-Refers-To-Target-URI", ref_url), ("WARC-Refers-To-Date", iso(ref_date)),
                        (FULL_LENGTH, str(len(payload)))]
                fields.append(("Content-Type", "application/http; msgtype=response"))
                out.write(_member(warc_record(fields, block)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    return stored(typed.select(*columns).mapInArrow(run, "file string, records bigint"), "warc-manifest")


def parse_warc(src) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of an open .warc.gz stream, one member at a time."""
    pending, z = b"", None
    member: list[bytes] = []
    while True:
        if not pending:
            pending = src.read(1 << 20)
            if not pending:
                if z is not None:
                    raise ValueError("the file ends inside a record")
                return
        z = z or zlib.decompressobj(31)
        member.append(z.decompress(pending))
        pending = z.unused_data
        if z.eof:
            yield _parse_record(b"".join(member))
            z, member = None, []


def _parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    end = data.index(b"\r\n\r\n")
    version, *rows = data[:end].split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for row in rows:
        key, _, value = row.decode().partition(":")
        fields[key.strip()] = value.strip()
    n = int(fields["Content-Length"])
    block = data[end + 4:end + 4 + n]
    if len(block) != n or data[end + 4 + n:] != b"\r\n\r\n":
        raise ValueError("the declared length does not fit")
    return fields, block


def read_warc(manifest: DataFrame, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the files."""
    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, base = file_system(path)
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as src:
                    for fields, block in parse_warc(src):
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        http, payload = split_http(block)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        ref = fields.get("WARC-Refers-To")
                        size = len(payload)
                        if ref is not None:  # the full payload is in the record it names
                            size = int(fields[FULL_LENGTH])
                        elif sha1_base32(payload) != digest:
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
                        rows.append((page_of(fields["WARC-Record-ID"].strip("<>")), size, digest,
                                     fields["WARC-Type"], page_of(ref.strip("<>")) if ref else None))
                        if len(rows) >= 5000:
                            yield _read_batch(rows)
                            rows = []
                if rows:
                    yield _read_batch(rows)

    files = manifest.count()  # one row per file
    return manifest.select("file").repartition(max(1, files), "file").mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def round_trip(arcs: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Convert ARC archives to WARC files in the shared folder and read them back."""
    path = scratch_path(arcs.sparkSession, "warc")
    return read_warc(write_warc(assign_types(convert(arcs), min_payload), path), path)
