"""Legacy archives: ARC files of either version to WARC records, and WARC files to rows.

An ARC file starts with a filedesc record that names its version and, on a line of its own, the fields of the header lines that follow. Version 1 has
URL, IP-address, Archive-date, Content-type, Archive-length; version 2 has Result-code, Checksum, Location, Offset and Filename between the type and the length. A converter
reads each header line by the fields of its version, cuts the body at the declared length, and makes up what WARC asks for: a record id (UUID version 5 of page and payload digest), the time in ISO form, the record
type, and SHA-1 digests of block and payload, which begins after the HTTP head that a body has. A revisit keeps the HTTP head alone and names the response by record id, URI and time.

WARC files, each led by a warcinfo record, are written by Spark's own text writer with the end of a record as line separator, so that they reach any store by its commit protocol, and are read
back whole, one file of about BYTES at a time. That writer compresses a file as one gzip member; Spark has no sink for bytes that would take a member for each record.

Defined results: a null html is an empty payload; a null url is about:blank, and one that looks like a header line of an archive is kept as it is; rows with one page_id and equal payloads are all responses if that id is the largest; among equal payloads null page_ids come before all others; a null page_id is kept as null; an empty table
gives an empty table; columns beside page_id, url and html do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stored

#: The field names of the two versions of the ARC format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
BYTES, LEAST = 16 << 20, 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def arc_file(version: int, name: str, records: list[tuple[str, str, bytes]], at: datetime) -> bytes:
    """An ARC file of (url, content type, body) records."""
    stamp, fields = at.strftime("%Y%m%d%H%M%S"), FIELDS[version]
    head = f"{version} {0 if version == 1 else 1} Archive\n{fields}\n".encode()

    def line(url: str, kind: str, body: bytes, offset: int) -> bytes:
        middle = [] if version == 1 else ["200", hashlib.md5(body).hexdigest(), "-", str(offset), name]
        return " ".join([url, "0.0.0.0", stamp, kind, *middle, str(len(body))]).encode() + b"\n"

    out = bytearray(line(f"filedesc://{name}", "text/plain", head, 0) + head)
    for url, kind, body in records:
        out += b"\n"
        out += line(url, kind, body, len(out)) + body
    return bytes(out) + b"\n"


def arc_records(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, body) of each record of an ARC file after its filedesc.

    Bodies are cut at their declared lengths; a line that doesn't have the fields of the version, or a length beyond the file, raises ValueError.
    """
    at, names = 0, FIELDS[1].split()
    while at < len(raw):
        if raw[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = raw.index(b"\n", at)
        values = raw[at:end].decode("utf-8").rstrip("\r").split(" ")
        first = at == 0 and values[0].startswith("filedesc://")  # elsewhere it is a URL like any other
        if first:
            names = FIELDS[2 if len(values) == len(FIELDS[2].split()) else 1].split()
        if len(values) > len(names):  # a content type may hold spaces
            extra = len(values) - len(names)
            values = values[:3] + [" ".join(values[3 : 4 + extra])] + values[4 + extra :]
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        fields, body = dict(zip(names, values, strict=True)), raw[end + 1 : end + 1 + int(values[-1])]
        if len(body) < int(values[-1]):
            raise ValueError(f"the record at byte {at} is cut off")
        if first:
            told = body.split(b"\n")
            names = FIELDS[int(told[0].split()[0])].split()
            if told[1].decode().split() != names:
                raise ValueError("the filedesc record names other fields than its version has")
        else:
            yield at, fields, body
        at = end + 1 + len(body)


def record_id(page, digest: str) -> str:
    """The id of the record of a page and its payload: rows that repeat each other have one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}/{digest}')}>"


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _written(head: dict[str, str], block: bytes) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), f"Content-Length: {len(block)}\r\n\r\n"]).encode() + block


def warc_info(name: str, at: datetime) -> bytes:
    """The record that leads a file."""
    block = b"software: ARC converter\r\nformat: WARC File Format 1.1\r\n"
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": at.strftime("%Y-%m-%dT%H:%M:%SZ"), "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return _written(head, block)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its empty line, payload) of a body; the head is empty where there is none."""
    end = body.find(b"\r\n\r\n") + 4 if body.startswith(b"HTTP/") else 0
    return (body[:end], body[end:]) if end >= 4 else (b"", body)


def warc_record(page, fields: dict[str, str], body: bytes, extra: dict[str, str], first: tuple | None = None) -> bytes:
    """The WARC record of an ARC record, without the two line ends that close it. first: (page, URI) of the response that it revisits."""
    http, payload = split_http(body)
    digest = _digest(payload)
    date = datetime.strptime(fields["Archive-date"][:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    block = http if first else body
    head = {
        "WARC-Type": "revisit" if first else "response" if http else "resource",
        "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": date,
        "WARC-Target-URI": fields["URL"],
        "WARC-IP-Address": fields["IP-address"],
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": _digest(block),
        "Content-Type": "application/http; msgtype=response" if http else fields["Content-type"],
    }
    if first:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first[0], digest), "WARC-Refers-To-Target-URI": first[1], "WARC-Refers-To-Date": date}
    return _written(head | extra, block)


def warc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file, by declared lengths."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split("\r\n")
        if not re.fullmatch(r"WARC/\d\.\d", lines[0]):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(block) + 4
        if raw[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield head, block


AT = datetime(1996, 12, 24, tzinfo=timezone.utc)


def _uri(url: str | None) -> str:
    return quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%")


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to ARC files of both versions in turn, those to WARC records, gathered to one string of about BYTES for each output file. A batch is bounded by its bytes (shipping.py)."""
    held, size, name = [], 0, ""

    def flush():
        return pa.RecordBatch.from_pydict({"value": pa.array([b"\r\n\r\n".join([warc_info(f"{name}.warc", AT), *held])], pa.binary())})

    for n, batch in enumerate(batches):
        version, rows = n % 2 + 1, batch.to_pylist()
        name = str(uuid.uuid5(uuid.NAMESPACE_OID, repr([r["page_id"] for r in rows])))
        http = lambda body: b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(body)
        arc = arc_file(version, f"{name}.arc", [(_uri(r["url"]), "text/html", http(r["html"]) + r["html"]) for r in rows], AT)
        for r, (_, fields, body) in zip(rows, arc_records(arc), strict=True):
            mine, first = r["page_id"], None if r["refers_to"] is None else (r["refers_to"], _uri(r["first_url"]))
            extra = {"X-Page": "-" if mine is None else str(mine)} | ({"X-Refers-To-Page": str(first[0])} if first else {})
            record = warc_record(mine, fields, body, extra, first)
            if held and size + len(record) > BYTES:
                yield flush()
                held, size = [], 0
            held.append(record)
            size += len(record) + 4
    if held:
        yield flush()


def write_warc(pages: DataFrame, folder: str) -> None:
    """A WARC record for each row of pages (page_id, url, html) in files of about BYTES; equal payloads of LEAST bytes or more after the first are revisits."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("long", F.length("html") >= LEAST)
    groups = rows.where("long").groupBy("digest").agg(F.max("page_id").alias("first"), F.max(F.struct("page_id", "url"))["url"].alias("first_url"), F.count("*").alias("n")).where("n > 1")
    groups = stored(groups.select(F.col("digest").alias("d"), "first", "first_url"), "warc-groups")
    joined = rows.join(groups, (F.col("digest") == F.col("d")) & F.col("long"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    records = joined.select("page_id", "url", "html", refers.alias("refers_to"), "first_url").mapInArrow(_converted, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).option("compression", "gzip").text(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    for batch in batches:
        for raw in batch.column("content"):
            out = {"page_id": [], "url": [], "digest": [], "record_type": [], "refers_to": [], "block": []}
            for head, block in warc_records(gzip.decompress(raw.as_py())):
                if head["WARC-Type"] == "warcinfo":
                    continue
                payload = split_http(block)[1]
                out["page_id"].append(None if head["X-Page"] == "-" else int(head["X-Page"]))
                out["url"].append(head["WARC-Target-URI"])
                out["digest"].append(base64.b32decode(head["WARC-Payload-Digest"][5:]).hex())
                out["record_type"].append(head["WARC-Type"])
                out["refers_to"].append(int(head["X-Refers-To-Page"]) if head["WARC-Type"] == "revisit" else None)
                if head["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != out["digest"][-1]:
                    raise ValueError("a payload doesn't match its digest")
                out["block"].append(payload)
            yield pa.RecordBatch.from_pydict(out, schema=_ROWS)


_ROWS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])
_SQL = "page_id long, url string, digest string, record_type string, refers_to long, block binary"


def read_warc(spark, folder: str) -> DataFrame:
    """page_id, url, digest, record_type, refers_to, block (the payload) of each record; a revisit's is empty."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(_read, _SQL)


def archive(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of pages, read back from archives just written."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, folder)
    rows = read_warc(spark, folder).withColumn("own", F.octet_length("block").cast("long"))
    slim = stored(rows.select("page_id", "digest", "record_type", "refers_to", "own"), "warc-rows")
    # A revisit has no block: its length is that of the response it refers to.
    sizes = slim.where("record_type = 'response'").join(slim.where("record_type = 'revisit'").select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.max("own").alias("full"))
    sizes = stored(sizes.withColumnRenamed("digest", "d"), "warc-sizes")
    rows = slim.join(sizes, (F.col("digest") == F.col("d")) & (F.col("record_type") == "revisit"), "left")
    return rows.select("page_id", F.coalesce("full", "own").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
