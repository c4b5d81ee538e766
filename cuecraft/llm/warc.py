"""WARC records in ZIP-packaged web archives: written by tasks, read back by range.

An archive is a ZIP with two stored members, the records, each a gzip member of its own as
WARC files have them (archive/data.warc.gz), and an index
of them (indexes/index.cdxj). The reader parses the central directory, with ZIP64 fields
where there are any, finds the two members and reads single records in place.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, shared_dir, shuffle_width, slices
from .files import Ranges, create, new_file

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Neighbouring records are read at once up to so many bytes.
READ_BYTES = 4 << 20
#: A payload counts as frequent from the so many-th part of what one task reads on average.
OFTEN = 4


def with_facts(rows: DataFrame, facts: DataFrame, key: str, total: int, *spread: str) -> DataFrame:
    """Rows with the columns of ``facts`` (key, n, ...), one row a key that n of the rows have; null where there is none.

    Keys that more than a part in OFTEN times the shuffle's width of all ``total`` rows have, at most
    that many, are broadcast, and their rows are dealt by ``spread``; all others meet by key.
    """
    names = [c for c in facts.columns if c not in (key, "n")]
    many = F.col("n") > total / (OFTEN * shuffle_width(rows.sparkSession))
    often = facts.filter(many).select(key, *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__often"))
    marked = rows.join(F.broadcast(often), key, "left")
    own = F.when(F.col("__often"), F.concat(F.lit("~"), F.xxhash64(*spread).cast("string"))).otherwise(F.col(key))
    joined = marked.withColumn("__own", own).join(facts.filter(~many).select(F.col(key).alias("__own"), *names), "__own", "left")
    return joined.select(*rows.columns, *[F.coalesce(f"__{c}", c).alias(c) for c in names])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_uri(url: str | None) -> str:
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    block = HTTP % len(payload) + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_header_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; a revisit has an empty payload."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{payload_digest(payload)}":
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload's digest is another")
    return headers, payload


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Writes the pages (page_id, url, html) and returns one row (path, records, bytes) per archive.

    Of pages with equal payloads of at least ``min_payload`` bytes the one with the smallest
    id is a response and the others revisit it; smaller payloads are all responses. The
    payload is the html in UTF-8, null counts as empty. A null id sorts first; rows that
    repeat the id of the response are responses too. No pages give no archives.

    Equal payloads are counted on their digests, folded before the shuffle; pages of a frequent
    payload are spread over all tasks and archives. The returned
    table is already written, and only archives it names count: what a lost task left
    behind is never read.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    first = (
        rows.filter(F.octet_length("html") >= min_payload)
        .groupBy("sha")
        .agg(F.min_by(F.struct("page_id"), F.struct(F.col("page_id").isNotNull(), F.col("page_id"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    rows = with_facts(rows, materialise(first, "copies"), "sha", pages.count(), "page_id", "url").select(
        "page_id", "url", "html", F.col("first.page_id").alias("refers_to"),
        (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))).alias("revisit"),
    )
    return materialise(rows.mapInArrow(lean(_writer(folder)), "path string, records long, bytes long"), "archives")


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = slices(batches, "html")
        batch = next(batches, None)
        if batch is None:
            return
        path, index, at = new_file(folder, ".wacz"), [], 0
        with create(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
            with archive.open(DATA, "w", force_zip64=True) as data:
                while batch is not None:
                    for row in batch.to_pylist():
                        payload = row["html"].encode()
                        digest = payload_digest(payload)
                        made = record(row["page_id"], row["url"], payload, digest, row["refers_to"], row["revisit"])
                        data.write(made)
                        index.append(json.dumps({"url": row["url"], "page_id": row["page_id"], "offset": at, "length": len(made)}))
                        at += len(made)
                    batch = next(batches, None)
            archive.writestr(INDEX, "".join(x + "\n" for x in index))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64()), pa.array([at], pa.int64())], ["path", "records", "bytes"])

    return run


def members(source: Ranges, path: str) -> dict[str, tuple[int, int]]:
    """Place and size of each stored member, from the central directory."""
    size = source.open(path).size()
    tail_at = max(0, size - 22 - 65535)
    tail = source.read(path, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError(f"{path}: no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        signature, _, where, _ = struct.unpack("<4sIQI", source.read(path, tail_at + at - 20, 20))
        if signature != b"PK\x06\x07":
            raise ValueError(f"{path}: no ZIP64 locator")
        count, length, offset = struct.unpack_from("<QQQ", source.read(path, where, 56), 32)
    directory, found, at = source.read(path, offset, length), {}, 0
    for _ in range(count):
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_comment
        k = 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # ZIP64: only the fields that do not fit are there, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + n
        if method:
            continue  # packed members have no records that can be read in place
        n_name, n_extra = struct.unpack("<HH", source.read(path, header + 26, 4))
        found[name] = (header + 30 + n_name + n_extra, plain)
    return found


def archive_index(archives: DataFrame) -> DataFrame:
    """One row (path, offset in the file, length, page_id, url) per record of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Ranges()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = members(source, path)
                start = found[DATA][0]
                rows = [json.loads(x) for x in source.read(path, *found[INDEX]).decode().splitlines()]
                yield pa.RecordBatch.from_pylist(
                    [{"path": path, "offset": start + x["offset"], "length": x["length"], "page_id": x["page_id"], "url": x["url"]} for x in rows],
                    pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string())]),
                )

    return archives.select("path").mapInArrow(lean(run), "path string, offset long, length long, page_id long, url string")


READ = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary"


def read_records(index: DataFrame) -> DataFrame:
    """The records that the index rows name, each read in place; neighbours at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Ranges()
        for batch in batches:
            rows, k = batch.to_pylist(), 0
            while k < len(rows):
                n, path, start = k + 1, rows[k]["path"], rows[k]["offset"]
                end = start + rows[k]["length"]
                while n < len(rows) and rows[n]["path"] == path and rows[n]["offset"] == end and end - start < READ_BYTES:
                    end += rows[n]["length"]
                    n += 1
                data, out = source.read(path, start, end - start), []
                for row in rows[k:n]:
                    at = row["offset"] - start
                    headers, payload = parse_record(data[at : at + row["length"]])
                    revisit = headers["WARC-Type"] == "revisit"
                    to = headers["WARC-Refers-To"][len("<urn:page:") : -1] if revisit else "None"
                    out.append((row["page_id"], row["url"], headers["WARC-Type"], headers["WARC-Payload-Digest"][5:], None if to == "None" else int(to), None if revisit else payload))
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in READ.split(", ")])
                k = n

    return index.mapInArrow(lean(run), READ)


def warc_round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Archives the pages and returns page_id, payload_bytes, payload_digest, record_type, refers_to as read back.

    A revisit has no payload of its own: its size is that of the response with its digest.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    read = read_records(archive_index(write_archives(pages, folder, min_payload)))
    read = materialise(
        read.select("page_id", "payload_digest", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes")), "records"
    )
    wanted = read.filter("record_type = 'revisit'").drop("payload_bytes")
    counts = wanted.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"))
    bytes_of = read.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    sizes = materialise(counts.join(bytes_of, "payload_digest"), "sizes")
    revisits = with_facts(wanted, sizes, "payload_digest", wanted.count(), "page_id")
    return read.filter("record_type = 'response'").unionByName(revisits)
