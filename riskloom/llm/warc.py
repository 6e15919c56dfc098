"""Web archives: written with an index, read back by coalesced byte ranges.

Every record is a gzip member of its own. The index holds file, offset, length, URL and digest per
record; a read sorts the chosen entries, merges neighbours into ranges and fetches each range at once.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources.tables import scratch_path, stored

#: A file is closed beyond FILE_BYTES; a read covers records that start within RANGE_BYTES, and
#: jumps over gaps of more than GAP_BYTES.
FILE_BYTES, RANGE_BYTES, GAP_BYTES = 1 << 28, 1 << 23, 1 << 16
INDEX = ("page_id long, url string, payload_digest string, record_type string, refers_to long, "
         "file string, offset long, length long")
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
          "payload binary")


def record(page_id, url, digest: str, refers_to, payload: bytes | None) -> bytes:
    """One compressed record; without payload it is a revisit."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if payload is None else b"response"),
            b"WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        head.append(b"WARC-Record-ID: <urn:page:%d>" % page_id)
    if url is not None:
        # Control characters would end the header line; a literal percent sign keeps them apart.
        safe = quote(url, safe="%/:=&?~#+!$,;'@()*[]| ") if any(ord(c) < 32 or ord(c) > 126 for c in url) else url
        head.append(b"WARC-Target-URI: " + safe.encode())
    head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if payload is None:
        if refers_to is not None:
            head.append(b"WARC-Refers-To: <urn:page:%d>" % refers_to)
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        block = b""
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        head.append(b"Content-Type: application/http; msgtype=response")
        block += payload
    head.append(b"Content-Length: %d" % len(block))
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> dict:
    """Headers and payload of one uncompressed record, checked against length and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(b": ", 1) for line in lines[1:])
    size = int(fields[b"Content-Length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")

    def page(name):
        return int(fields[name][len(b"<urn:page:"):-1]) if name in fields else None

    kind = fields[b"WARC-Type"].decode()
    url = fields.get(b"WARC-Target-URI")
    return {"page_id": page(b"WARC-Record-ID"), "url": None if url is None else url.decode(),
            "record_type": kind, "refers_to": page(b"WARC-Refers-To"),
            "payload_digest": fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"),
            "payload": block.partition(b"\r\n\r\n")[2] if kind == "response" else None}


def write(pages: DataFrame, folder: str, min_bytes: int = 0, page_id: str = "page_id",
          url: str = "url", html: str = "html") -> DataFrame:
    """Write one record per row into archives under `folder`; returns the stored index.

    The payload is the html in UTF-8, empty for NULL. Of rows with equal payloads of at least
    `min_bytes` bytes those with the largest page_id become responses and the others revisits of it;
    a NULL page_id is the smallest. Each task writes files of names of its own and hands over their
    index rows only when it ends, so a repeated task leaves at most files that no index row names.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        body.alias("payload"), F.sha1(body).alias("sha1"))
    shared = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1")
              .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL")
              .select("sha1", "last"))
    typed = rows.join(shared, "sha1", "left").select(
        "page_id", "url", "payload", "sha1",
        F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at, index = None, "", 0, []
        try:
            for batch in batches:
                for row in range(batch.num_rows):
                    p, u, payload, sha1, refers = (batch.column(i)[row].as_py() for i in range(5))
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    data = record(p, u, digest, refers, payload if refers is None else None)
                    out.write(data)
                    index.append((p, u, digest, "response" if refers is None else "revisit", refers,
                                  name, at, len(data)))
                    at += len(data)
                    if at >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()),
                            ("offset", pa.int64()), ("length", pa.int64())])
        for low in range(0, len(index), 10_000):
            part = list(zip(*index[low:low + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, schema)], schema=schema)

    return stored(typed.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows given: page_id, url, record_type, refers_to, digest, payload.

    A revisit's payload is NULL. Records that start in the same stretch of a file are read by one
    task; neighbours are fetched in one piece. A record whose payload does not have its digest, or
    that does not fill its index entry, raises an error.
    """
    spots = index.groupBy("file", F.floor(F.col("offset") / RANGE_BYTES).alias("stretch")).agg(
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("spots")).select("file", "spots")
    # The table of spots is small, what it points at is not: as many tasks as there are stretches of bytes.
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    spots = spots.repartition(max(1, -(-total // RANGE_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for name, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ranges = []
                for s in spots:
                    if ranges and s["offset"] - ranges[-1][1] <= GAP_BYTES:
                        ranges[-1][1] = s["offset"] + s["length"]
                        ranges[-1][2].append(s)
                    else:
                        ranges.append([s["offset"], s["offset"] + s["length"], [s]])
                with store.open_input_file(f"{base}/{name}") as source:
                    for low, high, inside in ranges:
                        data = source.read_at(high - low, low)
                        out = []
                        for s in inside:
                            at = s["offset"] - low
                            unpacker = zlib.decompressobj(31)
                            one = parse(unpacker.decompress(data[at:at + s["length"]]))
                            if unpacker.unused_data or not unpacker.eof:
                                raise ValueError("a record does not fill its index entry")
                            if one["payload"] is not None:
                                found = base64.b32encode(hashlib.sha1(one["payload"]).digest()).decode()
                                if found != one["payload_digest"]:
                                    raise ValueError("a payload differs from its digest")
                            out.append(one)
                        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return spots.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read all records back and resolve revisits: one row per page."""
    folder = scratch_path(pages.sparkSession, "warc")
    records = read(write(pages, folder, min_bytes), folder).withColumn(
        "bytes", F.octet_length("payload").cast("long")).drop("payload", "url")
    records = stored(records, "warc-records")
    # An id may stand for several payloads, so a revisit is resolved by id and digest.
    sizes = (records.where("record_type = 'response' AND page_id IS NOT NULL")
             .groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("bytes").alias("payload_bytes")))
    first = records.where("record_type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    again = records.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return first.union(again)
