"""WARC archives: writing, with revisit records for payloads met before, and sequential reading.

Each record is a gzip member of its own, so a reader may start at any record. The reader inflates a member bit by bit, takes
the header up to the empty line, then as many bytes as Content-Length says, and compares the digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import file_system, written

READ = 1 << 20
LEAST_REVISIT = 1000
GZIP = 31  # window bits of zlib for a gzip header and trailer
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
NAMELESS = "urn:sha1:"  # of url and payload, where a page has no id
FILES = "path string, n_records long, n_bytes long"
RECORDS = "record_id string, page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record(page_id: int | None, url: str, payload: bytes, size: int, sha1: bytes, refers_to: int | None) -> bytes:
    """One gzip member. A revisit keeps the HTTP header and leaves the payload to the record it refers to."""
    http = HTTP % size
    name = f"{URN}{page_id}" if page_id is not None else NAMELESS + hashlib.sha1(url.encode() + b" " + sha1).hexdigest()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def write_warc(pages: DataFrame, root: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record per row of `pages` (page_id, url, html) under `root`; returns the table of the files.

    A null html or url is empty. Of rows with equal payloads of at least `least` bytes, the one with the largest `page_id`
    is a response and the others are revisits of it; all smaller ones are responses. A row without `page_id` is a
    response, named by a digest of its url and payload, and no other row refers to it; rows that repeat a `page_id` are written each, and each is a response or revisit by its own
    payload, as revisits are joined back by `page_id` and digests. An empty table writes no file.

    Revisits are found by digests (SHA-1 and SHA-256 at once), counted per task before they are moved. Payloads are moved only
    where the table of revisits is too large to be sent to all tasks. Every attempt of a task writes a file of
    its own, and the table (path, n_records, n_bytes) names those of the attempts that counted.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("sha2", F.unhex(F.sha2("payload", 256)))
    own = ["page_id", "sha1", "sha2"]
    large = (F.octet_length("payload") >= least) & F.col("page_id").isNotNull()
    digests = written(rows.where(large).select(*own), "digests")
    copies = digests.groupBy("sha1", "sha2").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    copies = copies.where("n > 1").drop("n")
    revisits = digests.join(copies, ["sha1", "sha2"]).where("page_id <> refers_to").select(*own, "refers_to").distinct()
    joined = rows.join(written(revisits, "revisits"), own, "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(root)
        fs.create_dir(folder, recursive=True)
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4()}.warc.gz"
        out, n, size = None, 0, 0
        for batch in batches:
            for page, url, data, refers in zip(*(batch.column(i) for i in range(4))):
                body = data.as_py()
                member = record(page.as_py(), url.as_py(), body, len(body), hashlib.sha1(body).digest(), refers.as_py())
                out = out or fs.open_output_stream(path, compression=None)  # members are gzip already
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    return written(joined.select("page_id", "url", "payload", "refers_to").mapInArrow(write, FILES), "archives")


def members(stream) -> Iterator[bytes]:
    """The inflated content of each gzip member, one after the other; never more than one at a time."""
    data = stream.read(READ)
    while data:
        unpack, parts = zlib.decompressobj(GZIP), []
        while not unpack.eof:
            if not data and not (data := stream.read(READ)):
                raise ValueError("an archive ends inside a record")
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
        yield b"".join(parts)
        data = data or stream.read(READ)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and the block, of the length that the header says."""
    head, found, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not found or not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is not as long as it says")
    return fields, rest[:size]


def read_warc(archives: DataFrame, root: str) -> DataFrame:
    """A row per record of the archives in column `path`, in the columns of `RECORDS`.

    `payload_bytes` and `payload_digest` (bare hex SHA-1) are those of the full payload, for a revisit as its header has
    them; its `payload` is null and `refers_to` names the record that has it. A block or payload that has another digest than its
    header is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(root)
        schema = pa.schema(
            [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string())]
            + [("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for fields, block in map(parse, members(stream)):
                        rows.append(row_of(fields, block))
                        size += len(block)
                        if size > 16 * READ or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    dealt = archives.select("path").repartitionByRange(max(1, archives.count()), "path")
    return dealt.mapInArrow(read, RECORDS)


def row_of(fields: dict[str, str], block: bytes) -> dict:
    def digest(name: str) -> bytes:
        return base64.b32decode(fields[name].removeprefix("sha1:"))

    def page(name: str) -> int | None:
        value = fields.get(name, "").strip("<>")
        return int(value.removeprefix(URN)) if value.startswith(URN) else None

    if hashlib.sha1(block).digest() != digest("warc-block-digest"):
        raise ValueError(f"block of {fields['warc-record-id']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    sizes = [v for k, _, v in (h.partition(b":") for h in http.split(b"\r\n")) if k.lower() == b"content-length"]
    if not revisit and (hashlib.sha1(payload).digest() != digest("warc-payload-digest") or int(sizes[0]) != len(payload)):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    return {
        "record_id": fields["warc-record-id"],
        "page_id": page("warc-record-id"),
        "record_type": fields["warc-type"],
        "target_uri": fields["warc-target-uri"],
        "refers_to": page("warc-refers-to"),
        "payload_bytes": int(sizes[0]),
        "payload_digest": digest("warc-payload-digest").hex(),
        "payload": None if revisit else payload,
    }
