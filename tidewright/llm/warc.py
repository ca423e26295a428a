"""WARC archives: writing, normalising of monolithic gzip streams, reading by a sidecar index.

``write_archives`` makes one whole-file gzip stream per task. ``normalise`` inflates such a
stream once, in chunks, rewrites every record as a gzip member of its own and writes a
sidecar index (one JSON line per record: offset, length, record id). ``read_archives`` seeks
by that index. Memory is bounded by one chunk while normalising and by one record otherwise;
files are written under a name of the attempt and renamed, so a retried or speculative task
never leaves half a file behind.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, new_path

CHUNK = 1 << 20
GZIP = 31  # zlib's window bits for a gzip wrapper
END = b"\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"  # archives of equal input are equal byte for byte


def open_fs(uri: str):
    """(filesystem, path) of a file: or remote URI."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC/1.1 record. A revisit keeps the HTTP head, whose Content-Length
    is that of the full payload, and no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = f"page:{page_id}" if page_id is not None else f"page:none:{digest}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:{name}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {"version": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class Stream:
    """Inflates a gzip file (any number of members) in chunks and hands out its bytes."""

    def __init__(self, raw):
        self.raw, self.z, self.have, self.left, self.begun = raw, zlib.decompressobj(GZIP), bytearray(), b"", False

    def fill(self) -> bool:
        data = self.left or self.raw.read(CHUNK)
        if not data:
            return False
        self.begun = True
        if self.z.eof:
            self.z = zlib.decompressobj(GZIP)
        self.have += self.z.decompress(data, CHUNK)
        self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before ``mark``, which is passed over; None at the end of the file."""
        start = 0
        while (at := self.have.find(mark, start)) < 0:
            start = max(0, len(self.have) - len(mark) + 1)
            if not self.fill():
                if self.have.strip():
                    raise ValueError("truncated WARC head")
                if self.begun and not self.z.eof:
                    raise ValueError("truncated gzip stream")  # cut where a record ends
                return None
        out = bytes(self.have[:at])
        del self.have[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            while not self.have:
                if not self.fill():
                    raise ValueError("truncated WARC record")
            piece = bytes(self.have[:n])
            del self.have[: len(piece)]
            n -= len(piece)
            yield piece


def normalise_file(uri: str, to: str) -> dict:
    """Rewrites the archive at ``uri`` with a member per record; returns the paths and counts."""
    fs, path = open_fs(uri)
    out_fs, out = open_fs(to)
    trial, at, n = f"{out}.{uuid.uuid4().hex[:8]}.tmp", 0, 0
    with fs.open_input_stream(path, compression=None) as raw, out_fs.open_output_stream(trial, compression=None) as sink, out_fs.open_output_stream(f"{trial}.idx", compression=None) as index:
        stream = Stream(raw)
        while (head := stream.until(END)) is not None:
            fields, z, began = parse_head(head.lstrip(b"\r\n")), zlib.compressobj(6, zlib.DEFLATED, GZIP), at
            at += sink.write(z.compress(head.lstrip(b"\r\n") + END))
            for piece in stream.take(int(fields["content-length"])):
                at += sink.write(z.compress(piece))
            at += sink.write(z.compress(END) + z.flush())
            b"".join(stream.take(len(END)))
            index.write((json.dumps({"offset": began, "length": at - began, "id": fields["warc-record-id"], "type": fields["warc-type"]}) + "\n").encode())
            n += 1
    out_fs.move(trial, out)
    out_fs.move(f"{trial}.idx", f"{out}.idx")
    return {"archive": to, "index": f"{to}.idx", "records": n, "bytes": at}


def read_member(data: bytes) -> dict:
    raw = zlib.decompress(data, GZIP)
    head, _, rest = raw.partition(END)
    f = parse_head(head)
    http, _, body = rest[: int(f["content-length"])].partition(END)
    page = f["warc-record-id"][1:-1].split(":")
    revisit = f["warc-type"] == "revisit"
    size = int(parse_head(http)["content-length"])
    digest = f["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (size != len(body) or digest_of(body) != digest):
        raise ValueError(f"record {f['warc-record-id']} is damaged")
    return {
        "page_id": int(page[2]) if page[2] != "none" else None, "payload_bytes": size, "payload_digest": digest, "record_type": f["warc-type"],
        "refers_to": int(f["warc-refers-to"][1:-1].split(":")[2]) if revisit else None, "url": f.get("warc-target-uri"), "payload": None if revisit else body,
    }


def with_originals(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Adds ``_original``: the page whose record holds the payload, null if the row's own does.

    The smallest id per payload comes from a pre-aggregated pass over (digest, id) alone. The
    join back is a plain equi-join, which adaptive execution splits where one payload is hot.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", body.alias("_payload")).withColumn("_digest", F.sha1("_payload"))
    large = F.length("_payload") >= min_revisit_bytes
    firsts = keyed.where(large).groupBy(F.col("_digest").alias("_key")).agg(F.min("page_id").alias("_first"))
    joined = keyed.join(firsts, F.when(large, F.col("_digest")) == F.col("_key"), "left")
    return joined.withColumn("_original", F.when(F.col("page_id") == F.col("_first"), None).otherwise(F.col("_first"))).select("page_id", "url", "_payload", "_original")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """One monolithic gzip archive per task of ``rows`` (page_id, url, _payload, _original)."""

    def write(batches):
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        fs, out = open_fs(path)
        fs.create_dir(out.rsplit("/", 1)[0], recursive=True)
        trial, z, n, sink = f"{out}.{uuid.uuid4().hex[:8]}.tmp", zlib.compressobj(6, zlib.DEFLATED, GZIP), 0, None
        for batch in batches:
            for page, url, payload, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sink = sink or fs.open_output_stream(trial, compression=None)
                sink.write(z.compress(record_bytes(page, url, payload, digest_of(payload), original)))
                n += 1
        if sink:
            sink.write(z.flush())
            sink.close()
            fs.move(trial, out)
            yield pa.RecordBatch.from_pydict({"archive": [path], "records": pa.array([n], pa.int64())})

    return rows.mapInArrow(write, "archive string, records bigint")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """A row (archive, index, records, bytes) per rewritten archive."""

    def rewrite(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([normalise_file(uri, f"{folder}/{uri.rsplit('/', 1)[1]}")])

    def prepared(batches):
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        return rewrite(batches)

    return archives.select("archive").mapInArrow(prepared, "archive string, index string, records bigint, bytes bigint")


#: Payload bytes after which a batch of read records is handed on.
BATCH_BYTES = 1 << 24
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary, archive string, offset bigint"


def read_archives(normalised: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record, found by the sidecar index; damaged records raise."""

    def read(batches):
        for batch in batches:
            rows = batch.to_pydict()
            for archive, index in zip(rows["archive"], rows["index"], strict=True):
                fs, path = open_fs(archive)
                with fs.open_input_stream(open_fs(index)[1], compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with fs.open_input_file(path) as f:
                    found, size = [], 0
                    for e in entries:
                        r = read_member(f.read_at(e["length"], e["offset"])) | {"archive": archive, "offset": e["offset"]}
                        if not payloads:
                            r["payload"] = None
                        found.append(r)
                        size += len(r["payload"] or b"")
                        if len(found) == 200 or size > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(found, schema=READ_ARROW)
                            found, size = [], 0
                    yield pa.RecordBatch.from_pylist(found, schema=READ_ARROW)

    return normalised.select("archive", "index").mapInArrow(read, READ)


READ_ARROW = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("url", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()),
])


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC, normalises the archives, reads them back.

    A null html is an empty payload; a null url leaves the target out; a null page_id is kept
    (it revisits a known page of equal payload if there is one, else it is a response). Of equal payloads the smallest page_id is the response;
    rows that repeat that page_id are responses too. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    scratch, folder = Scratch(spark, "warc"), new_path(spark, "warc-files")
    written = scratch.write(write_archives(with_originals(pages, min_revisit_bytes), f"{folder}/whole"), "written")
    files = max(1, written.count())
    made = scratch.write(normalise(written.repartition(min(files, 100_000), "archive"), f"{folder}/members"), "made")
    return read_archives(made.repartition(min(files, 100_000), "archive"), payloads)
