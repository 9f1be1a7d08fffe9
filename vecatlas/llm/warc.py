"""WARC archives, index first.

Writing: every task appends records, each its own gzip member, to archives of bounded size in a shared folder and returns one index row per
record (archive, offset, length, url, digest, ...). The index is the only way to the records: an archive that a lost
or repeated task left behind has no index rows and is never read.

Reading: the wanted index rows are sorted by archive and offset; ranges that touch or lie within ``gap`` bytes are read
with one request of at most ``most`` bytes. Nothing else of an archive is read.

Of records with equal payloads (of ``least`` bytes or more) that with the smallest id is a response, the others are revisits that name it and
carry the digest and the length but no payload. Ids that are equal too are told apart by row. Null payloads and urls are empty ones; null ids
come last. Files are opened with pyarrow's file systems, so a folder may be local and shared (file://), on HDFS or in an object store.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.common import attach, stash

INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string, refers_to long"
ARCHIVE_BYTES, GAP, MOST = 256 << 20, 64 << 10, 8 << 20
STAMP = "2024-01-01T00:00:00Z"


def _id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, place: str, least: int) -> bytes:
    """One WARC 1.1 record with an HTTP block; a revisit's block ends after the HTTP head, which still tells the payload's length.

    The one response of a payload that revisits may name has an id made of the digest, any other record one made of its place.
    """
    original = _id(f"sha256:{digest}")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {original if kind == 'response' and len(payload) >= least else _id(place)}", f"WARC-Date: {STAMP}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {original}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    lines += [f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """Fields of one unpacked record; payload is None for a revisit."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(v) for k, _, v in (line.partition(b": ") for line in http.split(b"\r\n")) if k.lower() == b"content-length")
    ref = fields.get("x-refers-to-page-id", "")
    return {
        "page_id": int(fields["x-page-id"]) if fields["x-page-id"] else None,
        "url": fields["warc-target-uri"],
        "record_type": fields["warc-type"],
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"),
        "payload_bytes": length,
        "refers_to": int(ref) if ref else None,
        "payload": None if fields["warc-type"] == "revisit" else payload,
    }


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to). Rows are numbered once and stored. Digests meet without payloads: they are aggregated in part before any shuffle,
    those that occur twice are broadcast, or salted where they are many, and only the numbers of the revisits come back to the rows."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = stash(rows.select("*", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"), F.octet_length("payload").alias("bytes"), F.monotonically_increasing_id().alias("row")), "pages")
    slim = rows.where(F.col("bytes") >= least).select("row", "page_id", "digest")
    first = slim.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stash(first.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("first_row")), "payloads")
    again = stash(attach(slim, first, "digest", how="inner").where("row <> first_row").select("row", "refers_to", F.lit("revisit").alias("kind")), "revisits")
    return attach(rows, again, "row").select("page_id", "url", "payload", "digest", F.coalesce("kind", F.lit("response")).alias("kind"), "refers_to")


def write(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, least: int = 100) -> DataFrame:
    """Write archives and the index of what they hold; the index is returned as a stored table."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)

    def run(batches):
        out, name, at, number = None, "", 0, 0
        where, root = fs.FileSystem.from_uri(folder)
        own = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        try:
            for batch in batches:
                index: list[tuple] = []
                for page_id, url, payload, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at, number = f"{own}-{number:04d}.warc.gz", 0, number + 1
                        out = where.open_output_stream(f"{root}/{name}", compression=None)
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = pack.compress(_record(kind, page_id, url, payload, digest, refers_to, f"{name}/{at}", least)) + pack.flush()
                    out.write(member)
                    index.append((page_id, name, at, len(member), url, digest, kind, refers_to))
                    at += len(member)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                columns = list(zip(*index, strict=True)) or [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    source = records.select("page_id", "url", F.col("payload").cast("binary").alias("payload"), "digest", "kind", "refers_to")
    return stash(source.mapInArrow(run, INDEX), "warc-index")


def _runs(rows: Iterator[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(archive, begin, end, members) of coalesced reads, from ranges sorted by archive and offset."""
    archive, begin, end, members = None, 0, 0, []
    for a, offset, length in rows:
        if a != archive or offset > end + gap or offset + length - begin > most:
            if members:
                yield archive, begin, end, members
            archive, begin, end, members = a, offset, offset, []
        members.append((offset, length))
        end = max(end, offset + length)
    if members:
        yield archive, begin, end, members


def read(index: DataFrame, folder: str, *, gap: int = GAP, most: int = MOST, tasks: int | None = None) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of the index's rows; payload is null for revisits.

    The digest of a response is taken anew from the bytes read; one that differs from the record's is an error.
    """

    def run(batches):
        where, root = fs.FileSystem.from_uri(folder)
        opened, name = None, None
        ranges = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        rows: list[dict] = []
        size = 0

        def batch():
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for archive, begin, end, members in _runs(ranges, gap, most):
            if archive != name:
                if opened is not None:
                    opened.close()
                opened, name = where.open_input_file(f"{root}/{archive}"), archive
            data = opened.read_at(end - begin, begin)
            for offset, length in members:
                record = parse(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                if record["payload"] is not None and (hashlib.sha256(record["payload"]).hexdigest() != record["payload_digest"] or len(record["payload"]) != record["payload_bytes"]):
                    raise ValueError(f"damaged record at {offset} of {archive}")
                rows.append(record)
                size += record["payload_bytes"]
            if size > 4 * most:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()
        if opened is not None:
            opened.close()

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    wanted = index.select("archive", "offset", "length")
    # an archive's stretches of 32 MB go to tasks; a task sees each in order
    stretch = F.floor(F.col("offset") / (32 << 20))
    tasks = tasks or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = wanted.repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset")
    return lined.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
