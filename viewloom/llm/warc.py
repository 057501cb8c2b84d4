"""WARC archives, each record compressed on its own with a dictionary of the archive's own records.

Layout of an archive (``.warc.zst``): a skippable frame that holds a Zstandard dictionary, then one
frame per record. The dictionary is trained on the first records of the archive; with too few to train
on, their bytes are the dictionary. Any record can be read alone with the leading frame.

Of records with equal payloads, that with the largest page id is the response; others are revisits
that name it. Archives are written by Spark tasks into the shared folder under names of their own; the
list of archives that the successful tasks return is the manifest, so files of lost attempts are never
read.

Defined results: null html is an empty payload, null url an empty target, a null id the smallest; rows that repeat a response's
id and payload are responses as well; extra columns are ignored; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import materialize, released, shared_dir

SKIPPABLE = 0x184D2A5D
#: Uncompressed bytes of records per archive, of those kept to train on, and of a dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 64 << 20, 1 << 20, 32 << 10
#: Revisits, of some 50 bytes, that may be broadcast.
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
MANIFEST = "path string, records long, raw_bytes long, bytes long"


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page}')}>"


def record(page: object, url: str, payload: bytes, digest: str, refers_to: object | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"Page-Id: {page}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """(named fields, payload length, payload; that of a revisit is empty)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    return fields, length, payload


def dictionary(samples: list[bytes]) -> bytes:
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except z.ZstdError:  # too few or too small
        return b"".join(samples)[:DICTIONARY_BYTES]


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The archive's leading frame, then a frame per record; only the samples are held."""
    import zstandard as z

    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    words = dictionary(first)
    yield struct.pack("<II", SKIPPABLE, len(words)) + words
    pack = z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(words), write_checksum=True)
    yield from map(pack.compress, first)
    yield from map(pack.compress, records)


def unframe(stream) -> Iterator[bytes]:
    """The records of an archive, read piece by piece."""
    import zstandard as z

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    open_ = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(stream.read(size))).decompressobj
    rest = b""
    while rest or (rest := stream.read(1 << 20)):
        one, out = open_(), []
        while True:
            out.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            if not (rest := stream.read(1 << 20)):
                raise ValueError("a record's frame is cut short")
        yield b"".join(out)


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def resolve(pages: DataFrame) -> DataFrame:
    """Pages with their digest and ``refers_to``, null for responses.

    Ids and digests are shuffled; payloads only if more pages are revisits than may be broadcast. The
    largest id per digest is aggregated before the shuffle; a digest that a third of the rows share is
    split by the adaptive join.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    named = pages.select("page_id", F.regexp_replace("url", r"[\r\n]", "").alias("url"), html.alias("payload"), F.sha1(html).alias("sha"), F.coalesce("page_id", F.lit(-(1 << 63)).cast("long")).alias("k"))
    keys = named.select("k", "sha")
    top = keys.groupBy("sha").agg(F.max("k").alias("top"), F.count("*").alias("n"))
    later = materialize(keys.join(top.where("n > 1"), "sha").where("k < top").select("k", "sha", "top").distinct(), "revisits")
    few = later.count() <= BROADCAST_ROWS
    return named.join(F.broadcast(later) if few else later.hint("merge"), ["k", "sha"], "left").select("page_id", "url", "payload", F.col("top").alias("refers_to"))


def write(pages: DataFrame, uri: str) -> DataFrame:
    """Writes all pages to archives under ``uri``; returns the manifest, itself written there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(uri)
        store.create_dir(base)
        seen = {"raw": 0, "n": 0}

        def records() -> Iterator[bytes]:
            for b in released(batches):
                for at in range(b.num_rows):
                    page, url, payload, top = (b.column(c)[at].as_py() for c in ("page_id", "url", "payload", "refers_to"))
                    r = record(page, url or "", payload, sha1(payload), top)
                    seen["raw"] += len(r)
                    seen["n"] += 1
                    yield r

        def bounded(head: bytes) -> Iterator[bytes]:
            yield head
            while seen["raw"] < ARCHIVE_BYTES and (r := next(source, None)) is not None:
                yield r

        source = records()
        while (head := next(source, None)) is not None:
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            seen |= {"raw": len(head), "n": 1}
            with store.open_output_stream(path) as f:
                for frame in frames(bounded(head)):
                    f.write(frame)
                size = f.tell()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [seen["n"]], "raw_bytes": [seen["raw"]], "bytes": [size]})

    return materialize(resolve(pages).select("page_id", "url", "payload", "refers_to").mapInArrow(run, MANIFEST), "manifest")


READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])


def read(manifest: DataFrame, uri: str, tasks: int | None = None) -> DataFrame:
    """The records of the manifest's archives; a response's payload is checked against its digest.

    Each archive is one task's, unless a number of ``tasks`` is given.
    """
    tasks = tasks or max(1, manifest.count())

    def rows(store, path: str) -> Iterator[tuple]:
        with store.open_input_stream(path) as f:
            for raw in unframe(f):
                h, n, payload = parse(raw)
                digest, revisit = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "revisit"
                if not revisit and (sha1(payload) != digest or len(payload) != n):
                    raise ValueError(f"{path}: the payload of page {h['Page-Id']} is damaged")
                page, top = (None if x in (None, "None") else int(x) for x in (h["Page-Id"], h.get("Refers-To-Page-Id")))
                yield page, h["WARC-Target-URI"], h["WARC-Type"], top, digest, n, payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(uri)
        for b in released(batches):
            for path in b.column("path").to_pylist():
                held, size = [], 0
                for r in rows(store, path):
                    held.append(r)
                    size += 256 + len(r[-1])
                    if size > 8 << 20:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    return manifest.select("path").repartitionByRange(tasks, "path").mapInArrow(run, from_arrow_schema(READ))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)


def archive_uri(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/viewloom-{uuid.uuid4().hex}/warc"


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages, reads the archives, and gives one row per record read."""
    uri = archive_uri(pages.sparkSession)
    return read(write(pages, uri), uri).drop("payload").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
