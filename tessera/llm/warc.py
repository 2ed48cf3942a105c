"""WARC archives (operator 5), dictionary-compressed and read back.

Each write task fills archives of bounded size. An archive starts with a skippable frame that embeds a
Zstandard dictionary, built from a bounded sample of the archive's own records (``SAMPLES`` of at most
``SAMPLE_BYTES``), and holds each record as a frame of its own. Of records with equal payloads that
with the smallest page_id is a response, the others are revisits that refer to it; payloads are grouped
by SHA-256 before anything is written, in rows of digests only. The files are named by task attempt, and
only those of committed tasks are in the manifest, so lost executors cost a rewrite and no more.

Defined results: a null payload is empty; rows that repeat a page_id and payload are each a response if
that id is the smallest; a null page_id is a response only if all ids of its payload are null; line
breaks in urls are removed; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialize, scratch, ship, tidy

ARCHIVE_BYTES = 24_000_000
#: Bytes of archives that a task reads back, about.
READ_BYTES = 64_000_000
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 500, 8_192, 65_536, 3
_SKIPPABLE = 0x184D2A5D
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[4:4] = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of records spread evenly over an archive; none if they are too few or too small."""
    sample = [r[:SAMPLE_BYTES] for r in records[:: max(1, len(records) // SAMPLES)]][:SAMPLES]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes]) -> bytes:
    shared = dictionary(records)
    out = []
    if shared:
        raw = zstandard.ZstdCompressor(level=19).compress(shared.as_bytes())
        out.append(_SKIPPABLE.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
    return b"".join(out + [pack.compress(r) for r in records])


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, a frame at a time."""
    at, shared = 0, None
    if data[:4] == _SKIPPABLE.to_bytes(4, "little"):
        at = 8 + int.from_bytes(data[4:8], "little")
        raw = data[8:at]
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompress(raw)
        shared = zstandard.ZstdCompressionDict(raw)
    opener = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
    while at < len(data):
        frame, out = opener.decompressobj(), []
        while not frame.eof:
            part = data[at : at + 65_536]
            if not part:
                raise ValueError("the archive ends within a record")
            out.append(frame.decompress(part))
            at += len(part) - len(frame.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload); the digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (payload_digest(payload) != digest or len(payload) != size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = lambda k: None if k not in fields or (x := fields[k][len("<urn:page:") : -1]) == "None" else int(x)
    return page("WARC-Record-ID"), fields["WARC-Target-URI"], kind, page("WARC-Refers-To"), digest, size, payload if kind == "response" else None


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    held: list[bytes] = []
    size = k = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, size, k
        name = f"part-{task.partitionId():05d}-{k:04d}-{task.taskAttemptId()}.warc.zst"
        data = archive(held)
        with store.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(data)
        row = [[f"{folder}/{name}"], [len(held)], [len(data)]]
        held, size, k = [], 0, k + 1
        return pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["path", "records", "bytes"])

    for batch in batches:
        for page_id, url, html, kind, refers in zip(*batch.columns, strict=True):
            raw = record(kind.as_py(), page_id.as_py(), url.as_py(), html.as_py(), refers.as_py())
            held.append(raw)
            size += len(raw)
            if size >= ARCHIVE_BYTES:
                yield flush()
    if held:
        yield flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives; the manifest (path, records, bytes) of those that were committed."""
    ship(pages.sparkSession)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("html"))
    keyed = source.withColumn("key", F.unhex(F.sha2("html", 256)))
    rows = materialize(keyed.select("page_id", "key"), "warc-digests")
    first = materialize(rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count("key").alias("n")).where("n > 1"), "warc-first")
    told = lookup(keyed, first, "key", "n", rows.count())  # pages of a payload of their own, or of a hot one, stay where they are read
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    told = told.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))
    return materialize(told.transform(tidy, lambda b: _written(b, folder), "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of all archives of a manifest, read in as many partitions as READ_BYTES of archives make, at least one a core and at most one an archive."""
    told = manifest.agg(F.count("path").alias("n"), F.sum("bytes").alias("bytes")).first()
    spread = max(1, min(told.n, max(manifest.sparkSession.sparkContext.defaultParallelism, (told.bytes or 0) // READ_BYTES)))
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    kinds = kinds if payload else kinds[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    data = f.read()
                rows: list[tuple] = []
                for raw in records(data):
                    rows.append(parse(raw)[: len(kinds)])
                    if len(rows) == 500:
                        yield _batch(rows, kinds)
                        rows = []
                if rows:
                    yield _batch(rows, kinds)

    ship(manifest.sparkSession)
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payload
    return manifest.select("path").repartition(spread).transform(tidy, run, schema)


def _batch(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from the archives written."""
    manifest = write_archives(pages, scratch(pages.sparkSession, "warc"))
    return read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
