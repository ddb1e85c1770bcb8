"""WARC archives compressed record by record with a dictionary carried in each file.

A ``.warc.zst`` file starts with a Zstandard skippable frame (magic 0x184D2A5D) whose content is the
dictionary; every record after it is one Zstandard frame compressed with that dictionary.  The
dictionary is built from the first archived records of the file (at most ``SAMPLE_BYTES`` of them);
if those are too few to train on, the file has no such frame and plain frames.

Equal payloads: the record with the largest page_id is the response, the others revisit it.  Winners
are found by a grouped maximum over digests; pages meet their winner by an equi-join that AQE may
split, so a payload shared by a third of the pages does not sit in one task.

Scale and recovery: a task streams its rows, holds one sample and one record, and starts a new file
at ``FILE_BYTES``.  A file is written under a temporary name beside its place and renamed when whole; its
name holds the task's partition and attempt, and only the files in the stored manifest count, so a
lost executor or a second attempt leaves no torn or doubled archive.  Archives are read back one
file per row of the manifest, streaming.  Files go to the session's checkpoint folder by
``pyarrow.fs``, which knows local, HDFS and object-store addresses.

Defined cases: null html is an empty payload; an empty payload is a payload like any other; rows that
repeat the winning page_id with its payload are all responses; a null page_id is written without one, and
revisits a numbered page that has its payload, else is a response; null urls
become ``urn:page:<id>``, line breaks in urls are percent-encoded; an empty table gives no archives;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import prepare, scratch_path, stored, table
from sifter.session import shuffle_partitions

# Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"       # the pages table has no capture times; a constant keeps archives reproducible

DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20
FILE_BYTES = 256 << 20
LEVEL = 3


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, 'page:' + page)}>"


def uri(url: str | None, page: str) -> str:
    if not url:
        return f"urn:page:{page}"
    return "".join(c if c not in "\r\n\t " else f"%{ord(c):02X}" for c in url)


def record(page: str, url: str | None, payload: bytes, sha: str, refers: str | None) -> bytes:
    """One WARC record: a response with the payload or a revisit without it."""
    fields = [("WARC-Type", "revisit" if refers is not None else "response"), ("WARC-Record-ID", record_id(page)),
              ("WARC-Date", DATE), ("WARC-Target-URI", uri(url, page)), ("WARC-Payload-Digest", f"sha1:{sha}"),
              ("X-Page-ID", page), ("X-Payload-Length", str(len(payload)))]
    if refers is not None:
        fields += [("WARC-Refers-To", record_id(refers)), ("X-Refers-To-Page-ID", refers), ("WARC-Profile", PROFILE)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers is not None else http + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, payload) of a record; raises on a malformed one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.decode().split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def train(samples: list[bytes]):
    """A Zstandard dictionary of the samples, or None if they are too few or too alike to train on."""
    import zstandard
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Streams records into one ``.warc.zst`` file."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs
        self.fs, self.folder = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.path, self.temp = f"{self.folder}/{name}.warc.zst", f"{self.folder}/.{name}.part"
        self.pending: list[bytes] = []
        self.size = self.records = 0
        self.out = None

    def add(self, raw: bytes) -> None:
        self.size += len(raw)
        self.records += 1
        if self.out is not None:
            self.out.write(self.compressor.compress(raw))
            return
        self.pending.append(raw)
        if self.size >= SAMPLE_BYTES:
            self._open()

    def _open(self) -> None:
        import zstandard
        self.fs.create_dir(self.folder, recursive=True)
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        shared = train([r[:64 << 10] for r in self.pending])
        if shared is not None:
            content = shared.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        for r in self.pending:
            self.out.write(self.compressor.compress(r))
        self.pending = []

    def close(self) -> tuple[str, int]:
        """Finish the file and put it in place; (path, records)."""
        if self.out is None:
            self._open()
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.path, self.records


def read_archive(folder: str, path: str) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard
    from pyarrow import fs
    store, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    with store.open_input_stream(path, compression=None) as f:
        data = f.read(8)
        shared = None
        if len(data) == 8 and struct.unpack("<II", data)[0] == DICTIONARY_FRAME:
            shared = zstandard.ZstdCompressionDict(f.read(struct.unpack("<II", data)[1]))
            data = b""
        decompressor = zstandard.ZstdDecompressor(dict_data=shared)
        while True:
            d = decompressor.decompressobj()
            out = []
            while not d.eof:
                data = data or f.read(1 << 20)
                if not data:
                    if out:
                        raise ValueError(f"{path} ends inside a record")
                    return
                out.append(d.decompress(data))
                data = d.unused_data if d.eof else b""
            yield b"".join(out)


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) to archives in ``folder``; the manifest (path, records).

    Equal payloads of at least ``least`` bytes are kept once.
    """
    prepare(pages.sparkSession)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    slim = slim.withColumn("sha", F.unhex(F.sha1("html")))
    # a payload's winner: its largest page_id
    keyed = slim.select("sha", "page_id", F.octet_length("html").alias("size"))
    winner = keyed.where(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    shared = stored(winner.where("copies > 1").select("sha", "first"), "shared_payloads")
    joined = slim.join(shared, "sha", "left")
    names = ["path", "records"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer, n, done = None, 0, []
        for b in batches:
            for r in range(b.num_rows):
                page, url, html, first = (b.column(c)[r].as_py() for c in ("page_id", "url", "html", "first"))
                payload = html.encode()
                refers = None if first is None or first == page else str(first)
                if writer is None:
                    writer = ArchiveWriter(folder, f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}")
                    n += 1
                writer.add(record("" if page is None else str(page), url, payload, digest(payload), refers))
                if writer.size >= FILE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names)

    return stored(joined.select("page_id", "url", "html", "first").mapInArrow(run, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row per archived record: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload).

    A response's length and digest are worked out from its payload and must equal its header.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, expected in zip(b.column("path").to_pylist(), b.column("records").to_pylist()):
                rows, seen, held = [], 0, 0
                for raw in read_archive(folder, path):
                    fields, payload = parse(raw)
                    sha, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response" and (digest(payload), len(payload)) != (sha, size):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} in {path} differs from its header")
                    page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
                    rows.append((int(page) if page else None, size, sha, fields["WARC-Type"], int(refers) if refers else None, payload)[:len(names)])
                    seen += 1
                    held += len(payload) * payloads
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield table_of(rows)
                        rows, held = [], 0
                if seen != expected:
                    raise ValueError(f"{path} has {seen} records, its manifest says {expected}")
                yield table_of(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    files = manifest.repartition(shuffle_partitions(manifest.sparkSession), "path")      # a given number: AQE would merge them
    return files.mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back: payload sizes, digests and record types."""
    folder = scratch_path(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


_B32 = "".join(
    f"|| [x FOR x IN string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', '')][(('0x' || substr(h, {5 * q + 1}, 5))::INT >> {shift}) % 32 + 1] "
    for q in range(8) for shift in (15, 10, 5, 0))
ORACLE_OP7 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), w AS (SELECT h, max(page_id) AS first, count(*) AS n FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, '' {_B32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN w USING (h)
"""
