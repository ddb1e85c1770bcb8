"""Token ids in binary files of patched frame-of-reference blocks.

A file (``.pfor``) holds the ids of consecutive documents, cut into blocks of ``BLOCK`` ids:

    header   magic, ids a block
    block    smallest id (u32), packed width (u8), exceptions (u16), the packed values, the positions
             (u16) and high parts (u32) of the exceptions
    index    start of every block (u64), then of each document its id (i64), whether the id is null
             (u8) and its number of ids (u64)
    footer   blocks, documents, ids, start of the index, CRC-32 of the index, magic

A block stores each id minus the block's smallest.  The packed width is the one that ``PERCENTILE`` percent
of these differences need; the low bits of all of them are packed at that width, and a larger
one (an exception) puts its remaining high bits into the exception list.  Block starts make any range
of ids readable without what lies before it.

Writing: documents are range-partitioned by doc_id (ties by a hash of the text, then the row's place), so
partition after partition holds ascending ids; a task encodes its rows and appends them to a file, and starts the
next file at ``FILE_IDS`` ids or ``FILE_DOCS`` documents.  A file is written under a temporary name and renamed when whole; its name
holds partition and attempt, and only the files in the stored manifest count, so a lost executor or
a second attempt leaves nothing torn or doubled.  A file's first global position is the sum of the files before it,
summed in two steps (runs of ``RUN`` partitions, then the runs) so that no task sees the whole manifest.

Encoding: the vocabulary file is broadcast (a fixed size) and read by the tokenizers library.  No token
of a byte-level BPE spans the place between a character that isn't white space and a blank after
it, so a text is cut there, and each worker remembers the ids of at most ``CACHE`` short chunks; the cache is
emptied when full, which changes speed only.  Chunks not remembered go to the library.

Memory: a task holds one Arrow batch, the ids of ``GROUP`` of its texts, one block and its file's document table (17 bytes a document).

Defined cases: a null or empty text has the end id alone; very long texts span blocks; null doc_ids come
first; rows of one doc_id are ordered by their text's hash, equal rows are interchangeable; an empty table gives
no file and no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifter.llm.common import prepare, scratch_path, stored, table
from sifter.session import shuffle_partitions

MAGIC = b"PFORTOK1"
HEADER = struct.Struct("<8sI")
BLOCK_HEAD = struct.Struct("<IBH")
FOOTER = struct.Struct("<QQQQI8s")

BLOCK = 4096
PERCENTILE = 98
FILE_IDS = 32 << 20
FILE_DOCS = 1 << 20
RUN = 1024
CACHE = 1_500_000
CACHED_CHARS = 48
JOINED = 64
GROUP = 1024
END_ID = 2
_MODELS: dict[str, "Chunks"] = {}


# ---- blocks -----------------------------------------------------------------------------------

def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other, lowest bit first."""
    if not width:
        return b""
    if width in (8, 16, 32):            # the same bytes, without going through bits
        return values.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.zeros((n, 32), np.uint8)
    if width:
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint32)


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block; ``ids`` are unsigned 32-bit, at least one and at most 65,536 of them."""
    low = int(ids.min())
    rest = ids - np.uint32(low)
    at = max(0, -(-len(rest) * percentile // 100) - 1)          # nearest rank
    width = int(np.partition(rest, int(at))[int(at)]).bit_length()
    above = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    high = (rest[above] >> np.uint32(width)) if len(above) else np.empty(0, np.uint32)
    return (BLOCK_HEAD.pack(low, width, len(above)) + pack(rest, width)
            + above.astype("<u2").tobytes() + high.astype("<u4").tobytes())


def decode_block(data: bytes, n: int) -> np.ndarray:
    low, width, exceptions = BLOCK_HEAD.unpack_from(data)
    at = BLOCK_HEAD.size + (n * width + 7) // 8
    rest = unpack(data[BLOCK_HEAD.size:at], n, width)
    if exceptions:
        where = np.frombuffer(data, "<u2", exceptions, at)
        rest[where] |= np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions).astype(np.uint32) << np.uint32(width)
    return rest + np.uint32(low)


# ---- files ------------------------------------------------------------------------------------

def store_of(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class TokenFileWriter:
    """Appends documents to one file; ``close`` puts it in place."""

    def __init__(self, folder: str, name: str, block: int = BLOCK, percentile: float = PERCENTILE):
        self.fs, self.folder = store_of(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.path, self.temp = f"{self.folder}/{name}.pfor", f"{self.folder}/.{name}.part"
        self.block, self.percentile = block, percentile
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.out.write(HEADER.pack(MAGIC, block))
        self.at, self.ids = HEADER.size, 0
        self.starts, self.docs, self.nulls, self.counts = array("Q"), array("q"), bytearray(), array("Q")
        self.pending: list[np.ndarray] = []
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            held = np.concatenate(self.pending)
            whole = len(held) // self.block * self.block
            for i in range(0, whole, self.block):
                self._block(held[i:i + self.block])
            self.pending, self.waiting = [held[whole:].copy()], len(held) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = encode_block(ids, self.percentile)
        self.starts.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        """(path, documents, ids)"""
        if self.waiting:
            self._block(np.concatenate(self.pending))
        index = (np.array(self.starts, "<u8").tobytes() + np.array(self.docs, "<i8").tobytes() + bytes(self.nulls)
                 + np.array(self.counts, "<u8").tobytes())
        self.out.write(index + FOOTER.pack(len(self.starts), len(self.docs), self.ids, self.at, zlib.crc32(index), MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.path, len(self.docs), self.ids


class TokenFile:
    """A file opened for reading: its document table, and any range of its ids."""

    def __init__(self, folder: str, path: str):
        fs, _ = store_of(folder)
        self.path, self.file = path, fs.open_input_file(path)
        size = self.file.size()
        magic, self.block = HEADER.unpack(self.file.read_at(HEADER.size, 0)) if size >= HEADER.size + FOOTER.size else (b"", 0)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        blocks, n, self.ids, self.end, crc, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        index = self.file.read_at(size - FOOTER.size - self.end, self.end)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"the index of {path} is damaged")
        self.starts = np.append(np.frombuffer(index, "<u8", blocks), np.uint64(self.end)).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", n, 8 * blocks)
        self.null_ids = np.frombuffer(index, np.uint8, n, 8 * (blocks + n)).astype(bool)
        self.counts = np.frombuffer(index, "<u8", n, 8 * blocks + 9 * n).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` up to before ``last``; only their blocks are read."""
        if first >= last:
            return np.empty(0, np.uint32)
        b0, b1 = first // self.block, (last - 1) // self.block + 1
        data = self.file.read_at(int(self.starts[b1] - self.starts[b0]), int(self.starts[b0]))
        parts = []
        for b in range(b0, b1):
            at = self.starts[b] - self.starts[b0]
            parts.append(decode_block(data[at:at + self.starts[b + 1] - self.starts[b]], min(self.block, self.ids - b * self.block)))
        return np.concatenate(parts)[first - b0 * self.block:last - b0 * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.offsets[k]), int(self.offsets[k + 1]))

    def spans(self, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, one past the last, their ids) in order, about ``size`` ids at a time."""
        k = 0
        while k < len(self.counts):
            to = max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + size, "right")) - 1)
            yield k, to, self.read(int(self.offsets[k]), int(self.offsets[to]))
            k = to


# ---- encoding ---------------------------------------------------------------------------------

class Chunks:
    """The library's tokenizer and the ids of chunks met before.

    A text is cut at every blank after a character that isn't white space.  Chunks that aren't remembered are
    encoded ``JOINED`` at a time: a blank and something without blanks that begins and ends visibly, written one
    after the other, is a text whose only tokens that begin with a blank are the chunks' first ones.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task is one core
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_str(spec)
        self.model.no_truncation()
        self.model.no_padding()
        self.cache: dict[str, bytes] = {}       # chunks after a blank, without it
        self.begin: dict[str, bytes] = {}       # chunks that begin a text
        blank = self.model.encode(" ", add_special_tokens=False).tokens[0][0]       # how the vocabulary spells a blank
        vocabulary = self.model.get_vocab()
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank[[i for token, i in vocabulary.items() if token.startswith(blank)]] = True

    def encode(self, text: str, end: int | None = END_ID) -> np.ndarray:
        return self.encode_all([text], end)[0]

    def encode_all(self, texts: list[str], end: int | None = END_ID) -> list[np.ndarray]:
        """The ids of whole texts, each with the end id."""
        tail = b"" if end is None else struct.pack("<I", end)
        self._make_room()
        lookup, plans, need, need_begin = self.cache.get, [], {}, {}
        for text in texts:
            keys = text.split(" ")
            ids = list(map(lookup, keys))
            ids[0] = self.begin.get(keys[0])
            missing = [i for i, x in enumerate(ids) if x is None]
            if any(not keys[i] or keys[i][-1].isspace() for i in missing):
                keys = self._joined(keys)
                ids = list(map(lookup, keys))
                ids[0] = self.begin.get(keys[0])
                missing = [i for i, x in enumerate(ids) if x is None]
            for i in missing:
                (need if i else need_begin)[keys[i]] = b""
            plans.append((keys, ids, missing))
        self._encode(need, " ", self.cache)
        self._encode(need_begin, "", self.begin)
        out = []
        for keys, ids, missing in plans:
            for i in missing:
                ids[i] = (need if i else need_begin)[keys[i]]
            ids.append(tail)
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        return out

    def _make_room(self) -> None:
        if len(self.cache) + len(self.begin) > CACHE:
            self.cache.clear()
            self.begin.clear()

    @staticmethod
    def _joined(pieces: list[str]) -> list[str]:
        """Pieces joined again wherever the blank between them follows white space or nothing."""
        out, open_ = [pieces[0]], not pieces[0] or pieces[0][-1].isspace()
        for p in pieces[1:]:
            if open_:
                out[-1] += " " + p
            else:
                out.append(p)
            open_ = not p or p[-1].isspace()
        return out

    def _encode(self, need: dict[str, bytes], before: str, into: dict[str, bytes]) -> None:
        """Fill in the ids of the keys of ``need``, chunks without the blank ``before`` them."""
        plain = [k for k in need if k and " " not in k and not k[0].isspace() and not k[-1].isspace()] if before else []
        parts = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        texts = [before + before.join(part) for part in parts]
        for part, got in zip(parts, self.model.encode_batch_fast(texts, add_special_tokens=False) if texts else ()):
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(self.blank[ids]).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                need.update((k, raw[4 * x:4 * y]) for k, x, y in zip(part, cuts, [*cuts[1:], len(ids)]))
        rest = [k for k, ids in need.items() if not ids]
        for k, got in zip(rest, self.model.encode_batch_fast([before + k for k in rest], add_special_tokens=False) if rest else ()):
            need[k] = np.array(got.ids, "<u4").tobytes()
        into.update((k, ids) for k, ids in need.items() if 0 < len(k) <= CACHED_CHARS and " " not in k and not k[-1].isspace())


def tokenizer(spec: str) -> Chunks:
    """One per worker process and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = Chunks(spec)
    return _MODELS[key]


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# ---- tables -----------------------------------------------------------------------------------

def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int | None = END_ID,
                 file_ids: int = FILE_IDS, block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """Encode every text of ``docs`` into files in ``folder``; the manifest (path, part, seq, docs, ids, start)."""
    spark = docs.sparkSession
    prepare(spark)
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slim = slim.withColumn("by", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = slim.repartitionByRange("doc_id", "by", "row").sortWithinPartitions("doc_id", "by").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, model = TaskContext.get(), tokenizer(spec.value)
        writer, done = None, []
        for b in (whole.slice(i, GROUP) for whole in batches for i in range(0, whole.num_rows, GROUP)):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), model.encode_all([t or "" for t in b.column("text").to_pylist()], end)):
                if writer is None:
                    writer = TokenFileWriter(folder, f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}", block, percentile)
                writer.add(doc_id, ids)
                if writer.ids >= file_ids or len(writer.docs) >= FILE_DOCS:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        if done:
            paths, counts, ids = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([task.partitionId()] * len(done), pa.int64()),
                                              pa.array(range(len(done)), pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.int64())],
                                             ["path", "part", "seq", "docs", "ids"])

    files = stored(ordered.mapInArrow(run, "path string, part long, seq long, docs long, ids long"), "token_files")
    files = files.withColumn("run", F.floor(F.col("part") / RUN))
    before = F.sum("ids").over(Window.partitionBy("run").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    runs = files.groupBy("run").agg(F.sum("ids").alias("all")).withColumn("one", F.lit(0))
    earlier = F.sum("all").over(Window.partitionBy("one").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.withColumn("before", before).join(runs.select("run", earlier.alias("earlier")), "run")
    start = F.coalesce("before", F.lit(0)) + F.coalesce("earlier", F.lit(0))
    return placed.select("path", "part", "seq", "docs", "ids", start.alias("start"))


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """One row a document of the files: doc_id, start, n_tokens, ids_crc32 (and token_ids)."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["token_ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, docs, ids, start in zip(*(b.column(c).to_pylist() for c in ("path", "docs", "ids", "start"))):
                f = TokenFile(folder, path)
                if (len(f.counts), f.ids) != (docs, ids):
                    raise ValueError(f"{path} differs from its manifest")
                for k, to, got in f.spans():
                    cuts = f.offsets[k:to + 1] - f.offsets[k]
                    raw = memoryview(got.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                    cols = [pa.array(f.doc_ids[k:to], pa.int64(), mask=f.null_ids[k:to]), pa.array(f.offsets[k:to] + start, pa.int64()),
                            pa.array(f.counts[k:to], pa.int64()), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(got, pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, names)

    files = manifest.repartition(shuffle_partitions(manifest.sparkSession), "path")      # a given number: AQE would merge them
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * with_ids
    return files.mapInArrow(run, schema)


def op12_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents, read the files back: start, length and CRC-32 of every document's ids."""
    folder = scratch_path(spark, "tokens")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), folder), folder)
