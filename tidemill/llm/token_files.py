"""Token-ID output in fixed-width bit-packed files.

A file holds the ids of whole documents in ascending doc_id order, a bounded number of them unless one document has more.
Every id takes the same number of bits, the fewest that the vocabulary allows, least significant bit first. Layout,
little-endian:

    magic 8 bytes | bits u32 | ids per block u32 | ids u64 | documents u64
    doc_id i64 x documents | doc_id is null u8 x documents | ids before each document u64 x (documents + 1)
    byte offset of each block u64 x (blocks + 1) | blocks, each padded to a byte

Block offsets let a reader take any range of ids without touching the rest.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, in_arrow, scratch, stored, text_or_empty, to_arrow
from .word_ids import worker

MAGIC = b"TIDEPK01"
HEAD = struct.Struct("<8sIIQQ")
#: Ids per block.
BLOCK_IDS = 65_536
#: Bytes of text per file, about.
FILE_BYTES = 16 << 20
#: Tasks whose files' starts are summed together, and tasks that read files at most.
TASK_GROUP, READ_TASKS = 1024, 10_000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, least significant bit first, `bits` bits each, padded to a byte."""
    n = len(ids)
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = np.zeros((n + 7) // 8 * 8, dtype=np.uint64)
    lanes[:n] = ids
    lanes = lanes.reshape(-1, 8)
    out = np.zeros((len(lanes), bits + 1), dtype=np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for i in range((shift + bits + 7) // 8):
            out[:, byte + i] |= (value >> np.uint64(8 * i)).astype(np.uint8)
    return out[:, :bits].tobytes()[: (n * bits + 7) // 8]


def unpack(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The inverse of pack, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    groups = (n + 7) // 8
    bytes_ = np.zeros(groups * bits, dtype=np.uint8)
    bytes_[: (n * bits + 7) // 8] = np.frombuffer(raw, dtype=np.uint8, count=(n * bits + 7) // 8)
    rows = np.pad(bytes_.reshape(groups, bits), ((0, 0), (0, 1))).astype(np.uint64)
    out = np.empty((groups, 8), dtype="<u4")
    mask = np.uint64((1 << bits) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = np.zeros(groups, dtype=np.uint64)
        for i in range((shift + bits + 7) // 8):
            value |= rows[:, byte + i] << np.uint64(8 * i)
        out[:, lane] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


class PackedWriter:
    """One file's content, packed block by block as ids arrive: what is held of it has `bits` bits an id."""

    def __init__(self, bits: int, block_ids: int = BLOCK_IDS):
        self.bits, self.block_ids = bits, block_ids
        self.keys: list[int | None] = []
        self.offsets, self.n_ids = [0], 0
        self.blocks: list[bytes] = []
        self.pending: list[bytes] = []
        self.n_pending = 0

    def extend(self, raw: bytes) -> None:
        """More ids, little-endian unsigned 32-bit integers, of the document at hand."""
        self.pending.append(raw)
        self.n_pending += len(raw) // 4
        if self.n_pending >= self.block_ids:
            self._pack(self.n_pending // self.block_ids * self.block_ids)

    def end_document(self, doc_id: int | None) -> None:
        self.keys.append(doc_id)
        self.n_ids = len(self.blocks) * self.block_ids + self.n_pending
        self.offsets.append(self.n_ids)

    def _pack(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.pending), dtype="<u4")
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.blocks += [pack(ids[i : min(n, i + self.block_ids)], self.bits) for i in range(0, n, self.block_ids)]
        self.pending, self.n_pending = [ids[n:].tobytes()], len(ids) - n

    def parts(self) -> Iterator[bytes]:
        """The file, in order."""
        if self.n_pending:
            self._pack(self.n_pending)
        at = np.zeros(len(self.blocks) + 1, dtype="<u8")
        np.cumsum([len(b) for b in self.blocks], out=at[1:])
        yield HEAD.pack(MAGIC, self.bits, self.block_ids, self.n_ids, len(self.keys))
        yield np.array([d or 0 for d in self.keys], dtype="<i8").tobytes()
        yield np.array([d is None for d in self.keys], dtype=np.uint8).tobytes()
        yield np.array(self.offsets, dtype="<u8").tobytes()
        yield at.tobytes()
        yield from self.blocks


def file_bytes(doc_ids: list[int | None], ids: list[bytes], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """One file from documents' ids (each as little-endian unsigned 32-bit integers)."""
    writer = PackedWriter(bits, block_ids)
    for doc_id, raw in zip(doc_ids, ids, strict=True):
        writer.extend(raw)
        writer.end_document(doc_id)
    return b"".join(writer.parts())


class PackedFile:
    """Random access to the content of one file: bytes, or an open Arrow file, of which only what is asked for is read."""

    def __init__(self, content: bytes | pa.NativeFile):
        self.file = pa.BufferReader(content) if isinstance(content, bytes) else content
        magic, self.bits, self.block_ids, self.n_ids, self.n_docs = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(self._read(at, 8 * self.n_docs), "<i8")
        self.null_ids = np.frombuffer(self._read(at := at + 8 * self.n_docs, self.n_docs), np.uint8).astype(bool)
        self.offsets = np.frombuffer(self._read(at := at + self.n_docs, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        n_blocks = -(-self.n_ids // self.block_ids)
        self.blocks = np.frombuffer(self._read(at := at + 8 * (self.n_docs + 1), 8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.payload = at + 8 * len(self.blocks)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file; only the blocks that hold them are read and unpacked."""
        if stop <= start:
            return np.empty(0, dtype="<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        raw = memoryview(self._read(self.payload + int(self.blocks[first]), int(self.blocks[last + 1] - self.blocks[first])))
        parts = []
        for k in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            parts.append(unpack(raw[self.blocks[k] - self.blocks[first] : self.blocks[k + 1] - self.blocks[first]], n, self.bits))
        return np.concatenate(parts)[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.offsets[i]), int(self.offsets[i + 1]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, its ids), unpacking each block once for a run of documents."""
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + 16 * self.block_ids, side="right")) - 1)
            run, base = self.ids(int(self.offsets[i]), int(self.offsets[j])), self.offsets[i]
            for d in range(i, j):
                yield None if self.null_ids[d] else int(self.doc_ids[d]), int(self.offsets[d]), run[self.offsets[d] - base : self.offsets[d + 1] - base]
            i = j


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, file_bytes_of_text: int = FILE_BYTES) -> DataFrame:
    """Encodes whole texts (null: empty), appends end_id to each and writes the files under `path`, which all executors
    must share. Documents are ordered by doc_id, null first, then by their text's hash; repeated rows are documents of
    their own. An empty table writes nothing. Returns the manifest: task, file, n_docs, n_ids, start (ids of all files
    before).

    Spark's range partitioning deals the rows by (doc_id, hash of the text, row), so a doc_id that many rows share is
    spread over tasks; a task begins another file at file_bytes_of_text, so no file grows with a task. A file is written
    under a temporary name and then moved, so a repeated task only replaces it by its equal.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits, end = bits_for(vocabulary), np.array([end_id], dtype="<u4").tobytes()
    schema = "task long, file long, n_docs long, n_ids long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        encoder, task, number = worker(tokenizer), TaskContext.get().partitionId(), 0
        writer, held = PackedWriter(bits), 0

        def close() -> pa.RecordBatch:
            with system.open_output_stream(hidden := f"{root}/_{uuid.uuid4().hex}") as f:
                for part in writer.parts():
                    f.write(part)
            system.move(hidden, f"{root}/{file_name(task, number)}")
            return pa.RecordBatch.from_pydict({"task": [task], "file": [number], "n_docs": [len(writer.keys)], "n_ids": [writer.n_ids]}, schema=to_arrow(schema))

        for part in chunks(batches):
            for key, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                for ids in encoder.parts(text):
                    writer.extend(ids)
                writer.extend(end)
                writer.end_document(key)
                held += len(text)
                if held >= file_bytes_of_text:
                    yield close()
                    writer, held, number = PackedWriter(bits), 0, number + 1
        if writer.keys:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    placed = docs.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(max(1, math.ceil(total / file_bytes_of_text)), *order).sortWithinPartitions(*order)
    manifest = stored(in_arrow(placed.select("doc_id", "text"), write, schema), "packed-manifest")
    # Ids before a file: those of the groups of tasks before, and of the files before in its group.
    manifest = manifest.withColumn("tasks", F.floor(F.col("task") / TASK_GROUP))
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = manifest.groupBy("tasks").agg(F.sum("n_ids").alias("n_ids")).select(F.col("tasks").alias("of"), earlier(Window.orderBy("tasks")).alias("base"))
    within = manifest.withColumn("before", earlier(Window.partitionBy("tasks").orderBy("task", "file")))
    return stored(within.join(groups, F.col("tasks") == F.col("of")).select("task", "file", "n_docs", "n_ids", (F.col("base") + F.col("before")).alias("start")), "packed-starts")


def file_name(task: int, number: int) -> str:
    return f"part-{task:08d}-{number:06d}.tide"


def read_packed(path: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32 (unsigned crc32 of its ids as little-endian unsigned 32-bit integers). The manifest names the files and
    the ids before each."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    target = to_arrow(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        for part in batches:
            for task, number, start in zip(*(part[c].to_pylist() for c in ("task", "file", "start")), strict=True):
                with system.open_input_file(f"{root}/{file_name(task, number)}") as f:
                    rows = [(doc_id, start + local, len(ids), zlib.crc32(ids.tobytes())) for doc_id, local, ids in PackedFile(f).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    files = manifest.count()
    return in_arrow(manifest.select("task", "file", "start").repartition(max(1, min(files, READ_TASKS))), read, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, file_bytes_of_text: int = FILE_BYTES) -> DataFrame:
    """Writes the packed files of `docs` (doc_id, text) to the shared folder and returns what read_packed finds in them.
    Null texts are empty and have the end id only; nulls, ties and repeated rows as in write_packed; an empty table gives
    no rows."""
    path = scratch(docs.sparkSession, "token-files")
    manifest = write_packed(docs, path, tokenizer, end_id, worker(tokenizer).vocabulary, file_bytes_of_text)
    return read_packed(path, manifest)
