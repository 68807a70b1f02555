"""Token ids in files of patched frame-of-reference blocks.

A file is a row of segments, each with the ids of whole documents, in order:

* header: magic ``PFR1``, then unsigned little-endian ids in a block (u32),
  bytes of the segment (u64), documents (u64), ids (u64), blocks (u64);
* documents: a validity byte each, identifiers (i64), counts of ids (u64);
* block index: where each block starts in the block area (u64, one more than blocks);
* blocks: minimum (u32), width (u8), exceptions (u16), the exceptions'
  positions (u16 each) and differences (u32 each), then all differences from
  the minimum packed with ``width`` bits in 64-bit words. A difference that
  doesn't fit the width is packed as 0 and stands in the exception list. The
  last block repeats its minimum up to the block's length.

The width is the bits that a percentile of the block's differences needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import dealt
from .common import by_size, forget_kept, parts_for, saved, scratch_path, text_bytes, trim_heap
from .tokens import TEXT_BYTES, tokenizer

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 0.95
HEAD = np.dtype([("magic", "S4"), ("block", "<u4"), ("bytes", "<u8"), ("docs", "<u8"), ("ids", "<u8"), ("blocks", "<u8")])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``values`` (uint64, below 2**width) as rows of 64-bit words."""
    n, length = values.shape
    lanes = np.ascontiguousarray(values.T)
    words = np.zeros((-(-length * width // 64), n), np.uint64)
    for i in range(length if width else 0):
        at, shift = divmod(i * width, 64)
        words[at] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T)


def _unpack(words: np.ndarray, width: int, length: int) -> np.ndarray:
    out = np.zeros((length, len(words)), np.uint64)
    lanes, mask = np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    for i in range(length if width else 0):
        at, shift = divmod(i * width, 64)
        x = lanes[at] >> np.uint64(shift)
        if shift + width > 64:
            x |= lanes[at + 1] << np.uint64(64 - shift)
        out[i] = x & mask
    return np.ascontiguousarray(out.T)


_WIDTH = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that unsigned numbers below 2**32 need."""
    if not x.size or int(x.max()) < 1 << 16:
        return _WIDTH[x]
    return np.where(x >> 16, 16 + _WIDTH[x >> 16], _WIDTH[x & 0xFFFF])


def encode_segment(valid: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    n_blocks = -(-len(ids) // block)
    padded = np.zeros(n_blocks * block, np.uint32)
    padded[: len(ids)] = ids
    grid = padded.reshape(n_blocks, block)
    rest = len(ids) % block
    if rest:
        grid[-1, rest:] = grid[-1, :rest].min()
    low = grid.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    diff = grid - low[:, None]
    at = min(block - 1, int(np.ceil(percentile * block)) - 1)
    bits = _bits(diff)
    width = np.partition(bits, at, axis=1)[:, at].astype(int) if n_blocks else np.zeros(0, int)
    odd = bits > width[:, None]
    n_odd = odd.sum(axis=1)
    n_words = -(-block * width // 64)
    starts = np.zeros(n_blocks + 1, np.uint64)
    np.cumsum(7 + 6 * n_odd + 8 * n_words, out=starts[1:])
    area = np.zeros(int(starts[-1]), np.uint8)
    row, col = np.nonzero(odd)
    first = np.concatenate([[0], np.cumsum(n_odd)]).astype(np.int64)
    rank = np.arange(len(row)) - first[row]
    base = starts[:-1].astype(np.int64)

    def put(where: np.ndarray, values: np.ndarray, kind: str) -> None:
        raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), values[:1].size * np.dtype(kind).itemsize)
        area[where[:, None] + np.arange(raw.shape[1])] = raw

    if n_blocks:
        put(base, low, "<u4")
        put(base + 4, width, "<u1")
        put(base + 5, n_odd, "<u2")
        put(base[row] + 7 + 2 * rank, col, "<u2")
        put(base[row] + 7 + 2 * n_odd[row] + 4 * rank, diff[odd], "<u4")
        kept = np.where(odd, 0, diff).astype(np.uint64)
        for w in np.unique(width[width > 0]):
            these = np.flatnonzero(width == w)
            put(base[these] + 7 + 6 * n_odd[these], _pack(kept[these], int(w)), "<u8")
    n_bytes = HEAD.itemsize + 17 * len(counts) + starts.nbytes + area.nbytes
    head = np.array([(MAGIC, block, n_bytes, len(counts), len(ids), n_blocks)], HEAD)
    return b"".join([head.tobytes(), valid.astype(np.uint8).tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), area.tobytes()])


def segments(raw: memoryview) -> Iterator[memoryview]:
    at = 0
    while at < len(raw):
        n = int(np.frombuffer(raw, HEAD, 1, at)[0]["bytes"])
        yield raw[at : at + n]
        at += n


def decode_segment(raw: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Validity, identifiers, counts and ids of a segment."""
    head = np.frombuffer(raw, HEAD, 1)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a segment of patched frame-of-reference blocks")
    block, docs, n_ids, n_blocks = (int(head[k]) for k in ("block", "docs", "ids", "blocks"))
    at = HEAD.itemsize
    valid = np.frombuffer(raw, np.uint8, docs, at)
    doc_ids = np.frombuffer(raw, "<i8", docs, at + docs)
    counts = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    base = np.frombuffer(raw, "<u8", n_blocks + 1, at).astype(np.int64)[:-1]
    area = np.frombuffer(raw, np.uint8, offset=at + 8 * (n_blocks + 1))

    def get(where: np.ndarray, n: int, kind: str) -> np.ndarray:
        raw = area[where[:, None] + np.arange(n * np.dtype(kind).itemsize)]
        return np.ascontiguousarray(raw).view(kind)

    out = np.zeros((n_blocks, block), np.uint32)
    if n_blocks:
        low, width, n_odd = get(base, 1, "<u4"), get(base + 4, 1, "<u1")[:, 0].astype(np.int64), get(base + 5, 1, "<u2")[:, 0].astype(np.int64)
        for w in np.unique(width[width > 0]):
            these = np.flatnonzero(width == w)
            words = get(base[these] + 7 + 6 * n_odd[these], -(-block * int(w) // 64), "<u8")
            out[these] = _unpack(words, int(w), block)
        row = np.repeat(np.arange(n_blocks), n_odd)
        if len(row):
            first = np.concatenate([[0], np.cumsum(n_odd)])
            rank = np.arange(len(row)) - first[row]
            col = get(base[row] + 7 + 2 * rank, 1, "<u2")[:, 0]
            out[row, col] = get(base[row] + 7 + 2 * n_odd[row] + 4 * rank, 1, "<u4")[:, 0]
        out += low
    return valid, doc_ids, counts, out.reshape(-1)[:n_ids]


def _writer(folder: str, vocabulary: str, end: int, segment_ids: int, file_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        library, tail = tokenizer(vocabulary), np.array([end], "<u4").tobytes()
        schema = pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        number, out, done = 0, None, [0, 0]
        held: list[tuple[bool, int, bytes]] = []
        held_ids = 0

        def flush() -> None:
            nonlocal out, held_ids
            part = f"{path}/.{TaskContext.get().partitionId():06d}.{uuid.uuid4().hex}"
            out = out or (part, store.open_output_stream(part))
            valid, doc_ids, ids = zip(*held)
            counts = np.array([len(x) // 4 for x in ids])
            out[1].write(encode_segment(np.array(valid), np.array(doc_ids), counts, np.frombuffer(b"".join(ids), np.uint32)))
            done[0] += len(held)
            done[1] += held_ids
            held.clear()
            held_ids = 0

        def close() -> pa.RecordBatch:
            """A file gets its last name when it is whole, so a task may run twice."""
            nonlocal number, out
            name = f"ids-{TaskContext.get().partitionId():06d}-{number:06d}.pfr"
            out[1].close()
            store.move(out[0], f"{path}/{name}")
            row = pa.RecordBatch.from_pylist([{"file": name, "n_docs": done[0], "n_ids": done[1]}], schema=schema)
            number, out, done[:] = number + 1, None, [0, 0]
            return row

        for batch in batches:
            for some in by_size(batch, "text", TEXT_BYTES):
                for doc_id, raw in zip(some.column("doc_id").to_pylist(), library.encode(some.column("text"))):
                    held.append((doc_id is not None, doc_id or 0, raw + tail))
                    held_ids += len(raw) // 4 + 1
                    if held_ids >= segment_ids:
                        flush()
                        if done[1] >= file_ids:
                            yield close()
        if held:
            flush()
        if out:
            yield close()
        # Spark hands tasks to idle workers in turn, so all of an executor's workers would keep pieces.
        library.forget_pieces()
        trim_heap()

    return write


def write_id_blocks(docs: DataFrame, vocabulary: str, folder: str, end: int = 0, segment_ids: int = 250_000, file_ids: int = 8_000_000) -> DataFrame:
    """Tokenize whole texts and write their ids in ascending order of ``doc_id``.

    Reads ``doc_id`` (long) and ``text``; other columns are left out. A null or
    empty text is the end id alone. Rows of a null ``doc_id`` come first, rows
    of one ``doc_id`` in the order of a hash of their texts; all are written.
    An empty table writes no file. A segment ends after ``segment_ids`` ids and a
    file after ``file_ids`` (at the next document's end). Returns the manifest: file, n_docs, n_ids and
    start (ids in the files before it).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts_for(docs, rows.agg(text_bytes()).first()[0]), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = saved(ordered.mapInArrow(_writer(folder, vocabulary, end, segment_ids, file_ids), "file string, n_docs long, n_ids long"), "id-files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _whole_read(stream, n: int) -> bytes:
    """The next ``n`` bytes, also where a store hands out fewer at a time; fewer only at the end."""
    raw = stream.read(n)
    while 0 < len(raw) < n and (more := stream.read(n - len(raw))):
        raw += more
    return raw


def _segments_of(stream) -> Iterator[bytes]:
    """The segments of an open file, one at a time."""
    while head := _whole_read(stream, HEAD.itemsize):
        yield head + _whole_read(stream, int(np.frombuffer(head, HEAD)[0]["bytes"]) - len(head))


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        forget_kept()  # the tokenizer and its pieces
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_stream(f"{path}/{name}") as stream:
                    for segment in _segments_of(stream):
                        valid, doc_ids, counts, ids = decode_segment(memoryview(segment))
                        ends = np.cumsum(counts)
                        own = memoryview(ids.astype("<u4").tobytes())
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(doc_ids, pa.int64(), mask=valid == 0),
                                pa.array(before + ends - counts, pa.int64()),
                                pa.array([own[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist())], pa.binary()),
                            ],
                            names=["doc_id", "start", "ids"],
                        )
                        before += int(ends[-1])

    return read


def read_id_blocks(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents from the files: doc_id, start (ids before it), ids (little-endian unsigned 32-bit).

    Files are dealt over tasks, and a task holds one segment of them at a time.
    """
    return dealt(manifest.select("file", "start")).mapInArrow(_reader(folder), "doc_id long, start long, ids binary")


def id_block_digest(docs: DataFrame, vocabulary: str, end: int = 0) -> DataFrame:
    """Write the ids into a new shared folder, read them back and digest each document.

    Returns doc_id, start, n_tokens (with the end id) and ids_crc32; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "pfr")
    manifest = write_id_blocks(docs, vocabulary, folder, end)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    ids = read_id_blocks(spark, folder, manifest)
    return saved(ids.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "id-digests")
