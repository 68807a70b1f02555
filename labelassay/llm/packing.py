"""Packing token pieces into sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, located, parts_for, text_bytes, trim_heap
from .shingles import mix
from .tokens import TEXT_BYTES, tokenizer

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, pack_group long"
PACKED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; longest first, ties in the given order.

    A tournament tree over the bins has in each node the most room of a bin
    below it, so the first bin with enough room is found from the root, left
    child first.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def _cutter(vocabulary: str, end: int, capacity: int, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, tail = tokenizer(vocabulary), np.array([end], "<u4").tobytes()
        for batch in batches:
            for some in by_size(batch, "text", TEXT_BYTES):
                rows, seeds = [], []
                for doc_id, seed, raw in zip(*(some.column(c).to_pylist() for c in ("doc_id", "seed")), library.encode(some.column("text"))):
                    raw += tail
                    n = len(raw) // 4
                    rows += [(doc_id, s, min(capacity, n - s), n, raw[4 * s : 4 * (s + capacity)]) for s in range(0, n, capacity)]
                    seeds += [seed] * -(-n // capacity)
                columns = [*zip(*rows)]
                # A hash of the row's place: the same in whatever order a task meets its rows.
                dice = mix(np.array(seeds, np.int64).view(np.uint64))
                columns.append((dice % np.uint64(groups)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["doc_id", "start", "length", "doc_tokens", "ids", "pack_group"])
        # Spark hands tasks to idle workers in turn, so all of an executor's workers would keep pieces.
        library.forget_pieces()
        trim_heap()

    return cut


def _placer(capacity: int, stride: int) -> Callable[[pa.Table], pa.Table]:
    def place(table: pa.Table) -> pa.Table:
        group = table.column("pack_group")[0].as_py()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(group * stride + bins)).append_column("offset", pa.array(offsets))

    return place


def pack(docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = 2048, group_docs: int = 2048) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` ids.

    Reads ``doc_id`` and ``text``; other columns are left out. A document is the
    ids of its text (null: empty) and the end id; it is cut after every
    ``capacity`` ids, so only its last piece is short. Documents are dealt, with
    all their pieces, by a hash of their row's place into groups of about
    ``group_docs`` documents, and each group is packed alone by first-fit
    decreasing. Rows that repeat or share a doc_id
    are packed each; a null doc_id stays null; an empty table gives no rows.
    Returns a row for each piece: doc_id, start, length, doc_tokens, ids
    (little-endian unsigned 32-bit), sequence_id, offset.
    """
    rows = located(docs.select("doc_id", "text"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("at.file", "at.row").alias("seed"))
    n_rows, n_bytes = rows.agg(F.count("*"), text_bytes()).first()
    groups = max(1, -(-n_rows // group_docs))
    pieces = rows.mapInArrow(_cutter(vocabulary, end, capacity, groups), PIECES)
    stride = 1 << 32  # more than a group has pieces
    pieces = pieces.repartition(parts_for(docs, n_bytes, 8 << 20), "pack_group")
    return pieces.groupBy("pack_group").applyInArrow(_placer(capacity, stride), PACKED)


def pack_digest(docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = 2048, group_docs: int = 2048) -> DataFrame:
    """``pack`` with the ids of each piece as their crc32."""
    packed = pack(docs, vocabulary, end, capacity, group_docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
