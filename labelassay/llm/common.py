"""Helpers shared by the operators: shared scratch tables, Bloom bits, batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..storage import drop_table, kept_table, remove_path, scratch_path, settings, shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it.

    This cuts the lineage, and a lost executor costs only the tasks it ran.
    Whole texts go to Python in small Arrow batches.
    """
    with settings(df.sparkSession, {"spark.sql.parquet.compression.codec": "zstd"}):
        return kept_table(df, name)


def done_with(*tables: DataFrame) -> None:
    """Remove the files of tables that ``saved`` returned and nothing will read again.

    Spark removes the shuffle files of a plan after the driver's JVM has
    collected the plan; with a large heap that may be long after, so it is
    asked to collect now.
    """
    drop_table(*tables)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the identifier as text is divisible by ``folds`` (null: true)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)) == 0


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(rows: DataFrame, n_bytes: int, part_bytes: int = 16 << 20) -> int:
    """Partitions for a shuffle of ``n_bytes``, as counted by the caller: the session's number, more if they ask for it."""
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // part_bytes))


def text_bytes(column: str = "text") -> Column:
    """An aggregate: bytes of a text column, 16 more for each row."""
    return F.coalesce(F.sum(F.coalesce(F.octet_length(F.col(column).cast("string")), F.lit(0)) + 16), F.lit(0)).cast("long")


def scan_of(docs: DataFrame) -> DataFrame:
    """``docs`` if it is a plain scan of files, else a scan of its rows, written to the shared folder."""
    try:
        docs.select("_metadata.file_path")
        return docs
    except AnalysisException:
        return saved(docs, "rows")


def located(docs: DataFrame) -> DataFrame:
    """Rows of a scan with the locator ``at``: the file and the row in it that hold the content."""
    return scan_of(docs).select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))


# ---- joins on keys of which a few may be very frequent ------------------------------

HOT_KEYS = 4096


def hot_keys(counted: DataFrame, total: int, least: int = 500) -> DataFrame:
    """Of ``counted`` (a key and its rows ``n``) the keys with over 1 / ``HOT_KEYS`` of all rows, and ``salts``.

    There are ``HOT_KEYS`` of them at most, so they may be broadcast.
    """
    most = max(least, -(-total // HOT_KEYS))
    return counted.where(F.col("n") > most).withColumn("salts", F.ceil(F.col("n") / most).cast("int")).drop("n")


def salted(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with ``salt``: 0, but for hot keys drawn by a hash of the column ``by``."""
    salt = F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1))).cast("int")
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", salt).drop("salts")


def at_all_salts(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``rows`` (one for each key) once for each salt of their key."""
    salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(salts)).drop("salts")


# ---- Bloom bits -----------------------------------------------------------------

BLOOM_MIN_BITS, BLOOM_MAX_BITS = 1 << 16, 1 << 27
BLOOM_CHUNK = 1 << 13  # words that reach the driver as one value


def _bloom_chunk(words: pa.Table) -> pa.Table:
    """A chunk's words that have bits set, as the bytes of all its words."""
    at, out = words.column("word").to_numpy(), np.zeros(BLOOM_CHUNK, np.uint32)
    out[at % BLOOM_CHUNK] = words.column("set").to_numpy().astype(np.uint32)
    return pa.table({"chunk": pa.array([at[0] // BLOOM_CHUNK], pa.int64()), "words": pa.array([out.tobytes()], pa.binary())})


def bloom_bits(ids: DataFrame, n_ids: int) -> np.ndarray:
    """Bits of the hashes of a long column ``id``: at most ``BLOOM_MAX_BITS`` (16 MB).

    Only used to leave out rows that surely aren't needed, so a full filter
    costs time and changes no result. Tasks pack the words: a row for each would
    cost the driver over a hundred times its four bytes.
    """
    bits = BLOOM_MIN_BITS
    while bits < min(16 * n_ids, BLOOM_MAX_BITS):
        bits *= 2
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = (
        ids.select(F.shiftright(at, 5).alias("word"), (at % 32).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("set"))
    )
    chunks = words.groupBy(F.floor(F.col("word") / BLOOM_CHUNK)).applyInArrow(_bloom_chunk, "chunk long, words binary")
    out = np.zeros(bits // 32, np.uint32)
    for r in chunks.collect():
        own = out[r["chunk"] * BLOOM_CHUNK : (r["chunk"] + 1) * BLOOM_CHUNK]
        own[:] = np.frombuffer(r["words"], np.uint32)[: len(own)]
    return out


def bloom_has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which xxhash64 values (int64) may be among those of ``bloom_bits``."""
    at = np.mod(hashes, len(bits) * 32)
    return (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 != 0


def hash_of_longs(ids: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of 64-bit numbers (int64)."""
    prime = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]  # fixed values of XXH64
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = turn(ids.view(np.uint64) * prime[1], 31) * prime[0] ^ (np.uint64(42 + 8) + prime[4])
    h = turn(h, 27) * prime[0] + prime[3]
    h = (h ^ (h >> np.uint64(33))) * prime[1]
    h = (h ^ (h >> np.uint64(29))) * prime[2]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def maybe_in(bits) -> Callable[[Column], Column]:
    """A filter that lets an xxhash64 pass if it may be among those of broadcast ``bloom_bits``."""

    @F.pandas_udf("boolean")
    def has(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            yield pd.Series(bloom_has(bits.value, hashes.to_numpy(np.int64)))

    return has


# ---- Python workers ----------------------------------------------------------------

#: What operators keep in a Python worker from task to task.
KEPT_IN_WORKER: list[dict] = []


def trim_heap() -> None:
    """Give memory that was freed back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def forget_kept() -> None:
    """Give back what another operator kept in this worker: Spark reuses workers for all of them."""
    if any(KEPT_IN_WORKER):
        for kept in KEPT_IN_WORKER:
            kept.clear()
        gc.collect()
    trim_heap()


# ---- batches --------------------------------------------------------------------


def by_size(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of the text column each (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
