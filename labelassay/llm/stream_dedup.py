"""Exact deduplication by a stream with keyed state on disk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_all_salts, bloom_bits, bloom_has, done_with, hot_keys, located, remove_path, salted, saved, scan_of, scratch_path, settings

STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    # A store takes an eighth of a write buffer at once, and hundreds of stores may be open in an executor.
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    # Stores of a stream that has ended are closed at the next round of maintenance.
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Without this every state partition holds 4 MB of disk for its manifest, however little it has.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def _stream_state(arrivals: DataFrame, folder: str) -> DataFrame:
    """The state of each digest after the stream ``arrivals`` has been read to its end.

    The state is a streaming aggregate in the RocksDB store and never expires:
    the digest, the largest (doc_id, locator) seen, and how many rows came.
    Every micro-batch appends the states that it changed; the newest of each
    digest is the last state. A batch that runs again appends the same states.
    """
    spark = arrivals.sparkSession
    state = arrivals.groupBy("digest").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count("*").alias("group_size"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    with settings(spark, STATE_ON_DISK):
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(changed).start()
        query.awaitTermination()
    changes = spark.read.schema(state.schema.add("batch", "long")).parquet(f"{folder}/changes")
    return changes.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("last")).select("digest", "last.keep", "last.group_size")


def _hit_rows(bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom_has(bits.value, batch.column("hash").to_numpy())))

    return run


def _odd_rows(rows: DataFrame, state: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows whose full bytes differ from those at their digest's locator (none, but for a collision).

    Texts whose digest surely came once are left out before anything is
    shuffled; the one known text of a hot group goes to each of its salts.
    """
    hits = state.where("group_size > 1").select("digest", F.col("keep.at").alias("kept_at"))
    bits = rows.sparkSession.sparkContext.broadcast(bloom_bits(hits.select(F.xxhash64("digest").alias("id")), hits.count()))
    hashed = rows.select("digest", "doc_id", "at", "text", F.xxhash64(F.xxhash64("digest")).alias("hash"))
    copies = salted(hashed.mapInArrow(_hit_rows(bits), hashed.schema).drop("hash"), hot, "digest", "at")
    copies = saved(copies.join(at_all_salts(hits, hot, "digest"), ["digest", "salt"]), "dedup-copies")
    known = at_all_salts(copies.where(F.col("at") == F.col("kept_at")).select("digest", F.col("text").alias("known")), hot, "digest")
    others = copies.where(F.col("at") != F.col("kept_at")).select("digest", "salt", "at", "doc_id", "text")
    odd = saved(others.join(known, ["digest", "salt"]).where(F.col("text") != F.col("known")).select("digest", "at", "doc_id", "text"), "dedup-odd")
    done_with(copies)
    return odd


def stream_dedup(docs: DataFrame, batches: int = 2, rows_per_salt: int = 500, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """Decide for every row whether it stays; of equal texts the largest doc_id stays.

    Reads ``doc_id`` and ``text``; other columns are left out. Null texts count
    as empty, and empty texts are copies of one another. Digests, identifiers
    and content locators arrive as a stream of files, in about ``batches``
    micro-batches, and are kept in keyed state on disk. On a hit the full bytes
    are compared with those at the kept locator, in a join in which only texts
    of groups take part and a large group is dealt over salts; a text that
    differs is grouped by its own bytes. Of rows that repeat the largest
    doc_id, the last locator stays. A null doc_id is below every other. An
    empty table gives no rows. ``digest`` makes the key from the SHA-256 (tests
    use short ones, to meet collisions).

    Returns at (locator), doc_id, keep_id, group_size, kept, text_sha256.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "dedup-stream")
    key = digest or F.unhex
    rows = located(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "at")
    rows = rows.withColumn("sha", F.sha2("text", 256)).withColumn("digest", key(F.col("sha")))
    arrivals = rows.select("digest", "doc_id", "at", "sha")
    arrivals.write.parquet(f"{folder}/arrivals")
    arrived = spark.read.schema(arrivals.schema).parquet(f"{folder}/arrivals")
    files = len(arrived.inputFiles())
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{folder}/arrivals")
    state = saved(_stream_state(stream, folder), "dedup-state")
    remove_path(spark, f"{folder}/progress")
    remove_path(spark, f"{folder}/changes")
    hot = saved(hot_keys(state.select("digest", F.col("group_size").alias("n")), arrived.count(), rows_per_salt), "dedup-hot")
    odd = _odd_rows(rows, state, hot)

    out = salted(arrived, hot, "digest", "at").join(at_all_salts(state, hot, "digest"), ["digest", "salt"]).select("at", "doc_id", "keep", "group_size", "sha", "digest")
    if not odd.isEmpty():
        own = odd.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "at")).alias("own_keep"), F.count("*").alias("own_size"))
        own = odd.join(own, ["digest", "text"]).select("at", "own_keep", "own_size")
        fewer = odd.groupBy("digest").agg(F.count("*").alias("fewer"))
        out = out.join(own, "at", "left").join(fewer, "digest", "left")
        out = out.withColumn("keep", F.coalesce("own_keep", "keep")).withColumn("group_size", F.coalesce(F.col("own_size"), F.col("group_size") - F.coalesce("fewer", F.lit(0))))
    return out.select("at", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("keep.at")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = scan_of(docs)
    gone = stream_dedup(docs).where("NOT kept").select(F.col("at.file").alias("gone_file"), F.col("at.row").alias("gone_row"))
    rows = located(docs.select(F.struct("*").alias("doc")))
    return rows.join(gone, (F.col("at.file") == F.col("gone_file")) & (F.col("at.row") == F.col("gone_row")), "left_anti").select("doc.*")
