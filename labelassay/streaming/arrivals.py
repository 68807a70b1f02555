"""Documents that arrive batch after batch: the first of each brand is saved, whatever came in which batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.match import LOWER, UPPER
from ..storage import settings

ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
SAVED, DUPLICATE, FAILED = "saved", "duplicate", "failed"
OUTCOME = "doc_id long, batch_id long, filename string, outcome string"
_COLUMNS = ["doc_id", "batch_id", "filename", "outcome"]


#: Keys are dealt over so many groups of the stateful operator; a folder of ``run_arrivals`` keeps to it.
BUCKETS = 256


class FirstClaims(StatefulProcessor):
    """State of a bucket of keys: for each key the document that claimed it. It never expires.

    Rows of a micro-batch come in any order; of a key that is still free the
    least doc_id claims it. Only the best row so far of each free key is held,
    so a key may have any number of rows. A group for each key would cost a
    call and some frames for a few rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claimed = handle.getMapState("claimed", "key string", "doc_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        free: dict[str, bool] = {}
        first = None
        for frame in rows:
            for k in frame["key"].unique():
                if k not in free:
                    free[k] = not self.claimed.containsKey((k,))
            may = frame["key"].map(free).astype(bool)
            yield frame.loc[~may, _COLUMNS[:-1]].assign(outcome=DUPLICATE)
            first = pd.concat([*([] if first is None else [first]), frame[may]], ignore_index=True)
            best = first.groupby("key", sort=False)["doc_id"].idxmin()
            yield first.drop(index=best)[_COLUMNS[:-1]].assign(outcome=DUPLICATE)
            first = first.loc[best]
        if first is not None and len(first):
            for k, doc_id in zip(first["key"], first["doc_id"].tolist()):
                self.claimed.updateValue((k,), (doc_id,))
            yield first[_COLUMNS[:-1]].assign(outcome=SAVED)

    def close(self) -> None:
        pass


def outcomes(arrivals: DataFrame, saved_keys: DataFrame | None = None) -> DataFrame:
    """A stream of ``OUTCOME`` for a stream of documents (doc_id, batch_id, filename, brand, error).

    A document with an error fails and claims nothing. A blank or null brand is
    never a duplicate. Of the others with one brand (spaces trimmed, A-Z
    folded) the first to arrive is saved, in a micro-batch that of the least
    doc_id, unless ``saved_keys`` (a table with a column ``key``) has the brand.
    """
    key = F.nullif(F.translate(F.trim("brand"), UPPER, LOWER), F.lit(""))
    rows = arrivals.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("batch_id").cast("long").alias("batch_id"), "filename", F.when(F.col("error").isNull(), key).alias("key"), F.col("error").isNotNull().alias("failed"))
    if saved_keys is not None:
        known = saved_keys.select(F.translate(F.trim("key"), UPPER, LOWER).alias("key")).where("key IS NOT NULL").distinct().withColumn("known", F.lit(True))
        rows = rows.join(known, "key", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("boolean"))
    decided = F.when(F.col("failed"), FAILED).when(F.col("key").isNull(), SAVED).when(F.col("known"), DUPLICATE)
    rows = rows.withColumn("outcome", decided)
    claims = rows.where("outcome IS NULL").select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket"), "key", "doc_id", "batch_id", "filename")
    claimed = claims.groupBy("bucket").transformWithStateInPandas(statefulProcessor=FirstClaims(), outputStructType=OUTCOME, outputMode="append", timeMode="None")
    return rows.where("outcome IS NOT NULL").select(*_COLUMNS).unionByName(claimed)


def run_arrivals(arrivals: DataFrame, folder: str, saved_keys: DataFrame | None = None) -> DataFrame:
    """Work off what has arrived since the last run with this ``folder`` and return all outcomes so far.

    The folder holds the state, the progress and the outcomes; a run that was
    broken off goes on there, and each document has its outcome once.
    """
    spark = arrivals.sparkSession
    with settings(spark, ON_DISK):
        query = outcomes(arrivals, saved_keys).writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/outcomes")
        query.awaitTermination()
    return spark.read.schema(OUTCOME).parquet(f"{folder}/outcomes")


def counts_of_batches(decided: DataFrame) -> DataFrame:
    """batch_id with saved, duplicates and failed: what became of each batch's documents."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    return decided.groupBy("batch_id").agg(n(SAVED).alias("saved"), n(DUPLICATE).alias("duplicates"), n(FAILED).alias("failed"))
