"""Landed files as a stream: append, deduplicate, count by time window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postprism.functions.dates import as_instant, as_utc_wall_time
from postprism.functions.measures import share_pct


def landed_files(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """A folder of Parquet files as a stream; new files are picked up by name pattern."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def append_stream(stream: DataFrame, path: str, checkpoint: str, collection_id: int) -> None:
    """Append what has landed since the last run under a collection id, then stop.

    The checkpoint remembers the files already taken, and the file sink's log makes each batch count once,
    so a run repeated after a failure adds nothing twice.
    """
    (
        stream.withColumn("collection_id", F.lit(collection_id).cast("int"))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("collection_id")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def dedup_stream(stream: DataFrame, keys: Sequence[str], ts: str, repeat_within: str) -> DataFrame:
    """First arrivals per key.

    State is kept per key until the watermark has passed it by ``repeat_within``, so it is bounded by that
    span: a repeat that arrives later counts as new. Choose the longest time a repeat may take.
    """
    timed = stream.withColumn("_instant", as_instant(F.col(ts))).withWatermark("_instant", repeat_within)
    return timed.dropDuplicatesWithinWatermark(list(keys)).drop("_instant")


class _KeepFirst(StatefulProcessor):
    """Emits a key's first row once; whether it was emitted, or is in the history, is the key's state."""

    def __init__(self, order: Sequence[str]) -> None:
        self._order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self._seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if self._seen.exists():
            return
        # The smallest by order, NULLs last; a batch's rows of one key are looked at one by one, not held.
        first = min(rows, key=lambda row: [(row[name] is None, row[name] if row[name] is not None else 0) for name in self._order])
        self._seen.update((True,))
        yield first

    def close(self) -> None:
        pass


# State on disk: transformWithState needs this store, and it holds more keys than an executor's memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedup_against_history(stream: DataFrame, keys: Sequence[str], order: Sequence[str], history: DataFrame | None = None) -> DataFrame:
    """First arrivals per key that neither the stream so far nor ``history`` holds; nothing is ever forgotten.

    Of a key's rows in one batch the smallest by ``order``, such as the feed's rank and the place in it, is kept; a row of a later
    batch never replaces it. The state is one flag per key on disk, partitioned by key, and starts with the keys of ``history`` when the
    query is started anew; a restarted query goes on from its checkpoint and does not read the history again. NULL keys are equal. The
    session must use STATE_STORE.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")
    seen = None if history is None else history.select(*keys).distinct().groupBy(*keys)
    return stream.groupBy(*keys).transformWithState(_KeepFirst(order), stream.schema, "Append", "None", seen)


def window_counts(stream: DataFrame, ts: str, item: str, width: str, late_by: str) -> DataFrame:
    """Rows per time window and item: window_start, item, postings.

    Counts are combined before the shuffle and spread over windows and items. In append mode a window is
    emitted once, when it is complete; in update mode whenever its count changes. A row later than ``late_by`` is not
    counted, and state is kept for the windows that far back only.
    """
    timed = stream.select(as_instant(F.col(ts)).alias("_instant"), F.col(item).alias("item")).withWatermark(
        "_instant", late_by
    )
    return (
        timed.groupBy(F.window("_instant", width).alias("_window"), "item")
        .agg(F.count(F.lit(1)).alias("postings"))
        .select(as_utc_wall_time(F.col("_window.start")).alias("window_start"), "item", "postings")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append everything available to a Parquet table and return it."""
    (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_updates(counts: DataFrame, path: str, checkpoint: str, value: str = "postings") -> DataFrame:
    """Process everything available of a windowed count in update mode and return its table.

    Each batch appends only the counts it changed, in a folder of its own, so a batch repeated after a failure replaces
    only itself. The newest count of a window and item holds. The watermark ends a window's state, which therefore does not grow
    with the stream; rows later than the watermark allows are not counted.
    """

    def write(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        counts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    keys = [name for name in counts.columns if name != value]
    stored = T.StructType([*counts.schema.fields, T.StructField("batch", T.LongType())])
    changes = counts.sparkSession.read.schema(stored).parquet(path)
    return changes.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def window_shares(counts: DataFrame) -> DataFrame:
    """Share of each item in its window: adds share_of_pct. Works on the finished, small counts."""
    whole = counts.groupBy("window_start").agg(F.sum("postings").alias("_whole"))
    return counts.join(whole, "window_start").select(
        "window_start", "item", "postings", share_pct(F.col("postings"), F.col("_whole")).alias("share_of_pct")
    )
