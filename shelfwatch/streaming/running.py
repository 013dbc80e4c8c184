"""Running a stream to the end of what is there, into files, restartable.

Every stream writes to a folder and keeps its progress in a checkpoint next to
it, so that starting it again goes on where it stopped and repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_available(stream: DataFrame, path: str, checkpoint: str,
                     by: list[str] | None = None) -> DataFrame:
    """Process all input there is, append to ``path`` exactly once, and read it back."""
    spark = stream.sparkSession
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if by:
        writer = writer.partitionBy(*by)
    writer.start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def update_available(stream: DataFrame, path: str, checkpoint: str, apply=None,
                     mode: str = "update", by: list[str] | None = None) -> DataFrame:
    """Process all input there is, one folder per micro-batch.

    A repeated batch overwrites its own folder, so a restart after a failure
    between write and commit does not double its rows. ``apply`` turns a
    micro-batch, and what the batches before it have written (None for the
    first), into the rows to write. ``by`` are columns a folder is partitioned by,
    for an ``apply`` that reads only part of what was written.
    """
    spark = stream.sparkSession

    def before(batch_id: int) -> DataFrame | None:
        if not batch_id:
            return None
        return spark.read.option("basePath", path).parquet(path).filter(F.col("batch_id") < batch_id)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = apply(batch, before(batch_id)) if apply else batch
        writer = (rows.hint("rebalance", *by).write.partitionBy(*by) if by else rows.write).mode("overwrite")
        writer.parquet(f"{path}/batch_id={batch_id}")

    (stream.writeStream.outputMode(mode).foreachBatch(write)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
     .awaitTermination())
    return spark.read.option("basePath", path).parquet(path)


def stateful_available(stream: DataFrame, path: str, checkpoint: str, apply) -> DataFrame:
    """As :func:`update_available` for an ``apply`` that keeps a state of its own; it gets the batch and its number.

    A repeated batch has the number it had, so that the state can be made again from the version before it.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        apply(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    (stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.option("basePath", path).parquet(path)


def latest_updates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of every key among the folders that :func:`update_available` wrote."""
    rest = [c for c in rows.columns if c not in keys and c != "batch_id"]
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch_id", *rest)).alias("m"))
    return last.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def use_rocksdb(spark) -> None:
    """State kept by arbitrary stateful operators needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
