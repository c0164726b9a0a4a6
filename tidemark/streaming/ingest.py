"""Streams of changes: into a table by micro-batch, and to the latest version of every key."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.plans import scratch
from tidemark.table import Table


def into_table(changes: DataFrame, table: Table, checkpoint: str, order: str = "seq", name: str = "ingest", available_now: bool = True) -> StreamingQuery:
    """Write a stream of key, value (and op) rows to a table, each micro-batch as one commit.

    The commit is named after the batch, so one that is repeated after a failure counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)  # it is read twice, and may be costly to work out
        try:
            # The smallest number of the batch becomes 0: the table numbers on from its last change.
            first = batch.agg(F.min(order)).first()[0]
            if first is not None:
                columns = [c for c in ("key", "value", "op") if c in batch.columns]
                table.put_batch(batch.select(*columns, (F.col(order) - first).alias("place")), "place", f"{name}-{number}")
        finally:
            batch.unpersist()

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(changes: DataFrame, key: str = "k", order: str = "seq", value: str = "v") -> DataFrame:
    """The newest version of every key as a streaming aggregate (update mode); late, older changes alter nothing."""
    return changes.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def live_changes(changes: DataFrame) -> DataFrame:
    """For each key and micro-batch with a newer version: k, v, seq and whether the key is live after it.

    The state is the newest version of a key and the time of the batch that brought it, by
    which keys are left out that a batch gave only changes with no higher number.
    """
    now = F.unix_micros(F.current_timestamp())  # the batch's own, also when it is repeated
    rows = changes.select("k", "seq", (-now).alias("at"), "v")
    newest = rows.groupBy("k").agg(F.max(F.struct("seq", "at", "v")).alias("n"))  # of equal numbers the first batch's
    return newest.where(F.col("n.at") == -now).select("k", F.col("n.v").alias("v"), F.col("n.seq").alias("seq"), (~F.col("n.v").eqNullSafe("")).alias("live"))


def drained(stream: DataFrame, mode: str = "update") -> DataFrame:
    """All that a stream gives until its input is read, with the number of the micro-batch.

    A batch is written as a folder of its own, so that one that is repeated counts once.
    States are dealt to no more than two partitions a core, as each costs files in every
    batch.
    """
    spark = stream.sparkSession
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    folder = scratch.new_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(min(int(partitions), 2 * spark.sparkContext.defaultParallelism)))
        query = writer.trigger(availableNow=True).start()  # takes the settings of this moment
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    query.awaitTermination()
    out = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(out).parquet(f"{folder}/out")


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their total value by tumbling window and type, for a batch or a stream.

    Times without a zone are those of the session's.
    """
    kind = events.schema["ts"].dataType
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "total")
