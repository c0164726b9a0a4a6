"""Change-logs: (seq, k, op, v) rows, of which the highest seq of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_events(events: DataFrame) -> DataFrame:
    """The canonical change-log of the events table.

    An error event deletes; a view of small value puts the empty value, which deletes too.
    """
    key = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 5, "0"), F.lit(":"), F.regexp_replace("props", "[^0-9]", ""))
    gone = (F.col("event_type") == "error") | ((F.col("event_type") == "view") & (F.col("value") < 5))
    return events.select(
        (F.col("event_id") + 1).alias("seq"),
        key.alias("k"),
        F.when(F.col("event_type") == "error", "D").otherwise("P").alias("op"),
        F.when(gone, "").otherwise(F.concat("event_type", F.lit("|"), "props")).alias("v"),
    )


def latest(log: DataFrame, key: str = "k", order: str = "seq", value: str = "v") -> DataFrame:
    """The newest version of every key, tombstones included.

    max_by aggregates before the shuffle, so a hot key stays one row a task.
    """
    return log.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def live(versions: DataFrame, value: str = "v") -> DataFrame:
    """Without tombstones; only for versions that have been resolved, or deleted keys come back."""
    return versions.where(F.length(value) > 0)


def snapshot(log: DataFrame) -> DataFrame:
    """Every live key with its newest value."""
    return live(latest(log)).select("k", "v", "seq")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The snapshot that a reader had when `seq` was the newest change."""
    return snapshot(log.where(F.col("seq") <= seq))


def replay(log: DataFrame, after: int) -> DataFrame:
    """Changes newer than `after`, in the order in which they are applied again."""
    return log.where(F.col("seq") > after).orderBy("seq")


def valid_prefix(log: DataFrame, valid: str = "valid") -> DataFrame:
    """What recovery keeps: the changes before the first one that isn't valid."""
    first = log.where(~F.col(valid)).agg(F.min("seq").alias("_bad"))
    return log.join(F.broadcast(first), F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))).drop("_bad")  # one row
