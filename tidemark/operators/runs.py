"""Sorted runs: cutting a log into runs, merging runs, and what they cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import scratch

#: Sequence numbers in a bucket of the running totals, and buckets in a bucket of buckets.
BUCKET = 1 << 16


def running_total(rows: DataFrame, order: str, amount: Column, out: str = "before") -> DataFrame:
    """Add the sum of `amount` over all rows with a smaller `order`, a dense unique number.

    Totals of buckets, then of buckets of buckets, give where each begins; only within
    a bucket are rows sorted and joined, so no task need see more than BUCKET of them.
    """
    rows = rows.withColumn("_amount", amount).withColumn("_b", F.floor(F.col(order) / BUCKET)).withColumn("_bb", F.floor(F.col("_b") / BUCKET))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    small = rows.groupBy("_bb", "_b").agg(F.sum("_amount").alias("_sum"))
    large = small.groupBy("_bb").agg(F.sum("_sum").alias("_sum"))
    large = large.select("_bb", F.coalesce(F.sum("_sum").over(before(F.lit(0)).orderBy("_bb")), F.lit(0)).alias("_far"))
    small = small.select("_bb", "_b", F.coalesce(F.sum("_sum").over(before("_bb").orderBy("_b")), F.lit(0)).alias("_near"))
    rows = rows.withColumn("_own", F.coalesce(F.sum("_amount").over(before("_bb", "_b").orderBy(order)), F.lit(0)))
    # Beginnings are put together first: a join of the rows by _bb would be one task's.
    rows = rows.join(small.join(large, "_bb"), ["_bb", "_b"])
    return rows.withColumn(out, F.col("_far") + F.col("_near") + F.col("_own")).drop("_amount", "_b", "_bb", "_far", "_near", "_own")


def running_last(rows: DataFrame, by: list[str], order: str, value: Column, out: str = "last") -> DataFrame:
    """Add the newest `value` that isn't null of each group, up to and with the row.

    Only within a bucket of `order` are a group's rows sorted; what a bucket ends with is
    carried on from bucket to bucket, so a busy group is no single task's.
    """
    rows = rows.withColumn("_value", value).withColumn("_b", F.floor(F.col(order) / BUCKET))
    within = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*by, "_b").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    same = F.lit(True)
    for c in [*by, "_b"]:
        ends = ends.withColumnRenamed(c, "_e" + c)
        same = same & F.col(c).eqNullSafe(F.col("_e" + c))
    found = rows.withColumn("_own", F.last("_value", ignorenulls=True).over(within)).join(ends, same)
    return found.withColumn(out, F.coalesce("_own", "_carried")).drop("_value", "_b", "_own", "_carried", *["_e" + c for c in [*by, "_b"]])


def prefix_sums(rows: DataFrame, by: list[str], order: list[str], amount: Column, out: str = "before") -> DataFrame:
    """Add the sum of `amount` over the rows of the group that come before in `order`, which must be unique in it.

    The rows are dealt by range of group and order and written, as the ranges are drawn
    from a sample; each range sums up its rows, and the sums of ranges, a few for each
    group, say where each begins. No task sorts a whole group.
    """
    ranged = rows.withColumn("_amount", amount).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    ranged = scratch.materialize(ranged, "ranges")
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "_part").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_begin"))
    found = ranged.withColumn("_own", F.coalesce(F.sum("_amount").over(within), F.lit(0))).join(sums, [*by, "_part"])
    return found.withColumn(out, F.col("_begin") + F.col("_own")).drop("_amount", "_part", "_begin", "_own")


def assign_runs(log: DataFrame, capacity: int) -> DataFrame:
    """Add run_id: the flush that each change falls in when a buffer of so many bytes fills up."""
    size = F.length("k") + F.length("v")
    return running_total(log, "seq", size.cast("long")).withColumn("run_id", F.floor(F.col("before") / capacity)).drop("before")


def flush(log: DataFrame) -> DataFrame:
    """One version of every key in each run, the newest."""
    return log.groupBy("run_id", "k").agg(F.max_by("v", "seq").alias("v"), F.max("seq").alias("seq"))


def merge(inputs: list[DataFrame], key: str, value: str, recency: list[str]) -> DataFrame:
    """One run from several, given with the columns that rank versions, the newest being largest.

    Tombstones stay, since older runs may still hold their keys.
    """
    rows = reduce(DataFrame.unionByName, inputs)
    newest = F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*recency))
    return rows.groupBy(key).agg(newest.alias("_n")).select(key, "_n.*")


def sorted_run(rows: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Rows in key order over all partitions, sorted within each, as a run is stored."""
    ranged = rows.repartitionByRange(partitions, key) if partitions else rows.repartitionByRange(key)
    return ranged.sortWithinPartitions(key)


def gathered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """Rows with all those of one `by` in one partition, sorted by it and then in `order`.

    They are dealt by a hash of `by`. An exchange by the column itself is left out where a
    join has dealt the rows so, and that join may deal them otherwise when it runs: as a
    broadcast join, or split for skew.
    """
    return rows.repartition(F.xxhash64(by)).sortWithinPartitions(by, *order)


def statistics(runs: DataFrame) -> DataFrame:
    """Entries, key range, tombstones and payload of every run."""
    return runs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("k").alias("lo"),
        F.max("k").alias("hi"),
        F.sum(F.when(F.length("v") == 0, 1).otherwise(0)).alias("tombstones"),
        F.sum(F.length("k") + F.length("v")).cast("long").alias("bytes"),
    )


def overlaps(stats: DataFrame) -> DataFrame:
    """How many other runs each run's key range meets: run_id and overlaps; `stats` has one row a run.

    A sweep over the sorted bounds: all runs but those that end before it begins and those
    that begin after it ends. Only counts are made, as pairs may be as many as runs squared.
    """
    bounds = stats.select("run_id", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("end")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("end")))).alias("b"))
    bounds = bounds.select(F.lit(0).alias("all"), "run_id", "b.at", "b.end")
    # At equal keys ranges begin before others end, as they meet.
    order = ["at", "end", "run_id"]
    ended = prefix_sums(bounds, ["all"], order, F.col("end"), "ended").where("end = 0").select("run_id", "ended")
    begun = prefix_sums(bounds, ["all"], order, 1 - F.col("end"), "begun").where("end = 1").select("run_id", "begun")
    return ended.join(begun, "run_id").select("run_id", (F.col("begun") - F.col("ended") - 1).alias("overlaps"))


def amplification(log: DataFrame, runs: DataFrame) -> DataFrame:
    """How many entries were written, flushed, kept by a full merge, and are live."""
    merged = runs.groupBy("k").agg(F.max_by("v", "seq").alias("v"))
    count = F.count(F.lit(1))
    return (
        log.agg(count.alias("writes"))
        .crossJoin(runs.agg(count.alias("flushed")))
        .crossJoin(merged.agg(count.alias("retained"), F.count(F.when(F.length("v") > 0, 1)).alias("live")))
    )
