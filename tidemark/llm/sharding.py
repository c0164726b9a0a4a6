"""Weighted rendezvous hashing of stable record keys over shards.

Every (key, shard) pair gets a number u in (0, 1) from md5; the shard with the
largest weight / -ln(u) takes the record. A key's shard depends on the key and
the shards' names and weights alone, so a new shard takes rows only into itself
and a removed one gives away only its own. Built from DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import drop, fresh, materialize

#: Digits of the digest that make up u: 13 hexadecimal digits are 52 bits, exact in a double.
HEX_DIGITS = 13
#: Slots of equal rows that are written out at once.
SPREAD = 1 << 16


def rendezvous_score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The record's preference for a shard; a null key counts as the text 'null'."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)
    return F.lit(-float(weight)) / F.log(u)


def assign_shard(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Add the shard of every row (0 to len(weights) - 1), and in `grown` its shard with one more.

    Nulls in other columns and further columns pass through; an empty table gives none.
    Ties of scores go to the smaller shard. A column that has the name of `out` or
    `grown` is replaced.
    """
    best = F.array_max(F.array(*[F.struct(rendezvous_score(F.col(key), i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]))
    # The key is read before `out` and `grown`, of which one may have its name.
    top, more = fresh([*df.columns, out, grown or ""], "_best", "_more")
    df = df.withColumns({top: best, more: rendezvous_score(F.col(key), len(weights), grown_weight) if grown else F.lit(None)})
    df = df.withColumn(out, -F.col(f"{top}.i"))
    if grown:
        df = df.withColumn(grown, F.when(F.col(more) > F.col(f"{top}.s"), F.lit(len(weights))).otherwise(-F.col(f"{top}.i")))
    return df.drop(top, more)


def number_slots(df: DataFrame, shard: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0, in the order of `order`, without gaps.

    Only `shard` and `order` columns are kept, and equal rows are alike, so they are
    counted first and numbered together: a key that repeats without bound stays one
    row up to the last step. The rows are dealt by range, each range counts its rows
    by shard, and a prefix sum over those few counts gives where each range begins.
    """
    keys = [shard, *[c for c in order if c != shard]]
    n, part, at, start, chunk = fresh([*keys, out], "_n", "_part", "_at", "_start", "_chunk")
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    ranged = counted.repartitionByRange(*keys).withColumn(part, F.spark_partition_id())
    ranged = materialize(ranged, "slots")
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(shard, part).agg(F.sum(n).alias(n)).select(F.col(shard).alias(chunk), part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(part, shard).orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn(at, F.coalesce(F.sum(n).over(within), F.lit(0)))
    placed = placed.join(starts.withColumnRenamed(part, part + "_"), placed[shard].eqNullSafe(F.col(chunk)) & (F.col(part) == F.col(part + "_")))
    placed = materialize(placed.select(*keys, n, (F.col(at) + F.col(start)).alias(at)), "placed")
    drop(ranged)
    few = placed.where(F.col(n) <= SPREAD).select(*keys, F.explode(F.sequence(F.col(at), F.col(at) + F.col(n) - 1)).alias(out))
    # A row that repeats without bound is written out by many tasks, SPREAD slots at a time.
    many = placed.where(F.col(n) > SPREAD).withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(SPREAD).cast("long")))).repartition(*keys, chunk)
    last = F.least(F.col(n), F.col(chunk) + SPREAD) - 1
    return few.unionByName(many.select(*keys, F.explode(F.sequence(F.col(at) + F.col(chunk), F.col(at) + last)).alias(out)))
