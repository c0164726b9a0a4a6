"""When levels of runs are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema


def budget(level: int, l1_bytes: int = schema.L1_BYTES, ratio: int = schema.LEVEL_RATIO) -> int:
    """Bytes that a level from 1 on may hold."""
    return l1_bytes * ratio ** (level - 1)


def due(levels: DataFrame, l0_runs: int = schema.L0_RUNS, l1_bytes: int = schema.L1_BYTES, ratio: int = schema.LEVEL_RATIO, last: int = schema.LEVELS - 2) -> DataFrame:
    """Add to (level, runs, bytes) whether the level is over its limit; the last level never is."""
    limit = F.lit(l1_bytes) * F.pow(F.lit(float(ratio)), F.col("level") - 1)
    over = F.when(F.col("level") == 0, F.col("runs") >= l0_runs).when(F.col("level") <= last, F.col("bytes") > limit).otherwise(False)
    return levels.withColumn("due", over)


def next_level(runs: list[dict], after: int = -1, l0_runs: int = schema.L0_RUNS, l1_bytes: int = schema.L1_BYTES, ratio: int = schema.LEVEL_RATIO) -> int | None:
    """The level to merge next when `after` was merged last; None to stop.

    Levels are gone through upward, and the first one that is in its budget ends it.
    """
    level = after + 1
    if level > schema.LEVELS - 2:
        return None
    held = [r for r in runs if r["level"] == level]
    if level == 0:
        return 0 if len(held) >= l0_runs else None
    return level if held and sum(r["bytes"] for r in held) > budget(level, l1_bytes, ratio) else None
