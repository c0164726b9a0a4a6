"""The manifest: a log of added and removed runs, as a relation and as committed files."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.sources import files


def live(edits: DataFrame) -> DataFrame:
    """The runs of each level after replay, searched in order of `search_rank`, the newest first.

    The last edit of a run decides; edits with an unknown tag are passed over.
    """
    last = edits.where(F.col("tag").isin(schema.ADD, schema.REMOVE)).groupBy("level", "run_id").agg(F.max_by("tag", "edit_no").alias("tag"))
    return last.where(F.col("tag") == schema.ADD).select("level", "run_id")


def merge_edits(runs: DataFrame, level: int, run_id: int) -> DataFrame:
    """What a merge of all runs (level, run_id) of a level commits at once: tag, level and run_id.

    The run that it makes is added to the next level, and each of its inputs removed; a
    level without runs gives no edits.
    """
    inputs = runs.where(F.col("level") == level)
    made = inputs.limit(1).select(F.lit(schema.ADD).alias("tag"), F.lit(level + 1).alias("level"), F.lit(run_id).cast("long").alias("run_id"))
    return made.unionByName(inputs.select(F.lit(schema.REMOVE).alias("tag"), "level", F.col("run_id").cast("long").alias("run_id")))


def encode(edits: DataFrame) -> DataFrame:
    """Each edit as 13 bytes: tag, level (32 bit) and run (64 bit), little-endian."""
    from tidemark.functions.encoding import little_endian

    return edits.select("edit_no", F.concat(little_endian(F.col("tag"), 1), little_endian(F.col("level"), 4), little_endian(F.col("run_id"), 8)).alias("data"))


def decode(rows: DataFrame) -> DataFrame:
    """Edits from encode()'s bytes; short data and unknown tags are left out."""
    from tidemark.functions.encoding import from_little_endian

    data = F.col("data")
    whole = rows.where(F.octet_length(data) >= 13)
    edits = whole.select("edit_no", from_little_endian(data, 1, 1).cast("byte").alias("tag"), from_little_endian(data, 2, 4).cast("int").alias("level"), from_little_endian(data, 6, 8).alias("run_id"))
    return edits.where(F.col("tag").isin(schema.ADD, schema.REMOVE))


@dataclass
class State:
    """What a table consists of at one commit."""

    version: int = 0
    epoch: int = 0
    next_seq: int = 1
    next_run: int = 1
    next_log: int = 1
    #: Unflushed batches by name, with their payload bytes.
    logs: dict[str, int] = field(default_factory=dict)
    runs: list[dict] = field(default_factory=list)
    #: The newest batch number of each stream.
    batches: dict[str, int] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def read(spark: SparkSession, root: str) -> State:
    """The newest committed state; that of an empty table if there is none."""
    names = versions(spark, root)
    if not names:
        return State()
    return State(**json.loads(files.read_text(spark, f"{root}/_manifest/{names[-1]}")))


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the committed manifest files, the newest last."""
    return sorted(n for n in files.names(spark, f"{root}/_manifest") if n.endswith(".json"))


def commit(spark: SparkSession, root: str, state: State) -> State:
    """Publish a state as the next version, all of its changes at once.

    The file is created only if no one else has; it is written under another name and
    renamed, so a reader sees all of it or nothing.
    """
    state.version += 1
    path = f"{root}/_manifest/{state.version:012d}.json"
    if not files.create_text(spark, path, json.dumps(state.__dict__)):
        raise Conflict(f"version {state.version} has been committed by another writer")
    return state
