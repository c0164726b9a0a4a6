"""A persistent, versioned key-value table: batches go to a log, are flushed to sorted runs and merged by level.

    root/log/log_no=N-MARK/         changes not yet flushed, one folder a batch
    root/runs/level=L/run_id=R-MARK/ Parquet sorted by key, one version of each key
    root/_manifest/NNNNNNNNNNNN.json  one file a commit; the newest says what is live

Data is written first and published by one manifest file, so a crash leaves files that
no one reads (vacuum() deletes them) and never half a change. Any number of handles may
write: of two that commit the same version one gets Conflict. Every read of a handle
begins with the newest commit, whoever made it.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import runs as run_operators
from tidemark.plans import manifest, policy
from tidemark.sources import files


def _bytes(value: bytes | str) -> bytes:
    return value.encode() if isinstance(value, str) else bytes(value)


class Table:
    """The table of a folder; opening reads the manifest, and its log is replayed by every read.

    With `sync` every put is a commit. Without it, puts and removes of single rows are held
    by the handle, whose own reads see them, until sync_log(), a flush, a batch or
    SYNC_BYTES of them; a driver that dies loses those. With `background` a full buffer
    is frozen and flushed by a thread while writes go on; a write that fills the next
    buffer before that ends waits for it.
    """

    SYNC_BYTES = 1 << 20

    def __init__(self, spark: SparkSession, root: str, buffer_bytes: int = schema.BUFFER_BYTES, l0_runs: int = schema.L0_RUNS, l1_bytes: int = schema.L1_BYTES, ratio: int = schema.LEVEL_RATIO, bloom: bool = True, sync: bool = True, background: bool = False) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.buffer_bytes, self.l0_runs, self.l1_bytes, self.ratio, self.bloom = buffer_bytes, l0_runs, l1_bytes, ratio, bloom
        self.sync, self.background = sync, background
        self.mark = uuid.uuid4().hex[:12]
        self.held: list[tuple[int, bytes, bytes]] = []
        self.stalls = 0
        self._lock = threading.RLock()
        self._flusher: threading.Thread | None = None
        self._failed: BaseException | None = None
        self.state = manifest.read(spark, self.root)

    def refresh(self) -> None:
        """Take up what other handles have committed."""
        with self._lock:
            self.state = manifest.read(self.spark, self.root)

    # Paths

    # Names hold a writer's own mark: what a writer that loses a commit has written is never another's.

    def _log(self, name: str) -> str:
        return f"{self.root}/log/log_no={name}"

    def _run(self, run: dict) -> str:
        return f"{self.root}/runs/level={run['level']}/run_id={run['run_id']}-{run['mark']}"

    # Writes

    def put(self, key: bytes | str, value: bytes | str) -> None:
        """Insert or replace one row; the empty value deletes."""
        self.write([(schema.PUT, key, value)])

    update = put

    def remove(self, key: bytes | str) -> None:
        """Delete one row by a tombstone, whether it exists or not."""
        self.write([(schema.DELETE, key, b"")])

    def write(self, changes: Iterable[tuple[int, bytes | str, bytes | str]]) -> None:
        """A few changes from the driver, in their order."""
        rows = [(op, _bytes(k), _bytes(v) if op == schema.PUT else b"") for op, k, v in changes]
        if any(len(k) > schema.MAX_KEY_BYTES for _, k, _ in rows):
            raise ValueError(f"a key is longer than {schema.MAX_KEY_BYTES} bytes")
        self.held += rows
        if self.sync or sum(len(k) + len(v) for _, k, v in self.held) >= self.SYNC_BYTES:
            self.sync_log()

    def sync_log(self) -> None:
        """Commit the changes that the handle holds; none are lost by a commit that fails."""
        if self.held:
            rows, self.held = self.held, []
            try:
                self._append(self._held_rows(rows).coalesce(1), "seq", None)
            except BaseException:
                self.held = [] if self.sync else rows + self.held
                raise

    def _held_rows(self, rows: list[tuple[int, bytes, bytes]]) -> DataFrame:
        return self.spark.createDataFrame([(op, i, bytearray(k), bytearray(v)) for i, (op, k, v) in enumerate(rows)], schema.CHANGELOG)

    def put_batch(self, rows: DataFrame, order: str, batch_id: str | None = None) -> None:
        """Append rows (key, value and perhaps op) as one commit, numbered in the order of `order`.

        `order` must say which of two rows with equal keys is newer: a number, unique in
        the batch, that is added to the table's next sequence number. A batch id is the
        name of a stream, a hyphen and a number that rises (or a name alone, for one batch); a
        batch whose number the stream has reached already is left out, so it may be repeated.
        """
        self.sync_log()
        self._append(rows, order, batch_id)

    def _append(self, rows: DataFrame, order: str, batch_id: str | None) -> None:
        stream, _, number = (batch_id or "").rpartition("-")
        stream, number = (stream, int(number)) if stream and number.isdigit() else (batch_id, 0)
        if batch_id is not None and number <= self.state.batches.get(stream, -1):
            return
        op = F.col("op") if "op" in rows.columns else F.lit(schema.PUT)
        key, value = F.col("key").cast("binary"), F.coalesce(F.col("value").cast("binary"), F.lit(b""))
        too_long = F.raise_error(F.lit(f"a key is null or longer than {schema.MAX_KEY_BYTES} bytes"))
        key = F.when(F.coalesce(F.octet_length(key) > schema.MAX_KEY_BYTES, F.lit(True)), too_long.cast("binary")).otherwise(key)
        value = F.when(op == schema.DELETE, F.lit(b"")).otherwise(value)
        first = self.state.next_seq
        log = rows.select(op.cast("byte").alias("op"), (F.col(order).cast("long") + first).alias("seq"), key.alias("key"), value.alias("value"))
        name = f"{self.state.next_log}-{self.mark}"
        log.write.mode("overwrite").parquet(self._log(name))
        written = self.spark.read.schema(schema.CHANGELOG).parquet(self._log(name))
        low, high, size = written.agg(F.min("seq"), F.max("seq"), F.sum(F.octet_length("key") + F.octet_length("value"))).first()
        if low is None:
            return
        if low < first:
            raise ValueError("the order of a batch must not be negative")
        with self._lock:
            if self.state.next_seq != first:
                raise manifest.Conflict("another writer has numbered changes from the same one on")
            self.state.logs[name] = size
            self.state.next_log, self.state.next_seq = self.state.next_log + 1, high + 1
            if batch_id is not None:
                self.state.batches[stream] = number
            self._commit()
            due = sum(self.state.logs.values()) >= self.buffer_bytes
        if due and self.background:
            self._freeze()
        elif due:
            self.flush()
            self.compact()

    def _freeze(self) -> None:
        """Flush the buffer of this moment in a thread; waits for the one before."""
        if self._flusher and self._flusher.is_alive():
            self.stalls += 1
        self.wait()

        def work() -> None:
            try:
                self._flush_logs()
                self.compact()
            except BaseException as e:  # raised again by whoever waits
                self._failed = e

        self._flusher = threading.Thread(target=work, name="tidemark-flush")
        self._flusher.start()

    def wait(self) -> None:
        """Wait for a flush in the background; an error of it is raised here."""
        if self._flusher:
            self._flusher.join()
            self._flusher = None
        if self._failed:
            failed, self._failed = self._failed, None
            raise failed

    def _commit(self) -> None:
        with self._lock:
            try:
                manifest.commit(self.spark, self.root, self.state)
            except BaseException:
                self.state = manifest.read(self.spark, self.root)
                raise

    def log(self) -> DataFrame:
        """The changes that haven't been flushed, with those that the handle holds."""
        names = list(self.state.logs)
        if not names:
            rows = self.spark.createDataFrame([], schema.CHANGELOG)
        else:
            rows = self.spark.read.schema(schema.CHANGELOG).parquet(*map(self._log, names))
        if self.held:
            rows = rows.unionByName(self._held_rows(self.held).withColumn("seq", F.col("seq") + self.state.next_seq))
        return rows

    def _write_run(self, rows: DataFrame, level: int) -> dict | None:
        with self._lock:
            run = {"level": level, "run_id": self.state.next_run, "mark": self.mark}
            self.state.next_run += 1  # a run that comes to nothing leaves a gap
        path = self._run(run)
        writer = run_operators.sorted_run(rows.select("key", "value"), "key").write.mode("overwrite")
        if self.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
        writer.parquet(path)
        stats = self.spark.read.schema(schema.ENTRY).parquet(path).agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
        if not stats[0]:
            files.delete(self.spark, path)
            return None
        return run | {"n": stats[0], "low": bytes(stats[1]).hex(), "high": bytes(stats[2]).hex(), "bytes": files.size(self.spark, path)}

    def flush(self) -> None:
        """Write the log's newest versions as a run of level 0 and drop those batches from the log."""
        self.sync_log()
        self.wait()
        self._flush_logs()

    def _flush_logs(self) -> None:
        done = list(self.state.logs)
        if not done:
            return
        rows = self.spark.read.schema(schema.CHANGELOG).parquet(*map(self._log, done))
        run = self._write_run(rows.groupBy("key").agg(F.max_by("value", "seq").alias("value")), 0)
        with self._lock:
            for name in done:
                self.state.logs.pop(name, None)
            if run:
                self.state.runs.append(run)
                self.state.next_run = max(self.state.next_run, run["run_id"] + 1)
            self._commit()
        for name in done:
            files.delete(self.spark, self._log(name))

    def compact(self) -> None:
        """Merge levels that are over their limit into the next one, upward."""
        level = policy.next_level(self.state.runs, -1, self.l0_runs, self.l1_bytes, self.ratio)
        while level is not None:
            self.merge_level(level)
            level = policy.next_level(self.state.runs, level, self.l0_runs, self.l1_bytes, self.ratio)

    def merge_level(self, level: int, drop_tombstones: bool = False) -> None:
        """Merge all runs of a level to one run of the next, in one commit.

        Tombstones are dropped only if asked to, and if no older run is left beneath.
        """
        if threading.current_thread() is not self._flusher:
            self.wait()
        inputs = [r for r in self.state.runs if r["level"] == level]
        if not inputs:
            return
        older = [r for r in self.state.runs if r["level"] > level]
        rows = self._versions(inputs).groupBy("key").agg(F.max_by("value", F.struct(-F.col("level"), "run_id")).alias("value"))
        if drop_tombstones and not older:
            rows = rows.where(F.octet_length("value") > 0)
        run = self._write_run(rows, level + 1)
        gone = {r["run_id"] for r in inputs}
        with self._lock:
            self.state.runs = [r for r in self.state.runs if r["run_id"] not in gone] + ([run] if run else [])
            self.state.next_run = max([self.state.next_run, *[r["run_id"] + 1 for r in self.state.runs]])
            self._commit()
        for r in inputs:
            files.delete(self.spark, self._run(r))

    def clear(self) -> None:
        """Remove everything; sequence numbers and ids go on, so no later file has an old name."""
        self.held = []
        self.wait()
        with self._lock:
            logs, runs = list(self.state.logs), list(self.state.runs)
            self.state.logs, self.state.runs = {}, []
            self.state.epoch += 1
            self._commit()
        for path in [*map(self._log, logs), *map(self._run, runs)]:
            files.delete(self.spark, path)

    def vacuum(self, older_than: float = 3600.0) -> list[str]:
        """Delete data that the newest commit doesn't name, and old manifests; readers of older states may lose it.

        What has changed within `older_than` seconds stays: a writer may be about to commit
        it. No write may take longer than that.
        """
        # The age is taken before the manifest is read: what is committed in between is named by it.
        now = files.clock(self.spark, self.root) if files.names(self.spark, self.root) else 0
        found = [f"{self.root}/log/{n}" for n in files.names(self.spark, f"{self.root}/log")]
        for level in files.names(self.spark, f"{self.root}/runs"):
            found += [f"{self.root}/runs/{level}/{n}" for n in files.names(self.spark, f"{self.root}/runs/{level}")]
        found = [p for p in found if "=" in p.rpartition("/")[2] and files.age(self.spark, p, now) >= older_than]
        self.refresh()
        live = {self._log(n) for n in self.state.logs} | {self._run(r) for r in self.state.runs}
        gone = [p for p in found if p not in live]
        newest = (manifest.versions(self.spark, self.root) or [""])[-1]
        left = [f"{self.root}/_manifest/{n}" for n in files.names(self.spark, f"{self.root}/_manifest") if n < newest or n.endswith(".part")]
        for path in gone + [p for p in left if files.age(self.spark, p, now) >= older_than]:
            files.delete(self.spark, path)
        return gone

    # Reads

    def _versions(self, runs: list[dict]) -> DataFrame:
        """Runs' rows with where they come from; a missing file is an error."""
        if not runs:
            return self.spark.createDataFrame([], schema.RUN)
        parts = [self.spark.read.schema(schema.ENTRY).parquet(self._run(r)).select(F.lit(r["level"]).alias("level"), F.lit(r["run_id"]).cast("long").alias("run_id"), "key", "value") for r in runs]
        return reduce(DataFrame.unionByName, parts)

    def versions(self, key: bytes | None = None) -> DataFrame:
        """All versions: key, value, level (-1 in the log) and rank, in which a newer one is larger.

        With a key only runs whose range holds it are read.
        """
        self.refresh()
        runs = [r for r in self.state.runs if key is None or bytes.fromhex(r["low"]) <= key <= bytes.fromhex(r["high"])]
        log = self.log().select(F.lit(-1).alias("level"), F.col("seq").alias("run_id"), "key", "value")
        return log.unionByName(self._versions(runs)).select("key", "value", "level", F.col("run_id").alias("rank"))

    def snapshot(self) -> DataFrame:
        """Every live key with its newest value; the files are those of this moment."""
        newest = self.versions().groupBy("key").agg(F.max_by("value", F.struct(-F.col("level"), "rank")).alias("value"))
        return newest.where(F.octet_length("value") > 0)

    def get(self, key: bytes | str) -> bytes | None:
        key = _bytes(key)
        rows = self.versions(key).where(F.col("key") == F.lit(bytearray(key)))
        found = rows.orderBy("level", F.desc("rank")).limit(1).first()
        return bytes(found["value"]) if found and found["value"] else None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Each key of a table with its value, null where it has none."""
        asked = keys.select(F.col("key").cast("binary").alias("key")).distinct()
        hits = self.versions().join(asked, "key", "left_semi").groupBy("key").agg(F.max_by("value", F.struct(-F.col("level"), "rank")).alias("value"))
        return asked.join(hits.where(F.octet_length("value") > 0), "key", "left")

    def scan(self, low: bytes | str = b"", high: bytes | str | None = None) -> DataFrame:
        """Live rows from low (included) to high (excluded), in key order."""
        rows = self.snapshot().where(F.col("key") >= F.lit(bytearray(_bytes(low))))
        if high is not None:
            rows = rows.where(F.col("key") < F.lit(bytearray(_bytes(high))))
        return rows.orderBy("key")

    def levels(self) -> DataFrame:
        """Runs and bytes of each level that has any, and whether it is due to be merged."""
        self.refresh()
        rows = [(r["level"], 1, r["bytes"]) for r in self.state.runs]
        frame = self.spark.createDataFrame(rows, "level int, runs int, bytes long").groupBy("level").agg(F.sum("runs").alias("runs"), F.sum("bytes").alias("bytes"))
        return policy.due(frame, self.l0_runs, self.l1_bytes, self.ratio)
