"""Framed binary log files: records in chunks with checksums, in blocks of 32 KiB.

No chunk header crosses a block: less than a header's room at a block's end is zeros. A
record that doesn't fit goes on in further chunks (first, middle, last), with an empty
first chunk where exactly a header fits.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators.runs import gathered
from tidemark.plans import scratch
from tidemark.sources import files
from tidemark.sources.outputs import Output


def serialize(op: int, seq: int, key: bytes, value: bytes) -> bytes:
    if len(key) > schema.MAX_KEY_BYTES:
        raise ValueError(f"a key of {len(key)} bytes is longer than {schema.MAX_KEY_BYTES}")
    return bytes([op]) + seq.to_bytes(8, "little") + len(key).to_bytes(2, "little") + key + len(value).to_bytes(4, "little") + value


def parse(data: bytes) -> tuple[int, int, bytes, bytes] | None:
    if len(data) < 15 or data[0] not in (schema.PUT, schema.DELETE):
        return None
    at = 11 + int.from_bytes(data[9:11], "little")
    if len(data) < at + 4:
        return None
    end = at + 4 + int.from_bytes(data[at : at + 4], "little")
    return (data[0], int.from_bytes(data[1:9], "little"), data[11:at], data[at + 4 : end]) if len(data) >= end else None


def chunks(records: Iterable[bytes], offset: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """Offset, type and payload of the chunks of records that follow `offset` bytes of a file."""
    for record in records:
        begin, kinds = 0, (schema.FULL, schema.FIRST)
        while begin < len(record):
            left = -offset % schema.LOG_BLOCK_BYTES or schema.LOG_BLOCK_BYTES
            offset += left if left < schema.LOG_HEADER_BYTES else 0
            room = (left if left >= schema.LOG_HEADER_BYTES else schema.LOG_BLOCK_BYTES) - schema.LOG_HEADER_BYTES
            payload = record[begin : begin + room]
            begin += len(payload)
            yield offset, kinds[begin < len(record)], payload
            offset += schema.LOG_HEADER_BYTES + len(payload)
            kinds = (schema.LAST, schema.MIDDLE)


def frame(records: Iterable[bytes], offset: int = 0) -> bytes:
    """The bytes that records add to a file of `offset` bytes."""
    out = bytearray()
    for at, kind, payload in chunks(records, offset):
        out += bytes(at - offset - len(out))
        out += zlib.crc32(bytes([kind]) + payload).to_bytes(4, "little") + len(payload).to_bytes(2, "little") + bytes([kind]) + payload
    return bytes(out)


def recover(data: bytes) -> Iterator[bytes]:
    """The records of a file up to the first chunk that is cut off, damaged or out of order."""
    at, held = 0, None
    while True:
        room = schema.LOG_BLOCK_BYTES - at % schema.LOG_BLOCK_BYTES
        if room < schema.LOG_HEADER_BYTES:
            at += room
        head = data[at : at + schema.LOG_HEADER_BYTES]
        if len(head) < schema.LOG_HEADER_BYTES:
            return
        crc, size, kind = int.from_bytes(head[:4], "little"), int.from_bytes(head[4:6], "little"), head[6]
        payload = data[at + schema.LOG_HEADER_BYTES : at + schema.LOG_HEADER_BYTES + size]
        if len(payload) < size or zlib.crc32(bytes([kind]) + payload) != crc:
            return
        at += schema.LOG_HEADER_BYTES + size
        if kind == schema.FULL and held is None:
            yield payload
        elif kind == schema.FIRST and held is None:
            held = payload
        elif kind in (schema.MIDDLE, schema.LAST) and held is not None:
            held += payload
            if kind == schema.LAST:
                yield held
                held = None
        else:
            return


def framed(log: DataFrame, group: str = "log_no") -> DataFrame:
    """The chunks of each log's records in order of seq: log_no, chunk_no, offset, chunk_type, length, crc, payload.

    Where a chunk begins depends on all before it in its file, so one task frames a file;
    files are rotated by size, which bounds it.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        records = (serialize(int(o), int(s), bytes(k), bytes(v)) for o, s, k, v in zip(rows["op"], rows["seq"], rows["key"], rows["value"]))
        found = [(key[0], i, at, kind, len(payload), zlib.crc32(bytes([kind]) + payload), payload) for i, (at, kind, payload) in enumerate(chunks(records))]
        return pd.DataFrame(found, columns=["log_no", "chunk_no", "offset", "chunk_type", "length", "crc", "payload"])

    return log.groupBy(group).applyInPandas(run, "log_no int, chunk_no long, offset long, chunk_type byte, length int, crc long, payload binary")


def write(log: DataFrame, folder: str) -> DataFrame:
    """Write each log (log_no, op, seq, key, value) as the framed file NNNNN.log; gives log_no, records and bytes.

    A task takes the records of a file in order of seq and frames them as they come, a
    batch in memory; files are rotated by size, which bounds what a task writes.
    """
    folder = files.qualified(log.sparkSession, folder)
    ordered = gathered(log.select("log_no", "op", "seq", "key", "value"), "log_no", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((int(n), serialize(int(o), int(s), bytes(k), bytes(v))) for b in batches for n, o, s, k, v in zip(b["log_no"], b["op"], b["seq"], b["key"], b["value"]))
        for number, group in itertools.groupby(rows, key=lambda r: r[0]):
            records = 0
            with Output(folder, f"{number:05d}.log") as out:
                while part := [r for _, r in itertools.islice(group, 1024)]:
                    records += len(part)
                    out.write(frame(part, out.size))
            yield pd.DataFrame([(number, records, out.size)], columns=["log_no", "records", "bytes"])

    return scratch.materialize(ordered.mapInPandas(run, "log_no int, records long, bytes long"), "logs")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The change-log of framed files NNNNN.log: log_no, op, seq, key, value; each file's valid prefix.

    A file is read whole by one task; rotation bounds it.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path)
    found = found.select(F.regexp_extract("path", r"(\d+)\.log$", 1).try_cast("int").alias("log_no"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, content in zip(batch["log_no"], batch["content"]):
                rows = []
                for record in recover(bytes(content)):
                    if (change := parse(record)) is None:
                        break
                    rows.append((number, *change))
                yield pd.DataFrame(rows, columns=["log_no", "op", "seq", "key", "value"])

    return found.mapInPandas(run, "log_no int, op byte, seq long, key binary, value binary")


def chunk_count(length, header: int = schema.LOG_HEADER_BYTES):
    """Chunks of a record that begins a block, as a column of its length."""
    return F.ceil(length / (schema.LOG_BLOCK_BYTES - header))
