"""Relations of the engine and its fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the storage model.
BUFFER_BYTES = 4 * 1024 * 1024
BLOOM_FPR = 0.01
LOG_BLOCK_BYTES = 32768
LOG_HEADER_BYTES = 7
LOG_MAX_PAYLOAD = LOG_BLOCK_BYTES - LOG_HEADER_BYTES
BLOCK_BYTES = 4096
RESTART_INTERVAL = 16
L0_RUNS = 4
CACHE_BLOCKS = 100
LEVELS = 7
LEVEL_RATIO = 10
L1_BYTES = 10 * 1024 * 1024
MAX_KEY_BYTES = 65535
PUT, DELETE = 1, 2
ADD, REMOVE = 1, 2
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4

_f = T.StructField

ENTRY = T.StructType([_f("key", T.BinaryType(), False), _f("value", T.BinaryType(), False)])
CHANGELOG = T.StructType([_f("op", T.ByteType()), _f("seq", T.LongType()), _f("key", T.BinaryType()), _f("value", T.BinaryType())])
CHUNK = T.StructType([_f("log_no", T.IntegerType()), _f("chunk_no", T.LongType()), _f("crc", T.LongType()), _f("length", T.IntegerType()), _f("chunk_type", T.ByteType()), _f("payload", T.BinaryType())])
RUN = T.StructType([_f("level", T.IntegerType()), _f("run_id", T.LongType()), _f("key", T.BinaryType()), _f("value", T.BinaryType())])
MANIFEST = T.StructType([_f("edit_no", T.LongType()), _f("tag", T.ByteType()), _f("level", T.IntegerType()), _f("run_id", T.LongType())])
