"""LEB128 integers as column expressions; 64-bit values count as unsigned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(value: Column) -> Column:
    """Bytes that the encoding takes: one for every 7 bits."""
    found = F.when(value < 0, F.lit(10))
    for n in range(1, 10):
        if n < 9:
            found = found.when(value < (1 << (7 * n)), F.lit(n))
    return found.otherwise(F.lit(9)).cast("int")


def encode(value: Column) -> Column:
    """The encoding as binary: 7 bits a byte from the lowest, all but the last with the high bit."""
    n = length(value)
    digit = lambda i: F.call_function("shiftrightunsigned", value, (i * 7).cast("int")).bitwiseAND(F.lit(127)) + F.when(i < n - 1, 128).otherwise(0)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(digit(i)), 2, "0")), ""))


def decode(data: Column, width: int = 64) -> Column:
    """The first integer in binary data; null if it is cut off or longer than the width allows.

    Of a longest encoding, bits beyond the width are dropped.
    """
    most = 5 if width == 32 else 10
    digits = F.transform(F.sequence(F.lit(1), F.least(F.octet_length(data), F.lit(most))), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    digits = F.when(F.octet_length(data) > 0, digits).otherwise(F.array().cast("array<long>"))
    ends = F.array_position(F.transform(digits, lambda d: d < 128), True).cast("int")
    whole = F.aggregate(
        F.slice(digits, F.lit(1), F.greatest(ends, F.lit(1))),
        F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("s")),
        lambda a, d: F.struct((a["v"].bitwiseOR(F.call_function("shiftleft", d.bitwiseAND(F.lit(127)), a["s"]))).alias("v"), (a["s"] + 7).alias("s")),
        lambda a: a["v"],
    )
    return F.when(ends > 0, whole if width == 64 else whole.bitwiseAND(F.lit(0xFFFFFFFF)))
