"""Exact top-k search by inner product on a bit-sliced index.

Components are scaled to integers, and a block of vectors is turned into bitmaps: one
for each bit of each component, over the block's rows. For a query the bitmaps that its
own bits select are added with bitmap arithmetic (carry-save adders by weight) into the
slices of the score. Going down from the most significant slice, rows with a set bit are
taken as long as they are at most k in number; the rows that remain equal at the end are
the boundary, resolved by the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import drop, materialize

SCALE = 256
TOP = 5
#: Rows of a block of the index, and queries that one task answers on a block at most.
BLOCK = 16384
QUERIES = 2048
_ONE = np.uint64(1)


def build(rows: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Slices of integer vectors (components x bits x words), bits of a component, and the least value."""
    least = int(rows.min()) if rows.size else 0
    bits = max(1, (int(rows.max()) - least).bit_length()) if rows.size else 1
    words = -(-len(rows) // 64)
    padded = np.zeros((words * 64, rows.shape[1]), dtype=np.uint64)
    padded[: len(rows)] = rows.astype(np.uint64) - np.uint64(least % (1 << 64))  # unsigned, so no range is too wide
    out = np.empty((rows.shape[1], bits, words), dtype=np.uint64)
    for bit in range(bits):
        plane = ((padded.T >> np.uint64(bit)) & _ONE).astype(np.uint8)
        out[:, bit] = np.ascontiguousarray(np.packbits(plane, axis=1, bitorder="little")).view("<u8")
    return out, bits, least


def score_slices(slices: np.ndarray, least: int, query: np.ndarray) -> tuple[np.ndarray, int]:
    """Slices of the score, the least significant first, and what is to be subtracted from it."""
    components, bits, words = slices.shape
    top = (1 << bits) - 1
    size = np.abs(query)
    negative = query < 0
    offset = sum(size[negative].tolist()) * (top + least) - sum(size[~negative].tolist()) * least
    out: list[np.ndarray] = []
    carried = np.zeros((0, words), dtype=np.uint64)
    weight = 0
    own_bits = int(size.max()).bit_length() if size.size else 0
    while weight < own_bits + bits - 1 or len(carried):
        stack = [carried]
        for bit in range(max(0, weight - own_bits + 1), min(bits, weight + 1)):
            chosen = (size >> (weight - bit)) & 1 == 1
            stack += [slices[chosen & ~negative, bit], ~slices[chosen & negative, bit]]
        rows = np.concatenate(stack)
        carries = []
        while len(rows) > 1:
            third = len(rows) // 3
            if third:
                a, b, c, rest = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third], rows[3 * third :]
                half = a ^ b
                carries.append((a & b) | (half & c))
                rows = np.concatenate([half ^ c, rest])
            else:
                carries.append((rows[0] & rows[1])[None])
                rows = (rows[0] ^ rows[1])[None]
        out.append(rows[0] if len(rows) else np.zeros(words, dtype=np.uint64))
        carried = np.concatenate(carries) if carries else np.zeros((0, words), dtype=np.uint64)
        weight += 1
    return np.array(out).reshape(len(out), words), offset


def _set_rows(bitmap: np.ndarray, most: int | None = None) -> np.ndarray:
    found = np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    return found if most is None else found[:most]


def top_rows(score: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k rows of a bitmap with the largest scores; the first of equal ones."""
    taken, equal = np.zeros_like(rows), rows
    if int(np.bitwise_count(rows).sum()) > k:
        for piece in score[::-1]:
            more = taken | (equal & piece)
            n = int(np.bitwise_count(more).sum())
            if n > k:
                equal = equal & piece
            else:
                taken, equal = more, equal & ~piece
                if n == k:
                    equal = np.zeros_like(rows)
                    break
    first = _set_rows(taken)
    return np.concatenate([first, _set_rows(equal, k - len(first))])


def search(slices: np.ndarray, least: int, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Query id, row id and score of each query's k best rows of a block whose ids are in rising order."""
    words = slices.shape[2]
    every = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view("<u8")
    out = []
    for query, name in zip(queries, own):
        score, offset = score_slices(slices, least, query)
        rows = every.copy()
        for at in range(*np.searchsorted(ids, [name, name + 1])):
            rows[at // 64] &= ~(_ONE << np.uint64(at % 64))
        found = top_rows(score, rows, k)
        digits = (score[:, found // 64] >> (found % 64).astype(np.uint64)) & _ONE
        for r, column in zip(found.tolist(), digits.T):
            value = sum(1 << i for i in np.flatnonzero(column).tolist()) - offset
            if not -(1 << 63) <= value < 1 << 63:
                raise OverflowError(f"the score {value} of {name} and {ids[r]} exceeds 64 bits")
            out.append((int(name), int(ids[r]), value))
    return out


def top_k(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows of df, all if there are fewer.

    `queries` is a subset of rows with df's columns; a row with the query's own id is no
    candidate of it. Ties go to the smaller id. Vectors that are null, empty or hold a
    null or a value that isn't finite, and rows without a key, take no part; vectors of
    different lengths don't meet. Slices are as many as the components need; what is an
    error is a score among the k best, or a scaled component, that 64 bits can't hold. Repeated
    queries are answered once. Other columns are not used.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def scaled(table: DataFrame) -> DataFrame:
        table = table.where(F.col(key).isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite))
        large = F.raise_error(F.lit("a scaled component exceeds 64 bits"))
        number = lambda x: F.when(F.abs(x.cast("double") * scale) >= 2.0**63, large.cast("long")).otherwise(F.floor(x.cast("double") * scale))
        return table.select(F.col(key).cast("long").alias("id"), F.transform(vector, number).alias("v"), F.size(vector).alias("dim"))

    rows = rows_table = materialize(scaled(df).withColumn("_row", F.monotonically_increasing_id()), "rows")
    wanted = materialize(scaled(queries).dropDuplicates(["id", "v"]), "queries")
    counts = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    counts = materialize(counts.withColumn("blocks", F.col("blocks").cast("long")), "blocks")
    asked = wanted.count()
    blocks = rows.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("_row"), F.col("blocks")))

    def index(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "_row"])
        slices, bits, least = build(np.stack(frame["v"].to_numpy()).astype(np.int64))
        return pd.DataFrame({"dim": frame["dim"].iloc[:1], "block": frame["block"].iloc[:1], "ids": [frame["id"].to_numpy(dtype="<i8").tobytes()], "slices": [slices.tobytes()], "bits": [bits], "least": [least]})

    stored = blocks.select("dim", "block", "id", "v", "_row").groupBy("dim", "block").applyInPandas(index, "dim int, block long, ids binary, slices binary, bits int, least long")
    stored = materialize(stored, "slices")
    drop(rows_table)
    # Enough groups of queries to keep all cores busy, and none too large for a task.
    cores = df.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-asked // QUERIES), min(-(-2 * cores // max(1, stored.count())), -(-asked // 32)))
    dealt = wanted.join(counts, "dim").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(groups)))
    dealt = dealt.select("dim", "part", "id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    copies = stored.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def answer(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(asked) and len(block):
            row = block.iloc[0]
            ids = np.frombuffer(row["ids"], dtype="<i8")
            slices = np.frombuffer(row["slices"], dtype="<u8").reshape(int(row["dim"]), int(row["bits"]), -1)
            found = search(slices, int(row["least"]), ids, np.stack(asked["v"].to_numpy()).astype(np.int64), asked["id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    near = dealt.groupBy("dim", "block", "part").cogroup(copies.groupBy("dim", "block", "part")).applyInPandas(answer, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
