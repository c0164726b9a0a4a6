"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scratch import delete_path, drop, fresh, materialize, scratch_folder, scratch_root

__all__ = ["Kept", "append_columns", "delete_path", "drop", "fresh", "join_hot", "map_rows", "materialize", "scratch_folder", "scratch_root"]

#: A key with more than this share of all rows is joined apart; of such there are fewer than FEW.
FEW = 1024
#: So few rows of a key are no burden to a task, and no table of as many needs to be split.
LIGHT = 1024
_ENTRY = 240  # bytes of a word kept besides its characters and ids
_LONGEST_KEPT = 40


class Kept(dict):
    """Ids, as bytes, of short texts, worked out when first asked for.

    When they take `limit` bytes, or are `most`, the entries become the old ones, of which
    those asked for again return.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int, most: int = 1 << 62) -> None:
        super().__init__()
        self.encode = encode
        self.limit = self.room = limit
        self.entry = max(_ENTRY, limit // most)
        self.old: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        if (found := self.old.get(text)) is None:
            found = self.encode(text)
        if (n := len(text)) <= _LONGEST_KEPT:
            if self.room <= 0:
                self.old = dict(self)
                self.clear()
                self.room = self.limit
            self.room -= self.entry + 4 * n + len(found)
            self[text] = found
        return found


def join_hot(rows: DataFrame, table: DataFrame, on: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined ("inner" or "left") with `table`, which has one row for each value of `on`.

    `weight` says how many of the `total` rows have the value. Values of more than
    total / FEW rows are fewer than FEW, so their part of the table is broadcast; the
    others are joined by a shuffle in which no key has more than that share of the rows,
    and rows without a value, which may be many, take no part in it.
    """
    if total <= LIGHT:
        return rows.join(table.drop(weight), on, how)
    large = (F.col(weight) * FEW > total) & (F.col(weight) > LIGHT)
    hot, cold = table.where(large).drop(weight), table.where(~large).drop(weight)
    (mark,) = fresh([*rows.columns, *table.columns], "_hot")
    held = rows.where(F.col(on).isNotNull())
    marked = held.join(F.broadcast(hot.select(on, F.lit(True).alias(mark))), on, "left").where(F.col(mark).isNull()).select(*rows.columns)
    both = held.join(F.broadcast(hot), on).unionByName(marked.join(cold, on, how))
    if how == "left":
        added = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name not in (on, weight)]
        both = both.unionByName(rows.where(F.col(on).isNull()).select("*", *added))
    return both


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow over the named columns, handing fn at most `rows` rows at a time as lists.

    fn returns equally long lists by column of `schema`; small slices bound memory
    with very long texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(struct)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.select(*columns).mapInArrow(run, struct)


def append_columns(df: DataFrame, inputs: list[str], fn: Callable[..., dict[str, list]], new: str, rows: int = 512) -> DataFrame:
    """Add the columns of the DDL `new`, computed by fn from lists of the inputs' values.

    All columns of df are kept as they are; those with the name of a new column are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(new)
    lower = {n.lower() for n in added.fieldNames()}
    kept = [f for f in df.schema.fields if f.name.lower() not in lower]
    names = [f.name for f in kept]
    apart = list(dict.fromkeys(c for c in inputs if c not in names))
    place = {c: i for i, c in enumerate([*names, *apart])}
    out = StructType(kept + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = fn(*[part.column(place[c]).to_pylist() for c in inputs])
                columns = [part.column(i).cast(target.field(i).type) for i in range(len(names))]
                columns += [pa.array(got[f.name], target.field(f.name).type) for f in added.fields]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    # Inputs that aren't kept stand after what is, under names that no column has; all are found by place.
    others = fresh(names, *[f"_in_{i}" for i in range(len(apart))])
    return df.select(*[df[n] for n in names], *[df[c].alias(a) for c, a in zip(apart, others)]).mapInArrow(run, out)
