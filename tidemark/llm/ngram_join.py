"""Similarity join of documents on the Jaccard similarity of their word n-grams.

Documents with the same n-grams form a class, of which one member goes on. A MinHash
signature of TREES x DEPTH values gives each class a label of DEPTH values in each of
TREES prefix tries; two classes are candidates where they share a prefix in some tree.
Labels are shortened to the greatest depth at which any link at the threshold, with a
chance of 1 - (1 - s^depth)^TREES at similarity s, reaches the target, so that whether a
link is found doesn't depend on what else the table holds.
Candidates whose signatures agree far too little are let go. The others are gathered
into clusters, and within each all texts are compared exactly, so what the signatures
say decides nothing but where to look.

No pairs are emitted: a node of a trie, or a cluster, with more than BLOCK members (or a
cluster with more than BLOCK_GRAMS n-grams) is dealt out as pairs of blocks, and each task
returns sums by member and edges that connect what it found. Texts are shuffled only
where a bitmap of the members' ids has their bit.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import drop, fresh, join_hot, map_rows, materialize
from tidemark.llm.components import components

NGRAM = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 6
TARGET_RECALL = 0.9999
#: Members of a trie's node or a cluster that one task compares with as many others.
BLOCK = 256
#: N-grams that a block of a cluster holds, so that long texts make more and smaller blocks.
BLOCK_GRAMS = 1 << 20
#: Bits of the filter for each member, and at most: 32 MB, whatever the input. A filter that is too small lets more texts pass.
FILTER_SHARE = 32
FILTER_BITS = 1 << 28
_BITMAP = 32768
#: Standard errors by which a signature's similarity may fall short of the threshold.
SLACK = 5.0
_WORD = re.compile(r"\w+")
_CACHE = 150_000
_STEP = 1 << 14
_MULTIPLIERS = (np.random.default_rng(20).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, NGRAM - 1 - i, 1 << 64)) for i in range(NGRAM)]


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= _CACHE:
            self.clear()
        self[word] = found
        return found


_words = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams of words, lower case.

    A text of fewer words has one n-gram, of all its words; one of none has none.
    """
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(NGRAM, len(words))
    total = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * _POWERS[i]
    return np.unique(_mix(total + np.uint64(n)))


def digest(grams: np.ndarray) -> bytes | None:
    """Names a set; none for the empty one."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def signature(grams: np.ndarray) -> bytes:
    """The MinHash values of a set, 16 bits of each, tree by tree."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, (1 << 20) // len(_MULTIPLIERS))
    for at in range(0, len(grams), step):
        part = grams[at : at + step]
        np.minimum(least, (part[None, :] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    return (_mix(least) >> np.uint64(48)).astype("<u2").tobytes()


def found_share(s: float | np.ndarray, depth: int) -> float | np.ndarray:
    """Chance that two sets of similarity s share a prefix of that depth in some tree."""
    return 1.0 - (1.0 - s**depth) ** TREES


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key, a group never being split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        begin = int(np.searchsorted(column, column[-1], "left"))  # the last group may go on
        if held and begin:
            yield pa.Table.from_batches([*held, batch.slice(0, begin)])
            held = []
        elif begin:
            yield pa.Table.from_batches([batch.slice(0, begin)])
        held.append(batch.slice(begin))
        if len(held) > 1 and not begin and held[0].column(batch.schema.get_field_index(key))[0].as_py() != column[0]:
            *before, last = held
            yield pa.Table.from_batches(before)
            held = [last]
    if held:
        yield pa.Table.from_batches(held)


def _map_groups(df: DataFrame, key: str, fn: Callable[[np.ndarray, pa.Table], dict[str, list]], schema: str) -> DataFrame:
    """Run fn on whole groups of a long key: it gets where groups begin and their rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(struct)
        for table in _grouped(batches, key):
            values = table.column(key).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            out = fn(starts, table)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    # So many partitions whatever their bytes: the work is in comparing.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, key).sortWithinPartitions(key).mapInArrow(run, struct)


def _bit(key: Column, bits: int) -> tuple[Column, Column]:
    """Number of the bitmap and place in it of a key's bit."""
    h = F.pmod(F.xxhash64(key), F.lit(bits).cast("long"))
    return F.floor(h / _BITMAP).cast("int"), F.pmod(h, F.lit(_BITMAP))


def member_filter(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """Bitmaps with a bit for each key, by their number, and their bits in all: FILTER_BITS at most."""
    bits = _BITMAP
    while bits < min(FILTER_SHARE * n, FILTER_BITS):
        bits *= 2
    bitmap, place = _bit(F.col(key), bits)
    # Dealt before they are gathered: a bitmap is larger than the few keys of it that a task meets.
    dealt = keys.where(F.col(key).isNotNull()).select(bitmap.alias("_bitmap"), place.alias("_place")).repartition("_bitmap")
    return dealt.groupBy("_bitmap").agg(F.bitmap_construct_agg("_place").alias("_bits")), bits


def maybe_members(rows: DataFrame, key: str, filters: DataFrame, bits: int, out: str = "_maybe") -> DataFrame:
    """Add whether the key has its bit, as all members do, and few others while the filter is large enough."""
    bitmap, place = _bit(F.col(key), bits)
    number, held = fresh([*rows.columns, out], "_bitmap", "_bits")
    byte = F.conv(F.hex(F.substring(held, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = rows.withColumn(number, bitmap).join(F.broadcast(filters.toDF(number, held)), number, "left")
    has = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))
    return found.select(*rows.columns, has.alias(out))


def _dealt(rows: DataFrame, group: str, blocks: Column, member: str) -> DataFrame:
    """Deal each group to units of at most two of its blocks; adds unit, side and whether the unit is of two blocks."""
    own = F.pmod(F.xxhash64(member), F.col("_blocks"))
    other = F.explode(F.when(F.col("_blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.withColumn("_blocks", F.ceil(blocks).cast("long")).withColumn("_own", own)
    rows = rows.withColumn("_other", other)
    pair = F.struct(F.least("_own", "_other"), F.greatest("_own", "_other"))
    return rows.withColumn("unit", F.xxhash64(group, pair)).withColumn("side", (F.col("_own") > F.col("_other")).cast("int")).withColumn("two", F.col("_own") != F.col("_other")).drop("_blocks", "_own", "_other")


def _stars(near: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a graph connects, given its adjacency matrix: from the smallest id of each part.

    Other units that meet the same part give much the same edges, so few are distinct.
    """
    left = np.ones(len(near), dtype=bool)
    edges: list[tuple[int, int]] = []
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root] = False
        part, at = [root], 0
        while at < len(part):
            new = np.flatnonzero(near[part[at]] & left)
            left[new] = False
            part += new.tolist()
            at += 1
        least = int(ids[part].min())
        edges += [(least, int(x)) for x in ids[part] if x != least]
    return edges


def _candidates(least: float) -> Callable[[np.ndarray, pa.Table], dict[str, list]]:
    """Edges between members of a trie's nodes whose signatures agree enough."""

    def run(starts: np.ndarray, table: pa.Table) -> dict[str, list]:
        ids = table.column("cid").to_numpy()
        signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype="<u2").reshape(-1, TREES * DEPTH)
        group = np.zeros(len(ids), dtype=np.int64)
        group[starts] = 1
        group = np.cumsum(group)
        size = np.bincount(group)[group]
        a: list[int] = []
        b: list[int] = []

        def shares(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (signs[i] == signs[j]).mean(axis=1)

        small = np.flatnonzero(size <= 32)
        for k in range(1, int(size[small].max()) if len(small) else 0):
            i = small[:-k] if k < len(small) else small[:0]
            j = small[k:]
            i, j = i[group[i] == group[j]], j[group[i] == group[j]]
            for at in range(0, len(i), _STEP):
                x, y = i[at : at + _STEP], j[at : at + _STEP]
                near = shares(x, y) >= least
                a += ids[x[near]].tolist()
                b += ids[y[near]].tolist()
        for begin in starts[size[starts] > 32]:
            rows = np.arange(begin, begin + size[begin])
            near = np.zeros((len(rows), len(rows)), dtype=bool)
            for r, row in enumerate(rows):
                near[r] = shares(np.full(len(rows), row), rows) >= least
            for x, y in _stars(near, ids[rows]):
                a.append(x)
                b.append(y)
        return {"a": a, "b": b}

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all the intersections, as a matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    total = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    columns = int(shared.sum())
    width = max(1, min(columns, max(256, (1 << 22) // len(sets))))
    for at in range(0, columns, width):
        a, b = np.searchsorted(column, [at, at + width])
        bits = np.zeros((len(sets), width), dtype=np.float32)
        bits[owner[a:b], column[a:b] - at] = 1.0
        total += bits @ bits.T
    return total


def _verified(threshold: float) -> Callable[[np.ndarray, pa.Table], dict[str, list]]:
    """Documents linked to each member by exact comparison of a unit's texts, and edges that connect the linked."""

    def run(starts: np.ndarray, table: pa.Table) -> dict[str, list]:
        every, all_copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        side, two = table.column("side").to_numpy(), table.column("two").to_numpy(zero_copy_only=False)
        texts, digests = table.column("text"), table.column("grams")
        out: dict[str, list] = {"a": [], "b": [], "links": []}
        for begin, end in zip(starts, [*starts[1:], len(every)]):
            members: dict[int, tuple[int, np.ndarray]] = {}
            for i in range(begin, end):  # another row with the member's key may have another text
                if (cid := int(every[i])) not in members and digest(grams := ngrams(texts[i].as_py())) == digests[i].as_py():
                    members[cid] = i, grams
            at = np.array([i for i, _ in members.values()])
            sets = [g for _, g in members.values()]
            common = _common(sets)
            n = np.array([len(s) for s in sets], dtype=float)
            linked = common / (n[:, None] + n[None, :] - common) >= threshold
            np.fill_diagonal(linked, False)
            if two[begin]:
                linked &= side[at, None] != side[None, at]
            links = linked @ all_copies[at]
            out["a"] += every[at].tolist()
            out["b"] += [None] * len(at)
            out["links"] += links.tolist()
            for x, y in _stars(linked, every[at]):
                out["a"].append(x)
                out["b"].append(y)
                out["links"].append(0)
        return out

    return run


def join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One row for every document: key, class_id, n_links and copy_of.

    n_links counts the other documents whose n-grams have a Jaccard similarity of at
    least `threshold` with its own, class_id is the smallest key that links reach, and
    copy_of the smallest key with exactly its n-grams. A null text counts as empty;
    documents without words link with nothing. A text of any length is read whole. A null
    key, in a row that is kept, has null results. Repeated rows count as documents of their
    own. Other columns are not kept.
    """

    def sign(columns: dict[str, list]) -> dict[str, list]:
        grams = [ngrams(t) for t in columns["text"]]
        return {
            "doc": columns["doc"],
            "grams": [digest(g) for g in grams],
            "n": [len(g) for g in grams],
            "signature": [signature(g) if len(g) else None for g in grams],
        }

    rows = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    docs = materialize(map_rows(rows, ["doc", "text"], sign, "doc long, grams binary, n long, signature binary"), "signed")
    signed = docs.where(F.col("grams").isNotNull() & F.col("doc").isNotNull())
    classes = signed.groupBy("grams").agg(F.min("doc").alias("rid"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n_docs, n_classes = docs.count(), classes.count()

    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))
    depth = max((d for d in range(1, DEPTH + 1) if found_share(threshold, d) >= target), default=1)
    label = F.xxhash64("_t", F.expr(f"substring(signature, _t * {2 * DEPTH} + 1, {2 * depth})"))
    nodes = classes.select("cid", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("_t")).select("cid", label.alias("node"))
    counts = materialize(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "nodes")
    shared = join_hot(nodes, counts.withColumn("_n", F.col("members")), "node", "_n", TREES * n_classes)
    dealt = _dealt(shared, "node", F.col("members") / BLOCK, "cid")
    dealt = dealt.select("unit", "cid").join(classes.select("cid", "signature"), "cid")
    seen = materialize(_map_groups(dealt, "unit", _candidates(least), "a long, b long"), "candidates")
    drop(counts)

    clusters = components(seen.select("a", "b"))
    held = clusters.withColumnRenamed("node", "cid").join(classes.drop("signature"), "cid")
    sizes = materialize(held.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("all_grams")), "sizes")
    members = join_hot(held, sizes.withColumn("_n", F.col("members")), "component", "_n", n_classes)
    members = materialize(members, "members")
    drop(seen, sizes, clusters)
    filters, bits = member_filter(members, "rid", members.count())
    filters = materialize(filters, "filter")
    # Always a shuffled join: the members grow with the input, and no size of theirs changes the plan.
    texts = maybe_members(rows.where(F.col("doc").isNotNull()), "doc", filters, bits).where("_maybe").drop("_maybe").hint("merge")
    blocks = F.greatest(F.col("members") / BLOCK, F.col("all_grams") / BLOCK_GRAMS)
    dealt = _dealt(members.join(texts, F.col("rid") == F.col("doc")), "component", blocks, "cid").select("unit", "cid", "side", "two", "copies", "grams", "text")
    verified = materialize(_map_groups(dealt, "unit", _verified(threshold), "a long, b long, links long"), "links")
    drop(members, filters)

    links = verified.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    groups = components(verified.select("a", "b"))
    found_classes = classes.drop("signature", "n").join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
    found_classes = materialize(found_classes.withColumn("component", F.coalesce("component", "cid")), "linked")
    names = found_classes.groupBy("component").agg(F.min("rid").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    named = join_hot(found_classes, names, "component", "_n", n_classes)
    result = named.select("grams", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("rid").alias("copy_of"), F.col("copies").alias("_n"))
    result = materialize(result, "result")
    drop(verified, groups, classes, found_classes)
    docs = docs.select(F.col("doc").alias(key), F.when(F.col("doc").isNotNull(), F.col("grams")).alias("grams"))
    joined = join_hot(docs, result, "grams", "_n", n_docs, "left")
    n_links = F.when(F.col(key).isNotNull(), F.coalesce("n_links", F.lit(0)))
    return joined.select(key, F.coalesce("class_id", key).alias("class_id"), n_links.alias("n_links"), F.coalesce("copy_of", key).alias("copy_of"))
