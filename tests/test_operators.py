import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import blocks, changelog, lookup, runs
from tidemark.plans import manifest, policy


def _log(spark, rows):
    return spark.createDataFrame([(i + 1, k, "P" if v else "D", v) for i, (k, v) in enumerate(rows)], "seq long, k string, op string, v string")


def _pairs(df):
    return sorted((r.k, r.v) for r in df.select("k", "v").collect())


def test_latest_and_tombstones(spark):
    log = _log(spark, [("hero", "batman"), ("hero", "superman"), ("x", "1"), ("x", ""), ("gone", ""), ("", "empty")])
    assert _pairs(changelog.snapshot(log)) == [("", "empty"), ("hero", "superman")]
    assert _pairs(changelog.as_of(log, 3)) == [("hero", "superman"), ("x", "1")]
    assert _pairs(changelog.latest(log)) == [("", "empty"), ("gone", ""), ("hero", "superman"), ("x", "")]


def test_get_stops_at_a_tombstone(spark):
    log = _log(spark, [("a", "1"), ("a", ""), ("b", "2")])
    assert lookup.get(log, "a", [F.desc("seq")]).count() == 0
    assert lookup.get(log, "b", [F.desc("seq")]).first().v == "2"
    assert lookup.get(log, "c", [F.desc("seq")]).count() == 0


def test_merge_disjoint_and_overwriting_runs(spark):
    def run(rank, rows):
        return spark.createDataFrame([(k, v, rank) for k, v in rows], "k string, v string, rank int")

    merged = runs.merge([run(1, [("a", "1"), ("c", "3"), ("e", "5")]), run(2, [("b", "2"), ("d", "4"), ("f", "6")])], "k", "v", ["rank"])
    assert _pairs(merged) == list(zip("abcdef", "123456"))
    old = run(1, [("apple", "old_val"), ("banana", "old_val"), ("dog", "x")])
    new = run(2, [("apple", "new_val"), ("cat", "new_val"), ("dog", "")])
    assert _pairs(runs.merge([old, new], "k", "v", ["rank"])) == [("apple", "new_val"), ("banana", "old_val"), ("cat", "new_val"), ("dog", "")]


def test_running_total_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(runs, "BUCKET", 7)
    rows = spark.range(1, 500).withColumnRenamed("id", "seq")
    found = runs.running_total(rows, "seq", F.col("seq")).collect()
    assert len(found) == 499 and all(r.before == r.seq * (r.seq - 1) // 2 for r in found)


def test_running_total_joins_rows_by_bucket(spark, monkeypatch):
    """No task of the joins takes the rows of all buckets, also where nothing is broadcast."""
    monkeypatch.setattr(runs, "BUCKET", 64)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {name: spark.conf.get(name) for name in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        rows = spark.range(1, 4000).withColumnRenamed("id", "seq")
        found = runs.running_total(rows, "seq", F.lit(1)).select("before", F.spark_partition_id().alias("part"))
        sizes = [r["count"] for r in found.groupBy("part").count().collect()]
        assert sum(sizes) == 3999 and max(sizes) < 2500
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_empty_log(spark):
    log = _log(spark, [("a", "1")]).limit(0)
    assert changelog.snapshot(log).count() == 0
    assert runs.flush(runs.assign_runs(log, 10)).count() == 0


def test_binary_order(spark):
    keys = [b"\x80", b"\x7f", b"\xff", b"\x00", b"", b"\x7f\x00"]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    assert [bytes(r.key) for r in df.orderBy("key").collect()] == sorted(keys)


def test_block_bytes():
    block = blocks.Builder()
    block.add(b"apple", b"val1")
    block.add(b"appstore", b"val2")
    assert len(block.data) == 24 and block.points == [0]
    data = block.finish()
    assert list(blocks.entries(data)) == [(b"apple", b"val1"), (b"appstore", b"val2")]


def test_restart_at_the_17th_key():
    block = blocks.Builder()
    for i in range(17):
        block.add(b"key%02d" % i, b"v")
    assert len(block.points) == 2
    assert next(blocks.entries(block.finish(), 1))[0] == b"key16"


def test_block_find():
    block = blocks.Builder()
    for k in (b"apple", b"appstore", b"banana", b"bear", b"cat"):
        block.add(k, b"val_" + k)
    data = block.finish()
    assert blocks.find(data, b"bear") == b"val_bear" and blocks.find(data, b"apple") == b"val_apple"
    assert [blocks.find(data, k) for k in (b"a", b"bat", b"zebra")] == [None] * 3


def test_packed_blocks_round_trip(spark):
    rows = [(r, b"key%04d" % i, b"value%04d" % i * (1 + i % 9)) for r in (1, 2) for i in range(500)]
    df = spark.createDataFrame([(r, bytearray(k), bytearray(v)) for r, k, v in rows], "run_id long, key binary, value binary")
    packed = blocks.pack(df)
    sizes = {(r.run_id, r.block_no): r for r in packed.collect()}
    assert len(sizes) > 4 and all(len(r.data) >= 4096 for k, r in sizes.items() if (k[0], k[1] + 1) in sizes)
    assert sorted((r.run_id, bytes(r.key), bytes(r.value)) for r in blocks.unpack(packed).collect()) == sorted(rows)
    hit = next(r for r in sizes.values() if r.run_id == 1 and bytes(r.first_key) <= b"key0250" <= bytes(r.last_key))
    assert blocks.find(bytes(hit.data), b"key0250") == b"value0250" * (1 + 250 % 9)


@pytest.mark.parametrize("fanout", [64, 3])
def test_index_seek_down_a_tree(spark, monkeypatch, fanout):
    monkeypatch.setattr(lookup, "FANOUT", fanout)
    entries = [(r, 2 * b, f"k{b * 10:04d}") for r in (1, 2) for b in range(40)]  # block numbers have gaps
    index = spark.createDataFrame(entries, "run_id long, block_no long, last_k string")
    probes = spark.createDataFrame([(r, f"k{i:04d}") for r in (1, 2) for i in range(0, 400, 7)], "run_id long, k string")
    for r in lookup.index_seek(probes, index, "run_id", "k", "last_k").collect():
        want = [b for run, b, last in entries if run == r.run_id and last >= r.k]
        assert r.block_no == (min(want) if want else None)


def test_index_seek(spark):
    index = spark.createDataFrame([(1, 0, "c"), (1, 1, "f")], "run_id long, block_no long, last_k string")
    probes = spark.createDataFrame([(1, "a"), (1, "c"), (1, "d"), (1, "z"), (2, "a")], "run_id long, k string")
    found = {(r.run_id, r.k): r.block_no for r in lookup.index_seek(probes, index, "run_id", "k", "last_k").collect()}
    assert found == {(1, "a"): 0, (1, "c"): 0, (1, "d"): 1, (1, "z"): None, (2, "a"): None}


def test_cache_hits(spark):
    names = ["a", "b", "a", "c", "b", "a", "a"]
    df = spark.createDataFrame(list(enumerate(names)), "at long, block string")
    hits = [r.hit for r in blocks.cache_hits(df, 2).orderBy("at").collect()]
    assert hits == [False, False, True, False, False, False, True]


def test_manifest_replay(spark):
    edits = [(1, 1, 0, 7), (2, 1, 0, 8), (3, 2, 0, 7), (4, 1, 1, 9), (5, 9, 0, 8), (6, 1, 0, 7), (7, 2, 1, 9)]
    df = spark.createDataFrame(edits, schema.MANIFEST)
    assert sorted(tuple(r) for r in manifest.live(df).collect()) == [(0, 7), (0, 8)]
    again = manifest.decode(manifest.encode(df))
    assert sorted(tuple(r) for r in manifest.live(again).collect()) == [(0, 7), (0, 8)]
    cut = manifest.encode(df).select("edit_no", F.substring("data", 1, 12).alias("data"))
    assert manifest.decode(cut).count() == 0


def test_policy():
    def held(level, n, size=1):
        return [{"level": level, "run_id": i, "bytes": size} for i in range(n)]

    assert policy.next_level(held(0, 3)) is None and policy.next_level(held(0, 4)) == 0
    assert policy.next_level(held(1, 1, 10 * 2**20), 0) is None and policy.next_level(held(1, 1, 10 * 2**20 + 1), 0) == 1
    assert policy.next_level(held(2, 1, 10 * 2**20 + 1), 1) is None
    assert policy.next_level(held(6, 9, 2**60), 5) is None


def test_prefix_sums_over_ranges(spark):
    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), F.lpad((F.col("id") * 7919 % 2000).cast("string"), 5, "0").alias("k"), (F.col("id") % 13).alias("n"))
    found = runs.prefix_sums(rows.repartition(7), ["g"], ["k"], F.col("n")).collect()
    sums = {}
    for r in sorted(found, key=lambda r: (r.g, r.k)):
        assert r.before == sums.get(r.g, 0)
        sums[r.g] = r.before + r.n
    assert len(found) == 2000 and runs.prefix_sums(rows.limit(0), ["g"], ["k"], F.col("n")).count() == 0


def test_running_last_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(runs, "BUCKET", 5)
    data = [(i, None if i % 4 == 0 else f"g{i % 3}", f"v{i}" if i % 7 == 0 else None) for i in range(60)]
    rows = spark.createDataFrame(data, "at long, g string, v string")
    last, want = {}, {}
    for at, g, v in data:
        last[g] = v if v is not None else last.get(g)
        want[at] = last[g]
    assert {r.at: r.last for r in runs.running_last(rows, ["g"], "at", F.col("v")).collect()} == want


def test_overlaps_by_a_sweep(spark):
    ranges = [(i, f"{i * 7 % 50:02d}", f"{min(99, i * 7 % 50 + i % 9):02d}") for i in range(40)]
    found = {r.run_id: r.overlaps for r in runs.overlaps(spark.createDataFrame(ranges, "run_id long, lo string, hi string")).collect()}
    assert found == {i: sum(1 for j, a, b in ranges if i != j and lo <= b and a <= hi) for i, lo, hi in ranges}


def test_merge_edits(spark):
    live = spark.createDataFrame([(0, 5), (0, 6), (1, 4)], "level int, run_id long")
    assert sorted(tuple(r) for r in manifest.merge_edits(live, 0, 9).collect()) == [(1, 1, 9), (2, 0, 5), (2, 0, 6)]
    assert manifest.merge_edits(live, 3, 9).count() == 0
