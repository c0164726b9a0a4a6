import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import bloom
from tidemark.operators import blocks, lookup
from tidemark.sources import log_files, run_files


def test_small_chunk():
    data = log_files.frame([b"x" * 100])
    assert len(data) == 107 and data[6] == schema.FULL


def test_split_record():
    found = list(log_files.chunks([b"x" * 40000]))
    assert [(o, k, len(p)) for o, k, p in found] == [(0, schema.FIRST, 32761), (32768, schema.LAST, 7239)]


def test_block_padding():
    data = log_files.frame([b"x" * 32756, b"y" * 100])
    assert data[32763:32768] == bytes(5) and len(data) == 32875


def test_header_that_just_fits_gets_an_empty_first_chunk():
    found = [(o, k, len(p)) for o, k, p in log_files.chunks([b"x" * (32768 - 14), b"y" * 10])]
    assert found[1:] == [(32761, schema.FIRST, 0), (32768, schema.LAST, 10)]


@pytest.mark.parametrize("sizes", [[1], [32761], [32762], [100_000, 5, 32754, 32747, 1], [32754, 40000]])
def test_framing_round_trip(sizes):
    records = [bytes([i % 251]) * n for i, n in enumerate(sizes)]
    data = log_files.frame(records)
    assert list(log_files.recover(data)) == records
    more = data + log_files.frame([b"again" * 9000], len(data))  # appended to a file that isn't empty
    assert list(log_files.recover(more)) == [*records, b"again" * 9000]


def test_recovery_keeps_the_valid_prefix():
    records = [b"a" * 10, b"b" * 40000, b"c" * 10]
    data = log_files.frame(records)
    assert list(log_files.recover(data[:-1])) == records[:2]
    assert list(log_files.recover(data[:30000])) == records[:1]
    damaged = bytearray(data)
    damaged[33000] ^= 1
    assert list(log_files.recover(bytes(damaged))) == records[:1]


def test_log_files_to_changelog(spark, tmp_path):
    def write(number, changes):
        (tmp_path / f"{number:05d}.log").write_bytes(log_files.frame([log_files.serialize(*c) for c in changes]))

    write(1, [(1, 1, b"key1", b"v"), (1, 2, b"key2", b"x" * 40000), (2, 3, b"key1", b"")])
    write(2, [(1, 4, b"key3", b"w")])
    rows = log_files.read(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.log_no, r.op, r.seq, bytes(r.key), len(r.value)) for r in rows] == [(1, 1, 1, b"key1", 1), (1, 1, 2, b"key2", 40000), (1, 2, 3, b"key1", 0), (2, 1, 4, b"key3", 1)]


def test_long_keys_are_refused():
    log_files.serialize(1, 1, b"k" * 65535, b"")
    with pytest.raises(ValueError):
        log_files.serialize(1, 1, b"k" * 65536, b"")


def _changes(n):
    return [(1 + i % 2 * (i % 5 == 0), i + 1, b"key%05d" % (i % 97), b"" if i % 5 == 0 and i % 2 else bytes([i % 251]) * (1 + i * 37 % 5000)) for i in range(n)]


def test_log_sink_writes_what_framing_gives(spark, tmp_path):
    rows = [(1 + i // 100, *c) for i, c in enumerate(_changes(250))]
    df = spark.createDataFrame([(n, o, s, bytearray(k), bytearray(v)) for n, o, s, k, v in rows], "log_no int, op byte, seq long, key binary, value binary")
    folder = f"file://{tmp_path}/wal"
    told = {r.log_no: (r.records, r.bytes) for r in log_files.write(df.repartition(3), folder).collect()}
    for number in (1, 2, 3):
        want = log_files.frame([log_files.serialize(*c) for n, *c in rows if n == number])
        assert (tmp_path / "wal" / f"{number:05d}.log").read_bytes() == want and told[number][1] == len(want)
    assert [told[n][0] for n in (1, 2, 3)] == [100, 100, 50] and not list((tmp_path / "wal").glob(".*"))
    back = log_files.read(spark, folder).orderBy("seq").collect()
    assert [(r.log_no, r.op, r.seq, bytes(r.key), bytes(r.value)) for r in back] == rows
    assert log_files.write(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_recovery_over_several_logs(spark, tmp_path):
    """A damaged log keeps what stands before; the logs after it are read."""
    rows = [(1 + i // 10, *c) for i, c in enumerate(_changes(30))]
    df = spark.createDataFrame([(n, o, s, bytearray(k), bytearray(v)) for n, o, s, k, v in rows], "log_no int, op byte, seq long, key binary, value binary")
    log_files.write(df, f"file://{tmp_path}/wal")
    second = tmp_path / "wal" / "00002.log"
    (tmp_path / "wal" / ".00002.log.crc").unlink(missing_ok=True)
    second.write_bytes(second.read_bytes()[:-3])
    kept = {r.seq for r in log_files.read(spark, f"file://{tmp_path}/wal").collect()}
    assert kept == set(range(1, 31)) - {20}


def _runs(spark, n=700):
    rows = [(r, b"key%05d" % i, b"" if i % 11 == 0 else b"value%d-%d" % (r, i) * (1 + i % 13)) for r in (3, 7) for i in range(0, n, r)]
    return rows, spark.createDataFrame([(r, bytearray(k), bytearray(v)) for r, k, v in rows], "run_id long, key binary, value binary")


def test_run_files(spark, tmp_path):
    rows, df = _runs(spark)
    folder = f"{tmp_path}/sst"  # a path without its store
    told = {r.run_id: r for r in run_files.write(df.repartition(3), folder).collect()}
    for run_id in (3, 7):
        data = (tmp_path / "sst" / f"{run_id:08d}.run").read_bytes()
        assert len(data) == told[run_id].bytes and told[run_id].n == sum(r == run_id for r, *_ in rows)
        index, found = run_files.parts(data)
        assert len(list(blocks.entries(index))) == told[run_id].blocks
        k, m, words = bloom.from_bytes(found)
        assert (k, m) == bloom.parameters(told[run_id].n, 0.01) and data[-16:] == bytes(16)
    with pytest.raises(ValueError):
        run_files.parts(b"cut")
    with pytest.raises(ValueError):
        run_files.parts(data[1:])
    assert sorted((r.run_id, bytes(r.key), bytes(r.value)) for r in run_files.read(spark, folder).collect()) == sorted(rows)
    held = run_files.blocks(spark, folder).collect()
    assert {r.codec for r in held} <= {blocks.NONE, blocks.SNAPPY} and any(r.codec == blocks.SNAPPY for r in held)
    assert run_files.write(df.limit(0), f"file://{tmp_path}/none").count() == 0


@pytest.fixture
def joins_decided_late(spark):
    """Joins are planned with exchanges, and become broadcast joins as they run; what is small isn't put together."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "4096", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def test_runs_and_logs_are_written_whole(spark, tmp_path, joins_decided_late):
    """Each run and log by one task, also where a join had dealt the rows by its number."""
    n = 9000
    rows = spark.range(0, n, 1, 6).select((F.col("id") % 3).alias("run_id"), F.format_string("key%05d", "id").cast("binary").alias("key"), F.col("id").alias("seq"))
    rows = rows.withColumn("value", F.col("seq").cast("string").cast("binary"))
    told = run_files.write(rows, f"file://{tmp_path}/plain").collect()
    assert sorted((r.run_id, r.n) for r in told) == [(i, 3000) for i in range(3)]
    got = lookup.run_get(rows.select("key"), [0, 1, 2], run_files.filters(spark, f"file://{tmp_path}/plain"), run_files.blocks(spark, f"file://{tmp_path}/plain"))
    assert got.distinct().count() == n
    rows = rows.join(rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")), "run_id")
    run_files.write(rows, f"file://{tmp_path}/joined")
    for name in ("plain", "joined"):
        assert run_files.read(spark, f"file://{tmp_path}/{name}").distinct().count() == n
    packed = blocks.pack(rows)
    assert packed.agg(F.sum("n")).first()[0] == n and packed.groupBy("run_id", "block_no").count().where("count > 1").count() == 0
    log = rows.select(F.col("run_id").alias("log_no"), F.lit(1).cast("byte").alias("op"), "seq", "key", "value")
    log = log.join(log.groupBy("log_no").agg(F.count(F.lit(1)).alias("n")), "log_no").withColumn("log_no", F.col("log_no").cast("int"))
    log_files.write(log, f"file://{tmp_path}/wal")
    assert log_files.read(spark, f"file://{tmp_path}/wal").distinct().count() == n


def test_get_over_run_files(spark, tmp_path):
    rows, df = _runs(spark)
    folder = f"file://{tmp_path}/sst"
    run_files.write(df, folder)
    keys = [b"key%05d" % i for i in range(720)] + [b"", b"zebra", b"key"]
    asked = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    got = {bytes(r.key): (r.run_id, bytes(r.value)) for r in lookup.run_get(asked, [3, 7], run_files.filters(spark, folder), run_files.blocks(spark, folder)).collect()}
    want = {k: (r, v) for r, k, v in sorted(rows)}
    assert got == {k: (r, v) for k, (r, v) in want.items() if v}


def test_the_filter_of_a_file_is_the_relations(spark, tmp_path):
    rows, df = _runs(spark)
    run_files.write(df, f"file://{tmp_path}/sst")
    words = bloom.words(df, ["run_id"], "key", schema.BLOOM_FPR)
    pick = lambda d: sorted((r.run_id, r.k, r.m, r.word, r.bits) for r in d.select("run_id", "k", "m", "word", "bits").collect())
    assert pick(run_files.filters(spark, f"file://{tmp_path}/sst")) == pick(words)


def test_block_codecs():
    for data in (b"", b"x", b"abc" * 5000, bytes(range(256)) * 3):
        stored = blocks.compress(data)
        assert stored[0] in (blocks.NONE, blocks.SNAPPY) and len(stored) <= len(data) + 1 and blocks.decompress(stored) == data
    assert blocks.decompress(b"\x07abc") is None and blocks.decompress(b"") is None
    assert blocks.decompress(blocks.compress(b"abc" * 5000)[:-2]) is None
