import pytest
from pyspark.sql import functions as F

from tidemark import cli, schema
from tidemark.plans import manifest
from tidemark.streaming import ingest
from tidemark.table import Table


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/db"


def _batch(spark, n, prefix="key_", value="val_", step=1):
    rows = spark.range(0, n, step)
    name = lambda p: F.concat(F.lit(p), F.lpad(F.col("id").cast("string"), 4, "0"))
    return rows.select("id", name(prefix).alias("key"), name(value).alias("value"))


def test_hero(spark, root):
    t = Table(spark, root)
    t.put("hero", "batman")
    assert t.get("hero") == b"batman"
    t.update("hero", "superman")
    assert t.get("hero") == b"superman"
    t.remove("hero")
    assert t.get("hero") is None
    t.remove("never")
    t.put("", "x")
    t.put("e", "")
    assert t.get("") == b"x" and t.get("e") is None


def test_reopen_replays_the_log(spark, root):
    Table(spark, root).put_batch(_batch(spark, 100), "id")
    t = Table(spark, root)
    assert t.get("key_0050") == b"val_0050" and t.get("key_9999") is None and t.state.next_seq == 101


def test_flush_compact_and_reopen(spark, root):
    t = Table(spark, root, l0_runs=2)
    t.put_batch(_batch(spark, 300), "id")
    t.flush()
    t.write([(schema.DELETE, "key_0007", b""), (schema.PUT, "key_0008", "new")])
    t.flush()
    assert t.levels().first().runs == 2
    t.compact()
    assert [r["level"] for r in t.state.runs] == [1]
    t = Table(spark, root, l0_runs=2)
    assert t.get("key_0007") is None and t.get("key_0008") == b"new" and t.snapshot().count() == 299
    t.put("key_0007", "back")
    t.flush()
    assert t.get("key_0007") == b"back"
    asked = spark.createDataFrame([("key_0007",), ("key_0299",), ("no",)], "key string")
    assert {bytes(r.key): r.value and bytes(r.value) for r in t.multi_get(asked).collect()} == {b"key_0007": b"back", b"key_0299": b"val_0299", b"no": None}
    assert [bytes(r.key) for r in t.scan("key_0298").collect()] == [b"key_0298", b"key_0299"]


def test_newest_of_overlapping_runs_wins_after_reopen(spark, root):
    t = Table(spark, root, l0_runs=1, l1_bytes=1 << 40)
    for value in ("old", "mid", "new"):
        t.put("k", value)
        t.flush()
        t.merge_level(0)
    assert [r["level"] for r in t.state.runs] == [1, 1, 1]
    t = Table(spark, root)
    assert t.get("k") == b"new"
    t.merge_level(1)
    assert Table(spark, root).get("k") == b"new"


def test_tombstones_stay_until_the_bottom(spark, root):
    t = Table(spark, root)
    t.put("k", "v")
    t.flush()
    t.merge_level(0)
    t.remove("k")
    t.flush()
    t.merge_level(0, drop_tombstones=True)  # an older run still holds k
    assert t.get("k") is None
    t.merge_level(1, drop_tombstones=True)
    assert t.get("k") is None and t.versions().count() == 0


def test_automatic_flush(spark, root):
    t = Table(spark, root, buffer_bytes=1000)
    t.put_batch(_batch(spark, 10), "id")
    assert not t.state.runs
    t.put_batch(_batch(spark, 200), "id")
    assert t.state.runs and not t.state.logs


def test_order_in_a_batch(spark, root):
    t = Table(spark, root)
    rows = spark.createDataFrame([(2, "k", "last"), (0, "k", "first"), (1, "k", "second")], "n long, key string, value string")
    t.put_batch(rows, "n")
    assert t.get("k") == b"last"


def test_clear(spark, root):
    t = Table(spark, root)
    t.put_batch(_batch(spark, 20), "id")
    t.flush()
    t.put("x", "1")
    before = t.state.next_seq
    t.clear()
    assert t.snapshot().count() == 0 and Table(spark, root).snapshot().count() == 0 and t.state.next_seq == before
    t.put("x", "2")
    assert Table(spark, root).get("x") == b"2"


def test_a_commit_that_was_overtaken_is_refused(spark, root):
    a, b = Table(spark, root), Table(spark, root)
    a.put("k", "a")
    with pytest.raises(manifest.Conflict):
        b.put("k", "b")
    assert b.get("k") == b"a"


def test_vacuum_deletes_what_no_commit_names(spark, root):
    t = Table(spark, root)
    t.put("k", "v")
    _batch(spark, 3).select(F.lit(1).cast("byte").alias("op"), F.col("id").alias("seq"), F.col("key").cast("binary"), F.col("value").cast("binary")).write.parquet(f"{root}/log/log_no=99")
    assert Table(spark, root).snapshot().count() == 1
    assert t.vacuum() == [] and len(t.vacuum(older_than=0)) == 1 and t.get("k") == b"v"


def test_vacuum_of_a_stale_handle_spares_what_others_have_committed(spark, root):
    a, b = Table(spark, root), Table(spark, root)
    a.put("a", "1")
    b.refresh()
    b.put("b", "2")
    assert a.state.version == 1  # stale
    assert a.vacuum(older_than=0) == []
    assert sorted(bytes(r.key) for r in Table(spark, root).snapshot().collect()) == [b"a", b"b"]
    assert len(manifest.versions(spark, root)) == 1


def test_a_handle_reads_what_others_commit(spark, root):
    a, b = Table(spark, root), Table(spark, root)
    a.put("k", "1")
    assert b.get("k") == b"1"
    b.put("k", "2")
    assert a.get("k") == b"2"


@pytest.mark.parametrize("linked", [True, False])
def test_a_dead_writers_claim_blocks_no_one(spark, root, tmp_path, monkeypatch, linked):
    from tidemark.sources import files

    monkeypatch.setattr(files, "LINKED", {"file"} if linked else set())
    t = Table(spark, root)
    t.put("k", "1")
    claim = tmp_path / "db" / "_manifest" / f"{2:012d}.json.claim"
    claim.write_text("a writer that died")
    if not linked:
        with pytest.raises(manifest.Conflict):  # it may be alive still
            t.put("k", "2")
        monkeypatch.setattr(files, "CLAIM_SECONDS", 0.0)
    t.put("k", "2")
    assert Table(spark, root).get("k") == b"2" and t.state.version == 2
    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, t.root, manifest.State(version=1))
    assert not list((tmp_path / "db" / "_manifest").glob("*.part")) and (linked or not claim.exists())


def test_manifest_stays_small(spark, root):
    t = Table(spark, root)
    for i in range(3):
        t.put_batch(_batch(spark, 2), "id", batch_id=f"in-{i}")
    t.put_batch(_batch(spark, 2, value="again_"), "id", batch_id="in-1")  # a repeated batch is left out
    assert t.state.batches == {"in": 2} and sum(t.state.logs.values()) == 3 * 2 * 16 and t.get("key_0001") == b"val_0001"


def test_unsynced_changes_are_the_handles_own_until_a_commit(spark, root):
    t = Table(spark, root, sync=False)
    t.put("a", "1")
    t.put("a", "2")
    t.remove("b")
    assert t.get("a") == b"2" and t.state.version == 0 and Table(spark, root).get("a") is None
    t.sync_log()
    assert Table(spark, root).get("a") == b"2" and t.state.version == 1 and t.state.next_seq == 4
    t.put("c", "3")
    t.flush()
    assert Table(spark, root).get("c") == b"3" and not t.state.logs


def test_flush_in_the_background(spark, root):
    t = Table(spark, root, buffer_bytes=200, background=True)
    for i in range(4):
        t.put_batch(_batch(spark, 20, prefix=f"k{i}_"), "id")
    t.wait()
    assert t.snapshot().count() == 80 and t.state.runs and sum(t.state.logs.values()) < 2 * 20 * 15
    t.flush()
    assert Table(spark, root).snapshot().count() == 80 and not t.state.logs


def test_missing_run_is_an_error(spark, root):
    from tidemark.sources import files

    t = Table(spark, root)
    t.put("k", "v")
    t.flush()
    files.delete(spark, t._run(t.state.runs[0]))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        t.get("k")


def test_long_and_null_keys_are_refused(spark, root):
    t = Table(spark, root)
    t.put("k" * 65535, "v")
    assert t.get("k" * 65535) == b"v"
    with pytest.raises(Exception, match="65535"):
        t.put("k" * 65536, "v")


def test_commands(spark, root):
    t = Table(spark, root)
    assert cli.execute(t, "  PUT a b c  ").startswith("OK a")
    assert cli.execute(t, "get a extra").startswith("a → b c")
    assert cli.execute(t, "put a").startswith("usage") and cli.execute(t, "get").startswith("usage")
    assert cli.execute(t, "del a").startswith("OK") and cli.execute(t, "get a") == "(nil)"
    assert cli.execute(t, "nope").startswith("no such command: nope")
    assert cli.execute(t, "clear", lambda _: "n") == "Nothing was removed." and cli.execute(t, "clear", lambda _: "Y") == "All rows are removed."
    assert cli.execute(t, "") == "" and cli.execute(t, "quit") is None and "delete KEY" in cli.execute(t, "help")


def test_script(spark):
    lines = ["put a 1", "get a", "", "rm a", "get a", "set a  2 ", "get a", "clear", "get a", "put  x", "get ", "exit", "get a"]
    script = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    found = {r.line_no: r.value for r in cli.run_script(script).collect()}
    assert found == {1: "1", 4: None, 6: " 2", 8: None}


def test_stream_into_table(spark, root, tmp_path):
    folder = str(tmp_path / "in")
    _batch(spark, 50).withColumnRenamed("id", "seq").coalesce(1).write.parquet(folder)
    t = Table(spark, root)
    stream = spark.readStream.schema("seq long, key string, value string").parquet(folder)
    for _ in range(2):  # nothing new the second time
        ingest.into_table(stream, t, str(tmp_path / "cp")).awaitTermination()
    assert Table(spark, root).snapshot().count() == 50
    t.put_batch(_batch(spark, 5, value="again_"), "id", batch_id="ingest-0")  # a repeated batch is left out
    assert t.get("key_0001") == b"val_0001"


def test_stateful_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema_ = "k string, seq long, v string"
    for rows in ([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], [("a", 2, "late"), ("b", 4, "")]):
        spark.createDataFrame(rows, schema_).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).parquet(folder)
    got = []
    query = ingest.live_changes(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {k: (v, s, live) for k, v, s, live in sorted(got, key=lambda r: r[2])}
    assert last == {"a": ("z", 3, True), "b": ("", 4, False)}


def test_stateful_stream_tells_only_newer_versions(spark, tmp_path):
    """By batch: changes that come late or again tell nothing, and no key is stepped through in Python."""
    folder = str(tmp_path / "in")
    schema_ = "k string, seq long, v string"
    files = [[("a", 3, "z"), ("a", 1, "x"), ("b", 2, "")], [("a", 2, "late"), ("a", 3, "z"), ("c", 1, "w")], [("a", 5, ""), ("b", 1, "late")]]
    for rows in files:
        spark.createDataFrame(rows, schema_).coalesce(1).write.mode("append").parquet(folder)
    stream = ingest.live_changes(spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).parquet(folder))
    assert "InPandas" not in stream._jdf.queryExecution().logical().toString()
    got = []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: got.extend((n, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(got) == [(0, "a", "z", 3, True), (0, "b", "", 2, False), (1, "c", "w", 1, True), (2, "a", "", 5, False)]


def test_prompt(spark, tmp_path, monkeypatch, capsys):
    """The folder is an argument, the banner names it, and an error or the input's end doesn't break the prompt."""
    folder = str(tmp_path / "db")
    lines = iter(["put a 1", "get a", "", "put " + "k" * 70_000 + " v", "help", "nope", "delete a", "get a"])

    def read(prompt):
        assert prompt == "tidemark> "
        if (line := next(lines, None)) is None:
            raise EOFError
        return line

    monkeypatch.setattr("builtins.input", read)
    cli.main([folder])
    said = capsys.readouterr().out
    assert folder in said.splitlines()[0] and "a → 1" in said and "error: " in said and "(nil)" in said and "no such command: nope" in said
    lines = iter(["exit", "get a"])
    cli.main([folder])
    assert next(lines) == "get a"
