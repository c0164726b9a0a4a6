"""One query for each operator of the engine, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import cli, schema
from tidemark.functions import bloom, encoding, varint
from tidemark.operators import blocks, changelog, lookup, runs
from tidemark.plans import manifest, policy, scratch
from tidemark.sources import files, log_files, run_files
from tidemark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Payload bytes of a run in the queries.
RUN_BYTES = 65536


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.from_events(_table(spark, sf_dir, "events"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files; a single file is one of its folder's."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if files.is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.from_events(_stream(spark, sf_dir, "events"))


def _binary_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log rotated every 4096 changes, keys and values as bytes."""
    op = F.when(F.col("op") == "P", schema.PUT).otherwise(schema.DELETE).cast("byte")
    return _log(spark, sf_dir).select(F.floor(F.col("seq") / 4096).cast("int").alias("log_no"), op.alias("op"), "seq", F.col("k").cast("binary").alias("key"), F.col("v").cast("binary").alias("value"))


def _binary_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("run_id", F.col("k").cast("binary").alias("key"), F.col("v").cast("binary").alias("value"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fully merged runs of _blocks, keys and values as bytes."""
    merged = changelog.latest(_log(spark, sf_dir))
    return merged.select(F.substring("k", 10, 1).cast("long").alias("run_id"), F.col("k").cast("binary").alias("key"), F.col("v").cast("binary").alias("value"))


def _run_files(spark: SparkSession, sf_dir: str, rows: DataFrame) -> str:
    folder = scratch.new_folder(spark, "runs")
    run_files.write(rows, folder)
    return folder


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flush(runs.assign_runs(_log(spark, sf_dir), RUN_BYTES))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fully merged run in cumulative blocks; in the queries a run is the keys of one user digit."""
    merged = changelog.latest(_log(spark, sf_dir)).select("k", "v", F.substring("k", 10, 1).cast("long").alias("run_id"))
    return blocks.cumulative(merged)


# Sources and scans


@query
def changelog_scan(spark, sf_dir):
    return _log(spark, sf_dir)


@query
def ordered_scan(spark, sf_dir):
    return changelog.snapshot(_log(spark, sf_dir)).select("k", "v").orderBy("k")


@query
def recover_log(spark, sf_dir):
    """State after replay of the whole log and its largest sequence number."""
    log = _log(spark, sf_dir)
    return changelog.latest(log).agg(F.count(F.lit(1)).alias("keys"), F.max("seq").alias("max_seq"))


@query
def replay_order(spark, sf_dir):
    log = _log(spark, sf_dir)
    return changelog.replay(log, 100).select("seq", "k", "op", "v")


@query
def recover_prefix(spark, sf_dir):
    """A log damaged at the first change of value over 99.5 keeps what came before."""
    events = _table(spark, sf_dir, "events")
    log = changelog.from_events(events).join(events.select((F.col("event_id") + 1).alias("seq"), (F.col("value") <= 99.5).alias("valid")), "seq")
    return changelog.valid_prefix(log).agg(F.count(F.lit(1)).alias("kept"), F.max("seq").alias("last_seq"))


@query
def log_position(spark, sf_dir):
    """Newest log number, 1 where there is none, from names of files."""
    names = _table(spark, sf_dir, "events").select(F.concat(F.lpad((F.col("event_id") % 37 + 1).cast("string"), 5, "0"), F.lit(".log")).alias("name"))
    number = F.regexp_extract("name", r"(\d+)\.log$", 1).try_cast("int")
    return names.agg(F.coalesce(F.max(number), F.lit(1)).alias("log_no"))


# Writes


@query
def snapshot(spark, sf_dir):
    return changelog.snapshot(_log(spark, sf_dir))


@query
def latest_version(spark, sf_dir):
    return changelog.latest(_log(spark, sf_dir)).select("k", "v", "seq")


@query
def update_alias(spark, sf_dir):
    """A second put of the same key replaces the first, whatever its value."""
    log = _log(spark, sf_dir).where("op = 'P'")
    return changelog.snapshot(log.withColumn("v", F.concat("v", F.lit("!"))).where(F.length("v") > 1)).select("k", "v")


@query
def delete_only(spark, sf_dir):
    """Keys whose newest change is a delete."""
    newest = _log(spark, sf_dir).groupBy("k").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))
    return newest.where("op = 'D'").select("k", "seq")


@query
def put_empty(spark, sf_dir):
    """Keys gone by a put of the empty value, just as by a delete."""
    newest = _log(spark, sf_dir).groupBy("k").agg(F.max_by(F.struct("op", "v"), "seq").alias("n"))
    return newest.where("n.op = 'P' AND n.v = ''").select("k")


@query
def clear(spark, sf_dir):
    """What is visible when all was cleared in the middle of the changes."""
    log = _log(spark, sf_dir)
    middle = log.agg(F.floor(F.max("seq") / 2).alias("cleared"))  # one row
    return changelog.snapshot(log.join(F.broadcast(middle), F.col("seq") > F.col("cleared"))).select("k", "v")


@query
def sequence_numbers(spark, sf_dir):
    """Numbers of a batch in its declared order, from the table's next one on."""
    orders = _table(spark, sf_dir, "orders")
    numbered = runs.running_total(orders.select(F.col("o_orderkey").alias("k")), "k", F.lit(1))
    return numbered.select("k", (F.col("before") + 1).alias("seq"))


@query
def record_bytes(spark, sf_dir):
    """Each change as a log record: length and hexadecimal bytes."""
    log = _log(spark, sf_dir)
    op = F.when(F.col("op") == "P", schema.PUT).otherwise(schema.DELETE)
    data = encoding.record(op, F.col("seq"), F.col("k").cast("binary"), F.col("v").cast("binary"))
    return log.select("seq", F.octet_length(data).alias("n"), F.lower(F.hex(data)).alias("record"))


@query
def record_round_trip(spark, sf_dir):
    log = _log(spark, sf_dir)
    op = F.when(F.col("op") == "P", schema.PUT).otherwise(schema.DELETE)
    parsed = encoding.parse_record(encoding.record(op, F.col("seq"), F.col("k").cast("binary"), F.col("v").cast("binary")))
    return log.select(parsed.alias("r")).select(F.col("r.seq").alias("seq"), F.col("r.op").cast("int").alias("op"), F.col("r.key").cast("string").alias("k"), F.col("r.value").cast("string").alias("v"))


@query
def chunk_count(spark, sf_dir):
    """Chunks of each document's record where it begins a block: op, seq, lengths and an 8-byte key besides the text."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 23) / schema.LOG_MAX_PAYLOAD).alias("chunks"))


@query
def chunk_types(spark, sf_dir):
    """Type and length of every such chunk."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 23).alias("n"))
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / schema.LOG_MAX_PAYLOAD).cast("int")))
    docs = docs.select("doc_id", "n", chunk.alias("chunk_no"))
    length = F.least(F.lit(schema.LOG_MAX_PAYLOAD), F.col("n") - F.col("chunk_no") * schema.LOG_MAX_PAYLOAD)
    kind = encoding.chunk_type(F.col("chunk_no") == 0, (F.col("chunk_no") + 1) * schema.LOG_MAX_PAYLOAD >= F.col("n"))
    return docs.select("doc_id", "chunk_no", kind.cast("int").alias("chunk_type"), length.cast("int").alias("length"))


@query
def chunk_checksums(spark, sf_dir):
    """crc32 of the chunk that each change of the log makes where it fits one."""
    log = _log(spark, sf_dir)
    op = F.when(F.col("op") == "P", schema.PUT).otherwise(schema.DELETE)
    data = encoding.record(op, F.col("seq"), F.col("k").cast("binary"), F.col("v").cast("binary"))
    return log.select("seq", encoding.chunk_crc(F.lit(schema.FULL), data).alias("crc"))


@query
def framed_log(spark, sf_dir):
    """The exact chunks of the log, rotated every 4096 changes."""
    return log_files.framed(_binary_log(spark, sf_dir)).select("log_no", "chunk_no", "offset", F.col("chunk_type").cast("int").alias("chunk_type"), "length", "crc")


@query
def log_file_sizes(spark, sf_dir):
    """What is written when the log goes to framed files."""
    return log_files.write(_binary_log(spark, sf_dir), scratch.new_folder(spark, "logs"))


@query
def log_file_scan(spark, sf_dir):
    """The log read back from its framed files."""
    folder = scratch.new_folder(spark, "logs")
    log_files.write(_binary_log(spark, sf_dir), folder)
    found = log_files.read(spark, folder)
    return found.select("log_no", F.col("op").cast("int").alias("op"), "seq", F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query
def log_rotation(spark, sf_dir):
    """Changes in each log of a bounded size, and which logs a flush up to change 5000 frees."""
    logs = runs.running_total(_log(spark, sf_dir), "seq", (F.length("k") + F.length("v")).cast("long")).withColumn("log_no", (F.floor(F.col("before") / 32768) + 1).cast("long"))
    return logs.groupBy("log_no").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"), (F.max("seq") <= 5000).alias("freed"))


# Lookups


@query
def point_get(spark, sf_dir):
    log = _log(spark, sf_dir)
    newest = changelog.latest(log)
    # The smallest key that is live, so that the answer isn't empty at any scale.
    key = changelog.live(newest).agg(F.min("k")).first()[0]
    return lookup.get(log, key, [F.desc("seq")]).select("k", "v")


@query
def get_deleted(spark, sf_dir):
    """A get of the first deleted key finds its tombstone, and so nothing: what versions there are and what is answered."""
    log = _log(spark, sf_dir)
    key = changelog.latest(log).where("v = ''").agg(F.min("k")).first()[0]
    answers = lookup.get(log, key, [F.desc("seq")]).groupBy("k").agg(F.count(F.lit(1)).alias("answers"))
    versions = log.where(F.col("k") == F.lit(key)).groupBy("k").agg(F.count(F.lit(1)).alias("versions"), F.max_by("op", "seq").alias("last_op"))
    return versions.join(answers, "k", "left").select("k", "versions", "last_op", F.coalesce("answers", F.lit(0)).cast("long").alias("answers"))


@query
def multi_get(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer")
    keys = customers.select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit(":"), (F.col("c_custkey") % 10).cast("string")).alias("k"))
    return lookup.multi_get(keys, changelog.snapshot(_log(spark, sf_dir)).select("k", "v"))


def _asked(spark, sf_dir):
    """Keys of even users and one that none has."""
    log = _log(spark, sf_dir)
    return log.select(F.concat(F.col("k"), F.when(F.col("seq") % 2 == 0, "").otherwise("x")).alias("k")).distinct()


@query
def existing_keys(spark, sf_dir):
    return lookup.existing(_asked(spark, sf_dir), changelog.snapshot(_log(spark, sf_dir)))


@query
def missing_keys(spark, sf_dir):
    return lookup.missing(_asked(spark, sf_dir), changelog.snapshot(_log(spark, sf_dir)))


@query
def range_scan(spark, sf_dir):
    return lookup.between(changelog.snapshot(_log(spark, sf_dir)), "user:00010", "user:00050").select("k", "v")


@query
def prefix_scan(spark, sf_dir):
    return lookup.starting_with(changelog.snapshot(_log(spark, sf_dir)), "user:0001").select("k", "v")


@query
def lower_bound(spark, sf_dir):
    return lookup.lower_bound(changelog.latest(_log(spark, sf_dir)), "user:00020").select("k", "v")


@query
def index_seek(spark, sf_dir):
    """The block of its run that may hold each key of the log and one just behind it."""
    rows = _blocks(spark, sf_dir)
    probes = rows.select("run_id", "k").unionByName(rows.select("run_id", F.concat("k", F.lit("~")).alias("k")))
    return lookup.index_seek(probes, blocks.index(rows), "run_id", "k", "last_k")


@query
def run_lookup(spark, sf_dir):
    """A get over runs: the newest run that has the key answers, a tombstone ends it."""
    held = _runs(spark, sf_dir)
    newest = held.groupBy("k").agg(F.max_by(F.struct("run_id", "v"), "run_id").alias("n"))
    return newest.where("n.v <> ''").select("k", F.col("n.run_id").alias("run_id"), F.col("n.v").alias("v"))


@query
def filtered_get(spark, sf_dir):
    """A get of every key of the log and of one behind it over run files, by filter, index and block."""
    folder = _run_files(spark, sf_dir, _binary_runs(spark, sf_dir))
    held = scratch.materialize(run_files.blocks(spark, folder), "blocks")
    run_ids = [r[0] for r in held.select("run_id").distinct().collect()]  # as many as the manifest names
    log = _log(spark, sf_dir)
    keys = log.select(F.explode(F.array(F.col("k").cast("binary"), F.concat("k", F.lit("x")).cast("binary"))).alias("key"))
    found = lookup.run_get(keys, run_ids, run_files.filters(spark, folder), held)
    return found.select(F.col("key").cast("string").alias("k"), "run_id", F.col("value").cast("string").alias("v"))


@query
def block_search(spark, sf_dir):
    """Each key of the log and one just before it looked for in the exact block that may hold it."""
    packed = scratch.materialize(blocks.pack(_merged(spark, sf_dir)), "packed")
    keys = _merged(spark, sf_dir).select("run_id", "key")
    before = keys.select("run_id", F.expr("substring(key, 1, octet_length(key) - 1)").alias("key")).distinct()
    places = lookup.index_seek(keys.unionByName(before), packed, "run_id", "key", "last_key")
    found = blocks.search(places, packed)
    return found.select("run_id", F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query
def as_of(spark, sf_dir):
    return changelog.as_of(_log(spark, sf_dir), 700).select("k", "v", "seq")


# Runs and merging


@query
def run_assignment(spark, sf_dir):
    return runs.assign_runs(_log(spark, sf_dir), RUN_BYTES).select("seq", "run_id")


@query
def flush_decision(spark, sf_dir):
    """Whether a buffer of 4 MiB would have to be flushed, counting overwritten versions too."""
    size = F.sum(F.length("k") + F.length("v")).cast("long")
    return _log(spark, sf_dir).agg(size.alias("bytes"), (size >= schema.BUFFER_BYTES).alias("due"))


@query
def flushed_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", "k", "v")


@query
def run_file_scan(spark, sf_dir):
    """The runs read back from run files."""
    found = run_files.read(spark, _run_files(spark, sf_dir, _binary_runs(spark, sf_dir)))
    return found.select("run_id", F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query
def run_file_index(spark, sf_dir):
    """Blocks of the merged runs' files: last key, entries' bytes before compression, and whether they are stored without a gap."""
    held = run_files.blocks(spark, _run_files(spark, sf_dir, _merged(spark, sf_dir)))
    order = Window.partitionBy("run_id").orderBy("block_no")
    gap = F.col("offset") - F.coalesce(F.lag(F.col("offset") + F.col("size")).over(order), F.lit(0))
    return held.select("run_id", "block_no", F.col("last_key").cast("string").alias("last_k"), F.octet_length("data").alias("bytes"), gap.alias("gap"))


@query
def run_stats(spark, sf_dir):
    return runs.statistics(_runs(spark, sf_dir))


@query
def run_overlap(spark, sf_dir):
    return runs.overlaps(runs.statistics(_runs(spark, sf_dir)))


@query
def amplification(spark, sf_dir):
    return runs.amplification(_log(spark, sf_dir), _runs(spark, sf_dir))


@query
def compacted_run(spark, sf_dir):
    """One run of all runs: the newest version of each key, tombstones kept."""
    held = _runs(spark, sf_dir)
    return runs.merge([held], "k", "v", ["run_id"]).select("k", "v", "run_id")


@query
def compacted_bottom(spark, sf_dir):
    """The same at the last level, where tombstones may go."""
    return changelog.live(runs.merge([_runs(spark, sf_dir)], "k", "v", ["run_id"])).select("k", "v")


@query
def distinct_keys(spark, sf_dir):
    return _log(spark, sf_dir).agg(F.countDistinct("k").alias("keys"), F.max("seq").alias("max_seq"), F.sum(F.length("k") + F.length("v")).cast("long").alias("bytes"))


# Manifest and policy


def _edits(spark, sf_dir) -> DataFrame:
    """Edits of a table whose runs move from level 0 to 1 when their number divides by 3, and are added again by 7."""
    ids = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("run_id"))
    add = ids.select((F.col("run_id") * 10).alias("edit_no"), F.lit(schema.ADD).cast("byte").alias("tag"), F.lit(0).alias("level"), "run_id")
    up = ids.where("run_id % 3 = 0").select((F.col("run_id") * 10 + 1).alias("edit_no"), F.lit(schema.ADD).cast("byte").alias("tag"), F.lit(1).alias("level"), "run_id")
    gone = ids.where("run_id % 3 = 0").select((F.col("run_id") * 10 + 2).alias("edit_no"), F.lit(schema.REMOVE).cast("byte").alias("tag"), F.lit(0).alias("level"), "run_id")
    again = ids.where("run_id % 21 = 0").select((F.col("run_id") * 10 + 3).alias("edit_no"), F.lit(schema.ADD).cast("byte").alias("tag"), F.lit(0).alias("level"), "run_id")
    odd = ids.where("run_id % 5 = 0").select((F.col("run_id") * 10 + 4).alias("edit_no"), F.lit(9).cast("byte").alias("tag"), F.lit(0).alias("level"), "run_id")
    return add.unionByName(up).unionByName(gone).unionByName(again).unionByName(odd)


@query
def manifest_live(spark, sf_dir):
    return manifest.live(_edits(spark, sf_dir))


@query
def manifest_bytes(spark, sf_dir):
    return manifest.encode(_edits(spark, sf_dir)).select("edit_no", F.lower(F.hex("data")).alias("data"))


@query
def manifest_decoded(spark, sf_dir):
    found = manifest.decode(manifest.encode(_edits(spark, sf_dir)))
    return found.select("edit_no", F.col("tag").cast("int").alias("tag"), "level", "run_id")


@query
def merge_edits(spark, sf_dir):
    """What a merge of the first level's runs commits."""
    live = manifest.live(_edits(spark, sf_dir))
    return manifest.merge_edits(live, 1, 10**6)


@query
def search_order(spark, sf_dir):
    """Live runs in the order in which a get goes through them."""
    order = Window.partitionBy("level").orderBy(F.desc("run_id"))
    return manifest.live(_edits(spark, sf_dir)).withColumn("place", F.row_number().over(order))


@query
def level_policy(spark, sf_dir):
    """Levels made of the suppliers' nations' parts: which are over their limit."""
    lines = _table(spark, sf_dir, "lineitem")
    held = lines.groupBy((F.col("l_linenumber") - 1).alias("level")).agg(F.countDistinct("l_suppkey").alias("runs"), (F.sum(F.col("l_quantity").cast("long")) * 100).alias("bytes"))
    return policy.due(held)


# Blocks


@query
def block_index(spark, sf_dir):
    return blocks.offsets(blocks.index(_blocks(spark, sf_dir)))


@query
def block_prefixes(spark, sf_dir):
    return blocks.prefixes(_blocks(spark, sf_dir)).select("run_id", "k", "prev_k", "place", "is_restart", "shared")


@query
def restart_points(spark, sf_dir):
    """Restart points of each block and where they stand in it."""
    rows = blocks.entry_bytes(blocks.prefixes(_blocks(spark, sf_dir)))
    before = Window.partitionBy("run_id", "block_no").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("entry_bytes").over(before), F.lit(0)).cast("long"))
    return rows.where("is_restart").select("run_id", "block_no", "k", "offset")


@query
def packed_blocks(spark, sf_dir):
    """Exact blocks with their bytes' crc32."""
    packed = blocks.pack(_merged(spark, sf_dir))
    return packed.select("run_id", "block_no", "n", F.col("first_key").cast("string").alias("first_k"), F.col("last_key").cast("string").alias("last_k"), F.octet_length("data").alias("bytes"), F.crc32("data").alias("crc"))


@query
def unpacked_blocks(spark, sf_dir):
    """The rows read back from exact blocks."""
    found = blocks.unpack(blocks.pack(_merged(spark, sf_dir)))
    return found.select("run_id", F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query
def cache_hits(spark, sf_dir):
    """Accesses of each event type's own cache of 100 users' blocks."""
    events = _table(spark, sf_dir, "events")
    accesses = events.select("event_type", F.col("event_id").alias("at"), F.floor(F.col("user_id") / 8).alias("block"))
    hits = blocks.cache_hits(accesses, schema.CACHE_BLOCKS, by="event_type")
    return hits.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))


# Functions


@query
def varint_length(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", varint.length(F.col("n_chars")).alias("n"))


@query
def varint_bytes(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    data = varint.encode(F.col("n_chars"))
    return docs.select("doc_id", F.lower(F.hex(data)).alias("data"), varint.decode(data).alias("value"))


@query
def varint32(spark, sf_dir):
    """32-bit integers encoded and decoded, cut off by a byte, and with bytes of a longer one before them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.pmod(F.col("n_chars") * 40503 * 65537, F.lit(1 << 32)).alias("x"))
    data = varint.encode(F.col("x"))
    cut = F.substring(data, F.lit(1), F.octet_length(data) - 1)
    long = F.concat(F.unhex(F.lit("8080808080")), data)
    return docs.select("doc_id", F.lower(F.hex(data)).alias("data"), varint.decode(data, 32).alias("value"), varint.decode(cut, 32).alias("cut"), varint.decode(long, 32).alias("too_long"))


@query
def bloom_sizing(spark, sf_dir):
    """Filters for as many members as each nation has customers, at three rates."""
    counts = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rates = counts.withColumn("p", F.explode(F.array(F.lit(0.1), F.lit(0.01), F.lit(0.001))))
    k, m = bloom.parameter_columns(F.col("n"), F.col("p"))
    return rates.select("c_nationkey", "n", "p", k.alias("k"), m.alias("m"))


@query
def bloom_members(spark, sf_dir):
    """How many members of each run its filter holds: all of them."""
    held = _runs(spark, sf_dir).select("run_id", F.col("k").alias("key"))
    found = bloom.passes(held, bloom.words(held, ["run_id"], "key", schema.BLOOM_FPR, "md5"), ["run_id"], "key", "md5")
    return found.groupBy("run_id").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("passes").cast("long")).alias("hits"))


@query
def bloom_false_positives(spark, sf_dir):
    """How many of as many other keys each run's filter lets pass."""
    held = _runs(spark, sf_dir).select("run_id", F.col("k").alias("key"))
    probes = held.withColumn("key", F.concat("key", F.lit("?")))
    found = bloom.passes(probes, bloom.words(held, ["run_id"], "key", schema.BLOOM_FPR, "md5"), ["run_id"], "key", "md5")
    return found.groupBy("run_id").agg(F.count(F.lit(1)).alias("probes"), F.sum(F.col("passes").cast("long")).alias("passed"))


@query
def bloom_bytes(spark, sf_dir):
    """Each run's filter as bytes: their length and md5, and the bits that are set in them when they are read again."""
    held = _runs(spark, sf_dir).select("run_id", F.col("k").alias("key"))
    data = bloom.encoded(bloom.words(held, ["run_id"], "key", schema.BLOOM_FPR, "md5"), ["run_id"])
    bits = bloom.decoded(data, ["run_id"]).groupBy("run_id").agg(F.sum(F.bit_count("bits")).cast("long").alias("bits"))
    return data.join(bits, "run_id").select("run_id", F.octet_length("data").cast("long").alias("bytes"), F.md5("data").alias("md5"), "bits")


@query
def lossy_text(spark, sf_dir):
    """Text of values cut inside a character; null values have none."""
    docs = _table(spark, sf_dir, "documents")
    text = encoding.text(F.concat(F.col("text").cast("binary"), F.unhex(F.lit("C3"))))
    return docs.select("doc_id", F.char_length(text).cast("long").alias("n"), F.md5(text.cast("binary")).alias("md5"))


# Commands


@query
def commands(spark, sf_dir):
    """Answers of a script that sets, reads and deletes by the events, with one clear in it."""
    events = _table(spark, sf_dir, "events")
    key = (F.col("user_id") % 50).cast("string")
    line = (
        F.when(F.col("event_id") == 500, "CLEAR")
        .when(F.col("event_type") == "error", F.concat(F.lit("rm k"), key))
        .when(F.col("event_type") == "view", F.concat(F.lit("get k"), key))
        .otherwise(F.concat(F.lit("  Put k"), key, F.lit(" a b "), F.col("event_id").cast("string")))
    )
    return cli.run_script(events.select(F.col("event_id").alias("line_no"), line.alias("line")))


@query
def command_parse(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    text = F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "  x y").otherwise(""))
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("SET "), text)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("get "), text)).otherwise(text)
    return events.select("event_id", cli.parse(line).alias("c")).select("event_id", "c.command", "c.key", "c.value")


# Streams


@query
def stream_latest(spark, sf_dir):
    """What the aggregate of a stream of changes has told last of each key."""
    told = ingest.drained(ingest.latest(_log_stream(spark, sf_dir)))
    return told.groupBy("k").agg(F.max_by("v", "batch").alias("v"), F.max("seq").alias("seq"))


@query
def stream_live(spark, sf_dir):
    """The keys that are live after the last change that the stateful stream has told."""
    told = ingest.drained(ingest.live_changes(_log_stream(spark, sf_dir)))
    newest = told.groupBy("k").agg(F.max_by(F.struct("v", "live"), "seq").alias("n"), F.max("seq").alias("seq"))
    return newest.where("n.live").select("k", F.col("n.v").alias("v"), "seq")


@query
def stream_table(spark, sf_dir):
    """A table that a stream of changes was written to, flushed and merged once."""
    from tidemark.table import Table

    folder = scratch.new_folder(spark, "table")
    table = Table(spark, f"{folder}/db", l0_runs=1)
    op = F.when(F.col("op") == "P", schema.PUT).otherwise(schema.DELETE).cast("byte")
    changes = _log_stream(spark, sf_dir).select(F.col("k").alias("key"), F.col("v").alias("value"), op.alias("op"), "seq")
    ingest.into_table(changes, table, f"{folder}/checkpoint").awaitTermination()
    table.flush()
    table.compact()
    return table.snapshot().select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query
def event_windows(spark, sf_dir):
    """Windows over the stream of events, as they were told last."""
    told = ingest.drained(ingest.event_windows(_stream(spark, sf_dir, "events")))
    return told.groupBy("start", "event_type").agg(F.max("n").alias("n"), F.round(F.max_by("total", "batch"), 4).alias("total"))
