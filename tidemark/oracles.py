"""DuckDB SQL for the engine's queries, over the same tables."""

from __future__ import annotations

LOG = """log AS (
  SELECT event_id + 1 AS seq,
         'user:' || lpad(CAST(user_id AS VARCHAR), 5, '0') || ':' || regexp_replace(props, '[^0-9]', '', 'g') AS k,
         CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op,
         CASE WHEN event_type = 'error' OR (event_type = 'view' AND value < 5) THEN '' ELSE event_type || '|' || props END AS v
  FROM events)"""
NEWEST = LOG + ", newest AS (SELECT k, arg_max(v, seq) AS v, max(seq) AS seq FROM log GROUP BY k)"
SNAP = NEWEST + ", snap AS (SELECT * FROM newest WHERE v <> '')"
SIZED = LOG + ", sized AS (SELECT *, coalesce(sum(length(k) + length(v)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM log)"
RUNS = SIZED + """, assigned AS (SELECT *, CAST(before // 65536 AS BIGINT) AS run_id FROM sized),
runs AS (SELECT run_id, k, arg_max(v, seq) AS v, max(seq) AS seq FROM assigned GROUP BY run_id, k)"""
STATS = RUNS + """, stats AS (SELECT run_id, count(*) AS n, min(k) AS lo, max(k) AS hi,
  CAST(sum(CASE WHEN v = '' THEN 1 ELSE 0 END) AS BIGINT) AS tombstones, CAST(sum(length(k) + length(v)) AS BIGINT) AS bytes FROM runs GROUP BY run_id)"""
BLOCKS = NEWEST + """, held AS (SELECT CAST(substr(k, 10, 1) AS BIGINT) AS run_id, k, v FROM newest),
blocks AS (SELECT *, CAST(coalesce(sum(length(k) + length(v)) OVER (PARTITION BY run_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4096 AS BIGINT) AS block_no FROM held),
idx AS (SELECT run_id, block_no, min(k) AS first_k, max(k) AS last_k, count(*) AS n, CAST(sum(length(k) + length(v)) AS BIGINT) AS bytes FROM blocks GROUP BY run_id, block_no)"""
PREFIX = BLOCKS + """, placed AS (SELECT run_id, block_no, k, v, row_number() OVER w - 1 AS place, lag(k) OVER w AS prev_k FROM blocks WINDOW w AS (PARTITION BY run_id, block_no ORDER BY k)),
prefixes AS (SELECT *, place % 16 = 0 AS is_restart, CAST(CASE WHEN place % 16 = 0 OR prev_k IS NULL THEN 0
  ELSE coalesce(list_position(list_transform(range(1, least(length(prev_k), length(k)) + 1), lambda i: substr(prev_k, CAST(i AS BIGINT), 1) = substr(k, CAST(i AS BIGINT), 1)), false) - 1, least(length(prev_k), length(k))) END AS INTEGER) AS shared FROM placed)"""
EDITS = """edits AS (
  SELECT CAST(o_orderkey AS BIGINT) * 10 AS edit_no, 1 AS tag, 0 AS level, CAST(o_orderkey AS BIGINT) AS run_id FROM orders
  UNION ALL SELECT o_orderkey * 10 + 1, 1, 1, o_orderkey FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey * 10 + 2, 2, 0, o_orderkey FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey * 10 + 3, 1, 0, o_orderkey FROM orders WHERE o_orderkey % 21 = 0
  UNION ALL SELECT o_orderkey * 10 + 4, 9, 0, o_orderkey FROM orders WHERE o_orderkey % 5 = 0)"""
LIVE = EDITS + ", live AS (SELECT level, run_id FROM (SELECT level, run_id, arg_max(tag, edit_no) AS tag FROM edits WHERE tag IN (1, 2) GROUP BY level, run_id) WHERE tag = 1)"
ASKED = "asked AS (SELECT DISTINCT k || CASE WHEN seq % 2 = 0 THEN '' ELSE 'x' END AS k FROM log)"


def _le(value: str, width: int) -> str:
    """SQL for the hexadecimal digits of an integer, its lowest byte first."""
    return " || ".join(f"lpad(to_hex(({value} >> {8 * i}) & 255), 2, '0')" for i in range(width))


RECORD = f"""records AS (SELECT seq, lower({_le("CASE WHEN op = 'P' THEN 1 ELSE 2 END", 1)} || {_le("seq", 8)} || {_le("strlen(k)", 2)} || hex(encode(k)) || {_le("strlen(v)", 4)} || hex(encode(v))) AS record FROM log)"""


def _leb(value: str) -> str:
    """SQL for the bytes that a varint takes."""
    return "CASE " + " ".join(f"WHEN {value} < {1 << 7 * n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"


def _leb_hex(value: str) -> str:
    parts = [f"CASE WHEN {_leb(value)} > {i} THEN lpad(to_hex((({value} >> {7 * i}) & 127) + CASE WHEN {_leb(value)} > {i + 1} THEN 128 ELSE 0 END), 2, '0') ELSE '' END" for i in range(5)]
    return f"lower({' || '.join(parts)})"


#: The checksum by its table of 256 remainders, a byte at a time.
CRC = "remainders AS MATERIALIZED (SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM (SELECT unnest(range(256)) AS i)))"


def _crc(digits: str) -> str:
    """SQL for the crc32 of hexadecimal digits, beside the table `remainders`."""
    found = f"list_transform(regexp_extract_all({digits}, '..'), lambda p: CAST('0x' || p AS BIGINT))"
    return f"CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {found}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT)"


#: Each row is the next chunk of a log: its record, how much of that is written, whether any is, and where the file ends.
CHUNKS = f"""WITH RECURSIVE {LOG}, {RECORD}, {CRC},
rec AS MATERIALIZED (SELECT CAST(seq // 4096 AS INTEGER) AS log_no, row_number() OVER (PARTITION BY seq // 4096 ORDER BY seq) AS i, record, length(record) // 2 AS n FROM records),
walk AS (
  SELECT log_no, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS done, false AS begun, CAST(0 AS BIGINT) AS pos FROM rec GROUP BY log_no
  UNION ALL
  SELECT log_no, i + CAST(last AS BIGINT), chunk_no + 1, CASE WHEN last THEN 0 ELSE done + len END, NOT last, start + 7 + len FROM (
    SELECT *, done + len >= n AS last FROM (
      SELECT *, least(n - done, room) AS len FROM (
        SELECT w.*, r.n, CASE WHEN 32768 - pos % 32768 < 7 THEN pos + 32768 - pos % 32768 ELSE pos END AS start,
          CASE WHEN 32768 - pos % 32768 < 7 THEN 32768 ELSE 32768 - pos % 32768 END - 7 AS room
        FROM walk w JOIN rec r ON r.log_no = w.log_no AND r.i = w.i)))),
chunks AS (
  SELECT log_no, chunk_no, start AS "offset", CASE WHEN NOT begun AND done + len >= n THEN 1 WHEN NOT begun THEN 2 WHEN done + len >= n THEN 4 ELSE 3 END AS chunk_type, len AS length, substr(record, 2 * done + 1, 2 * len) AS payload FROM (
    SELECT *, least(n - done, room) AS len FROM (
      SELECT w.*, r.n, r.record, CASE WHEN 32768 - pos % 32768 < 7 THEN pos + 32768 - pos % 32768 ELSE pos END AS start,
        CASE WHEN 32768 - pos % 32768 < 7 THEN 32768 ELSE 32768 - pos % 32768 END - 7 AS room
      FROM walk w JOIN rec r ON r.log_no = w.log_no AND r.i = w.i)))"""


def _entry_size(shared: str) -> str:
    return f"({_leb(shared)}) + ({_leb(f'(length(k) - {shared})')}) + ({_leb('length(v)')}) + length(k) - {shared} + length(v)"


#: Exact blocks: each row of `walk` is an entry with its block, its place there and the bytes before it.
PACKED = f"""WITH RECURSIVE {NEWEST.removeprefix("WITH ")}, {CRC},
held AS (SELECT CAST(substr(k, 10, 1) AS BIGINT) AS run_id, k, v FROM newest),
near AS (SELECT *, row_number() OVER w AS i, lag(k) OVER w AS prev FROM held WINDOW w AS (PARTITION BY run_id ORDER BY k)),
entry AS MATERIALIZED (SELECT *, {_entry_size("0")} AS whole, {_entry_size("shared")} AS rest FROM (SELECT *, CAST(CASE WHEN prev IS NULL THEN 0
  ELSE coalesce(list_position(list_transform(range(1, least(length(prev), length(k)) + 1), lambda i: substr(prev, CAST(i AS BIGINT), 1) = substr(k, CAST(i AS BIGINT), 1)), false) - 1, least(length(prev), length(k))) END AS BIGINT) AS shared FROM near)),
walk AS (
  SELECT run_id, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS block_no, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS before FROM entry GROUP BY run_id
  UNION ALL
  SELECT run_id, i + 1, block_no + CAST(after >= 4096 AS BIGINT), CASE WHEN after >= 4096 THEN 0 ELSE place + 1 END, CASE WHEN after >= 4096 THEN 0 ELSE after END
  FROM (SELECT w.*, before + CASE WHEN place % 16 = 0 THEN e.whole ELSE e.rest END AS after FROM walk w JOIN entry e ON e.run_id = w.run_id AND e.i = w.i)),
placed AS (SELECT w.*, e.k, e.v, CASE WHEN place % 16 = 0 THEN 0 ELSE e.shared END AS shared FROM walk w JOIN entry e ON e.run_id = w.run_id AND e.i = w.i),
digits AS (SELECT run_id, block_no, count(*) AS n, min(k) AS first_k, max(k) AS last_k,
  string_agg({_leb_hex("shared")} || {_leb_hex("(length(k) - shared)")} || {_leb_hex("length(v)")} || hex(encode(substr(k, shared + 1))) || hex(encode(v)), '' ORDER BY i)
  || string_agg({_le("before", 4)}, '' ORDER BY i) FILTER (WHERE place % 16 = 0) || {_le("count(*) FILTER (WHERE place % 16 = 0)", 4)} AS data FROM placed GROUP BY run_id, block_no)"""

#: Filters of runs by md5: sizes, the bits of members, and those of other keys.
BLOOM = RUNS + """, counts AS (SELECT run_id, count(*) AS n FROM runs GROUP BY run_id),
wide AS (SELECT *, CAST(ceil(-n * ln(CAST(0.01 AS DOUBLE)) / pow(ln(2.0), 2)) AS BIGINT) AS m FROM counts),
sizes AS (SELECT *, greatest(1, CAST(ceil(CAST(m AS DOUBLE) / n * ln(2.0)) AS BIGINT)) AS hashes FROM wide),
hashed AS (SELECT run_id, key, member, m, hashes, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) AS low, CAST('0x' || substr(md5(key), 9, 8) AS BIGINT) AS high
  FROM (SELECT run_id, k AS key, true AS member FROM runs UNION ALL SELECT run_id, k || '?', false FROM runs) JOIN sizes USING (run_id)),
places AS (SELECT run_id, key, member, m, (low + unnest(range(hashes)) * high) % m AS bit FROM hashed),
bits AS (SELECT DISTINCT run_id, m, bit FROM places WHERE member),
passes AS (SELECT p.run_id, p.key, p.member, bool_and(b.bit IS NOT NULL) AS passes FROM places p LEFT JOIN bits b ON p.run_id = b.run_id AND p.bit = b.bit GROUP BY ALL)"""


ORACLES: dict[str, str] = {
    "changelog_scan": f"WITH {LOG} SELECT seq, k, op, v FROM log",
    "ordered_scan": f"WITH {SNAP} SELECT k, v FROM snap ORDER BY k",
    "recover_log": f"WITH {NEWEST} SELECT count(*) AS keys, max(seq) AS max_seq FROM newest",
    "replay_order": f"WITH {LOG} SELECT seq, k, op, v FROM log WHERE seq > 100 ORDER BY seq",
    "recover_prefix": "SELECT count(*) AS kept, max(event_id + 1) AS last_seq FROM events WHERE event_id < coalesce((SELECT min(event_id) FROM events WHERE value > 99.5), 9223372036854775807)",
    "log_position": "SELECT CAST(coalesce(max(event_id % 37 + 1), 1) AS INTEGER) AS log_no FROM events",
    "snapshot": f"WITH {SNAP} SELECT k, v, seq FROM snap",
    "latest_version": f"WITH {NEWEST} SELECT k, v, seq FROM newest",
    "update_alias": f"WITH {LOG} SELECT k, arg_max(v || '!', seq) AS v FROM log WHERE op = 'P' AND v <> '' GROUP BY k",
    "delete_only": f"WITH {LOG} SELECT k, max(seq) AS seq FROM log GROUP BY k HAVING arg_max(op, seq) = 'D'",
    "put_empty": f"WITH {LOG} SELECT k FROM log GROUP BY k HAVING arg_max(op, seq) = 'P' AND arg_max(v, seq) = ''",
    "clear": f"WITH {LOG}, n AS (SELECT k, arg_max(v, seq) AS v FROM log WHERE seq > (SELECT max(seq) // 2 FROM log) GROUP BY k) SELECT k, v FROM n WHERE v <> ''",
    "sequence_numbers": "SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders",
    "record_bytes": f"WITH {LOG}, {RECORD} SELECT seq, CAST(length(record) // 2 AS INTEGER) AS n, record FROM records",
    "record_round_trip": f"WITH {LOG} SELECT seq, CASE WHEN op = 'P' THEN 1 ELSE 2 END AS op, k, v FROM log",
    "chunk_count": "SELECT doc_id, CAST(ceil((coalesce(strlen(text), 0) + 23) / 32761.0) AS BIGINT) AS chunks FROM documents",
    "chunk_types": """WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) + 23 AS n FROM documents),
c AS (SELECT doc_id, n, CAST(unnest(range(0, (n - 1) // 32761 + 1)) AS INTEGER) AS chunk_no FROM d)
SELECT doc_id, chunk_no, CASE WHEN chunk_no = 0 AND n <= 32761 THEN 1 WHEN chunk_no = 0 THEN 2 WHEN (chunk_no + 1) * 32761 >= n THEN 4 ELSE 3 END AS chunk_type,
CAST(least(32761, n - chunk_no * 32761) AS INTEGER) AS length FROM c""",
    "log_rotation": f"WITH {SIZED} SELECT CAST(before // 32768 + 1 AS BIGINT) AS log_no, count(*) AS n, max(seq) AS last_seq, max(seq) <= 5000 AS freed FROM sized GROUP BY 1",
    "point_get": f"WITH {SNAP} SELECT k, v FROM snap ORDER BY k LIMIT 1",
    "get_deleted": f"WITH {SNAP}, asked AS (SELECT min(k) AS k FROM newest WHERE v = '') SELECT l.k, count(*) AS versions, arg_max(l.op, l.seq) AS last_op, (SELECT count(*) FROM snap SEMI JOIN asked USING (k)) AS answers FROM log l SEMI JOIN asked USING (k) GROUP BY l.k",
    "multi_get": f"WITH {SNAP}, asked AS (SELECT DISTINCT 'user:' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || ':' || CAST(c_custkey % 10 AS VARCHAR) AS k FROM customer) SELECT a.k, s.v FROM asked a LEFT JOIN snap s ON a.k = s.k",
    "existing_keys": f"WITH {SNAP}, {ASKED} SELECT k FROM asked SEMI JOIN snap USING (k)",
    "missing_keys": f"WITH {SNAP}, {ASKED} SELECT k FROM asked ANTI JOIN snap USING (k)",
    "range_scan": f"WITH {SNAP} SELECT k, v FROM snap WHERE k >= 'user:00010' AND k < 'user:00050'",
    "prefix_scan": f"WITH {SNAP} SELECT k, v FROM snap WHERE starts_with(k, 'user:0001')",
    "lower_bound": f"WITH {NEWEST} SELECT k, v FROM newest WHERE k >= 'user:00020' ORDER BY k LIMIT 1",
    "index_seek": f"WITH {BLOCKS}, probes AS (SELECT run_id, k FROM blocks UNION ALL SELECT run_id, k || '~' FROM blocks) SELECT p.run_id, p.k, i.block_no FROM probes p ASOF LEFT JOIN idx i ON p.run_id = i.run_id AND p.k <= i.last_k",
    "run_lookup": f"WITH {RUNS}, top AS (SELECT k, max(run_id) AS run_id, arg_max(v, run_id) AS v FROM runs GROUP BY k) SELECT k, run_id, v FROM top WHERE v <> ''",
    "as_of": f"WITH {LOG}, n AS (SELECT k, arg_max(v, seq) AS v, max(seq) AS seq FROM log WHERE seq <= 700 GROUP BY k) SELECT k, v, seq FROM n WHERE v <> ''",
    "run_assignment": f"WITH {RUNS} SELECT seq, run_id FROM assigned",
    "flush_decision": f"WITH {LOG} SELECT CAST(sum(length(k) + length(v)) AS BIGINT) AS bytes, sum(length(k) + length(v)) >= 4194304 AS due FROM log",
    "flushed_runs": f"WITH {RUNS} SELECT run_id, k, v FROM runs",
    "run_stats": f"WITH {STATS} SELECT * FROM stats",
    "run_overlap": f"WITH {STATS} SELECT x.run_id, (SELECT count(*) FROM stats y WHERE y.run_id <> x.run_id AND x.lo <= y.hi AND y.lo <= x.hi) AS overlaps FROM stats x",
    "amplification": f"WITH {RUNS}, m AS (SELECT k, arg_max(v, seq) AS v FROM runs GROUP BY k) SELECT (SELECT count(*) FROM log) AS writes, (SELECT count(*) FROM runs) AS flushed, count(*) AS retained, count(*) FILTER (WHERE v <> '') AS live FROM m",
    "compacted_run": f"WITH {RUNS} SELECT k, arg_max(v, run_id) AS v, max(run_id) AS run_id FROM runs GROUP BY k",
    "compacted_bottom": f"WITH {SNAP} SELECT k, v FROM snap",
    "distinct_keys": f"WITH {LOG} SELECT count(DISTINCT k) AS keys, max(seq) AS max_seq, CAST(sum(length(k) + length(v)) AS BIGINT) AS bytes FROM log",
    "manifest_live": f"WITH {LIVE} SELECT level, run_id FROM live",
    "manifest_bytes": f"WITH {EDITS} SELECT edit_no, lower({_le('tag', 1)} || {_le('level', 4)} || {_le('run_id', 8)}) AS data FROM edits",
    "manifest_decoded": f"WITH {EDITS} SELECT edit_no, tag, level, run_id FROM edits WHERE tag IN (1, 2)",
    "search_order": f"WITH {LIVE} SELECT level, run_id, CAST(row_number() OVER (PARTITION BY level ORDER BY run_id DESC) AS INTEGER) AS place FROM live",
    "level_policy": """WITH l AS (SELECT l_linenumber - 1 AS level, count(DISTINCT l_suppkey) AS runs, CAST(sum(CAST(l_quantity AS BIGINT)) * 100 AS BIGINT) AS bytes FROM lineitem GROUP BY 1)
SELECT level, runs, bytes, CASE WHEN level = 0 THEN runs >= 4 WHEN level <= 5 THEN bytes > 10485760 * pow(10.0, level - 1) ELSE false END AS due FROM l""",
    "block_index": f"WITH {BLOCKS} SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY run_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM idx",
    "block_prefixes": f"WITH {PREFIX} SELECT run_id, k, prev_k, CAST(place AS INTEGER) AS place, is_restart, shared FROM prefixes",
    "restart_points": f"""WITH {PREFIX}, e AS (SELECT *, ({_leb("shared")}) + ({_leb("(length(k) - shared)")}) + ({_leb("length(v)")}) + length(k) - shared + length(v) AS bytes FROM prefixes),
o AS (SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY run_id, block_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM e)
SELECT run_id, block_no, k, "offset" FROM o WHERE is_restart""",
    "unpacked_blocks": f"WITH {NEWEST} SELECT CAST(substr(k, 10, 1) AS BIGINT) AS run_id, k, v FROM newest",
    "cache_hits": """WITH a AS (SELECT event_type, event_id AS pos, user_id // 8 AS block FROM events),
p AS (SELECT *, lag(pos) OVER (PARTITION BY event_type, block ORDER BY pos) AS prev FROM a),
d AS (SELECT p.event_type, p.pos, p.prev, (SELECT count(DISTINCT b.block) FROM a b WHERE b.event_type = p.event_type AND b.pos > p.prev AND b.pos < p.pos) AS between_ FROM p)
SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN prev IS NOT NULL AND between_ < 100 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM d GROUP BY event_type""",
    "varint_length": f"SELECT doc_id, {_leb('n_chars')} AS n FROM documents",
    "varint_bytes": f"SELECT doc_id, {_leb_hex('n_chars')} AS data, n_chars AS value FROM documents",
    "bloom_sizing": """WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT *, unnest([CAST(0.1 AS DOUBLE), CAST(0.01 AS DOUBLE), CAST(0.001 AS DOUBLE)]) AS p FROM c),
m AS (SELECT *, CAST(ceil(-n * ln(p) / pow(ln(2.0), 2)) AS BIGINT) AS m FROM r)
SELECT c_nationkey, n, p, greatest(1, CAST(ceil(CAST(m AS DOUBLE) / n * ln(2.0)) AS BIGINT)) AS k, m FROM m""",
    "bloom_members": f"WITH {BLOOM} SELECT run_id, count(*) AS members, count(*) FILTER (WHERE passes) AS hits FROM passes WHERE member GROUP BY run_id",
    "bloom_false_positives": f"WITH {BLOOM} SELECT run_id, count(*) AS probes, count(*) FILTER (WHERE passes) AS passed FROM passes WHERE NOT member GROUP BY run_id",
    # The first bit stands highest in its byte.
    "bloom_bytes": f"""WITH {BLOOM}, every AS (SELECT run_id, hashes, m, unnest(range((m + 7) // 8)) AS byte FROM sizes),
  filled AS (SELECT run_id, bit // 8 AS byte, CAST(sum(128 >> CAST(bit % 8 AS INTEGER)) AS BIGINT) AS value, count(*) AS n FROM bits GROUP BY 1, 2),
  data AS (SELECT e.run_id, e.hashes, e.m, string_agg(lpad(to_hex(coalesce(f.value, 0)), 2, '0'), '' ORDER BY e.byte) AS payload, CAST(sum(coalesce(f.n, 0)) AS BIGINT) AS bits FROM every e LEFT JOIN filled f ON e.run_id = f.run_id AND e.byte = f.byte GROUP BY ALL)
  SELECT run_id, CAST(length(payload) // 2 + 12 AS BIGINT) AS bytes, md5(unhex({_le("hashes", 4)} || {_le("m", 8)} || payload)) AS md5, bits FROM data""",
    "lossy_text": "SELECT doc_id, length(text) + 1 AS n, md5(text || chr(65533)) AS md5 FROM documents",
    "chunk_checksums": f"WITH {LOG}, {RECORD}, {CRC} SELECT seq, {_crc("'01' || record")} AS crc FROM records, remainders",
    "framed_log": f"""{CHUNKS} SELECT log_no, chunk_no, "offset", chunk_type, CAST(length AS INTEGER) AS length, {_crc("'0' || chunk_type || payload")} AS crc FROM chunks, remainders""",
    "log_file_sizes": f"""{CHUNKS} SELECT log_no, count(*) FILTER (WHERE chunk_type IN (1, 2)) AS records, CAST(max("offset" + 7 + length) AS BIGINT) AS bytes FROM chunks GROUP BY log_no""",
    "log_file_scan": f"WITH {LOG} SELECT CAST(seq // 4096 AS INTEGER) AS log_no, CASE WHEN op = 'P' THEN 1 ELSE 2 END AS op, seq, k, v FROM log",
    "packed_blocks": f"{PACKED} SELECT run_id, block_no, n, first_k, last_k, CAST(length(data) // 2 AS INTEGER) AS bytes, {_crc('data')} AS crc FROM digits, remainders",
    "run_file_index": f"{PACKED} SELECT run_id, block_no, last_k, CAST(length(data) // 2 AS INTEGER) AS bytes, CAST(0 AS BIGINT) AS gap FROM digits",
    "run_file_scan": f"WITH {RUNS} SELECT run_id, k, v FROM runs",
    "filtered_get": f"WITH {RUNS}, asked AS (SELECT k FROM log UNION SELECT k || 'x' FROM log), top AS (SELECT k, max(run_id) AS run_id, arg_max(v, run_id) AS v FROM runs GROUP BY k) SELECT k, run_id, v FROM top SEMI JOIN asked USING (k) WHERE v <> ''",
    "block_search": f"WITH {NEWEST}, held AS (SELECT CAST(substr(k, 10, 1) AS BIGINT) AS run_id, k, v FROM newest), asked AS (SELECT run_id, k FROM held UNION SELECT run_id, substr(k, 1, length(k) - 1) FROM held) SELECT run_id, a.k, h.v FROM asked a LEFT JOIN held h USING (run_id, k)",
    "merge_edits": f"WITH {LIVE} SELECT 2 AS tag, level, run_id FROM live WHERE level = 1 UNION ALL SELECT 1, 2, 1000000 WHERE EXISTS (SELECT 1 FROM live WHERE level = 1)",
    "varint32": f"""WITH d AS (SELECT doc_id, (n_chars * 40503 * 65537) % 4294967296 AS x FROM documents)
  SELECT doc_id, {_leb_hex('x')} AS data, x AS value, CAST(NULL AS BIGINT) AS cut, CAST(NULL AS BIGINT) AS too_long FROM d""",
    "commands": """WITH s AS (SELECT event_id AS line_no, 'k' || CAST(user_id % 50 AS VARCHAR) AS key, CASE WHEN event_id = 500 THEN 'clear' WHEN event_type = 'error' THEN 'rm' WHEN event_type = 'view' THEN 'get' ELSE 'put' END AS c FROM events),
g AS (SELECT s.line_no, s.key, (SELECT arg_max(CASE WHEN p.c = 'put' THEN 'a b ' || CAST(p.line_no AS VARCHAR) ELSE '' END, p.line_no) FROM s p WHERE p.line_no < s.line_no AND (p.c = 'clear' OR (p.key = s.key AND p.c IN ('put', 'rm')))) AS value FROM s WHERE s.c = 'get')
SELECT line_no, key, nullif(value, '') AS value FROM g""",
    "command_parse": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'put' WHEN 1 THEN 'get' ELSE 'unknown' END AS command,
CASE WHEN event_id % 3 < 2 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS key,
CASE WHEN event_id % 3 < 2 THEN CAST(user_id AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '  x y' ELSE '' END WHEN event_id % 2 = 0 THEN ' x y' END AS value FROM events""",
    "stream_latest": f"WITH {NEWEST} SELECT k, v, seq FROM newest",
    "stream_live": f"WITH {SNAP} SELECT k, v, seq FROM snap",
    "stream_table": f"WITH {SNAP} SELECT k, v FROM snap",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
