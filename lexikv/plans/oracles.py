"""DuckDB SQL that the registered queries must agree with."""

from __future__ import annotations

_DOCS = "docs AS (SELECT doc_id AS id, 'doc:' || lang || ':' || doc_id AS key, text AS value FROM documents)"
_PAGES = "pg AS (SELECT page_id AS id, 'page:' || page_id AS key, html AS value FROM pages)"
_CONV = "conv AS (SELECT 'conv:' || conv_id AS key, turn::VARCHAR AS field, text AS value FROM conversations)"
_STRINGS = f"{_DOCS}, {_PAGES}, strs AS (SELECT * FROM docs UNION ALL SELECT * FROM pg)"
_LOG = """log AS (SELECT event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'setnx' WHEN 'purchase' THEN 'set' WHEN 'click' THEN 'append' WHEN 'view' THEN 'get' WHEN 'error' THEN 'getdel' ELSE 'get' END AS cmd,
  'user:' || user_id AS key, props AS value, event_id % 7 * 86400 AS ttl FROM events)"""
_REG = """reg AS (SELECT (o_orderkey % 65535 + 1)::INTEGER AS id, 'd' || o_orderkey AS uuid, CASE WHEN o_custkey % 5 = 0 THEN [o_orderpriority, 'default'] ELSE [o_orderpriority] END AS namespaces,
  o_orderdate AS created, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END AS retired, floor(o_totalprice)::BIGINT AS dict_size FROM orders)"""
_RATIOS = "ratios AS (SELECT event_id AS seq, (1000 + event_id % 13) AS raw, floor(abs(value) % 1000)::BIGINT AS cmp FROM events)"
_WRITES = "writes AS (SELECT event_id AS seq, 'conv:' || (user_id % 500) AS key, (event_id % 9)::VARCHAR AS field, props AS value FROM events)"
_STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_SPREAD = "spread AS (SELECT unnest(namespaces) AS ns, id, uuid, created, dict_size FROM reg WHERE retired IS NULL)"
_NS = "CASE WHEN starts_with(key, 'doc:en:') THEN 'doc:en:' WHEN starts_with(key, 'page:') THEN 'page:' WHEN starts_with(key, 'conv:') THEN 'conv:' WHEN starts_with(key, 'doc:') THEN 'doc:' ELSE 'default' END"
_DRAW = "('0x' || substr(md5({}), 1, 8))::UBIGINT"
_BYTES = "SELECT {key} AS key, unnest(regexp_extract_all(substr(hex(encode(value)), 1, 1024), '..')) AS b FROM {src}"
_SHARE = "(SELECT key, coalesce(sum((b BETWEEN '20' AND '7E' OR b IN ('09','0A','0D'))::INTEGER) / count(*), 0.0) AS share FROM bytes GROUP BY key)"
_ENTROPY = "(SELECT key, -sum(p * log2(p)) AS entropy FROM (SELECT key, n / sum(n) OVER (PARTITION BY key) AS p FROM (SELECT key, b, count(*) AS n FROM bytes GROUP BY key, b)) GROUP BY key)"
_EWMA = """SELECT {group} count(*) AS observations, sum(CASE WHEN i = 1 THEN power(1.0::DOUBLE - {a}, n - 1) * s ELSE {a}::DOUBLE * power(1.0::DOUBLE - {a}, n - i) * s END) AS ewma, sum(CASE WHEN i = 1 THEN s END) AS baseline, sum(raw)::BIGINT AS bytes
  FROM (SELECT *, cmp::DOUBLE / raw AS s, row_number() OVER ({part} ORDER BY seq) AS i, count(*) OVER ({part}) AS n FROM {src}) {by}"""
_SUMS = "sums AS (SELECT *, sum(len) OVER (ORDER BY seq) AS s, row_number() OVER (ORDER BY seq) AS i FROM (SELECT doc_id AS seq, strlen(text)::BIGINT AS len FROM documents) WHERE len <= 1048576)"
_MAGIC = "28B52FFD 1F8B 04224D18 02214C18 504B0304 FD377A585A00 425A68 FFD8 89504E470D0A1A0A 474946383761 474946383961 4F676753 494433 255044462D".split()
_LIST = "[" + ",".join(f"'{m}'" for m in [*_MAGIC, "7801", "789C", "4142"]) + "]"
_RANKED = "SELECT ns, uuid, id, row_number() OVER (PARTITION BY ns ORDER BY created DESC, id DESC)::INTEGER AS rank FROM spread"
_LIVES = """r AS (SELECT *, sum(CASE WHEN cmd IN ('set','getdel') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS life FROM log),
o AS (SELECT *, first_value(CASE WHEN cmd = 'set' THEN value END) OVER (PARTITION BY key, life ORDER BY seq) AS opener FROM r),
st AS (SELECT *, CASE WHEN opener IS NULL THEN min(CASE WHEN cmd IN ('setnx','append') THEN seq END) OVER (PARTITION BY key, life) END AS starts FROM o),
af AS (SELECT *, CASE WHEN opener IS NOT NULL OR starts <= seq THEN coalesce(opener, '') || coalesce(string_agg(CASE WHEN cmd = 'append' OR seq = starts THEN value END, '') OVER (PARTITION BY key, life ORDER BY seq), '') END AS after FROM st),
rp AS (SELECT *, lag(after) OVER (PARTITION BY key ORDER BY seq) AS before FROM af)"""

_UNIT = "['EX', 'PX', 'EXAT', 'PXAT', 'KEEPTTL', 'PERSIST', NULL][{} // 3 % 7 + 1]"
_UNTIL = """CASE unit WHEN 'EX' THEN ts + to_seconds(ttl) WHEN 'PX' THEN ts + to_milliseconds(ttl)
  WHEN 'EXAT' THEN TIMESTAMP '1970-01-01' + to_seconds(ttl) WHEN 'PXAT' THEN TIMESTAMP '1970-01-01' + to_milliseconds(ttl) END"""
_EXPIRING = f"""asked AS (SELECT event_id AS request, ts, 'conv:' || (user_id % 500) AS key, unnest([event_id % 9, event_id % 9 + 1])::VARCHAR AS field, props AS value,
  ['FNX', 'FXX', NULL][event_id % 3 + 1] AS cond, {_UNIT.format('event_id')} AS unit, event_id % 7 * 86400 AS ttl FROM events),
held AS (SELECT *, CASE WHEN field::INTEGER % 2 = 0 THEN TIMESTAMP '2030-01-01' END AS until FROM conv),
judged AS (SELECT a.*, h.key IS NOT NULL AS old, h.until AS before FROM asked a LEFT JOIN held h ON a.key = h.key AND a.field = h.field),
replies AS (SELECT request, CASE max(cond) WHEN 'FNX' THEN (NOT bool_or(old))::INTEGER WHEN 'FXX' THEN bool_and(old)::INTEGER ELSE 1 END AS reply FROM judged GROUP BY request)"""

_RUNS = """runs AS (SELECT ['doc:', 'doc:en:', 'page:', 'conv:'][user_id % 4 + 1] AS ns, event_id AS seq, event_id % 3 AS t, event_id % 5 = 0 AS failed, event_id % 1009 AS ms FROM events),
tr AS (SELECT coalesce(ns, 'global') AS ns, count(*) FILTER (t = 0) AS triggers_rise, count(*) FILTER (t = 1) AS triggers_drop,
  count(*) FILTER (failed) AS trainer_errs, arg_max(ms, seq) AS trainer_ms_last FROM runs GROUP BY ROLLUP (ns))"""
_SIX = "printf('%.6f', {})"
#: Entries of stats in their order, with the SQL of their values; null: what depends on the compressor.
_ENTRIES = {
    "ns": "x.ns", "ewma_m": _SIX.format("ewma"), "baseline": _SIX.format("baseline"), "comp_ratio": "NULL", "bytes_raw_total": "bytes_raw_total",
    "bytes_cmp_total": "NULL", "reads_total": "NULL", "writes_total": "writes_total", "dict_id": "dict_id", "dict_size": "dict_size", "total_dicts": "total_dicts",
    "train_mode": "'FAST'", "retrain": "0", "last_retrain_ms": "0", "trainer_runs": "0", "trainer_errs": "coalesce(trainer_errs, 0)",
    "trainer_ms_last": "coalesce(trainer_ms_last, 0)", "reservoir_bytes": "held.bytes", "reservoir_items": "held.k", "shadow_pct": "0", "shadow_samples": "0",
    "shadow_raw": "0", "shadow_saved": "0", "promotions": "0", "rollbacks": "0", "triggers_rise": "coalesce(triggers_rise, 0)",
    "triggers_drop": "coalesce(triggers_drop, 0)", "cooldown_left": "0", "compress_errs": "0", "decompress_errs": "0", "dict_miss_errs": "0",
    "skipped_min": "skipped_min", "skipped_max": "skipped_max", "skipped_incomp": "NULL",
}
_ENTRY_ROWS = ", ".join(f"{{'pos': {i}, 'entry': '{e}', 'value': ({v})::VARCHAR}}" for i, (e, v) in enumerate(_ENTRIES.items(), 1))

SQL: dict[str, str] = {
    "codec_roundtrip_docs": f"WITH {_DOCS} SELECT key, value FROM docs",
    "codec_roundtrip_dict_conv": f"WITH {_CONV} SELECT * FROM conv",
    "size_gate_counts": f"WITH {_STRINGS} SELECT CASE WHEN strlen(value) < 32 THEN 'skip_min' WHEN strlen(value) > 8192 THEN 'skip_max' ELSE 'eligible' END AS gate, count(*) AS n, sum(strlen(value))::BIGINT AS bytes FROM strs GROUP BY 1",
    "logical_strlen": f"WITH {_STRINGS} SELECT key, strlen(value)::BIGINT AS len FROM strs",
    "hash_hstrlen": f"WITH {_CONV} SELECT key, field, strlen(value)::BIGINT AS len FROM conv",
    "setraw_strlen": f"WITH {_DOCS} SELECT key, strlen(value)::BIGINT AS len, false AS is_encoded FROM docs",
    "route_longest_prefix": f"WITH {_STRINGS}, {_CONV}, {_LOG}, k AS (SELECT key FROM strs UNION ALL SELECT key FROM conv UNION ALL SELECT key FROM log) SELECT key, count(*) AS n, {_NS} AS ns FROM k GROUP BY key",
    "route_many_prefixes": f"WITH {_LOG}, p AS (SELECT DISTINCT 'user:' || (c_custkey % 1000) AS ns FROM customer) SELECT seq, key, coalesce(max_by(ns, length(ns)), 'default') AS ns FROM log LEFT JOIN p ON starts_with(key, ns) GROUP BY seq, key",
    "ns_stats_rollup": f"WITH {_STRINGS}, {_CONV}, k AS (SELECT key, strlen(value) AS n FROM strs UNION ALL SELECT key, strlen(value) FROM conv), r AS (SELECT {_NS} AS ns, n FROM k) SELECT coalesce(ns, 'global') AS ns, count(*) AS writes_total, sum(n)::BIGINT AS bytes_raw_total, sum((n < 32)::INTEGER)::BIGINT AS skipped_min, sum((n > 8192)::INTEGER)::BIGINT AS skipped_max FROM r GROUP BY ROLLUP (ns)",
    "list_namespaces": f"WITH {_REG} SELECT DISTINCT unnest(namespaces) AS ns FROM reg UNION SELECT 'global' UNION SELECT 'default'",
    "string_get": "SELECT 'page:' || l.doc_id AS key, md5(p.html) AS value_md5 FROM labels l LEFT JOIN pages p ON p.page_id = l.doc_id",
    "string_mget_ordered": "WITH a AS (SELECT page_id AS request, unnest([1, 2, 3, 4]) AS pos, unnest([page_id + 1, page_id - 1, page_id, page_id + 1]) AS p FROM pages) SELECT request, string_agg(coalesce(md5(html), '<null>'), '|' ORDER BY pos) AS \"values\" FROM a LEFT JOIN pages ON pages.page_id = a.p GROUP BY request",
    "string_mset": f"WITH {_LOG} SELECT key, max_by(value, seq) AS value FROM log WHERE cmd = 'set' GROUP BY key",
    "string_msetnx": f"""WITH RECURSIVE {_LOG}, w AS (SELECT floor(seq / 10)::BIGINT AS request, seq AS pos, key, value FROM log WHERE cmd = 'set'),
r AS (SELECT request, list(DISTINCT key) AS keys, row_number() OVER (ORDER BY request) AS i FROM w GROUP BY request),
step(i, held, done) AS (SELECT 0::BIGINT, (SELECT list('user:' || (c_custkey * 3)) FROM customer), NULL::BIGINT
  UNION ALL SELECT r.i, CASE WHEN list_has_any(held, keys) THEN held ELSE list_concat(held, keys) END, CASE WHEN NOT list_has_any(held, keys) THEN request END FROM step JOIN r ON r.i = step.i + 1)
SELECT * FROM w WHERE request IN (SELECT done FROM step WHERE done IS NOT NULL)""",
    "log_last_set": f"WITH {_LOG} SELECT key, max_by(value, seq) AS value, max(seq) AS seq FROM log WHERE cmd = 'set' GROUP BY key",
    "log_final_state": f"WITH {_LOG}, {_LIVES} SELECT key, after AS value FROM rp QUALIFY seq = max(seq) OVER (PARTITION BY key) AND after IS NOT NULL",
    "log_setnx_first": f"WITH {_LOG}, {_LIVES} SELECT seq, key, (before IS NULL)::INTEGER AS reply FROM rp WHERE cmd = 'setnx'",
    "log_getset_prev": f"WITH {_LOG}, {_LIVES} SELECT seq, key, before AS previous, value FROM rp WHERE cmd = 'set'",
    "log_get_asof": f"WITH {_LOG}, {_LIVES} SELECT seq, key, before AS value FROM rp WHERE cmd = 'get'",
    "log_getdel": f"WITH {_LOG}, {_LIVES} SELECT seq, key, before AS value FROM rp WHERE cmd = 'getdel'",
    "log_replay": f"WITH {_LOG}, {_LIVES} SELECT seq, key, cmd, md5(before) AS before_md5, strlen(after)::BIGINT AS after_len FROM rp",
    "log_append_fold": f"WITH {_LOG}, a AS (SELECT key, string_agg(value, '' ORDER BY seq) AS value FROM log WHERE cmd = 'append' GROUP BY key) SELECT key, value, strlen(value)::BIGINT AS length FROM a",
    "log_ttl_live": f"""WITH {_LOG}, {_LIVES},
l AS (SELECT *, max(CASE WHEN opener IS NOT NULL THEN ts + to_seconds(ttl) END) FILTER (cmd = 'set') OVER (PARTITION BY key, life) AS e FROM rp)
SELECT key, after AS value, {_STAMP.format('e')} AS expire_at FROM l
QUALIFY seq = max(seq) OVER (PARTITION BY key) AND after IS NOT NULL AND (e IS NULL OR e > TIMESTAMP '2024-01-20 00:00:00')""",
    "log_getex": f"""WITH {_LOG}, s AS (SELECT seq, key, CASE WHEN cmd <> 'getdel' AND ttl > 0 THEN ts + to_seconds(ttl) END AS e FROM log WHERE cmd IN ('set','get','getdel'))
SELECT l.seq, l.key, {_STAMP.format('s.e')} AS expire_at FROM log l ASOF LEFT JOIN s ON s.key = l.key AND s.seq <= l.seq""",
    "getrange": f"WITH {_LOG} SELECT seq, CASE WHEN length(value) - 3 >= seq % 5 THEN substr(value, seq % 5 + 1, length(value) - 2 - seq % 5) ELSE '' END AS slice FROM log",
    "setrange": f"WITH {_LOG}, s AS (SELECT seq, left(rpad(value, greatest(length(value), seq % 4)::INTEGER, chr(0)), (seq % 4)::BIGINT) || 'HEAD' || substr(value, seq % 4 + 5) AS value FROM log) SELECT seq, value, strlen(value)::BIGINT AS len FROM s",
    "hash_hget": f"WITH {_CONV}, a AS (SELECT key, (field::BIGINT + 1)::VARCHAR AS field FROM conv) SELECT a.key, a.field, nullif(c.value, '') AS value FROM a LEFT JOIN conv c ON a.key = c.key AND a.field = c.field",
    "hash_hmget": f"WITH {_CONV}, a AS (SELECT key AS request, unnest([1, 2, 3, 4]) AS pos, unnest(['2', '0', '99', '1']) AS field FROM (SELECT DISTINCT key FROM conv)) SELECT request, string_agg(coalesce(c.value, '<null>'), '|' ORDER BY pos) AS \"values\" FROM a LEFT JOIN conv c ON a.request = c.key AND a.field = c.field GROUP BY request",
    "hash_hvals": f"WITH {_CONV} SELECT key, string_agg(coalesce(nullif(value, ''), '<null>'), '|' ORDER BY field) AS \"values\" FROM conv GROUP BY key",
    "hash_hgetall": f"WITH {_CONV} SELECT key, string_agg(field || '=' || coalesce(nullif(value, ''), '<null>'), '|' ORDER BY field) AS entries FROM conv GROUP BY key",
    "hash_hset_new_fields": f"WITH {_CONV}, {_WRITES}, w AS (SELECT DISTINCT key, field FROM writes) SELECT w.key, sum((c.key IS NULL)::INTEGER)::BIGINT AS added FROM w LEFT JOIN conv c ON w.key = c.key AND w.field = c.field GROUP BY w.key",
    "hash_hset_merged": f"WITH {_CONV}, {_WRITES}, w AS (SELECT key, field, max_by(value, seq) AS value FROM writes GROUP BY key, field) SELECT coalesce(w.key, c.key) AS key, coalesce(w.field, c.field) AS field, md5(coalesce(w.value, c.value)) AS value_md5 FROM w FULL JOIN conv c ON w.key = c.key AND w.field = c.field",
    "hash_hsetnx": f"WITH {_CONV}, {_WRITES} SELECT w.seq, w.key, w.field, (c.key IS NULL AND row_number() OVER (PARTITION BY w.key, w.field ORDER BY w.seq) = 1)::INTEGER AS reply FROM writes w LEFT JOIN conv c ON w.key = c.key AND w.field = c.field",
    "hash_hgetdel": f"""WITH {_CONV}, {_WRITES}, a AS (SELECT DISTINCT key, field FROM writes)
SELECT a.key, a.field, nullif(c.value, '') AS value, 'reply' AS part FROM a LEFT JOIN conv c ON a.key = c.key AND a.field = c.field
UNION ALL SELECT key, field, value, 'left' FROM conv c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.key = c.key AND a.field = c.field)""",
    "hash_hrandfield": f"WITH {_CONV} SELECT key, field FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('5:' || field), field) AS i FROM conv) WHERE i <= 2",
    "hash_expiry": f"WITH w AS (SELECT 'conv:' || user_id AS key, event_type AS field, event_id, CASE WHEN event_id % 3 > 0 THEN ts + to_seconds(event_id % 100) END AS e FROM events) SELECT key, field, {_STAMP.format('e')} AS expire_at FROM (SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY event_id DESC) AS i FROM w) WHERE i = 1",
    "rewrite_rules": """WITH e AS (SELECT event_id, ['get','SET','Substr','hmset','HGETALL','hsetex','ZADD','mget','hset'][event_id % 9 + 1] AS cmd, CASE WHEN event_id % 11 = 0 THEN 'dict:' ELSE 'user:' END || user_id AS key, event_id % 4 AS argc FROM events)
SELECT event_id, key, CASE WHEN argc > 1 AND NOT starts_with(key, 'dict:') THEN CASE upper(cmd) WHEN 'GET' THEN 'get' WHEN 'SET' THEN 'set' WHEN 'SUBSTR' THEN 'getrange' WHEN 'HMSET' THEN 'hsetasync' WHEN 'HSET' THEN 'hsetasync' WHEN 'HGETALL' THEN 'hgetall' WHEN 'HSETEX' THEN 'hsetex' WHEN 'MGET' THEN 'mgetasync' ELSE cmd END ELSE cmd END AS cmd FROM e""",
    "bernoulli_md5": f"WITH {_DOCS} SELECT key FROM docs WHERE {_DRAW.format('key')} <= 858993459",
    "reservoir_warmup_k": f"WITH {_SUMS} SELECT count(*) AS k, coalesce(sum(len), 0)::BIGINT AS bytes FROM sums WHERE s <= 1048576 AND i <= 10485",
    "reservoir_bottom_k": "SELECT doc_id AS seq, strlen(text)::BIGINT AS len FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 100",
    "ewma_events": f"WITH {_RATIOS}, e AS ({_EWMA.format(group='', a=0.05, part='', src='ratios', by='')}) SELECT observations, round(ewma, 9) AS ewma, round(baseline, 9) AS baseline, bytes FROM e",
    "retrain_decision": f"WITH {_RATIOS}, g AS (SELECT *, seq % 5 AS grp FROM ratios), e AS ({_EWMA.format(group='grp,', a=0.2, part='PARTITION BY grp', src='g', by='GROUP BY grp')}) SELECT grp, round(ewma, 9) AS ewma, (bytes >= 1000 AND abs(ewma / baseline - 1) >= 0.12) AS due, CASE WHEN ewma < baseline THEN 'rise' WHEN ewma > baseline THEN 'drop' END AS trigger, round(least(ewma, baseline), 9) AS new_baseline FROM e",
    "magic_sniff": f"SELECT event_id, CASE event_id % 17 WHEN 16 THEN false ELSE true END AS magic FROM (SELECT event_id, {_LIST} AS m FROM events)",
    "ascii_ratio": f"WITH {_DOCS}, bytes AS ({_BYTES.format(key='key', src='docs')}) SELECT key, round(share, 9) AS share FROM {_SHARE}",
    "entropy_h8": f"WITH {_DOCS}, bytes AS ({_BYTES.format(key='key', src='docs')}) SELECT key, round(entropy, 9) AS entropy FROM {_ENTROPY}",
    "incompressible_rule": f"WITH {_DOCS}, bytes AS ({_BYTES.format(key='key', src='docs')}) SELECT key, share < 0.85 AND entropy >= 7.5 AS skip, round(entropy, 9) AS entropy FROM {_SHARE} JOIN {_ENTROPY} USING (key)",
    "training_feed": f"WITH {_DOCS}, bytes AS ({_BYTES.format(key='key', src='docs')}) SELECT key, strlen(value)::BIGINT AS len FROM docs JOIN {_SHARE} USING (key) JOIN {_ENTROPY} USING (key) WHERE strlen(value) BETWEEN 32 AND 102400 AND {_DRAW.format('key')} <= 2147483647 AND NOT starts_with(key, 'doc:en:') AND NOT (share < 0.85 AND entropy >= 7.5)",
    "dict_active": f"WITH {_REG}, {_SPREAD} SELECT ns, id AS dict_id, dict_size, n AS total_dicts FROM (SELECT *, row_number() OVER (PARTITION BY ns ORDER BY created DESC, id DESC, dict_size DESC) AS i, count(*) OVER (PARTITION BY ns) AS n FROM spread) WHERE i = 1",
    "dict_ranked": f"WITH {_REG}, {_SPREAD} SELECT ns, uuid, rank FROM ({_RANKED})",
    "dict_retention": f"WITH {_REG}, {_SPREAD} SELECT id FROM ({_RANKED}) GROUP BY id HAVING min(rank) > 10",
    "dict_next_ids": f"WITH {_REG} SELECT row_number() OVER (ORDER BY id)::INTEGER AS k, id::INTEGER AS id FROM (SELECT r AS id FROM range(1, 65536) t(r) WHERE r NOT IN (SELECT id * 2 FROM reg) ORDER BY r LIMIT 50)",
    "dict_by_id": f"WITH {_REG} SELECT id, uuid FROM (SELECT (id % 100)::INTEGER AS id, uuid, row_number() OVER (PARTITION BY id % 100 ORDER BY created DESC, uuid DESC) AS i FROM reg) WHERE i = 1",
    "dict_reload_diff": f"WITH {_REG}, o AS (SELECT DISTINCT id FROM reg WHERE id % 3 <> 0), n AS (SELECT id, namespaces FROM reg WHERE id % 5 <> 0) SELECT (SELECT count(DISTINCT x) FROM (SELECT unnest(namespaces) AS x FROM n)) AS namespaces, (SELECT count(*) FROM n) AS loaded, (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM o)) AS new, (SELECT count(*) FROM n WHERE id IN (SELECT id FROM o)) AS reused, (SELECT count(*) FROM o WHERE id NOT IN (SELECT id FROM n)) AS retired, (SELECT count(*) FROM n) AS failed",
    "dict_gc_eligible": f"WITH {_REG} SELECT uuid FROM reg WHERE retired + INTERVAL 7 DAY <= TIMESTAMP '1997-01-01' AND id NOT IN (SELECT id FROM reg WHERE retired IS NULL)",
    "dict_retire": f"""WITH {_REG},
r AS (SELECT id, uuid, CASE WHEN retired IS NULL AND id % 2 = 0 THEN TIMESTAMP '1997-01-01' ELSE retired END AS ended FROM reg)
SELECT id, uuid, {_STAMP.format('ended')} AS retired FROM r""",
    "manifest_parse": f"WITH {_REG} SELECT uuid AS path, id, uuid AS stem, namespaces[1] || ',extra' AS namespaces, {_STAMP.format('created')} AS created, 3 AS level, true AS valid FROM reg",
    "manifest_render": f"WITH {_REG} SELECT uuid AS path, id, array_to_string(namespaces, ',') AS namespaces, {_STAMP.format('retired')} AS retired FROM reg",
    "config_parse": """WITH e AS (SELECT event_id, (event_id % 50) + CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0 END AS x, event_id % 9 AS u FROM events)
SELECT event_id, CASE u WHEN 0 THEN floor(x * 1024) WHEN 1 THEN floor(x * 1048576) WHEN 2 THEN floor(x * 1073741824) WHEN 3 THEN floor(x) WHEN 6 THEN floor(x * 1048576) END::BIGINT AS bytes,
  CASE u WHEN 3 THEN floor(x) WHEN 5 THEN floor(x) WHEN 6 THEN floor(x * 60) WHEN 7 THEN floor(x * 3600) END::BIGINT AS seconds,
  CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' WHEN 3 THEN 'false' END AS flag, (event_id % 3)::DOUBLE / 2 AS fraction FROM e""",
    "spool_roundtrip": f"WITH {_DOCS} SELECT key, md5(value) AS value_md5 FROM docs",
    "spool_cap": f"WITH {_DOCS}, r AS (SELECT id AS seq, key, 8 + strlen(key) + strlen(value) AS size FROM docs WHERE {_DRAW.format('key')} <= 2147483647) SELECT seq, key FROM (SELECT seq, key, size, sum(size) OVER (ORDER BY seq) AS s FROM r) WHERE s - size < 524288",
    "cstrlen_bounds": f"WITH {_STRINGS} SELECT key, strlen(value)::BIGINT AS raw_len, true AS in_bound, CASE WHEN strlen(value) < 32 THEN strlen(value)::BIGINT END AS ungated_len FROM strs",
    "hash_chstrlen_bounds": f"WITH {_CONV} SELECT key, field, strlen(value)::BIGINT AS raw_len, true AS in_bound, CASE WHEN strlen(value) < 32 THEN strlen(value)::BIGINT END AS ungated_len FROM conv",
    "ns_snapshot_exact": f"""WITH {_STRINGS}, {_CONV}, {_REG}, {_SPREAD}, {_RATIOS},
k AS (SELECT key, strlen(value) AS n FROM strs UNION ALL SELECT key, strlen(value) FROM conv), r AS (SELECT {_NS} AS ns, n FROM k),
c AS (SELECT coalesce(ns, 'global') AS ns, count(*) AS writes_total, sum(n)::BIGINT AS bytes_raw_total, sum((n < 32)::INTEGER)::BIGINT AS skipped_min, sum((n > 8192)::INTEGER)::BIGINT AS skipped_max FROM r GROUP BY ROLLUP (ns)),
a AS (SELECT ns, id AS dict_id, dict_size, n AS total_dicts FROM (SELECT *, row_number() OVER (PARTITION BY ns ORDER BY created DESC, id DESC, dict_size DESC) AS i, count(*) OVER (PARTITION BY ns) AS n FROM spread) WHERE i = 1),
e AS ({_EWMA.format(group='', a=0.05, part='', src='ratios', by='')})
SELECT c.*, coalesce(dict_id, 0)::INTEGER AS dict_id, coalesce(dict_size, 0)::BIGINT AS dict_size, coalesce(total_dicts, 0)::BIGINT AS total_dicts,
  CASE WHEN c.ns IN ('default', 'global') THEN round(ewma, 9) ELSE 0.0 END AS ewma, CASE WHEN c.ns IN ('default', 'global') THEN round(baseline, 9) ELSE 0.0 END AS baseline
FROM c LEFT JOIN a USING (ns), e""",
    "string_mgetasync": """WITH a AS (SELECT page_id AS request, unnest([1, 2, 3]) AS pos, unnest([page_id + 1, page_id - 1, page_id]) AS p FROM pages)
SELECT request, string_agg(coalesce(CASE WHEN pages.page_id % 4 <> 0 THEN md5(html) END, '<null>'), '|' ORDER BY pos) AS "values" FROM a LEFT JOIN pages ON pages.page_id = a.p GROUP BY request""",
    "hash_hmgetasync": f"""WITH {_CONV}, a AS (SELECT key AS request, unnest([1, 2, 3]) AS pos, unnest(['1', '2', '99']) AS field FROM (SELECT DISTINCT key FROM conv))
SELECT request, string_agg(coalesce(CASE WHEN a.field <> '1' THEN nullif(c.value, '') END, '<null>'), '|' ORDER BY pos) AS "values" FROM a LEFT JOIN conv c ON a.request = c.key AND a.field = c.field GROUP BY request""",
    "dict_load_commands": """WITH e AS (SELECT event_id, ['dict:', 'DICT:', 'user:'][event_id % 3 + 1] AS prefix, event_id // 3 % 2 = 1 AS mf, event_id // 6 % 2 = 0 AS master, event_id // 12 % 3 AS origin, event_id // 36 % 3 AS field, event_id // 108 % 3 AS cmd FROM events)
SELECT event_id, CASE WHEN prefix <> 'user:' AND NOT master AND field < 2 AND cmd < 2 THEN CASE WHEN mf THEN 'lm' ELSE 'ld' END END AS loads, origin = 0 AND master AS compress FROM e""",
    "dict_publish": """WITH f AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT r::INTEGER AS id FROM range(1, 65536) t(r) WHERE r NOT IN (SELECT p_partkey * 2 FROM part))),
n AS (SELECT 's' || s_suppkey AS uuid, row_number() OVER (ORDER BY s_suppkey DESC) AS k FROM supplier)
SELECT 'p' || p_partkey AS uuid, (p_partkey * 2)::INTEGER AS id FROM part UNION ALL SELECT uuid, id FROM n JOIN f USING (k)""",
    "dict_signed": f"WITH {_REG} SELECT uuid, sha256(uuid) AS signature, dict_size % 3 <> 0 AS valid FROM reg",
    "log_set_options": f"""WITH {_LOG},
o AS (SELECT seq, ts, key, ttl, cmd, ['NX', 'XX', NULL][seq % 3 + 1] AS cond, {_UNIT.format('seq')} AS unit FROM log),
p AS (SELECT *, coalesce(last_value(CASE WHEN cmd IN ('setnx', 'append') OR (cmd = 'set' AND cond IS DISTINCT FROM 'XX') THEN true WHEN cmd = 'getdel' THEN false END IGNORE NULLS)
  OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS held FROM o),
w AS (SELECT *, cmd = 'set' AND CASE cond WHEN 'NX' THEN NOT held WHEN 'XX' THEN held ELSE true END AS written FROM p),
s AS (SELECT seq, key, CASE WHEN cmd <> 'getdel' THEN {_UNTIL} END AS e FROM w
  WHERE cmd = 'getdel' OR (written AND unit IS DISTINCT FROM 'KEEPTTL') OR (cmd = 'get' AND unit <> 'KEEPTTL'))
SELECT w.seq, w.key, w.written, {_STAMP.format('s.e')} AS expire_at FROM w ASOF LEFT JOIN s ON s.key = w.key AND s.seq <= w.seq""",
    "hash_hsetex": f"""WITH {_CONV}, {_EXPIRING},
n AS (SELECT key, field, value, CASE WHEN unit = 'KEEPTTL' THEN before ELSE {_UNTIL} END AS until FROM judged JOIN replies USING (request)
  WHERE reply = 1 QUALIFY row_number() OVER (PARTITION BY key, field ORDER BY request DESC) = 1),
m AS (SELECT * FROM n UNION ALL SELECT key, field, value, until FROM held h WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.key = h.key AND n.field = h.field))
SELECT key, field, md5(value) AS value_md5, {_STAMP.format('until')} AS expire_at FROM m""",
    "hash_hsetex_replies": f"WITH {_CONV}, {_EXPIRING} SELECT request, reply FROM replies",
    "hash_hgetex": f"""WITH {_CONV}, {_EXPIRING},
l AS (SELECT key, field, {_UNTIL} AS e FROM asked WHERE unit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key, field ORDER BY request DESC) = 1)
SELECT a.request, a.key, a.field, md5(nullif(h.value, '')) AS value_md5, NULL::VARCHAR AS expire_at FROM asked a LEFT JOIN held h ON a.key = h.key AND a.field = h.field
UNION ALL SELECT NULL, h.key, h.field, md5(h.value), {_STAMP.format("CASE WHEN l.key IS NULL THEN h.until ELSE l.e END")} FROM held h LEFT JOIN l ON l.key = h.key AND l.field = h.field""",
    "dict_load_replies": f"""WITH {_REG}, r AS (SELECT *, substr(uuid, 2)::BIGINT * 2 AS s FROM reg)
SELECT s AS seq, CASE WHEN dict_size % 7 = 0 THEN 'ERR base name' ELSE 'OK' END AS reply FROM r
UNION ALL SELECT s + 1, CASE WHEN dict_size % 7 = 0 THEN 'ERR base name' ELSE 'OK' END FROM r WHERE dict_size % 5 > 0""",
    "dict_load_registry": f"""WITH {_REG} SELECT id, uuid, array_to_string(namespaces, ',') AS namespaces, uuid AS dict, strlen(uuid)::BIGINT AS dict_size, {_STAMP.format('created')} AS created
FROM reg WHERE dict_size % 7 > 0 AND dict_size % 5 > 0""",
}

SQL["stats_training"] = f"WITH {_RUNS} SELECT * FROM tr"
SQL["stats_entries"] = f"""WITH {_RUNS}, snap AS ({SQL["ns_snapshot_exact"]}), sample AS ({SQL["reservoir_warmup_k"]}),
own AS (SELECT ns, CASE WHEN ns IN ('default', 'global') THEN k ELSE 0 END AS k, CASE WHEN ns IN ('default', 'global') THEN bytes ELSE 0 END AS bytes FROM snap, sample),
rows_of AS (SELECT x.ns, unnest([{_ENTRY_ROWS}]) AS e FROM snap x JOIN own held ON held.ns = x.ns LEFT JOIN tr ON tr.ns = x.ns)
SELECT ns, e.pos AS pos, e.entry AS entry, e.value AS value FROM rows_of"""
SQL["hash_hrandfield_repeated"] = f"""WITH {_CONV} SELECT key, field FROM (SELECT key, field,
  row_number() OVER (PARTITION BY key, d ORDER BY md5('5:' || key || ':' || d || ':' || field), field) AS i FROM conv, (SELECT unnest([1, 2, 3]) AS d)) WHERE i = 1"""
# only a getex on a key with a value counts; a set without a value leaves the key without one
SQL["log_getex_live"] = f"""WITH {_LOG}, {_LIVES},
ends AS (SELECT key, arg_max({{'e': CASE WHEN cmd <> 'getdel' AND ttl > 0 THEN ts + to_seconds(ttl) END}}, seq).e AS e
  FROM rp WHERE cmd IN ('set', 'getdel') OR (cmd = 'get' AND before IS NOT NULL) GROUP BY key),
l AS (SELECT key, after FROM rp QUALIFY seq = max(seq) OVER (PARTITION BY key) AND after IS NOT NULL)
SELECT key, after AS value, {_STAMP.format('e')} AS expire_at FROM l LEFT JOIN ends USING (key) WHERE e IS NULL OR e > TIMESTAMP '2024-01-20 00:00:00'"""
