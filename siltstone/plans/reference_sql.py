"""The same queries as SQL for an independent engine (DuckDB)."""

from __future__ import annotations

_O = """o AS (SELECT event_id AS seq, epoch_us(ts)//1000 AS ts_ms,
  CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'PUT_TTL' ELSE 'PUT' END AS op,
  'user:'||user_id AS key, CASE WHEN event_type='error' THEN '' ELSE event_type||':'||props END AS value,
  epoch_us(ts)//1000 + 3600000*(1+event_id%240) AS expiry_ms FROM events)"""
_L = """l AS (SELECT o_orderkey AS seq, 'cust:'||o_custkey AS key, o_orderstatus||'|'||o_orderpriority AS value FROM orders)"""
_LIVE = f"""{_O}, live AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn
  FROM o WHERE op<>'PUT_TTL') WHERE rn=1 AND op='PUT')"""
_REQ = "req AS (SELECT 'user:'||(7*i) AS key FROM range(40) t(i))"
_TTL = f"""{_O}, t AS (SELECT key, value, expiry_ms FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn
  FROM o WHERE op='PUT_TTL') WHERE rn=1)"""
_RUNS = f"""{_L}, cut AS (SELECT *, (row_number() OVER (ORDER BY seq)-1)//1000 AS run_id FROM l),
  r AS (SELECT run_id, key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) AS rn FROM cut) WHERE rn=1)"""
_N = "n AS (SELECT count(DISTINCT run_id) AS n FROM r)"
_LEVEL = "list_max(list_transform(range(0,12), lambda x: CASE WHEN (run_id // CAST(pow(4,x) AS BIGINT) + 1)*CAST(pow(4,x) AS BIGINT) <= n THEN x ELSE 0 END))"
_MEMBER = f"{_RUNS}, {_N}, m AS (SELECT run_id, CAST({_LEVEL} AS INTEGER) AS level FROM (SELECT DISTINCT run_id FROM r), n)"
_TIERED = f"""{_RUNS}, n AS (SELECT count(DISTINCT run_id)-1 AS n FROM r),
  m AS (SELECT run_id, CASE WHEN run_id=n THEN -1 ELSE CAST({_LEVEL} AS INTEGER) END AS level FROM (SELECT DISTINCT run_id FROM r), n),
  tr AS (SELECT r.*, m.level FROM r JOIN m USING (run_id))"""
_HASH = {
    "bloom_sha": "CAST('0x'||substr(sha256(key),1,8) AS BIGINT)",
    "bloom_fnv": "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(key)+1), lambda i: ascii(substr(key,i,1))::BIGINT)), lambda h,b: (xor(h,b)*16777619) & 4294967295)",
    "bloom_mur": "list_reduce(list_prepend(2538058380::BIGINT, list_transform(range(1, length(key)+1), lambda i: ascii(substr(key,i,1))::BIGINT)), lambda h,b: xor((xor(h,b)*1540483477) & 4294967295, ((xor(h,b)*1540483477) & 4294967295)>>15))",
}
_SIGN = "CASE WHEN {0} >= 2147483648 THEN {0}-4294967296 ELSE {0} END"


def _hash(name: str) -> str:
    return f"WITH {_L}, k AS (SELECT DISTINCT key FROM l), h AS (SELECT key, {_HASH[name]} AS u FROM k), g AS (SELECT key, {_SIGN.format('u')} AS hash FROM h) SELECT key, hash, abs(hash%10000) AS bit FROM g"


_BITS = f"""{_RUNS}, ks AS (SELECT DISTINCT key FROM r), hs AS (SELECT key, {", ".join(f"{v} AS {k}" for k, v in _HASH.items())} FROM ks),
  kb AS (SELECT key, unnest([{", ".join(f"abs(({_SIGN.format(k)})%10000)" for k in _HASH)}]) AS bit FROM hs),
  bits AS (SELECT DISTINCT run_id, bit FROM r JOIN kb USING (key))"""
_PROBE = f"""{_BITS}, asked AS (SELECT run_id-1 AS run_id, key FROM r WHERE run_id>0),
  pr AS (SELECT a.run_id, a.key, bool_and(b.bit IS NOT NULL) AS may_contain FROM asked a JOIN kb USING (key)
    LEFT JOIN bits b ON b.run_id=a.run_id AND b.bit=kb.bit GROUP BY 1,2)"""
_INDEX = """sz AS (SELECT run_id, key, row_number() OVER (PARTITION BY run_id ORDER BY key) AS n,
    12+strlen(key)+CASE WHEN strlen(key)<128 THEN 1 ELSE 2 END+CASE WHEN strlen(value)>0 THEN 1+strlen(value)+CASE WHEN strlen(value)<128 THEN 1 ELSE 2 END ELSE 0 END AS len FROM r),
  f AS (SELECT run_id, n, key, len, 0::BIGINT AS off, len::BIGINT AS acc, false AS ix FROM sz WHERE n=1
    UNION ALL SELECT s.run_id, s.n, s.key, s.len, f.off+f.len, CASE WHEN f.acc>4096 THEN s.len ELSE f.acc+s.len END, f.acc>4096
    FROM f JOIN sz s ON s.run_id=f.run_id AND s.n=f.n+1), ix AS (SELECT run_id, key, off AS "offset" FROM f WHERE ix)"""
_FLOOR = """fl AS (SELECT a.run_id, a.key, coalesce(max(i."offset"),0) AS "offset" FROM (SELECT run_id-1 AS run_id, key FROM r WHERE run_id>0) a
    LEFT JOIN ix i ON i.run_id=a.run_id AND i.key<=a.key GROUP BY 1,2)"""
_MERGE = """SELECT grp, key, run_id, seq, value FROM (SELECT *, run_id//4 AS grp, row_number() OVER (PARTITION BY run_id//4, key ORDER BY run_id {}) AS rn FROM r) WHERE rn=1"""

ORACLE: dict[str, str] = {
    "kv_latest": f"WITH {_LIVE} SELECT key, value FROM live",
    "kv_multi_get": f"WITH {_LIVE}, {_REQ} SELECT req.key, live.value FROM req LEFT JOIN live USING (key)",
    "kv_get": f"WITH {_LIVE} SELECT key, value FROM live WHERE key='user:14'",
    "kv_get_json": f"WITH {_LIVE}, {_REQ} SELECT req.key, CAST(json_object('key', req.key, 'value', live.value) AS VARCHAR) AS body FROM req LEFT JOIN live USING (key)",
    "kv_range": f"WITH {_LIVE} SELECT key, value FROM live WHERE key BETWEEN 'user:1' AND 'user:5'",
    "put_router": f"WITH {_O} SELECT seq, CASE WHEN op='PUT_TTL' THEN 'PUT_TTL' ELSE 'PUT' END AS route, key, value, CASE WHEN op='PUT_TTL' THEN expiry_ms-ts_ms END AS ttl FROM o WHERE op<>'DELETE'",
    "ttl_live": f"WITH {_TTL} SELECT * FROM t WHERE NOT (1705276800000 > expiry_ms)",
    "ttl_sweep": f"WITH {_TTL} SELECT 1705276800000 >= expiry_ms AS expired, count(*) AS n FROM t GROUP BY 1",
    "ttl_sample": f"WITH {_TTL} SELECT key, expiry_ms FROM t ORDER BY md5(key), key LIMIT 20",
    "ttl_trigger": f"WITH {_TTL}, s AS (SELECT * FROM t ORDER BY md5(key), key LIMIT 20) SELECT count(*) AS sampled, count(*) FILTER (1705276800000 >= expiry_ms) AS expired, count(*) FILTER (1705276800000 >= expiry_ms) >= 5 AS sweep FROM s",
    "ttl_units": f"WITH {_O}, u AS (SELECT seq, ['SECONDS','MINUTES','HOURS','DAYS'][seq%4+1] AS unit, 1+seq%240 AS amount FROM o) SELECT seq, unit, amount, amount*[1000,60000,3600000,86400000][seq%4+1] AS millis FROM u",
    "run_flush": f"WITH {_RUNS} SELECT run_id, count(*) AS n_entries, min(key) AS min_key, max(key) AS max_key, max(seq) AS max_seq FROM r GROUP BY 1",
    "run_catalog": f"WITH {_RUNS} SELECT run_id, 0 AS level, count(*) AS n_records, max(key) AS max_key, (SELECT max(run_id)+1 FROM r) AS next_run_id FROM r GROUP BY 1",
    "wal_tail": f"WITH {_L}, c AS (SELECT *, row_number() OVER (ORDER BY seq)-1 AS n FROM l) SELECT seq, key, value FROM c WHERE n >= (SELECT count(*)//1024*1024 FROM l)",
    "compact_newest": f"WITH {_RUNS} " + _MERGE.format("DESC"),
    "compact_oldest": f"WITH {_RUNS} " + _MERGE.format("ASC"),
    "compact_purge": f"""WITH {_O}, p AS (SELECT *, (row_number() OVER (ORDER BY seq)-1)//1000 AS run_id FROM o WHERE op<>'PUT_TTL'),
      q AS (SELECT *, run_id//4 AS grp, row_number() OVER (PARTITION BY run_id//4, key ORDER BY seq DESC) AS rn, min(run_id//4) OVER (PARTITION BY key) AS g0 FROM p)
      SELECT grp, key, run_id, seq, op, value FROM q WHERE rn=1 AND NOT (op='DELETE' AND g0=grp)""",
    "tier_membership": f"WITH {_MEMBER} SELECT run_id, level, run_id // CAST(pow(4,level) AS BIGINT) AS merged_run FROM m",
    "tier_levels": f"WITH {_RUNS}, {_N} SELECT CAST(x AS INTEGER) AS level, n // CAST(pow(4,x) AS BIGINT) % 4 AS n_runs FROM n, range(12) t(x) WHERE n // CAST(pow(4,x) AS BIGINT) % 4 > 0",
    "tiered_get": f"WITH {_TIERED} SELECT key, level, run_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level, run_id DESC) AS rn FROM tr) WHERE rn=1",
    "tiered_get_as_coded": f"WITH {_TIERED} SELECT key, level, run_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level, run_id) AS rn FROM tr) WHERE rn=1",
    "kv_as_coded_delete": f"""WITH {_O}, p AS (SELECT *, (row_number() OVER (ORDER BY seq)-1)//50 AS run_id FROM o WHERE op<>'PUT_TTL'),
      f AS (SELECT *, min(CASE WHEN op='PUT' THEN seq END) OVER (PARTITION BY key, run_id) AS fp FROM p),
      k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM f WHERE op='PUT' OR fp<seq) SELECT key, value FROM k WHERE rn=1 AND op='PUT'""",
    "bloom_sha": _hash("bloom_sha"),
    "bloom_fnv": _hash("bloom_fnv"),
    "bloom_mur": _hash("bloom_mur"),
    "bloom_build": f"WITH {_BITS} SELECT run_id, bit FROM bits",
    "bloom_probe": f"WITH {_PROBE} SELECT * FROM pr",
    "sparse_index": f'WITH RECURSIVE {_RUNS}, {_INDEX} SELECT run_id, key, "offset" FROM ix',
    "index_floor": f"WITH RECURSIVE {_RUNS}, {_INDEX}, {_FLOOR} SELECT * FROM fl",
    "run_probe": f"""WITH RECURSIVE {_PROBE}, {_INDEX}, {_FLOOR} SELECT pr.run_id, pr.key, may_contain, CASE WHEN may_contain THEN fl."offset" END AS "offset",
      CASE WHEN may_contain THEN r.value END AS value FROM pr JOIN fl USING (run_id, key) LEFT JOIN r USING (run_id, key)""",
    "wal_delta": f"WITH {_O}, d AS (SELECT seq, ts_ms - lag(ts_ms,1,0) OVER (ORDER BY seq) AS delta FROM o) SELECT seq, delta, delta & 4294967295 AS stored FROM d",
    "wal_batches": f"WITH {_O}, b AS (SELECT seq, (row_number() OVER (ORDER BY seq)-1)//200 AS batch_id FROM o) SELECT batch_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM b GROUP BY 1",
    "log_compact": f"WITH {_O}, p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM o WHERE op<>'PUT_TTL') SELECT key, seq, ts_ms, op, value FROM p WHERE rn=1 AND op='PUT'",
    "lru_final": f"WITH {_L} SELECT key, max(seq) AS last_seq FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500",
    "lru_hits": f"""WITH {_O}, a AS (SELECT seq, key, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS ps, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS ns FROM o),
      g AS (SELECT x.seq, count(y.seq) AS d FROM a x LEFT JOIN a y ON y.seq > x.ps AND y.seq < x.seq AND (y.ns IS NULL OR y.ns > x.seq) WHERE x.ps IS NOT NULL GROUP BY 1)
      SELECT (SELECT count(*) FROM a) AS accesses, (SELECT count(*) FROM g WHERE d < 50) AS hits""",
}

ORACLE["stream_latest"] = ORACLE["kv_latest"]
ORACLE["stream_ttl_live"] = ORACLE["ttl_live"]

_OP_RUNS = f"""{_O}, cut AS (SELECT *, (row_number() OVER (ORDER BY seq)-1)//1000 AS run_id FROM o WHERE op<>'PUT_TTL'),
  r AS (SELECT run_id, key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) AS rn FROM cut) WHERE rn=1)"""
ORACLE["tiered_get_deleted"] = f"""WITH {_OP_RUNS}, n AS (SELECT count(DISTINCT run_id)-1 AS n FROM r),
  m AS (SELECT run_id, CASE WHEN run_id=n THEN -1 ELSE CAST({_LEVEL} AS INTEGER) END AS level FROM (SELECT DISTINCT run_id FROM r), n),
  w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level, run_id DESC) AS rn FROM r JOIN m USING (run_id))
  SELECT key, level, run_id, seq, value FROM w WHERE rn=1 AND op<>'DELETE'"""
ORACLE["compact_tiers"] = f"""WITH {_MEMBER}, g AS (SELECT r.*, level, run_id // CAST(pow(4,level) AS BIGINT) AS merged_run FROM r JOIN m USING (run_id))
  SELECT level, merged_run, key, run_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY level, merged_run, key ORDER BY run_id DESC) AS rn FROM g) WHERE rn=1"""
ORACLE["compact_files"] = ORACLE["compact_newest"]
ORACLE["log_replay"] = ORACLE["kv_latest"]
ORACLE["index_text"] = f'WITH RECURSIVE {_RUNS}, {_INDEX} SELECT key, "offset" FROM ix WHERE run_id=0'
ORACLE["run_flush_full"] = f"""WITH RECURSIVE {_L}, a AS (SELECT *, CAST(split_part(key, ':', 2) AS BIGINT)%8 AS part FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY seq) AS n FROM a),
  f AS (SELECT part, 0::BIGINT AS n, []::VARCHAR[] AS held, 0::BIGINT AS run_id, 0::BIGINT AS next_run FROM (SELECT DISTINCT part FROM a)
    UNION ALL SELECT f.part, b.n, CASE WHEN len(f.held) + CASE WHEN list_contains(f.held, b.key) THEN 0 ELSE 1 END >= 50 THEN [] WHEN list_contains(f.held, b.key) THEN f.held ELSE list_append(f.held, b.key) END,
      f.next_run, f.next_run + CASE WHEN len(f.held) + CASE WHEN list_contains(f.held, b.key) THEN 0 ELSE 1 END >= 50 THEN 1 ELSE 0 END
    FROM f JOIN b ON b.part=f.part AND b.n=f.n+1)
  SELECT CAST(b.part AS INTEGER) AS part, run_id, count(DISTINCT key) AS n_entries, min(key) AS min_key, max(key) AS max_key, max(seq) AS max_seq FROM b JOIN f USING (part, n) GROUP BY 1, 2"""
ORACLE["lru_ops"] = """WITH RECURSIVE a AS (SELECT user_id%8 AS part, event_id AS seq, user_id::VARCHAR AS key, CASE event_type WHEN 'view' THEN 'GET' WHEN 'error' THEN 'DELETE' ELSE 'PUT' END AS op FROM events),
  b AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY seq) AS n FROM a),
  f AS (SELECT part, 0::BIGINT AS n, []::VARCHAR[] AS c, 0::BIGINT AS gets, 0::BIGINT AS hits, 0::BIGINT AS evictions FROM (SELECT DISTINCT part FROM a)
    UNION ALL SELECT f.part, b.n,
      CASE WHEN op='DELETE' THEN list_filter(c, lambda x: x<>b.key) WHEN op='GET' THEN CASE WHEN list_contains(c, b.key) THEN list_append(list_filter(c, lambda x: x<>b.key), b.key) ELSE c END
        WHEN list_contains(c, b.key) THEN list_append(list_filter(c, lambda x: x<>b.key), b.key) WHEN len(c)>=30 THEN list_append(c[2:], b.key) ELSE list_append(c, b.key) END,
      gets + CASE WHEN op='GET' THEN 1 ELSE 0 END, hits + CASE WHEN op='GET' AND list_contains(c, b.key) THEN 1 ELSE 0 END,
      evictions + CASE WHEN op='PUT' AND NOT list_contains(c, b.key) AND len(c)>=30 THEN 1 ELSE 0 END
    FROM f JOIN b ON b.part=f.part AND b.n=f.n+1)
  SELECT CAST(part AS INTEGER) AS part, gets, hits, evictions, len(c) AS size FROM f WHERE n=(SELECT max(n) FROM b WHERE b.part=f.part)"""
_TEXT = "list_concat([strlen({0})//256, strlen({0})%256], list_transform(range(1, length({0})+1), lambda i: ascii(substr({0}, i, 1))::BIGINT))"
ORACLE["wal_crc"] = f"""WITH {_O}, t AS (SELECT list(list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]::BIGINT[]), lambda c, b: CASE WHEN c&1=1 THEN xor(c>>1, 3988292384) ELSE c>>1 END) ORDER BY i) AS tab FROM range(256) r(i)),
  d AS (SELECT seq, ts_ms - lag(ts_ms,1,0) OVER (ORDER BY seq) AS delta, key, coalesce(value, '') AS value FROM o),
  p AS (SELECT seq, list_concat(list_transform(range(0, 8), lambda i: (delta >> (56-8*i)) & 255), list_concat({_TEXT.format('key')}, {_TEXT.format('value')})) AS bytes FROM d)
  SELECT seq, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c>>8, tab[(xor(c,b)&255)+1])), 4294967295) AS checksum FROM p, t"""

_STORED = """e AS (SELECT store_id, key, value, CASE WHEN TTL AND expiryTime<>0 THEN expiryTime END AS expiry_ms FROM ttl_entry WHERE store_id IS NOT NULL AND key IS NOT NULL),
  t AS (SELECT store_id, key, value, expiry_ms FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY expiry_ms DESC NULLS FIRST, value DESC NULLS LAST) AS rn FROM e) WHERE rn=1)"""
ORACLE["ttl_stored_live"] = f"WITH {_STORED} SELECT * FROM t WHERE expiry_ms IS NULL OR expiry_ms >= 1768700000000"
ORACLE["ttl_stored_sweep"] = f"WITH {_STORED} SELECT coalesce(expiry_ms <= 1768700000000, false) AS expired, count(*) AS n FROM t GROUP BY 1"
